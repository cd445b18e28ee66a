"""Tables of the store: schemas, writers and the statements that read them.

Tables are Parquet folders under one root. Changes are appended as new versions of a row, and reading
takes the newest version by key, so that no writer has to rewrite what others read.
"""

from __future__ import annotations

import tempfile
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sitelens.functions.columns import trim

#: Columns of the tables that the store keeps, and values that some columns may have.
SCHEMAS = {
    "audits": "id string, created_at timestamp, email string, host string, url string, market string, status string, mode string, overall_score int, seo_score int, aeo_score int, geo_score int, ai_presence_score int, pages_crawled int, pages_discovered int, page_rank double, scoring_version string, error string, started_at timestamp, completed_at timestamp, result string",
    "audit_stages": "audit_id string, stage string, status string, detail string, at timestamp",
    "audit_pages": "audit_id string, page_ord bigint, url string, status_code int, depth int, word_count bigint, title string, signals string",
    "findings": "audit_id string, check_ord int, check_id string, pillar string, `group` string, status string, score double, weight double, confidence double",
    "recommendations": "audit_id string, id string, check_id string, pillar string, horizon string, impact string, effort string, rank int",
    "competitors": "audit_id string, ord int, host string, status string, seo int, aeo int, geo int, overall int",
    "ai_queries": "audit_id string, engine string, prompt string, sample_index int, answer string, cited_domains array<string>",
    "ai_mentions": "audit_id string, engine string, prompt string, sample_index int, brand_mentioned boolean, ordinal int, cited_brand_domain boolean, sentiment string",
    "question_gaps": "audit_id string, q_ord int, question string, intent string, value double, answered boolean, matched_url string",
    "group_scores": "audit_id string, pillar string, `group` string, score double, coverage double, group_weight double",
    "pillar_scores": "audit_id string, pillar string, coverage double, score bigint",
    "leads": "id string, created_at timestamp, audit_id string, name string, company string, designation string, email string, phone string, budget_band string, lead_score int, grade string, status string, is_free_email boolean, email_matches_domain boolean, updated_at timestamp",
    "appointments": "id string, lead_id string, slot timestamp, status string",
    "reports": "audit_id string, created_at timestamp, name string, body string",
    "users": "email string, name string, first_seen timestamp, last_seen timestamp",
    "api_cache": "key string, stored_at timestamp, body string",
    "rate_limits": "scope string, key string, window_start timestamp, hits bigint",
}
ALLOWED = {
    ("audits", "status"): ("queued", "running", "complete", "failed"), ("audits", "mode"): ("A", "B", "C"),
    ("findings", "status"): ("pass", "warn", "fail", "opportunity", "unavailable", "not_applicable"), ("leads", "status"): ("new", "contacted", "qualified", "won", "lost"), ("leads", "grade"): ("A", "B", "C", "D"),
}
_VERSION = "_version"


def shared_folder(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``; one of our own only where all of Spark is one process."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    spark.conf.set("spark.checkpoint.dir", tempfile.mkdtemp(prefix="checkpoint-"))
    return spark.conf.get("spark.checkpoint.dir")


class Store:
    """Tables under a folder."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def path(self, name: str) -> str:
        if name not in SCHEMAS:
            raise KeyError(name)
        return f"{self.root}/{name}"

    def exists(self, name: str) -> bool:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path(name))
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(path)

    def create(self) -> list[str]:
        """Makes the tables that are not there, and says which; doing it again changes nothing."""
        made = [n for n in SCHEMAS if not self.exists(n)]
        for name in made:
            self.spark.createDataFrame([], f"{SCHEMAS[name]}, {_VERSION} timestamp").write.parquet(self.path(name))
        return made

    def table_count(self) -> int:
        return sum(self.exists(n) for n in SCHEMAS)

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.schema(f"{SCHEMAS[name]}, {_VERSION} timestamp").parquet(self.path(name))

    def read(self, name: str) -> DataFrame:
        return self.raw(name).drop(_VERSION)

    def append(self, name: str, rows: DataFrame) -> DataFrame:
        """Adds rows and returns them with all columns; columns that are not given are null."""
        schema = self.spark.createDataFrame([], SCHEMAS[name]).schema
        full = rows.select(*[(F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema])
        bad = self.violations(name, full)
        if not bad.isEmpty():
            raise ValueError(f"{name}: a column has a value that it may not have")
        full.withColumn(_VERSION, F.current_timestamp()).write.mode("append").parquet(self.path(name))
        return full

    @staticmethod
    def violations(name: str, rows: DataFrame) -> DataFrame:
        rules = [F.col(c).isNotNull() & ~F.col(c).isin(*values) for (t, c), values in ALLOWED.items() if t == name]
        return rows.where(reduce(lambda a, b: a | b, rules, F.lit(False)))

    def latest(self, name: str, *key: str) -> DataFrame:
        """The newest version of each row."""
        return latest(self.raw(name), list(key), [_VERSION]).drop(_VERSION)

    def update(self, name: str, key: str, changes: DataFrame) -> None:
        """Writes new versions of the rows that ``changes`` names, with its columns in place of theirs."""
        new = [c for c in changes.columns if c != key]
        old = self.latest(name, key)
        joined = old.join(changes.select(key, *[F.col(c).alias(f"_new_{c}") for c in new]), key)
        self.append(name, joined.select(*[F.coalesce(f"_new_{c}", c).alias(c) if c in new else F.col(f"`{c}`") for c in old.columns]))

    def views(self) -> None:
        """The tables under their names, for SQL."""
        for name in SCHEMAS:
            if self.exists(name):
                self.read(name).createOrReplaceTempView(name)


def latest(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """One row for each key, that with the greatest ``order``."""
    turn = F.row_number().over(Window.partitionBy(*key).orderBy(*[F.desc(c) for c in order]))
    return rows.withColumn("_turn", turn).where("_turn = 1").drop("_turn")


def newest(rows: DataFrame, most: int, by: str = "created_at", tie: str = "id") -> DataFrame:
    return rows.orderBy(F.desc(by), F.desc(tie)).limit(most)


def completed_for_host(audits: DataFrame, host: str, most: int = 20) -> DataFrame:
    return newest(audits.where((F.col("host") == host) & (F.col("status") == "complete")), most)


def stages_of(stages: DataFrame, audit_id: str) -> DataFrame:
    """The newest event of each stage of an audit."""
    return latest(stages.where(F.col("audit_id") == audit_id), ["audit_id", "stage"], ["at"]).orderBy("at")


def deny_by_default(rows: DataFrame, owner: str, email: str | None) -> DataFrame:
    """Rows of one owner; none for a caller without an address."""
    return rows.where(F.lower(owner) == email.strip().lower()) if email and email.strip() else rows.where(F.lit(False))


def stored(df: DataFrame) -> DataFrame:
    """The frame written in the shared folder and read again, which cuts its lineage."""
    path = f"{shared_folder(df.sparkSession)}/stored-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def version(rows: DataFrame) -> str:
    """A name for the state of the files that ``rows`` are read from: their paths, sizes and times."""
    files = rows.select("_metadata.file_path", "_metadata.file_size", "_metadata.file_modification_time").groupBy("file_path", "file_size", "file_modification_time").count()
    made = files.agg(F.sum(F.xxhash64("file_path", "file_size", "file_modification_time", "count").cast("decimal(38,0)")).alias("h"), F.count("*").alias("n")).first()
    return f"{made.n}-{int(made.h or 0) % (1 << 64):016x}"


def kept(spark: SparkSession, name: str, make) -> DataFrame:
    """The table ``name`` of the shared folder, made by ``make()`` the first time it is asked for.

    It is written aside and moved into place whole, so that readers never see a part and of several writers one wins.
    """
    jvm, folder = spark._jvm, f"{shared_folder(spark)}/kept"
    path = jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}")
    files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not files.exists(path):
        aside = jvm.org.apache.hadoop.fs.Path(f"{folder}/{uuid.uuid4().hex}")
        make().write.parquet(aside.toString())
        if files.exists(path) or not files.rename(aside, path):
            files.delete(aside, True)
    return spark.read.parquet(path.toString())


def append_sheet(rows: DataFrame, path: str) -> None:
    """Rows at the end of a spreadsheet kept as CSV."""
    rows.write.mode("append").option("header", True).csv(path)


def upsert_users(known: DataFrame, seen: DataFrame) -> DataFrame:
    """``known`` and ``seen``: email, name, at. One row for each address whatever its case, with first and last time seen and the newest name."""
    every = known.unionByName(seen).withColumn("email", F.lower(trim(F.col("email"))))
    return every.groupBy("email").agg(F.max_by("name", F.when(F.col("name").isNotNull(), F.col("at"))).alias("name"), F.min("at").alias("first_seen"), F.max("at").alias("last_seen"))


def as_json(rows: DataFrame) -> DataFrame:
    """Each row as one JSON text, nulls left out."""
    return rows.select(F.to_json(F.struct(*[F.col(f"`{c}`") for c in rows.columns])).alias("json"))


def audit_result(**parts: DataFrame) -> DataFrame:
    """All parts of an audit as one JSON text by audit_id."""
    out = None
    for name, rows in parts.items():
        one = rows.groupBy("audit_id").agg(F.collect_list(F.struct(*[F.col(f"`{c}`") for c in rows.columns if c != "audit_id"])).alias(name))
        out = one if out is None else out.join(one, "audit_id", "full")
    return out.select("audit_id", F.to_json(F.struct(*parts)).alias("result"))
