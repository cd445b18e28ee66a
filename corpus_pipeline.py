"""A training corpus from ``documents``: quality, near duplicates, secrets, mixing, packing."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sitelens.llm import jaccard_join, mixing, packing, quality, secrets
from sitelens.llm.common import finished_shuffles_go, shared_folder, table

#: Chunks of text whose ids a worker of the packing stage remembers.
REMEMBERED = 100_000


def _free(docs: DataFrame, name: str) -> str:
    """``name``, lengthened until no column is called so."""
    taken = {c.lower() for c in docs.columns}
    while name in taken:
        name += "_"
    return name


def _columns(docs: DataFrame) -> list:
    return [F.col(f"`{c}`") for c in docs.columns]


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents whose score reaches the threshold.

    Null and empty texts are scored like any other; equal texts fare alike; an empty table stays empty.
    """
    name = _free(docs, "_quality")
    scored = quality.score(docs, quality.trained(spark, docs, sf_dir), name)
    return scored.where(F.col(name) >= quality.THRESHOLD).select(*_columns(docs))


def near_duplicates_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group at five-word shingles and similarity 0.8: that with the smallest doc_id.

    Of rows with that doc_id and different texts the one with the smallest text hash stays; of rows equal in
    both, the first by a hash of all columns. Null and empty texts are in no group and all stay, as do rows
    without id.
    """
    found = jaccard_join.join(docs, percent=80, width=5).where("group is not null")
    best = found.groupBy("group").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("members")).where("members > 1")
    first = found.join(best.select("group", "doc_id"), ["group", "doc_id"]).groupBy("group", "doc_id").agg(F.min("text_hash").alias("text_hash"))
    member = found.join(best.select("group"), "group", "left_semi").select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"), "group").distinct()
    stays = member.join(first, "group").select("_id", "_hash", ((F.col("_id") == F.col("doc_id")) & (F.col("_hash") == F.col("text_hash"))).alias("_stays"))
    rows = docs.select(F.struct(*_columns(docs)).alias("_row"), F.col("doc_id").cast("bigint").alias("_doc"), jaccard_join.text_hash().alias("_text"), F.xxhash64(*_columns(docs)).alias("_order"))
    joined = rows.join(stays, (F.col("_doc") == F.col("_id")) & (F.col("_text") == F.col("_hash")), "left").where("_stays is null or _stays")
    turn = F.row_number().over(Window.partitionBy("_doc", "_text").orderBy("_order"))
    kept = joined.where("_stays").withColumn("_turn", turn).where("_turn = 1").select("_row").unionByName(joined.where("_stays is null").select("_row"))
    return kept.select("_row.*")


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Masks secrets in the texts; n_chars follows. Null stays null, every row stays."""
    name = _free(docs, "_scan")
    scanned = secrets.scan(docs, name=name)
    text = F.when(F.col("text").isNotNull(), F.col(f"{name}.text")).alias("text")
    chars = F.when(F.col(f"{name}.n_secrets") > 0, F.char_length(f"{name}.text").cast("bigint")).otherwise(F.col("n_chars")).alias("n_chars")
    return scanned.select(*[text if c == "text" else chars if c == "n_chars" else F.col(f"`{c}`") for c in docs.columns])


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes each document as often as the mix does, in training order; documents it takes no word of go.

    These are null, empty and blank texts, and the last of a source whose target is below its size.
    """
    return mixing.materialise(docs, docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs every row into sequences, pieces with their ids; repeats of a document are packed each for itself. A null text is empty."""
    # Workers hold the models of earlier stages too, so the encoder remembers less here.
    return packing.packed(docs, remembered=REMEMBERED)


STAGES = [
    ("quality", quality_stage),
    ("near_duplicates", near_duplicates_stage),
    ("secrets", secrets_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]
#: Models and tokenizers are beyond SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{k}_{name}"
        with finished_shuffles_go(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
