"""Fetched pages and API answers as tables: files in, rows out. Nothing here opens a connection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MOST_BYTES = 2_000_000
FETCH = "audit_id string, page_ord bigint, url string, final_url string, depth int, status_code int, content_type string, headers map<string,string>, redirect_chain array<string>, load_ms bigint, error string, body string"
MOST_REDIRECTS = 10


def capped(body: Column, most: int = MOST_BYTES) -> tuple[Column, Column, Column]:
    """Of a binary body: text of its first ``most`` bytes, their number, and whether more were cut off. Broken UTF-8 is replaced."""
    n = F.octet_length(body)
    head = F.when(n > most, F.substring(body, 1, most)).otherwise(body)
    return F.decode(head, "UTF-8"), F.least(n, F.lit(most)).cast("bigint"), n > most


def saved_pages(spark: SparkSession, path: str, audit_id: str, base: str, most: int = MOST_BYTES) -> DataFrame:
    """HTML files under a folder as fetches; a file's address is ``base`` and its path below the folder."""
    root = path.rstrip("/") + "/"
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.htm*").load(path)
    tail = F.regexp_replace(F.substring_index(F.col("path"), root, -1), r"(^|/)index\.html?$", "$1")
    text, size, cut = capped(F.col("content"), most)
    url = F.concat(F.lit(base.rstrip("/") + "/"), tail)
    return files.select(
        F.lit(audit_id).alias("audit_id"), F.xxhash64("path").alias("page_ord"), url.alias("url"), url.alias("final_url"), F.size(F.filter(F.split(tail, "/"), lambda p: p != "")).alias("depth"),
        F.lit(200).alias("status_code"), F.lit("text/html").alias("content_type"), F.lit(None).cast("string").alias("error"), text.alias("html"), size.alias("bytes"), cut.alias("truncated"),
    )


def followed(fetches: DataFrame, redirects: DataFrame, most: int = MOST_REDIRECTS) -> DataFrame:
    """Fetches with the chain of ``redirects`` (url, location) from their address; a longer chain than ``most`` is an error."""
    out = fetches.withColumns({"final_url": F.col("url"), "redirect_chain": F.array().cast("array<string>")})
    hop = redirects.groupBy(F.col("url").alias("_from")).agg(F.min("location").alias("_to"))
    for _ in range(most + 1):
        met = out.join(hop, F.col("final_url") == F.col("_from"), "left")
        out = met.withColumn("redirect_chain", F.when(F.col("_to").isNotNull(), F.concat("redirect_chain", F.array("_to"))).otherwise(F.col("redirect_chain"))).withColumn("final_url", F.coalesce("_to", "final_url")).drop("_from", "_to")
    return out.withColumn("error", F.when(F.size("redirect_chain") > most, "too many redirects"))


def answers(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Saved JSON answers, one a line: ok, data by ``schema``, and the text of those that do not parse."""
    lines = spark.read.text(path)
    parsed = lines.withColumn("data", F.from_json("value", schema)).withColumn("ok", F.try_parse_json("value").isNotNull() & F.col("data").isNotNull())
    return parsed.select("ok", F.when(F.col("ok"), F.col("data")).alias("data"), F.when(~F.col("ok"), F.col("value")).alias("error"))
