"""Connected components of a link table by Spark joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitelens.llm.common import Scratch


def components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """``links`` (a, b) to (node, component), the smallest node reachable; linked nodes only.

    Each round takes the smallest label among neighbours and then the label's own label, so that
    chains shorten by halves. Every round is written; the one before goes.
    """
    both = scratch.cut(links.select("a", "b").union(links.select("b", "a")).where("a <> b").distinct())
    label = scratch.cut(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("component")))
    while True:
        seen = both.join(label.select(F.col("node").alias("b"), "component"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("near"))
        near = label.join(seen, "node").select("node", F.least("component", "near").alias("near"), "component")
        up = label.select(F.col("node").alias("near"), F.col("component").alias("far"))
        new = scratch.cut(near.join(up, "near", "left").select("node", F.least("near", F.coalesce("far", "near")).alias("component"), F.col("component").alias("old")))
        scratch.drop(label)
        label = new
        if new.where("component <> old").isEmpty():
            scratch.drop(both)
            return new.select("node", "component")
