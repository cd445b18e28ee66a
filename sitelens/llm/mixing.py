"""Mixing sources to target weights along a time-varying curriculum.

Targets: every source's share of all words follows its weight, but stops at ``most`` times
its size; the excess is shared again by weight. A source takes each document whole as often as
the target asks, and once more for the first documents of a hash order until the target is
met exactly; one document per source is cut there. Source s is scheduled with density
``1 + slope * (2 t - 1)`` over training time t; inverting the integral at a document's
place in its source's taken words gives its position, and the result is range-sorted by it.

Sources are a dimension that the driver holds (one small row each); up to ``SOURCES`` of them are
joined by broadcast. A null source is one source, last. Null, empty and blank texts have size 0 and
take nothing. Every row counts for itself, rows that are equal in all columns included. An empty
table gives no rows. Of other columns any name may occur.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sitelens.llm.common import SPACE, WORD, Scratch, table

MOST, WEIGHTS, BUCKET_DOCS, SOURCES = 3, (1, 2, 3), 2_000, 100_000


def targets(sizes: list[int], weights: list[float], most: float = MOST) -> list[float]:
    """Words each source is to give; capped sources pass their excess on by weight."""
    total, out, free = float(sum(sizes)), [0.0] * len(sizes), set(range(len(sizes)))
    left = total
    while free:
        share = left / sum(weights[i] for i in free)
        over = {i for i in free if weights[i] * share > most * sizes[i]}
        for i in over or free:
            out[i] = float(most * sizes[i]) if over else weights[i] * share
        if not over:
            break
        left -= sum(out[i] for i in over)
        free -= over
    return out


def schedule_slope(rank: int) -> float:
    """Slopes of the sources' schedules: early, even, late, repeating."""
    return (-0.5, 0.0, 0.5)[rank % 3]


def invert(share: Column, slope: Column) -> Column:
    """t in [0, 1] with t + slope * (t^2 - t) = share."""
    b = 1 - slope
    return F.when(slope == 0, share).otherwise((F.sqrt(b * b + 4 * slope * share) - b) / (2 * slope))


def _place() -> Column:
    """Order of a source's documents, the same in every run."""
    return F.xxhash64(F.col("doc_id").cast("string"), "text", F.col("source").cast("string"))


def _name(column: str) -> Column:
    return F.col(f"`{column}`")


def _started(docs: DataFrame, most: float = MOST, weights: tuple = WEIGHTS) -> DataFrame:
    """Every row's doc_id, source, size and place, the words of its source ahead of it (start) and the plan of its source."""
    spark = docs.sparkSession
    sized = Scratch(spark).cut(
        docs.select(
            F.col("doc_id").cast("bigint").alias("doc_id"),
            F.col("source").cast("string").alias("source"),
            F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD)).cast("bigint").alias("size"),
            _place().alias("place"),
        )
    )
    found = sized.groupBy("source").agg(F.sum("size").alias("n"), F.count("*").alias("rows")).collect()
    found.sort(key=lambda r: (r.source is None, r.source or ""))
    goal = targets([r.n for r in found], [weights[i % len(weights)] for i in range(len(found))], most)
    rows = [
        (r.source, r.n, float(t), int(most if t >= most * r.n else t // r.n) if r.n else 0, -(-r.rows // max(BUCKET_DOCS, math.isqrt(r.rows))), schedule_slope(i))
        for i, (r, t) in enumerate(zip(found, goal, strict=True))
    ]
    plan = spark.createDataFrame(
        [(*row, max(0, round(row[2]) - row[3] * row[1])) for row in rows],
        "source string, source_size bigint, target double, copies bigint, buckets bigint, slope double, missing bigint",
    )
    # One row a source, as collected above.
    plan = F.broadcast(plan) if len(rows) <= SOURCES else plan
    known = sized.withColumnRenamed("source", "_s").join(plan, F.col("_s").eqNullSafe(F.col("source"))).drop("_s")
    # Buckets are ranges of the hash order, so a large source is summed by many tasks.
    spread = (F.col("place").cast("double") / F.lit(2.0**64) + 0.5) * F.col("buckets")
    known = known.withColumn("bucket", F.least(F.floor(spread), F.col("buckets") - 1))
    sums = known.groupBy("source", "bucket").agg(F.sum("size").alias("in_bucket"))
    by_source = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = sums.select(F.col("source").alias("_s"), F.col("bucket").alias("_b"), F.coalesce(F.sum("in_bucket").over(by_source), F.lit(0)).alias("base"))
    near = Window.partitionBy("source", "bucket").orderBy("place", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    before = known.withColumn("before", F.coalesce(F.sum("size").over(near), F.lit(0)))
    before = before.join(base, F.col("source").eqNullSafe(F.col("_s")) & (F.col("bucket") == F.col("_b"))).drop("_s", "_b")
    return before.withColumn("start", F.col("base") + F.col("before"))


def _taken(rows: DataFrame) -> DataFrame:
    """Rows with size, start and the plan of their source get extra, taken and position."""
    start = F.col("start")
    extra = F.greatest(F.lit(0), F.least(F.col("size"), F.col("missing") - start))
    chosen = rows.withColumn("extra", extra.cast("bigint")).withColumn("taken", F.col("copies") * F.col("size") + F.col("extra"))
    ahead = F.col("copies") * start + F.least(start, F.col("missing"))
    share = F.when(F.col("target") > 0, F.least(F.lit(1.0), (ahead + F.col("taken") / 2) / F.col("target"))).otherwise(0.0)
    return chosen.withColumn("position", invert(share, F.col("slope")))


def mix(docs: DataFrame, most: float = MOST, weights: tuple = WEIGHTS) -> DataFrame:
    """All columns of ``docs`` are not needed: gives doc_id, source, size, source_size, target, taken, copies, extra, position."""
    placed = _taken(_started(docs, most, weights))
    return placed.select("doc_id", "source", "size", "source_size", "target", "taken", "copies", "extra", "position", "place").orderBy("position", "doc_id", "place")


def materialise(docs: DataFrame, columns: list[str]) -> DataFrame:
    """The mix as documents: a row for each copy taken, the last one cut after a word where the mix cuts it.

    Whole texts are shuffled twice, to meet the plan and to be sorted.
    """
    key = ["place", "id", "none"]
    ids = F.col("doc_id").cast("bigint")
    ids = [F.coalesce(ids, F.lit(0).cast("bigint")).alias("id"), ids.isNull().alias("none")]
    # Rows with one id, text and source follow each other in the mix, so the first one's start is that of all.
    first = _started(docs).where("size > 0 and (copies > 0 or start < missing)").select("place", *ids, "start", F.struct("size", "copies", "missing", "target", "slope").alias("plan"))
    first = first.groupBy(*key).agg(F.min("start").alias("start"), F.min("plan").alias("plan"))
    keyed = docs.where("text is not null").select(F.struct(*[_name(c) for c in columns]).alias("row"), _place().alias("place"), *ids, F.xxhash64(*[_name(c) for c in columns]).alias("order"))
    # Numbered by the very columns of the join, which needs no other shuffle then.
    turn = F.row_number().over(Window.partitionBy(*key).orderBy("order"))
    joined = keyed.withColumn("turn", turn).drop("order").join(first, key)
    planned = _taken(joined.select("row", *key, "plan.*", (F.col("start") + (F.col("turn") - 1) * F.col("plan.size")).alias("start"))).where("copies > 0 or extra > 0")
    # Copies share a position, so rows are sorted before they are copied.
    planned = planned.select("row", "copies", "extra", "size", "position", *key).orderBy("position", F.when(~F.col("none"), F.col("id")), "place")
    text = F.col("row.text")
    whole = F.when(F.col("copies") > 0, F.array_repeat(text, F.col("copies").cast("int"))).otherwise(F.array().cast("array<string>"))
    cut = F.array_join(F.slice(F.regexp_extract_all(text, F.lit(f"((?:{SPACE})?{WORD})"), F.lit(1)), 1, F.col("extra").cast("int")), "")
    texts = F.when(F.col("extra") > 0, F.concat(whole, F.array(F.when(F.col("extra") == F.col("size"), text).otherwise(cut)))).otherwise(whole)
    taken = F.col("taken")
    out = [taken.alias(c) if c == "text" else F.char_length(taken).cast("bigint").alias(c) if c == "n_chars" else F.col("row").getField(c).alias(c) for c in columns]
    return planned.select("row", F.explode(texts).alias("taken")).select(*out)


def op8_curriculum_mix(spark, sf_dir):
    mixed = mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "position")
