"""Hard negatives by blocked dense products of anchors and candidates.

Anchors are dealt into blocks of about ``BLOCK_BYTES``, by a hash of their ids. A block is broadcast, and
every task multiplies it with its candidates, in float64, where products below 2^53 are exact; blocks of
rows that may exceed it are multiplied as Python integers. The first pass leaves the best positives of
each anchor, the second, within the window that each positive opens, the best negatives. Both keep a
running best of each task's rows, which merge by Spark, so that a task sends on a few rows of each anchor
whatever it reads.

Rows with a null id, label or vector, or with a null or non-finite component, take no part. Vectors meet
those of their own length only; empty ones have products of 0. Equal rows count once: candidates with one
vec_id are listed once, with the highest of their products, and of anchors with one vec_id the smallest by
label and vector counts. A product beyond the range of a long counts as the nearest long. An anchor
without positives, or a positive without negatives in its window, gives no rows; so does an empty table.
Only vec_id, embedding and label are read.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sitelens.llm.common import finished_shuffles_go, shared_folder, table

EVERY, POSITIVES, NEGATIVES, LOW, HIGH = 100, 5, 5, 80, 100
SCALE, NOISE, CLASSES = 256, 7, 10
BLOCK_BYTES, CELLS = 1 << 25, 1 << 21
_EXACT, _LONG = 2**53, 2**63
_NONE = -_LONG
_HUGE = np.finfo(np.float64).max


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, label with its noise, embedding as doubles."""
    label = F.col("label").cast("bigint")
    noisy = F.when(F.col("vec_id") % NOISE == 0, (label + 1) % CLASSES).otherwise(label)
    good = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    chosen = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), noisy.alias("label"), "embedding")
    return chosen.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull()).where(good)


def anchors_of(rows: DataFrame) -> DataFrame:
    return rows.where(F.col("vec_id") % EVERY == 0).groupBy("vec_id").agg(F.min(F.struct("label", "embedding")).alias("r")).select("vec_id", "r.label", "r.embedding")


class Side:
    """Rows of one vector length: ids, labels and whole components, sorted by id."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray):
        order = np.argsort(ids, kind="stable")
        with np.errstate(over="ignore"):
            whole = np.clip(np.floor(vectors[order] * SCALE), -_HUGE, _HUGE)
        self.ids, self.labels, self.x = ids[order], labels[order], whole
        self.largest = np.abs(whole).max(axis=1, initial=0.0)

    def part(self, rows: slice) -> Side:
        out = object.__new__(Side)
        out.ids, out.labels, out.x, out.largest = self.ids[rows], self.labels[rows], self.x[rows], self.largest[rows]
        return out


def sides(batch: pa.RecordBatch) -> dict[int, Side]:
    """Rows of an Arrow batch by vector length."""
    column = batch.column("embedding")
    ends = np.asarray(column.offsets)
    size = np.diff(ends)
    flat = column.values.to_numpy(zero_copy_only=False).astype(np.float64)
    ids, labels = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("vec_id", "label"))
    out = {}
    for n in np.unique(size):
        mine = np.flatnonzero(size == n)
        out[int(n)] = Side(ids[mine], labels[mine], flat[ends[mine][:, None] + np.arange(n)])
    return out


def products(a: Side, c: Side) -> np.ndarray:
    """Whole inner products, rows of ``a`` by rows of ``c``; no larger than a long."""
    size = max(a.x.shape[1], 1)
    with np.errstate(over="ignore", invalid="ignore"):
        rough = a.x @ c.x.T
        if a.largest.max(initial=0.0) * c.largest.max(initial=0.0) * size < _EXACT:
            return rough.astype(np.int64)
        doubtful = np.multiply.outer(a.largest, c.largest) * size >= _EXACT
    out = np.where(doubtful, 0, rough).astype(np.int64)
    for i, j in zip(*np.nonzero(doubtful), strict=True):
        exact = sum(int(p) * int(q) for p, q in zip(a.x[i], c.x[j], strict=True))
        out[i, j] = max(min(exact, _LONG - 1), 1 - _LONG)
    return out


def blocks_of(a: Side, c: Side) -> Iterator[tuple[slice, Side, Side]]:
    """Parts whose table of products has about ``CELLS`` cells."""
    wide = max(1, min(len(c.ids), 2048))
    high = max(1, CELLS // wide)
    for i in range(0, len(a.ids), high):
        rows = slice(i, min(i + high, len(a.ids)))
        for j in range(0, len(c.ids), wide):
            yield rows, a.part(rows), c.part(slice(j, j + wide))


class Best:
    """The ``k`` highest scores of each slot, ties to smaller ids, each id once."""

    def __init__(self, slots: int, k: int):
        self.ids = np.zeros((slots, k), np.int64)
        self.scores = np.full((slots, k), _NONE, np.int64)

    def put(self, slots: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        """``scores``: a row for each of ``slots`` and a column for each of ``ids``, which ascend; it is used up."""
        starts = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]]))
        if len(starts) < len(ids):
            scores, ids = np.maximum.reduceat(scores, starts, axis=1), ids[starts]
        k, rows = self.ids.shape[1], np.arange(len(slots))
        found, found_ids = [self.scores[slots]], [self.ids[slots]]
        least = self.scores[slots, -1]
        for _ in range(min(k, len(ids))):
            at = scores.argmax(1)  # the first of equals, so the smallest id
            top = scores[rows, at]
            if not (top > _NONE).any() or (top < least).all():
                break
            found.append(top[:, None])
            found_ids.append(ids[at][:, None])
            scores[rows, at] = _NONE
        if len(found) == 1:
            return
        score, one = np.concatenate(found, axis=1), np.concatenate(found_ids, axis=1)
        # The complement of a score sorts as its negative would, which has no room for the lowest.
        order = np.lexsort((~score, one), axis=1)
        score, one = np.take_along_axis(score, order, 1), np.take_along_axis(one, order, 1)
        again = (one[:, 1:] == one[:, :-1]) & (score[:, :-1] > _NONE)
        score[:, 1:][again] = _NONE
        order = np.lexsort((one, ~score), axis=1)[:, :k]
        self.scores[slots], self.ids[slots] = np.take_along_axis(score, order, 1), np.take_along_axis(one, order, 1)

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        slot, place = np.nonzero(self.scores > _NONE)
        return slot, self.ids[slot, place], self.scores[slot, place]


def best_positives(anchors: dict[int, Side], batches: Iterator[dict[int, Side]], k: int = POSITIVES) -> pd.DataFrame:
    best = {n: Best(len(a.ids), k) for n, a in anchors.items()}
    for batch in batches:
        for n, c in batch.items():
            if n in anchors:
                for rows, a, part in blocks_of(anchors[n], c):
                    score = products(a, part)
                    score[(a.labels[:, None] != part.labels) | (a.ids[:, None] == part.ids)] = _NONE
                    best[n].put(np.arange(rows.start, rows.stop), score, part.ids)
    parts = [(anchors[n].ids[slot], ids, scores) for n, b in best.items() for slot, ids, scores in [b.rows()]]
    return pd.DataFrame({name: np.concatenate([p[i] for p in parts]) if parts else [] for i, name in enumerate(("anchor_id", "positive_id", "positive_score"))}, dtype=np.int64)


def best_negatives(anchors: dict[int, Side], positives: dict[int, tuple[np.ndarray, np.ndarray]], batches: Iterator[dict[int, Side]], k: int = NEGATIVES) -> pd.DataFrame:
    """``positives``: ids and scores of the positives of each anchor id. One slot for each anchor and place of a positive."""
    best, window = {}, {}
    for n, a in anchors.items():
        most = max([len(positives[i][0]) for i in a.ids.tolist() if i in positives], default=0)
        low, high = np.full((len(a.ids), most), _LONG - 1), np.full((len(a.ids), most), _NONE)
        for row, i in enumerate(a.ids.tolist()):
            for place, p in enumerate(positives.get(i, ((), ()))[1]):
                low[row, place], high[row, place] = -(-LOW * int(p) // 100), HIGH * int(p) // 100
        best[n], window[n] = [Best(len(a.ids), k) for _ in range(most)], (low, high)
    for batch in batches:
        for n, c in batch.items():
            for rows, a, part in blocks_of(anchors[n], c) if n in anchors else ():
                score = products(a, part)
                score[(a.labels[:, None] == part.labels) | (a.ids[:, None] == part.ids)] = _NONE
                for place, b in enumerate(best[n]):
                    low, high = (w[rows, place : place + 1] for w in window[n])
                    inside = (score >= low) & (score <= high) & (score > _NONE)
                    if (some := inside.any(1)).any():
                        b.put(np.arange(rows.start, rows.stop)[some], np.where(inside[some], score[some], _NONE), part.ids)
    parts = []
    for n, many in best.items():
        for place, b in enumerate(many):
            slot, ids, scores = b.rows()
            known = [positives[i] for i in anchors[n].ids[slot].tolist()]
            parts.append((anchors[n].ids[slot], np.array([p[0][place] for p in known], np.int64), np.array([p[1][place] for p in known], np.int64), ids, scores))
    return pd.DataFrame({name: np.concatenate([p[i] for p in parts]) if parts else [] for i, name in enumerate(("anchor_id", "positive_id", "positive_score", "negative_id", "negative_score"))}, dtype=np.int64)


def mine(vectors: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score."""
    spark = vectors.sparkSession
    rows = usable(vectors)
    folder = f"{shared_folder(spark)}/hard-negatives-{uuid.uuid4().hex}"
    shape = "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint"
    with finished_shuffles_go(spark):
        made = anchors_of(rows)
        made.write.parquet(f"{folder}/anchors")
        stored = spark.read.schema(made.schema).parquet(f"{folder}/anchors")
        size = stored.agg(F.sum(F.size("embedding") * 8 + 64)).first()[0] or 0
        blocks = -(-size // block_bytes)
        for number in range(blocks):
            block = stored.where(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == number).toArrow().combine_chunks()
            anchors = spark.sparkContext.broadcast(sides(block.to_batches()[0]) if len(block) else {})
            _mined(rows, anchors).write.parquet(f"{folder}/found/{number}")
            anchors.destroy()
    return spark.read.schema(shape).parquet(*[f"{folder}/found/{n}" for n in range(blocks)]) if blocks else spark.createDataFrame([], shape)


def _mined(rows: DataFrame, anchors) -> DataFrame:
    """Both passes over all rows for one block of anchors."""

    def whole(frame: pd.DataFrame) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_pandas(frame, preserve_index=False)

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return whole(best_positives(anchors.value, map(sides, batches)))

    found = rows.mapInArrow(first, "anchor_id bigint, positive_id bigint, positive_score bigint")
    found = found.groupBy("anchor_id", "positive_id").agg(F.max("positive_score").alias("positive_score"))
    place = F.row_number().over(Window.partitionBy("anchor_id").orderBy(F.desc("positive_score"), "positive_id"))
    kept = found.withColumn("place", place).where(F.col("place") <= POSITIVES).groupBy("anchor_id").agg(F.sort_array(F.collect_list(F.struct("place", "positive_id", "positive_score"))).alias("p"))
    # At most a few positives of each anchor of the block.
    positives = rows.sparkSession.sparkContext.broadcast({r.anchor_id: (tuple(p.positive_id for p in r.p), tuple(p.positive_score for p in r.p)) for r in kept.collect()})

    def second(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return whole(best_negatives(anchors.value, positives.value, map(sides, batches)))

    found = rows.mapInArrow(second, "anchor_id bigint, positive_id bigint, positive_score bigint, negative_id bigint, negative_score bigint")
    found = found.groupBy("anchor_id", "positive_id", "negative_id").agg(F.max("positive_score").alias("positive_score"), F.max("negative_score").alias("negative_score"))
    rank = F.row_number().over(Window.partitionBy("anchor_id", "positive_id").orderBy(F.desc("negative_score"), "negative_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= NEGATIVES).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def op12_hard_negatives(spark, sf_dir):
    return mine(table(spark, sf_dir, "embeddings"))


_ROWS = f"""SELECT vec_id, CASE WHEN vec_id % {NOISE} = 0 THEN (label::BIGINT + 1) % {CLASSES} ELSE label::BIGINT END AS label, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)) AS v
 FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"""
SQL = f"""WITH r AS ({_ROWS}), s AS (SELECT a.vec_id AS anchor_id, a.label AS own, c.vec_id, c.label, list_inner_product(a.v, c.v)::BIGINT AS score FROM r a JOIN r c ON a.vec_id <> c.vec_id AND len(a.v) = len(c.v) WHERE a.vec_id % {EVERY} = 0),
 p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE label = own QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= {POSITIVES})
 SELECT anchor_id, positive_id, (row_number() OVER w)::INT AS rank, vec_id AS negative_id, positive_score, score AS negative_score FROM p JOIN s USING (anchor_id)
 WHERE label <> own AND {LOW} * positive_score <= 100 * score AND 100 * score <= {HIGH} * positive_score WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) QUALIFY row_number() OVER w <= {NEGATIVES}"""
