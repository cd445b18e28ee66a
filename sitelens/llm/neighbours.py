"""Approximate nearest neighbours with balanced posting lists.

The number of lists grows with the square root of the rows, up to ``LISTS``; centroids are fitted on a
sample of at most ``SAMPLE`` vectors. Every vector goes to its nearest list, and a boundary vector
to further lists whose centroids are nearly as near. A graph of centroids, held in memory, is
searched for both. A query probes its ``FIRST`` nearest lists, and further ones whose distance is within a ratio of the last of these.
The ratio is measured on the data: the true nearest of all rows are found for ``TRIED`` of the queries by brute force,
and it is the smallest that reaches ``RECALL`` of them, up to all lists. Of the further lists only rows within the k-th distance
found in the first ones are sent on, which loses none. Lists, and the queries that probe
one, are dealt in blocks of about ``BLOCK`` rows, each pair of which is a task of its own. A query
whose lists hold fewer than ``k`` candidates probes all lists. Lists are told apart by coordinates around the sample's mean in
double precision, so neither a common offset nor large components blur them.

Vectors that are null, zero, or hold null or non-finite components take no part. Vectors are near only
to those of their own length; each length has its own lists. Rows with one vec_id count as one
candidate, as near as the nearest of them; rows without it take no part. With fewer than k candidates
all are returned; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sitelens.llm.common import Scratch, sampled, table

K, SAMPLE, LISTS, DEGREE = 10, 32_768, 16_384, 16
CLOSURE, COPIES, BLOCK, EVERY = 1.1, 4, 4096, 100
#: Lists probed before the others.
FIRST = 16
#: The recall that pruning has on the queries it is measured with, and how many these are.
RECALL, TRIED = 0.97, 128


def usable(vectors: DataFrame) -> DataFrame:
    good = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists("embedding", lambda x: x != 0)
    single = vectors.schema["embedding"].dataType.elementType.typeName() == "float"
    kind = "array<float>" if single else "array<double>"
    chosen = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("embedding").cast(kind).alias("embedding"))
    return chosen.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & (F.size("embedding") > 0)).where(good)


class CentroidGraph:
    """Centroids and their nearest neighbours among themselves."""

    def __init__(self, centroids: np.ndarray, degree: int = DEGREE, middle: np.ndarray | float = 0.0, scale: float = 1.0):
        self.c, self.middle, self.scale = centroids.astype(np.float64), middle, scale
        square = (self.c**2).sum(1)
        parts = np.array_split(np.arange(len(self.c)), max(1, len(self.c) // 512))
        near = np.concatenate([np.argsort(square - 2 * self.c[p] @ self.c.T, axis=1, kind="stable")[:, 1 : degree + 1] for p in parts])
        # A ring keeps the graph connected.
        ring = (np.arange(len(self.c))[:, None] + 1) % len(self.c)
        self.links = np.concatenate([near, ring], axis=1)

    def placed(self, vectors) -> np.ndarray:
        """Vectors in the coordinates of the centroids."""
        return (np.stack(list(vectors)).astype(np.float64) - self.middle) / self.scale

    def distances(self, x: np.ndarray, at: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(((x[:, None, :] - self.c[at]) ** 2).sum(2), 0))

    def search(self, x: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """Nearest centroids of each row, nearest first, by best-first steps over the graph."""
        n, lists = len(x), len(self.c)
        beam = min(beam, lists)
        if 8 * beam >= lists:
            # So many steps would cost more than all distances do.
            dist = np.sqrt(np.maximum((x**2).sum(1)[:, None] - 2 * x @ self.c.T + (self.c**2).sum(1), 0))
            order = np.argsort(dist, axis=1, kind="stable")[:, :beam]
            return order, np.take_along_axis(dist, order, 1)
        start = np.linspace(0, lists - 1, min(lists, 8)).astype(int)
        dist = np.full((n, lists), np.inf)
        done = np.zeros((n, lists), bool)
        dist[:, start] = self.distances(x, start[None].repeat(n, 0))
        rows = np.arange(n)
        while len(rows):
            part = np.where(done[rows], np.inf, dist[rows])
            nxt = part.argmin(1)
            worst = np.partition(dist[rows], beam - 1, axis=1)[:, beam - 1]
            go = np.isfinite(part[np.arange(len(rows)), nxt]) & (part[np.arange(len(rows)), nxt] <= worst)
            rows, nxt = rows[go], nxt[go]
            if not len(rows):
                break
            done[rows, nxt] = True
            around = self.links[nxt]
            dist[rows[:, None], around] = self.distances(x[rows], around)
        order = np.argsort(dist, axis=1, kind="stable")[:, :beam]
        return order, np.take_along_axis(dist, order, 1)


def fit(sample: np.ndarray, lists: int, rounds: int = 8) -> np.ndarray:
    """Lloyd's rounds from a fixed start; an empty cell keeps its centroid."""
    sample = np.unique(sample, axis=0)
    pick = np.random.default_rng(7).permutation(len(sample))
    c = sample[pick[: max(1, min(lists, len(sample) // 4))]].copy()
    for _ in range(rounds):
        near = np.concatenate([((c**2).sum(1) - 2 * part @ c.T).argmin(1) for part in np.array_split(sample, max(1, len(sample) // 1024))])
        order = np.argsort(near, kind="stable")
        cells, at, size = np.unique(near[order], return_index=True, return_counts=True)
        c[cells] = np.add.reduceat(sample[order], at, axis=0) / size[:, None]
    return c


def posted_lists(d: np.ndarray) -> np.ndarray:
    """Which of a row's nearest lists it is put in."""
    keep = d <= d[:, :1] * CLOSURE
    keep[:, 0] = True
    keep[:, COPIES:] = False
    return keep


def needed(graph: CentroidGraph, asked: np.ndarray, of: np.ndarray, found: np.ndarray) -> np.ndarray:
    """The ratio with which each true neighbour ``found`` of the query in row ``of`` of ``asked`` is met; 0 in its first lists."""
    near, d = graph.search(found, min(len(graph.c), 4 * DEGREE))
    held = posted_lists(d)
    order, every = graph.search(asked, len(graph.c))
    place = np.argsort(order, axis=1)
    # The lists of a row that stand in its query's order, first of them the nearest to the query.
    at = np.where(held, place[of[:, None], near], len(graph.c)).min(1)
    first = every[:, min(FIRST, len(graph.c)) - 1]
    ratio = np.divide(every[of, at], first[of], out=np.full(len(of), np.inf), where=first[of] > 0)
    return np.where(at < FIRST, 0.0, ratio)


def nearest_rows(x: np.ndarray, ids: np.ndarray, v: np.ndarray, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of v, row of x, distance) of the k nearest, ties to smaller ids, never a query's own id.

    A product finds all rows that may be among the k, exact differences order them.
    """
    square = (x**2).sum(1)
    rough = square + (v**2).sum(1)[:, None] - 2 * v @ x.T
    rough[q[:, None] == ids] = np.inf
    out = []
    for i, row in enumerate(rough):
        limit = np.partition(row, min(k, len(row)) - 1)[min(k, len(row)) - 1]
        may = np.flatnonzero((row <= limit + 1e-9 * (1 + square.max() + (v[i] ** 2).sum())) & np.isfinite(row))
        d = np.sqrt(((x[may] - v[i]) ** 2).sum(1))
        top = np.lexsort((ids[may], d))[:k]
        out.append((np.full(len(top), i), may[top], d[top]))
    return tuple(np.concatenate(part) for part in zip(*out, strict=True))


def _true_nearest(base: DataFrame, tried: list, k: int) -> list[tuple[int, list]]:
    """(row of ``tried``, vector) of the k nearest of all rows to each of a bounded number of queries, by brute force."""
    spark = base.sparkSession
    asked = spark.sparkContext.broadcast((np.array([r.embedding for r in tried], np.float64), np.array([r.vec_id for r in tried])))
    schema = f"asked int, score double, vec_id bigint, embedding {base.schema['embedding'].dataType.simpleString()}"

    def best(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        v, q = asked.value
        for batch in batches:
            if len(batch):
                i, j, d = nearest_rows(np.stack(batch.embedding.to_numpy()).astype(np.float64), batch.vec_id.to_numpy(), v, q, k)
                yield pd.DataFrame({"asked": i.astype(np.int32), "score": d, "vec_id": batch.vec_id.to_numpy()[j], "embedding": batch.embedding.to_numpy()[j]})

    rows = base.mapInPandas(best, schema).groupBy("asked", "vec_id").agg(F.min_by("embedding", "score").alias("embedding"), F.min("score").alias("score"))
    place = F.row_number().over(Window.partitionBy("asked").orderBy("score", "vec_id"))
    return [(r.asked, r.embedding) for r in rows.withColumn("place", place).where(F.col("place") <= k).collect()]


def search(vectors: DataFrame, queries: DataFrame, k: int = K, report: dict | None = None) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of ``vectors`` for each row of ``queries``.

    ``report`` receives the number of lists and the mean number probed, by vector length.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark)
    base, asked = usable(vectors), usable(queries)
    lengths = [r.n for r in base.groupBy(F.size("embedding").alias("n")).count().orderBy("n").collect()]
    found = [_search(base.where(F.size("embedding") == n), asked.where(F.size("embedding") == n), k, scratch, {} if report is None else report.setdefault(n, {})) for n in lengths]
    return reduce(DataFrame.unionByName, found) if found else spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")


def _search(base: DataFrame, asked: DataFrame, k: int, scratch: Scratch, report: dict) -> DataFrame:
    spark, rows = base.sparkSession, base.count()
    kind = base.schema["embedding"].dataType.simpleString()
    sample = np.array([r.embedding for r in sampled(base, F.col("vec_id"), SAMPLE).collect()], np.float64)
    scale = float(np.abs(sample).max())
    middle = (sample / scale).mean(0) * scale
    made = CentroidGraph(fit((sample - middle) / scale, min(LISTS, 4 * math.isqrt(rows))), middle=middle, scale=scale)
    tried = sampled(asked, F.struct("vec_id", "embedding"), TRIED).collect()
    ratio = 0.0
    if tried:
        true = _true_nearest(base, tried, k)
        need = needed(made, made.placed([r.embedding for r in tried]), np.array([t[0] for t in true], int), made.placed([t[1] for t in true])) if true else np.zeros(1)
        ratio = float(np.sort(need)[math.ceil(RECALL * len(need)) - 1])
    graph = spark.sparkContext.broadcast(made)
    report.update(lists=len(made.c), ratio=ratio)

    def blocks(batches, wide, chosen):
        for batch in batches:
            for at in range(0, len(batch), 256):
                part = batch.iloc[at : at + 256]
                near, d = graph.value.search(graph.value.placed(part.embedding), wide)
                row, col = np.nonzero(chosen(d))
                yield pd.DataFrame({"vec_id": part.vec_id.to_numpy()[row], "list": near[row, col], "place": col.astype(np.int32), "embedding": part.embedding.to_numpy()[row]})

    def post(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        return blocks(batches, 4 * DEGREE, posted_lists)

    def within(d: np.ndarray) -> np.ndarray:
        # Rounding may not part a list from itself.
        chosen = d <= d[:, min(FIRST, d.shape[1]) - 1, None] * ratio * (1 + 1e-9)
        chosen[:, :FIRST] = True
        return chosen | (ratio == np.inf)

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        return blocks(batches, len(made.c), within)

    shape = f"vec_id bigint, list int, place int, embedding {kind}"
    posted = scratch.cut(base.mapInPandas(post, shape).drop("place"))

    def blocks_of(rows: DataFrame) -> dict[int, int]:
        """Blocks by list, at most LISTS of them."""
        return {r["list"]: -(-r["count"] // BLOCK) for r in rows.groupBy("list").count().collect()}

    sizes = blocks_of(posted)

    def dealt(rows: DataFrame, own: str, other: str) -> DataFrame:
        """Each row in one of its side's blocks, for every block of the other side."""
        mine = F.pmod(F.xxhash64("vec_id"), F.col(f"{own}s")).cast("int")
        return rows.withColumn(own, mine).withColumn(other, F.explode(F.sequence(F.lit(0), F.col(f"{other}s") - 1)))

    def nearest(probes: DataFrame) -> DataFrame:
        asks = blocks_of(probes)
        plan = [(name, parts, asks[name]) for name, parts in sizes.items() if name in asks]
        # A frame for each side, as one frame on both would make their columns ambiguous.
        left, right = (F.broadcast(spark.createDataFrame(plan, "list int, parts int, asks int")) for _ in range(2))

        def best(block: pd.DataFrame, asking: pd.DataFrame) -> pd.DataFrame:
            if not len(block) or not len(asking):
                return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
            x, v = (np.stack(f.embedding.to_numpy()).astype(np.float64) for f in (block, asking))
            ids, q = block.vec_id.to_numpy(), asking.vec_id.to_numpy()
            i, j, d = nearest_rows(x, ids, v, q, k)
            near = d <= asking.bound.to_numpy()[i]
            return pd.DataFrame({"query_id": q[i], "vec_id": ids[j], "score": d})[near]

        lists = dealt(posted.join(left, "list"), "part", "ask").groupBy("list", "part", "ask")
        found = lists.cogroup(dealt(probes.join(right, "list"), "ask", "part").groupBy("list", "part", "ask")).applyInPandas(best, "query_id bigint, vec_id bigint, score double")
        return found

    order = Window.partitionBy("query_id").orderBy("score", "vec_id")

    def first_k(rows: DataFrame) -> DataFrame:
        return rows.groupBy("query_id", "vec_id").agg(F.min("score").alias("score")).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

    probes = scratch.cut(asked.mapInPandas(ask, shape))
    report["probed"] = probes.count() / max(1, asked.count())
    # The nearest lists give every query a distance that no row of the further lists has to be sent beyond.
    near = scratch.cut(first_k(nearest(probes.where(F.col("place") < FIRST).withColumn("bound", F.lit(float("inf"))))))
    bound = near.where(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), F.col("score").alias("bound"))
    further = probes.where(F.col("place") >= FIRST).join(bound, "vec_id", "left").fillna(float("inf"), ["bound"])
    found = scratch.cut(first_k(nearest(scratch.cut(further)).unionByName(near.select("query_id", "vec_id", "score"))))
    full = found.groupBy("query_id").count().where(F.col("count") >= k).select(F.col("query_id").alias("vec_id"))
    short = scratch.cut(asked.join(full, "vec_id", "left_anti"))
    if not short.isEmpty():
        everywhere = short.withColumn("list", F.explode(F.sequence(F.lit(0), F.lit(len(made.c) - 1))))
        wider = first_k(nearest(everywhere.select("vec_id", "list", "embedding", F.lit(float("inf")).alias("bound"))))
        found = found.join(full.withColumnRenamed("vec_id", "query_id"), "query_id", "left_semi").unionByName(wider)
    return found.select("query_id", "rank", "vec_id", "score")


def op10_posting_lists(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    return search(vectors, vectors.where(F.col("vec_id") % EVERY == 0))
