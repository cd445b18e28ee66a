"""N-gram Jaccard join by grouped prefixes.

Documents with equal shingle sets are one class, named by its smallest doc_id. A class's prefix is
the first ``n - ceil(t n) + 1`` shingles of an order that puts rare ones first: by the number of texts
in their cell of hashes, of which there is a fixed number, and then by hash. Classes with equal prefix and size are one group; group
pairs that share a prefix shingle and pass the size bound are expanded to class pairs and
verified on whole sets, every one of them. A shingle in the prefixes of over ``CROWD`` classes
has its classes compared on whole sets in blocks; a block gives each class's number of
links and what it is tied to, so that a crowd's pairs never leave the task.

Nulls and texts without words have no shingles and are linked with nothing; their component is
their own doc_id. Rows with one id and different texts are compared each for itself. A row without
id takes part in no link and has a null component. An empty table gives no rows; other columns are
ignored. Word and shingle hashes have 64 mixed bits, so a false link takes a tenth of a set to collide.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sitelens.llm.common import Bitmap, Scratch, finished_shuffles_go, memory_goes_back, shuffle_width, small_batches, table
from sitelens.llm.components import components
from sitelens.llm.hashing import rolled, word_hashes

PERCENT, WIDTH = 90, 3
BUCKETS, CROWD, CELLS = 256, 64, 1 << 22
#: Bits of the filter of documents to read again; a full one lets more through and changes no result.
FILTER_BITS = 1 << 24
#: Classes and shingles of a block of a crowd.
BLOCK, BLOCK_SHINGLES = 2048, 2_000_000
#: Texts whose shingles a task holds together.
SLICE = 1024


def shingle_sets(texts: list[str], width: int = WIDTH) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of each text's shingles."""
    hashed = word_hashes(texts, lower=True)
    return [np.unique(rolled(h, min(width, len(h))).view(np.int64)) if len(h) else np.empty(0, np.int64) for h in hashed]


def counts(hashes: np.ndarray) -> bytes:
    """Shingles by hash bucket; the sum of two documents' lesser counts bounds what they share."""
    found = np.bincount(hashes & (BUCKETS - 1), minlength=BUCKETS)
    return found.astype("u1" if found.max() < 1 << 8 else "<u4").tobytes()


def stacked(packed: pd.Series) -> np.ndarray:
    rows = [np.frombuffer(p, "u1" if len(p) == BUCKETS else "<u4") for p in packed]
    return np.stack(rows) if rows else np.zeros((0, BUCKETS), "u1")


def enough(most: np.ndarray, n, m, percent: int) -> np.ndarray:
    return 100 * most >= percent * (n + m - most)


def overlaps(sets: list[np.ndarray]):
    """Of one set and an array of others, by their places, how much each of them shares with it."""
    sizes = np.array([len(s) for s in sets], np.int64)
    flat = np.unique(np.concatenate(sets), return_inverse=True)[1]
    ids, mark = np.split(flat, np.cumsum(sizes)[:-1]), np.zeros(len(flat) + 1, bool)

    def shared(i: int, j: np.ndarray) -> np.ndarray:
        if not len(j) or not sizes[i]:
            return np.zeros(len(j), np.int64)
        mark[ids[i]] = True
        total = np.concatenate([[0], np.cumsum(mark[np.concatenate([ids[k] for k in j])])])
        mark[ids[i]] = False
        ends = np.cumsum(sizes[j])
        return total[ends] - total[ends - sizes[j]]

    return shared


def key_of(s: np.ndarray) -> bytes | None:
    """Names a set; an empty one has no name."""
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None


def prefix_length(n: int, percent: int = PERCENT) -> int:
    return n - -(-percent * n // 100) + 1 if n else 0


def _slices(batch: pd.DataFrame, rows: int = SLICE) -> Iterator[pd.DataFrame]:
    """A batch in parts whose sets are held together."""
    return (batch.iloc[at : at + rows] for at in range(0, len(batch), rows))


def _sketch(docs: DataFrame, make, schema: str) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        memory_goes_back()
        for batch in batches:
            yield from map(make, _slices(batch))
        memory_goes_back()

    text = F.coalesce("text", F.lit(""))
    source = docs.select(F.col("doc_id").cast("string").alias("_id"), text.alias("text"), text_hash().alias("hash"))
    return source.mapInPandas(run, schema)


def text_hash():
    """Tells rows with one doc_id apart."""
    return F.xxhash64(F.coalesce("text", F.lit("")))


def cell_counts(docs: DataFrame, width: int) -> np.ndarray:
    """How many texts have a shingle of each cell of hashes, out of ``CELLS``, which fixes the size."""
    chunk, byte = CELLS >> 6, 255

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        memory_goes_back()
        total = np.zeros(CELLS, "u4")
        for batch in chain.from_iterable(map(_slices, batches)):
            # Copies in a slice count once.
            sets = {key_of(s): s for s in shingle_sets(batch.text.tolist(), width)}
            cells, n = np.unique(np.concatenate([np.empty(0, np.int64), *sets.values()]) & (CELLS - 1), return_counts=True)
            total[cells] += n.astype("u4")
        for k, part in enumerate(total.reshape(-1, chunk)):
            if part.any():
                # A byte for each cell, and those that need more by their places.
                over = np.flatnonzero(part >= byte)
                yield pd.DataFrame({"chunk": [k], "counts": [np.minimum(part, byte).astype("u1").tobytes()], "over": [over.astype("<u4").tobytes()], "more": [part[over].astype("<u4").tobytes()]})

    def summed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, counts, over, more in zip(batch.chunk, batch.counts, batch.over, batch.more, strict=True):
                part = np.frombuffer(counts, "u1").astype(np.int64)
                part[np.frombuffer(over, "<u4")] = np.frombuffer(more, "<u4")
                total[k] = total.get(k, 0) + part
        for k, part in total.items():
            yield pd.DataFrame({"chunk": [k], "counts": [np.minimum(part, 2**32 - 1).astype("<u4").tobytes()]})

    sums = docs.select(F.coalesce("text", F.lit("")).alias("text")).mapInPandas(counted, "chunk int, counts binary, over binary, more binary")
    out = np.zeros((64, chunk), "<u4")
    with finished_shuffles_go(docs.sparkSession), small_batches(docs.sparkSession, SLICE):
        for r in sums.repartition(min(64, shuffle_width(docs.sparkSession)), "chunk").mapInPandas(summed, "chunk int, counts binary").collect():
            out[r.chunk] = np.frombuffer(r.counts, "<u4")
    return out.reshape(-1)


def join(docs: DataFrame, percent: int = PERCENT, width: int = WIDTH) -> DataFrame:
    """A row for each document.

    doc_id, n_shingles, class_id (smallest doc_id with the same set), component_id, n_links (other classes
    that are alike enough); text_hash and group, the component as such, null for rows that are never linked.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, SLICE)
    cut = scratch.cut
    common = spark.sparkContext.broadcast(cell_counts(docs, width))

    def make(batch):
        out = []
        for doc_id, h, s in zip(batch._id, batch.hash, shingle_sets(batch.text.tolist(), width), strict=True):
            if not len(s):
                out.append((doc_id, h, 0, None, None, None))
                continue
            first = s[np.argsort(common.value[s & (CELLS - 1)], kind="stable")[: prefix_length(len(s), percent)]]
            out.append((doc_id, h, len(s), key_of(s), first, counts(s)))
        return pd.DataFrame(out, columns=["_id", "text_hash", "n", "key", "prefix", "sig"])

    slim = _sketch(docs, make, "_id string, text_hash bigint, n bigint, key binary, prefix array<bigint>, sig binary")
    slim = cut(slim.select(F.col("_id").cast("bigint").alias("doc_id"), "text_hash", "n", "key", "prefix", "sig"))
    keyed = slim.where("key is not null and doc_id is not null")
    named = keyed.groupBy("key").agg(F.min("doc_id").alias("first"))
    # A class is known by its smallest doc_id; of several classes with one smallest doc_id, all but one by a hash.
    turn = F.row_number().over(Window.partitionBy("first").orderBy("key"))
    named = cut(named.withColumn("rep", F.when(turn == 1, F.col("first")).otherwise(F.xxhash64("first", "key"))))
    classes = keyed.join(named, "key").where("doc_id = first").select("rep", "n", "key", "prefix", "sig").dropDuplicates(["rep"])
    grouped = F.xxhash64("prefix", "n")
    classes = cut(classes.withColumn("bucket", grouped))
    groups = classes.groupBy("bucket").agg(F.min("rep").alias("gid"), F.first("n").alias("n"), F.count("*").alias("members"), F.first("prefix").alias("prefix"))
    groups = cut(groups)
    member = cut(classes.select("rep", "bucket", "sig").join(groups.select("bucket", "gid", "n"), "bucket").select("rep", "gid", "n", "sig"))
    tokens = groups.select("gid", "n", "members", F.explode("prefix").alias("token"))
    # Shingles in one group's prefix alone link nothing, unless the group is itself a crowd.
    shared = tokens.groupBy("token").agg(F.min("gid").alias("low"), F.max("gid").alias("high"), F.sum("members").alias("crowd"))
    tokens = cut(tokens.join(shared.where((F.col("low") < F.col("high")) | (F.col("crowd") > CROWD)).select("token", "crowd"), "token"))
    crowds = cut(tokens.where(F.col("crowd") > CROWD).groupBy("gid").agg(F.collect_list("token").alias("crowds")))

    @F.pandas_udf("boolean")
    def may_link(na: pd.Series, sa: pd.Series, nb: pd.Series, sb: pd.Series) -> pd.Series:
        most = np.minimum(stacked(sa), stacked(sb)).sum(1, dtype=np.int64)
        return pd.Series(enough(most, na.to_numpy(), nb.to_numpy(), percent))

    def possible(pairs: DataFrame) -> DataFrame:
        """Pairs whose bucket counts leave room for enough shared shingles."""
        left = pairs.join(member.select(F.col("rep").alias("a"), F.col("n").alias("na"), F.col("sig").alias("sa")), "a")
        both = left.join(member.select(F.col("rep").alias("b"), F.col("n").alias("nb"), F.col("sig").alias("sb")), "b")
        return both.where(may_link("na", "sa", "nb", "sb")).select("a", "b")

    def whole(batch):
        sets = shingle_sets(batch.text.tolist(), width)
        return pd.DataFrame({"key": [key_of(s) for s in sets], "set": sets})

    def sets_of(needed: DataFrame) -> DataFrame:
        known = named.join(needed.distinct(), "rep")
        ids = known.select(F.col("first").alias("doc_id")).distinct()
        wanted = spark.sparkContext.broadcast(Bitmap.collect(ids.select(F.xxhash64("doc_id").alias("h")), FILTER_BITS))

        @F.pandas_udf("boolean")
        def may_be_needed(h: pd.Series) -> pd.Series:
            return pd.Series(wanted.value.holds(h.to_numpy()))

        texts = docs.where("doc_id is not null").select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
        again = texts.where(may_be_needed(F.xxhash64("doc_id"))).join(ids, "doc_id", "left_semi")
        return cut(_sketch(again, whole, "key binary, set array<bigint>").join(known.select("key", "rep"), "key").select("rep", "set").dropDuplicates(["rep"]))

    def verify(pairs: DataFrame) -> DataFrame:
        """Pairs whose whole sets are alike enough."""
        pairs = cut(possible(pairs))
        sets = sets_of(pairs.select(F.col("a").alias("rep")).union(pairs.select("b")))
        left = pairs.join(sets.select(F.col("rep").alias("a"), F.col("set").alias("x")), "a")
        both = left.join(sets.select(F.col("rep").alias("b"), F.col("set").alias("y")), "b")
        meet = F.size(F.array_intersect("x", "y"))
        return both.where(100 * meet >= percent * (F.size("x") + F.size("y") - meet)).select("a", "b")

    calm = tokens.where(F.col("crowd") <= CROWD)
    x, y = calm.alias("x"), calm.alias("y")
    size = 100 * F.least("x.n", "y.n") >= percent * F.greatest("x.n", "y.n")
    pairs = x.join(y, (F.col("x.token") == F.col("y.token")) & (F.col("x.gid") < F.col("y.gid")) & size)
    pairs = pairs.select(F.col("x.gid").alias("g"), F.col("y.gid").alias("h")).distinct()
    # Pairs that share a crowded shingle are compared there.
    pairs = pairs.join(crowds.select(F.col("gid").alias("g"), F.col("crowds").alias("cg")), "g", "left").join(crowds.select(F.col("gid").alias("h"), F.col("crowds").alias("ch")), "h", "left")
    pairs = pairs.where(~F.coalesce(F.arrays_overlap("cg", "ch"), F.lit(False))).select("g", "h")
    inside = groups.where("members > 1").join(crowds, "gid", "left_anti").select(F.col("gid").alias("g"), F.col("gid").alias("h"))
    left, right = member.select(F.col("gid").alias("g"), F.col("rep").alias("a")), member.select(F.col("gid").alias("h"), F.col("rep").alias("b"))
    pairs = pairs.union(inside).join(left, "g").join(right, "h").where("g <> h or a < b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    links = cut(verify(pairs))
    count = links.select(F.col("a").alias("rep")).union(links.select("b")).select("rep", F.lit(1).cast("bigint").alias("links"))

    def compare(frame: pd.DataFrame) -> pd.DataFrame:
        """Links of each class between hosts of two blocks, inside one, or of hosts and guests, and the class that stands for those it is tied to here."""
        frame = frame.sort_values("n", kind="stable")
        n, rep, block, host = frame.n.to_numpy(), frame.rep.to_numpy(), frame.block.to_numpy(), frame.host.to_numpy()
        guests = frame.part.iloc[0] >= 0
        one = (frame.low_block == frame.high_block).all()
        crowded = overlaps(frame.crowds.tolist()) if guests else None
        meets = overlaps(frame.set.tolist())
        ends = np.searchsorted(percent * n, 100 * n, side="right")
        found, root = np.zeros(len(frame), np.int64), np.arange(len(frame))
        for i in range(len(frame)):
            j = np.arange(i + 1, ends[i])
            if guests:
                # Hosts share the crowded shingle they live at; a guest need not share one with each of them.
                j = j[host[j] != host[i]]
                j = j[crowded(i, j) > 0]
            elif not one:
                j = j[block[j] != block[i]]
            j = j[enough(meets(i, j), n[i], n[j], percent)]
            if len(j):
                found[i] += len(j)
                found[j] += 1
                tied = np.unique(root[np.append(j, i)])
                if len(tied) > 1:
                    root[np.isin(root, tied)] = tied[0]
        at = np.flatnonzero(found)
        return pd.DataFrame({"rep": rep[at], "other": rep[root[at]], "links": found[at]})

    if not crowds.isEmpty():
        near = cut(_met(tokens.where(F.col("crowd") > CROWD), crowds, member, sets_of, cut).groupBy("dest", "low_block", "high_block", "part").applyInPandas(compare, "rep bigint, other bigint, links bigint"))
        links = links.union(near.where("rep <> other").select(F.least("rep", "other"), F.greatest("rep", "other")))
        count = count.union(near.select("rep", "links"))
    label = components(links, scratch)
    count = count.groupBy("rep").agg(F.sum("links").alias("n_links"))
    known = named.join(label.withColumnRenamed("node", "rep"), "rep", "left").join(count, "rep", "left").withColumn("group", F.coalesce("component", "rep"))
    smallest = known.groupBy("group").agg(F.min("first").alias("smallest"))
    known = known.join(smallest, "group").select("key", "first", "group", "smallest", "n_links")
    out = slim.select("doc_id", "text_hash", F.col("n").alias("n_shingles"), "key").join(known, "key", "left")
    own = F.when(F.col("doc_id").isNotNull(), F.coalesce("smallest", "doc_id"))
    group = F.when(F.col("doc_id").isNotNull(), F.col("group"))
    return out.select("doc_id", "n_shingles", F.coalesce("first", "doc_id").alias("class_id"), own.alias("component_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"), "text_hash", group.alias("group"))


def _met(tokens: DataFrame, crowds: DataFrame, member: DataFrame, sets_of, cut) -> DataFrame:
    """Classes with crowded shingles, with their sets, where they are to be compared.

    A class lives at the smallest crowded shingle of its prefix, with many others; it is a guest at the
    homes of more classes that it shares another crowded shingle with. Two classes meet at the larger of
    their homes, once; so a set is dealt to few places, however many crowded shingles it has.
    """
    homes = crowds.select("gid", F.array_min("crowds").alias("home"), "crowds")
    living = member.join(homes.select("gid", "home"), "gid").groupBy("home").agg(F.count("*").alias("classes"), F.sum("n").alias("shingles"))
    blocks = F.greatest(F.ceil(F.col("classes") / BLOCK), F.ceil(F.col("shingles") / BLOCK_SHINGLES)).cast("int")
    living = cut(living.withColumn("blocks", blocks))
    here = tokens.select("token", "gid").join(homes.select("gid", "home"), "gid").join(living.select("home", "classes"), "home")
    larger = here.select("token", F.col("home").alias("dest"), F.col("classes").alias("more")).distinct()
    above = (F.col("more") > F.col("classes")) | ((F.col("more") == F.col("classes")) & (F.col("dest") > F.col("home")))
    guests = here.join(larger, "token").where(above).select("gid", "dest").distinct()
    crowded = member.join(homes, "gid").select("gid", "rep", "n", "home", "crowds")
    crowded = cut(crowded.join(sets_of(crowded.select("rep")), "rep"))
    visits = cut(guests.join(crowded.select("gid", "rep", "n"), "gid"))
    visiting = visits.groupBy("dest").agg(F.count("*").alias("classes"), F.sum("n").alias("shingles")).select("dest", blocks.alias("parts"))
    at = living.select(F.col("home").alias("dest"), "blocks").join(visiting, "dest", "left").fillna(0, ["parts"])
    columns = ["dest", "low_block", "high_block", "part", "block", "host", "rep", "n", "crowds", "set"]
    block = F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")
    hosts = crowded.withColumnRenamed("home", "dest").join(at, "dest").withColumn("block", block).withColumn("host", F.lit(True))
    others = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(F.least("block", o).alias("low_block"), F.greatest("block", o).alias("high_block"), F.lit(-1).alias("part")))
    parts = F.transform(F.sequence(F.lit(0), F.col("parts")), lambda p: F.struct(F.col("block").alias("low_block"), F.col("block").alias("high_block"), p.alias("part")))
    meetings = F.concat(others, F.filter(parts, lambda p: p["part"] < F.col("parts")))
    among = hosts.select("*", F.inline(meetings)).select(*columns)
    guest = visits.select("dest", "rep").join(crowded.drop("home", "gid"), "rep").join(at, "dest").withColumn("block", F.lit(-1)).withColumn("host", F.lit(False))
    part = F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int")
    everywhere = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda b: F.struct(b.alias("low_block"), b.alias("high_block")))
    return among.unionByName(guest.withColumn("part", part).select("*", F.inline(everywhere)).select(*columns))


def op6_jaccard_join(spark, sf_dir):
    return join(table(spark, sf_dir, "documents")).drop("text_hash", "group")
