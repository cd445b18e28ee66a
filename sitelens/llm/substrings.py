"""Substring deduplication on the de Bruijn graph of words.

A node is ``width - 1`` consecutive words, an edge a window of ``width`` words from its first to
its last node. Three passes over the texts:

1. Each window has a minimizer, the smallest hash of its shorter shingles. Minimizers that stand in
   two different texts are gathered in a bitmap of fixed size; a window repeats only if its minimizer
   does. A full bitmap lets more windows through and changes no result.
2. Those windows become edges. Edges in several documents repeat; each knows its smallest document
   and its place there. Joins along the nodes find in and out degrees and an edge's one predecessor;
   an edge whose left node does not branch, and whose predecessor stands just before it in the same
   document, is compacted into the predecessor's path. Occurrences after the first document are
   joined with the paths and merged to spans in source coordinates.
3. The words of every span, and those of the path it repeats, are read from their sources and compared
   by a cryptographic digest. Spans that agree are removed. Should one differ, two node hashes were
   equal by accident, and all is done again with other hashes.

An edge that repeats more often than one in ``ONE_IN`` of all is joined by broadcast, of which there are
at most that many; so a passage in all documents is no hot key. Documents with equal words are one
class: a copy of at least ``width`` words goes whole.

Nulls and empty texts have no words and keep nothing. Texts shorter than a window stay. Rows with
one doc_id are told apart by their words and repeat nothing in each other. A row without doc_id is
neither compared nor cut. An empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import count

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sitelens.llm.common import Bitmap, Scratch, finished_shuffles_go, shuffle_width, table
from sitelens.llm.hashing import rolled, side_by_side, word_hashes

WIDTH, SEED_WIDTH = 13, 5
#: Bits of the filter of minimizers and of that of documents to read again.
FILTER_BITS = 1 << 27
ONE_IN, HOT_LEAST, DOCS_A_PART = 5000, 256, 50_000
#: A place is a row's tag of 32 bits before the number of a word.
_WORD_BITS = 31
_NOTHING = hashlib.sha256(b"").hexdigest()


def split(text: str) -> list[bytes]:
    """Words of a text; bytes part at exactly the six characters that are white space here."""
    return text.encode("utf-8", "surrogatepass").split()


def digest(words: list[bytes]) -> bytes:
    return hashlib.blake2b(b" ".join(words), digest_size=16).digest()


def tag_of(key: bytes) -> int:
    return int.from_bytes(key[:4], "little")


def minimizers(hashed: np.ndarray, width: int = WIDTH, seed_width: int = SEED_WIDTH) -> np.ndarray:
    """For each window the smallest hash of the shingles inside."""
    seeds = rolled(hashed, seed_width)
    n = len(hashed) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = seeds[:n].copy()
    for j in range(1, width - seed_width + 1):
        np.minimum(out, seeds[j : j + n], out=out)
    return out


def _mapped(source: DataFrame, make, schema: str, rows: int = 256) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), rows):
                yield from make(batch.iloc[at : at + rows])

    return source.mapInPandas(run, schema)


def spans(starts: np.ndarray, width: int = WIDTH) -> list[tuple[int, int]]:
    """Flagged window starts to disjoint covered word ranges."""
    starts = np.unique(starts)
    if not len(starts):
        return []
    cuts = np.flatnonzero(np.diff(starts) > width) + 1
    return [(int(part[0]), int(part[-1]) + width) for part in np.split(starts, cuts)]


def _repeated_minimizers(texts: DataFrame, seed: int, width: int, seed_width: int, parts: int) -> Bitmap:
    def found(batch):
        seeds, tags = [np.empty(0, np.uint64)], [np.empty(0, np.uint64)]
        texts = batch.text.tolist()
        for text, least in zip(texts, side_by_side(word_hashes(texts, seed), width, lambda h: minimizers(h, width, seed_width)), strict=True):
            if len(least):
                seeds.append(np.unique(least))
                tags.append(np.full(len(seeds[-1]), int.from_bytes(digest(split(text))[:8], "little"), np.uint64))
        lo, hi, of = _extremes(np.concatenate(seeds), np.concatenate(tags))
        if not len(of):
            return
        # A minimizer goes out once, or twice with the two texts that show it repeats.
        both = np.flatnonzero(lo != hi)
        of, lo = np.concatenate([of, of[both]]), np.concatenate([lo, hi[both]])
        bucket = (of >> np.uint64(33)) % np.uint64(4 * parts)
        order = np.argsort(bucket, kind="stable")
        b, starts = np.unique(bucket[order], return_index=True)
        ends = np.append(starts[1:], len(order))
        blobs = [(int(k), of[order[x:y]].tobytes(), lo[order[x:y]].tobytes()) for k, x, y in zip(b, starts, ends, strict=True)]
        yield pd.DataFrame(blobs, columns=["bucket", "seeds", "tags"])

    def repeated(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seeds, tags = [], []
        for batch in batches:
            seeds += [np.frombuffer(x, np.uint64) for x in batch.seeds]
            tags += [np.frombuffer(x, np.uint64) for x in batch.tags]
        if seeds:
            lo, hi, of = _extremes(np.concatenate(seeds), np.concatenate(tags))
            yield pd.DataFrame({"seed": of[lo != hi].view(np.int64)})

    blobs = _mapped(texts.select("text"), found, "bucket int, seeds binary, tags binary", 4096)
    return Bitmap.collect(blobs.repartition(parts, "bucket").mapInPandas(repeated, "seed bigint"), FILTER_BITS)


def _extremes(seeds: np.ndarray, tags: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Smallest and largest tag of each distinct seed."""
    if not len(seeds):
        return tags, tags, seeds
    order = np.argsort(seeds, kind="stable")
    seeds, tags = seeds[order], tags[order]
    at = np.flatnonzero(np.concatenate([[True], seeds[1:] != seeds[:-1]]))
    return np.minimum.reduceat(tags, at), np.maximum.reduceat(tags, at), seeds[at]


def _candidates(texts: DataFrame, often: Bitmap, seed: int, width: int, seed_width: int, keep_text: bool) -> DataFrame:
    """A row for each text: its words, and nodes of the windows whose minimizer may repeat, with their places."""
    shared = texts.sparkSession.sparkContext.broadcast(often)

    def make(batch):
        out, first = [], {}
        found = batch.text.tolist()
        known = []
        for doc_id, words in zip(batch._id, map(split, found), strict=True):
            raw = b" ".join(words)
            known.append((None if pd.isna(doc_id) else int(doc_id), raw, len(words), digest([raw])))
        for doc_id, _, _, key in known:
            if doc_id is not None and doc_id <= first.get(key, doc_id):
                first[key] = doc_id
        told, hashed = set(), word_hashes(found, seed)
        least = side_by_side(hashed, width, lambda h: minimizers(h, width, seed_width))
        every = side_by_side(hashed, width - 1, lambda h: rolled(h, width - 1))
        for (doc_id, raw, n_words, key), mins, all_nodes in zip(known, least, every, strict=True):
            nodes, at = np.empty(0, np.uint64), np.empty(0, np.int64)
            # Of the copies in a batch only the first shows its windows; the others go whole.
            if doc_id is not None and n_words >= width and first[key] == doc_id and key not in told:
                told.add(key)
                starts = np.flatnonzero(shared.value.holds(mins))
                at = np.union1d(starts, starts + 1)
                nodes = all_nodes[at]
            row = (doc_id, tag_of(key), key, n_words, hashlib.sha256(raw).hexdigest(), nodes.view(np.int64), at.astype("i4"))
            out.append((*row, raw.decode("utf-8", "surrogatepass")) if keep_text else row)
        names = ["doc_id", "tag", "key", "n_words", "sha", "nodes", "at"] + ["kept"] * keep_text
        frame = pd.DataFrame(out, columns=names)
        frame["doc_id"] = frame["doc_id"].astype("Int64")
        yield frame

    schema = "doc_id bigint, tag bigint, key binary, n_words bigint, sha string, nodes array<bigint>, at array<int>"
    return _mapped(texts.select(F.col("doc_id").cast("string").alias("_id"), "text"), make, schema + (", kept string" if keep_text else ""), 2048)


def _paths(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """Repeated edges with the place of the first edge of their path."""
    ahead = edges.groupBy(F.col("left").alias("node")).agg(F.count("*").alias("out"))
    behind = edges.groupBy(F.col("right").alias("node")).agg(F.count("*").alias("into"), F.min("lo").alias("lo_before"), F.min("lo_at").alias("at_before"))
    joined = edges.withColumn("node", F.col("left")).join(ahead, "node").join(behind, "node", "left")
    follows = (F.col("out") == 1) & (F.col("into") == 1) & (F.col("lo_before") == F.col("lo")) & (F.col("at_before") + 1 == F.col("lo_at"))
    heads = joined.select("left", "right", "lo", "lo_at", "n", F.when(~F.coalesce(follows, F.lit(False)), F.col("lo_at")).alias("head"))
    # Edges of a path lie side by side in the source, at most as many as the document has words.
    along = Window.partitionBy("lo").orderBy("lo_at").rowsBetween(Window.unboundedPreceding, 0)
    return scratch.cut(heads.withColumn("head", F.last("head", ignorenulls=True).over(along)))


def _flagged(occurrences: DataFrame, paths: DataFrame, total: int, parts: int) -> DataFrame:
    """Spans of each document that repeat a path of a smaller one: first and last window, and where they lie there."""
    often = max(HOT_LEAST, total // ONE_IN)
    # At most ONE_IN edges can be that frequent.
    hot = F.broadcast(paths.where(F.col("n") > often))
    later, keys = "doc_id > lo", ["left", "right"]
    known = occurrences.join(hot, keys).where(later).unionByName(occurrences.join(hot, keys, "left_anti").join(paths.where(F.col("n") <= often), keys).where(later))
    rows = known.select("doc_id", "at", "lo", "lo_at", "head").repartition(parts, "doc_id").sortWithinPartitions("doc_id", "at")

    def merge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            v = {c: batch[c].to_numpy() for c in batch.columns}
            if len(batch):
                same = (np.diff(v["doc_id"]) == 0) & (np.diff(v["lo"]) == 0) & (np.diff(v["head"]) == 0) & (np.diff(v["at"]) == 1) & (np.diff(v["lo_at"]) == 1)
                start = np.flatnonzero(np.concatenate([[True], ~same]))
                end = np.append(start[1:], len(batch)) - 1
                yield pd.DataFrame({"doc_id": v["doc_id"][start], "at": v["at"][start], "n": v["at"][end] - v["at"][start] + 1, "lo": v["lo"][start], "lo_at": v["lo_at"][start]})

    return rows.mapInPandas(merge, "doc_id bigint, at bigint, n bigint, lo bigint, lo_at bigint")


def _read_again(texts: DataFrame, found: DataFrame, width: int, keep_text: bool) -> DataFrame:
    """Texts with spans, without these; and digests of the words of spans and of what they repeat."""
    own = found.select("doc_id", F.struct("at", "n", "lo", "lo_at").alias("own"), F.lit(None).cast("struct<at:bigint,n:bigint>").alias("asked"))
    asked = found.select(F.col("lo").alias("doc_id"), F.lit(None).cast("struct<at:bigint,n:bigint,lo:bigint,lo_at:bigint>").alias("own"), F.struct(F.col("lo_at").alias("at"), "n").alias("asked")).distinct()
    marks = own.unionByName(asked).groupBy("doc_id").agg(F.collect_list("own").alias("own"), F.collect_list("asked").alias("asked"))
    needed = texts.sparkSession.sparkContext.broadcast(Bitmap.collect(marks.select(F.xxhash64("doc_id").alias("h")), FILTER_BITS))

    @F.pandas_udf("boolean")
    def may_be_needed(h: pd.Series) -> pd.Series:
        return pd.Series(needed.value.holds(h.to_numpy()))

    first, mask = 1 << _WORD_BITS, (1 << _WORD_BITS) - 1

    def make(batch):
        out = []
        for doc_id, text, own, asked in zip(batch.doc_id, batch.text, batch.own, batch.asked, strict=True):
            words = split(text)
            tag = tag_of(digest(words))
            own = [(s["at"] & mask, s["n"], s["lo"], s["lo_at"]) for s in own if s["at"] >> _WORD_BITS == tag]
            asked = [(s["at"] & mask, s["n"]) for s in asked if s["at"] >> _WORD_BITS == tag]
            gone = spans(np.concatenate([np.arange(a, a + n) for a, n, *_ in own]), width) if own else []
            kept, at = [], 0
            for a, b in gone:
                kept += words[at:a]
                at = b
            raw = b" ".join(kept + words[at:])
            seen = [{"lo": lo, "at": at, "n": n, "words": digest(words[a : a + n + width - 1])} for a, n, lo, at in own]
            known = [{"lo": doc_id, "at": tag * first + a, "n": n, "words": digest(words[a : a + n + width - 1])} for a, n in asked]
            row = (doc_id, tag, sum(b - a for a, b in gone), hashlib.sha256(raw).hexdigest(), [x for ab in gone for x in ab], seen, known)
            out.append((*row, raw.decode("utf-8", "surrogatepass")) if keep_text else row)
        yield pd.DataFrame(out, columns=["doc_id", "tag", "cut", "cut_sha", "spans", "seen", "known"] + ["cut_text"] * keep_text)

    of = "array<struct<lo:bigint,at:bigint,n:bigint,words:binary>>"
    schema = f"doc_id bigint, tag bigint, cut bigint, cut_sha string, spans array<int>, seen {of}, known {of}"
    joined = texts.where(may_be_needed(F.xxhash64("doc_id"))).join(marks, "doc_id").select("doc_id", "text", "own", "asked")
    return _mapped(joined, make, schema + (", cut_text string" if keep_text else "")).dropDuplicates(["doc_id", "tag"])


def _attempt(texts: DataFrame, seed: int, width: int, seed_width: int, keep_text: bool, scratch: Scratch) -> DataFrame | None:
    """The result, or None where words of a span differ from those it was to repeat."""
    spark = texts.sparkSession
    with_id = texts.where("doc_id is not null")
    parts = max(shuffle_width(spark), texts.count() // DOCS_A_PART)
    often = _repeated_minimizers(with_id, seed, width, seed_width, parts)
    rows = scratch.cut(_candidates(texts, often, seed, width, seed_width, keep_text))
    place = F.col("tag") * F.lit(1 << _WORD_BITS)
    shown = rows.where(F.size("nodes") > 1).select("doc_id", place.alias("base"), "nodes", "at")
    pairs = F.transform(F.sequence(F.lit(1), F.size("nodes") - 1), lambda i: F.struct(F.get("nodes", i - 1).alias("left"), F.get("nodes", i).alias("right"), F.get("at", i - 1).alias("at"), (F.get("at", i) - F.get("at", i - 1)).alias("step")))
    occurrences = shown.select("doc_id", "base", F.inline(pairs)).where("step = 1").select("left", "right", "doc_id", (F.col("base") + F.col("at")).alias("at"))
    total = shown.agg(F.coalesce(F.sum(F.size("nodes")), F.lit(0))).first()[0]
    edges = occurrences.groupBy("left", "right").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), F.min_by("at", "doc_id").alias("lo_at"), F.count("*").alias("n"))
    edges = scratch.cut(edges.where("lo < hi").select("left", "right", "lo", "lo_at", "n"))
    paths = _paths(edges, scratch)
    scratch.drop(edges)
    found = scratch.cut(_flagged(occurrences, paths, total, parts))
    scratch.drop(paths)
    again = scratch.cut(_read_again(with_id, found, width, keep_text))
    seen = again.select(F.inline("seen")).distinct()
    known = again.select(F.inline("known")).withColumnRenamed("words", "source_words")
    with finished_shuffles_go(spark):
        if not seen.join(known, ["lo", "at", "n"], "left").where(~F.col("words").eqNullSafe(F.col("source_words"))).isEmpty():
            return None
    firsts = rows.where("doc_id is not null").groupBy("key").agg(F.min("doc_id").alias("first"), F.count("*").alias("members")).where("members > 1").select("key", "first")
    merged = rows.drop("nodes", "at").join(firsts, "key", "left").join(again.drop("seen", "known"), ["doc_id", "tag"], "left")
    copy = F.coalesce((F.col("doc_id") > F.col("first")) & (F.col("n_words") >= width), F.lit(False))
    whole = F.array(F.lit(0), F.col("n_words").cast("int"))
    out = [
        "doc_id", "n_words", F.when(copy, F.col("n_words")).otherwise(F.coalesce("cut", F.lit(0))).alias("n_removed"),
        F.when(copy, F.lit(_NOTHING)).otherwise(F.coalesce("cut_sha", "sha")).alias("kept_sha256"),
        F.when(copy, whole).otherwise(F.coalesce("spans", F.array().cast("array<int>"))).alias("spans"),
    ]
    if keep_text:
        out.append(F.when(copy, F.lit("")).otherwise(F.coalesce("cut_text", "kept")).alias("text"))
    return merged.select(*out)


def dedup(docs: DataFrame, width: int = WIDTH, seed_width: int = SEED_WIDTH, keep_text: bool = True) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, spans of removed words and, with ``keep_text``, the kept words."""
    scratch = Scratch(docs.sparkSession)
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    for seed in count(1):
        done = _attempt(texts, seed, width, seed_width, keep_text, scratch)
        if done is not None:
            return done


def op5_substring_dedup(spark, sf_dir):
    return dedup(table(spark, sf_dir, "documents"), keep_text=False).select("doc_id", "n_words", "n_removed", "kept_sha256")
