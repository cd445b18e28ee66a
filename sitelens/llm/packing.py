"""Harmonic packing of token sequences.

A document's remainder after its full sequences is cut at harmonic lengths, the largest
``capacity // k`` that fits, until at most ``fine`` tokens are left. A piece of length L is of
class ``k = capacity // L``, and a bin of class k takes k pieces. Workers fill bins
independently; each worker merges the pieces of its unfinished bins by best fit, and their
number is bounded by the classes, not by the data.

Nulls: a null text counts as empty. An empty text is the end token alone. Repeated rows are
packed each for itself. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import bisect
import json
import os
import re
import struct
import zlib
from codecs import charmap_decode
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitelens.llm.common import memory_goes_back, shuffle_width, table

CAPACITY, END_ID, FINE = 2048, 1, 64
TOKENIZER = "byte_bpe_50k.json"
DOCS_PER_WORKER, TOGETHER, REMEMBERED = 4000, 256, 600_000
#: Characters that a token has at least, on the whole; only the number of workers depends on it.
CHARS_A_TOKEN = 2
#: A word of letters before a stop, or all up to the next white space; either with the white space before it.
_CHUNK = re.compile(r"[ \t\n\r]*[A-Za-zÀ-ÖØ-öø-ÿ]+(?=[ \t\n\r.,;:!?%&)|]|\Z)|[ \t\n\r]*[^ \t\n\r]+|[ \t\n\r]+")
#: Chunks whose letters, digits and white space are told here as the pre-tokenizer tells them, and the parts that it makes of them.
_LATIN = re.compile(r"[ \t\n\r]*[!-~À-ÖØ-öø-ÿ]*")
_PARTS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-zÀ-ÖØ-öø-ÿ]+| ?[0-9]+| ?[^\sA-Za-z0-9À-ÖØ-öø-ÿ]+|\s+(?!\S)|\s+")
#: Where white space stands before a blank, the blank need not begin a chunk.
_RUNS = ("  ", "\t ", "\n ", "\r ")
#: The character that stands for each byte in byte-level vocabularies: itself if printable, else one of those from 256 on.
_PRINTED = {*range(33, 127), *range(161, 173), *range(174, 256)}
_HIDDEN = [b for b in range(256) if b not in _PRINTED]
_SHOWN = "".join(chr(b if b in _PRINTED else 256 + _HIDDEN.index(b)) for b in range(256))
_PIECES = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint"


def harmonic_cuts(total: int, capacity: int = CAPACITY, fine: int = FINE) -> list[int]:
    """Lengths of a document's pieces, in order; they sum to ``total``."""
    cuts = [capacity] * (total // capacity)
    rest = total % capacity
    while rest > fine:
        k = -(-capacity // rest)
        cuts.append(min(rest, capacity // k))
        rest -= cuts[-1]
    return cuts + [rest] * (rest > 0)


def _tokenizer(path: str | None):
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(TOKENIZER)
    return Tokenizer.from_file(path)


class _Strange(Exception):
    """A text whose ids may not be those of its chunks."""


class Encoder(dict):
    """Token ids of texts, remembered by chunk as bytes.

    A chunk is a run of plain white space and the run of other characters behind it, parted once more
    where a stop follows a word of letters. The byte-level pre-tokenizer never joins a character with
    white space after it, nor a letter with a stop, and looks ahead only within white space and at
    the one character that follows; so a text's ids are those of its chunks, one after the other. A text without
    white space before a blank is cut at its blanks first, and what lies between is looked up whole. The
    tokenizer's model encodes the parts of each new chunk of Latin letters, digits and signs, the tokenizer every other one, and whole every text to which this
    need not apply: with other white space, with an added token, or if the tokenizer is of another kind.
    About ``most`` chunks of at most ``longest`` characters are remembered, those after a blank here without it, all others in ``bare``.
    """

    def __init__(self, tokenizer, most: int = REMEMBERED, longest: int = 40):
        super().__init__()
        self.tokenizer, self.most, self.longest, self.older, self.bare = tokenizer, most, longest, {}, {}
        made = json.loads(tokenizer.to_str())
        before, self.model = made.get("pre_tokenizer") or {}, tokenizer.model
        model, added = made["model"], [t["content"] for t in made.get("added_tokens", [])]
        by_chunk = before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space") and not made.get("normalizer")
        self.by_chunk = by_chunk and model["type"] == "BPE" and not model.get("dropout") and not made.get("truncation") and not made.get("padding")
        self.other = re.compile(r"[^\S \t\n\r]|[\x85᠎​﻿]" + "".join(f"|{re.escape(t)}" for t in added))

    def whole(self, text: str) -> list[int]:
        # The fast form leaves out offsets, which nothing here reads.
        return self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids

    def new(self, chunk: str) -> bytes:
        if self.other.search(chunk):
            raise _Strange
        if not _LATIN.fullmatch(chunk):
            found = self.whole(chunk)
        else:
            found = [t.id for part in _PARTS.findall(chunk) for t in self.model.tokenize(charmap_decode(part.encode(), "strict", _SHOWN)[0])]
        return struct.pack(f"<{len(found)}I", *found)

    def __missing__(self, rest: str) -> bytes:
        """Ids of a blank and ``rest``."""
        ids = self.older.get(rest)
        if ids is None:
            chunks = _CHUNK.findall(f" {rest}")
            if len(chunks) > 1:
                # Kept only if its chunks have been seen, else rare words would take twice the room.
                known, ids = len(self) + len(self.bare), b"".join(map(self.chunk, chunks))
                if len(self) + len(self.bare) > known:
                    return ids
            else:
                ids = self.new(chunks[0])
        if len(rest) < self.longest:
            self[rest] = ids
        return ids

    def chunk(self, chunk: str) -> bytes:
        if chunk[0] == " ":
            return self[chunk[1:]]
        ids = self.bare.get(chunk)
        if ids is None:
            ids = self.new(chunk)
            if len(chunk) <= self.longest:
                self.bare[chunk] = ids
        return ids

    def ids(self, text: str) -> bytes:
        if any(run in text for run in _RUNS):
            return b"".join(map(self.chunk, _CHUNK.findall(text)))
        first, *rest = text.split(" ")
        return b"".join([*map(self.chunk, _CHUNK.findall(first)), *map(self.__getitem__, rest)])

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        if len(self) + len(self.bare) >= self.most // 2:
            # What is still in use comes back from the older half.
            self.older, self.bare = dict(self), {}
            self.clear()
        out = []
        for text in texts:
            try:
                out.append(np.frombuffer(self.ids(text), "<u4") if self.by_chunk else np.array(self.whole(text), "<u4"))
            except _Strange:
                out.append(np.array(self.whole(text), "<u4"))
        return out


@cache
def _encoder(path: str | None, most: int) -> Encoder:
    """One for all tasks of a worker."""
    return Encoder(_tokenizer(path), most)


def pieces(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, fine: int = FINE, keep_ids: bool = True, remembered: int = REMEMBERED) -> DataFrame:
    """Tokenised and cut documents; with ``keep_ids`` each piece carries its token ids. A worker remembers about ``remembered`` chunks of text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        memory_goes_back()
        encoder = _encoder(tokenizer, remembered)
        for batch in batches:
            for a in range(0, len(batch), TOGETHER):
                some, out = batch.iloc[a : a + TOGETHER], []
                for doc_id, found in zip(some.doc_id, encoder.encode(some.text.tolist()), strict=True):
                    ids = np.append(found, np.array([END_ID], "<u4"))
                    start = 0
                    for n in harmonic_cuts(len(ids), capacity, fine):
                        part = ids[start : start + n]
                        row = (doc_id, start, n, zlib.crc32(part.tobytes()), len(ids))
                        out.append((*row, part.astype("int32")) if keep_ids else row)
                        start += n
                names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"] + ["ids"] * keep_ids
                frame = pd.DataFrame(out, columns=names)
                frame["doc_id"] = frame["doc_id"].astype("Int64")
                yield frame

    source = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return source.mapInPandas(run, _PIECES + (", ids array<int>" if keep_ids else ""))


def fill(lengths: list[int], capacity: int) -> tuple[list[int], list[int]]:
    """Best fit of a bounded list: bin and offset of each piece."""
    bins, offsets = [0] * len(lengths), [0] * len(lengths)
    room: list[tuple[int, int]] = []
    used: list[int] = []
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        at = bisect.bisect_left(room, (lengths[i], -1))
        if at == len(room):
            b = len(used)
            used.append(0)
        else:
            b = room.pop(at)[1]
        bins[i], offsets[i] = b, used[b]
        used[b] += lengths[i]
        if used[b] < capacity:
            bisect.insort(room, (capacity - used[b], b))
    return bins, offsets


def pack(cut_pieces: DataFrame, workers: int, capacity: int = CAPACITY) -> DataFrame:
    """Adds ``sequence_id`` and ``offset``. Reruns of a lost worker give the same bins."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        memory_goes_back()
        base = TaskContext.get().partitionId() << 40
        opened: dict[int, pd.DataFrame] = {}
        next_id = 0
        for batch in batches:
            batch["_k"] = capacity // batch["length"]
            for k, group in batch.groupby("_k", sort=True):
                if k in opened:
                    group = pd.concat([opened.pop(k), group], ignore_index=True)
                full = len(group) // k * k
                if full:
                    done = group.iloc[:full].copy()
                    number = np.arange(full)
                    before = done["length"].cumsum().to_numpy() - done["length"].to_numpy()
                    done["sequence_id"] = base + next_id + number // k
                    done["offset"] = before - before[number // k * k]
                    next_id += full // k
                    yield done.drop(columns="_k")
                if full < len(group):
                    opened[k] = group.iloc[full:]
        if opened:
            rest = pd.concat([opened[k] for k in sorted(opened)], ignore_index=True)
            bins, offsets = fill(rest["length"].tolist(), capacity)
            rest["sequence_id"] = base + next_id + np.array(bins)
            rest["offset"] = offsets
            yield rest.drop(columns="_k")

    dealt = cut_pieces.repartition(workers, F.xxhash64("doc_id", "start", "ids_crc32"))
    ordered = dealt.sortWithinPartitions("doc_id", "start", "ids_crc32")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in cut_pieces.schema) + ", sequence_id bigint, offset bigint"
    return ordered.mapInPandas(run, schema)


def packed(docs: DataFrame, keep_ids: bool = True, **options) -> DataFrame:
    """Documents packed; the number of workers follows the documents and the pieces that their characters make."""
    made = docs.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.char_length("text")), F.lit(0)).alias("chars")).first()
    n = made.n + made.chars // (CHARS_A_TOKEN * CAPACITY)
    workers = max(1, min(n // DOCS_PER_WORKER, max(shuffle_width(docs.sparkSession), n // 200_000)))
    return pack(pieces(docs, keep_ids=keep_ids, **options), workers)


def op2_harmonic_packing(spark, sf_dir):
    return packed(table(spark, sf_dir, "documents"), keep_ids=False)
