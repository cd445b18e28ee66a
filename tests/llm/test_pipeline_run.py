"""The whole pipeline: what comes out can be read back, and says of every document what the stages before decided."""

import zlib
from collections import defaultdict

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from sitelens.llm import packing

DATA = "/root/testdata/sf0.001"


def test_sequences_hold_the_mixed_documents(spark):
    docs, kept = spark.read.parquet(f"{DATA}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, DATA).cache()
        kept.append((name, {r.doc_id for r in docs.select("doc_id").collect()}))
    # Nothing comes back that a stage has let go.
    assert all(after <= before for (_, before), (_, after) in zip(kept, kept[1:], strict=False)) and kept[-1][1]
    encoder = packing._tokenizer(None)
    want = defaultdict(list)
    for r in docs.select("doc_id", "text").collect():
        want[r.doc_id].append(tuple([*encoder.encode(r.text or "", add_special_tokens=False).ids, packing.END_ID]))
    rows = corpus_pipeline.run(spark, DATA).collect()
    sequences, pieces = defaultdict(list), defaultdict(list)
    for r in rows:
        assert zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 and len(r.ids) == r.length
        sequences[r.sequence_id].append((r.offset, r.length))
        pieces[r.doc_id, r.doc_tokens].append((r.start, tuple(r.ids)))
    for spans in sequences.values():
        spans.sort()
        assert spans[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(spans, spans[1:], strict=False)) and sum(spans[-1]) <= packing.CAPACITY
    # Pieces of one document and length are those of its copies; equal starts hold equal ids unless the texts differ.
    flat = sorted((d, start, ids) for (d, _), found in pieces.items() for start, ids in found)
    cut = sorted((d, start, ids[start : start + n]) for d, texts in want.items() for ids in texts for start, n in starts(len(ids)))
    assert flat == cut


def starts(total):
    at = 0
    for n in packing.harmonic_cuts(total):
        yield at, n
        at += n


def test_masked_texts_are_what_is_packed(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    masked = corpus_pipeline.secrets_stage(spark, docs, DATA)
    changed = masked.join(docs.select("doc_id", F.col("text").alias("before")), "doc_id").where("NOT text <=> before")
    assert masked.count() == docs.count() and all("[" in r.text for r in changed.collect())
