"""Round 3: what the findings on time and memory named."""

from __future__ import annotations

import random
import re
from collections import Counter
from contextlib import redirect_stdout
from io import StringIO

import numpy as np
import pandas as pd
from pyspark.sql import Row

from sitelens.llm import hashing, jaccard_join, mixing, packing, substrings
from sitelens.llm.common import _BATCH, Scratch
from sitelens.plans import registry
from sitelens.streaming import limits


class _Counted:
    """A tokenizer that tells what it is asked to encode."""

    def __init__(self, tokenizer):
        self.tokenizer, self.model, self.asked = tokenizer, tokenizer.model, []

    def to_str(self):
        return self.tokenizer.to_str()

    def encode_batch_fast(self, texts, **options):
        self.asked += texts
        return self.tokenizer.encode_batch_fast(texts, **options)


def test_latin_words_go_to_the_model_alone():
    counted = _Counted(packing._tokenizer(None))
    rng = random.Random(3)
    letters = "abcDEFzéßÿÀ'stre.,-12 \n"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 60))) for _ in range(2000)]
    found = [ids.tolist() for ids in packing.Encoder(counted, most=4000).encode(texts)]
    assert not any(counted.asked)
    assert found == [e.ids for e in counted.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]


def test_other_scripts_and_signs_agree_with_the_tokenizer():
    tokenizer = packing._tokenizer(None)
    rng = random.Random(4)
    signs = [chr(c) for c in range(33, 384)] + list("шо中文字ª²½µ") + [" "] * 60 + ["\n", "\t", "'s", "'ll", "​", " "]
    texts = ["".join(rng.choice(signs) for _ in range(rng.randint(0, 40))) for _ in range(3000)]
    assert [ids.tolist() for ids in packing.Encoder(tokenizer).encode(texts)] == [e.ids for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]


def test_near_duplicates_hand_python_few_texts_at_a_time(spark, monkeypatch):
    def sizes(batches):
        yield from (pd.DataFrame({"n": [len(b)]}) for b in batches)

    made, seen = [], []
    monkeypatch.setattr(jaccard_join, "Scratch", lambda *a, **b: made.append(Scratch(*a, **b)) or made[-1])
    monkeypatch.setattr(jaccard_join, "cell_counts", lambda docs, width, f=jaccard_join.cell_counts: seen.append(spark.conf.get(_BATCH)) or f(docs, width))
    docs = spark.range(40).selectExpr("id AS doc_id", "concat('a b c d e f g h i j k l ', id % 2) AS text")
    assert jaccard_join.join(docs).select("component_id").distinct().count() == 2
    rows = spark.range(0, 3000, 1, 1).mapInPandas(sizes, "n long")
    assert max(r.n for r in rows.collect()) == 3000 and max(r.n for r in made[0].cut(rows).collect()) <= jaccard_join.SLICE
    assert spark.conf.get(_BATCH) == seen[0]


class _State:
    """A value state and timers that count what they are asked."""

    def __init__(self):
        self.value, self.timers, self.asked = None, set(), 0

    def getValueState(self, name, schema):
        return self

    def get(self):
        self.asked += 1
        return self.value

    def exists(self):
        self.asked += 1
        return self.value is not None

    def update(self, value):
        self.asked, self.value = self.asked + 1, value

    def registerTimer(self, at):
        self.asked += 1
        self.timers.add(at)

    def deleteTimer(self, at):
        self.asked += 1
        self.timers.remove(at)


def test_a_key_costs_three_questions_to_its_state_and_no_frame():
    state, limiter = _State(), limits.CallLimiter(3600, 2, aligned=False)
    limiter.init(state)
    minute = 60_000_000
    rows = list(limiter.handleInputRows(("ip", "7"), iter([Row(call=3, micros=9 * minute), Row(call=1, micros=5 * minute), Row(call=2, micros=9 * minute)]), None))
    assert [(r.call, r.window_us, r.allowed) for r in rows] == [(1, 5 * minute, True), (2, 5 * minute, True), (3, 5 * minute, False)]
    assert state.asked == 3 and state.timers == {65 * 60_000}
    rows = list(limiter.handleInputRows(("ip", "7"), iter([Row(call=4, micros=10 * minute), Row(call=5, micros=65 * minute)]), None))
    assert [(r.window_us, r.allowed) for r in rows] == [(5 * minute, False), (65 * minute, True)]
    assert state.value == (65 * minute, 1) and state.timers == {125 * 60_000}


def test_windows_of_short_texts_are_hashed_side_by_side():
    rng, calls = np.random.default_rng(5), []
    sizes = [*rng.integers(0, 40, 3000), 0, 12, 13, hashing.TOGETHER + 5, 3]
    hashed = [rng.integers(0, 2**64, n, np.uint64) for n in sizes]
    found = hashing.side_by_side(hashed, 13, lambda h: calls.append(len(h)) or substrings.minimizers(h))
    assert len(calls) < 10 and sum(calls) == sum(sizes)
    assert all(np.array_equal(a, substrings.minimizers(h)) for a, h in zip(found, hashed, strict=True))
    nodes = hashing.side_by_side(hashed, 12, lambda h: hashing.rolled(h, 12))
    assert all(np.array_equal(a, hashing.rolled(h, 12)) for a, h in zip(nodes, hashed, strict=True))
    assert hashing.side_by_side([], 13, substrings.minimizers) == []


def test_mixing_shuffles_whole_texts_twice(spark):
    docs = spark.createDataFrame([(k, f"a b c {k}", "s", 7) for k in range(50)], "doc_id bigint, text string, source string, n_chars bigint")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        with redirect_stdout(StringIO()) as said:
            mixing.materialise(docs, docs.columns).explain("formatted")
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    # Spark may take the text out of its row.
    assert len(re.findall(r"\) Exchange\nInput \[\d+\]: \[[^\]]*\b(?:row|_extract_text|taken)#", said.getvalue())) == 2


def test_rows_alike_are_mixed_as_planned(spark):
    rows = [(5, "a b", None), (5, None, "a b"), (None, "0", "u"), (0, "u", None), *[(7, "one two three", "t")] * 40, *[(None, "one two three", "t")] * 40, (9, " ", "t"), (8, "x " * 300, "v")]
    docs = spark.createDataFrame([(*r, k) for k, r in enumerate(rows)], "doc_id bigint, text string, source string, k int")
    plan, got, ahead = {}, {}, []
    for r in mixing.mix(docs).collect():
        plan[r.doc_id, r.source] = plan.get((r.doc_id, r.source), 0) + r.taken
    for r in mixing.materialise(docs, docs.columns).collect():
        got[r.doc_id, r.source] = got.get((r.doc_id, r.source), 0) + len(r.text.split())
        ahead.append(r.k)
    assert got == {k: n for k, n in plan.items() if n}
    # Every row that the mix takes a word of is there, and none more often than the mix may take it.
    assert max(ahead.count(k) for k in ahead) <= mixing.MOST + 1


def test_top_terms_count_no_pairs_of_rare_words(spark, tmp_path, monkeypatch):
    rng = random.Random(5)
    often = [f"often{k}" for k in range(20)] + ["cat", "cat"]
    texts = [(k, (None, "en", "de")[k % 3], " ".join(rng.choice(often) if rng.random() < 0.6 else f"rare{rng.randint(0, 10**6)}" for _ in range(60))) for k in range(60)]
    texts += [(70, "fr", "few words few words few words"), (71, "es", None), (72, "en", ""), (73, "de", "cat")]
    spark.createDataFrame(texts, "doc_id bigint, lang string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    weights, seen, want = {}, {}, set()
    for k, lang, text in texts:
        words = (text or "").split()
        for pos, term in enumerate(words + [f"{a} {b}" for a, b in zip(words, words[1:], strict=False)]):
            weights.setdefault(lang, Counter())[term] += 1 + (" " in term)
            seen.setdefault((lang, term), (k, pos))
    for lang, of in weights.items():
        best = sorted((-n, seen[lang, t], t) for t, n in of.items() if n > 1 and len(t) > 3)[: registry._TERMS]
        want |= {(lang, t, -n, i + 1) for i, (n, _, t) in enumerate(best)}
    counted = []
    monkeypatch.setattr(registry, "_counted_terms", lambda rows, weight, f=registry._counted_terms: counted.append(rows) or f(rows, weight))
    assert {tuple(r) for r in registry._corpus_top_terms(spark, str(tmp_path)).collect()} == want
    assert {tuple(r) for r in registry._corpus_top_terms(spark, str(tmp_path), 5).collect()} == want
    # Words in full, then pairs without rare words in languages that have enough terms.
    assert counted[1].where("term like '%rare%'").count() == 0 < counted[0].where("term like 'rare%'").count()
