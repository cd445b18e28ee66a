"""Operators against brute force without Spark where that is enough, missing ids, clashing columns, and the pipeline's stages."""

import itertools
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from sitelens.llm import jaccard_join, licences, media, mixing, neighbours, packing, quality, secrets, substrings, url_filter

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DATA = "/root/testdata/sf0.001"


def test_line_marginals_by_all_paths():
    rng = np.random.default_rng(2)
    lengths = np.array([5, 1, 3])
    unary, transition = rng.normal(size=(3, 5)), rng.normal(size=(2, 2))
    good, moves = quality.marginals(unary, lengths, transition)
    want_moves = np.zeros((2, 2))
    for d, n in enumerate(lengths):
        total, mass, pairs = 0.0, np.zeros(n), np.zeros((2, 2))
        for path in itertools.product((0, 1), repeat=int(n)):
            w = np.exp(sum(unary[d, t] for t in range(n) if path[t]) + sum(transition[a, b] for a, b in itertools.pairwise(path)))
            total += w
            mass += w * np.array(path)
            for a, b in itertools.pairwise(path):
                pairs[a, b] += w
        assert np.allclose(good[d, :n], mass / total)
        want_moves += pairs / total
    assert np.allclose(moves, want_moves)


def test_quality_of_held_out_documents():
    duckdb = pytest.importorskip("duckdb")
    import zlib
    from pathlib import Path

    def read(name, columns):
        path = Path(f"{DATA}/{name}.parquet")
        return duckdb.sql(f"SELECT {columns} FROM '{path}{'/*.parquet' if path.is_dir() else ''}'").fetchall()

    texts, labels = dict(read("documents", "doc_id, text")), dict(read("labels", "doc_id, quality"))
    known = [(texts[i] or "", int(q), zlib.crc32(str(i).encode()) % 4 == 2) for i, q in labels.items() if i in texts and q is not None]
    model = quality.LineField.fit([t for t, _, held in known if not held], [q for _, q, held in known if not held])
    held = [(t, q) for t, q, out in known if out]
    right = sum((s >= 0.5) == (q == 1) for s, (_, q) in zip(model.score([t for t, _ in held]), held, strict=True))
    assert len(held) >= 5 and right >= 0.8 * len(held)


def test_scores_do_not_depend_on_what_is_scored_together():
    model = quality.LineField.fit(["good words here.\nand more.", "X!! Y##\nZ$$"] * 10, [1, 0] * 10, steps=30)
    found = ["a b\nc", "", "X!!", "words " * 50, "one\n" * 40]
    assert np.allclose(model.score(found), [model.score([t], 1)[0] for t in found])


def test_licence_windows_by_brute_force():
    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(12)]
    templates = [("A", " ".join(rng.choices(vocabulary, k=6))), ("B", " ".join(rng.choices(vocabulary, k=9)))]
    scanner = licences.Scanner(templates, 0.8)
    for _ in range(200):
        words = rng.choices(vocabulary, k=rng.randint(0, 25))
        if rng.random() < 0.6:
            words[3:3] = templates[rng.randrange(2)][1].split()
        best = 0.0
        for a in range(len(words)):
            for b in range(a + 2, len(words) + 1):
                grams = licences.bigrams(" ".join(words[a:b]))
                best = max([best, *(2 * len(grams & t) / (len(grams) + len(t)) for t in map(licences.bigrams, (t for _, t in templates)) if grams and t)])
        found = scanner.windows(" ".join(words))
        assert bool(found) == (best >= 0.8) and all(d >= 0.8 for *_, d in found)
        if found:
            assert max(d for *_, d in found) <= best + 1e-12


@pytest.mark.parametrize("seed", [101, 202])
def test_secrets_of_findings_that_were_not_learned(seed):
    scanner = secrets.Scanner(secrets.synthetic_findings())
    held = secrets.synthetic_findings(600, seed)
    p = scanner.forest.predict(scanner.features([(f.candidate, f.before, f.path) for f in held]))
    assert np.mean((p >= secrets.THRESHOLD) == np.array([f.secret for f in held])) >= 0.95


def test_forest_walks_its_trees():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 4))
    forest = secrets.Forest.fit(x, (x[:, 1] > 0).astype(float), trees=5, depth=4)

    def walk(tree, row):
        return tree if isinstance(tree, float) else walk(tree[2] if row[tree[0]] <= tree[1] else tree[3], row)

    assert np.allclose(forest.predict(x), [np.mean([walk(t, r) for t in forest.trees]) for r in x])
    assert np.mean((forest.predict(x) >= 0.5) == (x[:, 1] > 0)) > 0.95


def test_boosted_trees_as_sql(spark):
    rng = np.random.default_rng(3)
    x = rng.integers(0, 20, (400, 3)).astype(float)
    y = ((x[:, 0] > 8) ^ (x[:, 2] > 15)).astype(float)
    base, trees = url_filter.boost(x, y, rounds=12)
    margin = base + url_filter.RATE * sum(url_filter.predict(t, x) for t in trees)
    assert any(not isinstance(t, float) for t in trees) and np.mean((margin > 0) == (y > 0)) > 0.9
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "i int, a double, b double, c double")
    made = df.select("i", F.expr(" + ".join([f"{base!r}D", *[f"{url_filter.RATE!r}D * ({url_filter.as_sql(t, ['a', 'b', 'c'])})" for t in trees]])).alias("m"))
    assert np.allclose([r.m for r in made.orderBy("i").collect()], margin)


def test_urls_learned_from_both_labels(spark):
    rows = [(i, f"http://h{i % 7}.com/{'spam' * (i % 2)}{'x' * (3 + 20 * (i % 2))}{i % 10}") for i in range(200)] + [(None, "http://a.com/x"), (900, None), (7, "http://h0.com/en/")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string")
    labelled = pages.where("page_id < 200").select("page_id", "url", (F.col("page_id") % 2).alias("blocked"))
    got = url_filter.judge(pages, labelled, rules=()).collect()
    assert len(got) == len(rows) and all((r.verdict == "block") == (r.page_id % 2 == 1) for r in got if r.page_id is not None and r.page_id < 200 and r.host != "h0.com")
    assert url_filter.judge(pages.limit(0), labelled, rules=()).count() == 0 and url_filter.judge(pages, labelled.limit(0)).count() == len(rows)


CLASH = "doc_id bigint, text string, source string, n_chars bigint, _quality double, _scan string, position int, place string, copies int, extra int, size int, `id` int, `row` int, turn int, taken int, _row int, _order int, `a.b` string"


def clashing(spark, texts, ids=None):
    ids = range(len(texts)) if ids is None else ids
    return spark.createDataFrame([(i, t, f"s{k % 2}", len(t or ""), 0.5, "x", *[1, "p", 1, 1, 1, 1, 1, 1, 1, 1, 1], f"v{k}") for k, (i, t) in enumerate(zip(ids, texts, strict=True))], CLASH)


def test_missing_ids_are_kept(spark):
    found = ["some words of a text", None, "some words of a text"]
    docs = clashing(spark, found, [None, None, 3])
    assert packing.packed(docs).count() == 3 and media.media(docs).count() == 3 and mixing.mix(docs).count() == 3
    assert substrings.dedup(docs).count() == 3 and jaccard_join.join(docs).count() == 3
    vectors = spark.createDataFrame([(None, [1.0, 2.0]), (0, [1.0, 2.0]), (1, [2.0, 1.0]), (0, [5.0, 5.0]), (2, [1.0, 2.0, 3.0])], "vec_id bigint, embedding array<double>")
    got = neighbours.search(vectors, vectors.where("vec_id = 0")).collect()
    assert [(r.query_id, r.vec_id, round(r.score, 6)) for r in got] == [(0, 1, round(2**0.5, 6))]


def test_nearest_rows_of_many_ties():
    x = np.vstack([np.ones((50, 4)), np.random.default_rng(0).normal(size=(30, 4)) + 5])
    ids = np.arange(80)[::-1].copy()
    i, j, d = neighbours.nearest_rows(x, ids, np.ones((1, 4)), np.array([40]), 10)
    assert ids[j].tolist() == [30, 31, 32, 33, 34, 35, 36, 37, 38, 39] and (d == 0).all()


def test_mixed_rows_are_written_as_planned(spark):
    found = [" a  b\tc ", " a  b\tc ", "one two three four five six", None, "", "x y z " * 5]
    docs = clashing(spark, found, [1, 1, 2, 3, 4, 5])
    plan = {}
    for r in mixing.mix(docs).collect():
        plan[r.doc_id] = plan.get(r.doc_id, 0) + r.taken
    out = mixing.materialise(docs, docs.columns).collect()
    got = {}
    for r in out:
        got[r.doc_id] = got.get(r.doc_id, 0) + len(WORD.findall(r.text))
        assert found[{1: 0, 2: 2, 5: 5}[r.doc_id]].startswith(r.text) and r.n_chars == len(r.text)
    assert got == {i: n for i, n in plan.items() if n}


def test_near_duplicates_stage_by_brute_force(spark):
    rng = random.Random(8)
    base = [f"w{i}" for i in range(60)]
    found = [" ".join(base), " ".join([*base[:-1], "x"]), " ".join(reversed(base)), " ".join(base), None, "", "short text", "short text", " ".join(rng.choices(base, k=40))]
    ids = [4, 2, 2, 9, 1, 1, 11, 10, 12]
    docs = clashing(spark, found, ids)
    sets = [frozenset(zip(*(WORD.findall(t or "")[k:] for k in range(5)), strict=False)) or frozenset([tuple(WORD.findall(t or ""))] if WORD.findall(t or "") else []) for t in found]
    label = list(range(len(found)))
    for _ in found:
        for i, j in itertools.combinations(range(len(found)), 2):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                label[i] = label[j] = min(label[i], label[j])
    want = sorted([min(ids[i] for i in range(len(found)) if label[i] == g) for g in set(label) if sets[g]] + [i for i, s in zip(ids, sets, strict=True) if not s])
    out = corpus_pipeline.near_duplicates_stage(spark, docs, DATA)
    assert out.columns == docs.columns and sorted(r.doc_id for r in out.collect()) == want


def test_other_stages(spark):
    good = "the words of a plain text go on and on.\nthey are many and they are plain."
    key = "9fK2mQ7xR4tZ8vB1nL6wYc3D"
    docs = clashing(spark, [good, None, "", f"password={key} and words", good])
    scored = quality.score(docs.select("doc_id", "text"), quality.trained(spark, docs, DATA), "s").collect()
    kept = corpus_pipeline.quality_stage(spark, docs, DATA)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == sorted(r.doc_id for r in scored if r.s >= quality.THRESHOLD)
    masked = {r.doc_id: r for r in corpus_pipeline.secrets_stage(spark, docs, DATA).collect()}
    assert masked[3].text == "password=<SECRET> and words" and masked[3].n_chars == len(masked[3].text) and masked[3]._scan == "x" and masked[1].text is None and masked[0].text == good
    mixed = corpus_pipeline.mixing_stage(spark, docs, DATA)
    assert mixed.columns == docs.columns
    pieces = corpus_pipeline.packing_stage(spark, mixed, DATA).collect()
    ends = {}
    for r in pieces:
        ends.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert all([o for o, _ in sorted(p)] == [0, *itertools.accumulate(n for _, n in sorted(p))][:-1] and sum(n for _, n in p) <= 2048 for p in ends.values())
    nothing = docs.limit(0)
    assert all(stage(spark, nothing, DATA).count() == 0 for _, stage in corpus_pipeline.STAGES)
