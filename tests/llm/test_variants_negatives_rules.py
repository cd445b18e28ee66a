"""Spelling variants, hard negatives and quality rules against brute force, SQL and held-out labels."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from sitelens.llm import hard_negatives, quality_rules, registry, spelling
from sitelens.llm.common import Scratch

DATA = "/root/testdata/sf0.001"
LETTERS = re.compile("[A-Za-zÀ-ÿ]+")


def variants_by_force(docs):
    n = Counter()
    for i, text in docs:
        for run in LETTERS.findall(text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += len(run) >= 5
    n = {w: k for w, k in n.items() if k >= 3}
    near, wild = defaultdict(set), defaultdict(list)
    for w in n:
        for i in range(len(w)):
            if (r := w[:i] + w[i + 1 :]) in n:
                near[w].add(r)
                near[r].add(w)
            wild[i, w[:i], w[i + 1 :]].append(w)
    for group in wild.values():
        for w in group:
            near[w].update(x for x in group if x != w)
    best = {w: min(near[w], key=lambda x: (-n[x], x)) for w in n if near[w]}
    form = {w: b for w, b in best.items() if n[b] >= 2 * n[w]}
    out = set()
    for w in n:
        root = w
        while root in form:
            root = form[root]
        out.add((w, form.get(w), root, n[w], len(near[w]), n[form[w]] if w in form else None))
    return out


def shown(df):
    rows = [tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


@pytest.mark.parametrize("limit", [spelling.LIMIT, 14])
def test_variants_by_brute_force(spark, limit):
    rng = random.Random(limit)
    docs = [(k, "".join(rng.choice("aab éB") for _ in range(1500))) for k in range(30)]
    docs += [(None, "Abcde abcdE, abcdef abcdef abcdef"), (7, None), (7, ""), (8, ("x" * 3000 + " ") * 3 + ("x" * 2999 + " ") * 9), (9, "fußball fussball ÿÀÿÀÿ " * 4), (9, "fußball fussball ÿÀÿÀÿ " * 4), (10, "naive 日本 náive")]
    df = spark.createDataFrame([(i, t, 1, "a") for i, t in docs], "doc_id bigint, text string, n int, word string")
    want = variants_by_force(docs)
    assert shown(spelling.variants(df, limit)) == want and any(w[4] > 10 for w in want)


def test_hot_groups_are_dealt_out(spark):
    words = [f"same{a}{b}{c}tail" for a in "abcdef" for b in "abcdef" for c in "abcdef"]
    vocab = spark.createDataFrame([(w, 3) for w in words], "word string, n bigint")
    rows = spelling.grouped(vocab, Scratch(spark), 40)
    weight = rows.groupBy("base", "at", "to", "rest").agg(F.sum(F.col("to") - F.col("at")).alias("w"), F.max(F.col("to") - F.col("at")).alias("size"))
    assert weight.where("w > 40 AND size > 1").isEmpty()
    pairs = spelling.near_pairs(vocab, Scratch(spark), 40).collect()
    assert len(pairs) == len({(p.word, p.near) for p in pairs}) == 216 * 15


def test_variants_of_empty_tables(spark):
    df = spark.createDataFrame([], "doc_id bigint, text string")
    assert shown(spelling.variants(df)) == set()
    assert shown(spelling.variants(spark.createDataFrame([(1, None), (None, None), (2, "a b")], "doc_id bigint, text string"))) == set()


def test_chains_of_forms(spark):
    chain = [(f"w{i}", f"w{i + 1}") for i in range(37)] + [("x", "w36")]
    got = spelling.roots(spark.createDataFrame(chain, "word string, form string"), Scratch(spark)).collect()
    assert {r.word: r.root for r in got} == dict.fromkeys([w for w, _ in chain], "w37")


def negatives_by_force(rows):
    good = []
    for i, v, label in rows:
        if i is None or label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        good.append((i, int(math.fmod(label + 1, 10)) if i % 7 == 0 else label, [math.floor(256 * x) for x in v]))
    anchors = {}
    for r in good:
        if r[0] % 100 == 0:
            anchors[r[0]] = min(anchors.get(r[0], r), r)

    def dot(a, b):
        return max(min(sum(x * y for x, y in zip(a, b, strict=True)), 2**63 - 1), 1 - 2**63)

    out = []
    for i, label, v in anchors.values():

        def best(fits, own=i, v=v):
            found = {}
            for j, m, w in good:
                if j != own and len(w) == len(v) and fits(m, s := dot(v, w)):
                    found[j] = max(found.get(j, s), s)
            return sorted(found.items(), key=lambda t: (-t[1], t[0]))[:5]

        for p, ps in best(lambda m, s, own=label: m == own):
            for k, (n, ns) in enumerate(best(lambda m, s, own=label, ps=ps: m != own and 80 * ps <= 100 * s <= 100 * ps)):
                out.append((i, p, k + 1, n, ps, ns))
    return sorted(out)


@pytest.mark.parametrize(("seed", "large", "block"), [(1, 1.0, 1 << 25), (2, 3.0, 300), (3, 1e20, 1 << 25)])
def test_negatives_by_brute_force(spark, seed, large, block):
    rng = random.Random(seed)
    rows = []
    for i in range(500):
        v = [rng.choice([0.0, 0.5, rng.random(), -0.2]) * (large if rng.random() < 0.1 else 1) for _ in range(rng.choice([4, 4, 4, 3, 0]))]
        if v and rng.random() < 0.04:
            v[0] = rng.choice([None, math.nan, math.inf])
        rows.append((rng.choice([i, i, i, None, i // 50 * 50, -i]), v if rng.random() < 0.97 else None, rng.choice([0, 1, 1, 2, None, 9, -5])))
    rows += rows[:30]
    df = spark.createDataFrame([(*r, 0, 1) for r in rows], "vec_id bigint, embedding array<double>, label int, rank int, anchor_id int").repartition(3)
    want = negatives_by_force(rows)
    assert sorted(map(tuple, hard_negatives.mine(df, block).collect())) == want and len(want) > 50


def test_negatives_of_equal_vectors_and_none(spark):
    rows = [(i, [0.5, 0.25], i % 3) for i in range(1, 301)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int")
    assert sorted(map(tuple, hard_negatives.mine(df).collect())) == negatives_by_force(rows)
    assert hard_negatives.mine(df.limit(0)).count() == 0
    assert hard_negatives.mine(df.where("vec_id % 100 <> 0")).count() == 0
    assert hard_negatives.mine(df.withColumn("label", F.lit(None).cast("int"))).count() == 0


def test_products_are_exact():
    rng = np.random.default_rng(1)
    a, c = (hard_negatives.Side(np.arange(n), np.zeros(n), rng.integers(-(2**30), 2**30, (n, 5)) / 256.0) for n in (4, 6))
    a.x[0] *= 2.0**10
    a.largest = np.abs(a.x).max(1)
    want = [[max(min(sum(int(p) * int(q) for p, q in zip(r, s, strict=True)), 2**63 - 1), 1 - 2**63) for s in c.x] for r in a.x]
    assert hard_negatives.products(a, c).tolist() == want


def base_by_force(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen, again, inside = set(), 0, set()
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            again += line in seen
            seen.add(line)
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    times = Counter(windows)
    for i, w in enumerate(windows):
        if times[w] > 1:
            inside |= set(range(i, i + 5))
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), again, len(inside)


HOSTILE = [
    None, "", " \t\r\n", "a", "\n\n\n", "same line\nsame line\n same line\nsame line", "a b c d e a b c d e", "a b c d e f a b c d e g b c d e f", "x " * 40, "word " * 9, "w" * 300_000, "\x0b\x0c#*$%&|<>     é 日本 😀",
    " ".join(f"w{i % 997}" for i in range(60_000)), "one two three four five six seven eight nine ten", "line\r\nline\r\nline\n",
]


def test_base_counts_by_brute_force(spark):
    rows = [(k if k % 5 else None, t, "x", 1.0) for k, t in enumerate(HOSTILE + HOSTILE[:4])]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, stats string, score double")
    got = quality_rules.judge(df, quality_rules.grow(np.zeros((4, len(quality_rules.FEATURES))), np.ones(4), np.zeros(len(quality_rules.FEATURES), int))).collect()
    key = lambda r: tuple((v is None, v or 0) for v in r)
    assert sorted([(r.doc_id, *[r[c] for c in quality_rules.COUNTS]) for r in got], key=key) == sorted([(i, *base_by_force(t)) for i, t, *_ in rows], key=key)
    assert all(r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words) and r.kept != r.base_failed for r in got)
    assert quality_rules.judge(df.limit(0), quality_rules.grow(np.zeros((0, 13)), np.zeros(0), np.zeros(13, int))).count() == 0


def test_counts_of_all_documents(spark):
    texts = [r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    assert [base for base, _ in quality_rules.all_counts([t or "" for t in texts], 3000)] == [base_by_force(t) for t in texts]


def test_trees_by_walking_them_and_monotone():
    rng = np.random.default_rng(4)
    x = rng.integers(0, 30, (600, 4)).astype(float)
    y = ((x[:, 0] + rng.integers(0, 8, 600) > 18) ^ (x[:, 1] > 25) | (x[:, 2] > 20)).astype(float)
    signs = np.array([1, -1, 0, 0])
    model = quality_rules.grow(x, y, signs)
    assert np.mean((model.score(x) >= 0.5) == (y > 0)) > 0.85

    def walk(at, row):
        f = model.feature[at]
        return model.value[at] if f < 0 else walk(model.left[at] + int(row[f] > model.threshold[at]), row)

    assert np.allclose(model.margin(x[:50]), [model.base + sum(walk(r, row) for r in model.root) for row in x[:50]])
    for f, sign in ((0, 1), (1, -1)):
        grid = np.repeat(rng.integers(0, 30, (40, 4)).astype(float)[:, None], 31, axis=1)
        grid[:, :, f] = np.arange(31)
        steps = np.diff(model.margin(grid.reshape(-1, 4)).reshape(40, 31), axis=1) * sign
        assert (steps >= -1e-9).all() and (steps > 0).any()
    free = quality_rules.grow(x, y, np.zeros(4, int))
    assert np.mean((free.score(x) >= 0.5) == (y > 0)) >= np.mean((model.score(x) >= 0.5) == (y > 0)) - 0.02


def test_verdicts_of_held_out_documents(spark):
    folder = "/root/testdata/sf0.01"
    got = registry.queries()["op13_monotone_rules"](spark, folder)
    labels = spark.read.parquet(f"{folder}/labels.parquet").where("crc32(cast(cast(doc_id as string) as binary)) % 4 = 2")
    rows = got.join(labels, "doc_id").collect()
    assert len(rows) > 50 and sum(r.kept == (r.quality == 1) for r in rows) >= 0.95 * len(rows)


def test_rules_without_labels(spark):
    docs = spark.createDataFrame([(i, f"some plain words of text number {i} and a few more words") for i in range(5)], "doc_id bigint, text string")
    none = spark.createDataFrame([(1, None), (None, 1), (77, 0)], "doc_id bigint, quality int")
    assert [r.kept for r in quality_rules.judge(docs, quality_rules.train(docs, none)).collect()] == [True] * 5


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_matches_sql(spark, name):
    db = duckdb.connect()
    for t in ("documents", "embeddings"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    df = registry.queries()[name](spark, DATA)
    want = db.execute(f"SELECT {', '.join(df.columns)} FROM ({registry.oracle_sql()[name]})").fetchall()
    key = lambda r: tuple((v is None, str(v)) for v in r)
    assert want and sorted(map(tuple, df.collect()), key=key) == sorted(want, key=key)
