"""What the fourth round found."""

import itertools
import random

from pyspark.sql import functions as F

from __spark_entry__ import oracle_sql
from sitelens.functions import text as T
from sitelens.operators import html as H
from sitelens.operators import scoring as S
from sitelens.operators import site as L
from sitelens.plans import audit
from sitelens.plans.registry import REGISTRY


def test_a_half_is_rounded_up_in_every_order(spark):
    scores = {"seo": 57, "aeo": 6, "geo": 5, "ai": 36}  # 0.3 * 57 + 0.25 * 6 + 0.3 * 5 + 0.15 * 36 = 25.5
    for order in itertools.permutations(scores):
        rows = spark.createDataFrame([("a", p, 1.0, scores[p]) for p in order], "audit_id string, pillar string, coverage double, score bigint").coalesce(1)
        assert S.overall_scores(rows).first().overall == 26
    groups = [("a", "seo", "g0", 0.1, 1.0, 10.0), ("a", "seo", "g1", 0.7, 1.0, 10.0), ("a", "seo", "g2", 0.55, 1.0, 10.0), ("a", "seo", "g3", 0.51, 1.0, 10.0)]
    made = {S.pillar_scores(spark.createDataFrame(list(rows), "audit_id string, pillar string, group string, score double, coverage double, group_weight double").coalesce(1)).first().score for rows in itertools.permutations(groups)}
    assert made == {47}


def test_all_links_of_a_page_count():
    body = "".join(f'<a href="/p{i}">{"w" * 130}{i}</a><a href="https://o{i}.org/">o</a><h2>H{i}{"x" * 400}</h2>' for i in range(700))
    got = H.parse(f"<html><body>{body}</body></html>", "https://e.com/")
    assert len(got["internal_links"]) == 700 and len(got["external_links"]) == 700 and len(got["anchor_texts"]) == 1400 and len(set(got["anchor_texts"])) == 701
    assert len(got["headings"]) == 700 and len(got["headings"][0]["text"]) == 402
    deep = H.parse("<a href=/x>" * 20_000 + "t" * 5_000, "https://e.com/")
    assert len(deep["anchor_texts"]) == 20_000 and sum(map(len, deep["anchor_texts"])) < 20_000 * 200


def test_pages_linked_far_down_are_no_orphans(spark):
    home = "<body>" + "".join(f'<a href="/p{i}">x</a>' for i in range(500))
    rows = [("e", 0, "https://e.com/", 0, home)] + [("e", i + 1, f"https://e.com/p{i}", 1, "<p>t") for i in range(500)]
    got = spark.createDataFrame(rows, "audit_id string, page_ord bigint, url string, depth int, html string").selectExpr("*", "url AS final_url", "200 AS status_code", "'text/html' AS content_type", "CAST(NULL AS STRING) AS error")
    assert L.orphan_pages(H.page_signals(got)).count() == 0


def test_documents_are_compared_whole(spark, tmp_path):
    same = " ".join(f"same{i}" for i in range(1700))
    texts = [same + "".join(f" {c * 3}{i}" for i in range(1500)) for c in "ab"] + [same + " one two", same + " three four"]
    spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)], "doc_id bigint, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    assert [(r.a, r.b) for r in REGISTRY["doc_near_duplicates"][0](spark, str(tmp_path)).collect()] == [(2, 3)]
    assert spark.range(1).select(F.size(T.shingles(F.lit(texts[0]), cap=None))).first()[0] == 3196


def test_pairs_of_blocks_are_those_of_brute_force(spark):
    rng = random.Random(4)
    pages = [(s, i, sorted(rng.sample(range(3 << 30, (3 << 30) + 400), rng.choice([39, 40, 60])))) for s in ("a", "b") for i in range(60)] + [("c", 1, list(range(50))), (None, 2, list(range(50))), (None, 3, list(range(50)))]
    want = {(s, i, j, round(len(set(x) & set(y)) / len(set(x) | set(y)), 9)) for s, i, x in pages for t, j, y in pages if s and s == t and i < j and min(len(x), len(y)) > 39 and len(set(x) & set(y)) >= 0.1 * len(set(x) | set(y))}
    rows = spark.createDataFrame(pages, "audit_id string, page_ord bigint, shingles array<bigint>")
    for block in (7, 16_384):
        got = [(r.audit_id, r.a, r.b, round(r.similarity, 9)) for r in L.shared_pairs(rows, least=0.1, block=block).collect()]
        assert len(got) == len(want) > 100 and set(got) == want
    # Pages are shuffled, not pairs: no join meets pages with pages.
    plan = L.shared_pairs(rows, least=0.1)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 1


def test_evidence_reads_whole_texts(spark, tmp_path):
    text = " ".join(f"word{i}" for i in range(3000))
    rows = [(1, "https://e.com/", f"<html><head></head><body><p>{text}</p></body></html>")]
    spark.createDataFrame(rows, "page_id bigint, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    whole, cut = (pages(spark, str(tmp_path)).first() for pages in (audit.whole_pages, audit.seen_pages))
    assert whole.excerpt == whole.body_text == cut.body_text and text in whole.excerpt and len(whole.shingles) == 2996
    assert len(cut.excerpt) == 1200 and len(cut.shingles) == 400
    sql = oracle_sql()
    assert "1600" not in sql["findings_evidence"] and "1200" not in sql["findings_evidence"] and "1600" in sql["site_facts"] and "1200" in sql["site_facts"]
    long = spark.createDataFrame([("e", 0, "https://e.com/", 0, "<body>" + "x" * 2_000_000 + " end")], "audit_id string, page_ord bigint, url string, depth int, html string")
    long = long.selectExpr("*", "url AS final_url", "200 AS status_code", "'text/html' AS content_type", "CAST(NULL AS STRING) AS error")
    assert H.page_signals(long).select("body_text").first()[0].endswith("x end")
