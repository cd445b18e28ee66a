"""Operators of the audit engine on small fixtures."""

import datetime
import re

import pytest
from pyspark.sql import functions as F

from sitelens.functions import maths as M
from sitelens.functions import text as T
from sitelens.functions import urls as U
from sitelens.operators import catalogue as C
from sitelens.operators import crawl as K
from sitelens.operators import discovery as D
from sitelens.operators import evidence as E
from sitelens.operators import html as H
from sitelens.operators import leads as G
from sitelens.operators import plan as P
from sitelens.operators import scoring as S
from sitelens.operators import site as L
from sitelens.sources import fetches as X
from sitelens.sources import tables as B
from sitelens.streaming import limits

ORG = '{"@context":"https://schema.org","@type":"Organization","@id":"#o","name":"Acme Ltd","url":"https://acme.com","sameAs":["https://a.org","https://b.org"],"address":{"@type":"PostalAddress"},"description":"Tools for careful people. More."}'
FAQ = '{"@type":"FAQPage","mainEntity":[{"@type":"Question","name":"What is a tool?","acceptedAnswer":{"text":"A tool is a thing that helps careful people to do their work."}}]}'
GOOD = f"""<!doctype html><html lang=en><head><title>Careful tools for people | Acme</title><meta name='description' content='Acme makes tools for careful people who like their work.'>
<meta property="og:site_name" content="Acme"><link rel=canonical href="/"><script type="application/ld+json">{ORG}</script><script type="application/ld+json">{FAQ}</script><script type="application/ld+json">{{bad</script></head>
<body><main><h1>Tools for careful people</h1><p>First <b>paragraph<p>Second paragraph<ul><li>one<li>two</ul><h2>What is a tool?</h2><p>A tool is a thing that helps careful people to do their work.</p><h4>Deep</h4>
<img src=a alt="A tool"><img src=b alt=""><img src=c><a href="/pricing/?utm_source=x&b=2&a=1#t">Pricing</a><a href="https://other.org/" rel=nofollow>Other</a><a href="mailto:a@b.c">mail</a><a href="/file.pdf">pdf</a>
<script>var x = "<p>not text</p>"</script><time datetime="2025-12-01">then</time><span class="post-author">By Jane Doe</span></main></body></html>"""


def rows(df):
    return [r.asDict(True) for r in df.collect()]


def one(spark, expression):
    return spark.range(1).select(expression.alias("x")).first().x


@pytest.fixture(scope="module")
def site(spark):
    pages = [
        ("a", 0, "https://acme.com/", 0, 200, "text/html", None, GOOD), ("a", 1, "https://acme.com/pricing", 1, 200, "text/html", None, "<html><title>Pricing</title><body><h1>Pricing</h1>" + "word " * 400),
        ("a", 2, "https://acme.com/blog/one", 2, 200, "text/html", None, '<title>Pricing</title><body><h1>A</h1><h1>B</h1><meta name=robots content="NOINDEX">' + "text " * 100), ("a", 3, "https://acme.com/gone", 1, 404, "text/html", None, "<p>no"),
        ("a", 4, "https://acme.com/down", 1, 0, None, "timeout", None), ("b", 0, "http://b.org/", 0, 200, "text/html", None, "<title>Just a moment</title><script src='/cdn-cgi/challenge-platform/x'></script>"),
    ]
    df = spark.createDataFrame([(a, o, u, u, d, s, c, e, h) for a, o, u, d, s, c, e, h in pages], "audit_id string, page_ord bigint, url string, final_url string, depth int, status_code int, content_type string, error string, html string")
    return L.resolved_canonicals(H.page_signals(df)).cache()


def test_a_tree_with_implied_ends_and_any_quotes(site):
    home = rows(site.where("audit_id = 'a' AND page_ord = 0"))[0]
    assert home["title"] == "Careful tools for people | Acme" and home["lang"] == "en" and home["canonical"] == "https://acme.com/"
    assert home["meta_description"].startswith("Acme makes") and home["open_graph"] == {"og:site_name": "Acme"}
    assert [(h["level"], h["text"]) for h in home["headings"]] == [(1, "Tools for careful people"), (2, "What is a tool?"), (4, "Deep")] and home["heading_hierarchy_breaks"] == 1
    assert home["images"] == {"total": 3, "with_alt": 1, "decorative": 1} and home["lists"] == {"ul": 1, "ol": 0, "table": 0, "dl": 0}
    assert home["internal_links"] == ["https://acme.com/pricing?a=1&b=2"] and home["external_links"] == ["https://other.org/"] and home["nofollow_outbound"] == 1
    assert home["anchor_texts"] == ["Pricing", "Other", "pdf"] and home["json_ld_types"] == ["Organization", "PostalAddress", "FAQPage", "Question"] and home["json_ld_has_ids"] and home["json_ld_parse_errors"] == 1
    assert home["question_headings"] == [{"text": "What is a tool?", "answer": "A tool is a thing that helps careful people to do their work.", "answer_length": 61, "qualifies": True}]
    assert home["author_name"] == "Jane Doe" and not home["has_author_schema"] and home["date_published"] == "2025-12-01" and "not text" not in home["body_text"]
    assert home["organisation"]["weight"] == 2 + 1 + 3 + 2 + 2 and home["organisation"]["same_as"] == ["https://a.org", "https://b.org"]
    assert home["semantic_tags"] == {"main": 1, "time": 1}


def test_responses_without_a_page_are_zeroed(site):
    down = rows(site.where("page_ord = 4"))[0]
    assert down["word_count"] == 0 and down["title"] is None and down["internal_links"] == [] and down["shingles"] == []
    assert rows(L.refused_sites(site)) == [{"audit_id": "b", "vendor": "Cloudflare"}] and L.broken_pages(site).count() == 2 and L.analysable(site).count() == 3


def _facts(spark, site, **evidence):
    discovery = spark.createDataFrame([("a", True, 200, 0, True, False, True, 0, 1, True, True, 9, 6, 0, False, 1)], "audit_id string, " + ", ".join(f"{c} {t}" for c, t in L.DISCOVERY.items()))
    brand = L.brands(site, spark.createDataFrame([("a", "acme.com"), ("b", "b.org")], "audit_id string, host string"))
    return L.site_facts(site, discovery, brand, F.lit("2026-01-30").cast("timestamp"), **evidence).where("audit_id = 'a'")


def test_checks_of_a_site(spark, site):
    evidence = {
        "performance": spark.createDataFrame([("a", "field", 95.0, 2600.0, 0.05, None, 1.0)], "audit_id string, performance_source string, performance_score double, lcp_ms double, cls double, ttfb_ms double, mobile_score double"),
        "entity": spark.createDataFrame([("a", True, None)], "audit_id string, entity_checked boolean, qid string"), "authority": spark.createDataFrame([("a", 4.0)], "audit_id string, page_rank double"),
        "citations": spark.createDataFrame([("a", 1.85, 0.75)], "audit_id string, tier_weight double, tier7_weight double"), "gaps": spark.createDataFrame([("a", 14, 7)], "audit_id string, gaps bigint, gaps_answered bigint"),
        "overviews": spark.createDataFrame([("a", 6, 4, 2, 5)], "audit_id string, aio_checked bigint, aio_present bigint, aio_cites bigint, aio_domains bigint"),
    }
    found = C.evaluate(_facts(spark, site, **evidence))
    got = {r["check_id"]: (r["status"], round(r["score"], 4), r["confidence"]) for r in rows(found)}
    want = {
        "seo.index.https": ("pass", 1.0, 1.0), "seo.index.noindex": ("fail", 0.6667, 1.0), "seo.index.broken_pages": ("warn", 0.0, 1.0), "seo.index.canonical_tags": ("warn", 0.6, 1.0), "seo.onpage.title_duplicates": ("fail", 0.3333, 1.0),
        "seo.onpage.h1": ("warn", 0.9, 1.0), "seo.onpage.heading_hierarchy": ("warn", 0.6667, 1.0), "seo.onpage.image_alt": ("warn", 0.6667, 1.0), "seo.onpage.duplicate_content": ("not_applicable", 0.0, 0.0),
        "seo.perf.performance_score": ("pass", 0.95, 1.0), "seo.perf.lcp": ("warn", 0.8, 1.0), "seo.perf.ttfb": ("unavailable", 0.0, 0.0), "seo.schema.valid_jsonld": ("fail", 0.6667, 1.0), "aeo.answer.direct_answer_proximity": ("pass", 1.0, 1.0),
        "aeo.schema.faq": ("pass", 1.0, 1.0), "aeo.schema.answer_alignment": ("pass", 1.0, 0.75), "aeo.eeat.author_byline": ("fail", 0.0, 1.0), "aeo.eeat.freshness": ("pass", 1.0, 1.0), "aeo.coverage.question_gap": ("warn", 0.5, 1.0),
        "geo.entity.organization_schema": ("warn", 0.625, 1.0), "geo.entity.sameas": ("warn", 0.4, 1.0), "geo.entity.location": ("opportunity", 0.7, 1.0), "geo.citation.wikidata": ("opportunity", 0.0, 1.0), "geo.citation.domain_authority": ("warn", 0.4, 0.7),
        "geo.citation.third_party": ("warn", 0.3917, 1.0), "geo.machine.training_crawler_policy": ("not_applicable", 0.0, 0.0), "geo.machine.entity_graph": ("pass", 1.0, 1.0), "ai.mention.google_aio": ("pass", 0.5, 1.0), "ai.sov.share": ("unavailable", 0.0, 0.0),
    }
    assert {c: got[c] for c in want} == want
    assert len(got) == 79 and "ai.mention.rate" not in got


def test_what_is_not_measured_moves_no_score(spark, site):
    found = C.evaluate(_facts(spark, site)).cache()
    groups = {r["group"]: r for r in rows(S.group_scores(found))}
    assert groups["seo.perf"]["coverage"] == 0 and groups["seo.perf"]["score"] == 0 and 0 < groups["geo.machine"]["coverage"] < 1
    pillars = {r["pillar"]: r["score"] for r in rows(S.pillar_scores(S.group_scores(found)))}
    assert pillars["ai"] is None and pillars["seo"] is not None
    more = found.unionByName(found.where("check_id = 'seo.perf.lcp'").withColumns({"check_id": F.lit("x"), "weight": F.lit(0.0)}))
    assert rows(S.overall_scores(S.pillar_scores(S.group_scores(more)))) == rows(S.overall_scores(S.pillar_scores(S.group_scores(found))))
    missing = {r["group"] for r in rows(P.not_measured(found))}
    assert {"seo.perf", "ai.sov"} <= missing and "seo.index" not in missing
    composite = rows(S.composite_scores(S.pillar_scores(S.group_scores(found))))[0]
    assert not composite["ai_is_measured"] and composite["google_visibility"] == int(0.65 * pillars["seo"] + 0.35 * pillars["aeo"] + 0.5)


def test_overall_of_no_pillar_is_zero(spark):
    none = spark.createDataFrame([("a", "seo", 0.2, None)], "audit_id string, pillar string, coverage double, score bigint")
    assert [(r["overall"], r["band"]) for r in rows(S.overall_scores(none))] == [(0, "E")]


def test_the_catalogue_is_whole():
    assert len(C.CHECKS) == 81 and len({c.id for c in C.CHECKS}) == 81
    assert {p: sum(c.pillar == p for c in C.CHECKS) for p in ("seo", "aeo", "geo", "ai")} == {"seo": 34, "aeo": 18, "geo": 23, "ai": 6}
    named = {c for checks in P.TEMPLATES.values() for c in checks.split()}
    assert {c.id for c in C.CHECKS} - named == {"seo.index.redirect_chain", "seo.index.status_code", "seo.onpage.title_length", "geo.machine.training_crawler_policy"} and len(named) == 77


ROBOTS = "Disallow: /lost\n# all\nUser-agent: *\nDisallow: /\nAllow: /open\n\nUser-agent: GPTBot\nUser-agent: claudebot\nCrawl-delay: 2\nDisallow:\nSitemap: https://a.org/map.xml\nbroken line\nUser-agent: Bing\nDisallow: /*.pdf$\nDisallow: /private*\nAllow: /private/a\n"


def test_robots(spark):
    fetched = [("a", "https://a.org/robots.txt", 200, ROBOTS), ("b", "https://b.org/robots.txt", 404, ""), ("c", "https://c.org/robots.txt", 200, "<!doctype html>")]
    files = D.robots_files(spark.createDataFrame(fetched, "audit_id string, url string, status_code int, body string")).cache()
    assert {r["audit_id"]: (r["found"], r["html_instead"]) for r in rows(files)} == {"a": (True, False), "b": (False, False), "c": (False, True)}
    rules = D.robots_rules(files.where("found")).cache()
    got = [(r["user_agent"], r["allow"], r["disallow"], r["crawl_delay"]) for r in rows(rules.orderBy("ord"))]
    assert got == [("*", ["/open"], ["/"], None), ("gptbot", [], [""], 2.0), ("claudebot", [], [""], 2.0), ("bing", ["/private/a"], ["/*.pdf$", "/private*"], None)]
    assert D.robots_lines(files.where("found")).where("kind = 'error'").count() == 2
    verdict = {(r["audit_id"], r["agent"], r["path"]): (r["allowed"], r["matched_by"]) for r in rows(D.allowed(rules, files, ["GPTBot", "Other", "Bingbot"], ["/", "/open/x", "/a.pdf", "/private/a", "/private/b"]))}
    assert verdict["a", "GPTBot", "/"] == (True, "gptbot") and verdict["a", "Other", "/"] == (False, "*") and verdict["a", "Other", "/open/x"] == (True, "*")
    assert [verdict["a", "Bingbot", p][0] for p in ("/", "/a.pdf", "/private/a", "/private/b")] == [True, False, True, False]
    assert verdict["b", "Other", "/"] == (True, "no robots.txt")
    matrix = {r["agent"]: r["allowed"] for r in rows(D.crawler_matrix(rules, files).where("audit_id = 'a'"))}
    assert matrix["ClaudeBot"] and not matrix["PerplexityBot"] and len(matrix) == 10
    split = {r["audit_id"]: r for r in rows(D.purpose_split(D.crawler_matrix(rules, files)))}
    assert split["a"]["retrievers"] == 6 and split["a"]["retrievers_blocked"] == 6 and split["b"]["retrievers_blocked"] == 0
    assert [r["crawl_delay"] for r in rows(D.crawl_delays(rules, "GPTBot"))] == [2.0]


@pytest.mark.parametrize(("pattern", "path", "fits"), [("/a*b", "/axxb/c", True), ("/a$", "/ab", False), ("/a.b", "/axb", False), ("/*?", "/any", True), ("/(x)", "/(x)", True), ("?x", "/x", None)])
def test_robots_patterns(spark, pattern, path, fits):
    assert one(spark, F.rlike(F.lit(path), D.pattern_regex(F.lit(pattern)))) is fits


def test_discovery(spark):
    index = "<sitemapindex xmlns='x'><sitemap><loc>https://a.org/one.xml</loc></sitemap></sitemapindex>"
    part = "<urlset><url><loc> https://a.org/x?b=1&amp;a=2 </loc><lastmod>2025-01-02</lastmod></url><url><loc>https://a.org/y/</loc></url><url><loc>https://a.org/y</loc></url></urlset>"
    fetched = [
        ("a", "http://a.org/", "https://a.org/", 200, ["https://a.org/"], "<html>"), ("a", "https://a.org/robots.txt", "https://a.org/robots.txt", 200, [], "User-agent: *\nAllow: /\nSitemap: https://a.org/map.xml"),
        ("a", "https://a.org/map.xml", "https://a.org/map.xml", 200, [], index), ("a", "https://a.org/one.xml", "https://a.org/one.xml", 200, [], part), ("a", "https://www.a.org/", "https://www.a.org/", 200, [], ""),
        ("a", "https://a.org/", "https://a.org/", 200, [], ""), ("a", "https://a.org/llms.txt", "https://a.org/llms.txt", 200, [], "# hello"), ("a", "https://a.org/feed", "https://a.org/feed", 200, [], ""),
    ]
    f = spark.createDataFrame(fetched, "audit_id string, url string, final_url string, status_code int, redirect_chain array<string>, body string")
    found = rows(D.discover(spark.createDataFrame([("a", "http://a.org/"), ("z", "http://z.org/")], "audit_id string, url string"), f).orderBy("audit_id"))
    a, z = found
    assert (a["https"], a["home_status"], a["redirects"], a["one_host"], a["robots_found"], a["sitemaps_declared"], a["sitemap_found"], a["sitemap_lastmod"], a["sitemap_urls"], a["llms_found"], a["feeds"]) == (True, 200, 1, False, True, 1, True, True, 3, True, 1)
    assert (z["https"], z["home_status"], z["robots_found"], z["sitemap_found"], z["blanket_block"], z["retrievers_blocked"]) == (False, 0, False, False, False, 0)
    maps = rows(D.sitemaps(f, spark.createDataFrame([("a", 5, "https://a.org/map.xml")], "audit_id string, ord int, url string"), spark.createDataFrame([("a", "https://a.org")], "audit_id string, origin string")))[0]
    assert maps["sources"] == ["https://a.org/map.xml", "https://a.org/one.xml"] and maps["sample"] == ["https://a.org/x?a=2&b=1", "https://a.org/y"] and maps["freshest"] == "2025-01-02"


@pytest.mark.parametrize(
    ("typed", "url"),
    [(" acme.com ", "https://acme.com"), ("http://a.co/x", "http://a.co/x"), ("localhost:3000", None), ("nodots", None), ("", None), ("10.0.0.1", None), ("has space.com", None)],
)
def test_typed_addresses(spark, typed, url):
    assert one(spark, U.normalise_input(F.lit(typed))) == url


@pytest.mark.parametrize("url", ["https://A.org:443/x/?b=1&a=2&utm_x=1#f", "http://a.org:8080/", "http://a.org", "https://a.org/a//", "ftp://a.org/x", "https://a.org/?ref=1&refund=2"])
def test_both_forms_of_canonical_agree(spark, url):
    assert one(spark, U.canonical(F.lit(url))) == H.canonical(url)


def test_small_functions(spark):
    assert one(spark, T.fnv1a(F.lit("abc"))) == 440920331 and one(spark, U.same_site(F.lit("http://www.a.co.uk/x"), F.lit("https://b.a.co.uk"))) is True
    assert [one(spark, T.ordinal_suffix(F.lit(n))) for n in (1, 2, 3, 4, 11, 12, 13, 21, 112)] == ["st", "nd", "rd", "th", "th", "th", "th", "st", "th"]
    assert one(spark, T.plural(F.lit(1), "page")) == "1 page" and one(spark, T.plural(F.lit(2), "page")) == "2 pages"
    assert one(spark, T.brand_from_title(F.lit("Home - Acme Tools"))) == "Acme Tools" and one(spark, T.brand_from_title(F.lit("Home"))) is None and one(spark, T.host_to_brand(F.lit("www.my-iPhone_shop.com"))) == "My IPhone Shop"
    assert one(spark, T.json_of(F.lit('x ```json\n{"a": 1}\n``` y'))) == '{"a": 1}' and one(spark, T.json_of(F.lit("none"))) is None
    assert [one(spark, M.ramp(F.lit(v), 5000, 2000)) for v in (6000.0, 3500.0, 1000.0)] == [0.0, 0.5, 1.0] and one(spark, M.ratio(F.lit(1), F.lit(0))) == 0.0 and one(spark, M.clamp01(F.lit(float("nan")))) == 0.0
    assert one(spark, M.fixed(F.lit(1.005), 1)) == "1.0" and M.env_number("SITELENS_NOT_SET", 3.0) == 3.0 and round(one(spark, M.log_scaled(F.lit(100))), 6) == 0.666667
    assert len(one(spark, U.hashed_ip(F.lit("1.2.3.4"), "salt:"))) == 16 and one(spark, U.report_name(F.lit("www.A b.com"), F.lit("2025-03-04").cast("date"))) == "A-b.com-2025-03-04-visibility-report.pdf"
    assert one(spark, U.email_domain(F.lit("a@b@Mail.ORG "))) == "mail.org" and one(spark, T.printable(F.lit("“a” – ☃é"))) == '"a" - ?é'
    assert one(spark, L.parsed_date(F.lit("June 1, 2026"))) == datetime.datetime(2026, 6, 1) and one(spark, L.parsed_date(F.lit("soon"))) is None and one(spark, L.parsed_date(F.lit("Wed, 01 Jan 2025 10:00:00 GMT"))) == datetime.datetime(2025, 1, 1, 10)
    assert [one(spark, T.intent(F.lit(t))) for t in ("our pricing page", "a versus b", "how to do it", "hello", "reorders")] == ["transactional", "commercial", "informational", "navigational", "navigational"]


def test_mentions(spark):
    def seen(answer, rivals=("Beta", "Gamma"), cited=("blog.acme.com",)):
        array = lambda xs: F.array(*[F.lit(x) for x in xs]) if xs else F.array().cast("array<string>")
        return one(spark, T.mention(F.lit(answer), F.lit("Acme"), F.lit("www.acme.com"), array(rivals), array(cited))).asDict()

    assert seen("Beta is fine, but ACME is the best.") == {"brand_mentioned": True, "ordinal": 2, "cited_brand_domain": True, "competitors_mentioned": ["Beta"], "sentiment": "positive"}
    assert seen("Gamma only", cited=()) == {"brand_mentioned": False, "ordinal": None, "cited_brand_domain": False, "competitors_mentioned": ["Gamma"], "sentiment": None}
    assert seen("Acme: avoid, though popular")["sentiment"] == "neutral" and seen("Acme is expensive")["sentiment"] == "negative"


def test_evidence_tables(spark):
    hits = [("a", 0, "www.acme.com", "https://en.wikipedia.org/x"), ("a", 1, "www.acme.com", "https://de.wikipedia.org/y"), ("a", 2, "www.acme.com", "https://shop.acme.com"), ("a", 3, "www.acme.com", "https://news.ycombinator.com/z"), ("a", 4, "www.acme.com", "https://dir.net")]
    cited = E.citations(spark.createDataFrame(hits, "audit_id string, ord int, host string, url string"))
    assert sorted((r["site"], r["tier"], r["url"]) for r in rows(cited)) == [("dir.net", 7, "https://dir.net"), ("wikipedia.org", 1, "https://en.wikipedia.org/x"), ("ycombinator.com", 7, "https://news.ycombinator.com/z")]
    assert [(r["tier_weight"], r["tier7_weight"]) for r in rows(E.citation_weights(cited))] == [(1.0, 0.3)]
    seen = [("a", "acme.com", "Acme", (True, "x", ["www.acme.com", "o.org"])), ("a", "acme.com", "Acme", (True, "by acme", ["o.org"])), ("a", "acme.com", "Acme", (True, "", [])), ("a", "acme.com", "Acme", (False, "", [])), ("a", "acme.com", "Acme", None)]
    o = rows(E.overviews(spark.createDataFrame(seen, "audit_id string, host string, brand string, overview struct<present:boolean,text:string,cited_domains:array<string>>")))[0]
    assert (o["aio_checked"], o["aio_present"], o["aio_cites"], o["aio_domains"]) == (4, 3, 2, 2)
    calls = spark.createDataFrame([("a", i) for i in range(5)] + [("b", 0)], "audit_id string, i int")
    assert E.within_budget(calls, ["i"], 3).count() == 4
    reports = spark.createDataFrame([("a", 90.0, (2000.0, 10.0, 300.0), (2500.0, 0.2, 500.0), {"viewport": 1.0, "font-size": 0.0}), ("b", None, None, (2500.0, 0.2, 500.0), {})], "audit_id string, score double, field struct<lcp_ms:double,cls:double,ttfb_ms:double>, lab struct<lcp_ms:double,cls:double,ttfb_ms:double>, audits map<string,double>")
    perf = {r["audit_id"]: r for r in rows(E.performance(reports))}
    assert (perf["a"]["performance_source"], perf["a"]["cls"], perf["a"]["mobile_score"]) == ("field", 0.1, 0.5) and (perf["b"]["performance_source"], perf["b"]["cls"], perf["b"]["mobile_score"]) == ("lab", 0.2, None)
    targets = spark.createDataFrame([("a", "www.acme.com"), ("b", "b.org"), ("c", "c.org")], "audit_id string, host string")
    found = E.entities(targets, spark.createDataFrame([("a", 0, "Q1", ["http://x.org"], None), ("a", 1, "Q2", ["https://acme.com/"], "w"), ("b", 0, "Q3", [], None)], "audit_id string, ord int, qid string, websites array<string>, wikipedia_url string"))
    assert {r["audit_id"]: r["qid"] for r in rows(found)} == {"a": "Q2", "b": None}
    ranks = E.authorities(targets, spark.createDataFrame([("acme.com", 3.5)], "host string, page_rank double"))
    assert {r["audit_id"]: r["page_rank"] for r in rows(ranks)} == {"a": 3.5, "b": None, "c": None}


def test_question_gaps_by_brute_force(spark, site):
    brands = spark.createDataFrame([("a", "Acme", "A tool for careful people", None)], "audit_id string, name string, category string, top_term string")
    asked = E.template_questions(brands).cache()
    assert asked.count() == 14 and rows(asked.where("q_ord = 0"))[0]["question"] == "What is tool for careful people?"
    stop, token = set(T.STOPWORDS), re.compile(T.TOKEN)

    def terms(text):
        found = [re.sub("['’]s$", "", w) for w in token.findall(text.lower())]
        return [w for w in found if len(w) > 2 and w not in stop]

    pages = [r for r in rows(site.where("audit_id = 'a'").orderBy("page_ord")) if 200 <= r["status_code"] < 300]
    want = {}
    for q in rows(asked):
        t, best = terms(q["question"]), (None, -1.0)
        for p in pages if t else []:
            heads, body = set(terms(" ".join(h["text"] for h in p["headings"]))), set(terms(f"{p['title'] or ''} {p['excerpt']}"))
            exact = any(sum(x in terms(h["text"].lower()) for x in t) / len(t) >= 0.7 for h in p["question_headings"])
            score = 1.0 if exact else sum(x in heads for x in t) / len(t) * 0.7 + sum(x in body for x in t) / len(t) * 0.3
            best = (p["url"], score) if score > best[1] else best
        want[q["q_ord"]] = (best[1] >= 0.6, best[0] if best[1] >= 0.6 else None)
    gaps = E.question_gaps(asked, site).cache()
    assert {r["q_ord"]: (r["answered"], r["matched_url"]) for r in rows(gaps)} == want and any(a for a, _ in want.values())
    ranked = rows(E.ranked_gaps(gaps).orderBy("rank"))
    assert [(r["answered"], -r["value"], r["q_ord"]) for r in ranked] == sorted((r["answered"], -r["value"], r["q_ord"]) for r in ranked)
    assert [r["prompt"] for r in rows(E.prompts(brands, "uk").orderBy("p_ord"))][:2] == ["best A tool for careful people in UK", "top A tool for careful people companies in UK"]


def test_plan(spark):
    found = [("a", i, c, c.split(".")[0], c.rsplit(".", 1)[0], s, 0.0, 10.0, 1.0) for i, (c, s) in enumerate([("seo.onpage.h1", "fail"), ("seo.index.https", "opportunity"), ("geo.machine.llms_txt", "warn"), ("seo.onpage.title_length", "fail"), ("aeo.schema.faq", "warn"), ("seo.index.noindex", "fail"), ("x.y.z", "pass")])]
    ranked = S.rank_findings(spark.createDataFrame(found, "audit_id string, check_ord int, check_id string, pillar string, group string, status string, score double, weight double, confidence double")).cache()
    assert [r["check_id"] for r in rows(ranked.orderBy("rank"))][0] == "seo.index.noindex"
    plan = {r["check_id"]: r["horizon"] for r in rows(P.recommendations(ranked))}
    assert plan == {"seo.onpage.h1": "now", "seo.index.https": "30d", "geo.machine.llms_txt": "90d", "aeo.schema.faq": "30d", "seo.index.noindex": "now"}
    told = {r["check_id"]: r["severity"] for r in rows(P.translations(ranked))}
    assert told == {"seo.index.noindex": "critical", "aeo.schema.faq": "warning"}
    audits = [("a", None, 0, "own.com", "ok", 60, 50, 40, 50), ("c1", "a", 0, "one.com", "ok", 40, 50, 60, 50), ("c2", "a", 1, "two.com", "failed", None, None, None, None), ("c3", "a", 2, "three.com", "ok", 60, 70, 40, 50)]
    compared = P.comparison(spark.createDataFrame(audits, "audit_id string, parent_id string, ord int, host string, status string, seo int, aeo int, geo int, overall int"))
    said = [r["sentence"] for r in rows(P.insights(compared, spark.createDataFrame([("a", 14, 13)], "audit_id string, gaps int, gaps_answered int")).orderBy("place"))]
    assert said == ["one.com: ahead technically, behind as an entity", "three.com: behind in answers", "1 question unanswered"]
    assert P.chart_rows(compared).count() == 8 and [(r["ok"], r["failed"]) for r in rows(P.competitor_states(compared))] == [(2, 1)]
    items = spark.createDataFrame([([("count", "Pages", "3", "4", None, None, None), ("url", None, None, None, None, "http://x", None), ("list", "Types", None, None, None, None, ["a", "b"]), ("metric", "y", "1", None, "ms", None, None)],)], "e array<struct<kind:string,label:string,value:string,of:string,unit:string,url:string,values:array<string>>>")
    assert items.select(P.evidence_line(F.col("e"))).first()[0] == "Pages: 3 of 4; http://x; Types: a, b"


def test_leads_and_access(spark):
    given = [("a@acme.com", "www.acme.com", 40, 1000, 10.0, True, 1, True, True), ("b@gmail.com", "acme.com", 100, 0, None, False, 0, False, False)]
    got = rows(G.lead_scores(spark.createDataFrame(given, "email string, host string, overall int, pages_discovered bigint, page_rank double, has_entity boolean, top_citations int, has_competitors boolean, has_budget boolean")))
    assert [(r["lead_score"], r["grade"], r["is_free_email"], r["email_matches_domain"]) for r in got] == [(88, "A", False, True), (10, "D", True, False)]
    assert one(spark, G.is_admin(F.lit("A@x.org"), "a@x.org, b@x.org")) is True and one(spark, G.is_admin(F.lit("a@x.org"), "")) is False and one(spark, G.may_set_up_schema(F.lit("z@z.z"), "", False)) is True
    asked = [("acme.com", "uk", []), ("x", "uk", []), ("acme.com", "moon", []), ("acme.com", "us", ["a"] * 4), ("localhost", "us", [])]
    bad = rows(G.invalid_requests(spark.createDataFrame(asked, "url string, market string, competitors array<string>")))
    assert [r["reason"] for r in bad] == ["url is too short", "unknown market", "more than three competitors", "url is no public address"]


def test_store(spark, tmp_path):
    store = B.Store(spark, str(tmp_path / "store"))
    assert len(store.create()) == 17 and store.create() == [] and store.table_count() == 17
    store.append("leads", spark.createDataFrame([("1", "new", "A"), ("2", "new", "B")], "id string, status string, grade string"))
    store.update("leads", "id", spark.createDataFrame([("2", "won")], "id string, status string"))
    assert sorted((r["id"], r["status"], r["grade"]) for r in rows(store.latest("leads", "id"))) == [("1", "new", "A"), ("2", "won", "B")]
    with pytest.raises(ValueError, match="may not have"):
        store.append("leads", spark.createDataFrame([("3", "odd")], "id string, status string"))
    seen = B.upsert_users(spark.createDataFrame([("A@x.org", "old", 1)], "email string, name string, at int"), spark.createDataFrame([("a@x.org ", "new", 5)], "email string, name string, at int"))
    assert [tuple(r) for r in seen.collect()] == [("a@x.org", "new", 1, 5)]
    assert B.as_json(spark.createDataFrame([(1, None)], "a int, b int")).first().json == '{"a":1}' and B.deny_by_default(seen, "email", None).count() == 0
    audits = spark.createDataFrame([(str(i), "h" if i % 2 else "g", "complete" if i < 8 else "failed", i) for i in range(10)], "id string, host string, status string, created_at int")
    assert [r["id"] for r in rows(B.completed_for_host(audits, "h", 2))] == ["7", "5"] and [r["id"] for r in rows(B.newest(audits, 1))] == ["9"]


def test_fetch_tables(spark, tmp_path):
    (tmp_path / "blog").mkdir()
    (tmp_path / "index.html").write_text("<p>home")
    (tmp_path / "blog" / "a.html").write_bytes(b"<p>" + b"x" * 50 + b"\xff")
    got = {r["url"]: r for r in rows(X.saved_pages(spark, str(tmp_path), "a", "https://a.org", 20))}
    assert set(got) == {"https://a.org/", "https://a.org/blog/a.html"} and got["https://a.org/blog/a.html"]["truncated"] and got["https://a.org/"]["depth"] == 0 and got["https://a.org/blog/a.html"]["bytes"] == 20
    hops = spark.createDataFrame([("u", "v"), ("v", "w"), ("l", "l")], "url string, location string")
    chains = {r["url"]: (r["final_url"], len(r["redirect_chain"]), r["error"]) for r in rows(X.followed(spark.createDataFrame([("u",), ("z",), ("l",)], "url string"), hops))}
    assert chains == {"u": ("w", 2, None), "z": ("z", 0, None), "l": ("l", 11, "too many redirects")}
    (tmp_path / "answers.txt").write_text('{"a": 1}\nnot json\n')
    assert sorted((r["ok"], r["error"]) for r in rows(X.answers(spark, str(tmp_path / "answers.txt"), "a int"))) == [(False, "not json"), (True, None)]


def test_crawl_by_brute_force(spark):
    graph = {"/": ["/a", "/b", "/c", "/no"], "/a": ["/a/1", "/b", "/"], "/b": ["/b/1", "/b/2"], "/c": [], "/a/1": ["/a/1/2"], "/b/1": ["/deep"], "/no": ["/x"], "/s/1": ["/a"], "/t/1": []}
    base = "https://a.org"
    links = [("a", base + u, i, base + v) for u, vs in graph.items() for i, v in enumerate(vs)]
    sitemap = [("a", i, base + u) for i, u in enumerate(["/s/1", "/s/2", "/t/1", "/a"])]
    files = D.robots_files(spark.createDataFrame([("a", base + "/robots.txt", 200, "User-agent: *\nDisallow: /no")], "audit_id string, url string, status_code int, body string"))
    crawled = K.crawl(spark.createDataFrame([("a", base + "/")], "audit_id string, url string"), spark.createDataFrame(links, "audit_id string, url string, link_ord int, link string"), D.robots_rules(files), files, spark.createDataFrame(sitemap, "audit_id string, ord int, url string"), "any", pages=7, batch=2)
    got = {r["url"].removeprefix(base): (r["state"], r["place"]) for r in rows(crawled)}
    # The same by a queue, one site, as written down in the docstring.
    order, queue, seen, pages, blocked, n = [], [("/", 0, 0, 0)], {"/"}, [], [], 0
    for u in ["/s/1", "/t/1", "/a", "/s/2"]:
        queue.append((u, u.count("/"), 1, n := n + 1))
        seen.add(u)
    while queue and len(pages) < 7:
        queue.sort(key=lambda q: (q[2], q[1], q[3]))
        now, queue = queue[: min(2, 7 - len(pages))], queue[min(2, 7 - len(pages)) :]
        for u, d, _, _ in now:
            if u == "/no":
                blocked.append(u)
                continue
            pages.append(u)
            for v in graph.get(u, []) if d < 4 else []:
                if v not in seen:
                    seen.add(v)
                    if len(pages) + len(queue) < 21:
                        queue.append((v, d + 1, 0, n := n + 100))
    want = {u: ("fetched", i + 1) for i, u in enumerate(pages)} | {u: ("blocked", None) for u in blocked} | {q[0]: ("queued", None) for q in queue}
    assert got == want
    assert K.not_visited(crawled, spark.createDataFrame(links, "audit_id string, url string, link_ord int, link string")).count() == len({v for vs in graph.values() for v in vs} - set(pages))


def test_stages_and_limits(spark):
    stages = spark.createDataFrame([("a", "crawl", "done", 1), ("a", "score", "running", 2), ("a", "crawl", "running", 0)], "audit_id string, stage string, status string, at int")
    newest = B.latest(stages, ["audit_id", "stage"], ["at"])
    assert [(r["share"], r["running"]) for r in rows(limits.progress(newest, ["crawl", "score"]))] == [(0.5, "score")]
    calls = spark.createDataFrame([(i, "ip", "k", datetime.datetime(2026, 1, 1, 0, i * 20)) for i in range(3)] + [(9, "ip", "k", datetime.datetime(2026, 1, 1, 1, 0))], "event_id int, scope string, key string, ts timestamp")
    assert [r["allowed"] for r in rows(limits.charged(calls, "scope", "key", 3600, 2).orderBy("ts"))] == [True, True, False, True]
    assert not any(r["allowed"] for r in rows(limits.charged(calls, "scope", "key", 3600, 0)))
