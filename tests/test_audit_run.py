"""A whole audit of several sites: refusals, competitors, evidence, and going on after a crash between stages."""

import json
import re
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from sitelens.operators import leads as G
from sitelens.operators import scoring as S
from sitelens.plans import runner
from sitelens.sources import pdf
from sitelens.sources.stages import Stages

AS_OF = "2026-01-01"
ORG = '{"@context":"https://schema.org","@graph":[{"@type":"Organization","@id":"#o","name":"Acme","legalName":"Acme Ltd","url":"https://acme.com","logo":"l","description":"Acme makes careful tools for people who build houses.","sameAs":["a","b","c","d","e"],"address":{"@type":"PostalAddress"},"areaServed":"x","founder":"f"},{"@type":"Person","name":"Jane Doe"},{"@type":"BreadcrumbList"}]}'
FAQ = '{"@type":"FAQPage","@id":"#f","mainEntity":[{"@type":"Question","name":"What is a careful tool?","acceptedAnswer":{"text":"A careful tool is a thing that helps people to build houses without fear."}}]}'
PARAGRAPH = "<p>Acme tools cut the time to build a house by 40 percent in 2025, as a study of 1,200 builders shows. A careful tool is a device that protects its owner. Builders who measure twice with our tools save money on every house they build.</p>"


def good(n, title):
    links = "".join(f'<a href="/p{i}">Page {i} about tools</a>' for i in range(24))
    return (
        f'<!doctype html><html lang="en"><head><title>{title} for careful builders | Acme</title><meta name="description" content="Acme page {n} tells builders what careful tools do and what they cost."><link rel="canonical" href="">'
        f'<meta property="og:site_name" content="Acme"><meta name="author" content="Jane Doe"><meta property="article:modified_time" content="2025-12-0{n % 9 + 1}"><script type="application/ld+json">{ORG}</script><script type="application/ld+json">{FAQ}</script></head>'
        f"<body><nav>{links}</nav><main><article><h1>{title} that careful builders trust</h1><h2>What is a careful tool?</h2><p>A careful tool is a thing that helps people to build houses without fear.</p>{PARAGRAPH * 6}"
        f'<h2>How much does it cost?</h2><p>It costs less than a house and more than a hammer, and lasts a life.</p><ul><li>one<li>two</ul><ol><li>a</ol><table><tr><td>b</table><blockquote>Good tools.</blockquote><img src="a" alt="A tool"><a href="https://source{n}.org/x">A source of numbers</a> unique words of page {n} {title} {"w%d " % n * 300}</article></main></body></html>'
    )


POOR = "<html><body><div>hello</div><img src=a></body></html>"
WALL = "<title>Just a moment</title><script src='/cdn-cgi/challenge-platform/x'></script>"


@pytest.fixture(scope="module")
def inputs(spark):
    rows = []

    def site(audit, host, pages, extra=()):
        for n, (path, body) in enumerate(pages):
            rows.append((audit, n, f"https://{host}{path}", f"https://{host}{path}", 0 if path == "/" else 1, 200, "text/html", None, [], body))
        for path, status, body in extra:
            rows.append((audit, None, f"https://{host}{path}", f"https://{host}{path}", None, status, "text/plain", None, [], body))

    names = ["/", "/about", "/contact", "/team", "/blog/one", "/pricing", "/compare/others", "/research/report"]
    extra = [("/robots.txt", 200, "User-agent: *\nAllow: /\nSitemap: https://acme.com/sitemap.xml"), ("/sitemap.xml", 200, "<urlset><url><loc>https://acme.com/</loc><lastmod>2025-12-01</lastmod></url></urlset>"), ("/feed", 200, "<rss/>"), ("/llms.txt", 200, "# Acme")]
    site("good", "acme.com", [(p, good(n, f"Tools {n}")) for n, p in enumerate(names)] + [(f"/p{i}", good(9 + i, f"Page {i}")) for i in range(30)], extra)
    site("poor", "poor.net", [("/", POOR), ("/x", POOR), ("/y", POOR)], [("/robots.txt", 200, "User-agent:\t*\nDisallow:\t/\n")])
    site("wall", "wall.org", [("/", WALL)])
    site("good#1", "rival.com", [("/", POOR)])
    site("good#2", "fence.com", [("/", WALL)])
    rows.append(("down", 0, "https://down.org/", "https://down.org/", 0, 0, None, "timeout", [], None))
    asked = [("good", "acme.com", "us", ["rival.com", "https://fence.com", "no address"]), ("poor", "poor.net", None, None), ("wall", "wall.org", "uk", []), ("down", "down.org", "global", None), ("odd", "x", "us", None)]
    made = {
        "requests": (asked, "audit_id string, url string, market string, competitors array<string>"),
        "fetches": (rows, "audit_id string, page_ord bigint, url string, final_url string, depth int, status_code int, content_type string, error string, redirect_chain array<string>, body string"),
        "speed": ([("good", 95, (1800.0, 2.0, 300.0), None, {"viewport": 1.0})], "audit_id string, score int, field struct<lcp_ms:double,cls:double,ttfb_ms:double>, lab struct<lcp_ms:double,cls:double,ttfb_ms:double>, audits map<string,double>"),
        "ranks": ([("acme.com", 5.5), ("poor.net", 0.5)], "host string, page_rank double"),
        "hits": ([("good", 1, "https://en.wikipedia.org/wiki/Acme"), ("good", 2, "https://www.g2.com/acme"), ("poor", 1, "https://poor.net/")], "audit_id string, ord int, url string"),
        "answers": ([("good", "one", "best tools", i, "Acme is a reliable choice, before Rival." if i else "Rival.", ["acme.com"]) for i in range(4)], "audit_id string, engine string, prompt string, sample_index int, answer string, cited_domains array<string>"),
        "rewrites": ([("poor", "geo.machine.ai_crawler_access", "Open the door to crawlers.")], "audit_id string, check_id string, text string"),
    }
    return {name: spark.createDataFrame(data, schema) for name, (data, schema) in made.items()}


@pytest.fixture(scope="module")
def done(spark, inputs, tmp_path_factory):
    """The audit, ended once by an error between its stages and then taken up again."""
    root = f"file://{tmp_path_factory.mktemp('audit')}"
    steps = runner.stages(AS_OF)
    broken = [(name, (lambda t: (_ for _ in ()).throw(RuntimeError("lost driver"))) if name == "brands" else f) for name, f in steps]
    with pytest.raises(RuntimeError, match="lost driver"):
        Stages(spark, root).run(broken, inputs)
    job = Stages(spark, root)
    before = {name: job.published(name) for name, _ in steps}
    assert [name for name, m in before.items() if m] == ["requests", "discovery", "crawl", "refusals"]
    events = [(r.stage, r.status) for r in job.events([n for n, _ in steps]).orderBy("ord").collect()]
    assert events[3:5] == [("refusals", "done"), ("brands", "waiting")]
    out = runner.audit(spark, root, inputs, AS_OF)
    # What was done before the crash was read, not made again.
    assert all(job.published(name) == m for name, m in before.items() if m) and all(job.published(name) for name, _ in steps)
    folders = {p.name for p in Path(root.removeprefix("file://")).iterdir() if p.is_dir()}
    assert folders == {job.published(name)["folder"] for name, _ in steps}
    return out


def by(df, *keys):
    return {tuple(r[k] for k in keys) if len(keys) > 1 else r[keys[0]]: r for r in df.collect()}


def test_requests_and_refusals(done):
    assert {r.audit_id: r.reason for r in done["rejected"].collect()} == {"odd": "url is too short"}
    gone = by(done["refused"], "audit_id")
    assert set(gone) == {"wall", "down", "good#2", "good#3"} and gone["wall"].vendor == "Cloudflare" and "behind Cloudflare" in gone["wall"].reason
    assert gone["down"].reason == "down.org did not answer." and "no public address" in gone["good#3"].reason
    assert set(by(done["overall"], "audit_id")) == {"good", "poor", "good#1"}
    assert by(done["targets"], "audit_id")["wall"].region.gl == "gb" and by(done["targets"], "audit_id")["good#1"].region.gl == "us"


def test_the_good_site_is_well_above_the_poor_one(done):
    overall = by(done["overall"], "audit_id")
    assert overall["good"].overall >= overall["poor"].overall + 20
    assert overall["good"].mode == "A" and overall["poor"].mode == "C" and "left out" in overall["poor"].note
    assert abs(sum(overall["good"].weights.values()) - 1) < 1e-9 and overall["poor"].weights["ai"] == 0
    assert done["signals"].where("audit_id = 'good'").count() == runner.PAGES


def test_findings_have_evidence(done):
    found = by(done["findings"], "audit_id", "check_id")
    robots = found["poor", "seo.index.robots_txt"]
    assert robots.status == "fail" and "shuts out" in robots.summary
    assert found["poor", "geo.machine.ai_crawler_access"].status == "fail" and found["poor", "geo.machine.ai_crawler_access"].evidence[0].value.startswith("shut out by *")
    assert found["poor", "seo.onpage.title_present"].affected_urls == ["https://poor.net/", "https://poor.net/x", "https://poor.net/y"]
    assert len(found["good", "seo.onpage.duplicate_content"].affected_urls) <= 20
    org = {e.label: e["values"] for e in found["good", "geo.entity.organization_schema"].evidence}
    assert "sameAs" in org["Present"] and "foundingDate" in org["Missing"]
    assert found["good", "geo.citation.third_party"].evidence[0].url == "https://en.wikipedia.org/wiki/Acme" and found["poor", "geo.citation.third_party"].status == "fail"
    assert found["good", "ai.mention.rate"].summary.startswith("3 of 4") and found["poor", "ai.mention.rate"].status == "unavailable" and not found["poor", "ai.mention.rate"].evidence
    assert found["good#1", "geo.citation.third_party"].status == "unavailable" and found["good", "aeo.coverage.question_gap"].status != "unavailable"


def test_competitors_and_words(done):
    rivals = by(done["competitors"], "audit_id", "ord")
    assert {k: (r.status, r.host) for k, r in rivals.items()} == {("good", 1): ("ok", "rival.com"), ("good", 2): ("failed", "fence.com"), ("good", 3): ("failed", "no address")}
    assert rivals["good", 1].overall < rivals["good", 1].own_overall and "Cloudflare" in rivals["good", 2].reason
    assert any("ahead" in r.sentence for r in done["insights"].where("audit_id = 'good'").collect())
    told = by(done["translations"].where("audit_id = 'poor'"), "check_id")
    assert len(told) == 5 and told["geo.machine.ai_crawler_access"].business == "Open the door to crawlers."
    results = {r.audit_id: json.loads(r.result) for r in done["results"].collect()}
    assert set(results) == {"good", "poor"} and len(results["good"]["findings"]) == 79 and results["poor"]["recommendations"]


def test_weights_and_regions(spark):
    p = spark.createDataFrame([("a", "seo", 1.0, 50), ("a", "aeo", 1.0, 60), ("a", "geo", 0.2, None), ("b", "seo", 0.0, None)], "audit_id string, pillar string, coverage double, score int")
    w = by(S.applied_weights(p), "audit_id")
    assert abs(w["a"].weights["seo"] - 0.3 / 0.55) < 1e-12 and w["a"].weights["geo"] == 0 and set(w["b"].weights.values()) == {0.0}
    regions = spark.createDataFrame([("uk",), ("global",), ("ae",), (None,), ("mars",)], "m string").select(G.search_region(F.col("m")).alias("r")).collect()
    assert [(r.r.gl, r.r.hl) for r in regions] == [("gb", "en"), ("us", "en"), ("ae", "en"), ("us", "en"), ("us", "en")]


def read_pdf(data):
    """Text of a PDF by its own table of objects."""
    start = int(re.search(rb"startxref\n(\d+)\n%%EOF\n$", data).group(1))
    places = [int(x) for x in re.findall(rb"(\d{10}) 00000 n \n", data[start:])]
    assert all(data[p:].startswith(b"%d 0 obj\n" % n) for n, p in enumerate(places, 1))
    body = lambda n: data[places[n - 1] :].split(b"endobj", 1)[0]
    kids = [int(x) for x in re.findall(rb"(\d+) 0 R", re.search(rb"/Kids \[(.*?)\]", body(2)).group(1))]
    out = []
    for k in kids:
        content = body(int(re.search(rb"/Contents (\d+) 0 R", body(k)).group(1)))
        size, stream = int(re.search(rb"/Length (\d+)", content).group(1)), content.split(b"stream\n", 1)[1]
        assert stream[size:].startswith(b"endstream")
        for bold, points, x, y, text in re.findall(rb"BT /F(\d) ([\d.]+) Tf ([\d.]+) ([\d.]+) Td \((.*)\) Tj ET\n", stream[:size]):
            line = re.sub(rb"\\(.)", rb"\1", text).decode("latin-1")
            assert float(y) >= pdf.MARGIN - 12 and float(x) + pdf.width(line, float(points), bold == b"2") <= pdf.PAGE[0] - pdf.MARGIN + 1
            out.append(line)
    return " ".join(out), len(kids)


def test_reports_can_be_read(done):
    files = by(done["reports"], "audit_id")
    assert set(files) == {"good", "poor"} and files["good"].name == "acme.com-2026-01-01-visibility-report.pdf"
    for audit, row in files.items():
        text, n = read_pdf(bytes(row.pdf))
        flat = "".join(text.split())
        assert n == row.pages > 1
        for f in done["findings"].where(F.col("audit_id") == audit).collect():
            assert "".join(f"{f.title}: {f.status}".split()) in flat and "".join(f.summary.split()) in flat
    assert "rival.com" in read_pdf(bytes(files["good"].pdf))[0]


def test_long_words_and_odd_characters():
    data = pdf.document([("title", "A (b) \\ c"), ("text", "x" * 4000), ("text", ""), ("note", "ÿ \u4e00 end")] + [("head", f"head {i}") for i in range(200)])
    text, n = read_pdf(data)
    assert n > 2 and "A (b) \\ c" in text and text.count("x") == 4000 and "? end" in text
