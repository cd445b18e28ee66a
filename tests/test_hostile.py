"""Pages, addresses and robots files that are not as they should be, and calls of a stream."""

import datetime
import time

import pytest
from pyspark.sql import functions as F

from sitelens.functions import addresses as A
from sitelens.functions import text as T
from sitelens.functions import urls as U
from sitelens.operators import discovery as D
from sitelens.operators import html as H
from sitelens.operators import site as L
from sitelens.streaming import limits

#: Address, host, path and canonical form as browsers read them.
READ = (
    ("https://a.org/a b", "a.org", "/a%20b", "https://a.org/a%20b"), ("https://a.org/a|b?x={1}", "a.org", "/a|b", "https://a.org/a|b?x=%7B1%7D"), ("https://a.org/x?q=a|b", "a.org", "/x", "https://a.org/x?q=a%7Cb"),
    ("https://a.org/%zz", "a.org", "/%zz", "https://a.org/%zz"), ("https://my_site.example.com/x", "my_site.example.com", "/x", "https://my_site.example.com/x"), ("https://münchen.de/x", "xn--mnchen-3ya.de", "/x", "https://xn--mnchen-3ya.de/x"),
    ("http://[abc/", "", "", None), ("  HTTP:\\\\Ex.com\\a\\..\\b/./c/ ", "ex.com", "/b/c/", "http://ex.com/b/c"), ("https:a.com", "a.com", "/", "https://a.com/"), ("https://user:pw@a.com:0443/x//", "a.com", "/x//", "https://user:pw@a.com/x"),
    ("https://a.com:99999/", "", "", None), ("https://a.com:8080", "a.com", "/", "https://a.com:8080/"), ("https://bücher.例え.テスト/ü?ü=é&a=1&B=2&utm_x=3&b=1+2", "xn--bcher-kva.xn--r8jz45g.xn--zckzah", "/%C3%BC", "https://xn--bcher-kva.xn--r8jz45g.xn--zckzah/%C3%BC?a=1&b=1+2&B=2&%C3%BC=%C3%A9"),
    ("https://1.2.3.4/", "1.2.3.4", "/", "https://1.2.3.4/"), ("https://0x7f.1/", "", "", None), ("http://[::1]:80/x", "[::1]", "/x", "http://[::1]/x"), ("https://a.com/?b&a=&&=c", "a.com", "/", "https://a.com/?=c&a=&b="),
    ("https://a.com/%2e%2E/b/..", "a.com", "/", "https://a.com/"), ("javascript:alert(1)", "", "", None), ("", "", "", None), ("https://faß.de/", "xn--fa-hia.de", "/", "https://xn--fa-hia.de/"), ("https://ab c.de/", "", "", None), ("https://a%41.com/", "aa.com", "/", "https://aa.com/"),
    ("https://a.com/?x_1=1&x-1=2&x1=3&X=4&x=5", "a.com", "/", "https://a.com/?x=5&X=4&x_1=1&x-1=2&x1=3"), ("https://☃.net/", "xn--n3h.net", "/", "https://xn--n3h.net/"), ("https://a.com/x?y=%E4%zz%20~*", "a.com", "/x", "https://a.com/x?y=%EF%BF%BD%25zz+%7E*"),
    ("https://a.com/a\tb\n", "a.com", "/ab", "https://a.com/ab"), (None, "", "", None),
)


def test_addresses_as_browsers_read_them(spark):
    df = spark.createDataFrame([(u,) for u, *_ in READ], "u string")
    got = df.select("u", U.host(F.col("u")).alias("h"), U.path(F.col("u")).alias("p"), U.canonical(F.col("u")).alias("c")).collect()
    assert [tuple(r) for r in got] == list(READ)
    assert [A.canonical(u) for u, *_ in READ if u is not None] == [c for u, _, _, c in READ if u is not None]


def test_links_against_their_page():
    base = "https://a.org/x/y?q=1"
    assert [A.canonical(x, base) for x in ("z", "/z", "//b.org/z", "?r=2", "../../z", "#t", "mailto:a@b.c", "http://[x/", "\\z")] == [
        "https://a.org/x/z", "https://a.org/z", "https://b.org/z", "https://a.org/x/y?r=2", "https://a.org/z", "https://a.org/x/y?q=1", None, None, "https://a.org/z",
    ]


def test_white_space_of_any_kind(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    assert one(T.is_question(F.lit("Really now?\n"))) and one(T.is_question(F.lit("\u00a0Really now?\t")))
    body = "User-agent:\tGPTBot\t\r\n\tDisallow:\t/private\r\n"
    fetched = [("a", "https://a.org/robots.txt", 200, body), ("a", "http://a.org/robots.txt", 200, "User-agent: *\nDisallow: /"), ("a", "https://www.a.org/robots.txt", 404, "")]
    df = spark.createDataFrame(fetched, "audit_id string, url string, status_code int, body string")
    files = D.robots_files(df, spark.createDataFrame([("a", "https://a.org")], "audit_id string, origin string"))
    assert files.count() == 1
    got = {r.path: (r.allowed, r.matched_by) for r in D.allowed(D.robots_rules(files.where("found")), files, ["GPTBot"], ["/", "/private/x"]).collect()}
    assert got == {"/": (True, "gptbot"), "/private/x": (False, "gptbot")}


BAD = [
    "<a href='http://[abc/'>x</a>", '<script type="application/ld+json">' + "[" * 100_000 + "</script>", '<script type="application/ld+json">{"@type":"X\\udc00","name":"\\ud83d","acceptedAnswer":{"text":"\\ud83d"}}</script>',
    '<script type="application/ld+json">{"a":NaN}</script>', "<![foo[x", "<!", "<p" * 1000, "\x00<p>\x00", "<table><p><td>" * 500, "</div>" * 1000, None, "",
]


def test_one_bad_page_does_not_fail_the_others(spark):
    rows = [("a", i if i % 3 else None, "https://a.org/", "http://[abc/" if i == 4 else "https://a.org/", 0 if i % 2 else None, 200, "text/html", None, h) for i, h in enumerate(BAD)] + [("a", 2**60 + 1, "https://a.org/z", "https://a.org/z", 1, 200, "text/html", None, "<h1>ok</h1>")]
    df = spark.createDataFrame(rows, "audit_id string, page_ord bigint, url string, final_url string, depth int, status_code int, content_type string, error string, html string")
    got = H.page_signals(df).select("page_ord", "h1_count", "json_ld_parse_errors", "json_ld_types").collect()
    assert len(got) == len(rows) and any(r.page_ord == 2**60 + 1 and r.h1_count == 1 for r in got)
    assert sorted(r.json_ld_parse_errors for r in got)[-2:] == [1, 1] and ["X\ufffd"] in [r.json_ld_types for r in got]


@pytest.mark.parametrize("html", ["".join(f"<h2>What is {i}?</h2>" for i in range(4000)), "<div>" * 20_000 + "x", "<p><button>" + "<div>" * 20_000, '<a href="/x">aaaaaa' * 20_000, "<table><td><p>abc def" * 20_000])
def test_a_page_costs_what_it_is_long(html):
    start = time.process_time()
    H.parse(html, "https://a.org/")
    assert time.process_time() - start < 6


def test_near_duplicates_with_one_paragraph_on_all_pages(spark):
    n = 2000
    pages = [("a", i, sorted({*range(60), *range(1000 + 100 * i, 1050 + 100 * i)})) for i in range(n)] + [("a", n + k, list(range(900_000, 900_100 + k % 3))) for k in range(6)] + [("b", 0, list(range(50))), ("b", 1, list(range(39)))]
    df = spark.createDataFrame(pages, "audit_id string, page_ord bigint, shingles array<bigint>")
    classes, pairs = L.near_duplicate_classes(df)
    assert pairs.count() == 3 and classes.where("n > 1").count() == 3
    found = {(r.a, r.b): round(r.similarity, 6) for r in L.near_duplicate_pages(df).collect()}
    assert len(found) == 15 and found[n, n + 3] == 1.0 and found[n, n + 1] == round(100 / 101, 6)
    assert [(r.audit_id, r.alike) for r in L.near_duplicate_counts(df).collect()] == [("a", 15)]


def test_calls_of_a_stream_and_their_state(spark, tmp_path):
    at = datetime.datetime(2025, 1, 1, 10, 50, tzinfo=datetime.UTC)
    minutes = [[0, 5, 20, 30], [25, 62, 70, 71], [300], [600]]  # a late call, a new window, and calls that move the watermark
    schema = "event_id bigint, user_id bigint, event_type string, ts timestamp"
    for k, batch in enumerate(minutes):
        spark.createDataFrame([(100 * k + i, 1 if m < 200 else 2, "x", at + datetime.timedelta(minutes=m)) for i, m in enumerate(batch)], schema).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
        time.sleep(0.05)
    got = {}
    for aligned in (True, False):
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
        with limits.many_states(spark):
            query = limits.answered(stream, "event_type", "user_id", "event_id", 3600, 2, aligned).writeStream.format("memory").queryName(f"calls_{aligned}").option("checkpointLocation", f"{tmp_path}/state-{aligned}").trigger(availableNow=True).start()
            query.awaitTermination()
        got[aligned] = {r.call: (r.window_us // 60_000_000 - int(at.timestamp()) // 60, r.allowed) for r in spark.table(f"calls_{aligned}").collect()}
        states = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
        assert max(states) <= 6 and states[-1] <= 3
    assert got[True] == {0: (-50, True), 1: (-50, True), 2: (10, True), 3: (10, True), 100: (10, False), 101: (10, False), 102: (70, True), 103: (70, True), 200: (250, True), 300: (550, True)}
    assert got[False] == {0: (0, True), 1: (0, True), 2: (0, False), 3: (0, False), 100: (0, False), 101: (62, True), 102: (62, True), 103: (62, False), 200: (300, True), 300: (600, True)}
