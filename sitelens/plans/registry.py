"""Queries on the driver's tables and the SQL they are compared with."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sitelens.functions import text as T
from sitelens.functions import urls as U
from sitelens.llm.common import Scratch
from sitelens.operators import crawl as K
from sitelens.operators import discovery as D
from sitelens.operators import evidence as E
from sitelens.operators import leads as G
from sitelens.operators import site as L
from sitelens.plans import audit
from sitelens.plans import observed as O
from sitelens.plans import sql as Q
from sitelens.sources.tables import stored
from sitelens.streaming.limits import charged, stream_calls, stream_latest_stage, stream_rate_limit

_TOK, _CONTENT, _SENT, _q = Q.TOK, Q.CONTENT, Q.SENT, Q.quoted
_HOST_SQL, _PATH_SQL = Q.HOST, Q.PATH
_APEX = f"regexp_replace({_HOST_SQL}, '^www\\.', '')"
_REG_SQL = Q.registrable(_HOST_SQL)
_TITLE = r"(?is)<title[^>]*>(.*?)</title>"
_TITLE_SQL = r"nullif(trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)), '')"


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _select(spark: SparkSession, sf_dir: str, table: str, key: str, **columns) -> DataFrame:
    return _read(spark, sf_dir, table).select(key, *[c.alias(n) for n, c in columns.items()])


def _title():
    return F.nullif(F.trim(F.regexp_extract("html", _TITLE, 1)), F.lit(""))


def _pages(spark, d):
    return _read(spark, d, "pages").select("page_id", "url", "html", U.registrable(U.host(F.col("url"))).alias("site"), _title().alias("title"))


_PAGES_SQL = f"SELECT page_id, url, html, {_REG_SQL} AS site, {_TITLE_SQL} AS title FROM pages"


def _conv_answers(spark, d):
    turn = Window.partitionBy("conv_id").orderBy("turn")
    rows = _read(spark, d, "conversations").withColumn("answer", F.lead("text").over(turn)).withColumn("by", F.lead("role").over(turn))
    return rows.where("role = 'user'").select("conv_id", "turn", T.is_question(F.col("text")).alias("is_question"), (F.coalesce(F.col("by") == "assistant", F.lit(False)) & T.qualifies_as_answer(F.col("answer"))).alias("qualifies"))


def _rate_limit(spark, d):
    window = F.date_trunc("hour", F.col("ts"))
    hits = _read(spark, d, "events").groupBy("user_id", window.alias("window_start")).agg(F.count("*").alias("hits"))
    return hits.withColumn("allowed", F.least("hits", F.lit(3).cast("bigint"))).select("user_id", F.unix_seconds(F.col("window_start").cast("timestamp")).alias("window_s"), "hits", "allowed")


def _latest(spark, d):
    newest = F.max_by("event_id", F.struct("ts", "event_id"))
    return _read(spark, d, "events").groupBy("user_id", "event_type").agg(newest.alias("event_id"), F.count("*").alias("n"))


def _duplicate_titles(spark, d):
    key = _pages(spark, d).where("title is not null").groupBy("site", F.lower("title").alias("key")).count()
    return key.groupBy("site").agg(F.sum(F.when(F.col("count") > 1, F.col("count")).otherwise(0)).alias("duplicates"), F.count("*").alias("titles"))


def _url_sample(spark, d):
    p = _read(spark, d, "pages").select("page_id", U.registrable(U.host(F.col("url"))).alias("site"), F.regexp_extract(U.path(F.col("url")), "^/([^/]*)", 1).alias("prefix"))
    turn = p.withColumn("turn", F.row_number().over(Window.partitionBy("site", "prefix").orderBy("page_id"))).withColumn("first_seen", F.min("page_id").over(Window.partitionBy("site", "prefix")))
    return turn.withColumn("place", F.row_number().over(Window.partitionBy("site").orderBy("turn", "first_seen"))).where("place <= 25").select("site", "page_id", "place")


def _recent(spark, d):
    order = Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id"))
    return _read(spark, d, "events").select("user_id", "event_id", "event_type", F.row_number().over(order).alias("place")).where("place <= 5")


def _sentences():
    return T.sentences(F.col("text"))


def _count(rule):
    return F.size(F.filter(_sentences(), rule))


def _sentence_counts(spark, d):
    made = _read(spark, d, "documents").select("doc_id", T.sentences(F.col("text")).alias("s")).withColumn("n", F.transform("s", lambda x: F.size(T.tokens(x)).cast("double")))
    return made.select("doc_id", F.size("s").alias("n_sentences"), T.median(F.col("n")).alias("median_words"))


def _word_counts(spark, d):
    made = _read(spark, d, "documents").select("doc_id", T.tokens(F.col("text")).alias("t"))
    return made.select("doc_id", F.size("t").alias("n_tokens"), F.size(T.content_of(F.col("t"))).alias("n_content"))


def _gram_hashes(spark, d):
    """Number and sum of the hashes of all five-word grams of the content words of whole texts."""
    made = _read(spark, d, "documents").select("doc_id", T.gram_hashes(T.content_tokens(F.col("text"))).alias("h"))
    return made.select("doc_id", F.size("h").alias("n"), F.aggregate("h", F.lit(0).cast("bigint"), lambda a, x: a + x).alias("total"))


def _shingles(spark, d):
    made = _read(spark, d, "documents").select("doc_id", T.shingles(F.col("text")).alias("s")).where("size(s) > 0")
    return made.select("doc_id", F.size("s").cast("bigint").alias("n"), F.array_max("s").alias("largest"), F.aggregate("s", F.lit(0).cast("bigint"), lambda a, x: a + x).alias("total"))


def _near_documents(spark, d):
    """Pairs of documents of one source whose shingles, those of whole texts, are alike."""
    made = stored(_read(spark, d, "documents").select(F.coalesce("source", F.lit("")).alias("audit_id"), F.col("doc_id").alias("page_ord"), T.shingles(F.col("text"), cap=None).alias("shingles")))
    return L.near_duplicate_pages(made).select(F.col("audit_id").alias("source"), "a", "b", F.round("similarity", 9).alias("similarity"))


#: Places of one document's terms follow those of the documents before it.
_ROOM = 1 << 24
#: Terms of a language that are returned, and frequent words that all tasks may hold.
_TERMS, _FREQUENT = 15, 100_000
_TERM = "weight > 1 and char_length(term) > 3"


def _counted_terms(rows: DataFrame, weight: int) -> DataFrame:
    """Of rows of lang, term, doc_id and pos: each term's weight and where it is first seen."""
    return rows.groupBy("lang", "term").agg((F.count("*") * weight).alias("weight"), F.min(F.col("doc_id") * _ROOM + F.col("pos")).alias("seen"))


def _best_terms(counted: DataFrame) -> DataFrame:
    first = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("weight"), "seen"))
    return counted.withColumn("rank", first).where(F.col("rank") <= _TERMS)


def _frequent_words(spark: SparkSession, docs: DataFrame, most: int) -> DataFrame | None:
    """Counted words of which a pair may be among the best terms; none if they are more than ``most``.

    A pair weighs at most twice as much as its rarer word, and nothing below the last of enough single words is among the best.
    """
    scratch = Scratch(spark)
    counted = scratch.cut(_counted_terms(docs.select("lang", "doc_id", F.posexplode(T.content_tokens(F.col("text"))).alias("pos", "term")), 1))
    last = _best_terms(counted.where(_TERM)).groupBy(F.col("lang").alias("_lang")).agg(F.when(F.count("*") == _TERMS, F.min("weight")).alias("least")).where("least is not null")
    found = counted.join(last, F.col("lang").eqNullSafe(F.col("_lang")), "left").where("least is null or 2 * weight >= least").select(*counted.columns).take(most + 1)
    scratch.drop(counted)
    return spark.createDataFrame(found, counted.schema) if len(found) <= most else None


def _corpus_top_terms(spark, d, most: int = _FREQUENT):
    docs = _read(spark, d, "documents")
    frequent = _frequent_words(spark, docs, most)
    if frequent is None:
        rows = docs.select("lang", "doc_id", F.posexplode(T.top_terms(T.content_tokens(F.col("text")))).alias("pos", "t"))
        counted = rows.groupBy("lang", F.col("t.term").alias("term")).agg(F.sum("t.weight").alias("weight"), F.min(F.col("doc_id") * _ROOM + F.col("pos")).alias("seen"))
        return _best_terms(counted.where(_TERM)).drop("seen")
    words = docs.select("lang", "doc_id", T.content_tokens(F.col("text")).alias("words")).withColumn("n", F.size("words"))
    # Each word beside the next one: whole lists would be copied for each of their words.
    beside = F.arrays_zip(F.col("words").alias("a"), F.slice("words", 2, F.greatest(F.size("words"), F.lit(1))).alias("b"))
    each = words.select("lang", "doc_id", "n", F.posexplode(beside).alias("pos", "t")).select("lang", "doc_id", "n", "pos", "t.a", "t.b")
    for name in ("a", "b"):
        known = F.broadcast(frequent.select(F.col("lang").alias("_lang"), F.col("term").alias("_term")))
        each = each.join(known, F.col("lang").eqNullSafe(F.col("_lang")) & (F.col(name) == F.col("_term")), "left_semi")
    pairs = each.select("lang", "doc_id", F.concat_ws(" ", "a", "b").alias("term"), (F.col("n") + F.col("pos")).alias("pos"))
    return _best_terms(frequent.where(_TERM).unionByName(_counted_terms(pairs, 2))).drop("seen")


_TERMS_SQL = f"""SELECT lang, term, weight, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY weight DESC, seen) AS rank FROM (SELECT lang, term, sum(w)::BIGINT AS weight, min(doc_id * {_ROOM} + pos) AS seen FROM
 (SELECT lang, doc_id, unnest(c) AS term, 1 AS w, generate_subscripts(c, 1) - 1 AS pos FROM (SELECT lang, doc_id, {_CONTENT.format('text')} AS c FROM documents)
 UNION ALL SELECT lang, doc_id, c[i] || ' ' || c[i + 1], 2, len(c) + i - 1 FROM (SELECT lang, doc_id, c, unnest(range(1, len(c))) AS i FROM (SELECT lang, doc_id, {_CONTENT.format('text')} AS c FROM documents)))
 GROUP BY lang, term HAVING sum(w) > 1 AND length(term) > 3)) WHERE rank <= 15"""

def _citations(spark, d):
    return E.citations(O.hits(spark, d)).select("audit_id", "site", "tier")


def _citation_weights(spark, d):
    w = E.citation_weights(E.citations(O.hits(spark, d)))
    return w.select("audit_id", F.round("tier_weight", 9).alias("tier_weight"), F.round("tier7_weight", 9).alias("tier7_weight"))




def _mentions(spark, d):
    m = E.mentions(O.answers(spark, d))
    return m.select("audit_id", "prompt", "sample_index", "brand_mentioned", "ordinal", "cited_brand_domain", F.size("competitors_mentioned").alias("rivals"), "sentiment")


def _voice(spark, d):
    s = E.answer_summary(E.mentions(O.answers(spark, d)))
    return s.withColumns({"voice_pct": F.round("voice_pct", 9), "mean_ordinal": F.round("mean_ordinal", 9)})




def _leads(spark, d):
    """Customers as leads of the site that bears their segment's name."""
    orders = _read(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"))
    c = _read(spark, d, "customer").join(orders, "c_custkey", "left")
    host = F.concat(F.lit("www."), F.lower("c_mktsegment"), F.lit(".com"))
    mail = F.when(F.col("c_custkey") % 3 == 0, "gmail.com").when(F.col("c_custkey") % 3 == 1, F.concat(F.lower("c_mktsegment"), F.lit(".com"))).otherwise("other.org")
    rows = c.select(
        "c_custkey", F.concat(F.col("c_name"), F.lit("@"), mail).alias("email"), host.alias("host"), (F.col("c_custkey") % 101).alias("overall"), F.coalesce("n", F.lit(0)).alias("pages_discovered"),
        F.when(F.col("c_nationkey") % 2 == 0, F.col("c_nationkey") / 3).alias("page_rank"), (F.col("c_nationkey") % 4 == 0).alias("has_entity"), (F.col("c_custkey") % 4).alias("top_citations"), (F.col("c_custkey") % 2 == 0).alias("has_competitors"), (F.col("c_acctbal") > 5000).alias("has_budget"),
    )
    return G.lead_scores(rows)


def _lead_scores(spark, d):
    return _leads(spark, d).select("c_custkey", "lead_score", "grade", "is_free_email", "email_matches_domain", G.tone(F.col("overall")).alias("tone"))


_OWN = "c_custkey % 3 = 1"
_LEADS_SQL = f"""SELECT c_custkey, lead_score, CASE WHEN lead_score >= 70 THEN 'A' WHEN lead_score >= 55 THEN 'B' WHEN lead_score >= 40 THEN 'C' ELSE 'D' END AS grade, c_custkey % 3 = 0 AS is_free_email, {_OWN} AS email_matches_domain,
 CASE WHEN c_custkey % 101 >= 70 THEN 'good' WHEN c_custkey % 101 >= 55 THEN 'warning' WHEN c_custkey % 101 >= 35 THEN 'serious' ELSE 'critical' END AS tone FROM (SELECT *, floor(100 * (0.3::DOUBLE * least(1.0::DOUBLE, log10(greatest(n, 10)) / 3) + 0.3::DOUBLE * ((100 - c_custkey % 101) / 100.0::DOUBLE)
 + 0.25::DOUBLE * least(1.0::DOUBLE, CASE WHEN c_nationkey % 2 = 0 THEN c_nationkey / 3.0::DOUBLE / 10 * 0.6::DOUBLE ELSE 0.0::DOUBLE END + CASE WHEN c_nationkey % 4 = 0 THEN 0.25::DOUBLE ELSE 0 END + CASE WHEN c_custkey % 4 > 0 THEN 0.15::DOUBLE ELSE 0 END)
 + 0.15::DOUBLE * least(1.0::DOUBLE, CASE WHEN c_custkey % 2 = 0 THEN 0.25::DOUBLE ELSE 0 END + CASE WHEN {_OWN} THEN 0.45::DOUBLE ELSE 0 END + CASE WHEN c_acctbal > 5000 THEN 0.3::DOUBLE ELSE 0 END)) + 0.5)::BIGINT AS lead_score
 FROM customer LEFT JOIN (SELECT o_custkey AS c_custkey, count(*) AS n FROM orders GROUP BY 1) USING (c_custkey))"""


def _dashboard(spark, d):
    leads = _read(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.when(F.col("c_custkey") % 4 != 0, F.col("c_nationkey")).alias("audit_id"))
    audits = _read(spark, d, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("host"), F.col("n_regionkey").alias("overall_score"))
    return G.lead_dashboard(leads, audits, _read(spark, d, "orders").select(F.col("o_custkey").alias("lead_id"))).select("id", "name", "host", "overall_score", "has_booking")


def _admin(spark, d):
    o = _read(spark, d, "orders")
    return G.admin_counters(o.select(F.when(F.col("o_orderstatus") == "F", "complete").otherwise("running").alias("status"), F.concat(F.col("o_orderpriority"), F.col("o_custkey") % 50).alias("email")))


def _charged(spark, d):
    e = charged(_read(spark, d, "events").withColumn("scope", F.lit("ip")), "event_type", "user_id", 3600, 2)
    return e.select("event_id", "window_s", "allowed")


_AGENTS = ("GPTBot", "ClaudeBot", "Other")


def _robots(spark, d):
    """Which pages each agent may read by rules that the site's pages stand for: some paths are shut, shorter ones open, one agent has a group of its own."""
    p = _read(spark, d, "pages").select(U.host(F.col("url")).alias("audit_id"), F.col("page_id").cast("bigint").alias("page_id"), "url", U.path(F.col("url")).alias("path"))
    shut, open_ = F.concat(F.lit("Disallow:\t"), "path", F.lit(" # shut")), F.concat(F.lit("  allow :"), F.substring("path", 1, 4), F.lit("*"))
    line = F.when(F.col("page_id") % 3 == 0, shut).when(F.col("page_id") % 3 == 1, open_).otherwise(F.concat(F.lit("Disallow: "), F.substring("path", 1, 3)))
    own = F.when(F.min("page_id") % 4 == 0, "\r\nUser-Agent:\tgptbot\t\r\nDisallow: /*$\r\n").otherwise("")
    body = F.concat(F.lit("User-agent: *\r\n"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("page_id", line.alias("line")))), lambda x: x["line"]), "\r\n"), own)
    sites = p.groupBy("audit_id").agg(body.alias("body"), F.min("page_id").alias("m"))
    rows = F.array(F.struct(F.concat(F.lit("https://"), "audit_id", F.lit("/robots.txt")).alias("url"), F.when(F.col("m") % 5 == 0, 404).otherwise(200).alias("status_code"), "body"), F.struct(F.concat(F.lit("http://"), "audit_id", F.lit("/robots.txt")).alias("url"), F.lit(200).alias("status_code"), F.lit("User-agent: *\nDisallow: /").alias("body")))
    files = stored(D.robots_files(sites.select("audit_id", F.inline(rows))))
    p, rules = stored(p), stored(D.robots_rules(files.where("found")))
    parts = [D.fetchable(p, rules, files, a).select("audit_id", "page_id", F.lit(a).alias("agent")) for a in _AGENTS]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


_ROBOTS_SQL = f"""WITH p AS (SELECT {_HOST_SQL} AS audit_id, page_id, CASE WHEN {_PATH_SQL} = '' THEN '/' ELSE {_PATH_SQL} END AS path FROM pages), s AS (SELECT audit_id, min(page_id) AS m FROM p GROUP BY audit_id),
 r AS (SELECT audit_id, page_id % 3 = 1 AS opens, CASE page_id % 3 WHEN 0 THEN path WHEN 1 THEN substr(path, 1, 4) ELSE substr(path, 1, 3) END AS prefix FROM p),
 best AS (SELECT p.audit_id, p.page_id, coalesce(max(length(prefix)) FILTER (opens), -1) AS a, coalesce(max(length(prefix)) FILTER (NOT opens), -1) AS d FROM p JOIN r ON r.audit_id = p.audit_id AND starts_with(path, prefix) GROUP BY ALL)
 SELECT p.audit_id, p.page_id, agent FROM p JOIN s USING (audit_id) LEFT JOIN best USING (audit_id, page_id), (VALUES {", ".join(f"('{a}')" for a in _AGENTS)}) AS x(agent)
 WHERE m % 5 = 0 OR (CASE WHEN agent = 'GPTBot' AND m % 4 = 0 THEN false ELSE coalesce(d < 0 OR a >= d, true) END)"""


#: Addresses as they turn up in the wild, made from page addresses: how each differs, and what a browser reads.
_ODD = (
    ("concat(s, '://', h, p, '/a b')", "h", "p || '/a%20b'", "''"), ("concat(s, '://', h, p, '?q=a|b&ref=x')", "h", "p", "'?q=a%7Cb'"), ("concat('  ', upper(s), ':\\\\', upper(h), p, '/x\t')", "h", "p || '/x'", "''"),
    ("concat(s, '://', h, p, '/%zz')", "h", "p || '/%zz'", "''"), ("concat(s, '://my_', h, p)", "'my_' || h", "p", "''"), ("concat(s, '://münchen.', h, p)", "'xn--mnchen-3ya.' || h", "p", "''"),
    ("concat(s, '://[', h, p)", "''", "''", "''"), ("concat(s, '://', h, ':8080', p, '/../q/./r/')", "h", "regexp_replace(p, '[^/]*$', '') || 'q/r/'", "''"), ("concat(s, '://', h, p, '?b=2&a=%41+b&utm_x=1#f')", "h", "p", "'?a=A+b&b=2'"),
    ("concat(s, '://', h, p, '/é')", "h", "p || '/%C3%A9'", "''"),
)


def _odd_urls(spark, d):
    p = _read(spark, d, "pages").select("page_id", F.regexp_extract("url", "^([a-z]+)://", 1).alias("s"), F.regexp_extract("url", "^[a-z]+://([^/?#]*)", 1).alias("h"), F.regexp_replace(F.regexp_extract("url", "^[a-z]+://[^/?#]*([^?#]*)", 1), "/+$", "").alias("p"))
    made = F.coalesce(*[F.when(F.col("page_id") % len(_ODD) == i, F.expr(u)) for i, (u, *_) in enumerate(_ODD)])
    url = F.col("url")
    return p.select("page_id", made.alias("url")).select("page_id", U.host(url).alias("host"), U.path(url).alias("path"), U.canonical(url).alias("canonical"), U.depth(url).alias("depth"))


def _odd(at: int) -> str:
    return f"CASE page_id % {len(_ODD)} " + " ".join(f"WHEN {i} THEN {row[at]}" for i, row in enumerate(_ODD)) + " END"


_ODD_SQL = f"""SELECT page_id, host, path, CASE WHEN host <> '' THEN s || '://' || host || port || CASE WHEN regexp_replace(path, '/+$', '') = '' THEN '/' ELSE regexp_replace(path, '/+$', '') END || query END AS canonical,
 len(list_filter(string_split(path, '/'), lambda x: x <> ''))::INT AS depth FROM (SELECT page_id, s, {_odd(1)} AS host, CASE WHEN {_odd(1)} <> '' AND {_odd(2)} = '' THEN '/' ELSE {_odd(2)} END AS path, {_odd(3)} AS query, CASE WHEN page_id % {len(_ODD)} = 7 THEN ':8080' ELSE '' END AS port
 FROM (SELECT page_id, regexp_extract(url, '^([a-z]+)://', 1) AS s, regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS h, regexp_replace(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), '/+$', '') AS p FROM pages))"""


def _crawl(spark, d):
    """A crawl of each site over the links that its pages show, without robots rules, seeded by all its pages."""
    seen = stored(audit.signals(spark, d).select("audit_id", "page_ord", "url", "internal_links"))
    links = seen.select("audit_id", U.canonical(F.col("url")).alias("url"), F.posexplode("internal_links").alias("link_ord", "link"))
    sampled = seen.select("audit_id", F.col("page_ord").alias("ord"), U.canonical(F.col("url")).alias("url"))
    none = spark.createDataFrame([], "audit_id string, found boolean, status_code int, body string, html_instead boolean")
    starts = seen.groupBy("audit_id").agg(F.min_by("url", "page_ord").alias("url"))
    return K.crawl(starts, links, D.robots_rules(none), none, sampled, "any")


#: Windows that a first call opens: the next one begins with the first call after the last one's end.
_SLIDING_SQL = """WITH RECURSIVE w AS (SELECT event_type, user_id, min(ts) AS start FROM events GROUP BY ALL
 UNION ALL SELECT w.event_type, w.user_id, min(e.ts) FROM w JOIN events e ON e.event_type = w.event_type AND e.user_id = w.user_id AND e.ts >= w.start + INTERVAL 1 HOUR GROUP BY w.event_type, w.user_id, w.start)
 SELECT event_id, epoch_us(start) AS window_us, row_number() OVER (PARTITION BY event_type, user_id, start ORDER BY ts, event_id) <= 2 AS allowed FROM (SELECT e.event_id, e.event_type, e.user_id, e.ts, max(start) AS start
 FROM events e JOIN w ON w.event_type = e.event_type AND w.user_id = e.user_id AND w.start <= e.ts GROUP BY ALL)"""


REGISTRY = audit.REGISTRY | {
    "doc_word_counts": (_word_counts, f"SELECT doc_id, len({_TOK.format('text')})::INT AS n_tokens, len({_CONTENT.format('text')})::INT AS n_content FROM documents"),
    "doc_sentences": (_sentence_counts, f"SELECT doc_id, len(s)::INT AS n_sentences, coalesce(list_median(list_transform(s, lambda x: len({_TOK.format('x')})::DOUBLE)), 0.0::DOUBLE) AS median_words FROM (SELECT doc_id, {_SENT.format('text')} AS s FROM documents)"),
    "doc_fnv_hash": (_gram_hashes, f"SELECT doc_id, count(h)::INT AS n, coalesce(sum(h), 0)::BIGINT AS total FROM (SELECT doc_id, CASE WHEN i IS NOT NULL THEN {Q.FNV.format('array_to_string(list_slice(w, i, i + 4), chr(32))')} END AS h FROM (SELECT doc_id, w, unnest(CASE WHEN len(w) >= 5 THEN range(1, len(w) - 3) ELSE [NULL] END) AS i FROM (SELECT doc_id, {_CONTENT.format('text')} AS w FROM documents))) GROUP BY doc_id"),
    "doc_shingles": (_shingles, f"SELECT doc_id, count(*) AS n, max(h) AS largest, sum(h)::BIGINT AS total FROM ({Q.shingle_rows('documents', 'doc_id', _CONTENT.format('text'))}) GROUP BY doc_id"),
    "doc_near_duplicates": (_near_documents, f"WITH s AS MATERIALIZED ({Q.shingle_rows('documents', 'doc_id', _CONTENT.format('text'), 'source', True)}), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id HAVING count(*) >= 40) SELECT coalesce(a.source, '') AS source, a.doc_id AS a, b.doc_id AS b, round(count(*)::DOUBLE / (any_value(x.n) + any_value(y.n) - count(*)), 9) AS similarity FROM s a JOIN s b ON coalesce(a.source, '') = coalesce(b.source, '') AND a.h = b.h AND a.doc_id < b.doc_id JOIN n x ON x.doc_id = a.doc_id JOIN n y ON y.doc_id = b.doc_id GROUP BY a.source, a.doc_id, b.doc_id HAVING count(*)::DOUBLE / (any_value(x.n) + any_value(y.n) - count(*)) >= 0.7"),
    "corpus_top_terms": (_corpus_top_terms, _TERMS_SQL),
    "host_citation_tier": (_citations, O.HITS_SQL),
    "citation_score": (_citation_weights, f"SELECT audit_id, round(coalesce(sum({O.WEIGHT_SQL}) FILTER (tier < 7), 0), 9) AS tier_weight, round(coalesce(sum({O.WEIGHT_SQL}) FILTER (tier = 7), 0), 9) AS tier7_weight FROM ({O.HITS_SQL}) GROUP BY audit_id"),
    "tier_histogram": (lambda s, d: E.tier_histogram(E.citations(O.hits(s, d))).withColumnRenamed("count", "n"), f"SELECT audit_id, tier, count(*) AS n FROM ({O.HITS_SQL}) GROUP BY audit_id, tier"),
    "answer_mentions": (_mentions, O.MENTIONS_SQL),
    "share_of_voice": (_voice, O.VOICE_SQL),
    "lead_scores": (_lead_scores, _LEADS_SQL),
    "lead_dashboard": (_dashboard, "SELECT c_custkey AS id, c_name AS name, n_name AS host, n_regionkey AS overall_score, EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey) AS has_booking FROM customer LEFT JOIN nation ON c_custkey % 4 <> 0 AND n_nationkey = c_nationkey"),
    "admin_counters": (_admin, "SELECT count(*) AS audits, count(*) FILTER (o_orderstatus = 'F') AS completed, count(DISTINCT lower(o_orderpriority || (o_custkey % 50)::VARCHAR)) AS people FROM orders"),
    "rate_limit_calls": (_charged, "SELECT event_id, epoch(date_trunc('hour', ts))::BIGINT AS window_s, row_number() OVER (PARTITION BY event_type, user_id, date_trunc('hour', ts) ORDER BY ts, event_id) <= 2 AS allowed FROM events"),
    "stream_limit_calls": (lambda s, d: stream_calls(s, d, True), "SELECT event_id, epoch_us(date_trunc('hour', ts)) AS window_us, row_number() OVER (PARTITION BY event_type, user_id, date_trunc('hour', ts) ORDER BY ts, event_id) <= 2 AS allowed FROM events"),
    "stream_sliding_calls": (lambda s, d: stream_calls(s, d, False), _SLIDING_SQL),
    "robots_allowed": (_robots, _ROBOTS_SQL),
    "url_hostile": (_odd_urls, _ODD_SQL),
    "crawl_rounds": (_crawl, None),
    "stream_stage_state": (stream_latest_stage, "SELECT user_id, event_type, arg_max(event_id, (ts, event_id)) AS event_id, count(*) AS n FROM events GROUP BY ALL"),
    "doc_tokens": (lambda s, d: _select(s, d, "documents", "doc_id", tokens=F.array_join(T.tokens(F.col("text")), " ")), f"SELECT doc_id, array_to_string({_TOK.format('text')}, ' ') AS tokens FROM documents"),
    "doc_definitions": (lambda s, d: _select(s, d, "documents", "doc_id", n_definitions=_count(T.is_definition)), f"SELECT doc_id, len(list_filter({_SENT.format('text')}, lambda x: regexp_matches(x, {_q(T.DEFINITION)})))::INT AS n_definitions FROM documents"),
    "doc_statistics": (lambda s, d: _select(s, d, "documents", "doc_id", n_statistics=_count(T.is_statistic)), f"SELECT doc_id, len(list_filter({_SENT.format('text')}, lambda x: regexp_matches(x, {_q(T.STATISTIC)}) AND len({_CONTENT.format('x')}) >= 5))::INT AS n_statistics FROM documents"),
    "doc_quotable": (lambda s, d: _select(s, d, "documents", "doc_id", n_quotable=_count(T.is_quotable)), f"SELECT doc_id, len(list_filter({_SENT.format('text')}, lambda x: len({_TOK.format('x')}) BETWEEN 15 AND 45 AND NOT x LIKE '%?' AND NOT regexp_matches(x, {_q(T.CONNECTIVE)}) AND len({_CONTENT.format('x')}) >= 7))::INT AS n_quotable FROM documents"),
    "conv_answers": (_conv_answers, f"SELECT conv_id, turn, length(trim(text)) >= 6 AND (trim(text) LIKE '%?' OR regexp_matches(trim(text), {_q(T.STARTERS)})) AS is_question, coalesce(nxt = 'assistant', false) AND coalesce(length(trim(answer)) BETWEEN 40 AND 320 AND NOT trim(answer) LIKE '%?' AND NOT regexp_matches(trim(answer), {_q(T.BACKWARD)}), false) AS qualifies FROM (SELECT *, lead(text) OVER w AS answer, lead(role) OVER w AS nxt FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) WHERE role = 'user'"),
    "url_parts": (lambda s, d: _select(s, d, "pages", "page_id", host=U.host(F.col("url")), registrable=U.registrable(U.host(F.col("url"))), depth=U.depth(F.col("url")), is_html=U.is_html(F.col("url"))), f"SELECT page_id, {_HOST_SQL} AS host, {_REG_SQL} AS registrable, len(list_filter(string_split({_PATH_SQL}, '/'), lambda p: p <> ''))::INT AS depth, NOT regexp_matches({_PATH_SQL}, {_q(U.ASSET)}) AS is_html FROM pages"),
    "url_variants": (lambda s, d: _select(s, d, "pages", "page_id", variants=F.array_join(U.variants(F.col("url")), " ")), f"SELECT page_id, 'http://' || h || '/ https://' || h || '/ http://www.' || h || '/ https://www.' || h || '/' AS variants FROM (SELECT page_id, {_APEX} AS h FROM pages)"),
    "url_canonical": (lambda s, d: _select(s, d, "pages", "page_id", canonical=U.canonical(F.col("url"))), rf"SELECT page_id, s || '://' || h || CASE WHEN p = '' THEN '/' WHEN length(p) > 1 THEN regexp_replace(p, '/+$', '') ELSE p END || CASE WHEN len(q) = 0 THEN '' ELSE '?' || array_to_string(list_transform(list_sort(list_transform(q, lambda x: lower(split_part(x, '=', 1)) || chr(1) || x)), lambda x: split_part(x, chr(1), 2)), '&') END AS canonical FROM (SELECT page_id, lower(regexp_extract(url, '^([a-zA-Z]+)://', 1)) AS s, {_HOST_SQL} AS h, {_PATH_SQL} AS p, list_filter(string_split(regexp_extract(url, '\?([^#]*)', 1), '&'), lambda x: x <> '' AND NOT regexp_matches(x, {_q(U.TRACKING)})) AS q FROM pages)"),
    "url_round_robin_sample": (_url_sample, rf"SELECT site, page_id, place::INT AS place FROM (SELECT site, page_id, row_number() OVER (PARTITION BY site ORDER BY turn, first_seen) AS place FROM (SELECT *, row_number() OVER (PARTITION BY site, prefix ORDER BY page_id) AS turn, min(page_id) OVER (PARTITION BY site, prefix) AS first_seen FROM (SELECT page_id, {_REG_SQL} AS site, regexp_extract({_PATH_SQL}, '^/([^/]*)', 1) AS prefix FROM pages))) WHERE place <= 25"),
    "page_title": (lambda s, d: _select(s, d, "pages", "page_id", title=_title()), f"SELECT page_id, {_TITLE_SQL} AS title FROM pages"),
    "site_title_duplicates": (_duplicate_titles, f"SELECT site, sum(CASE WHEN n > 1 THEN n ELSE 0 END)::BIGINT AS duplicates, count(*) AS titles FROM (SELECT site, lower(title) AS k, count(*) AS n FROM ({_PAGES_SQL}) WHERE title IS NOT NULL GROUP BY ALL) GROUP BY site"),
    "rate_limit_events": (_rate_limit, "SELECT user_id, epoch(date_trunc('hour', ts))::BIGINT AS window_s, count(*) AS hits, least(count(*), 3) AS allowed FROM events GROUP BY ALL"),
    "recent_by_user": (_recent, "SELECT user_id, event_id, event_type, place::INT AS place FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS place FROM events) WHERE place <= 5"),
    "stream_rate_limit": (stream_rate_limit, "SELECT user_id, epoch(date_trunc('hour', ts))::BIGINT AS window_s, count(*) AS hits, least(count(*), 3) AS allowed FROM events GROUP BY ALL"),
    "latest_stage": (_latest, "SELECT user_id, event_type, arg_max(event_id, (ts, event_id)) AS event_id, count(*) AS n FROM events GROUP BY ALL"),
}
