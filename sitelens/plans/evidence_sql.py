"""SQL of evidence and affected pages: what the remainders of page_id say that each finding has to show."""

from __future__ import annotations

from sitelens.operators import catalogue as C
from sitelens.operators import findings as R
from sitelens.operators.discovery import AI_CRAWLERS
from sitelens.operators.html import PROPERTIES
from sitelens.plans import observed as O
from sitelens.plans import sql as Q

_LD = "page_id % 10"
_AFFECTED = {
    "seo.index.noindex": "noindex", "seo.index.canonical_tags": "page_id % 4 IN (0, 3)", "seo.index.crawl_depth": "depth > 3", "seo.index.csr_dependency": "csr", "seo.onpage.title_present": "title IS NULL", "seo.onpage.title_length": "NOT length(title) BETWEEN 30 AND 60",
    "seo.onpage.meta_description": "page_id % 3 > 0", "seo.onpage.h1": "len(h1s) <> 1", "seo.onpage.heading_hierarchy": f"len(h1s) > 0 AND {_LD} = 9 AND list_contains(heads, 'Setup guide')", "seo.onpage.thin_pages": "word_count < 300 AND NOT csr",
    "seo.schema.present": f"{_LD} IN (1, 8, 9)", "seo.schema.valid_jsonld": f"{_LD} = 1", "aeo.answer.semantic_html": "articles = 0", "aeo.schema.faq": f"{_LD} = 3", "aeo.schema.article": f"{_LD} <> 4 AND {Q.url_has(Q.EDITORIAL)}",
    "aeo.eeat.author_byline": f"NOT (page_id % 5 = 2 OR {_LD} = 4) AND {Q.url_has(Q.ESSAYS)}", "aeo.eeat.dates": f"NOT (page_id % 4 = 3 OR {_LD} = 4) AND {Q.url_has(Q.ESSAYS)}", "geo.entity.products": f"{_LD} <> 5 AND {Q.url_has(Q.COMMERCIAL)}",
    "geo.content.comparisons": Q.has_word(Q.TOPIC, O.T.COMPARISON), "geo.content.original_research": Q.has_word(Q.TOPIC, O.T.RESEARCH),
}
_PAGES = " UNION ALL ".join(f"SELECT audit_id, '{c}' AS check_id, 0 AS p, page_id AS x, 0 AS y, url FROM pg WHERE {p}" for c, p in _AFFECTED.items())
_PAIRS = "pairs JOIN (SELECT page_id AS a, url AS url_a FROM pg) USING (a) JOIN (SELECT page_id AS b, url AS url_b FROM pg) USING (b)"
_ALL = f"""{_PAGES} UNION ALL SELECT audit_id, 'aeo.schema.faq', 1, page_id, 0, url FROM pg WHERE {_LD} = 7 UNION ALL SELECT host, 'seo.index.broken_pages', 0, page_id, 0, url FROM every WHERE {O.LOST} AND NOT first
 UNION ALL SELECT audit_id, 'seo.onpage.title_duplicates', first, page_id, 0, url FROM (SELECT audit_id, page_id, url, count(*) OVER w AS n, min(page_id) OVER w AS first FROM pg WHERE title IS NOT NULL WINDOW w AS (PARTITION BY audit_id, lower(title))) WHERE n > 1
 UNION ALL SELECT audit_id, 'seo.links.orphan_risk', 0, page_id, 0, url FROM orphaned UNION ALL SELECT audit_id, 'seo.onpage.duplicate_content', a, b, 0, url_a FROM {_PAIRS} UNION ALL SELECT audit_id, 'seo.onpage.duplicate_content', a, b, 1, url_b FROM {_PAIRS}"""
_HOST_OF = "CASE site " + " ".join(f"WHEN '{s}' THEN '{h}'" for h, s in O._SITE_OF.items()) + " END"
_KINDS = {0: ["BreadcrumbList"], 2: ["Organization", "PostalAddress"], 3: ["FAQPage", "Question", "Answer"], 4: ["Article", "Person"], 5: ["Product"], 6: ["HowTo"], 7: ["QAPage"]}
_TYPES = f"CASE {_LD} " + " ".join(f"WHEN {k} THEN {v}" for k, v in _KINDS.items()) + " ELSE [] END"
_THERE = ["name", "url", "sameAs", "address"]
_MISSING = ",".join(p for p in PROPERTIES if p not in _THERE)
_GOOD = f"length(answer) BETWEEN 40 AND 320 AND NOT answer LIKE '%?' AND NOT regexp_matches(answer, {Q.quoted(O.T.BACKWARD)})"
_QUESTIONS = "SELECT audit_id, page_id, unnest(asked) AS q, generate_subscripts(asked, 1) AS spot, answer FROM pg"
_CRAWLERS = ", ".join(f"('{a}', '{o}', '{p}')" for a, o, p in AI_CRAWLERS)


def _few(rows: str, check: str, most: int, order: str) -> str:
    return f"SELECT audit_id, '{check}' AS check_id, string_agg(txt, '; ' ORDER BY place) AS shown FROM (SELECT audit_id, txt, row_number() OVER (PARTITION BY audit_id ORDER BY {order}) AS place FROM ({rows})) WHERE place <= {most} GROUP BY audit_id"


def _list(rows: str, check: str, label: str, most: int, order: str) -> str:
    return f"SELECT audit_id, '{check}', 'list|{label}|' || string_agg(txt, ',' ORDER BY place) FROM (SELECT audit_id, txt, row_number() OVER (PARTITION BY audit_id ORDER BY {order}) AS place FROM ({rows})) WHERE place <= {most} GROUP BY audit_id"


_SHOWN = " UNION ALL ".join([
    _few(f"SELECT *, 'text|' || substr(q, 1, 90) || '|' || CASE WHEN answer IS NULL THEN 'No answer follows.' ELSE 'The answer has ' || length(answer) || ' characters.' END AS txt FROM ({_QUESTIONS}) WHERE NOT coalesce({_GOOD}, false)", "aeo.answer.direct_answer_proximity", 4, "page_id, spot"),
    _few(f"SELECT host AS audit_id, page_id, 'text|' || url || '|HTTP 404' AS txt FROM every WHERE {O.LOST} AND NOT first", "seo.index.broken_pages", 10, "page_id"),
    _few(f"SELECT audit_id, a, b, 'text|' || floor(100 * similarity + 0.5::DOUBLE)::BIGINT || '% similar|' || url_a || ' ≈ ' || url_b AS txt FROM {_PAIRS}", "seo.onpage.duplicate_content", 6, "a, b"),
    _few(f"SELECT audit_id, page_id, 'text|Not in the visible text|' || url || ': ' || lower(substr('{O.STANDS}', 1, 60)) AS txt FROM pg WHERE page_id % 20 = 13", "aeo.schema.answer_alignment", 5, "page_id"),
    _few(f"SELECT audit_id, tier, site, 'url|Tier ' || tier || '|https://' || {_HOST_OF} || '/x' AS txt FROM ({O.HITS_SQL})", "geo.citation.third_party", 10, "tier, site"),
    _few(f"""SELECT audit_id, agent, 'text|' || agent || ' (' || operator || ', ' || purpose || ')|' || CASE WHEN m % 5 = 1 THEN 'shut out by *' WHEN m % 5 = 3 AND agent IN ('GPTBot', 'PerplexityBot') THEN 'shut out by ' || lower(agent) ELSE 'allowed' END AS txt
 FROM homes, (VALUES {_CRAWLERS}) AS c(agent, operator, purpose)""", "geo.machine.ai_crawler_access", 20, "agent"),
    _list(f"SELECT audit_id, kind AS txt, min((page_id, spot)) AS at_first FROM (SELECT audit_id, page_id, unnest({_TYPES}) AS kind, generate_subscripts({_TYPES}, 1) AS spot FROM pg) GROUP BY audit_id, kind", "seo.schema.present", "Types", 20, "at_first"),
    _list(f"SELECT audit_id, page_id, spot, q AS txt FROM ({_QUESTIONS})", "aeo.answer.question_headings", "Examples", 5, "page_id, spot"),
    _list("SELECT audit_id, value, q_ord, question AS txt FROM gap_rows WHERE NOT answered", "aeo.coverage.question_gap", "Unanswered", 6, "value DESC, q_ord"),
    f"SELECT audit_id, 'geo.entity.organization_schema', 'list|Present|{','.join(_THERE)}; list|Missing|{_MISSING}' FROM home WHERE org", "SELECT audit_id, 'geo.entity.sameas', 'list|Profiles|a,b,c' FROM home WHERE org",
    f"SELECT audit_id, 'geo.entity.name_consistency', 'list|Names|' || array_to_string(list_transform(list_filter(list_zip(names, range(len(names))), lambda z: length(z[1]) <= 60 AND list_position(names, z[1]) = z[2] + 1), lambda z: z[1]), ',') FROM (SELECT audit_id, {O._NAMES} AS names FROM home)",
])


def _items(c: C.Check) -> str:
    out = []
    if c.id in R.COUNTS:
        label, part, whole = R.COUNTS[c.id]
        out.append(f"concat_ws('|', 'count', '{label}', CAST({part} AS STRING), CAST({whole or 'NULL'} AS STRING))")
    if c.id in R.METRICS:
        label, value, unit = R.METRICS[c.id]
        out.append(f"concat_ws('|', 'metric', '{label}', CAST({value} AS STRING), nullif('{unit}', ''))")
    return f"concat_ws('; ', {', '.join(out)})" if out else "NULL"


def _text(c: C.Check) -> str:
    sql = c.sql()["status"]
    return f"SELECT audit_id, '{c.id}' AS check_id, '{R.TEXTS[c.id][0]}' AS title, {R.summary_sql(c, sql)} AS summary, {_items(c)} AS items FROM facts"


#: After the CTE ``findings``.
EVIDENCE = f"""spoken AS ({" UNION ALL ".join(map(_text, C.CHECKS))}), few AS ({_SHOWN}),
 urls AS (SELECT audit_id, check_id, string_agg(url, ' ' ORDER BY place) AS affected FROM (SELECT *, row_number() OVER (PARTITION BY audit_id, check_id ORDER BY p, x, y) AS place FROM ({_ALL})) WHERE place <= {R.MOST_URLS} GROUP BY ALL)
 SELECT audit_id, check_id, title, summary, CASE WHEN status IN ('unavailable', 'not_applicable') THEN '' ELSE concat_ws('; ', items, shown) END AS evidence,
 CASE WHEN status IN ('unavailable', 'not_applicable') THEN '' ELSE coalesce(affected, '') END AS affected_urls FROM findings JOIN spoken USING (audit_id, check_id) LEFT JOIN few USING (audit_id, check_id) LEFT JOIN urls USING (audit_id, check_id)"""
