"""The check catalogue: each check is a few SQL expressions over the row of facts of a site.

Spark evaluates the expressions as one projection, so that all checks of a site cost one aggregation.
A check whose condition ``unless`` does not hold is not applicable, one whose ``known`` does not hold is
unavailable; both have score and confidence 0 and stay out of every roll-up but coverage.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitelens.functions.maths import sql_clamp, sql_grade, sql_ramp, sql_ratio

_N = "greatest(pages_ok, 1)"
_CSR = "CASE WHEN csr > 0 THEN 0.5e0 ELSE 1e0 END"


def _share(part: str) -> str:
    return sql_ratio(part, _N)


def _flag(condition: str, yes: str = "1e0", no: str = "0e0") -> str:
    return f"CASE WHEN {condition} THEN {yes} ELSE {no} END"


def _pick(*pairs: str) -> str:
    """CASE of (condition, status) pairs with a last status."""
    whens = " ".join(f"WHEN {c} THEN '{s}'" for c, s in zip(pairs[:-1:2], pairs[1:-1:2], strict=True))
    return f"CASE {whens} ELSE '{pairs[-1]}' END"


@dataclass(frozen=True)
class Check:
    id: str
    weight: float
    score: str
    #: Limits of the score below which it fails and warns, or an expression of the status.
    status: tuple | str
    confidence: str = "1e0"
    unless: str = "true"
    known: str = "true"

    @property
    def group(self) -> str:
        return self.id.rsplit(".", 1)[0]

    @property
    def pillar(self) -> str:
        return self.id.split(".", 1)[0]

    def sql(self) -> dict[str, str]:
        """Score, status and confidence; the status is graded before the score is clamped."""
        graded = self.status if isinstance(self.status, str) else sql_grade(f"({self.score})", *self.status)
        state = f"CASE WHEN NOT ({self.known}) THEN 'unavailable' WHEN NOT ({self.unless}) THEN 'not_applicable' ELSE {graded} END"
        live = f"({self.known}) AND ({self.unless})"
        return {
            "score": f"CASE WHEN {live} THEN {sql_clamp(f'({self.score})')} ELSE 0e0 END",
            "status": state,
            "confidence": f"CASE WHEN {live} THEN {self.confidence} ELSE 0e0 END",
        }


_CANONICAL = f"0.6e0 * {_share('canonicals')} + 0.4e0 * {sql_ratio('canonicals_own', 'greatest(canonicals, 1)')}"
_H1 = f"0.7e0 * {_share('h1_any')} + 0.3e0 * {_share('h1_one')}"
_ANCHORS = f"0.6e0 * {sql_ratio('anchors_distinct', 'anchors')} + 0.4e0 * (1e0 - {sql_ratio('anchors_generic', 'greatest(anchors, 1)')})"
_PARAGRAPH = f"CASE WHEN median_paragraph = 0 THEN 0.5e0 WHEN median_paragraph <= 90 THEN {sql_ramp('median_paragraph', 5, 30)} ELSE {sql_ramp('median_paragraph', 180, 90)} END"
_FAQ = sql_clamp("CAST(faq + qa AS DOUBLE) / greatest(pages_ok * 0.25e0, 1e0)")
_CITED = "least(tier7_weight, 0.5e0)"
_MODE_A, _MODE_B = "ai_samples IS NOT NULL", "ai_samples IS NULL AND coalesce(aio_checked, 0) > 0"
_CITE_RATE = sql_ratio("aio_cites", "greatest(aio_present, 1)")
_UNKNOWN_PERF = "performance_source IS NOT NULL"
_FIELD = "CASE WHEN performance_source = 'field' THEN 1e0 ELSE 0.6e0 END"
_LIST_DENSITY = "CASE WHEN words = 0 THEN 0e0 ELSE CAST(list_units AS DOUBLE) / (words / 1000e0) END"
_TRUST = f"{_flag('about', '0.4e0')} + {_flag('contact', '0.35e0')} + {_flag('people_page', '0.25e0')}"
_CLARITY = f"{_flag('category_length > 12', '0.4e0')} + {_flag('home_h1', '0.3e0')} + {_flag('home_meta', '0.3e0')}"
_PLACE = f"{_flag('org_address OR postal > 0', '0.7e0')} + {_flag('org_area', '0.3e0')}"
_MAP = f"CASE WHEN sitemap_found THEN 0.5e0 + {_flag('sitemap_lastmod', '0.3e0')} + {_flag('sitemap_urls > 0', '0.2e0')} ELSE 0e0 END"
_INTENTS = f"({_flag('informational')} + {_flag('commercial')} + {_flag('transactional')}) / 3e0"

#: Ids, weights, limits and confidences of the checks, in order of the report.
CHECKS = (
    Check("seo.index.https", 10, _flag("https"), _pick("https", "pass", "fail")),
    Check("seo.index.status_code", 10, _flag("home_status BETWEEN 200 AND 299"), _pick("home_status BETWEEN 200 AND 299", "pass", "fail")),
    Check("seo.index.redirect_chain", 6, "CASE redirects WHEN 0 THEN 1e0 WHEN 1 THEN 0.9e0 WHEN 2 THEN 0.6e0 ELSE 0.2e0 END", _pick("redirects <= 1", "pass", "redirects = 2", "warn", "fail")),
    Check("seo.index.canonical_host", 8, _flag("one_host", "1e0", "0.2e0"), _pick("one_host", "pass", "fail")),
    Check("seo.index.robots_txt", 8, "CASE WHEN blanket_block THEN 0e0 WHEN NOT robots_found THEN 0.6e0 WHEN robots_errors > 0 THEN 0.7e0 ELSE 1e0 END", _pick("blanket_block", "fail", "NOT robots_found OR robots_errors > 0", "warn", "pass")),
    Check("seo.index.sitemap", 8, f"CASE WHEN sitemap_found THEN 0.5e0 + {_flag('sitemap_lastmod', '0.25e0')} + {_flag('sitemaps_declared > 0', '0.25e0')} ELSE 0.1e0 END", _pick("NOT sitemap_found", "fail", "sitemap_lastmod AND sitemaps_declared > 0", "pass", "warn")),
    Check("seo.index.noindex", 12, f"1e0 - {_share('noindex')}", _pick("noindex = 0", "pass", f"{_share('noindex')} > 0.25e0", "fail", "warn")),
    Check("seo.index.canonical_tags", 10, _CANONICAL, (0.4, 0.8)),
    Check("seo.index.broken_pages", 10, f"1e0 - {sql_clamp('3e0 * CAST(broken AS DOUBLE) / greatest(pages, 1)')}", _pick("broken = 0", "pass", "broken > 2", "fail", "warn")),
    Check("seo.index.crawl_depth", 6, f"1e0 - {sql_clamp(f'2e0 * {_share("deep")}')}", (0.5, 0.85)),
    Check("seo.index.csr_dependency", 12, f"1e0 - {_share('csr')}", _pick("csr = 0", "pass", f"{_share('csr')} > 0.5e0", "fail", "warn")),
    Check("seo.onpage.title_present", 12, _share("titled"), (0.7, 1.0)),
    Check("seo.onpage.title_length", 8, sql_ratio("titles_sized", "greatest(titled, 1)"), (0.3, 0.75)),
    Check("seo.onpage.title_duplicates", 8, f"1e0 - {_share('title_repeats')}", _pick("title_repeats = 0", "pass", f"title_repeats > {_N} * 0.3e0", "fail", "warn")),
    Check("seo.onpage.meta_description", 8, _share("described"), (0.4, 0.9)),
    Check("seo.onpage.meta_duplicates", 5, f"1e0 - {_share('meta_repeats')}", _pick("meta_repeats = 0", "pass", "warn")),
    Check("seo.onpage.h1", 10, _H1, (0.5, 0.9)),
    Check("seo.onpage.heading_hierarchy", 7, _share("ordered"), (0.4, 0.8)),
    Check("seo.onpage.image_alt", 6, sql_ratio("images_alt", "images"), (0.5, 0.9), unless="images > 0"),
    Check("seo.onpage.content_depth", 10, sql_ramp("median_words", 150, 800), (0.25, 0.65), _CSR),
    Check("seo.onpage.thin_pages", 6, f"1e0 - {_share('thin')}", _pick("thin = 0", "pass", f"{_share('thin')} > 0.4e0", "fail", "warn")),
    Check("seo.onpage.duplicate_content", 8, f"1e0 - {sql_clamp('CAST(alike AS DOUBLE) / greatest(comparable, 1)')}", _pick("alike = 0", "pass", "alike > 2", "fail", "warn"), unless="comparable >= 2"),
    Check("seo.perf.performance_score", 12, "performance_score / 100e0", (0.5, 0.9), _FIELD, known=f"{_UNKNOWN_PERF} AND performance_score IS NOT NULL"),
    Check("seo.perf.lcp", 10, sql_ramp("lcp_ms", 5000, 2000), _pick("lcp_ms <= 2500", "pass", "lcp_ms <= 4000", "warn", "fail"), _FIELD, known=f"{_UNKNOWN_PERF} AND lcp_ms IS NOT NULL"),
    Check("seo.perf.cls", 8, sql_ramp("cls", 0.4, 0.05), _pick("cls <= 0.1e0", "pass", "cls <= 0.25e0", "warn", "fail"), _FIELD, known=f"{_UNKNOWN_PERF} AND cls IS NOT NULL"),
    Check("seo.perf.ttfb", 6, sql_ramp("ttfb_ms", 2500, 500), _pick("ttfb_ms <= 800", "pass", "ttfb_ms <= 1800", "warn", "fail"), _FIELD, known=f"{_UNKNOWN_PERF} AND ttfb_ms IS NOT NULL"),
    Check("seo.perf.mobile_friendly", 10, "mobile_score", (0.5, 0.95), _FIELD, known=f"{_UNKNOWN_PERF} AND mobile_score IS NOT NULL"),
    Check("seo.schema.present", 14, _share("schema_any"), (0.2, 0.7)),
    Check("seo.schema.valid_jsonld", 10, f"1e0 - {_share('schema_errors')}", _pick("schema_errors = 0", "pass", "fail")),
    Check("seo.schema.breadcrumbs", 6, _share("breadcrumbs"), _pick(f"{_share('breadcrumbs')} >= 0.5e0", "pass", "breadcrumbs > 0", "warn", "opportunity")),
    Check("seo.links.internal_density", 12, sql_ramp("median_links", 3, 25), (0.25, 0.7)),
    Check("seo.links.anchor_quality", 8, _ANCHORS, (0.3, 0.7), unless="anchors > 0"),
    Check("seo.links.orphan_risk", 6, f"1e0 - {_share('orphans')}", _pick("orphans = 0", "pass", "warn"), "0.7e0"),
    Check("seo.links.outbound_references", 6, sql_ramp(f"(CAST(external AS DOUBLE) / {_N})", 0, 3), _pick(f"{sql_ramp(f'(CAST(external AS DOUBLE) / {_N})', 0, 3)} >= 0.6e0", "pass", "opportunity")),
    Check("aeo.answer.question_headings", 14, sql_ramp(f"(CAST(questions AS DOUBLE) / {_N})", 0, 2.5), (0.2, 0.6), _CSR),
    Check("aeo.answer.direct_answer_proximity", 16, sql_ratio("questions_answered", "questions"), _pick("questions = 0", "fail", f"{sql_ratio('questions_answered', 'questions')} < 0.3e0", "fail", f"{sql_ratio('questions_answered', 'questions')} < 0.7e0", "warn", "pass"), _CSR),
    Check("aeo.answer.definitions", 8, sql_ramp(f"(CAST(definitions AS DOUBLE) / {_N})", 0, 2), (0.2, 0.6, True), _CSR),
    Check("aeo.answer.lists_tables", 8, sql_ramp(f"({_LIST_DENSITY})", 0.3, 4), (0.25, 0.65, True), _CSR),
    Check("aeo.answer.paragraph_length", 6, _PARAGRAPH, (0.3, 0.7), _CSR),
    Check("aeo.answer.semantic_html", 8, _share("semantic"), (0.3, 0.8)),
    Check("aeo.schema.faq", 14, _FAQ, _pick("faq + qa = 0", "fail", f"{_FAQ} < 0.2e0", "fail", f"{_FAQ} < 0.7e0", "warn", "pass")),
    Check("aeo.schema.howto", 6, _flag("howto > 0"), _pick("howto > 0", "pass", "opportunity"), unless="procedural"),
    Check("aeo.schema.article", 8, sql_ratio("articles", "editorial"), (0.3, 0.8), unless="editorial > 0"),
    Check("aeo.schema.answer_alignment", 10, f"CASE WHEN faq_checked = 0 THEN 0.5e0 ELSE {sql_ratio('faq_aligned', 'faq_checked')} END", _pick("faq_checked = 0", "warn", f"{sql_ratio('faq_aligned', 'faq_checked')} < 0.5e0", "fail", f"{sql_ratio('faq_aligned', 'faq_checked')} < 0.85e0", "warn", "pass"), "0.75e0", unless="faq > 0"),
    Check("aeo.eeat.author_byline", 12, sql_ratio("bylined", "essays"), (0.3, 0.8), unless="essays > 0"),
    Check("aeo.eeat.author_schema", 8, sql_ratio("author_schema", "essays"), (0.25, 0.75), unless="essays > 0"),
    Check("aeo.eeat.trust_pages", 12, _TRUST, (0.4, 0.75), "0.85e0"),
    Check("aeo.eeat.dates", 10, sql_ratio("dated", "essays"), (0.3, 0.8), unless="essays > 0"),
    Check("aeo.eeat.freshness", 8, sql_ramp("months_old", 24, 2), _pick("months_old <= 3", "pass", "months_old <= 12", "warn", "fail"), unless="months_old IS NOT NULL"),
    Check("aeo.eeat.outbound_citations", 8, _share("citing"), (0.2, 0.6, True)),
    Check("aeo.coverage.intent_spread", 10, _INTENTS, (0.4, 0.99)),
    Check("aeo.coverage.question_gap", 16, sql_ratio("gaps_answered", "gaps"), (0.25, 0.7), known="coalesce(gaps, 0) > 0"),
    Check("geo.entity.organization_schema", 16, "coalesce(org_weight, 0e0) / 16e0", _pick("org_weight IS NULL", "fail", "org_weight / 16e0 < 0.3e0", "fail", "org_weight / 16e0 < 0.75e0", "warn", "pass")),
    Check("geo.entity.sameas", 12, sql_ramp("same_as", 0, 5), (0.2, 0.8)),
    Check("geo.entity.name_consistency", 10, _flag("one_name", "1e0", "0.4e0"), _pick("one_name", "pass", "warn")),
    Check("geo.entity.category_clarity", 12, _CLARITY, (0.4, 0.9)),
    Check("geo.entity.people", 6, _flag("persons > 0"), _pick("persons > 0", "pass", "opportunity")),
    Check("geo.entity.location", 8, _PLACE, (0.3, 0.9, True)),
    Check("geo.entity.products", 10, sql_ratio("product_schema", "commercial_pages"), (0.2, 0.7), unless="commercial_pages > 0"),
    Check("geo.citation.wikidata", 14, _flag("qid IS NOT NULL"), _pick("qid IS NOT NULL", "pass", "opportunity"), known="entity_checked"),
    Check("geo.citation.domain_authority", 8, "page_rank / 10e0", (0.2, 0.5), "0.7e0", known="page_rank IS NOT NULL"),
    Check("geo.citation.third_party", 16, f"(tier_weight + {_CITED}) / 6e0", (0.25, 0.7), known="tier_weight IS NOT NULL"),
    Check("geo.content.statistics", 14, sql_ramp(f"(CAST(statistics AS DOUBLE) / {_N})", 0, 3), (0.2, 0.65, True), _CSR),
    Check("geo.content.quotable", 12, sql_ramp(f"(CAST(quotable AS DOUBLE) / {_N})", 0.5, 8), (0.2, 0.65), _CSR),
    Check("geo.content.comparisons", 12, "comparisons / 3e0", _pick("comparisons >= 2", "pass", "comparisons = 1", "warn", "opportunity")),
    Check("geo.content.original_research", 10, "research / 2e0", _pick("research > 0", "pass", "opportunity")),
    Check("geo.content.expert_commentary", 8, sql_ramp(f"(CAST(blockquotes AS DOUBLE) / {_N})", 0, 1.5), _pick("blockquotes > 3", "pass", "blockquotes > 0", "warn", "opportunity"), _CSR),
    Check("geo.content.definitions", 8, sql_ramp(f"(CAST(definitions AS DOUBLE) / {_N})", 0, 2), (0.2, 0.6, True), _CSR),
    Check("geo.machine.ai_crawler_access", 18, f"1e0 - {sql_ratio('retrievers_blocked', 'greatest(retrievers, 1)')}", _pick("retrievers_blocked = 0", "pass", "retrievers_blocked >= retrievers / 2e0", "fail", "warn")),
    Check("geo.machine.training_crawler_policy", 4, "0e0", "'not_applicable'", unless="false"),
    Check("geo.machine.schema_coverage", 14, _share("schema_pages"), (0.25, 0.75)),
    Check("geo.machine.entity_graph", 10, f"CASE WHEN schema_pages = 0 THEN 0e0 ELSE {sql_ratio('schema_ids', 'schema_pages')} END", _pick("schema_pages = 0", "fail", f"{sql_ratio('schema_ids', 'schema_pages')} < 0.6e0", "opportunity", "pass")),
    Check("geo.machine.sitemap_quality", 8, _MAP, (0.3, 0.9)),
    Check("geo.machine.llms_txt", 3, _flag("llms_found"), _pick("llms_found", "pass", "opportunity"), "0.4e0"),
    Check("geo.machine.feeds", 4, _flag("feeds > 0"), _pick("feeds > 0", "pass", "opportunity")),
    Check("ai.mention.google_aio", 40, _CITE_RATE, (0.15, 0.5)),
    Check("ai.citation.google_aio", 30, _CITE_RATE, (0.15, 0.5), known="aio_domains > 0"),
    Check("ai.mention.rate", 40, sql_ratio("ai_mentioned", "ai_samples"), (0.15, 0.5), known=_MODE_A),
    Check("ai.citation.rate", 30, sql_ratio("ai_cited", "ai_samples"), (0.1, 0.4), known=_MODE_A),
    Check("ai.sov.share", 20, sql_clamp("voice_pct / 40e0"), (0.2, 0.6), known=_MODE_A),
    Check("ai.sentiment.quality", 10, f"CAST(ai_positive - ai_negative AS DOUBLE) / greatest(ai_mentioned, 1) + 0.5e0", _pick("ai_negative > ai_positive", "warn", "pass"), "0.6e0", known=f"{_MODE_A} AND ai_mentioned > 0"),
)
#: Which of the AI checks a site gets: with an overview but no sampled answers those of the search engine take two places.
_SHOWN = {"ai.mention.google_aio": _MODE_B, "ai.citation.google_aio": _MODE_B, "ai.mention.rate": f"NOT ({_MODE_B})", "ai.citation.rate": f"NOT ({_MODE_B})"}


def mode_sql() -> str:
    """A: sampled answers; B: overviews of the search engine; C: neither."""
    return f"CASE WHEN {_MODE_A} THEN 'A' WHEN {_MODE_B} THEN 'B' ELSE 'C' END"


#: What a finding has.
COLUMNS = ("audit_id", "check_ord", "check_id", "pillar", "group", "status", "score", "weight", "confidence")


def evaluate(facts: DataFrame, checks: tuple[Check, ...] = CHECKS) -> DataFrame:
    """audit_id, check_ord, check_id, pillar, group, status, score, weight, confidence: a row for each site and check."""
    rows = []
    for i, c in enumerate(checks):
        sql = c.sql()
        shown = _SHOWN.get(c.id, "true")
        rows.append(
            F.struct(
                F.lit(i).alias("check_ord"), F.lit(c.id).alias("check_id"), F.lit(c.pillar).alias("pillar"), F.lit(c.group).alias("group"), F.expr(sql["status"]).alias("status"),
                F.expr(sql["score"]).cast("double").alias("score"), F.lit(float(c.weight)).alias("weight"), F.expr(sql["confidence"]).cast("double").alias("confidence"), F.expr(shown).alias("shown"),
            )
        )
    return facts.select("audit_id", F.inline(F.array(*rows))).where("shown").drop("shown")


def findings_sql(facts: str, checks: tuple[Check, ...] = CHECKS) -> str:
    """The same rows from a table of facts, for the comparison database."""
    parts = []
    for i, c in enumerate(checks):
        sql = c.sql()
        parts.append(
            f"SELECT audit_id, {i} AS check_ord, '{c.id}' AS check_id, '{c.pillar}' AS pillar, '{c.group}' AS \"group\", {sql['status']} AS status, "
            f"CAST({sql['score']} AS DOUBLE) AS score, {float(c.weight)}::DOUBLE AS weight, CAST({sql['confidence']} AS DOUBLE) AS confidence FROM {facts} WHERE {_SHOWN.get(c.id, 'true')}"
        )
    return " UNION ALL ".join(parts)
