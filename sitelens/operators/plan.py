"""From ranked findings to an action plan, business translations and competitor comparison."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sitelens.functions import text as T
from sitelens.operators import scoring as S

#: Horizon, impact and effort of the recommendation for each check; checks that are not named have none.
TEMPLATES = {
    ("now", "High", "High"): "seo.index.csr_dependency",
    ("now", "High", "Low"): "geo.machine.ai_crawler_access seo.index.robots_txt seo.index.noindex seo.index.canonical_host",
    ("now", "High", "Medium"): "seo.index.https",
    ("now", "Medium", "Low"): "seo.index.broken_pages seo.schema.valid_jsonld",
    ("30d", "High", "Low"): "geo.entity.organization_schema geo.entity.sameas aeo.schema.faq seo.onpage.title_present geo.entity.category_clarity",
    ("30d", "High", "Medium"): "aeo.answer.direct_answer_proximity aeo.answer.question_headings aeo.coverage.question_gap seo.schema.present",
    ("30d", "Low", "Low"): "seo.onpage.meta_description seo.onpage.heading_hierarchy seo.onpage.image_alt seo.onpage.meta_duplicates seo.links.anchor_quality seo.links.outbound_references seo.schema.breadcrumbs aeo.answer.paragraph_length geo.machine.sitemap_quality geo.machine.feeds",
    ("30d", "Medium", "High"): "seo.onpage.content_depth",
    ("30d", "Medium", "Low"): "aeo.schema.answer_alignment aeo.eeat.dates seo.onpage.title_duplicates seo.onpage.h1 seo.links.internal_density seo.index.sitemap seo.index.canonical_tags seo.links.orphan_risk aeo.answer.definitions aeo.answer.lists_tables aeo.answer.semantic_html aeo.eeat.trust_pages aeo.eeat.outbound_citations aeo.eeat.author_schema aeo.schema.article aeo.schema.howto geo.entity.name_consistency geo.entity.location",
    ("30d", "Medium", "Medium"): "aeo.eeat.author_byline seo.perf.lcp seo.perf.performance_score seo.index.crawl_depth seo.onpage.thin_pages seo.onpage.duplicate_content seo.perf.cls seo.perf.ttfb seo.perf.mobile_friendly aeo.eeat.freshness geo.entity.products",
    ("90d", "High", "High"): "geo.citation.third_party geo.citation.wikidata geo.content.statistics geo.content.original_research geo.citation.domain_authority ai.mention.rate ai.citation.rate ai.sov.share ai.mention.google_aio ai.citation.google_aio",
    ("90d", "High", "Medium"): "geo.content.comparisons",
    ("90d", "Low", "Low"): "geo.machine.llms_txt",
    ("90d", "Medium", "High"): "aeo.coverage.intent_spread ai.sentiment.quality",
    ("90d", "Medium", "Medium"): "geo.content.quotable geo.machine.entity_graph geo.entity.people geo.machine.schema_coverage geo.content.definitions geo.content.expert_commentary",
}
LIMITS = {"now": 6, "30d": 8, "90d": 8}
#: Severity of the translation of each check, where its status says nothing; the wording is ours.
TRANSLATIONS = {
    "geo.machine.ai_crawler_access": ("critical", "AI assistants may not read the site"), "aeo.schema.faq": ("critical", "Answers are not marked as answers"),
    "aeo.answer.direct_answer_proximity": ("critical", "Answers stand too far from their questions"), "geo.citation.third_party": ("critical", "Few others confirm what the site says"),
    "geo.citation.wikidata": ("warning", "No public record names the company"), "geo.entity.organization_schema": ("critical", "Machines must guess who the company is"),
    "aeo.coverage.question_gap": ("critical", "Customers' questions stay unanswered"), "seo.index.csr_dependency": ("critical", "Pages are empty without scripts"),
    "geo.content.comparisons": ("opportunity", "Comparisons are written by others"), "geo.content.statistics": ("opportunity", "There are no figures to quote"),
    "seo.onpage.content_depth": ("warning", "Pages are too short for the question"), "seo.index.noindex": ("critical", "Pages ask not to be listed"),
    "seo.perf.lcp": ("warning", "Pages load too slowly"), "aeo.eeat.author_byline": ("warning", "Nobody signs the advice"),
    "geo.entity.sameas": ("warning", "Profiles elsewhere are not connected"), "seo.index.canonical_host": ("critical", "The site competes with itself"),
}
MOST_TRANSLATIONS, MOST_COMPETITORS, MOST_SENTENCES = 5, 3, 4


def _by_check(values: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in values.items() for x in kv])


def recommendations(ranked: DataFrame) -> DataFrame:
    """``ranked``: audit_id, check_id, pillar, status, rank. The best ranked of each horizon, as many as it takes.

    What fails is urgent, and what is only an opportunity never is. A check without template is dropped.
    """
    template = {c: "|".join(kind) for kind, checks in TEMPLATES.items() for c in checks.split()}
    once = ranked.groupBy("audit_id", "check_id").agg(F.min_by(F.struct("pillar", "status"), "rank").alias("f"), F.min("rank").alias("rank")).select("audit_id", "check_id", "f.*", "rank")
    known = once.withColumn("_t", F.split(F.try_element_at(_by_check(template), F.col("check_id")), r"\|")).where("_t IS NOT NULL")
    usual = F.get("_t", F.lit(0))
    horizon = F.when((F.col("status") == "fail") & (usual == "30d"), "now").when((F.col("status") == "opportunity") & (usual == "now"), "30d").otherwise(usual)
    placed = known.withColumn("horizon", horizon).withColumn("place", F.row_number().over(Window.partitionBy("audit_id", "horizon").orderBy("rank")))
    limit = F.coalesce(*[F.when(F.col("horizon") == h, n) for h, n in LIMITS.items()])
    chosen = placed.where(F.col("place") <= limit)
    return chosen.select("audit_id", F.concat(F.lit("rec."), F.col("check_id")).alias("id"), "check_id", "pillar", "horizon", F.get("_t", F.lit(1)).alias("impact"), F.get("_t", F.lit(2)).alias("effort"), "rank", "place")


def translations(ranked: DataFrame, gaps: DataFrame | None = None) -> DataFrame:
    """The first findings of a site that have a translation. ``gaps``: audit_id, gaps, gaps_answered."""
    usual, headline = _by_check({c: s for c, (s, _) in TRANSLATIONS.items()}), _by_check({c: h for c, (_, h) in TRANSLATIONS.items()})
    known = ranked.where(F.col("check_id").isin(*TRANSLATIONS))
    known = known.withColumn("place", F.row_number().over(Window.partitionBy("audit_id").orderBy("rank"))).where(F.col("place") <= MOST_TRANSLATIONS)
    severity = F.when(F.col("status") == "fail", "critical").when(F.col("status") == "warn", "warning").otherwise(F.element_at(usual, F.col("check_id")))
    business = F.element_at(headline, F.col("check_id"))
    if gaps is not None:
        known = known.join(gaps.select("audit_id", (F.col("gaps") - F.col("gaps_answered")).alias("_open")), "audit_id", "left")
        told = F.concat(business, F.lit(": "), T.plural(F.col("_open"), "question"))
        business = F.when((F.col("check_id") == "aeo.coverage.question_gap") & (F.col("_open") > 0), told).otherwise(business)
    return known.select("audit_id", "check_id", business.alias("business"), severity.alias("severity"), "place")


def comparison(audits: DataFrame) -> DataFrame:
    """``audits``: audit_id, parent_id (null for own sites), ord, host, status, seo, aeo, geo, overall. Own and competitors' scores side by side."""
    own = audits.where("parent_id IS NULL").select("audit_id", *[F.col(c).alias(f"own_{c}") for c in ("seo", "aeo", "geo", "overall")])
    return audits.where("parent_id IS NOT NULL").select(F.col("parent_id").alias("audit_id"), "ord", "host", "status", "seo", "aeo", "geo", "overall").join(own, "audit_id")


def insights(compared: DataFrame, gaps: DataFrame) -> DataFrame:
    """What the first competitors with a score show, one sentence each, and how many questions stay open."""
    valid = compared.where("status = 'ok' AND overall IS NOT NULL")
    placed = valid.withColumn("place", F.row_number().over(Window.partitionBy("audit_id").orderBy("ord"))).where(F.col("place") <= MOST_COMPETITORS)
    d = {c: F.coalesce(f"own_{c}", F.lit(0)) - F.coalesce(c, F.lit(0)) for c in ("seo", "aeo", "geo", "overall")}
    kind = (
        F.when((d["seo"] > 8) & (d["geo"] < -8), "ahead technically, behind as an entity").when((d["geo"] > 8) & (d["seo"] < -8), "behind technically, ahead as an entity")
        .when(d["aeo"] < -10, "behind in answers").when(d["overall"] < -10, "behind overall").when(d["overall"] > 10, "ahead overall")
    )
    sentences = placed.withColumn("kind", kind).where("kind IS NOT NULL").select("audit_id", "place", F.concat("host", F.lit(": "), F.col("kind")).alias("sentence"))
    open_ = gaps.select("audit_id", (F.col("gaps") - F.col("gaps_answered")).alias("n")).where("n > 0").join(valid.select("audit_id").distinct(), "audit_id", "left_semi")
    last = open_.select("audit_id", F.lit(MOST_COMPETITORS + 1).alias("place"), F.concat(T.plural(F.col("n"), "question"), F.lit(" unanswered")).alias("sentence"))
    every = sentences.unionByName(last)
    order = Window.partitionBy("audit_id").orderBy("place")
    return every.withColumn("place", F.row_number().over(order)).where(F.col("place") <= MOST_SENTENCES)


def verdict(scores: DataFrame) -> DataFrame:
    """Three sentences about a site: its band, its best and its worst pillar. ``scores``: audit_id, overall, band, pillars map."""
    pairs = F.filter(F.transform(F.map_entries("pillars"), lambda e: F.struct(e["value"].alias("score"), e["key"].alias("pillar"))), lambda p: p["score"].isNotNull())
    best, worst = F.array_max(pairs), F.array_min(pairs)
    first = F.concat(F.lit("Overall "), F.col("overall").cast("string"), F.lit(" of 100, band "), F.col("band"), F.lit("."))
    return scores.select("audit_id", F.concat_ws(" ", first, F.concat(F.lit("Strongest: "), best["pillar"], F.lit(".")), F.concat(F.lit("Weakest: "), worst["pillar"], F.lit("."))).alias("verdict"))


def rewritten(translated: DataFrame, rewrites: DataFrame) -> DataFrame:
    """Business wording from ``rewrites`` (audit_id, check_id, text) where there is some."""
    joined = translated.join(rewrites.select("audit_id", "check_id", "text"), ["audit_id", "check_id"], "left")
    return joined.withColumn("business", F.coalesce("text", "business")).drop("text")


# Reading a report


def findings_by_status(findings: DataFrame) -> DataFrame:
    """How many findings of each status, in the order a report shows them."""
    order = F.coalesce(*[F.when(F.col("status") == s, i) for i, s in enumerate(("fail", "warn", "opportunity", "pass", "not_applicable", "unavailable"))])
    return findings.groupBy("audit_id", "status").agg(F.count("*").alias("n")).withColumn("place", order)


def by_horizon(plan: DataFrame) -> DataFrame:
    return plan.groupBy("audit_id", "horizon").agg(F.count("*").alias("n"), F.transform(F.sort_array(F.collect_list(F.struct("place", "check_id"))), lambda p: p["check_id"]).alias("checks"))


def chart_rows(compared: DataFrame) -> DataFrame:
    """A row for each shown competitor and measure."""
    shown = compared.where("status = 'ok'").withColumn("place", F.row_number().over(Window.partitionBy("audit_id").orderBy("ord"))).where(F.col("place") <= MOST_COMPETITORS)
    return shown.unpivot(["audit_id", "host"], ["seo", "aeo", "geo", "overall"], "measure", "score")


def competitor_states(compared: DataFrame) -> DataFrame:
    return compared.groupBy("audit_id").agg(F.count_if(F.col("status") == "ok").alias("ok"), F.count_if(F.col("status") != "ok").alias("failed"))


def not_measured(findings: DataFrame) -> DataFrame:
    """Groups of which nothing could be measured."""
    gone = findings.groupBy("audit_id", "pillar", "group").agg(F.count_if(S.is_scored(F.col("status"))).alias("n"), F.count_if(F.col("status") == "unavailable").alias("missing"))
    return gone.where("n = 0 AND missing > 0").select("audit_id", "pillar", "group", "missing")


def evidence_line(evidence: Column, most: int = 3) -> Column:
    """The first evidence items of a finding as one line. Items: kind, label, value, of, unit, url, values."""

    def shown(e: Column) -> Column:
        amount = F.concat_ws("", e["value"], F.when(e["of"].isNotNull(), F.concat(F.lit(" of "), e["of"])), e["unit"])
        text = F.when(e["kind"] == "url", e["url"]).when(e["kind"] == "list", F.array_join(F.slice(e["values"], 1, most), ", ")).otherwise(amount)
        return F.concat_ws(": ", F.nullif(e["label"], F.lit("")), text)

    return F.array_join(F.transform(F.slice(evidence, 1, most), shown), "; ")


def cli_summary(pillars: DataFrame, plan: DataFrame, gaps: DataFrame, most: int = 8) -> DataFrame:
    """Pillar scores, urgent actions and the first open questions of a site."""
    scores = pillars.groupBy("audit_id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("pillar", "score")))).alias("pillars"))
    now = by_horizon(plan.where("horizon = 'now'")).select("audit_id", F.col("checks").alias("now"))
    open_ = gaps.where("NOT answered").groupBy("audit_id").agg(F.transform(F.slice(F.sort_array(F.collect_list(F.struct("rank", "question"))), 1, most), lambda q: q["question"]).alias("unanswered"))
    return scores.join(now, "audit_id", "left").join(open_, "audit_id", "left")
