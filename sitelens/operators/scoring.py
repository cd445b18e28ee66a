"""Confidence-weighted roll-up of findings: groups, pillars, overall, ranking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Weights of pillars and groups, gating checks and bands.
PILLARS = {"seo": 0.30, "aeo": 0.25, "geo": 0.30, "ai": 0.15}
GROUPS = {
    "seo.index": 26, "seo.onpage": 24, "seo.perf": 20, "seo.schema": 16, "seo.links": 14, "aeo.answer": 34, "aeo.schema": 24, "aeo.eeat": 24, "aeo.coverage": 18,
    "geo.entity": 30, "geo.citation": 28, "geo.content": 24, "geo.machine": 18, "ai.mention": 40, "ai.citation": 30, "ai.sov": 20, "ai.sentiment": 10,
}
GATING = ("seo.index.robots_txt", "seo.index.noindex", "seo.index.https", "seo.index.status_code", "seo.index.canonical_host", "seo.index.csr_dependency", "geo.machine.ai_crawler_access")
COMPOSITES = {"google_visibility": {"seo": 0.65, "aeo": 0.35}, "ai_measured": {"geo": 0.6, "aeo": 0.25, "ai": 0.15}, "ai_estimated": {"geo": 0.7, "aeo": 0.3}}
SCORING_VERSION = "1.0.0"
BANDS = ((85, "A"), (70, "B"), (55, "C"), (35, "D"))
MIN_COVERAGE, PARTIAL_COVERAGE = 0.5, 0.7


def _lookup(key: Column, values: dict, default: float) -> Column:
    out = F.lit(float(default))
    for name, value in values.items():
        out = F.when(key == name, float(value)).otherwise(out)
    return out


def half_up(x: Column) -> Column:
    return F.floor(x + 0.5)


def settled(x: Column) -> Column:
    """Without the last places, which depend on the order in which doubles were added, so that a half is one in every order."""
    return F.round(x, 9)


def band(score: Column) -> Column:
    out = F.lit("E")
    for least, name in reversed(BANDS):
        out = F.when(score >= least, name).otherwise(out)
    return out


def is_scored(status: Column) -> Column:
    return ~status.isin("unavailable", "not_applicable")


def group_scores(findings: DataFrame) -> DataFrame:
    scored = is_scored(F.col("status"))
    weight = F.when(scored, F.col("weight") * F.col("confidence"))
    total = F.sum(weight)
    score = F.when(total > 0, F.sum(weight * F.col("score")) / total).otherwise(0.0)
    all_weight = F.sum("weight")
    coverage = F.when(all_weight > 0, F.sum(F.when(scored, F.col("weight")).otherwise(0.0)) / all_weight).otherwise(0.0)
    return findings.groupBy("audit_id", "pillar", "group").agg(score.alias("score"), coverage.alias("coverage")).withColumn("group_weight", _lookup(F.col("group"), GROUPS, 10))


def pillar_scores(groups: DataFrame) -> DataFrame:
    live = F.when(F.col("coverage") > 0, F.col("group_weight"))
    coverage = F.sum(F.col("coverage") * F.col("group_weight")) / F.sum("group_weight")
    mean = F.sum(live * F.col("score")) / F.sum(live)
    rolled = groups.groupBy("audit_id", "pillar").agg(coverage.alias("coverage"), mean.alias("_m"))
    return rolled.select("audit_id", "pillar", "coverage", F.when(F.col("coverage") >= MIN_COVERAGE, half_up(settled(F.col("_m") * 100))).alias("score"))


def partial(coverage: Column) -> Column:
    """Whether a score that is shown rests on part of its checks only."""
    return (coverage >= MIN_COVERAGE) & (coverage < PARTIAL_COVERAGE)


def overall_scores(pillars: DataFrame) -> DataFrame:
    weight = F.when(F.col("score").isNotNull(), _lookup(F.col("pillar"), PILLARS, 0))
    rolled = pillars.groupBy("audit_id").agg(F.coalesce(half_up(settled(F.sum(weight * F.col("score")) / F.sum(weight))), F.lit(0)).alias("overall"))
    return rolled.withColumn("band", band(F.col("overall"))).withColumn("scoring_version", F.lit(SCORING_VERSION))


def applied_weights(pillars: DataFrame) -> DataFrame:
    """audit_id, weights: the share that each pillar has in the overall score, 0 for those without score."""
    weight = F.when(F.col("score").isNotNull(), _lookup(F.col("pillar"), PILLARS, 0)).otherwise(0.0)
    by = pillars.groupBy("audit_id").agg(F.sum(weight).alias("_all"), *[F.coalesce(F.max(F.when(F.col("pillar") == p, weight)), F.lit(0.0)).alias(p) for p in PILLARS])
    shares = [x for p in PILLARS for x in (F.lit(p), F.when(F.col("_all") > 0, F.col(p) / F.col("_all")).otherwise(0.0))]
    return by.select("audit_id", F.create_map(*shares).alias("weights"))


def measured_note(mode: Column, weights: Column) -> Column:
    """What a reader has to know about how the overall score came about."""
    used = F.size(F.filter(F.map_values(weights), lambda w: w > 0)).cast("string")
    left_out = F.concat(F.lit("Made from "), used, F.lit(f" of {len(PILLARS)} pillars; what AI systems answer was not measured and is left out."))
    return F.when(mode == "C", left_out).when(mode == "B", "AI presence comes from overviews of the search engine alone.").otherwise("All pillars are measured.")


def composite_scores(pillars: DataFrame) -> DataFrame:
    """Google and AI visibility; a pillar without score counts as 0 here, and AI visibility is estimated where its pillar has none."""
    by = {p: F.max(F.when(F.col("pillar") == p, F.col("score"))) for p in PILLARS}
    wide = pillars.groupBy("audit_id").agg(*[c.alias(p) for p, c in by.items()])

    def of(name: str) -> Column:
        return half_up(sum((F.coalesce(p, F.lit(0)) * w for p, w in COMPOSITES[name].items()), F.lit(0.0)))

    ai = F.when(F.col("ai").isNotNull(), of("ai_measured")).otherwise(of("ai_estimated"))
    return wide.select("audit_id", of("google_visibility").alias("google_visibility"), ai.alias("ai_visibility"), F.col("ai").isNotNull().alias("ai_is_measured"))


def status_counts(findings: DataFrame) -> DataFrame:
    """Findings of each status as columns."""
    states = ("pass", "warn", "fail", "opportunity", "unavailable", "not_applicable")
    return findings.groupBy("audit_id").agg(*[F.count_if(F.col("status") == s).alias(s) for s in states])


def rank_findings(findings: DataFrame) -> DataFrame:
    severity = F.when(F.col("status") == "fail", F.when(F.col("check_id").isin(*GATING), -1).otherwise(0)).when(F.col("status") == "warn", 1).otherwise(2)
    # Sums in another order may differ in the last places; they tie all the same.
    gain = F.round((1 - F.col("score")) * F.col("weight") * F.col("confidence") * _lookup(F.col("group"), GROUPS, 10) * _lookup(F.col("pillar"), PILLARS, 0.25), 9)
    chosen = findings.where(F.col("status").isin("fail", "warn", "opportunity")).withColumn("severity", severity).withColumn("recoverable", gain)
    order = Window.partitionBy("audit_id").orderBy("severity", F.desc("recoverable"), "check_ord")
    return chosen.withColumn("rank", F.row_number().over(order))


def grade_status(score: Column, fail_below: float = 0.4, warn_below: float = 0.8) -> Column:
    return F.when(score < fail_below, "fail").when(score < warn_below, "warn").otherwise("pass")
