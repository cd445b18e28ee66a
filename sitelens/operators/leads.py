"""Lead scores, the lead dashboard, administration counters and access rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitelens.functions import maths as M
from sitelens.functions import urls as U
from sitelens.functions.columns import trim

#: Mail hosts anyone can use, markets, and the least score of each grade.
FREE_MAIL = (
    "gmail.com googlemail.com yahoo.com yahoo.co.in outlook.com hotmail.com live.com aol.com icloud.com me.com proton.me protonmail.com gmx.com yandex.com mail.com zoho.com rediffmail.com"
).split()
MARKETS = ("global", "us", "in", "uk", "ae", "au", "ca", "sg")
#: Country and language that a search engine is asked for, where they are not the market's own code and English.
COUNTRIES, LANGUAGE = {"global": "us", "uk": "gb"}, "en"
GRADES = ((70, "A"), (55, "B"), (40, "C"))


def search_region(market: Column) -> Column:
    """Struct of country (gl) and language (hl) for a market; an unknown one is global."""
    known = F.when(market.isin(*MARKETS), market).otherwise("global")
    named = F.coalesce(*[F.when(known == m, c) for m, c in COUNTRIES.items()], known)
    return F.struct(named.alias("gl"), F.lit(LANGUAGE).alias("hl"))


def grade(score: Column) -> Column:
    return F.coalesce(*[F.when(score >= least, name) for least, name in GRADES], F.lit("D"))


def lead_scores(signals: DataFrame) -> DataFrame:
    """Adds score, grade and factors to rows of email, host, overall, pages_discovered, page_rank, has_entity, top_citations, has_competitors, has_budget."""
    domain = U.email_domain(F.col("email"))
    free = domain.isin(*FREE_MAIL)
    own = ~free & (domain != "") & (U.registrable(domain) == U.registrable(F.col("host")))

    def worth(condition: Column, value: float) -> Column:
        return F.when(condition, value).otherwise(0.0)

    size = M.log_scaled(F.col("pages_discovered"))
    pain = M.clamp01((100 - F.col("overall")) / 100)
    equity = F.least(F.lit(1.0), F.coalesce("page_rank", F.lit(0.0)) / 10 * 0.6 + worth(F.col("has_entity"), 0.25) + worth(F.col("top_citations") > 0, 0.15))
    intent = F.least(F.lit(1.0), worth(F.col("has_competitors"), 0.25) + worth(own, 0.45) + worth(F.col("has_budget"), 0.3))
    parts = signals.withColumns({"size": size, "pain": pain, "equity": equity, "intent": intent, "is_free_email": free, "email_matches_domain": own})
    score = M.half_up(100 * (0.3 * F.col("size") + 0.3 * F.col("pain") + 0.25 * F.col("equity") + 0.15 * F.col("intent")))
    return parts.withColumn("lead_score", score).withColumn("grade", grade(F.col("lead_score")))


def signals_from_findings(findings: DataFrame, cited: DataFrame) -> DataFrame:
    """What a lead's score takes from an audit: recognised entity, and citations of the first three tiers."""
    entity = findings.groupBy("audit_id").agg(F.max(F.when((F.col("check_id") == "geo.citation.wikidata") & (F.col("status") == "pass"), True).otherwise(False)).alias("has_entity"))
    top = cited.where("tier <= 3").groupBy("audit_id").agg(F.count("*").alias("top_citations"))
    return entity.join(top, "audit_id", "left").fillna(0, ["top_citations"])


def lead_dashboard(leads: DataFrame, audits: DataFrame, appointments: DataFrame) -> DataFrame:
    """Leads with the scores of their audit, and whether they booked."""
    booked = appointments.select("lead_id").where("lead_id IS NOT NULL").distinct().withColumn("has_booking", F.lit(True))
    joined = leads.join(audits.withColumnRenamed("id", "audit_id"), "audit_id", "left").join(booked.withColumnRenamed("lead_id", "id"), "id", "left")
    return joined.withColumn("has_booking", F.coalesce("has_booking", F.lit(False)))


def admin_counters(audits: DataFrame) -> DataFrame:
    """Audits, completed ones, and different people by mail address whatever its case."""
    return audits.agg(F.count("*").alias("audits"), F.count_if(F.col("status") == "complete").alias("completed"), F.count_distinct(F.lower("email")).alias("people"))


def owned_by(audits: DataFrame, email: str) -> DataFrame:
    """Only the audits of one person; nobody's without an address."""
    return audits.where(F.lower("email") == (email or "").strip().lower()).where(F.lit(bool((email or "").strip())))


def is_admin(email: Column, allowlist: str) -> Column:
    """Whether an address is in a comma-separated list; an empty list admits nobody."""
    names = [n.strip().lower() for n in allowlist.split(",") if n.strip()]
    return F.coalesce(F.lower(trim(email)).isin(*names), F.lit(False)) if names else F.lit(False)


def may_set_up_schema(email: Column, allowlist: str, ready: bool) -> Column:
    """The schema may be made by an administrator, and by anyone known while there is none."""
    return F.coalesce(email != "", F.lit(False)) & (is_admin(email, allowlist) | F.lit(not ready))


def shown_result(audits: DataFrame) -> DataFrame:
    """Results only of finished audits."""
    return audits.withColumn("result", F.when(F.col("status") == "complete", F.col("result")))


def invalid_requests(requests: DataFrame) -> DataFrame:
    """Requests (url, market, competitors array) that may not start an audit, with the reason."""
    reason = (
        F.when(F.col("url").isNull() | (F.char_length("url") < 3), "url is too short").when(F.char_length("url") > 2048, "url is too long").when(~F.coalesce("market", F.lit("global")).isin(*MARKETS), "unknown market")
        .when(F.size("competitors") > 3, "more than three competitors").when(F.exists("competitors", lambda c: F.char_length(c) > 2048), "a competitor is too long").when(U.normalise_input(F.col("url")).isNull(), "url is no public address")
    )
    return requests.withColumn("reason", reason).where("reason IS NOT NULL")


def tone(score: Column) -> Column:
    """Name of the colour of a score."""
    return F.when(score >= 70, "good").when(score >= 55, "warning").when(score >= 35, "serious").otherwise("critical")
