"""Evidence from outside a site: citations by tier, overviews of search engines, sampled answers, question gaps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sitelens.functions import text as T
from sitelens.functions import urls as U
from sitelens.functions.columns import trim

#: Tiers of citing hosts with weight and label; all other hosts are of the last tier, whose sum is capped.
TIERS = (
    (1, 1.0, "Wikipedia / Wikidata", "wikipedia.org wikidata.org"),
    (2, 0.85, "Major press / .edu / .gov", "nytimes.com wsj.com ft.com bbc.co.uk reuters.com bloomberg.com forbes.com economictimes.indiatimes.com business-standard.com thehindu.com"),
    (3, 0.7, "Industry publications", "techcrunch.com searchengineland.com searchenginejournal.com wired.com venturebeat.com theverge.com gartner.com inc.com"),
    (4, 0.55, "Review platforms", "g2.com capterra.com trustpilot.com getapp.com softwareadvice.com producthunt.com glassdoor.com"),
    (5, 0.45, "Community & Q&A", "reddit.com quora.com stackexchange.com stackoverflow.com news.ycombinator.com"),
    (6, 0.35, "Owned social & profiles", "linkedin.com youtube.com github.com crunchbase.com x.com twitter.com facebook.com instagram.com"),
)
LAST_TIER, LAST_WEIGHT, LAST_LABEL = 7, 0.15, "Directories & aggregators"
#: How much a question of each intent is worth, and the questions asked of every brand ({s} subject, {n} name).
INTENT_VALUES = {"comparison": 1.0, "best_for": 0.9, "pricing": 0.8, "how_to": 0.6, "what_is": 0.5}
QUESTIONS = (
    ("What is {s}?", "what_is"), ("How does {s} work?", "what_is"), ("What should I look for when choosing {s}?", "best_for"), ("Who are the best providers of {s}?", "best_for"),
    ("Is {n} any good?", "best_for"), ("What are the alternatives to {n}?", "comparison"), ("How does {n} compare to other providers?", "comparison"), ("What are the pros and cons of {s}?", "comparison"),
    ("How much does {s} cost?", "pricing"), ("Is {s} worth the money?", "pricing"), ("How do I get started with {s}?", "how_to"), ("How long does {s} take?", "how_to"),
    ("What mistakes should I avoid with {s}?", "how_to"), ("Who needs {s}?", "best_for"),
)
PROMPTS = ("best {s}{r}", "top {s} companies{r}", "how to choose {s}", "{s} alternatives", "what is the best {s} for a small business", "{s} pricing comparison")
ANSWERED, EXACT = 0.6, 0.7


def _filled(template: str, **parts: Column) -> Column:
    """A template with its {names} replaced by columns."""
    out = F.lit(template)
    for name, value in parts.items():
        out = F.replace(out, F.lit("{" + name + "}"), value)
    return out


def tier(host: Column) -> Column:
    """Tier of a citing host: the first that lists its registrable domain, or a domain above it."""
    site = U.registrable(host)
    return F.coalesce(*[F.when(site.isin(*hosts.split()) | F.lit(False), number) for number, _, _, hosts in TIERS], F.lit(LAST_TIER))


def tier_weight(number: Column) -> Column:
    return F.coalesce(*[F.when(number == n, w) for n, w, _, _ in TIERS], F.lit(LAST_WEIGHT))


def tier_label(number: Column) -> Column:
    return F.coalesce(*[F.when(number == n, label) for n, _, label, _ in TIERS], F.lit(LAST_LABEL))


def citations(hits: DataFrame) -> DataFrame:
    """``hits``: audit_id, ord, host (the audited one), url. One citation for each citing site, its best tier first; own pages do not count."""
    found = hits.withColumn("source_host", U.host(F.col("url"))).where("source_host <> ''").withColumn("site", U.registrable(F.col("source_host")))
    found = found.where(F.col("site") != U.registrable(F.col("host"))).withColumn("tier", tier(F.col("source_host")))
    best = found.groupBy("audit_id", "site").agg(F.min("tier").alias("tier"), F.min_by("url", F.struct("tier", "ord")).alias("url"))
    return best.withColumn("source", tier_label(F.col("tier")))


def citation_weights(cited: DataFrame) -> DataFrame:
    """Sum of weights of tiers above the last, and of the last, which the check caps. They are added as decimals, so that no order of rows matters."""
    last = F.col("tier") == LAST_TIER
    weight = tier_weight(F.col("tier")).cast("decimal(20,2)")
    return cited.groupBy("audit_id").agg(F.sum(F.when(last, 0).otherwise(weight)).cast("double").alias("tier_weight"), F.sum(F.when(last, weight).otherwise(0)).cast("double").alias("tier7_weight"))


def tier_histogram(cited: DataFrame) -> DataFrame:
    return cited.groupBy("audit_id", "tier").count()


def overviews(results: DataFrame) -> DataFrame:
    """``results``: audit_id, host, brand, overview struct<present, text, cited_domains>, null where none was asked for."""
    o = F.col("overview")
    own = F.exists(o["cited_domains"], lambda d: U.registrable(d) == U.registrable(F.col("host"))) | F.contains(F.lower(o["text"]), F.lower("brand"))
    seen = results.groupBy("audit_id").agg(
        F.count_if(o.isNotNull()).alias("aio_checked"), F.count_if(o["present"]).alias("aio_present"), F.count_if(o["present"] & F.coalesce(own, F.lit(False))).alias("aio_cites"),
        F.size(F.array_distinct(F.flatten(F.collect_list(F.when(o["present"], o["cited_domains"]))))).cast("bigint").alias("aio_domains"),
    )
    return seen


def within_budget(calls: DataFrame, order: list[str], budget: int, key: str = "audit_id") -> DataFrame:
    """The first ``budget`` calls of each audit; the rest are never made."""
    turn = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    return calls.withColumn("_turn", turn).where(F.col("_turn") <= budget).drop("_turn")


def mentions(answers: DataFrame) -> DataFrame:
    """``answers``: audit_id, engine, prompt, sample_index, answer, cited_domains, brand, host, rivals. Adds how each treats the brand."""
    seen = T.mention(F.col("answer"), F.col("brand"), F.col("host"), F.col("rivals"), F.col("cited_domains"))
    return answers.withColumn("_m", seen).select("audit_id", "engine", "prompt", "sample_index", "cited_domains", "_m.*")


def answer_summary(mentioned: DataFrame) -> DataFrame:
    """Counts of a site's sampled answers and its share of voice in percent."""
    named = F.col("brand_mentioned")
    own, rivals = F.count_if(named), F.coalesce(F.sum(F.size("competitors_mentioned")), F.lit(0))
    return mentioned.groupBy("audit_id").agg(
        F.count("*").alias("ai_samples"), own.alias("ai_mentioned"), F.count_if("cited_brand_domain").alias("ai_cited"), F.coalesce(F.try_divide(own * 100.0, own + rivals), F.lit(0.0)).alias("voice_pct"),
        F.count_if(named & (F.col("sentiment") == "positive")).alias("ai_positive"), F.count_if(named & (F.col("sentiment") == "negative")).alias("ai_negative"), F.avg(F.when(named, F.col("ordinal"))).alias("mean_ordinal"),
    )


# Questions


def template_questions(brands: DataFrame) -> DataFrame:
    """``brands``: audit_id, name, category, top_term. The questions of each brand, in order, with intent and value."""
    bare = F.regexp_replace("category", r"(?i)^(we are|we're|a|an|the)\s+", "")
    subject = F.array_join(F.slice(F.split(F.coalesce(bare, "top_term", F.lit("this service")), r"\s+"), 1, 5), " ")
    rows = [F.struct(F.lit(i).alias("q_ord"), _filled(q, s=F.col("_s"), n=F.col("name")).alias("question"), F.lit(intent).alias("intent"), F.lit(INTENT_VALUES[intent]).alias("value")) for i, (q, intent) in enumerate(QUESTIONS)]
    return brands.withColumn("_s", subject).select("audit_id", F.inline(F.array(*rows)))


def prompts(brands: DataFrame, market: str = "global") -> DataFrame:
    """The prompts sampled for each brand; none without category and top term."""
    subject = trim(F.array_join(F.slice(F.split(F.coalesce("category", "top_term", F.lit("")), r"\s+"), 1, 6), " "))
    region = F.lit("" if market in ("", "global") else f" in {market.upper()}")
    rows = [F.struct(F.lit(i).alias("p_ord"), _filled(p, s=F.col("_s"), r=region).alias("prompt")) for i, p in enumerate(PROMPTS)]
    return brands.withColumn("_s", subject).where("_s <> ''").select("audit_id", F.inline(F.array(*rows)))


def question_gaps(questions: DataFrame, signals: DataFrame) -> DataFrame:
    """Which questions the best matching page of a site answers; the first of equally good pages counts.

    Pages meet a question only through a term that both have; a question without a page that shares a term
    is unanswered all the same.
    """
    terms = questions.withColumn("terms", T.content_tokens(F.col("question")))
    heads = F.array_join(F.transform("headings", lambda h: h["text"]), " ")
    pages = signals.where("status_code BETWEEN 200 AND 299").select(
        "audit_id", "page_ord", "url", F.array_distinct(T.content_tokens(heads)).alias("in_heads"), F.array_distinct(T.content_tokens(F.concat_ws(" ", F.coalesce("title", F.lit("")), "excerpt"))).alias("in_body"),
        F.transform("question_headings", lambda q: T.content_tokens(F.lower(q["text"]))).alias("asked"),
    )
    words = pages.select("audit_id", "page_ord", F.explode(F.array_distinct(F.concat("in_heads", "in_body", F.flatten("asked")))).alias("term"))
    wanted = terms.select("audit_id", "q_ord", F.explode(F.array_distinct("terms")).alias("term"))
    meet = wanted.join(words, ["audit_id", "term"]).select("audit_id", "q_ord", "page_ord").distinct()
    both = meet.join(terms.select("audit_id", "q_ord", "terms"), ["audit_id", "q_ord"]).join(pages, ["audit_id", "page_ord"])

    def share(found: Column) -> Column:
        return F.size(F.filter("terms", lambda t: F.array_contains(found, t))) / F.size("terms")

    exact = F.exists("asked", lambda q: F.size(F.filter("terms", lambda t: F.array_contains(q, t))) / F.size("terms") >= EXACT)
    scored = both.withColumn("score", F.when(exact, 1.0).otherwise(share(F.col("in_heads")) * 0.7 + share(F.col("in_body")) * 0.3))
    best = scored.groupBy("audit_id", "q_ord").agg(F.max("score").alias("score"), F.max_by("url", F.struct("score", -F.col("page_ord"))).alias("url"))
    answered = F.coalesce(F.col("score") >= ANSWERED, F.lit(False))
    joined = questions.join(best, ["audit_id", "q_ord"], "left")
    return joined.select("audit_id", "q_ord", "question", "intent", "value", answered.alias("answered"), F.when(answered, F.col("url")).alias("matched_url"))


def ranked_gaps(gaps: DataFrame) -> DataFrame:
    """Unanswered questions first, dear ones first."""
    order = Window.partitionBy("audit_id").orderBy("answered", F.desc("value"), "q_ord")
    return gaps.withColumn("rank", F.row_number().over(order))


def gap_counts(gaps: DataFrame) -> DataFrame:
    return gaps.groupBy("audit_id").agg(F.count("*").alias("gaps"), F.count_if("answered").alias("gaps_answered"))


# Other providers


def performance(reports: DataFrame) -> DataFrame:
    """``reports``: audit_id, score, field and lab structs of lcp_ms, cls, ttfb_ms (field cls in hundredths), audits map. Field data first."""
    f, b = F.col("field"), F.col("lab")
    scores = F.filter(F.array(*[F.try_element_at("audits", F.lit(a)) for a in ("viewport", "font-size", "tap-targets")]), lambda s: s.isNotNull())
    mean = F.when(F.size(scores) > 0, F.aggregate(scores, F.lit(0.0), lambda a, s: a + s) / F.size(scores))
    return reports.select(
        "audit_id", F.when(f.isNotNull(), "field").otherwise("lab").alias("performance_source"), F.col("score").cast("double").alias("performance_score"), F.coalesce(f["lcp_ms"], b["lcp_ms"]).alias("lcp_ms"),
        F.coalesce(f["cls"] / 100, b["cls"]).alias("cls"), F.coalesce(f["ttfb_ms"], b["ttfb_ms"]).alias("ttfb_ms"), mean.alias("mobile_score"),
    )


def entities(targets: DataFrame, candidates: DataFrame, most: int = 5) -> DataFrame:
    """``targets``: audit_id, host; ``candidates``: audit_id, ord, qid, websites, wikipedia_url. A candidate counts if one of its websites is the site's host."""
    bare = F.regexp_replace("host", r"^www\.", "")
    own = F.exists("websites", lambda w: F.regexp_replace(U.host(w), r"^www\.", "") == bare)
    found = candidates.where(F.col("ord") < most).join(targets, "audit_id").where(own).groupBy("audit_id").agg(F.min_by("qid", "ord").alias("qid"), F.min_by("wikipedia_url", "ord").alias("wikipedia_url"))
    asked = candidates.select("audit_id").distinct().withColumn("entity_checked", F.lit(True))
    return asked.join(found, "audit_id", "left")


def authorities(targets: DataFrame, ranks: DataFrame) -> DataFrame:
    """``ranks``: host, page_rank (null where none is known). Joined on the host without www."""
    known = ranks.select(F.regexp_replace("host", r"^www\.", "").alias("bare"), "page_rank").groupBy("bare").agg(F.max("page_rank").alias("page_rank"))
    return targets.withColumn("bare", F.regexp_replace("host", r"^www\.", "")).join(known, "bare", "left").select("audit_id", "page_rank")


def available(data: Column, reason: Column) -> Column:
    """Data, or why there is none."""
    return F.struct(data.isNotNull().alias("available"), F.when(data.isNull(), reason).alias("reason"), data.alias("data"))
