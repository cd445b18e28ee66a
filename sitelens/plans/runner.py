"""One audit from request to report, for many sites at once, in stages that can be taken up again.

Inputs are tables; those marked with a star may be missing, and what rests on them is then unavailable.

- ``requests``: audit_id, url, market, competitors (array of addresses, the first three count).
- ``fetches``: audit_id, page_ord (null for files of the root), url, final_url, depth, status_code, content_type,
  error, redirect_chain, body. Fetches of the n-th competitor of an audit bear ``<audit_id>#<n>``.
- ``speed``*, ``candidates``*, ``ranks``*, ``hits``*, ``searches``*, ``answers``*: as the functions of ``evidence`` read them.
- ``questions``*: audit_id, q_ord, question, intent, value in place of the templates. ``rewrites``*: audit_id, check_id, text.

A competitor is an audit of its own by the same checks, without evidence from outside. A site of which nothing
could be read, or only the page of a bot protection, is refused and never scored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sitelens.functions import text as T
from sitelens.functions import urls as U
from sitelens.operators import catalogue as C
from sitelens.operators import discovery as D
from sitelens.operators import evidence as E
from sitelens.operators import findings as R
from sitelens.operators import html as H
from sitelens.operators import leads as G
from sitelens.operators import plan as P
from sitelens.operators import scoring as S
from sitelens.operators import site as L
from sitelens.sources.pdf import report_lines, reports
from sitelens.sources.stages import Stages, Tables
from sitelens.sources.tables import audit_result

PAGES, COMPETITOR_PAGES, COMPETITORS = 25, 10, 3
BLOCKED = (401, 403, 429, 503)


def _child(t: Tables) -> DataFrame:
    """Audits and their competitors: audit_id, parent_id, ord, typed, url (null where it is no public address)."""
    own = t["requests"].select("audit_id", F.lit(None).cast("string").alias("parent_id"), F.lit(0).alias("ord"), F.col("url").alias("typed"))
    listed = F.slice(F.filter(F.coalesce("competitors", F.array().cast("array<string>")), lambda c: c != ""), 1, COMPETITORS)
    rivals = t["requests"].select(F.col("audit_id").alias("parent_id"), F.posexplode(listed).alias("n", "typed"))
    rivals = rivals.select(F.concat("parent_id", F.lit("#"), (F.col("n") + 1).cast("string")).alias("audit_id"), "parent_id", (F.col("n") + 1).alias("ord"), "typed")
    return own.unionByName(rivals).withColumn("url", U.normalise_input(F.col("typed")))


def requests(t: Tables) -> Tables:
    """Requests that can be served, with their competitors, and why the others cannot."""
    bad = G.invalid_requests(t["requests"])
    good = dict(t, requests=t["requests"].join(bad.select("audit_id"), "audit_id", "left_anti"))
    region = G.search_region(F.col("market"))
    return {"targets": _child(good).join(good["requests"].select(F.col("audit_id").alias("_id"), F.coalesce("market", F.lit("global")).alias("market"), region.alias("region")), F.coalesce("parent_id", "audit_id") == F.col("_id")).drop("_id"), "rejected": bad.select("audit_id", "reason")}


def _sites(t: Tables) -> DataFrame:
    return t["targets"].where("url IS NOT NULL").select("audit_id", "url")


def discovery(t: Tables) -> Tables:
    """What each site says of itself, its robots rules and what they let crawlers read."""
    home = t["fetches"].join(_sites(t).select("audit_id"), "audit_id", "left_semi")
    # The address that was asked for is the homepage's, however it was typed.
    first = home.where("page_ord IS NOT NULL").groupBy("audit_id").agg(F.min_by("url", F.struct(F.col("depth") != 0, "page_ord")).alias("_home"))
    targets = _sites(t).join(first, "audit_id", "left").select("audit_id", F.coalesce("_home", "url").alias("url"))
    found = D.discover(targets, home)
    files = D.robots_files(home, found.select("audit_id", "origin"))
    return {"discovery": found, "crawlers": D.crawler_matrix(D.robots_rules(files.where("found")), files)}


def crawl(t: Tables) -> Tables:
    """Signals of each site's first pages."""
    most = F.when(F.contains("audit_id", F.lit("#")), COMPETITOR_PAGES).otherwise(PAGES)
    pages = t["fetches"].where("page_ord IS NOT NULL").join(_sites(t).select("audit_id"), "audit_id", "left_semi")
    turn = F.row_number().over(Window.partitionBy("audit_id").orderBy("page_ord"))
    kept = pages.select("audit_id", "page_ord").distinct().withColumn("_turn", turn).where(F.col("_turn") <= most).drop("_turn")
    return {"signals": H.page_signals(pages.join(kept, ["audit_id", "page_ord"], "left_semi").withColumnRenamed("body", "html"))}


def refusals(t: Tables) -> Tables:
    """Sites that may not be scored, with the reason, and those that may."""
    host = F.coalesce(F.nullif(U.host(F.col("url")), F.lit("")), F.col("typed"))
    seen = t["signals"].groupBy("audit_id").agg(F.count_if(F.col("status_code").between(200, 299) & ~F.col("bot_challenge")).alias("n"), F.first("bot_challenge_vendor", ignorenulls=True).alias("vendor"))
    known = t["targets"].withColumn("host", host).join(seen, "audit_id", "left").join(t["discovery"].select("audit_id", "home_status"), "audit_id", "left")
    status = F.coalesce("home_status", F.lit(0))
    answered = F.concat(F.lit(" answered with HTTP "), status.cast("string"))
    why = (
        F.when(F.col("url").isNull(), F.concat(F.col("typed"), F.lit(" is no public address.")))
        .when(F.col("vendor").isNotNull(), F.concat("host", F.lit(" is behind "), "vendor", F.lit(", which showed its own page instead of the site; a site that was not seen gets no score.")))
        .when(status.isin(*BLOCKED), F.concat("host", answered, F.lit(" and does not let us read it; a site that was not seen gets no score.")))
        .when(status == 0, F.concat("host", F.lit(" did not answer."))).otherwise(F.concat("host", answered, F.lit(", but with nothing that could be read as a page.")))
    )
    gone = F.coalesce("n", F.lit(0)) == 0
    return {"refused": known.where(gone).select("audit_id", "parent_id", "ord", "host", why.alias("reason"), "vendor"), "accepted": known.where(~gone).select("audit_id", "parent_id", "ord", "url", "market", "region")}


def _accepted(t: Tables, name: str) -> DataFrame:
    return t[name].join(t["accepted"].select("audit_id"), "audit_id", "left_semi")


def brands(t: Tables) -> Tables:
    seen = _accepted(t, "signals")
    hosts = t["accepted"].join(t["discovery"].select("audit_id", "resolved"), "audit_id").select("audit_id", U.host(F.col("resolved")).alias("host"))
    named = L.brands(seen, hosts).join(hosts, "audit_id").join(L.top_terms(seen), "audit_id", "left")
    made = named.withColumn("top_term", F.get("top_terms", F.lit(0)))
    pairs = R.with_urls(L.near_duplicate_pages(L.ok_pages(seen)), seen)
    return {"brands": made, "prompts": E.prompts(made.where(~F.contains("audit_id", F.lit("#")))), "pairs": pairs, "orphans": L.orphan_pages(seen).select("audit_id", "page_ord", "url")}


def evidence(t: Tables) -> Tables:
    """What was measured outside the sites; competitors are compared without it."""
    own = t["accepted"].where("parent_id IS NULL").select("audit_id").join(t["brands"].select("audit_id", "host", "name"), "audit_id")
    mine = lambda name: t[name].join(own.select("audit_id"), "audit_id", "left_semi")
    out = {}
    if "speed" in t:
        out["performance"] = E.performance(mine("speed"))
    if "candidates" in t:
        out["entity"] = E.entities(own.select("audit_id", "host"), mine("candidates"))
    if "ranks" in t:
        out["authority"] = E.authorities(own.select("audit_id", "host"), t["ranks"])
    if "hits" in t:
        out["cited"] = E.citations(mine("hits").join(own.select("audit_id", "host"), "audit_id"))
        # A site that was searched for and found nowhere weighs nothing, which is not unknown.
        weights = E.citation_weights(out["cited"])
        out["citations"] = mine("hits").select("audit_id").distinct().join(weights, "audit_id", "left").fillna(0.0)
    if "searches" in t:
        out["overviews"] = E.overviews(mine("searches").join(own.select("audit_id", "host", F.col("name").alias("brand")), "audit_id"))
    if "answers" in t:
        rivals = t["targets"].where("parent_id IS NOT NULL AND url IS NOT NULL").groupBy("parent_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("ord", "url"))), lambda x: T.host_to_brand(U.host(x["url"]))).alias("rivals"))
        asked = mine("answers").join(own.select("audit_id", "host", F.col("name").alias("brand")), "audit_id").join(rivals.withColumnRenamed("parent_id", "audit_id"), "audit_id", "left")
        out["mentions"] = E.mentions(asked.withColumn("rivals", F.coalesce("rivals", F.array().cast("array<string>"))))
        out["answered"] = E.answer_summary(out["mentions"])
    return out


def analyse(t: Tables, as_of: str) -> Tables:
    """Question gaps, facts and findings with what they rest on."""
    seen, asked = _accepted(t, "signals"), E.template_questions(t["brands"])
    if "questions" in t:
        given = t["questions"].select("audit_id", "q_ord", "question", "intent", "value")
        asked = asked.join(given.select("audit_id").distinct(), "audit_id", "left_anti").unionByName(given.join(t["accepted"].select("audit_id"), "audit_id", "left_semi"))
    gaps = E.ranked_gaps(E.question_gaps(asked, seen))
    parts = {name: t[table] for name, table in (("performance", "performance"), ("entity", "entity"), ("authority", "authority"), ("citations", "citations"), ("overviews", "overviews"), ("answers", "answered")) if table in t}
    facts = L.site_facts(seen, _accepted(t, "discovery"), t["brands"], F.lit(as_of).cast("timestamp"), gaps=E.gap_counts(gaps), **parts)
    shown = R.examples(seen, t["pairs"], gaps, t["brands"], t.get("cited"), _accepted(t, "crawlers"))
    made = R.report(facts, R.affected_urls(seen, t["pairs"], t["orphans"]), shown)
    return {"gaps": gaps, "facts": facts, "findings": made}


def score(t: Tables) -> Tables:
    groups = S.group_scores(t["findings"])
    pillars = S.pillar_scores(groups)
    weights, mode = S.applied_weights(pillars), t["facts"].select("audit_id", F.expr(C.mode_sql()).alias("mode"))
    overall = S.overall_scores(pillars).join(S.composite_scores(pillars), "audit_id").join(weights, "audit_id").join(mode, "audit_id")
    return {"groups": groups, "pillars": pillars, "overall": overall.withColumn("note", S.measured_note(F.col("mode"), F.col("weights"))), "ranked": S.rank_findings(t["findings"])}


def interpret(t: Tables) -> Tables:
    """What it means in words, and how competitors compare."""
    by = t["pillars"].groupBy("audit_id").pivot("pillar", list(S.PILLARS)).agg(F.first("score"))
    scores = t["overall"].select("audit_id", "overall", "band").join(by, "audit_id")
    of = t["targets"].select("audit_id", "parent_id", "ord").join(t["brands"].select("audit_id", "host"), "audit_id", "left")
    ok = scores.join(of, "audit_id").select("audit_id", "parent_id", "ord", "host", F.lit("ok").alias("status"), *[F.col(c).cast("int").alias(c) for c in ("seo", "aeo", "geo", "overall")], F.lit(None).cast("string").alias("reason"))
    none = F.lit(None).cast("int")
    gone = t["refused"].where("parent_id IS NOT NULL").select("audit_id", "parent_id", "ord", "host", F.lit("failed").alias("status"), *[none.alias(c) for c in ("seo", "aeo", "geo", "overall")], "reason")
    every = ok.unionByName(gone)
    compared = P.comparison(every).join(gone.select(F.col("parent_id").alias("audit_id"), "ord", "reason"), ["audit_id", "ord"], "left")
    own = t["ranked"].where(~F.contains("audit_id", F.lit("#")))
    counts = E.gap_counts(t["gaps"])
    told = P.translations(own, counts)
    if "rewrites" in t:
        told = P.rewritten(told, t["rewrites"])
    pillars = scores.where(~F.contains("audit_id", F.lit("#"))).select("audit_id", "overall", "band", F.create_map(*[x for p in S.PILLARS for x in (F.lit(p), F.col(p))]).alias("pillars"))
    return {"competitors": compared, "insights": P.insights(compared, counts), "translations": told, "verdicts": P.verdict(pillars)}


def recommend(t: Tables) -> Tables:
    own = lambda name: t[name].where(~F.contains("audit_id", F.lit("#")))
    plan = P.recommendations(own("ranked"))
    parts = {name: own(name) for name in ("overall", "pillars", "findings", "gaps", "translations", "competitors", "insights", "verdicts")} | {"recommendations": plan, "not_measured": P.not_measured(own("findings"))}
    return {"recommendations": plan, "results": audit_result(**parts)}


def publish(t: Tables, as_of: str) -> Tables:
    """The reports as files."""
    return {"reports": reports(report_lines(t), as_of)}


def stages(as_of: str) -> list:
    return [
        ("requests", requests), ("discovery", discovery), ("crawl", crawl), ("refusals", refusals), ("brands", brands), ("evidence", evidence), ("analyse", lambda t: analyse(t, as_of)), ("score", score),
        ("interpret", interpret), ("recommend", recommend), ("publish", lambda t: publish(t, as_of)),
    ]


def audit(spark: SparkSession, root: str, inputs: Tables, as_of: str) -> Tables:
    """All tables of an audit of the moment ``as_of`` kept under ``root``; a second call with the same root goes on where the first one ended."""
    return Stages(spark, root).run(stages(as_of), inputs)
