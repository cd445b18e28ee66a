"""What a site says about itself before its pages are read: robots rules, sitemaps, host variants, feeds.

All of it is read from ``fetches``: audit_id, url, final_url, status_code, redirect_chain (array), body. A
fetch that is missing counts as one that failed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sitelens.functions import urls as U
from sitelens.functions.columns import trim

#: Crawlers of AI systems, who runs them and what for; paths of feeds.
AI_CRAWLERS = (
    ("GPTBot", "OpenAI", "training"), ("OAI-SearchBot", "OpenAI", "search"), ("ChatGPT-User", "OpenAI", "user_fetch"), ("ClaudeBot", "Anthropic", "training"),
    ("Claude-SearchBot", "Anthropic", "search"), ("Claude-User", "Anthropic", "user_fetch"), ("PerplexityBot", "Perplexity", "search"), ("Perplexity-User", "Perplexity", "user_fetch"),
    ("Google-Extended", "Google", "training"), ("CCBot", "Common Crawl", "corpus"),
)
FEEDS = ("/feed", "/rss.xml", "/feed.xml", "/atom.xml")
RETRIEVAL, TRAINING = ("search", "user_fetch"), ("training", "corpus")
SOURCES, CHILDREN, SAMPLE = 3, 3, 200


def ok(status: Column) -> Column:
    return status.between(200, 299)


def failed_fetch(url: Column, error: Column) -> Column:
    """The row of a fetch that gave no response."""
    none = F.lit(None)
    return F.struct(url.alias("url"), url.alias("final_url"), F.lit(0).alias("status_code"), none.cast("string").alias("content_type"), F.lit("").alias("body"), F.array().cast("array<string>").alias("redirect_chain"), error.alias("error"))


# robots.txt


def robots_files(fetches: DataFrame, origins: DataFrame | None = None) -> DataFrame:
    """audit_id, found, status_code, body, html_instead of each site's robots.txt, one row for each site that has a fetch of it.

    Of several fetches that of the site's own origin counts (``origins``: audit_id, origin), then one by https, then the first by address.
    """
    html = F.substring("body", 1, 200).rlike("(?i)<html|<!doctype")
    alive = ok(F.col("status_code")) & (trim(F.col("body")) != "")
    files = fetches.where(U.path(F.col("url")) == "/robots.txt")
    own = F.lit(True)
    if origins is not None:
        files = files.join(origins.select("audit_id", F.lower("origin").alias("_origin")), "audit_id", "left")
        own = F.coalesce(F.lower("url") == F.concat("_origin", F.lit("/robots.txt")), F.lit(False))
    row = F.struct((alive & ~html).alias("found"), "status_code", F.when(alive & ~html, F.col("body")).alias("body"), (alive & html).alias("html_instead"))
    first = F.min_by(row, F.struct((~own).alias("a"), (~F.lower("url").startswith("https:")).alias("b"), "url", F.coalesce("body", F.lit("")).alias("c")))
    return files.groupBy("audit_id").agg(first.alias("r")).select("audit_id", "r.*")


def robots_lines(files: DataFrame) -> DataFrame:
    """Lines with a number of their group; a group starts at the first user agent after a directive."""
    lines = files.select("audit_id", F.posexplode(F.split("body", r"\r?\n")).alias("pos", "raw"))
    lines = lines.withColumn("line", trim(F.substring_index("raw", "#", 1))).where("line <> ''")
    field = F.lower(trim(F.substring_index("line", ":", 1)))
    value = trim(F.expr("substring(line, instr(line, ':') + 1)"))
    kind = F.when(~F.contains("line", F.lit(":")), "error").when(field == "sitemap", "sitemap").when(field == "user-agent", "agent").otherwise("directive")
    split = lines.select("audit_id", "pos", "line", field.alias("field"), value.alias("value"), kind.alias("kind"))
    grouped = split.where("kind IN ('agent', 'directive')")
    order = Window.partitionBy("audit_id").orderBy("pos")
    starts = grouped.withColumn("starts", ((F.col("kind") == "agent") & ~F.lag("kind").over(order).eqNullSafe("agent")).cast("int"))
    numbered = starts.withColumn("group", F.sum("starts").over(order)).drop("starts")
    others = split.where("kind NOT IN ('agent', 'directive')").withColumn("group", F.lit(None).cast("bigint"))
    # A directive before any user agent belongs to no group.
    lost = F.when((F.col("kind") == "directive") & (F.col("group") == 0), "error").otherwise(F.col("kind"))
    return numbered.withColumn("kind", lost).unionByName(others)


def robots_rules(files: DataFrame) -> DataFrame:
    """audit_id, ord, user_agent, allow, disallow, crawl_delay: a rule for each user agent line."""
    lines = robots_lines(files)
    agents = lines.where("kind = 'agent'").select("audit_id", "group", F.col("pos").alias("ord"), F.lower("value").alias("user_agent"))
    directives = lines.where("kind = 'directive'").groupBy("audit_id", "group").agg(
        F.sort_array(F.collect_list(F.when(F.col("field") == "allow", F.struct("pos", "value")))).alias("a"), F.sort_array(F.collect_list(F.when(F.col("field") == "disallow", F.struct("pos", "value")))).alias("d"),
        F.max_by(F.expr("try_cast(value AS DOUBLE)"), F.when((F.col("field") == "crawl-delay") & F.expr("try_cast(value AS DOUBLE) IS NOT NULL"), F.col("pos"))).alias("crawl_delay"),
    )
    none = F.array().cast("array<string>")
    return agents.join(directives, ["audit_id", "group"], "left").select(
        "audit_id", "ord", "user_agent", F.coalesce(F.transform("a", lambda p: p["value"]), none).alias("allow"), F.coalesce(F.transform("d", lambda p: p["value"]), none).alias("disallow"), "crawl_delay",
    )


def pattern_regex(pattern: Column) -> Column:
    """A robots pattern as a regular expression. A question mark is left as it is, so it quantifies; what is no expression is null."""
    escaped = F.regexp_replace(F.regexp_replace(pattern, r"([.+^{}()|\[\]\\])", r"\\$1"), r"\*", ".*")
    anchored = F.when(escaped.endswith("$"), F.concat(F.lit("^"), F.substring(escaped, F.lit(1), F.char_length(escaped) - 1), F.lit("$"))).otherwise(F.concat(F.lit("^"), escaped))
    return F.when(~pattern.rlike(r"^\?|\?\?\?|\*\?\?"), anchored)


def specificity(pattern: Column) -> Column:
    return F.char_length(F.replace(pattern, F.lit("*"), F.lit("")))


def selected_rules(rules: DataFrame, agents: list[str]) -> DataFrame:
    """Of each site and agent the rule with the longest token inside the agent's name, the first of equals; ``*`` fits all."""
    named = rules.withColumn("agent", F.explode(F.array(*[F.lit(a) for a in agents])))
    star = F.col("user_agent") == "*"
    fits = named.where(star | F.contains(F.lower("agent"), F.col("user_agent"))).withColumn("fit", F.when(star, 0).otherwise(F.char_length("user_agent")))
    best = Window.partitionBy("audit_id", "agent").orderBy(F.desc("fit"), "ord")
    return fits.withColumn("place", F.row_number().over(best)).where("place = 1").drop("place", "fit")


def allowed(rules: DataFrame, files: DataFrame, agents: list[str], paths: list[str]) -> DataFrame:
    """audit_id, agent, path, allowed, matched_by for every site of ``files``. The more specific pattern wins, ties allow."""
    chosen = selected_rules(rules, agents).withColumn("path", F.explode(F.array(*[F.lit(p) for p in paths])))

    def best(patterns: str) -> Column:
        regexes = F.transform(patterns, lambda p: F.struct(pattern_regex(p).alias("regex"), specificity(p).alias("size"), p.alias("pattern")))
        fits = F.filter(regexes, lambda p: (p["pattern"] != "") & F.coalesce(F.rlike(F.col("path"), p["regex"]), F.lit(False)))
        return F.coalesce(F.array_max(F.transform(fits, lambda p: p["size"])), F.lit(-1))

    judged = chosen.withColumns({"_a": best("allow"), "_d": best("disallow")})
    judged = judged.select("audit_id", "agent", "path", ((F.col("_d") < 0) | (F.col("_a") >= F.col("_d"))).alias("allowed"), F.col("user_agent").alias("matched_by"))
    every = files.select("audit_id", "found", F.explode(F.array(*[F.lit(a) for a in agents])).alias("agent")).withColumn("path", F.explode(F.array(*[F.lit(p) for p in paths])))
    by = F.when(~F.col("found"), "no robots.txt").otherwise(F.coalesce("matched_by", F.lit("no matching group")))
    return every.join(judged, ["audit_id", "agent", "path"], "left").select("audit_id", "agent", "path", (~F.col("found") | F.coalesce("allowed", F.lit(True))).alias("allowed"), by.alias("matched_by"))


def crawler_matrix(rules: DataFrame, files: DataFrame) -> DataFrame:
    """audit_id, agent, operator, purpose, allowed, matched_by of the AI crawlers at the root."""
    about = F.create_map(*[F.lit(x) for a, operator, purpose in AI_CRAWLERS for x in (a, f"{operator}|{purpose}")])
    verdicts = allowed(rules, files, [a for a, _, _ in AI_CRAWLERS], ["/"])
    known = F.split(F.element_at(about, F.col("agent")), r"\|")
    return verdicts.select("audit_id", "agent", F.get(known, F.lit(0)).alias("operator"), F.get(known, F.lit(1)).alias("purpose"), "allowed", "matched_by")


def purpose_split(matrix: DataFrame) -> DataFrame:
    """How many crawlers that fetch for answers, and that train, there are and are blocked."""
    fetches, trains, blocked = F.col("purpose").isin(*RETRIEVAL), F.col("purpose").isin(*TRAINING), ~F.col("allowed")
    return matrix.groupBy("audit_id").agg(F.count_if(fetches).alias("retrievers"), F.count_if(fetches & blocked).alias("retrievers_blocked"), F.count_if(trains & blocked).alias("trainers_blocked"))


def crawl_delays(rules: DataFrame, agent: str) -> DataFrame:
    return selected_rules(rules, [agent]).select("audit_id", F.coalesce("crawl_delay", F.lit(0.0)).alias("crawl_delay"))


def fetchable(urls: DataFrame, rules: DataFrame, files: DataFrame, agent: str) -> DataFrame:
    """Rows of ``urls`` (audit_id, url or path, ...) that the site's robots rules let ``agent`` fetch.

    A path meets only the patterns that begin as it does up to their first special character, by a join on that beginning.
    """
    chosen = selected_rules(rules, [agent]).join(files.where("found").select("audit_id"), "audit_id", "left_semi")
    listed = [chosen.select("audit_id", F.lit(opens).alias("opens"), F.explode(name).alias("pattern")) for name, opens in (("allow", True), ("disallow", False))]
    pattern = F.col("pattern")
    # A question mark makes the character before it optional.
    begins = F.regexp_replace(F.regexp_extract(pattern, r"^([^*$?]*\??)", 1), r"(?s).?\?$", "")
    patterns = listed[0].unionByName(listed[1]).where("pattern <> ''").distinct().select("audit_id", "opens", "pattern", begins.alias("begins"), specificity(pattern).alias("size"))
    lengths = patterns.groupBy("audit_id").agg(F.collect_set(F.char_length("begins")).alias("lengths"))
    pathed = urls.withColumn("_path", F.col("path") if "path" in urls.columns else U.path(F.col("url")))
    paths = pathed.select("audit_id", "_path").distinct().join(lengths, "audit_id")
    tried = paths.select("audit_id", "_path", F.explode(F.filter("lengths", lambda n: n <= F.char_length("_path"))).alias("n")).select("audit_id", "_path", F.substring("_path", F.lit(1), F.col("n")).alias("begins"))
    plain = (pattern == F.col("begins")) | (pattern == F.concat("begins", F.lit("*")))
    met = tried.join(patterns, ["audit_id", "begins"]).where(plain | F.coalesce(F.rlike(F.col("_path"), pattern_regex(pattern)), F.lit(False)))
    best = met.groupBy("audit_id", "_path").agg(F.max(F.when(F.col("opens"), F.col("size"))).alias("a"), F.max(F.when(~F.col("opens"), F.col("size"))).alias("d"))
    shut = best.where("d IS NOT NULL AND (a IS NULL OR a < d)").select("audit_id", "_path")
    return pathed.join(shut, ["audit_id", "_path"], "left_anti").select(*urls.columns)


# Sitemaps


def _blocks(xml: Column, tag: str) -> Column:
    return F.regexp_extract_all(xml, F.lit(rf"(?is)<(?:\w+:)?{tag}(?:\s[^>]*)?>(.*?)</(?:\w+:)?{tag}>"), F.lit(1))


def _first(block: Column, tag: str) -> Column:
    found = trim(F.regexp_extract(block, rf"(?is)<(?:\w+:)?{tag}(?:\s[^>]*)?>\s*(?:<!\[CDATA\[)?(.*?)(?:\]\]>)?\s*</(?:\w+:)?{tag}>", 1))
    for entity, character in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&")):
        found = F.replace(found, F.lit(entity), F.lit(character))
    return F.when(found != "", found)


def sitemap_entries(xml: Column) -> Column:
    """loc and lastmod of the pages that a sitemap lists."""
    return F.filter(F.transform(_blocks(xml, "url"), lambda b: F.struct(_first(b, "loc").alias("loc"), _first(b, "lastmod").alias("lastmod"))), lambda e: e["loc"].isNotNull())


def sitemap_children(xml: Column) -> Column:
    """Sitemaps that an index lists."""
    return F.filter(F.transform(_blocks(xml, "sitemap"), lambda b: _first(b, "loc")), lambda c: c.isNotNull())


def sitemaps(fetches: DataFrame, declared: DataFrame, origins: DataFrame) -> DataFrame:
    """One row for each site of ``origins`` (audit_id, origin): found, sources, urls, lastmod, freshest and a sample.

    ``declared``: audit_id, ord, url from robots.txt; these come first, then the two usual places. The first
    ``SOURCES`` that list anything count; of an index the first ``CHILDREN``, one level deep.
    """
    usual = origins.select("audit_id", F.posexplode(F.array(*[F.concat("origin", F.lit(p)) for p in ("/sitemap.xml", "/sitemap_index.xml")])).alias("ord", "url"))
    wanted = declared.select("audit_id", F.col("ord").cast("bigint").alias("ord"), "url").unionByName(usual.select("audit_id", (F.col("ord") + (1 << 40)).alias("ord"), "url"))
    wanted = wanted.groupBy("audit_id", "url").agg(F.min("ord").alias("ord"))
    files = fetches.where(ok(F.col("status_code"))).groupBy("audit_id", "url").agg(F.first("body").alias("body"))
    read = wanted.join(files, ["audit_id", "url"]).select("audit_id", "url", "ord", sitemap_entries(F.col("body")).alias("entries"), sitemap_children(F.col("body")).alias("children"))
    turn = Window.partitionBy("audit_id").orderBy("ord")
    read = read.where("size(entries) > 0 OR size(children) > 0").withColumn("turn", F.row_number().over(turn)).where(F.col("turn") <= SOURCES)
    inner = read.select("audit_id", "ord", F.posexplode(F.slice("children", 1, CHILDREN)).alias("child", "url")).join(files, ["audit_id", "url"]).select("audit_id", "url", "ord", sitemap_entries(F.col("body")).alias("entries"))
    every = read.select("audit_id", "url", "ord", "entries").unionByName(inner.where("size(entries) > 0"))
    rolled = every.groupBy("audit_id").agg(F.sort_array(F.collect_list(F.struct("ord", "url"))).alias("s"), F.flatten(F.collect_list("entries")).alias("e"))
    canon = F.array_distinct(F.filter(F.transform("e", lambda x: U.canonical(x["loc"])), lambda u: u.isNotNull()))
    stamps = F.filter(F.transform("e", lambda x: x["lastmod"]), lambda m: m.isNotNull())
    summed = rolled.select(
        "audit_id", F.lit(True).alias("found"), F.transform("s", lambda x: x["url"]).alias("sources"), F.size("e").cast("bigint").alias("url_count"), (F.size(stamps) > 0).alias("has_lastmod"),
        F.array_max(stamps).alias("freshest"), F.slice(canon, 1, SAMPLE).alias("sample"),
    )
    return origins.select("audit_id").join(summed, "audit_id", "left").fillna({"found": False, "url_count": 0, "has_lastmod": False})


# Together


def host_variants(fetches: DataFrame, origins: DataFrame) -> DataFrame:
    """Per site, whether all variants of its host that answer lead to one origin."""
    probes = origins.select("audit_id", F.explode(U.variants(F.col("origin"))).alias("url"))
    met = probes.join(fetches.select("audit_id", "url", "status_code", "final_url"), ["audit_id", "url"], "left")
    origin = F.regexp_extract(F.lower("final_url"), r"^([a-z]+://[^/?#]*)", 1)
    return met.groupBy("audit_id").agg((F.count_distinct(F.when(F.col("status_code").between(1, 399), origin)) <= 1).alias("one_host"))


def probes(fetches: DataFrame) -> DataFrame:
    """Per site, whether there is an llms.txt and how many feeds."""
    path = U.path(F.col("url"))
    text = ok(F.col("status_code")) & (trim(F.col("body")) != "") & ~F.substring("body", 1, 200).rlike("(?i)<html")
    return fetches.groupBy("audit_id").agg((F.count_if((path == "/llms.txt") & text) > 0).alias("llms_found"), F.count_distinct(F.when(path.isin(*FEEDS) & ok(F.col("status_code")), path)).alias("feeds"))


def discover(targets: DataFrame, fetches: DataFrame) -> DataFrame:
    """A row of discovery facts for each site of ``targets`` (audit_id, url)."""
    # A page that was fetched twice counts once, as the fetch that got an answer.
    answer = F.struct(~ok(F.col("status_code")), "final_url", "status_code", "redirect_chain")
    once = fetches.join(targets.select("audit_id", "url"), ["audit_id", "url"], "left_semi").groupBy("audit_id", "url").agg(F.min(answer).alias("r")).select("audit_id", "url", "r.final_url", "r.status_code", "r.redirect_chain")
    home = targets.join(once, ["audit_id", "url"], "left")
    resolved = F.coalesce("final_url", "url")
    home = home.select(
        "audit_id", resolved.alias("resolved"), F.regexp_extract(resolved, r"(?i)^([a-z]+://[^/?#]*)", 1).alias("origin"), F.coalesce("status_code", F.lit(0)).alias("home_status"),
        resolved.rlike("(?i)^https://").alias("https"), F.coalesce(F.size("redirect_chain"), F.lit(0)).alias("redirects"),
    )
    files = targets.select("audit_id").join(robots_files(fetches, home.select("audit_id", "origin")), "audit_id", "left").fillna({"found": False, "html_instead": False})
    lines, rules = robots_lines(files.where("found")), robots_rules(files.where("found"))
    summary = lines.groupBy("audit_id").agg(F.count_if(F.col("kind") == "error").alias("errors"), F.count_if((F.col("kind") == "sitemap") & (F.col("value") != "")).alias("declared"))
    blocked = rules.where((F.col("user_agent") == "*") & F.array_contains("disallow", "/")).select("audit_id").distinct().withColumn("blocks", F.lit(True))
    declared = lines.where("kind = 'sitemap' AND value <> ''").select("audit_id", F.col("pos").alias("ord"), F.col("value").alias("url"))
    maps = sitemaps(fetches, declared, home.select("audit_id", "origin"))
    out = home
    for part in (files, summary, blocked, maps.select("audit_id", F.col("found").alias("map_found"), "has_lastmod", "url_count"), host_variants(fetches, home), probes(fetches), purpose_split(crawler_matrix(rules, files))):
        out = out.join(part.drop("status_code", "body"), "audit_id", "left")
    errors = F.coalesce("errors", F.lit(0)) + F.col("html_instead").cast("bigint")
    return out.select(
        "audit_id", "resolved", "origin", "https", "home_status", "redirects", F.coalesce("one_host", F.lit(True)).alias("one_host"), F.coalesce("blocks", F.lit(False)).alias("blanket_block"),
        F.col("found").alias("robots_found"), errors.alias("robots_errors"), F.coalesce("declared", F.lit(0)).alias("sitemaps_declared"), F.col("map_found").alias("sitemap_found"),
        F.col("has_lastmod").alias("sitemap_lastmod"), F.col("url_count").alias("sitemap_urls"), "retrievers", "retrievers_blocked", F.coalesce("llms_found", F.lit(False)).alias("llms_found"), F.coalesce("feeds", F.lit(0)).alias("feeds"),
    )
