"""What a finding says: title, summary, evidence and the pages it concerns.

Titles and summaries are templates over the row of facts, so that all of a site's findings cost one
projection. Affected pages and examples come from one pass over the pages that turns each into rows of
(site, check, place, item); the first of each site and check are kept by a ranked window, so that no task
holds more of a site than it shows. Unavailable and not applicable findings have a reason and nothing else.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sitelens.functions import text as T
from sitelens.operators import catalogue as C
from sitelens.operators import site as L
from sitelens.operators.html import PROPERTIES

MOST_URLS = 20
ITEM = "struct<kind:string,label:string,value:string,of:string,unit:string,url:string,values:array<string>>"
_MEAN = "CAST(floor(10 * {0} / greatest(pages_ok, 1) + 0.5e0) / 10 AS DECIMAL(18, 1))"


def _whole(x: str) -> str:
    return f"CAST(floor({x} + 0.5e0) AS BIGINT)"


#: Title and summary of each check. {..} holds an expression over the facts.
TEXTS = {
    "seo.index.https": ("Secure transport", "The homepage is {CASE WHEN https THEN 'read' ELSE 'not read' END} over HTTPS."),
    "seo.index.status_code": ("Homepage answers", "The homepage answers with status {home_status}."),
    "seo.index.redirect_chain": ("Redirects before the homepage", "{redirects} redirects stand before the homepage."),
    "seo.index.canonical_host": ("One host name", "The variants of the host lead to {CASE WHEN one_host THEN 'one place' ELSE 'several places' END}."),
    "seo.index.robots_txt": ("robots.txt", "robots.txt {CASE WHEN blanket_block THEN 'shuts out every crawler' WHEN NOT robots_found THEN 'is missing' WHEN robots_errors > 0 THEN 'has lines that cannot be read' ELSE 'is in order' END}."),
    "seo.index.sitemap": ("XML sitemap", "{CASE WHEN sitemap_found THEN 'A sitemap lists' ELSE 'No sitemap was found; listed are' END} {sitemap_urls} addresses."),
    "seo.index.noindex": ("Pages may be indexed", "{noindex} of {pages_ok} pages ask not to be indexed."),
    "seo.index.canonical_tags": ("Canonical links", "{canonicals} of {pages_ok} pages name a canonical address, {canonicals_own} of them their own."),
    "seo.index.broken_pages": ("Pages that fail", "{broken} of {pages} addresses failed."),
    "seo.index.crawl_depth": ("Depth of pages", "{deep} of {pages_ok} pages are more than three steps from the homepage."),
    "seo.index.csr_dependency": ("Content without scripts", "{csr} of {pages_ok} pages show hardly any text before scripts run."),
    "seo.onpage.title_present": ("Titles", "{titled} of {pages_ok} pages have a title."),
    "seo.onpage.title_length": ("Length of titles", "{titles_sized} of {titled} titles have 30 to 60 characters."),
    "seo.onpage.title_duplicates": ("Titles differ", "{title_repeats} pages share their title with another one."),
    "seo.onpage.meta_description": ("Descriptions", "{described} of {pages_ok} pages have a description."),
    "seo.onpage.meta_duplicates": ("Descriptions differ", "{meta_repeats} pages share their description with another one."),
    "seo.onpage.h1": ("One main heading", "{h1_any} of {pages_ok} pages have a main heading, {h1_one} exactly one."),
    "seo.onpage.heading_hierarchy": ("Order of headings", "{ordered} of {pages_ok} pages skip no level of headings."),
    "seo.onpage.image_alt": ("Texts of images", "{images_alt} of {images} images have an alternative text or are marked as decoration."),
    "seo.onpage.content_depth": ("Length of pages", "Half of the pages have more than {" + _whole("median_words") + "} words."),
    "seo.onpage.thin_pages": ("Thin pages", "{thin} of {pages_ok} pages have fewer than 300 words."),
    "seo.onpage.duplicate_content": ("Pages that repeat each other", "{alike} pairs of {comparable} pages are nearly the same."),
    "seo.perf.performance_score": ("Speed score", "The speed score is {" + _whole("performance_score") + "} of 100 ({performance_source} data)."),
    "seo.perf.lcp": ("Largest paint", "The largest element shows after {" + _whole("lcp_ms") + "} ms ({performance_source} data)."),
    "seo.perf.cls": ("Layout shift", "The layout shifts by {CAST(cls AS DECIMAL(18, 3))} ({performance_source} data)."),
    "seo.perf.ttfb": ("First byte", "The first byte comes after {" + _whole("ttfb_ms") + "} ms ({performance_source} data)."),
    "seo.perf.mobile_friendly": ("Use on phones", "{" + _whole("100 * mobile_score") + "} % of the rules for small screens are met."),
    "seo.schema.present": ("Structured data", "{schema_any} of {pages_ok} pages carry structured data."),
    "seo.schema.valid_jsonld": ("Structured data can be read", "{schema_errors} of {pages_ok} pages have JSON-LD that is no JSON."),
    "seo.schema.breadcrumbs": ("Breadcrumbs", "{breadcrumbs} of {pages_ok} pages mark their breadcrumbs."),
    "seo.links.internal_density": ("Links between pages", "Half of the pages link to more than {" + _whole("median_links") + "} others."),
    "seo.links.anchor_quality": ("Texts of links", "{anchors_generic} of {anchors} links say nothing about their target."),
    "seo.links.orphan_risk": ("Pages without links to them", "No other page links to {orphans} of {pages_ok} pages."),
    "seo.links.outbound_references": ("Links to other sites", "The pages link to {external} addresses elsewhere."),
    "aeo.answer.question_headings": ("Headings that ask", "{questions} headings are questions."),
    "aeo.answer.direct_answer_proximity": ("Answers below questions", "{questions_answered} of {questions} questions have a short answer right below them."),
    "aeo.answer.definitions": ("Definitions", "{definitions} sentences define something."),
    "aeo.answer.lists_tables": ("Lists and tables", "{list_units} lists and tables stand beside {words} words."),
    "aeo.answer.paragraph_length": ("Length of paragraphs", "Half of the paragraphs have more than {" + _whole("median_paragraph") + "} words."),
    "aeo.answer.semantic_html": ("Main content is marked", "{semantic} of {pages_ok} pages mark their main content."),
    "aeo.schema.faq": ("Questions as structured data", "{faq + qa} of {pages_ok} pages mark questions and answers."),
    "aeo.schema.howto": ("Instructions as structured data", "{howto} pages mark their instructions."),
    "aeo.schema.article": ("Articles as structured data", "{articles} pages mark an article, {editorial} seem to be one."),
    "aeo.schema.answer_alignment": ("Marked answers are visible", "{faq_aligned} of {faq_checked} marked answers stand in the visible text."),
    "aeo.eeat.author_byline": ("Authors", "{bylined} of {essays} articles name their author."),
    "aeo.eeat.author_schema": ("Authors as structured data", "{author_schema} of {essays} articles mark their author."),
    "aeo.eeat.trust_pages": ("About, contact and people", "Found: {CASE WHEN about THEN 'about' ELSE 'no about' END}, {CASE WHEN contact THEN 'contact' ELSE 'no contact' END}, {CASE WHEN people_page THEN 'people' ELSE 'no people' END}."),
    "aeo.eeat.dates": ("Dates", "{dated} pages bear a date, {essays} are articles."),
    "aeo.eeat.freshness": ("Age of content", "The newest date is {" + _whole("months_old") + "} months old."),
    "aeo.eeat.outbound_citations": ("Sources", "{citing} of {pages_ok} pages link to a source elsewhere."),
    "aeo.coverage.intent_spread": ("Kinds of visitors", "Served: {CASE WHEN informational THEN 'readers' ELSE 'no readers' END}, {CASE WHEN commercial THEN 'those who compare' ELSE 'none who compare' END}, {CASE WHEN transactional THEN 'buyers' ELSE 'no buyers' END}."),
    "aeo.coverage.question_gap": ("Questions of customers", "{gaps_answered} of {gaps} likely questions are answered."),
    "geo.entity.organization_schema": ("The organisation as structured data", "The organisation is described with weight {" + _whole("coalesce(org_weight, 0e0)") + "} of 16."),
    "geo.entity.sameas": ("Profiles elsewhere", "{same_as} profiles elsewhere are named."),
    "geo.entity.name_consistency": ("One name", "The brand goes by {CASE WHEN one_name THEN 'one name' ELSE 'several names' END}."),
    "geo.entity.category_clarity": ("What the site is about", "The homepage {CASE WHEN category_length > 12 THEN 'says' ELSE 'does not say' END} what is offered."),
    "geo.entity.people": ("People as structured data", "{persons} pages mark a person."),
    "geo.entity.location": ("Places as structured data", "An address is {CASE WHEN org_address OR postal > 0 THEN 'given' ELSE 'not given' END}."),
    "geo.entity.products": ("Offers as structured data", "{product_schema} pages mark an offer, {commercial_pages} seem to be one."),
    "geo.citation.wikidata": ("Entry in Wikidata", "Wikidata {CASE WHEN qid IS NULL THEN 'does not know the brand' ELSE concat('knows the brand as ', qid) END}."),
    "geo.citation.domain_authority": ("Rank of the domain", "The domain ranks {CAST(page_rank AS DECIMAL(18, 2))} of 10."),
    "geo.citation.third_party": ("Mentions elsewhere", "Mentions elsewhere weigh {CAST(tier_weight AS DECIMAL(18, 2))}, those in directories {CAST(tier7_weight AS DECIMAL(18, 2))}."),
    "geo.content.statistics": ("Numbers", "{statistics} sentences give numbers, {" + _MEAN.format("statistics") + "} a page."),
    "geo.content.quotable": ("Sentences to quote", "{quotable} sentences can be quoted as they are, {" + _MEAN.format("quotable") + "} a page."),
    "geo.content.comparisons": ("Comparisons", "{comparisons} pages compare offers."),
    "geo.content.original_research": ("Research", "{research} pages present research."),
    "geo.content.expert_commentary": ("Quotations", "{blockquotes} quotations stand on the pages."),
    "geo.content.definitions": ("Definitions to cite", "{definitions} sentences define something."),
    "geo.machine.ai_crawler_access": ("Crawlers of answer engines", "{retrievers_blocked} of {retrievers} crawlers of answer engines are shut out."),
    "geo.machine.training_crawler_policy": ("Crawlers that train", "Whether crawlers that train models may come is the owner's choice and not scored."),
    "geo.machine.schema_coverage": ("Pages that machines can read", "{schema_pages} of {pages_ok} pages carry JSON-LD."),
    "geo.machine.entity_graph": ("Linked entities", "{schema_ids} of {schema_pages} pages with JSON-LD name their entities by @id."),
    "geo.machine.sitemap_quality": ("Sitemap for machines", "The sitemap lists {sitemap_urls} addresses {CASE WHEN sitemap_lastmod THEN 'with' ELSE 'without' END} dates."),
    "geo.machine.llms_txt": ("llms.txt", "An llms.txt is {CASE WHEN llms_found THEN 'there' ELSE 'not there' END}; few crawlers are known to read it."),
    "geo.machine.feeds": ("Feeds", "{feeds} feeds were found."),
    "ai.mention.google_aio": ("Overviews that name the brand", "{aio_present} of {aio_checked} searches show an overview, {aio_cites} of them name the brand."),
    "ai.citation.google_aio": ("Overviews that cite the site", "Overviews cite {aio_domains} domains."),
    "ai.mention.rate": ("Answers that name the brand", "{ai_mentioned} of {ai_samples} sampled answers name the brand."),
    "ai.citation.rate": ("Answers that cite the site", "{ai_cited} of {ai_samples} sampled answers cite the site."),
    "ai.sov.share": ("Share of voice", "{" + _whole("voice_pct") + "} % of the mentions of tracked brands are the brand's."),
    "ai.sentiment.quality": ("Tone of answers", "{ai_positive} of {ai_mentioned} mentions are friendly, {ai_negative} are not."),
}
#: Why a check may have no answer.
UNAVAILABLE = {
    "seo.perf": "The speed of the site was not measured.", "geo.citation": "Nothing outside the site was asked.", "aeo.coverage": "There are no questions for this brand.", "ai": "Answers of AI systems were not sampled.",
}
NOT_APPLICABLE = {
    "seo.onpage.image_alt": "There are no images.", "seo.onpage.duplicate_content": "There are too few long pages to compare.", "seo.links.anchor_quality": "There are no links with a text.", "aeo.schema.howto": "The site gives no instructions.",
    "aeo.schema.article": "There are no articles.", "aeo.schema.answer_alignment": "No questions are marked.", "aeo.eeat": "There are no articles.", "aeo.eeat.freshness": "No page bears a date.", "geo.entity.products": "There are no pages of offers.",
}
#: Counts (label, part, whole) and metrics (label, value, unit) that a finding shows.
COUNTS = {
    "seo.index.sitemap": ("Addresses", "sitemap_urls", None), "seo.index.noindex": ("Pages with noindex", "noindex", "pages_ok"), "seo.index.csr_dependency": ("Pages that need scripts", "csr", "pages_ok"), "seo.onpage.image_alt": ("Images with text", "images_alt", "images"),
    "aeo.answer.question_headings": ("Questions", "questions", None), "aeo.answer.direct_answer_proximity": ("Answered at once", "questions_answered", "questions"), "aeo.coverage.question_gap": ("Answered", "gaps_answered", "gaps"),
    "ai.mention.google_aio": ("Overviews", "aio_present", "aio_checked"), "ai.mention.rate": ("Answers with the brand", "ai_mentioned", "ai_samples"), "ai.citation.rate": ("Answers with the site", "ai_cited", "ai_samples"),
}
METRICS = {
    "seo.index.status_code": ("Status", "home_status", ""), "seo.onpage.content_depth": ("Median words", _whole("median_words"), ""), "seo.perf.performance_score": ("Score", _whole("performance_score"), ""), "seo.perf.lcp": ("LCP", _whole("lcp_ms"), "ms"),
    "seo.perf.ttfb": ("TTFB", _whole("ttfb_ms"), "ms"), "seo.links.internal_density": ("Median links", _whole("median_links"), ""), "aeo.eeat.freshness": ("Months", _whole("months_old"), ""), "ai.sov.share": ("Share", _whole("voice_pct"), "%"),
}
#: Pages that a finding concerns, by their signals.
AFFECTED = {
    "seo.index.noindex": "robots_meta.noindex", "seo.index.canonical_tags": "coalesce(canonical, '') = ''", "seo.index.crawl_depth": "depth > 3", "seo.index.csr_dependency": "csr_dependent", "seo.onpage.title_present": "title IS NULL",
    "seo.onpage.title_length": "title IS NOT NULL AND NOT char_length(title) BETWEEN 30 AND 60", "seo.onpage.meta_description": "meta_description IS NULL", "seo.onpage.h1": "h1_count <> 1", "seo.onpage.heading_hierarchy": "heading_hierarchy_breaks > 0",
    "seo.onpage.thin_pages": "word_count < 300 AND NOT csr_dependent", "seo.schema.present": "size(json_ld_types) = 0", "seo.schema.valid_jsonld": "json_ld_parse_errors > 0",
    "aeo.answer.semantic_html": "coalesce(try_element_at(semantic_tags, 'main'), 0) + coalesce(try_element_at(semantic_tags, 'article'), 0) = 0", "aeo.schema.faq": "array_contains(json_ld_types, 'FAQPage')",
}


def text_sql(template: str) -> str:
    """A template as SQL text that both databases read."""
    parts = re.split(r"\{([^{}]*)\}", template)
    shown = ["'" + p.replace("'", "''") + "'" if i % 2 == 0 else f"CAST({p} AS STRING)" for i, p in enumerate(parts) if p]
    return f"concat({', '.join(shown)})"


def reason(check: C.Check, reasons: dict[str, str]) -> str:
    known = [r for r in (check.id, check.group, check.pillar) if r in reasons]
    return reasons[known[0]] if known else TEXTS[check.id][1] if "{" not in TEXTS[check.id][1] else "Not known."


def summary_sql(check: C.Check, status: str) -> str:
    gone, idle = (reason(check, r).replace("'", "''") for r in (UNAVAILABLE, NOT_APPLICABLE))
    return f"CASE {status} WHEN 'unavailable' THEN '{gone}' WHEN 'not_applicable' THEN '{idle}' ELSE {text_sql(TEXTS[check.id][1])} END"


def item(kind: str, label: Column | str, value=None, of=None, unit=None, url=None, values=None) -> Column:
    def text(x) -> Column:
        return (F.lit(x) if x is None or isinstance(x, str) else x).cast("string")

    listed = (F.lit(None) if values is None else values).cast("array<string>")
    return F.struct(F.lit(kind).alias("kind"), text(label).alias("label"), text(value).alias("value"), text(of).alias("of"), text(unit).alias("unit"), text(url).alias("url"), listed.alias("values"))


def texts(facts: DataFrame, checks: tuple = C.CHECKS) -> DataFrame:
    """audit_id, check_id, title, summary and the evidence that the facts give, of every check of every site."""
    rows = []
    for c in checks:
        status, items = c.sql()["status"], []
        if c.id in COUNTS:
            label, part, whole = COUNTS[c.id]
            items.append(item("count", label, F.expr(part), F.expr(whole) if whole else None))
        if c.id in METRICS:
            label, value, unit = METRICS[c.id]
            items.append(item("metric", label, F.expr(value), unit=unit))
        shown = F.array(*items) if items else F.array().cast(f"array<{ITEM}>")
        rows.append(F.struct(F.lit(c.id).alias("check_id"), F.lit(TEXTS[c.id][0]).alias("title"), F.expr(summary_sql(c, status)).alias("summary"), shown.alias("shown")))
    return facts.select("audit_id", F.inline(F.array(*rows)))


def _first(rows: DataFrame, value: str, most: Column | int, order: list, name: str) -> DataFrame:
    """audit_id, check_id and the first values of each as an array."""
    place = F.row_number().over(Window.partitionBy("audit_id", "check_id").orderBy(*order))
    kept = rows.withColumn("_place", place).where(F.col("_place") <= most)
    return kept.groupBy("audit_id", "check_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("_place", value))), lambda x: x[value]).alias(name))


def affected_urls(signals: DataFrame, pairs: DataFrame, orphans: DataFrame, most: int = MOST_URLS) -> DataFrame:
    """audit_id, check_id, affected_urls: the first pages that a finding concerns, in order of pages.

    ``pairs``: near duplicates with their urls (audit_id, a, b, url_a, url_b); ``orphans``: audit_id, page_ord, url.
    """
    essay, news = F.col("url").rlike(L.ESSAYS), F.col("url").rlike(L.EDITORIAL)
    article = F.exists("json_ld_types", lambda t: t.rlike("Article|BlogPosting|NewsArticle"))
    offer = F.exists("json_ld_types", lambda t: t.isin("Product", "Service", "Offer", "SoftwareApplication"))
    topic = F.concat_ws(" ", "url", F.coalesce("title", F.lit("")))
    more = {
        "aeo.schema.article": news & ~article, "aeo.eeat.author_byline": essay & F.col("author_name").isNull(), "aeo.eeat.dates": essay & F.col("date_published").isNull() & F.col("date_modified").isNull(),
        "geo.entity.products": F.col("url").rlike(L.COMMERCIAL) & ~offer, "geo.content.comparisons": T.has_word(topic, T.COMPARISON), "geo.content.original_research": T.has_word(topic, T.RESEARCH),
    }
    ok = F.col("status_code").between(200, 299)
    marks = [F.when(ok & F.expr(p), F.struct(F.lit(0).alias("part"), F.lit(c).alias("check_id"))) for c, p in AFFECTED.items()] + [F.when(ok & p, F.struct(F.lit(0).alias("part"), F.lit(c).alias("check_id"))) for c, p in more.items()]
    marks.append(F.when(ok & F.array_contains("json_ld_types", "QAPage"), F.struct(F.lit(1).alias("part"), F.lit("aeo.schema.faq").alias("check_id"))))
    marks.append(F.when(F.expr("status_code >= 400 OR (status_code = 0 AND error IS NOT NULL)"), F.struct(F.lit(0).alias("part"), F.lit("seo.index.broken_pages").alias("check_id"))))
    by_page = signals.select("audit_id", "url", F.explode(F.filter(F.array(*marks), lambda m: m.isNotNull())).alias("m"), F.col("page_ord").alias("x"))
    by_page = by_page.select("audit_id", "m.check_id", F.struct(F.col("m.part").cast("bigint").alias("p"), F.col("x"), F.lit(0).alias("y")).alias("place"), "url")
    same = Window.partitionBy("audit_id", F.lower(L.trim(F.col("title"))))
    titled = L.ok_pages(signals).where(L.trim(F.col("title")) != "").select("audit_id", "url", "page_ord", F.count("*").over(same).alias("n"), F.min("page_ord").over(same).alias("first")).where("n > 1")

    def rows(df: DataFrame, check: str, p: Column, x: Column, y: Column, url: str = "url") -> DataFrame:
        return df.select("audit_id", F.lit(check).alias("check_id"), F.struct(p.cast("bigint").alias("p"), x.alias("x"), y.cast("int").alias("y")).alias("place"), F.col(url).alias("url"))

    zero = F.lit(0)
    every = [
        by_page, rows(titled, "seo.onpage.title_duplicates", F.col("first"), F.col("page_ord"), zero), rows(orphans, "seo.links.orphan_risk", zero, F.col("page_ord"), zero),
        rows(pairs, "seo.onpage.duplicate_content", F.col("a"), F.col("b"), zero, "url_a"), rows(pairs, "seo.onpage.duplicate_content", F.col("a"), F.col("b"), F.lit(1), "url_b"),
    ]
    out = every[0]
    for part in every[1:]:
        out = out.unionByName(part)
    return _first(out, "url", most, ["place"], "affected_urls")


def examples(signals: DataFrame, pairs: DataFrame, gaps: DataFrame, brands: DataFrame, cited: DataFrame | None = None, matrix: DataFrame | None = None) -> DataFrame:
    """audit_id, check_id, examples: items from pages and evidence, a few of each."""
    good = L.ok_pages(signals)
    asked = good.select("audit_id", "page_ord", F.posexplode("question_headings").alias("at", "q"))
    place = lambda *c: F.struct(*[F.col(x).cast("bigint").alias(x) for x in c]).alias("place")
    none = F.concat(F.lit("The answer has "), F.col("q.answer_length").cast("string"), F.lit(" characters."))
    bad = item("text", F.substring("q.text", 1, 90), F.when(F.col("q.answer").isNull(), "No answer follows.").otherwise(none))
    rows = [
        (asked.where(~F.col("q.qualifies")).select("audit_id", F.lit("aeo.answer.direct_answer_proximity").alias("check_id"), place("page_ord", "at"), bad.alias("item")), 4),
        (signals.where("status_code >= 400 OR (status_code = 0 AND error IS NOT NULL)").select("audit_id", F.lit("seo.index.broken_pages").alias("check_id"), place("page_ord"), item("text", F.col("url"), F.coalesce("error", F.concat(F.lit("HTTP "), F.col("status_code").cast("string")))).alias("item")), 10),
        (pairs.select("audit_id", F.lit("seo.onpage.duplicate_content").alias("check_id"), place("a", "b"), item("text", F.concat(F.floor(100 * F.col("similarity") + 0.5).cast("string"), F.lit("% similar")), F.concat("url_a", F.lit(" ≈ "), "url_b")).alias("item")), 6),
    ]
    # FAQ answers that the visible text lacks.
    needle = F.lower(F.substring(L.trim(F.regexp_replace(F.regexp_replace("answer", "<[^>]+>", " "), r"\s+", " ")), 1, 60))
    told = good.where(F.array_contains("json_ld_types", "FAQPage")).select("audit_id", "page_ord", "url", "excerpt", "question_headings", F.posexplode("faq_answers").alias("at", "answer")).withColumn("needle", needle)
    seen = F.contains(F.lower("excerpt"), F.col("needle")) | F.exists("question_headings", lambda q: F.contains(F.lower(F.coalesce(q["answer"], F.lit(""))), F.col("needle")))
    gone = told.where((F.char_length("needle") >= 20) & ~seen)
    rows.append((gone.select("audit_id", F.lit("aeo.schema.answer_alignment").alias("check_id"), place("page_ord", "at"), item("text", "Not in the visible text", F.concat("url", F.lit(": "), "needle")).alias("item")), 5))
    if cited is not None:
        rows.append((cited.select("audit_id", F.lit("geo.citation.third_party").alias("check_id"), F.struct(F.col("tier").cast("bigint").alias("tier"), F.col("site").alias("site")).alias("place"), item("url", F.concat(F.lit("Tier "), F.col("tier").cast("string")), url=F.col("url")).alias("item")), 10))
    if matrix is not None:
        rows.append((matrix.select("audit_id", F.lit("geo.machine.ai_crawler_access").alias("check_id"), F.struct("agent").alias("place"), item("text", F.concat("agent", F.lit(" ("), "operator", F.lit(", "), "purpose", F.lit(")")), F.when(F.col("allowed"), "allowed").otherwise(F.concat(F.lit("shut out by "), "matched_by"))).alias("item")), 20))
    single = None
    for df, most in rows:
        made = _first(df, "item", most, ["place"], "items")
        single = made if single is None else single.unionByName(made)

    def listed(df: DataFrame, check: str, label: str, most: int, order: list, value: str) -> DataFrame:
        found = _first(df.select("audit_id", F.lit(check).alias("check_id"), *[F.col(c) for c in dict.fromkeys([*order, value])]), value, most, order, "v")
        return found.select("audit_id", "check_id", F.array(item("list", label, values=F.col("v"))).alias("items"))

    kinds = good.select("audit_id", "page_ord", F.posexplode("json_ld_types").alias("at", "kind")).groupBy("audit_id", "kind").agg(F.min(F.struct("page_ord", "at")).alias("first"))
    single = single.unionByName(listed(kinds, "seo.schema.present", "Types", 20, ["first"], "kind"))
    single = single.unionByName(listed(asked.withColumn("text", F.col("q.text")), "aeo.answer.question_headings", "Examples", 5, ["page_ord", "at"], "text"))
    single = single.unionByName(listed(gaps.where("NOT answered"), "aeo.coverage.question_gap", "Unanswered", 6, ["rank"], "question"))
    there, every = F.coalesce("org_present", F.array().cast("array<string>")), F.array(*[F.lit(p) for p in PROPERTIES])
    org = brands.where("org_weight IS NOT NULL").select("audit_id", F.lit("geo.entity.organization_schema").alias("check_id"), F.array(item("list", "Present", values=there), item("list", "Missing", values=F.array_except(every, there))).alias("items"))
    same = brands.where("size(org_same_as) > 0").select("audit_id", F.lit("geo.entity.sameas").alias("check_id"), F.array(item("list", "Profiles", values=F.slice("org_same_as", 1, 10))).alias("items"))
    names = brands.select("audit_id", F.lit("geo.entity.name_consistency").alias("check_id"), F.array(item("list", "Names", values=F.col("name_variants"))).alias("items"))
    return single.unionByName(org).unionByName(same).unionByName(names)


def with_urls(pairs: DataFrame, signals: DataFrame) -> DataFrame:
    """Pairs of pages (audit_id, a, b, similarity) with the addresses of both."""
    left, right = (signals.select("audit_id", F.col("page_ord").alias(c), F.col("url").alias(f"url_{c}")) for c in ("a", "b"))
    return pairs.join(left, ["audit_id", "a"]).join(right, ["audit_id", "b"])


def report(facts: DataFrame, affected: DataFrame, shown: DataFrame, checks: tuple = C.CHECKS) -> DataFrame:
    """Findings with title, summary, evidence and affected_urls."""
    found = C.evaluate(facts, checks).join(texts(facts, checks), ["audit_id", "check_id"]).join(affected, ["audit_id", "check_id"], "left").join(shown, ["audit_id", "check_id"], "left")
    scored = ~F.col("status").isin("unavailable", "not_applicable")
    none = F.array().cast(f"array<{ITEM}>")
    items = F.when(scored, F.concat("shown", F.coalesce("items", none))).otherwise(none)
    urls = F.when(scored, F.coalesce("affected_urls", F.array().cast("array<string>"))).otherwise(F.array().cast("array<string>"))
    return found.select(*C.COLUMNS, "title", "summary", items.alias("evidence"), urls.alias("affected_urls"))
