"""Facts of a site: one row that the check catalogue reads, from page signals and evidence tables.

Only responses of 2xx count as pages, except where all responses are counted. A site without any gets
zeros. Evidence tables are joined by audit_id; a site that a table lacks has nulls there, which makes
its checks unavailable.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sitelens.functions import text as T
from sitelens.functions import urls as U
from sitelens.functions.columns import trim

#: What URLs of some kinds of pages hold, and labels that say nothing.
EDITORIAL = r"(?i)/(blog|article|news|insight|resource|guide)"
ESSAYS = r"(?i)/(blog|article|news|insight|resource|guide|case-stud)"
ABOUT, CONTACT = r"(?i)/(about|who-we-are|our-story|company|team)", r"(?i)/(contact|get-in-touch|reach-us|support)"
PEOPLE = r"(?i)/(author|people|team|leadership|experts)"
COMMERCIAL = r"(?i)/(product|service|solution|pricing|plans|shop)"
GENERIC = r"(?i)^(click here|here|read more|learn more|more|link|this|details)$"
LEGAL = r"(inc|llc|ltd|limited|pvt|private|gmbh|corp|corporation|co)$"
NEAR, LEAST_SHINGLES, TOP_TERMS = 0.7, 40, 18
_DATES = ("yyyy-MM-dd'T'HH:mm:ssXXX", "yyyy-MM-dd", "MMMM d, yyyy", "MMM d, yyyy", "d MMMM yyyy", "d MMM yyyy HH:mm:ss zzz")


def ok_pages(signals: DataFrame) -> DataFrame:
    return signals.where("status_code BETWEEN 200 AND 299")


def analysable(signals: DataFrame) -> DataFrame:
    """Pages that are the site itself and not a bot challenge."""
    return ok_pages(signals).where(~F.col("bot_challenge"))


def refused_sites(signals: DataFrame) -> DataFrame:
    """Sites without one analysable page: nothing about them may be scored."""
    seen = signals.groupBy("audit_id").agg(F.count_if(F.col("status_code").between(200, 299) & ~F.col("bot_challenge")).alias("n"), F.first("bot_challenge_vendor", ignorenulls=True).alias("vendor"))
    return seen.where("n = 0").select("audit_id", "vendor")


def broken_pages(signals: DataFrame) -> DataFrame:
    return signals.where("status_code >= 400 OR (status_code = 0 AND error IS NOT NULL)")


def parsed_date(text: Column) -> Column:
    """A moment from the usual ways to write one; null for the rest. The name of a weekday before it says nothing."""
    bare = F.regexp_replace(trim(text), r"^[A-Za-z]{3,9},\s+", "")
    return F.coalesce(F.try_to_timestamp(bare), *[F.try_to_timestamp(bare, F.lit(f)) for f in _DATES])


def months_between(newest: Column, as_of: Column) -> Column:
    """Age in months of 30 days."""
    return (as_of.cast("double") - newest.cast("double")) / (60 * 60 * 24 * 30)


def candidate_pairs(classes: DataFrame, key: str, least: float) -> DataFrame:
    """Pairs (key, a, b) of classes (key, first, shingles) that can be alike enough, by their first pages.

    Only the rarest ``n - ceil(least * n) + 1`` shingles of a page, counted over the site's classes, can be all that a
    pair has to share; it is a candidate if it shares so many of these that the others can make up for the rest. What
    stands on all pages of a site is rarest nowhere, so it brings no two of them together.
    """
    each = classes.select(key, "first", F.explode("shingles").alias("shingle"))
    often = each.groupBy(key, "shingle").agg(F.count("*").alias("often"))
    ranked = each.join(often, [key, "shingle"]).groupBy(key, "first").agg(F.sort_array(F.collect_list(F.struct("often", "shingle"))).alias("s"))

    def rest(n: Column | str) -> Column:
        """How many of ``n`` shingles are not among the rarest."""
        return F.ceil(F.col(n) * least - 1e-9).cast("int") - 1

    sized = ranked.select(key, "first", "s", F.size("s").alias("n"))
    few = sized.select(key, "first", "n", F.explode(F.slice("s", 1, F.col("n") - rest("n"))).alias("x")).where("x.often > 1").select(key, "first", "n", "x.shingle")
    a, b = few.alias("a"), few.alias("b")
    met = a.join(b, (F.col(f"a.{key}") == F.col(f"b.{key}")) & (F.col("a.shingle") == F.col("b.shingle")) & (F.col("a.first") < F.col("b.first")))
    met = met.select(F.col(f"a.{key}").alias(key), F.col("a.first").alias("a"), F.col("b.first").alias("b"), F.col("a.n").alias("na"), F.col("b.n").alias("nb")).groupBy(key, "a", "b", "na", "nb").agg(F.count("*").alias("c"))
    # Beyond those counted, no two classes share more than one of them has besides its rarest.
    most = F.least(F.col("c") + F.greatest(rest("na"), rest("nb")), "na", "nb")
    return met.where(most >= (F.col("na") + F.col("nb") - most) * least - 1e-6).select(key, "a", "b")


def near_duplicate_classes(signals: DataFrame, key: str = "audit_id", order: str = "page_ord", least: float = NEAR) -> tuple[DataFrame, DataFrame]:
    """Classes of pages with equal shingles (key, first, n) and pairs of classes (key, a, b, similarity) that are alike enough, by their first pages."""
    classes = signals.where(F.size("shingles") >= LEAST_SHINGLES).groupBy(key, "shingles").agg(F.count("*").alias("n"), F.min(order).alias("first"))
    met = candidate_pairs(classes, key, least)
    left, right = (classes.select(key, F.col("first").alias(c), F.col("shingles").alias(f"s{c}")) for c in ("a", "b"))
    compared = met.join(left, [key, "a"]).join(right, [key, "b"]).withColumn("similarity", T.jaccard(F.col("sa"), F.col("sb")))
    return classes.select(key, "first", "n"), compared.where(F.col("similarity") >= least).select(key, "a", "b", "similarity")


def near_duplicate_pages(signals: DataFrame, key: str = "audit_id", order: str = "page_ord", least: float = NEAR) -> DataFrame:
    """Pairs (key, a, b, similarity) of comparable pages of a site whose shingles are alike enough; each two of equal pages are a pair."""
    _, pairs = near_duplicate_classes(signals, key, order, least)
    pages = signals.where(F.size("shingles") >= LEAST_SHINGLES).select(key, F.col(order).alias("ord"), F.min(order).over(Window.partitionBy(key, "shingles")).alias("first"))
    left, right = (pages.select(key, F.col("ord").alias(f"o{c}"), F.col("first").alias(c)) for c in ("a", "b"))
    other = pairs.join(left, [key, "a"]).join(right, [key, "b"]).select(key, F.least("oa", "ob").alias("a"), F.greatest("oa", "ob").alias("b"), "similarity")
    equal = left.join(right, (left[key] == right[key]) & (left["a"] == right["b"]) & (F.col("oa") < F.col("ob"))).select(left[key], F.col("oa").alias("a"), F.col("ob").alias("b"), F.lit(1.0).alias("similarity"))
    return other.unionByName(equal)


#: Pages of a site that are met at a time where all its pairs are counted; their places are 16 bits.
_BLOCK = 16_384
#: Rows that leave a counting task at a time.
_ROWS = 65_536


def _met_block(keys: np.ndarray, ends: np.ndarray, places: np.ndarray, sizes: np.ndarray, hashes: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Places in a block of the pages that are alike enough to one of ``hashes``, and the similarities.

    ``keys``: the block's distinct hashes in order; ``ends``: where the places of each end in ``places``.
    """
    at = np.searchsorted(keys, hashes)
    at = at[(at < len(keys)) & (keys[np.minimum(at, len(keys) - 1)] == hashes)] if len(keys) else at[:0]
    starts, ends = np.where(at > 0, ends[at - 1], 0) if len(at) else at, ends[at]
    many = ends - starts
    counts = np.zeros(len(sizes), np.int64)
    # A few shingles at a time where they stand on many pages.
    step = max(1, _ROWS // (int(many.max()) or 1)) if len(many) else 1
    for i in range(0, len(at), step):
        n = many[i : i + step]
        spots = np.repeat(starts[i : i + step] - np.cumsum(n) + n, n) + np.arange(n.sum())
        counts += np.bincount(places[spots], minlength=len(sizes))
    found = np.flatnonzero(counts)
    shared = counts[found].astype(np.float64)
    alike = shared / (sizes[found] + len(hashes) - shared)
    close = alike >= least
    return found[close], alike[close]


def _met_blocks(least: float):
    """Of rows (site, turn, side, ord, s) in order, those of each turn's side 0 indexed and those of side 1 looked up in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn, index, first = None, None, []
        out: list[tuple] = []
        held = 0

        def made() -> Iterator[pa.RecordBatch]:
            nonlocal held
            if out:
                site = pa.DictionaryArray.from_arrays(pa.array(np.repeat(np.arange(len(out), dtype=np.int32), [len(o[1]) for o in out])), pa.array([o[0] for o in out], pa.string())).cast(pa.string())
                a, b, alike = (pa.array(np.concatenate([o[k] for o in out])) for k in (1, 2, 3))
                yield pa.RecordBatch.from_arrays([site, a, b, alike], names=["site", "a", "b", "similarity"])
            out.clear()
            held = 0

        for batch in batches:
            site, now, side, ords, lists = (batch.column(c) for c in ("site", "turn", "side", "ord", "s"))
            for i in range(batch.num_rows):
                key = (site[i].as_py(), now[i].as_py())
                if key != turn:
                    turn, index, first = key, None, []
                hashes = np.frombuffer(lists[i].as_buffer(), np.uint32)
                if side[i].as_py() == 0:
                    first.append((ords[i].as_py(), hashes.copy()))
                    continue
                if index is None:
                    # Hash and place in one number, sorted in place.
                    packed = np.concatenate([h.astype(np.uint64) << np.uint64(16) | np.uint64(p) for p, (_, h) in enumerate(first)]) if first else np.zeros(0, np.uint64)
                    packed.sort()
                    places, all_keys = (packed & np.uint64(0xFFFF)).astype(np.uint16), (packed >> np.uint64(16)).astype(np.uint32)
                    last = np.flatnonzero(np.append(all_keys[1:] != all_keys[:-1], True)) if len(all_keys) else np.zeros(0, int)
                    index = (all_keys[last], last + 1, places, np.array([len(h) for _, h in first], np.float64), np.array([o for o, _ in first], np.int64))
                    first = []
                found, alike = _met_block(*index[:4], hashes, least)
                other, own = index[4][found], ords[i].as_py()
                # Within one block each pair is met from both sides.
                kept = other < own if key[1] % (1 << 32) == key[1] >> 32 else other != own
                other, alike = other[kept], alike[kept]
                if len(other):
                    out.append((key[0], np.minimum(other, own), np.maximum(other, own), alike))
                    held += len(other)
                    if held >= _ROWS:
                        yield from made()
        yield from made()

    return run


def shared_pairs(pages: DataFrame, key: str = "audit_id", order: str = "page_ord", least: float = NEAR, block: int = _BLOCK) -> DataFrame:
    """The pairs of ``near_duplicate_pages`` where almost every two pages that share a shingle are alike enough.

    The pages of a site are dealt into blocks, and each two blocks meet in one turn, where shared shingles are counted. Only pages
    are shuffled, once for each block of their site, never pairs; a turn holds one block's shingles. Shingles are of 32 bits.
    """
    comparable = pages.where((F.size("shingles") >= LEAST_SHINGLES) & F.col(order).isNotNull())
    blocks = comparable.groupBy(F.col(key).alias("_k")).agg(F.ceil(F.count("*") / block).cast("int").alias("_blocks")).where("_blocks > 0")

    def packed(lists: pd.Series) -> pd.Series:
        return pd.Series([np.asarray(s).astype(np.uint32).tobytes() for s in lists], dtype=object)

    flat = F.pandas_udf(packed, "binary").asNondeterministic()(F.col("shingles"))
    dealt = comparable.join(blocks, F.col(key) == F.col("_k")).select(F.col(key).alias("site"), F.col(order).cast("bigint").alias("ord"), F.pmod(F.xxhash64(order), "_blocks").cast("bigint").alias("own"), "_blocks", flat.alias("s"))
    other = F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)).alias("other")
    turns = dealt.select("site", "ord", "own", "s", other).withColumn("turn", F.shiftleft(F.least("own", F.col("other").cast("bigint")), 32) + F.greatest("own", F.col("other").cast("bigint")))
    # A page of the only block of a turn is both indexed and looked up.
    sides = F.when(F.col("own") == F.col("other"), F.array(F.lit(0), F.lit(1))).when(F.col("own") < F.col("other"), F.array(F.lit(0))).otherwise(F.array(F.lit(1)))
    rows = turns.repartition("site", "turn").select("site", "turn", F.explode(sides).alias("side"), "ord", "s").sortWithinPartitions("site", "turn", "side")
    met = rows.mapInArrow(_met_blocks(least), "site string, a bigint, b bigint, similarity double")
    return met.select(F.col("site").alias(key), "a", "b", "similarity")


def near_duplicate_counts(signals: DataFrame) -> DataFrame:
    """audit_id, alike: the number of pairs of near duplicates, counted by classes."""
    classes, pairs = near_duplicate_classes(signals)
    left, right = (classes.select("audit_id", F.col("first").alias(c), F.col("n").alias(f"n{c}")) for c in ("a", "b"))
    across = pairs.join(left, ["audit_id", "a"]).join(right, ["audit_id", "b"]).select("audit_id", (F.col("na") * F.col("nb")).alias("k"))
    inside = classes.where("n > 1").select("audit_id", (F.col("n") * (F.col("n") - 1) / 2).cast("bigint").alias("k"))
    return across.unionByName(inside).groupBy("audit_id").agg(F.sum("k").alias("alike"))


def orphan_pages(signals: DataFrame) -> DataFrame:
    """Pages below the homepage that no other page of the site links to."""
    good = ok_pages(signals)
    links = good.select("audit_id", F.col("url").alias("source"), F.explode("internal_links").alias("target"))
    own = good.where("depth > 0").withColumn("target", F.col("own_url")).alias("p")
    met = (F.col("p.audit_id") == F.col("l.audit_id")) & (F.col("p.target") == F.col("l.target")) & (F.col("p.url") != F.col("l.source"))
    return own.join(links.alias("l"), met, "left_anti").drop("target")


def repeats(pages: DataFrame, column: str) -> DataFrame:
    """Per site, how many pages share their ``column`` with another page, whatever its case and outer blanks."""
    keys = pages.where(trim(F.col(column)) != "").groupBy("audit_id", F.lower(trim(F.col(column))).alias("k")).count()
    return keys.groupBy("audit_id").agg(F.sum(F.when(F.col("count") > 1, F.col("count")).otherwise(0)).alias(f"{column}_repeats"))


def anchor_counts(pages: DataFrame) -> DataFrame:
    label = pages.select("audit_id", F.explode(F.transform("anchor_texts", F.lower)).alias("label")).groupBy("audit_id", "label").count()
    generic = F.when(trim(F.col("label")).rlike(GENERIC), F.col("count")).otherwise(0)
    return label.groupBy("audit_id").agg(F.sum("count").alias("anchors"), F.count("*").alias("anchors_distinct"), F.sum(generic).alias("anchors_generic"))


def brands(signals: DataFrame, hosts: DataFrame) -> DataFrame:
    """Name, category and descriptor of each site's brand, and whether its names agree. ``hosts``: audit_id, host."""
    home = F.min_by(F.struct("title", "open_graph", "meta_description", "headings"), F.struct(F.col("depth") != 0, "page_ord"))
    org = F.max_by("organisation", F.when(F.col("organisation").isNotNull(), F.struct(F.col("organisation.keys"), -F.col("page_ord"))))
    rolled = hosts.select("audit_id", "host").join(ok_pages(signals).groupBy("audit_id").agg(home.alias("home"), org.alias("org")), "audit_id", "left")
    first = F.get(F.filter("home.headings", lambda h: h["level"] == 1), F.lit(0))["text"]
    site_name = trim(F.try_element_at("home.open_graph", F.lit("og:site_name")))
    names = [F.col("org.name"), F.col("org.legal_name"), site_name, T.brand_from_title(F.col("home.title")), T.host_to_brand(F.lower("host"))]
    named = rolled.withColumn("_names", F.array(*names))
    kind, descriptor = T.category(F.col("org.description"), F.try_element_at("home.open_graph", F.lit("og:description")), F.col("home.meta_description"), first)
    variants = F.array_distinct(F.filter("_names", lambda v: (v != "") & (F.char_length(v) <= 60)))
    forms = F.array_distinct(F.transform(variants, lambda v: F.regexp_replace(F.regexp_replace(F.lower(v), "[^a-z0-9]", ""), LEGAL, "")))
    chosen = F.coalesce(*[F.when(F.get("_names", F.lit(i)) != "", F.get("_names", F.lit(i))) for i in (0, 2, 3, 4)])
    return named.select(
        "audit_id", chosen.alias("name"), kind.alias("category"), descriptor.alias("descriptor"), variants.alias("name_variants"), (F.size(forms) <= 1).alias("one_name"),
        F.coalesce(F.char_length(kind), F.lit(0)).alias("category_length"), F.exists("home.headings", lambda h: (h["level"] == 1) & (F.char_length(h["text"]) > 10)).alias("home_h1"),
        F.coalesce(F.char_length("home.meta_description") > 40, F.lit(False)).alias("home_meta"), F.col("org.weight").alias("org_weight"),
        F.coalesce(F.size("org.same_as"), F.lit(0)).cast("bigint").alias("same_as"), F.col("org.same_as").alias("org_same_as"), F.col("org.present").alias("org_present"), F.coalesce("org.address", F.lit(False)).alias("org_address"), F.coalesce("org.area", F.lit(False)).alias("org_area"),
    )


def top_terms(signals: DataFrame, most: int = TOP_TERMS) -> DataFrame:
    """audit_id, top_terms: the heaviest terms of the pages' excerpts, equal ones as they come first."""
    seen = ok_pages(signals).select("audit_id", "page_ord", F.posexplode(T.top_terms(T.content_tokens(F.col("excerpt")))).alias("at", "t"))
    weighed = seen.groupBy("audit_id", F.col("t.term").alias("term")).agg(F.sum("t.weight").alias("weight"), F.min(F.struct("page_ord", "at")).alias("first")).where("weight > 1 AND char_length(term) > 3")
    place = F.row_number().over(Window.partitionBy("audit_id").orderBy(F.desc("weight"), "first"))
    best = weighed.withColumn("place", place).where(F.col("place") <= most)
    return best.groupBy("audit_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("place", "term"))), lambda x: x["term"]).alias("top_terms"))


def _page_flags(signals: DataFrame) -> DataFrame:
    """Signals that an aggregate reads several times."""
    heads = F.array_join(F.transform("headings", lambda h: h["text"]), " ")
    named = F.concat_ws(" ", F.coalesce("title", F.lit("")), heads)
    needles = F.transform("faq_answers", lambda a: F.lower(F.substring(trim(F.regexp_replace(F.regexp_replace(a, "<[^>]+>", " "), r"\s+", " ")), 1, 60)))

    def stands(needle: Column) -> Column:
        answered = F.exists("question_headings", lambda q: F.contains(F.lower(F.coalesce(q["answer"], F.lit(""))), needle))
        return (F.char_length(needle) >= 20) & (F.contains(F.lower("excerpt"), needle) | answered)

    return signals.withColumns({
        "_ok": F.col("status_code").between(200, 299), "_intent": T.intent(F.lower(F.concat_ws(" ", "url", named))), "_named": named, "_topic": F.concat_ws(" ", "url", F.coalesce("title", F.lit(""))),
        "_aligned": F.size(F.filter(needles, stands)), "_date": parsed_date(F.coalesce("date_modified", "date_published")),
        "_own": F.coalesce(F.col("canonical_url") == F.col("own_url"), F.lit(False)),
    })


def resolved_canonicals(signals: DataFrame) -> DataFrame:
    """Relative canonical links against their pages' addresses; absolute ones stay as they are."""
    relative = F.col("canonical").isNotNull() & ~F.col("canonical").rlike("(?i)^https?://")
    return signals.withColumn("canonical", F.when(relative, F.col("canonical_url")).otherwise(F.col("canonical")))


def page_facts(signals: DataFrame, as_of: Column) -> DataFrame:
    """One row for each site from its pages alone."""
    pages = _page_flags(signals)
    ok = F.col("_ok")

    def count(condition: Column | str) -> Column:
        return F.count_if(ok & (F.expr(condition) if isinstance(condition, str) else condition))

    def total(value: Column | str) -> Column:
        return F.coalesce(F.sum(F.when(ok, value if isinstance(value, Column) else F.expr(value))), F.lit(0))

    def middle(value: str, where: str = "true") -> Column:
        return F.coalesce(F.median(F.when(ok & F.expr(where), F.expr(value).cast("double"))), F.lit(0.0))

    def has(kind: str) -> Column:
        return F.array_contains("json_ld_types", kind)

    url, described, titled = F.col("url"), trim(F.col("meta_description")) != "", trim(F.col("title")) != ""
    essay = url.rlike(ESSAYS)
    rolled = pages.groupBy("audit_id").agg(
        F.count("*").alias("pages"), F.count_if(F.expr("status_code >= 400 OR (status_code = 0 AND error IS NOT NULL)")).alias("broken"), F.count_if(ok).alias("pages_ok"),
        count("robots_meta.noindex").alias("noindex"), count("coalesce(canonical, '') <> ''").alias("canonicals"), count("coalesce(canonical, '') <> '' AND _own").alias("canonicals_own"), count("depth > 3").alias("deep"),
        count("csr_dependent").alias("csr"), count(titled).alias("titled"), count(titled & F.char_length("title").between(30, 60)).alias("titles_sized"), count(described).alias("described"),
        count("h1_count >= 1").alias("h1_any"), count("h1_count = 1").alias("h1_one"), count("heading_hierarchy_breaks = 0").alias("ordered"), total("images.total").alias("images"),
        total("images.with_alt + images.decorative").alias("images_alt"), middle("word_count").alias("median_words"), count("word_count < 300 AND NOT csr_dependent").alias("thin"),
        count(F.size("shingles") >= LEAST_SHINGLES).alias("comparable"), count("size(json_ld_types) > 0 OR size(microdata_types) > 0").alias("schema_any"), count("size(json_ld_types) > 0").alias("schema_pages"),
        count("json_ld_parse_errors > 0").alias("schema_errors"), count(has("BreadcrumbList")).alias("breadcrumbs"), count("json_ld_has_ids").alias("schema_ids"), middle("size(internal_links)").alias("median_links"),
        total("size(external_links)").alias("external"), count("size(external_links) > 0").alias("citing"), total("size(question_headings)").alias("questions"),
        total(F.size(F.filter("question_headings", lambda q: q["qualifies"]))).alias("questions_answered"), total("definition_blocks").alias("definitions"), total("statistic_claims").alias("statistics"),
        total("quotable_passages").alias("quotable"), total("blockquotes").alias("blockquotes"), total("lists.ul + lists.ol + lists.table + lists.dl").alias("list_units"), total("word_count").alias("words"),
        middle("median_paragraph_words", "median_paragraph_words > 0").alias("median_paragraph"), count("coalesce(try_element_at(semantic_tags, 'main'), 0) + coalesce(try_element_at(semantic_tags, 'article'), 0) > 0").alias("semantic"),
        count(has("FAQPage")).alias("faq"), count(has("QAPage")).alias("qa"), count(has("HowTo")).alias("howto"), (count(T.has_word(F.col("_named"), T.PROCEDURAL) & (F.col("lists.ol") > 0)) > 0).alias("procedural"),
        count(F.exists("json_ld_types", lambda t: t.rlike("Article|BlogPosting|NewsArticle"))).alias("articles"), count(url.rlike(EDITORIAL)).alias("editorial"), count(essay).alias("essays"),
        count(essay & F.col("author_name").isNotNull()).alias("bylined"), count(essay & F.col("has_author_schema")).alias("author_schema"), (count(url.rlike(ABOUT)) > 0).alias("about"),
        (count(url.rlike(CONTACT)) > 0).alias("contact"), (count(url.rlike(PEOPLE)) > 0).alias("people_page"), count("date_published IS NOT NULL OR date_modified IS NOT NULL").alias("dated"),
        months_between(F.max(F.when(ok, F.col("_date"))), as_of).alias("months_old"), total(F.when(has("FAQPage"), F.size("faq_answers")).otherwise(0)).alias("faq_checked"),
        total(F.when(has("FAQPage"), F.col("_aligned")).otherwise(0)).alias("faq_aligned"), *[(count(F.col("_intent") == name) > 0).alias(name) for name, _ in T.INTENTS], count(has("Person")).alias("persons"),
        count(has("PostalAddress")).alias("postal"), count(F.exists("json_ld_types", lambda t: t.isin("Product", "Service", "Offer", "SoftwareApplication"))).alias("product_schema"),
        count(url.rlike(COMMERCIAL)).alias("commercial_pages"), count(T.has_word(F.col("_topic"), T.COMPARISON)).alias("comparisons"), count(T.has_word(F.col("_topic"), T.RESEARCH)).alias("research"),
    )
    good = ok_pages(signals)
    extra = [
        repeats(good, "title"), repeats(good, "meta_description").withColumnRenamed("meta_description_repeats", "meta_repeats"), anchor_counts(good),
        near_duplicate_counts(good), orphan_pages(signals).groupBy("audit_id").agg(F.count("*").alias("orphans")),
    ]
    joined = reduce(lambda left, right: left.join(right, "audit_id", "left"), extra, rolled)
    return joined.fillna(0, ["title_repeats", "meta_repeats", "anchors", "anchors_distinct", "anchors_generic", "alike", "orphans"])


#: Columns of each evidence table besides audit_id; a table that is not given has nulls for all sites.
EVIDENCE = {
    "performance": {"performance_source": "string", "performance_score": "double", "lcp_ms": "double", "cls": "double", "ttfb_ms": "double", "mobile_score": "double"},
    "entity": {"entity_checked": "boolean", "qid": "string"}, "authority": {"page_rank": "double"}, "citations": {"tier_weight": "double", "tier7_weight": "double"},
    "overviews": {"aio_checked": "bigint", "aio_present": "bigint", "aio_cites": "bigint", "aio_domains": "bigint"},
    "answers": {"ai_samples": "bigint", "ai_mentioned": "bigint", "ai_cited": "bigint", "voice_pct": "double", "ai_positive": "bigint", "ai_negative": "bigint"},
    "gaps": {"gaps": "bigint", "gaps_answered": "bigint"},
}
DISCOVERY = {
    "https": "boolean", "home_status": "int", "redirects": "int", "one_host": "boolean", "blanket_block": "boolean", "robots_found": "boolean", "robots_errors": "bigint", "sitemaps_declared": "bigint",
    "sitemap_found": "boolean", "sitemap_lastmod": "boolean", "sitemap_urls": "bigint", "retrievers": "bigint", "retrievers_blocked": "bigint", "llms_found": "boolean", "feeds": "bigint",
}


def site_facts(signals: DataFrame, discovery: DataFrame, brand: DataFrame, as_of: Column, **evidence: DataFrame) -> DataFrame:
    """The row of facts of each site. ``discovery`` has a row for each site; ``evidence`` by the names of EVIDENCE."""
    out = page_facts(signals, as_of).join(discovery.select("audit_id", *DISCOVERY), "audit_id", "left")
    out = out.join(brand.select("audit_id", "one_name", "category_length", "home_h1", "home_meta", "org_weight", "same_as", "org_address", "org_area"), "audit_id", "left")
    for name, columns in EVIDENCE.items():
        if evidence.get(name) is not None:
            out = out.join(evidence[name].select("audit_id", *[F.col(c).cast(t) for c, t in columns.items()]), "audit_id", "left")
        else:
            out = out.withColumns({c: F.lit(None).cast(t) for c, t in columns.items()})
    return out.withColumn("entity_checked", F.coalesce("entity_checked", F.lit(False)))


def heading_breaks(headings: DataFrame) -> DataFrame:
    """Of rows (page, ord, level) the number of headings more than one level below the one before."""
    before = F.lag("level").over(Window.partitionBy("page").orderBy("ord"))
    return headings.withColumn("_jump", F.coalesce(F.col("level") - before > 1, F.lit(False))).groupBy("page").agg(F.count_if("_jump").alias("breaks"))
