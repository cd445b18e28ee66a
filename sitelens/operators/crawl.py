"""A breadth-first crawl over a stored link graph, for all sites at once.

Every round takes up to ``batch`` addresses of each site's frontier, those found by links before those of the
sitemap and shallow ones first, and fetches what robots rules allow; what they block spends no budget. Links of
pages above the greatest depth are followed once; a link counts as seen even where the frontier has no
room for it. The number of rounds is bounded by the budget and the frontier's size, not by the sites.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sitelens.functions import urls as U
from sitelens.operators.discovery import fetchable
from sitelens.sources.tables import stored

PAGES, DEPTH, BATCH, ROOM = 25, 4, 5, 3


def spread(urls: DataFrame, most: int) -> DataFrame:
    """Of rows audit_id, ord, url the first ``most``, taken in turn from the first parts of the paths."""
    prefix = F.regexp_extract(U.path(F.col("url")), "^/([^/]*)", 1)
    by_prefix = Window.partitionBy("audit_id", "_prefix")
    turned = urls.withColumn("_prefix", prefix).withColumn("_turn", F.row_number().over(by_prefix.orderBy("ord"))).withColumn("_seen", F.min("ord").over(by_prefix))
    # No prefix gives more than ``most``, so the second sort is small.
    few = turned.where(F.col("_turn") <= most)
    placed = few.withColumn("place", F.row_number().over(Window.partitionBy("audit_id").orderBy("_turn", "_seen")))
    return placed.where(F.col("place") <= most).select("audit_id", "place", "url")


def _first(rows: DataFrame, order: list) -> DataFrame:
    """One row for each address of a site."""
    turn = F.row_number().over(Window.partitionBy("audit_id", "url").orderBy(*order))
    return rows.withColumn("_turn", turn).where("_turn = 1").drop("_turn")


def crawl(starts: DataFrame, links: DataFrame, rules: DataFrame, files: DataFrame, sampled: DataFrame, agent: str, pages: int = PAGES, depth: int = DEPTH, batch: int = BATCH) -> DataFrame:
    """audit_id, url, depth, state (fetched, blocked or queued), place for every address that was taken up.

    ``starts``: audit_id, url. ``links``: audit_id, url, link_ord, link, the link graph. ``sampled``: audit_id,
    ord, url of the sitemap. ``rules`` and ``files``: the robots tables of discovery.
    """
    start = starts.select("audit_id", U.canonical(F.col("url")).alias("url")).where("url IS NOT NULL")
    site = start.select("audit_id", U.registrable(U.host(F.col("url"))).alias("site"))

    def inside(url: str) -> Column:
        return U.registrable(U.host(F.col(url))) == F.col("site")

    seeds = spread(sampled, 2 * pages).join(site, "audit_id").where(inside("url") & U.is_html(F.col("url")))
    # Addresses are read once; the rounds only move them.
    links = stored(links.join(site, "audit_id").where(inside("link")).select("audit_id", "url", "link_ord", "link", U.path(F.col("link")).alias("link_path")))
    seeds = seeds.select("audit_id", "url", F.least(U.depth(F.col("url")), F.lit(depth)).alias("depth"), F.lit(1).alias("priority"), (F.col("place") + 1).cast("bigint").alias("seq"))
    first = start.select("audit_id", "url", F.lit(0).alias("depth"), F.lit(0).alias("priority"), F.lit(0).cast("bigint").alias("seq"))
    taken = stored(_first(first.unionByName(seeds), ["priority", "seq"]).withColumns({"path": U.path(F.col("url")), "state": F.lit("queued"), "place": F.lit(None).cast("int")}))
    seen = stored(taken.select("audit_id", "url"))
    for number in range(1, ROOM * pages + 2):
        done = taken.groupBy("audit_id").agg(F.count_if(F.col("state") == "fetched").alias("fetched"), F.count_if(F.col("state") == "queued").alias("queued"))
        order = Window.partitionBy("audit_id").orderBy("priority", "depth", "seq")
        queue = taken.where("state = 'queued'").join(done.where((F.col("fetched") < pages) & (F.col("queued") > 0)), "audit_id").withColumn("turn", F.row_number().over(order))
        now = queue.where(F.col("turn") <= F.least(F.lit(batch), pages - F.col("fetched")))
        now = stored(now.select("audit_id", "url", "path", "depth", "turn", "fetched", "queued"))
        if now.isEmpty():
            break
        open_ = fetchable(now, rules, files, agent).select("audit_id", "url").withColumn("open", F.lit(True))
        judged = now.join(open_, ["audit_id", "url"], "left").withColumn("open", F.coalesce("open", F.lit(False)))
        by_turn = Window.partitionBy("audit_id").orderBy("turn")
        judged = stored(judged.withColumn("nth", F.sum(F.col("open").cast("int")).over(by_turn)).withColumn("taking", F.max("turn").over(Window.partitionBy("audit_id"))))
        found = judged.where("open").where(F.col("depth") < depth).drop("path").join(links, ["audit_id", "url"])
        found = found.select("audit_id", F.col("link").alias("url"), F.col("link_path").alias("path"), (F.col("depth") + 1).alias("depth"), "turn", "link_ord", "nth", "fetched", F.col("queued").alias("waiting"), "taking")
        new = _first(found, ["turn", "link_ord"]).join(seen, ["audit_id", "url"], "left_anti")
        # Room shrinks with every page of the round and every address that got in before.
        new = new.withColumn("entry", F.row_number().over(Window.partitionBy("audit_id").orderBy("turn", "link_ord")))
        new = stored(new.withColumn("fits", F.col("fetched") + F.col("nth") + F.col("waiting") - F.col("taking") + F.col("entry") - 1 < ROOM * pages))
        state = judged.select("audit_id", "url", F.when(F.col("open"), "fetched").otherwise("blocked").alias("_state"), (F.col("fetched") + F.col("nth")).alias("_place"))
        old = taken.join(state, ["audit_id", "url"], "left")
        place = F.coalesce("place", F.when(F.col("_state") == "fetched", F.col("_place")).cast("int"))
        old = old.withColumn("place", place).withColumn("state", F.coalesce("_state", "state")).drop("_state", "_place")
        more = new.where("fits").select("audit_id", "url", "path", "depth", F.lit(0).alias("priority"), (F.lit(number << 32) + F.col("entry")).alias("seq"), F.lit("queued").alias("state"), F.lit(None).cast("int").alias("place"))
        taken = stored(old.unionByName(more))
        seen = stored(seen.unionByName(new.select("audit_id", "url")))
    return taken.select("audit_id", "url", "depth", "state", "place")


def discovered(crawled: DataFrame, links: DataFrame, sitemap_urls: DataFrame) -> DataFrame:
    """Per site how many addresses are known: those taken up or linked from a fetched page, or the sitemap's number if it is greater."""
    fetched = crawled.where("state = 'fetched'").select("audit_id", "url")
    known = crawled.select("audit_id", "url").unionByName(links.join(fetched, ["audit_id", "url"], "left_semi").select("audit_id", F.col("link").alias("url")))
    counted = known.groupBy("audit_id").agg(F.count_distinct("url").alias("n"))
    return counted.join(sitemap_urls.select("audit_id", "url_count"), "audit_id", "left").select("audit_id", F.greatest("n", F.coalesce("url_count", F.lit(0))).alias("discovered"))


def not_visited(crawled: DataFrame, links: DataFrame) -> DataFrame:
    """Linked addresses that were never fetched."""
    fetched = crawled.where("state = 'fetched'").select("audit_id", "url")
    return links.select("audit_id", F.col("link").alias("url")).distinct().join(fetched, ["audit_id", "url"], "left_anti")
