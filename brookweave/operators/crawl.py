"""Crawling a link graph: breadth first, level by level, under page, depth and character budgets.

The driver loops over the levels (max_depth of them); each level is one join of the frontier with the edges, an anti
join with what was queued before, and a top-k of each page's links.  Levels are written to the checkpoint folder, so
lineage stays short and lost executors cost no replay.
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _cut(df: DataFrame) -> DataFrame:
    """df written to the folder of spark.checkpoint.dir; only a local session may have one of its own."""
    sc = df.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        where = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not where and not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(where or os.path.join(tempfile.gettempdir(), f"brookweave-{sc.applicationId}"))
    return df.checkpoint(eager=True)


def candidates(edges: DataFrame) -> DataFrame:
    """Edges that a crawl may follow: same host, http(s), no document or image, no fragment."""
    from ..functions.urls import host_of

    d = F.col("dst")
    return edges.filter(
        (host_of(F.col("src")) == host_of(d)) & d.rlike("^https?://") & ~d.rlike(r"\.(pdf|jpg|png)$") & ~F.contains(d, F.lit("#"))
    )


def link_score(anchor: Column, terms: list[str]) -> Column:
    low = F.lower(anchor)
    total: Column = F.lit(0)
    for t in terms:
        total = total + F.when(F.contains(low, F.lit(t)), 1).otherwise(0)
    return total


def bfs(edges: DataFrame, seeds: DataFrame, max_depth: int, fan_out: int = 10) -> DataFrame:
    """(node, depth): all nodes reached; edges are (src, dst, score, pos), seeds (node).

    Of each page only the fan_out best links (score, then position) are followed.
    """
    best = Window.partitionBy("src").orderBy(F.desc("score"), "pos")
    kept = _cut(edges.withColumn("_r", F.row_number().over(best)).filter(F.col("_r") <= fan_out).select("src", "dst"))
    frontier = _cut(seeds.select("node").distinct().withColumn("depth", F.lit(0)))
    seen = frontier
    for depth in range(1, max_depth + 1):
        found = frontier.join(kept, frontier["node"] == kept["src"]).select(F.col("dst").alias("node")).distinct()
        frontier = _cut(found.join(seen, "node", "left_anti").withColumn("depth", F.lit(depth)))
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)  # every level is written once
    return seen


def crawl(links: DataFrame, pages: DataFrame, seeds: DataFrame, max_depth: int = 2, max_pages: int = 10, max_chars: int | None = None, fan_out: int = 10) -> DataFrame:
    """(seed, url, depth, ord, ok, chars): the pages that a crawl from each seed fetches, in order; ok is false for failed ones.

    links are (src, dst, score, pos), pages (url, chars), seeds (seed, url); urls are normalized.  Pages of a level are
    fetched in the order in which they were queued.  A crawl ends at max_pages pages or once its characters pass
    max_chars; the page that passes them stays, but its links are not followed.  Of each page the fan_out best links that
    no earlier level has queued are followed; a link that two pages of a level share belongs to the first.
    """
    frontier = _cut(seeds.select("seed", "url").distinct().withColumn("ord", F.lit(1).cast("bigint")))
    queued = frontier.select("seed", "url")
    state = done = None
    for depth in range(max_depth + 1):
        f = frontier.join(pages, "url", "left").withColumn("ok", F.col("chars").isNotNull()).withColumn("chars", F.coalesce("chars", F.lit(0)).cast("bigint"))
        if state is None:
            f = f.withColumn("_n", F.lit(0).cast("bigint")).withColumn("_c", F.lit(0).cast("bigint"))
        else:
            f = f.join(state, "seed")
        before = Window.partitionBy("seed").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
        n = F.col("_n") + F.coalesce(F.sum(F.col("ok").cast("bigint")).over(before), F.lit(0))
        c = F.col("_c") + F.coalesce(F.sum("chars").over(before), F.lit(0))
        f = f.withColumn("_n", n).withColumn("_c", c).filter(F.col("_n") < max_pages)
        if max_chars is not None:
            f = f.filter(F.col("_c") < max_chars)
        level = _cut(f.withColumn("depth", F.lit(depth)))
        rows = level.select("seed", "url", "depth", "ord", "ok", "chars")
        done = rows if done is None else done.unionByName(rows)
        if depth == max_depth or level.isEmpty():
            break
        state = level.groupBy("seed").agg(F.max(F.col("_n") + F.col("ok").cast("bigint")).alias("_n"), F.max(F.col("_c") + F.col("chars")).alias("_c"))
        follow = level.filter("ok")
        if max_chars is not None:
            follow = follow.filter(F.col("_c") + F.col("chars") <= max_chars)
        found = follow.select("seed", F.col("url").alias("src"), "ord").join(links, "src").withColumnRenamed("dst", "url").join(queued, ["seed", "url"], "left_anti")
        best = Window.partitionBy("seed", "src").orderBy(F.desc("score"), "pos")
        found = found.withColumn("_r", F.row_number().over(best)).filter(F.col("_r") <= fan_out)
        found = found.groupBy("seed", "url").agg(F.min(F.struct("ord", "_r")).alias("_o"))
        # a crawl queues fan_out links of at most max_pages pages a level, so a window by seed stays small
        found = found.withColumn("ord", F.row_number().over(Window.partitionBy("seed").orderBy("_o", "url")).cast("bigint")).drop("_o")
        frontier = _cut(found)
        queued = queued.unionByName(frontier.select("seed", "url"))
    return done


def discover(links: DataFrame, seeds: DataFrame, max_depth: int = 2, max_pages: int = 10) -> DataFrame:
    """(seed, url): the addresses that a crawl would queue from each seed, at most max_pages, by level and position."""
    frontier = _cut(seeds.select("seed", "url").distinct())
    seen = frontier.withColumn("_at", F.lit(0))
    for depth in range(1, max_depth + 1):
        found = frontier.withColumnRenamed("url", "src").join(links, "src").groupBy("seed", F.col("dst").alias("url")).agg(F.min("pos").alias("_p"))
        found = _cut(found.join(seen.select("seed", "url"), ["seed", "url"], "left_anti"))
        if found.isEmpty():
            break
        frontier = found.select("seed", "url")
        seen = seen.unionByName(frontier.withColumn("_at", F.lit(depth)))
    first = Window.partitionBy("seed").orderBy("_at", "url")
    return seen.withColumn("_r", F.row_number().over(first)).filter(F.col("_r") <= max_pages).select("seed", "url")


def crawl_sitemap(urls: DataFrame, pages: DataFrame, max_pages: int = 10, max_chars: int | None = None) -> DataFrame:
    """(seed, url, ord, ok, chars): the first max_pages addresses of a sitemap in order, each normalized one once."""
    first = urls.groupBy("seed", "url").agg(F.min("ord").alias("ord"))
    w = Window.partitionBy("seed").orderBy("ord")
    f = first.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= max_pages).join(pages, "url", "left")
    f = f.withColumn("ok", F.col("chars").isNotNull()).withColumn("chars", F.coalesce("chars", F.lit(0)).cast("bigint"))
    f = f.withColumn("_c", F.coalesce(F.sum("chars").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return (f if max_chars is None else f.filter(F.col("_c") < max_chars)).select("seed", "url", "ord", "ok", "chars")


#: Ids of one range of the running sum.
RANGE = 65_536


def within_budget(pages: DataFrame, group: str, order: str, size: str, limit: int) -> DataFrame:
    """Pages in order until the budget is used up; the page that crosses it is kept.

    order is a unique number within the group.  The running sum goes within ranges of RANGE numbers, and ranges hand on
    their totals, so a group with a third of all pages is no single task.
    """
    p = pages.withColumn("_seg", F.floor(F.col(order) / RANGE))
    total = p.groupBy(F.col(group).alias("_e"), F.col("_seg").alias("_g")).agg(F.sum(size).alias("_sum"))
    total = total.withColumn("_carry", F.coalesce(F.sum("_sum").over(Window.partitionBy("_e").orderBy("_g").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    # ranges that start beyond the budget hold nothing
    p = p.join(total.filter(F.col("_carry") < limit).drop("_sum"), p[group].eqNullSafe(F.col("_e")) & (p["_seg"] == F.col("_g")))
    own = Window.partitionBy(group, "_seg").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    used = F.col("_carry") + F.coalesce(F.sum(size).over(own), F.lit(0))
    return p.withColumn("used", used).filter(F.col("used") < limit).drop("_seg", "_e", "_g", "_carry")


def sitemap_urls(maps: DataFrame, xml: str, host: str) -> DataFrame:
    """(url): the locations of a host's sitemaps that lie on the host itself, each once."""
    from ..functions.urls import host_of

    loc = F.explode(F.regexp_extract_all(F.col(xml), F.lit(r"(?s)<loc>(.*?)</loc>"), F.lit(1)))
    return maps.select(host, loc.alias("url")).select(host, F.regexp_replace("url", r"^\s+|\s+$", "").alias("url")).filter(host_of(F.col("url")) == F.col(host)).distinct()
