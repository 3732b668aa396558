"""Federated search: rank fusion of the engines' lists, reranking and filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import urls

#: The fusion constant, the engines' order and the hosts that rank lower.
K = 60
ENGINES = ("ddg", "bing", "brave", "mojeek", "yahoo")
DEMOTED = r"youtube\.com|youtu\.be|pinterest\.|facebook\.com|tiktok\.com|quora\.com"


def fuse(hits: DataFrame, group: str, seq: Column) -> DataFrame:
    """One row per (group, normalized url): rrf, the first url, the first snippet that is not empty, the longest title.

    hits has group, engine, rank (from 0), title, url, snippet; seq orders them (unique within the group).  A url
    that an engine lists twice adds twice.
    """
    h = hits.withColumn("key", urls.normalize(F.col("url"))).withColumn("seq", seq)
    full = F.col("snippet") != ""
    longest = F.struct(-F.octet_length("title"), F.col("seq"))
    return h.groupBy(group, "key").agg(
        F.round(F.sum(F.lit(1.0) / (F.lit(K) + F.col("rank"))), 9).alias("rrf"),
        F.min_by("url", "seq").alias("url"),
        F.coalesce(F.min_by(F.when(full, F.col("snippet")), F.when(full, F.col("seq"))), F.lit("")).alias("snippet"),
        F.min_by("title", longest).alias("title"),
        F.min("seq").alias("first_seq"),
        F.count(F.lit(1)).alias("votes"),
    )


def demoted(url: Column) -> Column:
    return urls.host_of(url).rlike(DEMOTED)


def reranked(fused: DataFrame, terms: Column, extra: str = "") -> DataFrame:
    """Adds cov and score = 10 * coverage + rrf - 0.5 for demoted hosts."""
    hay = F.lower(F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("snippet", F.lit("")), F.col("url")))
    hit = F.size(F.filter(terms, lambda t: F.contains(hay, t))).cast("double")
    cov = F.when(F.size(terms) > 0, hit / F.size(terms)).otherwise(F.lit(0.0))
    d = fused.withColumn("cov", cov)
    # nine digits, so that equal sums of different order tie
    return d.withColumn("score", F.round(10 * F.col("cov") + F.col("rrf") - F.when(demoted(F.col("url")), 0.5).otherwise(0.0), 9))


def drop_uncovered(ranked: DataFrame, group: str, least: int = 3) -> DataFrame:
    """Hits without any term are dropped where at least three have one."""
    n = F.count_if(F.col("cov") > 0).over(Window.partitionBy(group))
    return ranked.withColumn("_n", n).filter((F.col("_n") < least) | (F.col("cov") > 0)).drop("_n")


def top(ranked: DataFrame, group: str, most: int) -> DataFrame:
    w = Window.partitionBy(group).orderBy(F.desc("score"), "first_seq")
    return ranked.withColumn("pos", F.row_number().over(w)).filter(F.col("pos") <= most)


def engine_order(engine: Column) -> Column:
    """The engine's place in the fusion; unknown ones come last."""
    return F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, ENGINES)), engine), F.lit(0)), F.lit(len(ENGINES) + 1)).cast("int")


def low_relevance(best: Column, terms: Column, ok_engines: Column, engines: Column) -> Column:
    """A warning when the first hit covers less than half of the terms or less than two engines answered; engines are
    the status lines of all of them."""
    n = F.size(terms)
    text = F.concat(
        F.lit("low relevance: top hits cover "), F.round(best * n).cast("int").cast("string"), F.lit("/"), n.cast("string"), F.lit(" query terms; engines: "),
        F.array_join(engines, ","), F.lit(" — retry later, rephrase with fewer terms, or fetch known URLs"),
    )
    return F.when((n > 0) & ~((best >= 0.5) & (ok_engines >= 2)), text)


def effective_query(query: Column, site: Column, exclude: Column, fresh: Column) -> Column:
    """The query with its site, its exclusions (an array) and its freshness; blank ones and unknown periods add nothing."""
    site, fresh = F.trim(site), F.lower(F.trim(fresh))
    out = F.transform(F.filter(F.transform(F.coalesce(exclude, F.array().cast("array<string>")), lambda x: F.trim(x)), lambda x: x != ""), lambda x: F.concat(F.lit("-site:"), x))
    return F.concat_ws(
        " ",
        query,
        F.when(site != "", F.concat(F.lit("site:"), site)),
        F.when(F.size(out) > 0, F.array_join(out, " ")),
        F.when(fresh.isin("day", "week", "month", "year"), F.concat(F.lit("when:"), fresh)),
    )


def for_sites(hits: DataFrame, url: str, site: str | None = None, exclude: tuple[str, ...] = ()) -> DataFrame:
    """Hits of one site, and of none of the excluded ones, subdomains included."""
    host = urls.host_of(F.col(url))
    if site and site.strip():
        hits = hits.filter(urls.host_matches(host, F.lit(site)))
    for x in exclude:
        if x.strip():
            hits = hits.filter(~urls.host_matches(host, F.lit(x)))
    return hits
