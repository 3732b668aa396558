"""The verbs: each takes a session, checked options and a table of pages or results, and composes the operators.

Options are dataclasses; a value out of its range is an OptionError that names it.  Batches of more than BATCH inputs,
crawls and result lists are bounded as the options say.  Live pages come from `sources.fetch`; every verb also runs over
recorded ones.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .functions import pages as P
from .functions import text as T
from .functions import urls as U
from .operators import crawl as C
from .operators import extract as E
from .operators import focus as X
from .operators import search as S
from .operators import state as ST

#: Inputs of a batch, paragraphs that a focus keeps, links that a page returns.
BATCH, KEEP, LINKS = 20, 40, 50


class OptionError(ValueError):
    """A missing, misplaced or out of range option."""


def _between(name: str, value: int, low: int, high: int | None = None) -> None:
    if not isinstance(value, int) or isinstance(value, bool) or value < low or high is not None and value > high:
        raise OptionError(f"{name} must be a number of at least {low}" + ("" if high is None else f" and at most {high}"))


@dataclass(frozen=True)
class ScrapeOptions:
    max_chars: int = 6000
    offset: int = 0
    focus: str | None = None
    links: bool = False
    media: bool = False

    def __post_init__(self) -> None:
        _between("max_chars", self.max_chars, 1)
        _between("offset", self.offset, 0)


@dataclass(frozen=True)
class SearchOptions:
    max_results: int = 10
    site: str | None = None
    exclude: tuple[str, ...] = ()
    freshness: str | None = None
    fetch: int = 0

    def __post_init__(self) -> None:
        _between("max_results", self.max_results, 1, 20)
        _between("fetch", self.fetch, 0, 8)
        if self.freshness not in (None, "day", "week", "month", "year"):
            raise OptionError("freshness must be day, week, month or year")


@dataclass(frozen=True)
class CrawlOptions:
    max_pages: int = 10
    max_depth: int = 2
    max_total_chars: int | None = None
    focus: str | None = None
    discover_only: bool = False

    def __post_init__(self) -> None:
        _between("max_pages", self.max_pages, 1, 50)
        _between("max_depth", self.max_depth, 0)
        if self.max_total_chars is not None:
            _between("max_total_chars", self.max_total_chars, 1)


@dataclass(frozen=True)
class LinkOptions:
    filter: str | None = None
    most: int = 100
    terms: tuple[str, ...] = field(default=())

    def __post_init__(self) -> None:
        _between("most", self.most, 1)


def terms_of(focus: str | None) -> list[str]:
    """The terms of a focus: words of more than two bytes without marks around them, in lower case."""
    words = (w.strip("".join(c for c in set(w) if not c.isalnum())).lower() for w in (focus or "").split())
    return [w for w in words if len(w.encode()) > 2]


def judged(pages: DataFrame) -> DataFrame:
    """Adds ok, note and next_action to rows of markdown, clean_html, links, blocked, page_type and tier."""
    p = pages.withColumn("md", F.coalesce("markdown", F.lit(""))).withColumn("html", F.coalesce("clean_html", F.lit("")))
    kind, blocked, size = F.coalesce("page_type", F.lit("unknown")), F.coalesce("blocked", F.lit(False)), F.octet_length("html")
    length = F.octet_length(F.btrim("md", F.lit(" \t\n\r")))
    none = F.lit(None).cast("string")
    ok = P.content_ok(length, P.visible_bytes(F.col("html")), size, blocked, F.lit(False), none, kind, F.coalesce(F.size("links"), F.lit(0)))
    notes = P.content_notes(F.col("ok"), blocked, F.lit(False), F.coalesce("tier", F.lit("")), none, size, kind)
    return p.withColumn("ok", ok).withColumn("_x", notes).select("*", "_x.note", "_x.next_action").drop("_x")


def paged(pages: DataFrame, terms: list[str], offset: int, limit: int) -> DataFrame:
    """Adds focused, missed, piece, next_offset and page: focus of pages that hold content, slice, cut, closed fence and the
    note of a miss.  One row a page and no shuffle."""
    md = F.when(F.col("ok"), F.col("md")).otherwise(F.lit(""))
    if terms:
        p = X.view(pages, "md", T.paragraphs(md), terms, KEEP).withColumn("missed", F.col("ok") & F.col("missed"))
    else:
        p = pages.withColumn("focused", F.col("md")).withColumn("missed", F.lit(False)).withColumn("kept", F.lit(0).cast("bigint"))
    p = p.withColumn("piece", T.truncate(T.slice_at(F.col("focused"), F.lit(offset)), limit))
    cut = F.length("focused") - offset > F.length("piece")
    p = p.withColumn("next_offset", F.when(cut, F.lit(offset) + F.length("piece")))
    page = F.when(cut, T.close_fence(F.col("piece"))).otherwise(F.col("piece"))
    return p.withColumn("page", F.when(F.col("missed"), F.concat(page, F.lit(f"\n\n{X.MISS}"))).otherwise(page))


def scrape(responses: DataFrame, options: ScrapeOptions = ScrapeOptions(), key: str = "url") -> DataFrame:
    """Results of responses (key, url, response, blocked, tier); refused addresses are error rows."""
    ok = U.valid(F.col("url"))
    kept = [c for c in dict.fromkeys([key, "url", "blocked", "tier", "response"])]
    good = responses.filter(ok).select(*kept)
    got = E.documents(good, "response", "url", key, options.links, options.media, keep=[c for c in kept if c != key])
    got = got.withColumnRenamed("clean_html", "sanitized").withColumnRenamed("response", "clean_html")
    q = paged(judged(got), terms_of(options.focus), options.offset, options.max_chars)
    out = q.select(
        key, *(["url"] if key != "url" else []), "title", F.col("page").alias("markdown"), F.col("sanitized").alias("clean_html"), "tier", F.col("ok").alias("content_ok"),
        F.coalesce("blocked", F.lit(False)).alias("blocked"), "note", "next_action", F.length("md").cast("bigint").alias("total_chars"), F.col("next_offset").isNotNull().alias("truncated"),
        "page_type", "quality_score", "description", F.slice("links", 1, LINKS).alias("links"), T.headings(F.col("page")).alias("headings"),
        F.col("next_offset").cast("bigint").alias("next_offset"), "media", F.length("focused").cast("bigint").alias("focused_chars"),
    )
    return out.unionByName(failed(responses.filter(~F.coalesce(ok, F.lit(False))), F.lit("blocked: address refused"), key), allowMissingColumns=True)


def failed(rows: DataFrame, note: Column, key: str = "url") -> DataFrame:
    """The placeholder results of pages that could not be fetched."""
    return rows.select(
        *dict.fromkeys([key, "url"]), F.lit("").alias("title"), F.lit("").alias("markdown"), F.lit("").alias("clean_html"), F.lit("http").alias("tier"), F.lit(False).alias("content_ok"),
        F.lit(False).alias("blocked"), note.alias("note"), F.lit("try another URL or check connectivity").alias("next_action"), F.lit(0).cast("bigint").alias("total_chars"),
        F.lit(False).alias("truncated"), F.lit("unknown").alias("page_type"), F.lit(0.0).alias("quality_score"), F.lit(0).cast("bigint").alias("focused_chars"),
    )


def batch(responses: DataFrame, count: int, options: ScrapeOptions = ScrapeOptions()) -> DataFrame:
    """scrape over a list of inputs; more than BATCH of them are an error rather than dropped."""
    _between("inputs", count, 1, BATCH)
    return scrape(responses, options)


def search(hits: DataFrame, query: Column, options: SearchOptions = SearchOptions(), group: str = "search_id") -> DataFrame:
    """(group, pos, key, url, title, snippet, score): the fused, reranked and filtered results of each search.

    hits are (group, hit_id, engine, rank, title, url, snippet); query gives each hit's query.
    """
    h = hits.filter("url is not null").fillna("", ["title", "snippet"]).dropDuplicates(["hit_id"]).withColumn("_q", query)
    fused = S.fuse(h, group, F.struct(S.engine_order(F.col("engine")).alias("e"), F.col("engine"), F.col("rank"), F.col("hit_id")))
    terms = h.groupBy(group).agg(T.query_terms(F.min("_q")).alias("terms"))
    ranked = S.for_sites(S.reranked(fused.join(terms, group), F.col("terms")), "url", options.site, options.exclude)
    return S.top(S.drop_uncovered(ranked, group), group, options.max_results).select(group, "pos", "key", "url", "title", "snippet", "score")


def links(pages: DataFrame, options: LinkOptions = LinkOptions(), key: str = "scrape_id") -> DataFrame:
    """(key, pos, href, text): the distinct http(s) links of each page without fragments, those that match the filter."""
    e = pages.filter(F.col(key).isNotNull()).dropDuplicates([key]).select(key, F.posexplode("links").alias("pos", "l")).select(key, "pos", F.regexp_replace("l.href", "#.*$", "").alias("href"), "l.text")
    e = e.filter(F.col("href").rlike("^https?://")).groupBy(key, "href").agg(F.min(F.struct("pos", "text")).alias("f")).select(key, "f.pos", "href", "f.text")
    if options.filter:
        low = F.lit(options.filter.lower())
        e = e.filter(F.contains(F.lower("href"), low) | F.contains(F.lower(F.coalesce("text", F.lit(""))), low))
    # a page has at most a hundred links, so the top of a page is taken in its array
    best = F.slice(F.array_sort(F.collect_list(F.struct("pos", "href", F.coalesce(F.nullif(T.collapse(F.col("text")), F.lit("")), F.lit("(no text)")).alias("text")))), 1, options.most)
    return e.groupBy(key).agg(best.alias("l")).select(key, F.explode("l").alias("l")).select(key, "l.*")


def crawl(edges: DataFrame, pages: DataFrame, seeds: DataFrame, options: CrawlOptions = CrawlOptions()) -> DataFrame:
    """The pages of a crawl from each seed in order, or only the addresses that it would queue."""
    if options.discover_only:
        return C.discover(edges, seeds, options.max_depth, options.max_pages)
    return C.crawl(edges, pages, seeds, options.max_depth, options.max_pages, options.max_total_chars)


def cache_clear(cache: DataFrame) -> DataFrame:
    """The empty cache, to be written over the old one."""
    return cache.limit(0)


def engine_state(old: DataFrame, calls: DataFrame) -> DataFrame:
    """(engine, last_ms, cooldown_until_ms): the state after calls (engine, ms, blocked), merged with the old one.

    A block opens a cooldown by its engine's length; a later success does not close it."""
    until = F.when(F.col("blocked"), F.col("ms") + ST.cooldown_ms(F.col("engine")))
    new = calls.select("engine", F.col("ms").cast("bigint").alias("last_ms"), until.cast("bigint").alias("cooldown_until_ms"))
    both = old.select("engine", "last_ms", "cooldown_until_ms").unionByName(new)
    return both.groupBy("engine").agg(F.max("last_ms").alias("last_ms"), F.coalesce(F.max("cooldown_until_ms"), F.lit(0).cast("bigint")).alias("cooldown_until_ms"))
