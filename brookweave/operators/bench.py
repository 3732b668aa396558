"""Scores of answers: which of the wanted things a text holds, as column expressions over one row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What an address may not hold, what is cut from its end, and the tolerance of a number.
URL = r"""https?://[^\s<>()\]\[»"'`]+"""
TAIL = r"[.,);:]+$"
NUMBER = r"(\d[\d,]*(?:\.\d+)?)\s*([kK]?)"
NEAR = 0.03
ENGINES = ("duckduckgo", "bing.com", "google.com", "mojeek", "brave.com", "yahoo.com")


def urls(text: Column) -> Column:
    """The distinct addresses of a text in order, without marks at their ends."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(URL), F.lit(0)), lambda u: F.regexp_replace(u, TAIL, "")))


def other_urls(text: Column) -> Column:
    """Addresses that are no search engine's."""
    return F.filter(urls(text), lambda u: ~F.lower(u).rlike("|".join(e.replace(".", r"\.") for e in ENGINES)))


def near(text: Column, wanted: Column) -> Column:
    """Whether the text holds a number within NEAR of the wanted one; k means thousands."""
    raw = F.regexp_extract_all(text, F.lit(NUMBER), F.lit(1))
    kilo = F.regexp_extract_all(text, F.lit(NUMBER), F.lit(2))
    value = lambda r, k: F.replace(r, F.lit(","), F.lit("")).cast("double") * F.when(k == "", 1.0).otherwise(1000.0)
    return F.exists(F.zip_with(raw, kilo, value), lambda v: v.between(wanted * (1 - NEAR), wanted * (1 + NEAR)))


def indicators(text: Column, wanted: Column) -> Column:
    """struct of 0 or 1 per wanted thing, and score, their mean in per cent."""
    n = lambda c: F.coalesce(c, F.lit(False)).cast("int")
    items = {
        "three_urls": n(F.size(urls(text)) >= 3),
        "three_other_urls": n(F.size(other_urls(text)) >= 3),
        "year": n(F.contains(text, F.lit("2025")) | F.contains(text, F.lit("2026"))),
        "tradeoff": n(F.lower(text).rlike("trade-?offs?")),
        "number": n(near(text, wanted)),
    }
    total: Column = F.lit(0)
    for c in items.values():
        total = total + c
    return F.struct(*(c.alias(k) for k, c in items.items()), F.round(100.0 * total / len(items), 1).alias("score"))


_U = r"""list_distinct(list_transform(regexp_extract_all(markdown, 'https?://[^\s<>()\]\[»"''`]+'), lambda u: regexp_replace(u, '[.,);:]+$', '')))"""
_N = r"(\d[\d,]*(?:\.\d+)?)\s*([kK]?)"
SQL = rf"""WITH p AS (SELECT DISTINCT scrape_id, markdown FROM scrape_results WHERE scrape_id IS NOT NULL AND markdown IS NOT NULL),
 u AS (SELECT scrape_id, markdown, {_U} AS us, list_zip(regexp_extract_all(markdown, '{_N}', 1), regexp_extract_all(markdown, '{_N}', 2)) AS ns FROM p),
 i AS (SELECT scrape_id, (len(us) >= 3)::INT AS three_urls, (len(list_filter(us, lambda x: NOT regexp_matches(lower(x), 'duckduckgo|bing\.com|google\.com|mojeek|brave\.com|yahoo\.com'))) >= 3)::INT AS three_other_urls,
 (contains(markdown, '2025') OR contains(markdown, '2026'))::INT AS year, regexp_matches(lower(markdown), 'trade-?offs?')::INT AS tradeoff,
 (len(list_filter(ns, lambda x: replace(x[1], ',', '')::DOUBLE * CASE WHEN x[2] = '' THEN 1 ELSE 1000 END BETWEEN length(markdown) * (1 - 0.03::DOUBLE) AND length(markdown) * (1 + 0.03::DOUBLE))) > 0)::INT AS number FROM u)
 SELECT *, round(100.0::DOUBLE * (three_urls + three_other_urls + year + tradeoff + number) / 5, 1) AS score FROM i"""
