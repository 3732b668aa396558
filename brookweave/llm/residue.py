"""Problem 6: unfilled templates, filler text, error pages and script notices.

Detectors look for placeholders in running text (not in code) and for filler.  Whether a text stands instead of a page's
content is told by comparing the terms of address and title with those of the text, headings included.

A text that shares none of them is a response rather than a page.  Each of its lines is counted over the whole table,
numbers and one further word apart: by how many different titles, and on how many hosts, it was given as such a
response.  A line is a known response if it answered for TITLES titles on HOSTS hosts and this evidence of hosts and
titles outweighs the information in it (WEIGHT times their sum against its words, so that a long text needs more).  A
record is found if half of its lines are known responses.  A text that shares at most one term is found as well if words
of messages stand in the sentences that make up half of it.

Defined cases: null or empty markdown is no case; a null title or url shares no terms but flags nothing by itself; null
hosts count as one host; repeated deliveries count once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut
from .pagestats import page_stats

TITLES, HOSTS, WEIGHT, HALF = 3, 2, 2, 0.5


def answered(stats: DataFrame) -> DataFrame:
    """(scrape_id, line): the lines that different pages of different hosts were answered with."""
    a = F.explode(F.arrays_zip("answers", "answer_lines", "answer_words")).alias("a")
    rows = stats.filter(F.size("answers") > 0).select("scrape_id", "title_hash", F.xxhash64("site").alias("host"), a)
    rows = rows.select("scrape_id", "title_hash", "host", F.col("a.answers").alias("key"), F.col("a.answer_lines").alias("line"), F.col("a.answer_words").alias("words"))
    # a count of rows bounds that of titles, so most keys leave before rows travel
    often = rows.groupBy("key").count().filter(F.col("count") >= TITLES).select("key")
    rows = cut(rows.join(often, "key"))
    # counted by partial sums, so a response that a third of all rows share is reduced before it meets
    n = rows.groupBy("key").agg(F.countDistinct("title_hash").alias("titles"), F.countDistinct("host").alias("hosts"), F.max("words").alias("words"))
    known = n.filter((F.col("titles") >= TITLES) & (F.col("hosts") >= HOSTS) & (WEIGHT * (F.col("titles") + F.col("hosts")) >= F.col("words"))).select("key")
    return rows.join(known, "key").select("scrape_id", "line").distinct()


def with_evidence(stats: DataFrame) -> DataFrame:
    """stats with responses, the number of the record's lines that are known responses."""
    n = answered(stats).groupBy("scrape_id").agg(F.count(F.lit(1)).cast("int").alias("responses"))
    return stats.drop("answers", "answer_lines", "answer_words").join(n, "scrape_id", "left").withColumn("responses", F.coalesce("responses", F.lit(0)))


def is_response() -> Column:
    return (F.col("overlap") == 0) & (F.col("responses") > 0) & (F.col("responses") >= HALF * F.col("body_lines"))


def is_residue() -> Column:
    told = (F.col("overlap") <= 1) & ((F.col("note_share") >= HALF) | (F.col("fill_share") >= HALF))
    return F.col("placeholder").isNotNull() | F.col("filler") | told | is_response()


def residue_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_evidence(page_stats(spark, sf_dir)).filter(is_residue()).select("scrape_id")
