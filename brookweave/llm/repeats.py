"""Problem 3: lines repeated across one site's records.

Every line gets a key (case, spacing, quote and emphasis marks, list marks, dates and numbers removed; the link target
stays) and, per run of name-like words, a variant key in which the run is blank, so that lines which differ in an
author's name alone share a key.  Keys whose row count cannot reach the thresholds are dropped first (exact: a row count
bounds the number of records from above).

The records of each remaining line are then stored as compressed bitmaps, one per line and container of 32,768 ids:
sparse containers as position arrays, dense ones as bit arrays.  The containers of the lines that are variants of one
key are united, the exact cardinality of the unions is set against the thresholds, and a line is found, and deleted, by
looking its record up in the union of one of its keys.

A null ``site`` is one site.  Null or empty ``markdown`` has no lines but counts as a record of its site.  Repeated
deliveries set a bit twice and change nothing.  Any number of records per site or line: all groups are pre-aggregated
by container and no group is collected beyond one container.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, records

MIN_RECORDS, MIN_SHARE, MIN_WORDS = 5, 0.1, 2
#: Ids per container, and the cardinality from which a container is a bit array.
SPAN, DENSE = 32_768, 2_048
#: The keys that may repeat are broadcast up to so many bytes.
BROADCAST_BYTES = 16 << 20

NUMBER = re.compile(r"\d+(?:\s?[./:,\-]\s?\d+)*")
MARKS = re.compile(r"[*_`\"'“”„«»‘’‚>]+")
LEAD = re.compile(r"^\s*(?:[*_>\"“„«]*\s*)*(?:[-•+]\s+|\d+[.)]\s+)?")
TARGET = re.compile(r"(\]\([^()\s]*\))")
TOKEN = re.compile(r"\w+")
#: Words that introduce an author.
BY = frozenset("by von par por przez di door av".split())


def _norm(text: str) -> str:
    # numbers are filled in outside link targets only: another target is another line
    parts = TARGET.split(text)
    parts[::2] = [MARKS.sub(" ", NUMBER.sub("0", x)) for x in parts[::2]]
    return " ".join("".join(parts).lower().split())


def _hash(text: str) -> int:
    return xxhash.xxh64_intdigest(text.encode()) - (1 << 63)


def keys(line: str) -> list[tuple[int, int]]:
    """(key, filler) of a line: its own key with filler 0, then a variant for each pair of adjacent name-like words."""
    text = LEAD.sub("", line)
    if len(TOKEN.findall(text)) < MIN_WORDS:
        return []
    out = [(_hash(_norm(text)), 0)]
    words = list(re.finditer(r"[^\W\d_][\w’'&-]*", text))
    for a, b in zip(words, words[1:]):
        if text[a.end() : b.start()] == " " and a[0][0].isupper() and b[0][0].isupper():
            rest = text[: a.start()] + " \x01 " + text[b.end() :]
            fixed = [w.lower() for w in TOKEN.findall(NUMBER.sub(" ", rest)) if w != "\x01"]
            if len(fixed) >= 2 or fixed and fixed[0] in BY:
                out.append((_hash(_norm(rest)), _hash(f"{a[0]} {b[0]}".lower())))
    return out


def _explode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        rows = [
            (sid, site, no, found[0][0], key, filler)
            for sid, site, md in zip(b["scrape_id"], b["site"], b["markdown"])
            for no, line in enumerate(md.split("\n"), 1)
            if line.strip()
            for found in (keys(line),)
            for key, filler in found
        ]
        yield pd.DataFrame(rows, columns=["scrape_id", "site", "line_no", "own", "key", "filler"])


def line_keys(pages: DataFrame) -> DataFrame:
    return records(pages).select("scrape_id", "site", "markdown").mapInPandas(
        _explode, "scrape_id bigint, site string, line_no int, own bigint, key bigint, filler bigint"
    )


def _bucket() -> tuple:
    return F.expr(f"scrape_id div {SPAN}").alias("bucket"), F.pmod("scrape_id", F.lit(SPAN)).cast("int").alias("pos")


def lines_that_may_repeat(pages: DataFrame) -> DataFrame:
    """(site, own, key, need, line_no, scrape_id, bucket, pos): the occurrences of keys with rows enough for the thresholds."""
    need = (
        pages.filter(F.col("scrape_id").isNotNull()).select("site", "scrape_id").distinct().groupBy("site").count()
        .select(F.coalesce("site", F.lit("")).alias("site"), F.greatest(F.lit(float(MIN_RECORDS)), F.col("count") * MIN_SHARE).alias("need"))
        .groupBy("site").agg(F.max("need").alias("need"))
    )
    lines = cut(line_keys(pages).withColumn("site", F.coalesce("site", F.lit(""))))
    bound = lines.groupBy("site", "key").agg(
        F.count(F.lit(1)).alias("n"), (F.min("filler") != F.max("filler")).alias("varies"), F.expr("min(filler) = 0 and max(filler) = 0").alias("plain")
    )
    # a blanked run that never varies is no author's name
    may = bound.join(need, "site").filter(F.col("n") >= F.col("need") - 1e-9).filter("plain or varies").select("site", "key", "need")
    may = cut(may)
    # checked size: beyond it a sort-merge join, whose hot keys the engine splits
    size = may.agg(F.sum(F.length("site") + 48)).first()[0] or 0
    may = F.broadcast(may) if size <= BROADCAST_BYTES else may
    return cut(lines.join(may, ["site", "key"]).select("site", "own", "key", "need", "line_no", "scrape_id", *_bucket()))


def line_bitmaps(rows: DataFrame) -> DataFrame:
    """(site, own, bucket, sparse, dense): the records of each line, by container."""
    # a container is collected, never a line: at most SPAN positions
    held = cut(rows.groupBy("site", "own", "bucket").agg(F.sort_array(F.collect_set("pos")).alias("sparse")))
    few = held.filter(F.size("sparse") <= DENSE).withColumn("dense", F.lit(None).cast("binary"))
    many = held.filter(F.size("sparse") > DENSE).select("site", "own", "bucket", F.explode("sparse").alias("pos")).groupBy("site", "own", "bucket").agg(
        F.lit(None).cast("array<int>").alias("sparse"), F.expr("bitmap_construct_agg(bitmap_bit_position(pos + 1))").alias("dense")
    )
    return few.unionByName(many)


def united(rows: DataFrame) -> DataFrame:
    """(site, key, bucket, sparse, dense): the unions of the variants' bitmaps of the keys that repeat in their site."""
    names = rows.select("site", "key", "own", "need").distinct()
    union = names.join(line_bitmaps(rows), ["site", "own"]).groupBy("site", "key", "need", "bucket").agg(
        F.array_distinct(F.flatten(F.collect_list("sparse"))).alias("sparse"),
        F.when(F.count("dense") > 0, F.expr("bitmap_or_agg(dense) filter (where dense is not null)")).alias("dense"),
    )
    # positions of an array that the bit array does not hold come on top of it
    extra = F.size(F.filter("sparse", lambda p: F.when(F.col("dense").isNull(), F.lit(True)).otherwise(~_bit(p))))
    union = cut(union.withColumn("n", extra + F.coalesce(F.bitmap_count("dense"), F.lit(0))))
    total = union.groupBy("site", "key").agg(F.sum("n").alias("records"), F.max("need").alias("need")).filter(F.col("records") >= F.col("need") - 1e-9)
    return union.join(total.select("site", "key"), ["site", "key"]).select("site", "key", "bucket", "sparse", "dense")


def _bit(pos):
    """Whether the bit array has the position."""
    byte = F.conv(F.hex(F.substring("dense", F.floor(pos / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return F.floor(byte / F.pow(F.lit(2), pos % 8)) % 2 == 1


def _held():
    return F.array_contains("sparse", F.col("pos")) | F.when(F.col("dense").isNotNull(), _bit(F.col("pos"))).otherwise(F.lit(False))


def repeated_lines(pages: DataFrame) -> DataFrame:
    """(scrape_id, line_no) of every occurrence of a repeated line."""
    rows = lines_that_may_repeat(pages)
    return rows.join(united(rows), ["site", "key", "bucket"]).filter(_held()).select("scrape_id", "line_no").distinct()


def without_repeats(pages: DataFrame) -> DataFrame:
    """(scrape_id, markdown, removed): the records without their repeated lines; records without text stay as they are."""
    drop = repeated_lines(pages).groupBy("scrape_id").agg(F.collect_set("line_no").alias("drop"))
    rows = pages.select("scrape_id", "markdown").dropDuplicates(["scrape_id"])
    kept = F.expr("filter(transform(split(markdown, '\\n', -1), (x, i) -> struct(i + 1 as i, x as x)), s -> not array_contains(drop, s.i))")
    return rows.join(drop, "scrape_id", "left").select(
        "scrape_id",
        F.when(F.col("drop").isNull(), F.col("markdown")).otherwise(F.array_join(F.transform(kept, lambda s: s["x"]), "\n")).alias("markdown"),
        F.coalesce(F.size("drop"), F.lit(0)).alias("removed"),
    )
