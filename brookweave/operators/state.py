"""State over event tables: cache hits under a time to live, eviction, pacing and cooldown."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Seconds that an entry lives, entries that are kept, milliseconds between requests and of cooldowns.
TTL_S, ENTRIES, PACE_MS, PACE_MOST_MS = 3600, 200, 1100, 1500
COOLDOWN_LONG_MS, COOLDOWN_MS = 600_000, 120_000


def cache_hits(events: DataFrame, key: str, ts: str, order: str) -> DataFrame:
    """Adds age_us, the time since the key's previous event, and hit: whether it is within the time to live."""
    w = Window.partitionBy(key).orderBy(ts, order)
    age = F.timestamp_diff("MICROSECOND", F.lag(ts).over(w), F.col(ts))
    return events.withColumn("age_us", age).withColumn("hit", F.coalesce(F.col("age_us") < TTL_S * 1_000_000, F.lit(False)))


def lookup(requests: DataFrame, cache: DataFrame, key: str, now: Column, fetched: str) -> DataFrame:
    """Every request with the cached row of its key, if that is still fresh at now; nulls otherwise."""
    fresh = cache.withColumnRenamed(fetched, "_at").withColumnRenamed(key, "_key")
    age = F.timestamp_diff("MICROSECOND", F.col("_at"), now)
    on = requests[key].eqNullSafe(fresh["_key"]) & (age >= 0) & (age < TTL_S * 1_000_000)
    return requests.join(fresh, on, "left").drop("_key")


def cache_key(url: Column, focus: Column, max_chars: Column) -> Column:
    return F.concat(url, F.lit("|"), F.coalesce(focus, F.lit("")), F.lit("|"), max_chars.cast("string"))


def cache_key_options(url: Column, focus: Column, max_chars: Column, offset: Column, media: Column, pages: Column, actions: Column) -> Column:
    """The key of a request with options; actions (an array of structs) count by content, none as 0."""
    digest = F.when(F.coalesce(F.size(actions), F.lit(0)) > 0, F.xxhash64(actions).cast("string")).otherwise(F.lit("0"))
    parts = (F.coalesce(offset, F.lit(0)).cast("string"), media.cast("string"), F.coalesce(pages, F.lit("")), digest)
    return F.concat_ws("|", cache_key(url, focus, max_chars), *parts)


def store(cache: DataFrame, new: DataFrame, key: str, fetched: str, entries: int = ENTRIES) -> DataFrame:
    """The cache after new rows were written: the latest row of each key, of the `entries` latest keys; ties by key."""
    last = cache.unionByName(new).groupBy(key).agg(F.max_by(F.struct(*[c for c in cache.columns if c != key]), fetched).alias("_v")).select(key, "_v.*")
    return last.orderBy(F.desc(fetched), key).limit(entries)


def kept_entries(events: DataFrame, key: str, ts: str, entries: int = ENTRIES) -> DataFrame:
    """(key, last): the least recently used entries beyond the limit are evicted; ties by key."""
    last = events.groupBy(key).agg(F.max(ts).alias("last"))
    return last.orderBy(F.desc("last"), key).limit(entries)


#: Milliseconds of a segment; windows run within (engine, segment), and segments hand on one value each.
SEGMENT_MS = 3_600_000


def pacing(requests: DataFrame, engine: str, ts: str, order: str) -> DataFrame:
    """Adds sleep_ms that keeps requests of one engine PACE_MS apart: 0 for the first.

    A window by engine would have as many tasks as engines; requests are cut into segments of an hour, and a segment's
    first request takes the last time of the segment before it.
    """
    r = requests.withColumn("_seg", F.date_trunc("hour", ts))
    last = r.groupBy(F.col(engine).alias("_e"), F.col("_seg").alias("_g")).agg(F.max(ts).alias("_last"))
    last = last.withColumn("_carry", F.lag("_last").over(Window.partitionBy("_e").orderBy("_g"))).drop("_last")
    r = r.join(last, r[engine].eqNullSafe(last["_e"]) & r["_seg"].eqNullSafe(last["_g"]), "left")
    before = F.coalesce(F.lag(ts).over(Window.partitionBy(engine, "_seg").orderBy(ts, order)), F.col("_carry"))
    gap = (F.timestamp_diff("MICROSECOND", before, F.col(ts)) / 1000).cast("bigint")
    wait = F.when(gap.isNull() | (gap < 0), F.lit(0)).otherwise(F.least(F.lit(PACE_MOST_MS), F.greatest(F.lit(0), F.lit(PACE_MS) - gap)))
    return r.withColumn("sleep_ms", wait.cast("bigint")).drop("_seg", "_e", "_g", "_carry")


def cooldown_ms(engine: Column) -> Column:
    return F.when(engine.startswith("ddg"), COOLDOWN_LONG_MS).otherwise(COOLDOWN_MS)


def cooling(requests: DataFrame, engine: str, ts_ms: str, blocked: str, order: str, length: Column) -> DataFrame:
    """Adds until_ms, the end of the cooldown that earlier blocks set, and skip: whether a request falls into it.

    Segmented like pacing; a segment hands on the latest end so far.
    """
    r = requests.withColumn("_seg", F.floor(F.col(ts_ms) / SEGMENT_MS)).withColumn("_end", F.when(F.col(blocked), F.col(ts_ms) + length))
    ends = r.groupBy(F.col(engine).alias("_e"), F.col("_seg").alias("_g")).agg(F.max("_end").alias("_last"))
    before = Window.partitionBy("_e").orderBy("_g").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.withColumn("_carry", F.max("_last").over(before)).drop("_last")
    r = r.join(ends, r[engine].eqNullSafe(ends["_e"]) & r["_seg"].eqNullSafe(ends["_g"]), "left")
    own = Window.partitionBy(engine, "_seg").orderBy(ts_ms, order).rowsBetween(Window.unboundedPreceding, -1)
    r = r.withColumn("until_ms", F.greatest(F.max("_end").over(own), F.col("_carry")))
    return r.withColumn("skip", F.coalesce(F.col("until_ms") > F.col(ts_ms), F.lit(False))).drop("_seg", "_end", "_e", "_g", "_carry")


def bypass(engines: DataFrame, now: Column, until: str, order: str) -> DataFrame:
    """Engines to ask: those not cooling, or where all are, the two whose cooldown ends first."""
    every = Window.partitionBy("grp")
    cooled = F.col(until) > now
    d = engines.withColumn("all_cooled", F.min(cooled.cast("int")).over(every) == 1)
    d = d.withColumn("_r", F.row_number().over(every.orderBy(until, order)))
    return d.filter(~cooled | (F.col("all_cooled") & (F.col("_r") <= 2))).drop("_r")
