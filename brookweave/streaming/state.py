"""Streaming counterparts of the stateful operators: pacing and cooldown by key, fresh-only lookups, windowed counts."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.state import PACE_MOST_MS, PACE_MS


def _pace(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    last = state.get[0] if state.exists else None
    rows = []
    for b in batches:
        for i, ms in sorted(zip(b["id"], b["ms"]), key=lambda r: (r[1], r[0])):
            gap = None if last is None else ms - last
            wait = 0 if gap is None or gap < 0 else min(PACE_MOST_MS, max(0, PACE_MS - gap))
            rows.append((key[0], int(i), int(wait)))
            last = ms
    if last is not None:
        state.update((int(last),))
    yield pd.DataFrame(rows, columns=["engine", "id", "sleep_ms"])


def pacing(requests: DataFrame) -> DataFrame:
    """(engine, id, sleep_ms) of a stream of (engine, id, ms); the state is each engine's last request."""
    return requests.groupBy("engine").applyInPandasWithState(
        _pace, "engine string, id bigint, sleep_ms bigint", "last bigint", "append", GroupStateTimeout.NoTimeout
    )


def _cool(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    until = state.get[0] if state.exists else -1
    length = 600_000 if str(key[0]).startswith("ddg") else 120_000
    rows = []
    for b in batches:
        for i, ms, blocked in sorted(zip(b["id"], b["ms"], b["blocked"]), key=lambda r: (r[1], r[0])):
            rows.append((key[0], int(i), bool(until > ms)))
            if blocked:
                until = max(until, ms + length)
    state.update((int(until),))
    yield pd.DataFrame(rows, columns=["engine", "id", "skip"])


def cooldown(requests: DataFrame) -> DataFrame:
    """(engine, id, skip) of a stream of (engine, id, ms, blocked): requests inside a cooldown are to be skipped."""
    return requests.groupBy("engine").applyInPandasWithState(
        _cool, "engine string, id bigint, skip boolean", "until bigint", "append", GroupStateTimeout.NoTimeout
    )


def first_fetches(events: DataFrame, key: str, ts: str, ttl: str = "1 hour") -> DataFrame:
    """The events that a cache with this time to live would not answer."""
    return events.withWatermark(ts, ttl).dropDuplicatesWithinWatermark([key])


def windowed(events: DataFrame, ts: str, kind: str, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """(start, kind, n) per tumbling window; later rows than `late` are dropped by the watermark."""
    return (
        events.withWatermark(ts, late).groupBy(F.window(ts, width), kind).agg(F.count(F.lit(1)).alias("n"))
        .select(F.col("window.start").alias("start"), kind, "n")
    )
