"""Event-time windows, deduplication and session timeouts. All take batch and streaming DataFrames alike, but for what says otherwise."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def _late(rows: DataFrame, delay: str | None) -> DataFrame:
    return rows.withWatermark("ts", delay) if delay and rows.isStreaming else rows


def windowed(rows: DataFrame, keys: Sequence[str], length: str, slide: str | None = None, delay: str | None = None) -> DataFrame:
    """keys, start, end, n, total of `value` for each window of event time; a stream gives a window once it is `delay` old."""
    window = F.window("ts", length, slide) if slide else F.window("ts", length)
    found = _late(rows, delay).groupBy(window, *keys).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return found.select(*keys, F.col("window.start").alias("start"), F.col("window.end").alias("end"), "n", "total")


def sessions(rows: DataFrame, keys: Sequence[str], gap: str, delay: str | None = None) -> DataFrame:
    """keys, start, end, n of stretches without a pause of `gap`."""
    found = _late(rows, delay).groupBy(F.session_window("ts", gap), *keys).agg(F.count("*").alias("n"))
    return found.select(*keys, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def first_only(rows: DataFrame, keys: Sequence[str], delay: str = "1 hour") -> DataFrame:
    """One row for each key; a stream forgets keys after `delay`."""
    return _late(rows, delay).dropDuplicatesWithinWatermark(list(keys)) if rows.isStreaming else rows.dropDuplicates(list(keys))


def session_timeouts(heartbeats: DataFrame, timeout_ms: int) -> DataFrame:
    """member_id, state, last_ms of a stream of heartbeats (member_id, ts): `alive` when heard of, `expired` when event time has passed the last
    heartbeat by the timeout. Needs a watermark on ts."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            (last,) = state.get
            state.remove()
            yield pd.DataFrame({"member_id": [key[0]], "state": ["expired"], "last_ms": [last]})
            return
        last = state.get[0] if state.exists else 0
        for pdf in batches:
            if len(pdf):
                last = max(last, int(pdf["_ms"].max()))
        state.update((last,))
        state.setTimeoutTimestamp(max(last + timeout_ms, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"member_id": [key[0]], "state": ["alive"], "last_ms": [last]})

    beats = heartbeats.select("member_id", "ts", F.unix_millis("ts").alias("_ms"))
    return beats.groupBy("member_id").applyInPandasWithState(step, "member_id string, state string, last_ms long", "last_ms long", "update", GroupStateTimeout.EventTimeTimeout)
