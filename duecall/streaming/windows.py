"""Windows over events: anchored rate limits, tumbling windows with watermarks, sessions.

The rate limit's window begins at a key's first event and again at the first event after it
ends, which no grid expresses: a fold over each key's events in order.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def folded(times: list[int], start: int | None, count: int, width: int, limit: int) -> tuple[list[tuple[int, bool]], int | None, int]:
    """((window start, allowed) of each event, the window's start, its count)."""
    out = []
    for t in times:
        if start is None or t >= start + width:
            start, count = t, 0
        count += 1
        out.append((start, count <= limit))
    return out, start, count


def rate_limited(events: DataFrame, keys: list[str], seconds: int, limit: int) -> DataFrame:
    """events (keys, event_id, ts) with window_start and allowed.

    Sorted by key and time within partitions, events stream through the fold in batches: no
    key is held whole, but each window hangs on the one before, so one key's events pass through one task.
    """
    kinds = dict(events.dtypes)
    slim = events.select(*keys, "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("_t"))
    slim = slim.repartition(*keys).sortWithinPartitions(*keys, "_t", "event_id")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, start, count = object(), None, 0
        for b in batches:
            starts, allowed = [], []
            for raw, t in zip(b[keys].itertuples(index=False, name=None), b["_t"], strict=True):
                key = tuple(None if pd.isna(x) else x for x in raw)
                if key != last:
                    last, start, count = key, None, 0
                (one,), start, count = folded([t], start, count, seconds * 1_000_000, limit)
                starts.append(one[0])
                allowed.append(one[1])
            yield b.assign(window_start=starts, allowed=allowed).drop(columns="_t")

    schema = ", ".join(f"{k} {kinds[k]}" for k in keys) + ", event_id long, window_start long, allowed boolean"
    out = slim.mapInPandas(run, schema)
    at = F.lit("1970-01-01").cast("timestamp_ntz") + F.make_dt_interval(secs=(F.col("window_start") / 1_000_000).cast("decimal(18,6)"))
    return out.withColumn("window_start", at)


def rate_limited_stream(events: DataFrame, key: str, seconds: int, limit: int, late: str = "10 minutes") -> DataFrame:
    """The same on a stream: a key's state is two numbers, its window's start and its count, and
    goes once the watermark has passed the window's end. Rows later than the watermark are dropped."""

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        start, count = state.get if state.exists else (None, 0)
        rows = pd.concat(list(batches)).sort_values(["ts", "event_id"])
        times = rows["ts"].astype("int64").floordiv(1000 if str(rows["ts"].dtype).startswith("datetime64[ns") else 1).tolist()
        out, start, count = folded(times, start, count, seconds * 1_000_000, limit)
        state.update((start, count))
        state.setTimeoutTimestamp(max((start + seconds * 1_000_000) // 1000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({key: k[0], "event_id": rows["event_id"].to_numpy(), "allowed": [a for _, a in out]})

    kind = dict(events.dtypes)[key]
    rows = events.withWatermark("ts", late)
    return rows.groupBy(key).applyInPandasWithState(step, f"{key} {kind}, event_id long, allowed boolean", "start long, count long", "append", GroupStateTimeout.EventTimeTimeout)


def tumbling(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts and sums by window and type; on a stream, late rows beyond the watermark are dropped."""
    rows = events.withColumn("ts", F.col("ts").cast("timestamp"))
    rows = rows.withWatermark("ts", late) if rows.isStreaming else rows
    return rows.groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


def sessions(events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    rows = events.withColumn("ts", F.col("ts").cast("timestamp"))
    return rows.groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n"))
