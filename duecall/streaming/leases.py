"""Leases and caches whose state lapses: keyed state with event-time timers, and state with a time to live.

A lease runs from an event of its key for a while and is renewed by every later one. Where the next event
comes after its end, or none does and the watermark passes it, one row tells that it lapsed, and
the state goes. An event that comes late, within the watermark, renews what is still open. The state is one number
a key; it lies in the checkpoint, so a restarted stream goes on with it. How the events are cut into batches
doesn't matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

#: State with timers needs this store.
STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def _millis(micros: int) -> int:
    return -(-micros // 1000)


class Lease(StatefulProcessor):
    """Renews a key's lease by its events' times ``micros`` in microseconds, and tells when it lapsed."""

    def __init__(self, key: str, micros: int) -> None:
        self.key, self.micros = key, micros

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.until = handle.getValueState("until", "until long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        until = self.until.get()[0] if self.until.exists() else None
        lapsed = []
        for t in sorted(x for b in rows for x in b["micros"].tolist()):
            if until is not None and t > until:
                lapsed.append(until)
            until = max(until or 0, t + self.micros)
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        self.until.update((until,))
        self.handle.registerTimer(_millis(until))
        yield pd.DataFrame({self.key: [key[0]] * len(lapsed), "lapsed": lapsed})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        until = self.until.get()[0] if self.until.exists() else None
        if until is not None and _millis(until) <= expiredTimerInfo.getExpiryTimeInMs():
            self.until.clear()
            yield pd.DataFrame({self.key: [key[0]], "lapsed": [until]})
        else:
            yield pd.DataFrame({self.key: [], "lapsed": []})

    def close(self) -> None:
        pass


def lapses(events: DataFrame, key: str, seconds: int, late: str = "0 seconds") -> DataFrame:
    """(key, lapsed_at) of a stream of (key, ts): when each lease ended that was not renewed in time."""
    kind = dict(events.dtypes)[key]
    rows = events.select(key, F.col("ts").cast("timestamp").alias("ts")).withColumn("micros", F.unix_micros("ts")).withWatermark("ts", late)
    out = rows.groupBy(key).transformWithStateInPandas(Lease(key, seconds * 1_000_000), f"{key} {kind}, lapsed long", "append", "eventTime")
    at = F.lit("1970-01-01").cast("timestamp_ntz") + F.make_dt_interval(secs=(F.col("lapsed") / 1_000_000).cast("decimal(18,6)"))
    return out.select(key, at.alias("lapsed_at"))


class Cache(StatefulProcessor):
    """Tells of each request of a key whether it was kept, and keeps it for a while from the first miss on."""

    def __init__(self, key: str, millis: int) -> None:
        self.key, self.millis = key, millis

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.kept = handle.getValueState("kept", "id long", ttlDurationMs=self.millis)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        ids = sorted(x for b in rows for x in b["event_id"].tolist())
        known = self.kept.exists()
        source = self.kept.get()[0] if known else ids[0]
        if not known:
            self.kept.update((source,))
        yield pd.DataFrame({self.key: [key[0]] * len(ids), "event_id": ids, "answered_by": source, "fresh": [not known and i == source for i in ids]})

    def close(self) -> None:
        pass


def cached(requests: DataFrame, key: str, seconds: float) -> DataFrame:
    """(key, event_id, answered_by, fresh) of a stream of (key, event_id): the request whose answer each one gets, which
    lives for so many seconds of the clock; the state goes by itself."""
    kind = dict(requests.dtypes)[key]
    return requests.select(key, "event_id").groupBy(key).transformWithStateInPandas(Cache(key, int(seconds * 1000)), f"{key} {kind}, event_id long, answered_by long, fresh boolean", "append", "processingTime")
