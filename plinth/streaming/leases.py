"""Leases that run out: state with an event-time timer per key, so that it leaves when its lease ends instead of being kept for good."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

EXPIRED = "key long, since long, expired long"
_STORE, _ROCKS = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class _Leases(StatefulProcessor):
    """Per key the last sign of life; a timer at its end. A later sign moves the timer."""

    def __init__(self, lease: int):
        self.lease = lease

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "since long")

    def _rows(self, key: int, ends: list[int]) -> pd.DataFrame:
        return pd.DataFrame({"key": [key] * len(ends), "since": ends, "expired": [e + self.lease for e in ends]}).astype("int64")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        signs = sorted(int(t) for part in rows for t in part["at"])
        ends, last = [], int(self.last.get()[0]) if self.last.exists() else None
        if last is not None:
            self.handle.deleteTimer(last + self.lease)
        for at in signs:
            if last is not None and at >= last + self.lease:
                ends.append(last)
            last = at if last is None else max(last, at)
        self.last.update((last,))
        self.handle.registerTimer(last + self.lease)
        yield self._rows(key[0], ends)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        last = int(self.last.get()[0])
        self.last.clear()
        yield self._rows(key[0], [last])

    def close(self) -> None:
        pass


def expired_leases(signs: DataFrame, lease: int, lateness: str) -> DataFrame:
    """signs: key (whole number), ts. The leases that ran out: (key, since, expired), milliseconds of the last sign of life and of the end, `lease` later; a sign at that moment comes too late. Null keys and moments take no part.

    On a stream, a lease ends when the watermark (the latest ts less lateness) passes its end, and its state goes; rows behind the watermark are dropped. A batch gives what a stream gives that has all rows in time."""
    whole = signs.where("key IS NOT NULL AND ts IS NOT NULL").select(F.col("key").cast("long").alias("key"), "ts", F.unix_millis("ts").alias("at"))
    if not whole.isStreaming:
        end = whole.agg((F.unix_millis(F.max(F.col("ts")) - F.expr(f"INTERVAL {lateness}"))).alias("mark"))
        following = F.lead("at").over(Window.partitionBy("key").orderBy("at"))
        gaps = whole.withColumn("next", following).crossJoin(F.broadcast(end))  # one row
        over = F.coalesce(F.col("next") >= F.col("at") + lease, F.col("at") + lease <= F.col("mark"))
        return gaps.where(over).select("key", F.col("at").alias("since"), (F.col("at") + lease).alias("expired"))
    whole.sparkSession.conf.set(_STORE, _ROCKS)  # the only store that keeps timers
    return whole.withWatermark("ts", lateness).select("key", "ts", "at").groupBy("key").transformWithStateInPandas(_Leases(lease), EXPIRED, "Append", "EventTime")
