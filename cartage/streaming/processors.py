"""Keyed state on streams as processors with timers, time to live and initial state: limits, claims and payments.

Rows of a key are taken in order of time inside a micro-batch, and micro-batches as they come, so a stream that comes in order gives
what the batch fold of ``state`` gives, whatever its cuts.  State lies in RocksDB, not in the heap.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from cartage.streaming.state import allow

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def with_rocksdb(spark: SparkSession) -> None:
    """Streams of this session that start from now on keep their state in RocksDB, which processors need."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)


def _in_order(rows: Iterator[pd.DataFrame]) -> pd.DataFrame:
    return pd.concat(list(rows)).sort_values(["t", "order_id"], kind="stable")


class Limiter(StatefulProcessor):
    """A sliding-window limit; a key's hits go by a timer when the watermark is a window past the last of them."""

    OUT = "order_id long, key string, t double, allowed boolean"

    def __init__(self, limit: int, window: float) -> None:
        self.limit, self.window = limit, window

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.hits = handle.getValueState("hits", "at array<double>")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        hits = list(self.hits.get()[0]) if self.hits.exists() else []
        out = _in_order(rows)
        out["allowed"] = [allow(hits, t, self.limit, self.window) for t in out["t"]]
        self.hits.update((hits,))
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        self.handle.registerTimer(max(int((out["t"].max() + self.window) * 1000), timerValues.getCurrentWatermarkInMs() + 1))
        yield out.assign(key=key[0])[["order_id", "key", "t", "allowed"]]

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        self.hits.clear()
        return iter([])

    def close(self) -> None:
        pass


class Claims(StatefulProcessor):
    """The first row of each key; keys of the ledger (the initial state) are claimed already.  With ``ttl_ms`` a claim is forgotten after that time."""

    def __init__(self, columns: list[str], ttl_ms: int | None = None) -> None:
        self.columns, self.ttl = columns, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.claimed = handle.getValueState("claimed", "yes boolean", self.ttl)

    def handleInitialState(self, key: tuple, initialState: pd.DataFrame, timerValues: object) -> None:  # noqa: N802, N803
        self.claimed.update((True,))

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        if self.claimed.exists():
            for _ in rows:
                pass
            return
        self.claimed.update((True,))
        yield _in_order(rows)[self.columns].iloc[:1]

    def close(self) -> None:
        pass


class Payments(StatefulProcessor):
    """The status of a payment session: success is final, failure and expiry only leave pending; sessions that the ledger lacks are ignored.

    The initial state has each session's status; a row goes out for each change.
    """

    OUT = "key string, order_id long, status string"

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.status = handle.getValueState("status", "status string")

    def handleInitialState(self, key: tuple, initialState: pd.DataFrame, timerValues: object) -> None:  # noqa: N802, N803
        self.status.update((initialState["status"].iloc[0],))

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        ordered = _in_order(rows)
        if not self.status.exists():
            return
        now, out = self.status.get()[0], []
        for number, kind in zip(ordered["order_id"], ordered["kind"], strict=True):
            new = "succeeded" if kind == "succeeded" else {"failed": "failed", "expired": "cancelled"}.get(kind, now) if now == "pending" else now
            if new != now and now != "succeeded":
                now = new
                out.append((key[0], number, now))
        if out:
            self.status.update((now,))
            yield pd.DataFrame(out, columns=["key", "order_id", "status"])

    def close(self) -> None:
        pass


def limited(events: DataFrame, limit: int, window: float, delay: str = "10 minutes") -> DataFrame:
    """(order_id, key, t, allowed) of a stream (order_id, key, t in seconds); rows later than ``delay`` are dropped."""
    with_rocksdb(events.sparkSession)
    timed = events.withColumn("at", F.timestamp_seconds("t")).withWatermark("at", delay)
    return timed.groupBy("key").transformWithStateInPandas(Limiter(limit, window), Limiter.OUT, "Append", "EventTime")


def claimed(events: DataFrame, key: str, ledger: DataFrame | None = None, ttl_ms: int | None = None) -> DataFrame:
    """The first row of each key of a stream that has order_id and t; ``ledger`` has keys that are claimed already."""
    with_rocksdb(events.sparkSession)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in events.schema)
    start = None if ledger is None else ledger.select(key).distinct().groupBy(key)
    return events.groupBy(key).transformWithStateInPandas(Claims(events.columns, ttl_ms), schema, "Append", "ProcessingTime" if ttl_ms else "None", start)


def payments(events: DataFrame, sessions: DataFrame) -> DataFrame:
    """(key, order_id, status) for each change, from a stream (key, order_id, t, kind) and the sessions (key, status) of before."""
    with_rocksdb(events.sparkSession)
    return events.groupBy("key").transformWithStateInPandas(Payments(), Payments.OUT, "Append", "None", sessions.select("key", "status").groupBy("key"))
