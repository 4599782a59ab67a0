"""Keyed state over streams: sliding-window limits, exactly-once claims and the payment state machine.

The same fold serves batch replay (``applyInPandas`` per key) and streams (``applyInPandasWithState``).
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def allow(hits: list[float], t: float, limit: int, window: float) -> bool:
    """Decide one request and update ``hits`` in place; a denied request leaves no trace."""
    while hits and hits[0] <= t - window:
        hits.pop(0)
    if len(hits) >= limit:
        return False
    hits.append(t)
    return True


def limit_batch(events: DataFrame, key: str, t: str, order: str, limit: int, window: float) -> DataFrame:
    """(order, key, t, allowed) of a finished stream.  A key's state is at most ``limit`` times, its rows come sorted."""
    slim = events.select(F.col(order).cast("long").alias("order_id"), F.col(key).cast("string").alias("key"), F.col(t).cast("double").alias("t"))
    parts = int(events.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def fold(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, hits = None, []
        for f in frames:
            out = []
            for k, at in zip(f["key"], f["t"], strict=True):
                if k != last:
                    last, hits = k, []
                out.append(allow(hits, at, limit, window))
            yield f.assign(allowed=out)

    return slim.repartition(parts, "key").sortWithinPartitions("key", "t", "order_id").mapInPandas(fold, "order_id long, key string, t double, allowed boolean")


def limit_stream(events: DataFrame, limit: int, window: float, delay: str = "10 minutes") -> DataFrame:
    """The same on a stream of (key, t in seconds, order_id); a key's state goes when the watermark has passed its last hit by a window.

    Rows later than ``delay`` are dropped, as their window may be gone.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        hits = list(state.get[0]) if state.exists else []
        rows = pd.concat(list(frames)).sort_values(["t", "order_id"])
        rows["allowed"] = [allow(hits, t, limit, window) for t in rows["t"]]
        state.update((hits,))
        state.setTimeoutTimestamp(max(int((rows["t"].max() + window) * 1000), state.getCurrentWatermarkMs() + 1))
        yield rows[["order_id", "key", "t", "allowed"]]

    timed = events.withColumn("at", F.timestamp_seconds("t")).withWatermark("at", delay)
    return timed.groupBy("key").applyInPandasWithState(step, "order_id long, key string, t double, allowed boolean", "hits array<double>", "append", GroupStateTimeout.EventTimeTimeout)


def limit_all(events: DataFrame, limits: dict[str, tuple[str, int, float]], t: str, order: str) -> DataFrame:
    """(order_id, name, key, allowed) under several independent limits: name -> (key column, hits, seconds)."""
    out = [limit_batch(events.withColumn("__key", F.concat_ws(":", F.lit(name), F.col(c).cast("string"))), "__key", t, order, n, window).select("order_id", F.lit(name).alias("name"), "key", "allowed") for name, (c, n, window) in limits.items()]
    for more in out[1:]:
        out[0] = out[0].unionByName(more)
    return out[0]


def claim(events: DataFrame, ledger: DataFrame | None, keys: list[str], order: str) -> DataFrame:
    """The first of each key that the ledger doesn't have yet."""
    firsts = events.groupBy(*keys).agg(F.min_by(F.struct(*[c for c in events.columns if c not in keys]), order).alias("__row")).select(*keys, "__row.*")
    return firsts if ledger is None else firsts.join(ledger.select(*keys).distinct(), keys, "left_anti")


def claim_stream(events: DataFrame, keys: list[str], at: str, delay: str) -> DataFrame:
    """First of each key within the watermark's reach."""
    return events.withWatermark(at, delay).dropDuplicatesWithinWatermark(keys)


def payment_state(kinds: object) -> object:
    """The status after ordered event kinds: success is final, failure only leaves pending; others are ignored."""
    return F.aggregate(
        kinds,
        F.lit("pending"),
        lambda s, k: F.when(s == "succeeded", s).when(k == "succeeded", F.lit("succeeded")).when((s == "pending") & (k == "failed"), F.lit("failed")).when((s == "pending") & (k == "expired"), F.lit("cancelled")).otherwise(s),
    )
