"""Keyed state on file streams, cut and restarted anywhere, equals the batch fold."""

import random

import pytest
from pyspark.sql import functions as F

from cartage.streaming import processors, state


def _play(spark, tmp_path, parts, schema, make):
    """Run ``make`` over a folder that gets one file at a time, restarted from its checkpoint each time."""
    for k, part in enumerate(parts):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
        make(stream).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/ck").outputMode("append").trigger(availableNow=True).start().awaitTermination(300)
    return spark.read.parquet(f"{tmp_path}/out").collect()


def test_limits_over_restarts_equal_the_batch_fold(spark, tmp_path):
    rng, t, rows = random.Random(3), 1000.0, []
    for i in range(120):
        t += rng.choice([0.5, 1, 4])
        rows.append((i, rng.choice("abc"), t))
    schema = "order_id long, key string, t double"
    late = [(999, "a", 1.0)]  # far behind the watermark: dropped
    got = _play(spark, tmp_path, [rows[:40], rows[40:41], rows[41:] + late], schema, lambda s: processors.limited(s, 3, 10.0, "1 minutes"))
    want = state.limit_batch(spark.createDataFrame(rows, schema), "key", "t", "order_id", 3, 10.0).collect()
    assert {(r.order_id, r.allowed) for r in got} == {(r.order_id, r.allowed) for r in want} and len(got) == 120


def test_claims_over_restarts_know_the_ledger(spark, tmp_path):
    schema = "order_id long, event string, t double"
    parts = [[(1, "x", 1.0), (2, "y", 2.0), (3, "x", 3.0)], [(4, "y", 4.0), (5, "z", 5.0)], [(5, "z", 5.0), (6, "w", 6.0)]]
    ledger = spark.createDataFrame([("w",), ("w",), ("q",)], "event string")
    got = _play(spark, tmp_path, parts, schema, lambda s: processors.claimed(s, "event", ledger))
    flat = spark.createDataFrame([r for p in parts for r in p], schema)
    want = state.claim(flat, ledger, ["event"], "order_id").collect()
    assert {(r.order_id, r.event) for r in got} == {(r.order_id, r.event) for r in want} == {(1, "x"), (2, "y"), (5, "z")}


@pytest.mark.parametrize("seed", [1])
def test_payments_over_restarts_equal_the_ordered_fold(spark, tmp_path, seed):
    rng = random.Random(seed)
    schema = "order_id long, key string, t double, kind string"
    rows = [(i, rng.choice("abcdez"), float(i), rng.choice(["succeeded", "failed", "expired", "ignored", "failed"])) for i in range(40)]
    sessions = spark.createDataFrame([(k, "pending") for k in "abcd"] + [("e", "succeeded")], "key string, status string")
    got = _play(spark, tmp_path, [rows[:5], rows[5:20], rows[20:] + rows[-3:]], schema, lambda s: processors.payments(s, sessions))
    last = {}
    for r in sorted(got, key=lambda r: r.order_id):
        last[r.key] = r.status
    kinds = F.transform(F.array_sort(F.collect_list(F.struct("order_id", "kind"))), lambda x: x["kind"])
    fold = {r.key: r.s for r in spark.createDataFrame(rows, schema).groupBy("key").agg(state.payment_state(kinds).alias("s")).collect()}
    assert {k: last.get(k, "pending") for k in "abcd"} == {k: fold.get(k, "pending") for k in "abcd"}
    assert "z" not in last and "e" not in last  # unknown sessions and finished ones do not change
