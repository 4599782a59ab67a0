"""Models as stored rows: versions under two writers, parameters read back, the order of reasons, estimates made anew."""

import math
import random
import statistics

import pytest
from pyspark.sql import functions as F

from cartage.operators import pricing, registry
from cartage.sources import commits


def _rows(spark, n, seed=1, tenants=("a", "b")):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        size = rng.choice(["1br", "2br"]) if rng.random() < 0.95 else "studio"
        base = rng.choice([3.0, 5.5])
        rows.append((tenants[i % len(tenants)], i, f"2024-{i % 12 + 1:02d}-{i % 28 + 1:02d}", size, base, base * math.exp(rng.gauss(0.1, 0.2)), 5.0 if i % 9 else None))
    df = spark.createDataFrame(rows, "tenant string, id long, day string, home_size string, base double, actual double, miles double").withColumn("day", F.to_timestamp_ntz("day"))
    priced = df.withColumn("p", F.struct(F.col("base").alias("estimated_hours"), F.lit(1000).cast("long").alias("total_cents")))
    return registry.training_rows(priced, "p", "actual", F.col("miles"), F.lit(1), F.lit(0)), rows


def test_models_are_fitted_stored_and_read_back(spark, tmp_path):
    root = f"file://{tmp_path}/m"
    training, rows = _rows(spark, 300)
    registry.store(spark, root, registry.fit(training, "tenant", "home_size", "id", "day", "actual"), "tenant")
    models = commits.read(spark, root, "models")
    got = {r.tenant: r for r in models.withColumn("m", F.from_json("params", registry.PARAMS)).collect()}
    for tenant in "ab":
        mine = [(r[3], math.log(r[5] / r[4])) for r in rows if r[0] == tenant and r[6] is not None]
        overall = statistics.median(v for _, v in mine)
        r = got[tenant]
        assert (r.version, r.status, r.n_train) == (1, "shadow", len(mine)) and r.m.global_log_ratio == pytest.approx(overall, abs=1e-15)
        for size, s in r.m.segments.items():
            own = [v for x, v in mine if x == size]
            assert s.n == len(own) and s.log_ratio == pytest.approx((len(own) * statistics.median(own) + 10 * overall) / (len(own) + 10))
        assert '"considered":{"eligible":' in r.metrics and "improvement_pct" in r.metrics and len(r.fingerprint) == 64
    assert got["a"].fingerprint != got["b"].fingerprint
    again = registry.fit(training.orderBy(F.desc("id")), "tenant", "home_size", "id", "day", "actual").collect()
    assert {r.tenant: r.fingerprint for r in again} == {t: r.fingerprint for t, r in got.items()}


def test_of_two_writers_one_wins_and_the_other_takes_the_next_version(spark, tmp_path, monkeypatch):
    root = f"file://{tmp_path}/m"
    one = spark.createDataFrame([("a", "x"), ("b", "x")], "tenant string, params string")
    assert registry.store(spark, root, one, "tenant") == "models-000000001"
    publish, calls = commits.publish, []

    def slow(spark, root, name, adds, drops=None):
        calls.append(name)
        if len(calls) == 1:  # another writer is faster
            rival = spark.createDataFrame([("a", "rival", 2, "shadow")], "tenant string, params string, version int, status string")
            publish(spark, root, name, {"models": rival})
        return publish(spark, root, name, adds, drops)

    monkeypatch.setattr(commits, "publish", slow)
    assert registry.store(spark, root, one.where("tenant = 'a'"), "tenant") == "models-000000003"
    rows = {(r.tenant, r.version): r.params for r in commits.read(spark, root, "models").collect()}
    assert rows == {("a", 1): "x", ("b", 1): "x", ("a", 2): "rival", ("a", 3): "x"}
    monkeypatch.setattr(commits, "publish", publish)
    registry.promote(spark, root, "tenant", spark.createDataFrame([("a", 2)], "tenant string, version int"))
    registry.promote(spark, root, "tenant", spark.createDataFrame([("a", 3)], "tenant string, version int"))
    models = commits.read(spark, root, "models")
    assert {(r.tenant, r.version): r.status for r in models.collect()} == {("a", 1): "shadow", ("b", 1): "shadow", ("a", 2): "retired", ("a", 3): "active"}
    assert [(r.tenant, r.version) for r in registry.listed(models, "tenant").collect()] == [("a", 3), ("a", 2), ("a", 1), ("b", 1)]


def test_reasons_come_in_order_and_leave_the_estimate_alone(spark):
    model = "struct<global_log_ratio: double, n_train: long, shrinkage_k: double, segments: map<string, struct<log_ratio: double, raw_log_ratio: double, n: long>>>"
    models = spark.createDataFrame([("few", 1, (0.1, 19, 10.0, {})), ("ok", 1, (0.5, 60, 10.0, {"2br": (-0.05, -0.1, 30), "1br": (0.02, 0.02, 12), "studio": (0.9, 0.9, 7)})), ("bad", 1, (None, 60, 10.0, {}))], f"tenant string, version int, model {model}")
    quotes = [("none", "2br", 5.0), ("few", "2br", 5.0), ("ok", "2br", 5.0), ("ok", "1br", 5.0), ("ok", "studio", 5.0), ("ok", "2br", 0.0), ("bad", "2br", 5.0)]
    df = spark.createDataFrame(quotes, "tenant string, home_size string, base double")
    got = [tuple(r) for r in registry.predicted(df, models, "tenant", "home_size", F.col("base")).select("tenant", "home_size", "base", "c.reason", F.round("c.factor", 6), "c.segment", "c.clamped").collect()]
    want = {("none", "2br", 5.0, "no_model", 1.0, None, False), ("few", "2br", 5.0, "insufficient_history", 1.0, None, False), ("ok", "2br", 5.0, None, round(math.exp(-0.05), 6), "2br", False), ("ok", "1br", 5.0, "insufficient_support", 1.0, None, False), ("ok", "studio", 5.0, None, 1.15, "all", True), ("ok", "2br", 0.0, "unusable_base", 1.0, None, False), ("bad", "2br", 5.0, "model_error", 1.0, None, False)}
    assert set(got) == want


def test_rebuilt_lines_equal_an_estimate_of_those_hours(spark):
    """At factor 1 the estimate comes back; at another one labour follows the hours and travel stays."""
    df = spark.createDataFrame([(1, "2br", "2025-05-31", 10.0), (2, "studio", "2025-02-04", 0.0)], "id int, size string, day string, miles double")
    side = {"floor": F.lit(3), "flights": F.lit(0), "elevator": F.lit(False)}
    base = pricing.priced(df, "p", F.col("size"), F.lit("full"), F.array(F.lit("piano")), side, side, F.col("miles"), F.to_date("day"))
    same = registry.rebuilt(base.withColumn("c", F.struct(F.lit(1.0).alias("factor"), F.lit(None).cast("string").alias("reason"))), "p", "c")
    assert all(r.p == r.calibrated for r in same.collect())
    more = {r.id: r for r in registry.rebuilt(base.withColumn("c", F.struct(F.lit(1.1).alias("factor"), F.lit(None).cast("string").alias("reason"))), "p", "c").collect()}
    for r in more.values():
        hours = math.ceil(round(r.p.estimated_hours * 1.1 * 2, 9)) / 2
        lines = {x.code: x.amount_cents for x in r.calibrated.line_items}
        assert r.calibrated.estimated_hours == hours and lines["labor"] == hours * {2: 14000, 3: 19000}[r.p.crew_size]
        assert lines["travel"] == {x.code: x.amount_cents for x in r.p.line_items}["travel"]
        assert abs(r.calibrated.total_cents - (lines["labor"] + lines["travel"]) * r.p.adjustment_multiplier) < 1
    defaults = spark.range(1).select(F.struct(*[v.alias(k) for k, v in registry.side_defaults(F.lit(None).cast("int"), F.lit(-2), F.lit(None).cast("boolean")).items()]).alias("s")).first().s
    assert tuple(defaults) == (1, 0, False)
