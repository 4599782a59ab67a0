"""Exact order statistics in bounded memory and intervals from brackets, against brute force."""

import random
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from cartage.operators import quantiles, stats


def _value(values, kind, q):
    s = sorted(values)
    if kind == "nearest":
        return s[max(0, -(-int(q * 100) * len(s) // 100) - 1)]
    if kind == "upper":
        return s[len(s) // 2]
    at = q * (len(s) - 1)
    lo = int(at)
    return s[lo] if lo == at else s[lo] * (1 - (at - lo)) + s[lo + 1] * (at - lo)


def _groups(seed):
    rng = random.Random(seed)
    return {
        "normal": [rng.gauss(0, 1) for _ in range(4001)], "ties": [float(rng.randrange(3)) for _ in range(3000)], "one": [7.0] * 2500, "edge": [5.0] * 1500 + [5.0 + rng.random() for _ in range(1500)],
        "far": [rng.random() for _ in range(2000)] + [1e300, -1e300], "powers": [2.0 ** rng.uniform(-500, 500) for _ in range(2600)], "few": [3.0, 1.0, 2.0], "single": [4.0], None: [rng.random() for _ in range(2100)],
    }


@pytest.mark.parametrize("limit", [10, 300, 1_000_000])
def test_quantiles_of_large_and_tied_groups(spark, limit):
    groups = _groups(limit)
    rows = [(g, v) for g, values in groups.items() for v in values] + [("none", None), ("few", None)]
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, "g string, v double").repartition(6)
    wanted = {"m": (F.col("v"), 0.5), "q": (F.col("v"), 0.9), "p": (F.col("v") * 2, quantiles.nearest(0.9)), "u": (F.col("v"), quantiles.upper_middle()), "least": (F.col("v"), 0.0), "most": (F.col("v"), 1.0)}
    got = {r.g: r for r in quantiles.with_quantiles(df, ["g"], [F.count("v").alias("n")], wanted, limit).collect()}
    assert set(got) == {*groups, "none"} and got["none"].m is None and got["none"].n == 0
    for g, values in groups.items():
        r = got[g]
        assert r.n == len(values)
        want = {"m": _value(values, "linear", 0.5), "q": _value(values, "linear", 0.9), "p": 2 * _value(values, "nearest", 0.9), "u": _value(values, "upper", 0), "least": min(values), "most": max(values)}
        for k, v in want.items():
            assert r[k] == pytest.approx(v, rel=1e-12), (g, k)


def test_one_group_of_all_rows_is_never_in_one_task(spark):
    """Of 200 000 rows in one group at most ``limit`` are sorted; every pass sends counts or what lies between two bounds."""
    sizes = []
    sort = quantiles._sorted_ranks

    def watched(rows, want):
        sizes.append(rows.count())
        return sort(rows, want)

    quantiles._sorted_ranks = watched
    try:
        df = spark.range(200_000).select((F.xxhash64("id") % 1_000_003).cast("double").alias("v"))
        got = quantiles.exact_quantiles(df, [], {"m": (F.col("v"), 0.5)}, limit=2_000).first().m
    finally:
        quantiles._sorted_ranks = sort
    assert got == statistics.median(r.v for r in df.collect())
    assert sizes and max(sizes) <= 2_000


def test_empty_tables_have_no_quantiles(spark):
    df = spark.createDataFrame([], "g string, v double")
    assert quantiles.exact_quantiles(df, ["g"], {"m": (F.col("v"), 0.5)}).count() == 0
    assert [r.m for r in quantiles.with_quantiles(df, [], [F.count("v").alias("n")], {"m": (F.col("v"), 0.5)}).collect()] == [None]


def _bootstrap(base, cand, actual, iterations, seed):
    rng, n = np.random.default_rng(seed), len(actual)
    gaps = [np.abs(actual - p) / p * 100 for p in (base, cand)]
    pick = rng.integers(0, n, (iterations, n))
    b, c = (np.median(g[pick], axis=1) for g in gaps)
    found = np.sort((b - c) / b * 100)
    return found[int(0.025 * iterations)], found[int(0.975 * iterations) - 1]


def _history(n, seed, gain):
    rng = np.random.default_rng(seed)
    actual = rng.uniform(4, 12, n)
    base = actual * np.exp(rng.normal(0, 0.3, n))
    cand = actual * np.exp(rng.normal(0, 0.3 * (1 - gain), n))
    return base, cand, actual


def test_intervals_agree_with_resampling_of_all_rows(spark):
    rows, plain = [], {}
    for tenant, n, gain in (("a", 40, 0.3), ("b", 3000, 0.2), ("c", 9, 0.5), ("d", 2500, 0.0)):
        base, cand, actual = _history(n, n, gain)
        plain[tenant] = _bootstrap(base, cand, actual, 4000, 1) if n >= 10 else None
        rows += [(tenant, i, float(b), float(c), float(a)) for i, (b, c, a) in enumerate(zip(base, cand, actual, strict=True))]
    df = spark.createDataFrame(rows, "tenant string, rn int, base double, calibrated double, actual double").repartition(5)
    got = {r.tenant: r for r in stats.intervals(df, "tenant", "base", "actual", 4000, 3, limit=200).collect()}
    assert {t: r.n for t, r in got.items()} == {"a": 40, "b": 3000, "c": 9, "d": 2500}
    assert got["c"].ci_low_pct is None and not got["c"].significant
    for tenant in "abd":
        low, high = plain[tenant]
        width = high - low
        assert abs(got[tenant].ci_low_pct - low) < 0.15 * width and abs(got[tenant].ci_high_pct - high) < 0.15 * width
    assert got["b"].significant and not got["d"].significant


def test_interval_covers_a_known_effect():
    """Of 95-percent intervals about 95 percent hold the improvement of the medians of the whole population."""
    big = _history(400_000, 99, 0.25)
    gaps = [np.median(np.abs(big[2] - p) / p * 100) for p in big[:2]]
    truth, held = (gaps[0] - gaps[1]) / gaps[0] * 100, 0
    for seed in range(60):
        base, cand, actual = _history(200, seed, 0.25)
        pairs = np.stack([np.abs(actual - p) / p * 100 for p in (base, cand)], axis=1)
        low, high = stats.resampled_interval(pairs, np.zeros((200, 2), int), np.zeros((2, 2), int), 600, seed)
        held += low <= truth <= high
    assert held >= 51


def test_corners_stand_for_rows_far_from_the_medians():
    base, cand, actual = _history(2000, 5, 0.2)
    gaps = np.stack([np.abs(actual - p) / p * 100 for p in (base, cand)], axis=1)
    whole = stats.resampled_interval(gaps, np.zeros((2000, 2), int), np.zeros((2, 2), int), 3000, 1)
    ends = [np.sort(gaps[:, k])[[1000 - 148, 1000 + 148]] for k in (0, 1)]
    side = np.stack([np.where(gaps[:, k] < ends[k][0], -1, np.where(gaps[:, k] > ends[k][1], 1, 0)) for k in (0, 1)], axis=1)
    near = (side == 0).any(axis=1)
    corner = np.zeros((2, 2), np.int64)
    for a, b in side[~near]:
        corner[int(a > 0), int(b > 0)] += 1
    part = stats.resampled_interval(gaps[near], side[near], corner, 3000, 2)
    assert near.sum() < 800 and abs(part[0] - whole[0]) < 0.1 * (whole[1] - whole[0]) and abs(part[1] - whole[1]) < 0.1 * (whole[1] - whole[0])
