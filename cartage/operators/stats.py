"""Accuracy measures, robust corrections, backtests and intervals; order statistics are exact and never gather a group."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cartage.functions.staging import cut
from cartage.operators.quantiles import exact_quantiles, nearest, select_ranks, upper_middle, with_quantiles


def signed_pct(actual: Column, quoted: Column) -> Column:
    """Percent by which the actual exceeds the quoted; null where the quoted is null or 0."""
    return F.when(quoted != 0, (actual - quoted) / quoted * 100)


def hours_metrics(rows: DataFrame, predicted: str, actual: str, *by: str) -> DataFrame:
    """n, median absolute and signed percent, mean absolute error, nearest-rank P90, shares within 15 and 25 percent."""
    p, a = F.col(predicted), F.col(actual)
    gap = F.abs(a - p)
    share = (a - p) / p * 100
    good = rows.where((p > 0) & (a > 0)).withColumns({"__gap": gap, "__s": share, "__a": F.abs(share)})
    within = lambda k: F.round(F.avg((F.col("__a") <= k).cast("double")) * 100, 1)
    plain = [F.count(F.lit(1)).alias("n"), F.round(F.avg("__gap"), 3).alias("mae_hours"), within(15).alias("within_15_pct"), within(25).alias("within_25_pct")]
    out = with_quantiles(good, list(by), plain, {"ape": (F.col("__a"), 0.5), "signed": (F.col("__s"), 0.5), "p90": (F.col("__gap"), nearest(0.9))})
    return out.select(
        *by, "n", F.round("ape", 2).alias("median_ape_pct"), "mae_hours", F.round("signed", 2).alias("median_signed_error_pct"), F.round("p90", 3).alias("p90_abs_error_hours"), "within_15_pct", "within_25_pct",
    )


def shrunk_medians(rows: DataFrame, segment: str, value: str, strength: float = 10.0) -> DataFrame:
    """Each segment's median pulled to the global one: (n m_seg + k m_all) / (n + k)."""
    whole = F.broadcast(exact_quantiles(rows, [], {"m_all": (F.col(value), 0.5)}))  # one row
    parts = with_quantiles(rows, [segment], [F.count(F.lit(1)).alias("n")], {"m_seg": (F.col(value), 0.5)})
    return parts.crossJoin(whole).select(segment, "n", "m_seg", ((F.col("n") * F.col("m_seg") + strength * F.col("m_all")) / (F.col("n") + strength)).alias("shrunk"))


def clamp_cap(n: Column) -> Column:
    """How far a correction may go, by support."""
    return F.when(n >= 200, 0.20).when(n >= 50, 0.15).when(n >= 20, 0.10).otherwise(0.0)


def apply_correction(base: Column, log_ratio: Column, n: Column) -> Column:
    """Struct: factor after the clamp, hours rounded up to the half hour, reason (null where applied)."""
    cap = clamp_cap(n)
    raw = F.exp(log_ratio)
    factor = F.least(F.greatest(raw, 1 - cap), 1 + cap)
    reason = F.when(log_ratio.isNull(), "no_model").when(base.isNull() | (base <= 0), "unusable_base").when(n < 20, "insufficient_support")
    used = F.when(reason.isNull(), factor).otherwise(F.lit(1.0))
    return F.struct(used.alias("factor"), (F.ceil(F.round(base * used * 2, 9)) / 2).alias("hours"), reason.alias("reason"), (F.abs(raw - factor) > 1e-9).alias("clamped"))


def rolling_folds(rows: DataFrame, order: list[str], total: int, folds: int = 4, first_min: int = 20, test_min: int = 10) -> list[tuple[int, int, int]]:
    """(fold, train rows, test end): expanding prefixes and disjoint test blocks over ``total`` ordered rows."""
    first = max(first_min, total // 2)
    step = max((total - first) // folds, test_min)
    out = []
    for i, start in enumerate(range(first, total, step)):
        end = min(start + step, total)
        if start >= first_min and end - start >= test_min:
            out.append((i, start, end))
    return out


def numbered(rows: DataFrame, tenant: str, bucket: Column, *order: str) -> DataFrame:
    """``rows`` with ``rn``: their number inside the tenant in the order of (bucket, order), from 1.

    Rows are numbered inside a bucket and the buckets before are added, so a large tenant is spread over its buckets;
    ``bucket`` is a coarse form of the first order column, such as the day of a time.
    """
    parted = rows.withColumn("__b", bucket)
    before = Window.partitionBy(tenant).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    sizes = parted.groupBy(tenant, "__b").agg(F.count(F.lit(1)).alias("__n")).select(F.col(tenant).alias("__t"), F.col("__b").alias("__c"), F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    inside = parted.withColumn("__r", F.row_number().over(Window.partitionBy(tenant, "__b").orderBy(*order)))
    met = inside.join(sizes, F.col(tenant).eqNullSafe(F.col("__t")) & F.col("__b").eqNullSafe(F.col("__c")))
    return met.withColumn("rn", F.col("__r") + F.col("__before")).drop("__b", "__r", "__t", "__c", "__before")


def fold_bounds(numbered_rows: DataFrame, tenant: str, folds: int = 4, train_min: int = 20, test_min: int = 10) -> DataFrame:
    """(tenant, n, fold, lo, hi): the first ``lo`` rows train, the next up to ``hi`` test; blocks under ``test_min`` are left out."""
    sizes = numbered_rows.groupBy(tenant).agg(F.max("rn").cast("long").alias("n"))
    first = F.greatest(F.lit(train_min), F.expr("n div 2"))
    step = F.greatest(F.call_function("div", F.col("n") - first, F.lit(folds)), F.lit(test_min))
    each = sizes.withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(folds))))
    return each.withColumn("lo", first + F.col("fold") * step).withColumn("hi", F.least(first + (F.col("fold") + 1) * step, F.col("n"))).where(F.col("hi") - F.col("lo") >= test_min)


def backtest_predictions(rows: DataFrame, tenant: str, segment: str, base: str, actual: str) -> DataFrame:
    """Test rows of every fold with ``calibrated`` and ``clamped``, from numbered rows (tenant, rn, segment, base, actual).

    Each fold fits shrunken segment medians of log(actual / base) on the rows before it; the factor is clamped as in
    production, by the fold's training rows, and not rounded.
    """
    rows = cut(rows)
    bounds = cut(fold_bounds(rows, tenant))
    joined = rows.withColumn("__v", F.ln(F.col(actual) / F.col(base))).join(bounds, tenant).where("rn <= hi")
    train = joined.where("rn <= lo")
    whole = cut(exact_quantiles(train, [tenant, "fold"], {"__all": (F.col("__v"), 0.5)}))
    parts = cut(with_quantiles(train, [tenant, "fold", segment], [F.count(F.lit(1)).alias("__n")], {"__seg": (F.col("__v"), 0.5)}))
    test = joined.where("rn > lo").join(whole, [tenant, "fold"]).join(parts, [tenant, "fold", segment], "left")
    ratio = F.coalesce((F.col("__n") * F.col("__seg") + 10.0 * F.col("__all")) / (F.col("__n") + 10.0), F.col("__all"))
    cap = clamp_cap(F.col("lo"))
    step = test.withColumns({"__raw": F.exp(ratio), "__cap": cap})
    factor = F.least(F.greatest(F.col("__raw"), 1 - F.col("__cap")), 1 + F.col("__cap"))
    return step.withColumns({"calibrated": F.col(base) * factor, "clamped": F.abs(factor - F.col("__raw")) > 1e-9}).drop("__v", "__all", "__seg", "__n", "__raw", "__cap")


def both_arms(tested: DataFrame, tenant: str, base: str, actual: str) -> DataFrame:
    """Per tenant: tests, folds, both median absolute percent errors, the improvement in percent, the share of clamped predictions."""
    ape = lambda p: F.abs(F.col(actual) - F.col(p)) / F.col(p) * 100
    plain = [F.count(F.lit(1)).alias("n_test"), F.count_distinct("fold").alias("n_folds"), F.avg(F.col("clamped").cast("double")).alias("k")]
    out = with_quantiles(cut(tested), [tenant], plain, {"b": (ape(base), 0.5), "c": (ape("calibrated"), 0.5)})
    gain = F.when(F.col("b") > 0, (F.col("b") - F.col("c")) / F.col("b") * 100).otherwise(0.0)
    return out.select(tenant, "n_test", "n_folds", F.round("b", 2).alias("baseline_ape_pct"), F.round("c", 2).alias("calibrated_ape_pct"), F.round(gain, 2).alias("improvement_pct"), F.round(F.col("k") * 100, 1).alias("clamp_rate_pct"))


def resampled_interval(gaps: np.ndarray, side: np.ndarray, corner: np.ndarray, iterations: int = 2000, seed: int = 12345, times: np.ndarray | None = None) -> tuple[float, float] | None:
    """The middle 95 percent of the improvement of the median over resampled pairs; null under ten pairs.

    ``gaps``: (m, 2), both errors of the rows near either median; ``side``: (m, 2), -1, 0 or 1 as each error lies below,
    in or above its bracket; ``times``: how often each of them stands (once by default); ``corner``: (2, 2), how many other
    rows lie below or above both brackets.  A resample of all n rows deals n draws over the m rows and the four corners, so it has the distribution of a resample of the rows.
    """
    times = np.ones(len(gaps), np.int64) if times is None else times
    m, n = len(gaps), int(times.sum()) + int(corner.sum())
    if n < 10:
        return None
    share = np.append(times / n, corner.ravel() / n)
    middles = ((n - 1) // 2, n // 2)
    order = [np.flatnonzero(side[:, k] == 0)[np.argsort(gaps[side[:, k] == 0, k], kind="stable")] for k in (0, 1)]
    rng, found = np.random.default_rng(seed), []
    at_once = max(1, 4_000_000 // len(share))
    for done in range(0, iterations, at_once):
        drawn = rng.multinomial(n, share, min(at_once, iterations - done))
        medians = []
        for k in (0, 1):
            below = drawn[:, :m][:, side[:, k] < 0].sum(axis=1) + (drawn[:, m : m + 2].sum(axis=1) if k == 0 else drawn[:, m] + drawn[:, m + 2])
            reached = below[:, None] + np.cumsum(drawn[:, order[k]], axis=1)
            values = gaps[order[k], k]
            medians.append(sum(values[np.minimum((reached <= r).sum(axis=1), len(values) - 1)] for r in middles) / 2)
        b, c = medians
        found.append(np.where(b > 0, (b - c) / np.where(b > 0, b, 1) * 100, 0.0))
    ordered = np.sort(np.concatenate(found))
    return round(float(ordered[int(0.025 * iterations)]), 2), round(float(ordered[int(0.975 * iterations) - 1]), 2)


#: Half the width of the bracket around a median's rank, in square roots of the rows: 6.5 standard deviations of a resample's.
SPREAD = 3.25


def intervals(tested: DataFrame, tenant: str, base: str, actual: str, iterations: int = 2000, seed: int = 12345, limit: int = 20_000) -> DataFrame:
    """(tenant, n, ci_low_pct, ci_high_pct, significant): the bootstrap interval of the improvement of the median error.

    A resample's median moves by a few square roots of n ranks, so only the rows in a bracket of that width around
    either median meet in a task (about 13 square roots of n); all others are counted by the side on which they lie.  A median
    beyond the bracket has a chance of under 1e-9 and counts as its end.
    """
    ape = lambda p: F.abs(F.col(actual) - F.col(p)) / F.col(p) * 100
    rows = cut(tested.where(F.col(base) > 0).select(F.struct(F.col(tenant)).alias("__g"), "rn", ape(base).alias("g0"), ape("calibrated").alias("g1")))
    sizes = rows.groupBy("__g").agg(F.count(F.lit(1)).alias("n"))
    wide = F.ceil(SPREAD * F.sqrt("n")) + 2
    want = sizes.select("__g", F.explode(F.array(F.lit(0), F.lit(1))).alias("__w"), "n", F.greatest(F.floor(F.col("n") / 2) - wide, F.lit(0)).cast("long").alias("r1"), F.least(F.floor(F.col("n") / 2) + wide, F.col("n") - 1).cast("long").alias("r2"))
    long = rows.select("__g", F.inline(F.array(F.struct(F.lit(0).alias("__w"), F.col("g0").alias("__v")), F.struct(F.lit(1).alias("__w"), F.col("g1").alias("__v")))))
    ends = select_ranks(long, want, limit)
    brackets = cut(ends.groupBy("__g").agg(*[F.max(F.when(F.col("__w") == k, F.col(v))).alias(f"{side}{k}") for k in (0, 1) for v, side in (("v1", "low"), ("v2", "high"))]))
    side = lambda k: F.when(F.col(f"g{k}") < F.col(f"low{k}"), -1).when(F.col(f"g{k}") > F.col(f"high{k}"), 1).otherwise(0)
    placed = rows.join(brackets, "__g").select("__g", "rn", "g0", "g1", side(0).alias("s0"), side(1).alias("s1"))
    # Rows that tie with others in both errors and sides are one row with a count.
    near = placed.where("s0 = 0 OR s1 = 0").groupBy("__g", "g0", "g1", "s0", "s1").agg(F.count(F.lit(1)).alias("times"))
    far = placed.where("s0 <> 0 AND s1 <> 0").groupBy("__g", "s0", "s1").agg(F.count(F.lit(1)).alias("times")).select("__g", F.lit(None).cast("double").alias("g0"), F.lit(None).cast("double").alias("g1"), "s0", "s1", "times")

    def one(_key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        inner = part[part.g0.notna()].sort_values(["g0", "g1"])
        corner = np.zeros((2, 2), np.int64)
        for r in part[part.g0.isna()].itertuples():
            corner[int(r.s0 > 0), int(r.s1 > 0)] = r.times
        ci = resampled_interval(inner[["g0", "g1"]].to_numpy(), inner[["s0", "s1"]].to_numpy(), corner, iterations, seed, inner.times.to_numpy())
        low, high = ci or (None, None)
        return pd.DataFrame({"__t": part["__t"].iloc[:1].to_list(), "n": [int(part.times.sum())], "ci_low_pct": [low], "ci_high_pct": [high], "significant": [low is not None and low > 0]})

    kind = tested.schema[tenant].dataType.simpleString()
    met = near.unionByName(far).select(F.col(f"__g.`{tenant}`").alias("__t"), "g0", "g1", "s0", "s1", "times")
    found = met.groupBy("__t").applyInPandas(one, f"__t {kind}, n long, ci_low_pct double, ci_high_pct double, significant boolean")
    return found.withColumnRenamed("__t", tenant)


def set_fingerprint(rows: DataFrame, *fields: Column) -> DataFrame:
    """One row: a digest of the rows whatever their order; sums of two parts of each row's SHA-256, so nothing is gathered."""
    h = F.sha2(F.concat_ws(":", *fields), 256)
    part = lambda at: F.sum(F.conv(F.substring(h, at, 15), 16, 10).cast("decimal(20,0)"))
    sums = rows.agg(F.count(F.lit(1)).alias("n"), part(1).alias("a"), part(16).alias("b"))
    return sums.select("n", F.sha2(F.concat_ws(":", "n", F.coalesce("a", F.lit(0)).cast("string"), F.coalesce("b", F.lit(0)).cast("string")), 256).alias("fingerprint"))


def shadow_summary(traces: DataFrame, tenant: str) -> DataFrame:
    """Per tenant of traces (reason, clamped, applied, factor): counts, clamp rate and upper median factor of adjusted ones."""
    adjusted = F.col("reason").isNull()
    plain = [F.count(F.lit(1)).alias("recorded"), F.count_if(adjusted).alias("adjusted"), F.count_if("applied").alias("applied"), F.count_if(adjusted & F.col("clamped")).alias("clamped")]
    out = with_quantiles(traces, [tenant], plain, {"m": (F.when(adjusted, F.col("factor")), upper_middle())})
    return out.select(tenant, "recorded", "adjusted", "applied", "clamped", F.round(F.try_divide(F.col("clamped") * 100, F.col("adjusted")), 1).alias("clamp_rate_pct"), F.round("m", 4).alias("median_factor"))


def chosen_model(companies: DataFrame, models: DataFrame) -> DataFrame:
    """(company, mode, version, applies): the active model, or in shadow mode the newest shadow one; none in mode off."""
    best = models.groupBy("company").agg(F.max(F.when(F.col("status") == "active", F.col("version"))).alias("__a"), F.max(F.when(F.col("status") == "shadow", F.col("version"))).alias("__s"))
    both = companies.join(best, "company", "left")
    version = F.when(F.col("mode") == "off", None).otherwise(F.coalesce("__a", F.when(F.col("mode") == "shadow", F.col("__s"))))
    return both.select("company", "mode", version.alias("version"), ((F.col("mode") == "active") & F.col("__a").isNotNull()).alias("applies"))


def permuted(rows: DataFrame, tenant: str, key: str, value: str, seed: int = 99) -> DataFrame:
    """``rows`` (tenant, key, value) with ``permuted``: the values of each tenant dealt to its keys anew, by a hash of seed and key."""
    shuffle = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")))
    x = rows.select(tenant, key, value)
    own = x.withColumn("__r", F.row_number().over(Window.partitionBy(tenant).orderBy(key)))
    dealt = x.select(tenant, F.row_number().over(Window.partitionBy(tenant).orderBy(shuffle, key)).alias("__r"), F.col(value).alias("permuted"))
    return own.join(dealt, [tenant, "__r"]).drop("__r")
