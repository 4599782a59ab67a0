"""Corrections as stored models: the training set from our own baseline, fitted parameters as versioned rows, predictions from stored rows.

A company's model is one row: parameters and metrics as JSON, the window and a fingerprint of its training rows.  Versions are
given when a commit is published, so of two writers one wins and the other takes the next number.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cartage.functions.staging import cut
from cartage.operators import lifecycle, stats
from cartage.operators.pricing import TEN_THOUSANDTHS, PricingConfig, cents, div, dollar_cents, exclusion_reason, lookup, units
from cartage.operators.quantiles import with_quantiles
from cartage.sources import commits

# Least support of a company and of a segment, strength of the pull to the company's median.
MIN_COMPANY, MIN_SEGMENT, SHRINKAGE = 20, 8, 10.0
PARAMS = "global_log_ratio double, n_train long, shrinkage_k double, segments map<string, struct<log_ratio: double, raw_log_ratio: double, n: long>>"


def side_defaults(floor: Column, flights: Column, elevator: Column) -> dict[str, Column]:
    """What a sparse record says about one end of a move: the ground floor, no stairs and no elevator where nothing is known."""
    return {"floor": F.greatest(F.coalesce(floor, F.lit(1)), F.lit(1)), "flights": F.greatest(F.coalesce(flights, F.lit(0)), F.lit(0)), "elevator": F.coalesce(elevator, F.lit(False))}


def training_rows(jobs: DataFrame, estimate: str, actual: str, miles: Column, floor: Column, flights: Column) -> DataFrame:
    """``jobs`` (with our estimate, a struct) with ``reason`` (null where a job can train), base_hours, base_total_cents and log_ratio."""
    base = F.col(f"{estimate}.estimated_hours")
    reason = exclusion_reason(F.col(actual), miles, floor, flights, base)
    return jobs.withColumns({"reason": reason, "base_hours": base, "base_total_cents": F.col(f"{estimate}.total_cents"), "log_ratio": F.when(reason.isNull(), F.ln(F.col(actual) / base))})


def fit(rows: DataFrame, tenant: str, segment: str, job: str, day: str, actual: str) -> DataFrame:
    """One row a tenant: algorithm, params, metrics, n_train, window_start, window_end, fingerprint.  ``rows`` are those of ``training_rows``."""
    rows = cut(rows)
    good = rows.where("reason IS NULL")
    whole = with_quantiles(good, [tenant], [F.count(F.lit(1)).alias("n_train"), F.min(day).alias("window_start"), F.max(day).alias("window_end")], {"all": (F.col("log_ratio"), 0.5)})
    parts = with_quantiles(good, [tenant, segment], [F.count(F.lit(1)).alias("n")], {"raw": (F.col("log_ratio"), 0.5)})
    shrunk = ((F.col("n") * F.col("raw") + SHRINKAGE * F.col("all")) / (F.col("n") + SHRINKAGE)).alias("log_ratio")
    pulled = parts.join(whole.select(tenant, "all"), tenant).select(tenant, segment, F.struct(shrunk, F.col("raw").alias("raw_log_ratio"), "n").alias("s"))
    listed = pulled.groupBy(tenant).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col(segment), "s")))).alias("segments"))  # a few segments a tenant
    numbered = stats.numbered(good.select(tenant, segment, F.col(day).alias("__day"), F.col(job).alias("__job"), F.col("base_hours").alias("__base"), F.col(actual).alias("__actual")), tenant, F.to_date("__day"), "__day", "__job")
    tested = stats.both_arms(stats.backtest_predictions(numbered, tenant, segment, "__base", "__actual"), tenant, "__base", "__actual")
    reasons = rows.groupBy(tenant, F.coalesce("reason", F.lit("eligible")).alias("r")).agg(F.count(F.lit(1)).alias("n")).groupBy(tenant).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("r", "n")))).alias("considered"))
    prints = fingerprints(good, tenant, F.col(job).cast("string"), F.round(F.col(actual), 4).cast("string"), F.round("base_hours", 4).cast("string"))
    out = whole.join(listed, tenant).join(reasons, tenant).join(prints, tenant).join(tested, tenant, "left")
    params = F.struct(F.col("all").alias("global_log_ratio"), "n_train", F.lit(SHRINKAGE).alias("shrinkage_k"), "segments")
    backtest = F.struct(*[F.col(c) for c in tested.columns if c != tenant])
    return out.select(tenant, F.lit("segmented_home_size").alias("algorithm"), F.to_json(params).alias("params"), F.to_json(F.struct(backtest.alias("backtest"), "considered")).alias("metrics"), "n_train", "window_start", "window_end", "fingerprint")


def fingerprints(rows: DataFrame, tenant: str, *fields: Column) -> DataFrame:
    """(tenant, fingerprint): a digest of each tenant's rows whatever their order."""
    h = F.sha2(F.concat_ws(":", *fields), 256)
    part = lambda at: F.sum(F.conv(F.substring(h, at, 15), 16, 10).cast("decimal(20,0)")).cast("string")
    sums = rows.groupBy(tenant).agg(F.count(F.lit(1)).alias("n"), part(1).alias("a"), part(16).alias("b"))
    return sums.select(tenant, F.sha2(F.concat_ws(":", "n", "a", "b"), 256).alias("fingerprint"))


def store(spark: SparkSession, root: str, fitted: DataFrame, tenant: str, tries: int = 20) -> str:
    """Publish fitted models as the next versions of their tenants, in status shadow; returns the commit's name."""
    fitted = cut(fitted)
    for _ in range(tries):
        known = commits.read(spark, root, "models")
        number = 1 if known is None else 1 + int(commits.last(spark, root, "models").rpartition("-")[2])
        before = spark.createDataFrame([], f"{tenant} {fitted.schema[tenant].dataType.simpleString()}, __v int") if known is None else known.groupBy(tenant).agg(F.max("version").alias("__v"))
        rows = fitted.join(before, tenant, "left").withColumn("version", F.coalesce("__v", F.lit(0)) + 1).drop("__v").withColumn("status", F.lit("shadow"))
        name = f"models-{number:09d}"
        if commits.publish(spark, root, name, {"models": rows}):
            return name
    raise RuntimeError("other writers were always faster")


def promote(spark: SparkSession, root: str, tenant: str, chosen: DataFrame, tries: int = 20) -> str:
    """Make the chosen (tenant, version) active and what was active retired, in one commit."""
    for _ in range(tries):
        name = f"models-{1 + int(commits.last(spark, root, 'models').rpartition('-')[2]):09d}"
        if commits.rewrite(spark, root, name, {"models": (F.lit(True), lambda df: lifecycle.promote(df, tenant, "version", chosen))}):
            return name
    raise RuntimeError("other writers were always faster")


def listed(models: DataFrame, tenant: str) -> DataFrame:
    """All versions, newest first inside a tenant."""
    return models.orderBy(tenant, F.desc("version"))


def active(models: DataFrame, tenant: str) -> DataFrame:
    """(tenant, version, model): the parameters of active models, read back from their JSON."""
    return models.where("status = 'active'").select(tenant, "version", F.from_json("params", PARAMS).alias("model"))


def predicted(rows: DataFrame, models: DataFrame, tenant: str, segment: str, base: Column) -> DataFrame:
    """``rows`` with struct ``c``: factor, raw_factor, clamped, support, segment, reason (null where a correction applies).

    Reasons in order: no_model, insufficient_history, unusable_base, model_error, insufficient_support; with one the factor is 1.
    """
    met = rows.join(models, tenant, "left")
    own = F.try_element_at("model.segments", F.col(segment))
    enough = F.coalesce(own["n"] >= MIN_SEGMENT, F.lit(False))
    ratio = F.when(enough, own["log_ratio"]).otherwise(F.col("model.global_log_ratio"))
    support = F.when(enough, own["n"]).otherwise(F.col("model.n_train"))
    cap, n = stats.clamp_cap(F.col("model.n_train")), F.col("model.n_train")
    raw = F.exp(ratio)
    reason = (
        F.when(F.col("version").isNull(), "no_model").when(F.coalesce(n, F.lit(0)) < MIN_COMPANY, "insufficient_history").when(base.isNull() | (base <= 0), "unusable_base")
        .when(raw.isNull(), "model_error").when(support < MIN_COMPANY, "insufficient_support")
    )
    factor = F.when(reason.isNull(), F.least(F.greatest(raw, 1 - cap), 1 + cap)).otherwise(F.lit(1.0))
    out = F.struct(factor.alias("factor"), F.when(reason.isNull(), raw).otherwise(F.lit(1.0)).alias("raw_factor"), (reason.isNull() & (F.abs(factor - raw) > 1e-9)).alias("clamped"), F.when(reason.isNull() | (reason == "insufficient_support"), support).otherwise(F.lit(0)).alias("support"), F.when(reason.isNull(), F.when(enough, F.col(segment)).otherwise("all")).alias("segment"), reason.alias("reason"))
    return met.withColumn("c", out).drop("model")


def rebuilt(rows: DataFrame, estimate: str, correction: str, cfg: PricingConfig | None = None) -> DataFrame:
    """``rows`` with struct ``calibrated``: the estimate at the corrected hours, its travel, date multiplier and spread kept.

    Hours are scaled, rounded up to the half hour and at least the minimum; labour is charged at the crew's rate.  A correction
    with a reason leaves the estimate as it is.
    """
    cfg = cfg or PricingConfig()
    e = lambda n: F.col(f"{estimate}.{n}")
    halves = F.greatest(F.ceil(F.round(e("estimated_hours") * F.col(f"{correction}.factor") * 2, 9)).cast("long"), F.lit(units(cfg.min_hours, 2)).cast("long"))
    travel = F.element_at(F.filter(e("line_items"), lambda x: x["code"] == "travel"), 1)["amount_cents"]
    step = rows.withColumns({"__halves": halves, "__travel": travel * (TEN_THOUSANDTHS // 100), "__factor": F.round(e("adjustment_multiplier") * 1_000_000).cast("long")})
    labour = div(F.col("__halves") * lookup(cfg.rate, e("crew_size")), 2)
    step = step.withColumn("__labour", labour).withColumn("__total", (F.col("__labour") + F.col("__travel")) * F.col("__factor"))
    low, high = (F.col("__total") * units(1 + sign * cfg.spread, 100) for sign in (-1, 1))
    item = lambda code, amount: F.struct(F.lit(code).alias("code"), amount.alias("amount_cents"))
    gap = F.col("__total") - (F.col("__labour") + F.col("__travel")) * 1_000_000
    lines = F.array_compact(F.array(item("labor", cents(F.col("__labour"), TEN_THOUSANDTHS)), item("travel", cents(F.col("__travel"), TEN_THOUSANDTHS)), F.when(F.col("__factor") != 1_000_000, item("date_adjustment", cents(gap, 10**10)))))
    new = F.struct(
        e("crew_size").alias("crew_size"), (F.col("__halves") / 2).alias("estimated_hours"), lines.alias("line_items"), cents(F.col("__labour") + F.col("__travel"), TEN_THOUSANDTHS).alias("subtotal_cents"), e("adjustment_multiplier").alias("adjustment_multiplier"),
        cents(F.col("__total"), 10**10).alias("total_cents"), dollar_cents(low, 10**12).alias("amount_min_cents"), dollar_cents(high, 10**12).alias("amount_max_cents"),
    )
    out = F.when(F.col(f"{correction}.reason").isNull(), new).otherwise(F.col(estimate))
    return step.withColumn("calibrated", out).drop("__halves", "__travel", "__factor", "__labour", "__total")


def traces(rows: DataFrame, quote: str, tenant: str) -> DataFrame:
    """What is recorded of each quote's correction, whether it applied or why not; never an error."""
    return rows.select(F.col(quote), F.col(tenant), "version", "c.factor", "c.raw_factor", "c.clamped", "c.support", "c.segment", "c.reason", F.col("c.reason").isNull().alias("applied"))

