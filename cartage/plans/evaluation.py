"""Queries of model evaluation: backtests of the fitted segments on both arms, intervals, fingerprints, shadow summaries, choice of a model."""

from __future__ import annotations

from pyspark.sql import functions as F

from cartage.functions.staging import cut, shared_folder
from cartage.operators import registry, similarity, stats
from cartage.plans.queries import ORACLE, _priced, query, t
from cartage.sources import commits

MOVES = """SELECT c_nationkey AS company_id, o_orderkey, o_orderdate, o_orderpriority AS segment, (o_custkey % 40 + 10)::DOUBLE AS base, (o_custkey % 40 + 10) * (0.7 + (o_orderkey % 13) / 20.0 + (o_orderpriority[1]::INT) / 20.0) AS actual FROM orders JOIN customer ON o_custkey = c_custkey"""


def moves(spark, d):
    """Orders as moves of a company: a size segment, our engine's hours and the actual ones."""
    o = t(spark, d, "orders").join(t(spark, d, "customer").select("c_custkey", F.col("c_nationkey").alias("company_id")), F.col("o_custkey") == F.col("c_custkey"))
    base = (F.col("o_custkey") % 40 + 10).cast("double")
    share = F.lit(0.7) + (F.col("o_orderkey") % 13) / 20 + F.substring("o_orderpriority", 1, 1).cast("int") / 20
    return o.select("company_id", "o_orderkey", "o_orderdate", F.col("o_orderpriority").alias("segment"), base.alias("base"), (base * share).alias("actual"))


def _tested(spark, d, rows):
    x = stats.numbered(rows, "company_id", F.to_date("o_orderdate"), "o_orderdate", "o_orderkey")
    return stats.backtest_predictions(x, "company_id", "segment", "base", "actual")


def _sql(moves_sql: str) -> str:
    return f"""WITH x AS (SELECT *, ln(actual / base) AS v, row_number() OVER (PARTITION BY company_id ORDER BY o_orderdate, o_orderkey) AS rn, count(*) OVER (PARTITION BY company_id) AS n FROM ({moves_sql})),
f AS (SELECT company_id, greatest(20, n // 2) AS first, greatest((n - greatest(20, n // 2)) // 4, 10) AS step, n FROM x GROUP BY company_id, n),
k AS (SELECT company_id, i AS fold, first + i * step AS lo, least(first + (i + 1) * step, n) AS hi FROM f, range(0, 5) r(i) WHERE least(first + (i + 1) * step, n) - (first + i * step) >= 10),
g AS (SELECT k.company_id, fold, median(v) AS m_all FROM k JOIN x ON x.company_id = k.company_id AND rn <= lo GROUP BY ALL), s AS (SELECT k.company_id, fold, segment, median(v) AS m_seg, count(*) AS c FROM k JOIN x ON x.company_id = k.company_id AND rn <= lo GROUP BY ALL),
p AS (SELECT k.company_id, k.fold, base, actual, exp(coalesce((c * m_seg + 10.0 * m_all) / (c + 10.0), m_all)) AS raw, CASE WHEN lo >= 200 THEN 0.2 WHEN lo >= 50 THEN 0.15 WHEN lo >= 20 THEN 0.1 ELSE 0.0 END::DOUBLE AS cap
  FROM k JOIN x ON x.company_id = k.company_id AND rn > lo AND rn <= hi JOIN g ON g.company_id = k.company_id AND g.fold = k.fold LEFT JOIN s ON s.company_id = k.company_id AND s.fold = k.fold AND s.segment = x.segment),
r AS (SELECT *, base * least(greatest(raw, 1 - cap), 1 + cap) AS cal, abs(least(greatest(raw, 1 - cap), 1 + cap) - raw) > 1e-9 AS clamped FROM p),
a AS (SELECT company_id, count(*) AS n_test, count(DISTINCT fold) AS n_folds, median(abs(actual - base) / base * 100) AS b, median(abs(actual - cal) / cal * 100) AS c, avg(clamped::INT) AS k FROM r GROUP BY 1)
SELECT company_id, n_test, n_folds, round(b, 2) AS baseline_ape_pct, round(c, 2) AS calibrated_ape_pct, round((b - c) / b * 100, 2) AS improvement_pct, round(k * 100, 1) AS clamp_rate_pct FROM a"""


@query(_sql(MOVES))
def segment_backtest(spark, d):
    return stats.both_arms(_tested(spark, d, moves(spark, d)), "company_id", "base", "actual")


PERMUTED = f"""SELECT a.company_id, a.o_orderkey, o_orderdate, segment, base, permuted AS actual FROM (SELECT *, row_number() OVER (PARTITION BY company_id ORDER BY o_orderkey) AS r FROM ({MOVES})) a
JOIN (SELECT company_id, actual AS permuted, row_number() OVER (PARTITION BY company_id ORDER BY md5('99:' || o_orderkey::VARCHAR), o_orderkey) AS r FROM ({MOVES})) b USING (company_id, r)"""


@query(_sql(PERMUTED))
def permuted_backtest(spark, d):
    """The control: the same backtest with every company's actual hours dealt anew must show no improvement."""
    m = moves(spark, d)
    dealt = stats.permuted(m.select("company_id", "o_orderkey", "actual"), "company_id", "o_orderkey", "actual")
    rows = m.drop("actual").join(dealt.select(F.col("o_orderkey"), F.col("permuted").alias("actual")), "o_orderkey")
    return stats.both_arms(_tested(spark, d, rows), "company_id", "base", "actual")


@query()
def improvement_interval(spark, d):
    return stats.intervals(_tested(spark, d, moves(spark, d)), "company_id", "base", "actual")


@query(f"""WITH r AS (SELECT sha256(o_orderkey::VARCHAR || ':' || round(actual, 4)::VARCHAR || ':' || round(base, 4)::VARCHAR) AS h FROM ({MOVES}))
SELECT count(*) AS n, sha256(count(*)::VARCHAR || ':' || sum(('0x' || h[1:15])::HUGEINT)::VARCHAR || ':' || sum(('0x' || h[16:30])::HUGEINT)::VARCHAR) AS fingerprint FROM r""")
def dataset_fingerprint(spark, d):
    x = moves(spark, d)
    return stats.set_fingerprint(x, F.col("o_orderkey").cast("string"), F.round("actual", 4).cast("string"), F.round("base", 4).cast("string"))


TRACES = f"""SELECT company_id, CASE WHEN o_orderkey % 10 = 0 THEN 'no_model' WHEN o_orderkey % 10 = 1 THEN 'insufficient_support' END AS reason, actual / base AS raw, o_orderkey % 2 = 0 AS applied FROM ({MOVES})"""


@query(f"""WITH x AS (SELECT *, least(greatest(raw, 0.8), 1.2) AS factor FROM ({TRACES})) SELECT company_id, count(*) AS recorded, count(*) FILTER (reason IS NULL) AS adjusted, count(*) FILTER (applied) AS applied, count(*) FILTER (reason IS NULL AND abs(raw - factor) > 1e-9) AS clamped,
round(count(*) FILTER (reason IS NULL AND abs(raw - factor) > 1e-9) * 100 / count(*) FILTER (reason IS NULL), 1) AS clamp_rate_pct, round(list_sort(list(factor) FILTER (reason IS NULL))[(count(*) FILTER (reason IS NULL) // 2 + 1)::BIGINT], 4) AS median_factor FROM x GROUP BY 1""")
def shadow_summary(spark, d):
    k, raw = F.col("o_orderkey"), F.col("actual") / F.col("base")
    factor = F.least(F.greatest(raw, F.lit(0.8)), F.lit(1.2))
    traces = moves(spark, d).select("company_id", F.when(k % 10 == 0, "no_model").when(k % 10 == 1, "insufficient_support").alias("reason"), factor.alias("factor"), (F.abs(raw - factor) > 1e-9).alias("clamped"), (k % 2 == 0).alias("applied"))
    return stats.shadow_summary(traces, "company_id")


@query("""WITH m AS (SELECT n_regionkey AS company, n_nationkey AS version, CASE n_nationkey % 4 WHEN 0 THEN 'active' WHEN 1 THEN 'retired' ELSE 'shadow' END AS status FROM nation WHERE n_nationkey % 4 <> 0 OR n_regionkey < 3), c AS (SELECT r_regionkey AS company, ['off', 'shadow', 'active'][r_regionkey % 3 + 1] AS mode FROM region),
b AS (SELECT company, max(version) FILTER (status = 'active') AS a, max(version) FILTER (status = 'shadow') AS s FROM m GROUP BY 1)
SELECT company, mode, CASE WHEN mode <> 'off' THEN coalesce(a, CASE WHEN mode = 'shadow' THEN s END) END AS version, mode = 'active' AND a IS NOT NULL AS applies FROM c LEFT JOIN b USING (company)""")
def model_choice(spark, d):
    m = t(spark, d, "nation").where("n_nationkey % 4 <> 0 OR n_regionkey < 3").select(F.col("n_regionkey").alias("company"), F.col("n_nationkey").alias("version"), F.when(F.col("n_nationkey") % 4 == 0, "active").when(F.col("n_nationkey") % 4 == 1, "retired").otherwise("shadow").alias("status"))
    mode = F.element_at(F.array(F.lit("off"), F.lit("shadow"), F.lit("active")), F.col("r_regionkey") % 3 + 1)
    return stats.chosen_model(t(spark, d, "region").select(F.col("r_regionkey").alias("company"), mode.alias("mode")), m)


# Orders as historical moves: our engine's baseline is made anew for each, whatever their old system had estimated.
JOBS = ORACLE["price_kernel"].replace("FROM lineitem JOIN orders ON l_orderkey = o_orderkey", "FROM (SELECT o_orderkey AS l_orderkey, (o_custkey % 7 + 1)::INT AS l_linenumber, (o_custkey % 50 + 1)::DOUBLE AS l_quantity, o_custkey AS l_partkey, o_orderdate FROM orders)").rpartition("\nSELECT l_orderkey")[0]
TRAINING = JOBS + """, w AS (SELECT p.*, o_orderkey, o_custkey, o_orderdate, c_nationkey AS company_id, CASE WHEN o_orderkey % 17 <> 0 THEN hours::DOUBLE * (0.75 + (o_orderkey % 9) / 20.0 + l_linenumber / 20.0) * CASE WHEN o_orderkey % 23 = 0 THEN 6 ELSE 1 END END AS actual,
  CASE WHEN o_custkey % 13 <> 0 THEN miles END AS known_miles, CASE WHEN o_orderkey % 19 <> 0 THEN floor END AS known_floor FROM p JOIN orders ON o_orderkey = l_orderkey JOIN customer ON o_custkey = c_custkey),
tr AS (SELECT *, CASE WHEN actual IS NULL THEN 'no_actual_hours' WHEN actual < 0.5 OR actual > 48 THEN 'implausible_hours' WHEN known_miles IS NULL THEN 'no_distance' WHEN known_floor IS NULL THEN 'no_access' WHEN hours <= 0 THEN 'unpriceable' WHEN actual / hours::DOUBLE < 0.25 OR actual / hours::DOUBLE > 4 THEN 'implausible_ratio' END AS reason, ln(actual / hours::DOUBLE) AS v FROM w)"""


def _training(spark, d):
    c = t(spark, d, "customer").select("c_custkey", F.col("c_nationkey").alias("company_id"))
    o = t(spark, d, "orders").join(c, F.col("o_custkey") == F.col("c_custkey"))
    k, n = F.col("o_orderkey"), F.col("o_custkey")
    jobs = o.select("company_id", k, n, "o_orderdate", k.alias("l_orderkey"), (n % 7 + 1).cast("int").alias("l_linenumber"), (n % 50 + 1).cast("double").alias("l_quantity"), n.alias("l_partkey"), F.to_date("o_orderdate").alias("day"))
    size = F.element_at(F.array(*map(F.lit, similarity.HOME_SIZES)), F.least(F.col("l_linenumber"), F.lit(6)))
    priced = _priced(jobs, "p").withColumn("home_size", size)
    share = F.lit(0.75) + (k % 9) / 20 + F.col("l_linenumber") / 20
    hours = F.when(k % 17 != 0, F.col("p.estimated_hours") * share * F.when(k % 23 == 0, 6).otherwise(1))
    whole = F.col("l_quantity").cast("int")
    return registry.training_rows(priced.withColumn("actual", hours), "p", "actual", F.when(n % 13 != 0, F.col("l_quantity")), F.when(k % 19 != 0, whole % 6), F.lit(None).cast("int"))


@query(TRAINING + " SELECT o_orderkey, company_id, hours::DOUBLE AS base_hours, round(v, 9) AS log_ratio FROM tr WHERE reason IS NULL")
def training_set(spark, d):
    """The first output of a training set: eligible moves with our baseline and the log of actual over it."""
    return _training(spark, d).where("reason IS NULL").select("o_orderkey", "company_id", "base_hours", F.round("log_ratio", 9).alias("log_ratio"))


@query(TRAINING + " SELECT company_id, coalesce(reason, 'eligible') AS reason, count(*) AS n FROM tr GROUP BY ALL")
def training_exclusions(spark, d):
    """The second output: how many moves of each company cannot train, and why."""
    return _training(spark, d).groupBy("company_id", F.coalesce("reason", F.lit("eligible")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def _models(spark, d, training):
    """A store where every company has a model; companies of even number have a second one, of the years from 1995 on, which is made active."""
    root = shared_folder(spark, "models")
    fit = lambda rows: registry.fit(rows, "company_id", "home_size", "o_orderkey", "o_orderdate", "actual")
    registry.store(spark, root, fit(training), "company_id")
    registry.store(spark, root, fit(training.where("company_id % 2 = 0 AND o_orderdate >= TIMESTAMP_NTZ'1995-01-01 00:00:00'")), "company_id")
    chosen = commits.read(spark, root, "models").groupBy("company_id").agg(F.max("version").alias("version")).where("company_id % 5 <> 0")
    registry.promote(spark, root, "company_id", chosen)
    return commits.read(spark, root, "models")


FITTED = TRAINING + """, good AS (SELECT *, ['studio', '1br', '2br', '3br', '4br', '5br_plus'][least(l_linenumber, 6)] AS home_size FROM tr WHERE reason IS NULL),
src AS (SELECT 1 AS version, * FROM good UNION ALL SELECT 2, * FROM good WHERE company_id % 2 = 0 AND o_orderdate >= TIMESTAMP '1995-01-01'),
mo AS (SELECT company_id, version, median(v) AS g, count(*) AS n_train, min(o_orderdate) AS window_start, max(o_orderdate) AS window_end FROM src GROUP BY ALL),
se AS (SELECT src.company_id, src.version, home_size, count(*) AS n, (count(*) * median(v) + 10.0 * any_value(g)) / (count(*) + 10.0) AS lr FROM src JOIN mo USING (company_id, version) GROUP BY ALL),
st AS (SELECT *, CASE WHEN company_id % 5 = 0 THEN 'shadow' WHEN version = max(version) OVER (PARTITION BY company_id) THEN 'active' ELSE 'shadow' END AS status FROM mo)"""


@query(FITTED + """ SELECT st.company_id, version, status, n_train, window_start, window_end, round(g, 9) AS global_log_ratio, count(*) AS segments, round(sum(lr), 9) AS sum_log_ratio FROM st JOIN se USING (company_id, version) GROUP BY ALL""")
def model_registry(spark, d):
    """Models fitted, stored, promoted and read back from their rows."""
    m = _models(spark, d, cut(_training(spark, d)))
    p = F.from_json("params", registry.PARAMS)
    total = F.aggregate(F.map_values(p["segments"]), F.lit(0.0), lambda a, s: a + s["log_ratio"])
    return m.select("company_id", "version", "status", "n_train", "window_start", "window_end", F.round(p["global_log_ratio"], 9).alias("global_log_ratio"), F.size(p["segments"]).cast("long").alias("segments"), F.round(total, 9).alias("sum_log_ratio"))


@query(FITTED + """, ac AS (SELECT * FROM st WHERE status = 'active'), jb AS (SELECT w.*, ['studio', '1br', '2br', '3br', '4br', '5br_plus'][least(l_linenumber, 6)] AS home_size FROM w),
pr AS (SELECT jb.*, ac.version, ac.n_train, coalesce(CASE WHEN se.n >= 8 THEN se.lr END, g) AS lr, CASE WHEN se.n >= 8 THEN se.n ELSE n_train END AS support FROM jb LEFT JOIN ac ON ac.company_id = jb.company_id LEFT JOIN se ON se.company_id = ac.company_id AND se.version = ac.version AND se.home_size = jb.home_size),
ca AS (SELECT *, CASE WHEN version IS NULL THEN 'no_model' WHEN n_train < 20 THEN 'insufficient_history' WHEN support < 20 THEN 'insufficient_support' END AS why, CASE WHEN n_train >= 200 THEN 0.2 WHEN n_train >= 50 THEN 0.15 ELSE 0.1 END AS cap FROM pr),
fa AS (SELECT *, CASE WHEN why IS NULL THEN least(greatest(exp(lr), 1 - cap), 1 + cap) ELSE 1.0 END AS factor FROM ca),
ho AS (SELECT *, greatest(ceil(round(hours::DOUBLE * factor * 2, 9)) / 2, 3.0)::DECIMAL(18,1) AS new_hours FROM fa),
re AS (SELECT *, (new_hours * map {2: 140, 3: 190, 4: 240, 5: 290}[crew])::DECIMAL(18,4) + 50 + 2 * miles::DECIMAL(18,4) AS new_sub FROM ho)
SELECT o_orderkey, why AS reason, round(factor, 9) AS factor, CASE WHEN why IS NULL THEN new_hours ELSE hours END::DOUBLE AS hours, CASE WHEN why IS NULL THEN (round((new_sub * f)::DECIMAL(24,8), 2) * 100)::BIGINT ELSE (round((sub * f)::DECIMAL(24,8), 2) * 100)::BIGINT END AS total_cents,
CASE WHEN why IS NULL THEN (round((new_sub * f * 0.88)::DECIMAL(28,8), 0) * 100)::BIGINT ELSE (round((sub * f * 0.88)::DECIMAL(28,8), 0) * 100)::BIGINT END AS amount_min_cents, CASE WHEN why IS NULL THEN (round(new_sub, 2) * 100)::BIGINT ELSE (round(sub, 2) * 100)::BIGINT END AS line_cents FROM re""")
def calibrated_quotes(spark, d):
    """Estimates corrected by the active models as they are stored, with their line items made anew."""
    training = cut(_training(spark, d))
    models = cut(registry.active(_models(spark, d, training), "company_id"))
    found = registry.rebuilt(registry.predicted(training.drop("reason"), models, "company_id", "home_size", F.col("p.estimated_hours")), "p", "c")
    lines = F.aggregate(F.filter("calibrated.line_items", lambda x: x["code"] != "date_adjustment"), F.lit(0).cast("long"), lambda a, x: a + x["amount_cents"])
    return found.select("o_orderkey", "c.reason", F.round("c.factor", 9).alias("factor"), F.col("calibrated.estimated_hours").alias("hours"), "calibrated.total_cents", "calibrated.amount_min_cents", lines.alias("line_cents"))
