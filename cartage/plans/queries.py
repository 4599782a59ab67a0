"""The engine's own queries over the driver's tables, each with the SQL that must give the same rows where SQL can."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cartage.functions import parse, text
from cartage.functions.staging import cut
from cartage.operators import evidence, pricing, relational, retrieval, similarity, stats, topk, validation
from cartage.operators.quantiles import exact_quantiles, upper_middle, with_quantiles
from cartage.streaming import state

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    def keep(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return keep


def t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


@query("SELECT o_orderkey, c_name, n_name, o_totalprice FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE o_orderstatus = 'O'")
def funnel_3way(spark, d):
    o = t(spark, d, "orders").where("o_orderstatus = 'O'")
    return o.join(t(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(F.broadcast(t(spark, d, "nation")), F.col("c_nationkey") == F.col("n_nationkey")).select("o_orderkey", "c_name", "n_name", "o_totalprice")


@query("""SELECT l_orderkey, l_linenumber, c_name, n_name, o_orderdate FROM lineitem JOIN orders ON l_orderkey = o_orderkey
JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE l_returnflag <> 'R' AND o_orderdate BETWEEN TIMESTAMP '1996-01-01' AND TIMESTAMP '1996-12-31'""")
def bookings_4way(spark, d):
    o = t(spark, d, "orders").where(F.col("o_orderdate").between(F.lit("1996-01-01").cast("timestamp"), F.lit("1996-12-31").cast("timestamp")))
    li = t(spark, d, "lineitem").where("l_returnflag <> 'R'")
    c = t(spark, d, "customer").join(F.broadcast(t(spark, d, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))
    return li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(c, F.col("o_custkey") == F.col("c_custkey")).select("l_orderkey", "l_linenumber", "c_name", "n_name", "o_orderdate")


@query("""SELECT c_custkey, c_name, count(o_orderkey) AS n_orders, coalesce(string_agg(o_orderkey::VARCHAR, ',' ORDER BY o_orderdate DESC, o_orderkey), '') AS order_keys
FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey, c_name""")
def lead_detail_nested(spark, d):
    key = F.struct((-F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01', o_orderdate)")).alias("at"), F.col("o_orderkey"))
    o = t(spark, d, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list(key)).alias("o"))
    return t(spark, d, "customer").join(o, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", "c_name", F.coalesce("n", F.lit(0)).cast("long").alias("n_orders"), F.coalesce(F.array_join(F.transform("o.o_orderkey", lambda k: k.cast("string")), ","), F.lit("")).alias("order_keys"))


@query("""SELECT c_nationkey AS company_id, o_orderdate::DATE::VARCHAR AS day, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey
WHERE o_orderstatus <> 'F' GROUP BY 1, 2""")
def booked_counts(spark, d):
    return _booked(spark, d).withColumn("day", F.col("day").cast("string"))


def _booked(spark, d):
    o = t(spark, d, "orders").where("o_orderstatus <> 'F'").join(t(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return o.groupBy(F.col("c_nationkey").alias("company_id"), F.to_date("o_orderdate").alias("day")).agg(F.count(F.lit(1)).alias("n"))


@query("""WITH b AS (SELECT c_nationkey AS company_id, o_orderdate::DATE AS day, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey
  WHERE o_orderstatus <> 'F' AND o_orderdate >= TIMESTAMP '1996-01-01' AND o_orderdate < TIMESTAMP '1996-04-02' GROUP BY 1, 2),
s AS (SELECT n_nationkey AS company_id, x::DATE AS day FROM nation, generate_series(TIMESTAMP '1996-01-01', TIMESTAMP '1996-04-01', INTERVAL 1 DAY) g(x)),
j AS (SELECT s.company_id, s.day, coalesce(b.n, 0) AS booked, CASE WHEN s.company_id % 5 = 0 AND day(s.day) = 25 THEN true ELSE false END AS blocked,
  CASE WHEN s.company_id % 5 = 0 AND day(s.day) <> 25 THEN 3 ELSE 2 END AS cap FROM s LEFT JOIN b USING (company_id, day)),
r AS (SELECT *, CASE WHEN day < DATE '1996-01-05' THEN 'too_soon' WHEN day > DATE '1996-03-20' THEN 'too_far' WHEN blocked THEN 'blocked' WHEN booked >= cap THEN 'full' END AS reason FROM j)
SELECT company_id, day::VARCHAR AS day, booked, reason IS NULL AS available, reason FROM r""")
def availability_calendar(spark, d):
    booked = _booked(spark, d).where("day BETWEEN DATE'1996-01-01' AND DATE'1996-04-01'")
    tenants = t(spark, d, "nation").select(F.col("n_nationkey").alias("company_id"))
    days = tenants.where("company_id % 5 = 0").select("company_id", F.explode(F.expr("sequence(DATE'1996-01-01', DATE'1996-04-01')")).alias("day"))
    over = days.select("company_id", "day", F.when(F.dayofmonth("day") != 25, 3).alias("max_moves"), (F.dayofmonth("day") == 25).alias("is_blocked"))
    return relational.calendar(tenants, booked, over, "1996-01-01", "1996-04-01", "1996-01-03", 2, 2, 77).withColumn("day", F.col("day").cast("string"))


PAIRS = "SELECT l_orderkey, l_linenumber, p_type, p_size, l_shipdate, p_retailprice * l_quantity AS quoted, l_extendedprice AS actual, l_quantity, l_returnflag FROM lineitem JOIN part ON l_partkey = p_partkey"


def pairs(spark, d):
    li = t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_shipdate", "l_quantity", "l_extendedprice", "l_returnflag")
    p = t(spark, d, "part").select("p_partkey", "p_type", "p_size", "p_retailprice")
    return li.join(p, F.col("l_partkey") == F.col("p_partkey")).withColumn("quoted", F.col("p_retailprice") * F.col("l_quantity")).withColumn("actual", F.col("l_extendedprice"))


@query(f"""SELECT l_returnflag AS source, count(*) AS moves, min(l_shipdate)::DATE::VARCHAR AS first_day, max(l_shipdate)::DATE::VARCHAR AS last_day, median(l_quantity) AS median_hours,
round(median(CASE WHEN quoted <> 0 THEN (actual - quoted) / quoted * 100 END), 6) AS median_error_pct FROM ({PAIRS}) GROUP BY 1""")
def history_summary(spark, d):
    rows = pairs(spark, d).withColumn("source", F.col("l_returnflag"))
    plain = [F.count(F.lit(1)).alias("moves"), F.to_date(F.min("l_shipdate")).cast("string").alias("first_day"), F.to_date(F.max("l_shipdate")).cast("string").alias("last_day")]
    out = with_quantiles(rows, ["source"], plain, {"median_hours": (F.col("l_quantity"), 0.5), "e": (stats.signed_pct(F.col("actual"), F.col("quoted")), 0.5)})
    return out.withColumn("e", F.round("e", 6)).withColumnRenamed("e", "median_error_pct")


@query(f"""SELECT count(*) AS jobs, round(avg(CASE WHEN quoted <> 0 THEN abs(actual - quoted) / quoted * 100 END), 6) AS mape, round(avg(abs(actual - quoted)), 4) AS mae
FROM ({PAIRS}) WHERE l_returnflag = 'N'""")
def accuracy_scorecard(spark, d):
    rows = pairs(spark, d).where("l_returnflag = 'N'")
    return rows.agg(F.count(F.lit(1)).alias("jobs"), F.round(F.avg(F.abs(stats.signed_pct(F.col("actual"), F.col("quoted")))), 6).alias("mape"), F.round(F.avg(F.abs(F.col("actual") - F.col("quoted"))), 4).alias("mae"))


@query(f"""WITH x AS (SELECT l_returnflag, abs(actual - quoted) AS gap, (actual - quoted) / quoted * 100 AS s FROM ({PAIRS}) WHERE quoted > 0 AND actual > 0)
SELECT l_returnflag, count(*) AS n, round(median(abs(s)), 2) AS median_ape_pct, round(avg(gap), 3) AS mae_hours, round(median(s), 2) AS median_signed_error_pct,
round(quantile_disc(gap, 0.9), 3) AS p90_abs_error_hours, round(avg((abs(s) <= 15)::INT) * 100, 1) AS within_15_pct, round(avg((abs(s) <= 25)::INT) * 100, 1) AS within_25_pct FROM x GROUP BY 1""")
def hours_metrics(spark, d):
    return stats.hours_metrics(pairs(spark, d), "quoted", "actual", "l_returnflag")


@query(f"""SELECT l_returnflag, round(list_sort(list(actual / quoted))[(count(*) // 2 + 1)::BIGINT], 9) AS upper_median FROM ({PAIRS}) WHERE quoted > 0 GROUP BY 1""")
def upper_median_factor(spark, d):
    rows = pairs(spark, d).where("quoted > 0").withColumn("factor", F.col("actual") / F.col("quoted"))
    return exact_quantiles(rows, ["l_returnflag"], {"m": (F.col("factor"), upper_middle())}).select("l_returnflag", F.round("m", 9).alias("upper_median"))


@query(f"""WITH x AS (SELECT p_type, ln(actual / quoted) AS v FROM ({PAIRS}) WHERE quoted > 0 AND actual > 0), g AS (SELECT median(v) AS m FROM x)
SELECT p_type, count(*) AS n, round((count(*) * median(v) + 10.0 * any_value(m)) / (count(*) + 10.0), 9) AS shrunk FROM x, g GROUP BY 1""")
def segmented_shrinkage(spark, d):
    rows = pairs(spark, d).where("quoted > 0 AND actual > 0").select("p_type", F.ln(F.col("actual") / F.col("quoted")).alias("v"))
    return stats.shrunk_medians(rows, "p_type", "v").select("p_type", "n", F.round("shrunk", 9).alias("shrunk"))


@query(f"""WITH x AS (SELECT p_type, l_orderkey, l_linenumber, l_quantity AS base, ln(actual / quoted) AS v FROM ({PAIRS}) WHERE quoted > 0 AND actual > 0), g AS (SELECT median(v) AS m FROM x),
m AS (SELECT p_type, count(*) AS n, (count(*) * median(v) + 10.0 * any_value(m)) / (count(*) + 10.0) AS lr FROM x, g GROUP BY 1),
c AS (SELECT *, CASE WHEN n >= 200 THEN 0.2 WHEN n >= 50 THEN 0.15 WHEN n >= 20 THEN 0.1 ELSE 0.0 END AS cap FROM m),
f AS (SELECT l_orderkey, l_linenumber, CASE WHEN n < 20 THEN 'insufficient_support' END AS reason, CASE WHEN n < 20 THEN 1.0 ELSE least(greatest(exp(lr), 1 - cap), 1 + cap) END AS factor, base FROM x JOIN c USING (p_type))
SELECT l_orderkey, l_linenumber, reason, round(factor, 9) AS factor, ceil(round(base * factor * 2, 9)) / 2 AS hours FROM f""")
def calibrated_predict(spark, d):
    rows = pairs(spark, d).where("quoted > 0 AND actual > 0").select("p_type", "l_orderkey", "l_linenumber", F.col("l_quantity").alias("base"), F.ln(F.col("actual") / F.col("quoted")).alias("v"))
    model = stats.shrunk_medians(rows, "p_type", "v").select("p_type", "n", "shrunk")
    return rows.join(model, "p_type", "left").withColumn("c", stats.apply_correction(F.col("base"), F.col("shrunk"), F.col("n"))).select("l_orderkey", "l_linenumber", "c.reason", F.round("c.factor", 9).alias("factor"), "c.hours")


@query("""WITH x AS (SELECT c_nationkey AS company_id, o_orderkey, o_totalprice AS v, row_number() OVER (PARTITION BY c_nationkey ORDER BY o_orderdate, o_orderkey) AS rn, count(*) OVER (PARTITION BY c_nationkey) AS n
  FROM orders JOIN customer ON o_custkey = c_custkey),
f AS (SELECT company_id, greatest(20, n // 2) AS first, greatest((n - greatest(20, n // 2)) // 4, 10) AS step, n FROM x GROUP BY company_id, n),
k AS (SELECT company_id, i AS fold, first + i * step AS lo, least(first + (i + 1) * step, n) AS hi FROM f, range(0, 5) r(i) WHERE least(first + (i + 1) * step, n) - (first + i * step) >= 10),
m AS (SELECT k.company_id, fold, lo, hi, median(v) AS fit FROM k JOIN x ON x.company_id = k.company_id AND rn <= lo GROUP BY ALL)
SELECT m.company_id, fold, lo AS n_train, hi - lo AS n_test, round(fit, 6) AS fit, round(avg(abs(v - fit)), 4) AS mae FROM m JOIN x ON x.company_id = m.company_id AND rn > lo AND rn <= hi GROUP BY m.company_id, fold, lo, hi, fit""")
def rolling_backtest(spark, d):
    o = t(spark, d, "orders").join(t(spark, d, "customer").select("c_custkey", F.col("c_nationkey").alias("company_id")), F.col("o_custkey") == F.col("c_custkey"))
    x = cut(stats.numbered(o.select("company_id", "o_orderdate", "o_orderkey", F.col("o_totalprice").alias("v")), "company_id", F.to_date("o_orderdate"), "o_orderdate", "o_orderkey"))
    folds = cut(stats.fold_bounds(x, "company_id"))
    joined = x.join(folds, "company_id").where("rn <= hi")
    fit = exact_quantiles(joined.where("rn <= lo"), ["company_id", "fold"], {"fit": (F.col("v"), 0.5)})
    test = joined.where("rn > lo").join(fit, ["company_id", "fold"])
    return test.groupBy("company_id", "fold", "fit", F.col("lo").cast("long").alias("n_train"), (F.col("hi") - F.col("lo")).cast("long").alias("n_test")).agg(F.round(F.avg(F.abs(F.col("v") - F.col("fit"))), 4).alias("mae")).withColumn("fit", F.round("fit", 6)).withColumn("fold", F.col("fold").cast("long"))


@query("""WITH x AS (SELECT l_orderkey, l_linenumber, ['studio', '1br', '2br', '3br', '4br', '5br_plus'][least(l_linenumber, 6)] AS size, ['none', 'partial', 'full'][(l_orderkey % 3 + 1)::BIGINT] AS packing,
  (l_quantity::INT % 6) AS floor, (l_orderkey % 2 = 0) AS elevator, (l_quantity::INT % 3) AS flights, l_quantity AS miles, o_orderdate::DATE AS day, l_partkey % 4 AS item FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
h AS (SELECT *, map {'studio': 3.0, '1br': 4.0, '2br': 5.5, '3br': 7.5, '4br': 9.0, '5br_plus': 11.0}[size]::DECIMAL(18,4)
  + CASE WHEN floor <= 1 AND flights = 0 THEN 0 WHEN elevator THEN 0.3 ELSE 0.4 * greatest(flights, floor - 1) END::DECIMAL(18,4)
  + CASE item WHEN 0 THEN 0 WHEN 1 THEN 1.5 WHEN 2 THEN 1.0 ELSE 0.5 END::DECIMAL(18,4) AS raw, CASE packing WHEN 'none' THEN 1.00 WHEN 'partial' THEN 1.25 ELSE 1.50 END::DECIMAL(4,2) AS pm FROM x),
c AS (SELECT *, greatest((ceil(raw * pm * 2) / 2)::DECIMAL(18,1), 3.0::DECIMAL(18,1)) AS hours, map {'studio': 2, '1br': 2, '2br': 3, '3br': 3, '4br': 4, '5br_plus': 5}[size] AS crew,
  CASE WHEN isodow(day) >= 6 THEN 1.10 ELSE 1.00 END::DECIMAL(3,2) * CASE WHEN day(day) >= 25 THEN 1.10 ELSE 1.00 END::DECIMAL(3,2) * CASE WHEN month(day) BETWEEN 5 AND 9 THEN 1.05 ELSE 1.00 END::DECIMAL(3,2) AS f FROM h),
p AS (SELECT *, (hours * map {2: 140, 3: 190, 4: 240, 5: 290}[crew])::DECIMAL(18,4) + 50 + 2 * miles::DECIMAL(18,4) AS sub FROM c)
SELECT l_orderkey, l_linenumber, crew AS crew_size, hours::DOUBLE AS estimated_hours, (round(sub, 2) * 100)::BIGINT AS subtotal_cents, (round((sub * f)::DECIMAL(24,8), 2) * 100)::BIGINT AS total_cents,
(round((sub * f * 0.88)::DECIMAL(28,8), 0) * 100)::BIGINT AS amount_min_cents, (round((sub * f * 1.12)::DECIMAL(28,8), 0) * 100)::BIGINT AS amount_max_cents FROM p""")
def price_kernel(spark, d):
    return _priced(_jobs(spark, d), "p").select("l_orderkey", "l_linenumber", "p.crew_size", "p.estimated_hours", "p.subtotal_cents", "p.total_cents", "p.amount_min_cents", "p.amount_max_cents")


def _jobs(spark, d):
    o = t(spark, d, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("day"))
    return t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_partkey").join(o, F.col("l_orderkey") == F.col("o_orderkey"))


def _priced(jobs, name, change=None):
    """``_jobs`` with their price; ``change`` replaces packing or floor."""
    size = F.element_at(F.array(*map(F.lit, similarity.HOME_SIZES)), F.least(F.col("l_linenumber"), F.lit(6)))
    n = F.col("l_quantity").cast("int")
    own = {"packing": F.element_at(F.array(*map(F.lit, similarity.PACKING)), (F.col("l_orderkey") % 3 + 1).cast("int")), "floor": n % 6} | (change or {})
    items = F.element_at(F.array(F.array().cast("array<string>"), F.array(F.lit("piano")), F.array(F.lit("safe")), F.array(F.lit("harp"))), (F.col("l_partkey") % 4 + 1).cast("int"))
    ground = {"floor": F.lit(1), "flights": F.lit(0), "elevator": F.lit(False)}
    return pricing.priced(jobs, name, size, own["packing"], items, {"floor": own["floor"], "flights": n % 3, "elevator": F.col("l_orderkey") % 2 == 0}, ground, F.col("l_quantity"), F.col("day"))


@query("""WITH x AS (SELECT CASE WHEN l_linenumber = 7 THEN NULL ELSE l_quantity END AS a, CASE WHEN l_partkey % 11 = 0 THEN NULL ELSE l_tax END AS m, CASE WHEN l_suppkey % 7 = 0 THEN NULL ELSE 1 END AS f, l_discount * 200 AS p FROM lineitem)
SELECT coalesce(CASE WHEN a IS NULL THEN 'no_actual_hours' WHEN a < 0.5 OR a > 48 THEN 'implausible_hours' WHEN m IS NULL THEN 'no_distance' WHEN f IS NULL THEN 'no_access' WHEN p <= 0 THEN 'unpriceable'
  WHEN a / p < 0.25 OR a / p > 4 THEN 'implausible_ratio' END, 'eligible') AS reason, count(*) AS n FROM x GROUP BY 1""")
def ineligible_cascade(spark, d):
    x = t(spark, d, "lineitem")
    a, m = F.when(F.col("l_linenumber") != 7, F.col("l_quantity")), F.when(F.col("l_partkey") % 11 != 0, F.col("l_tax"))
    reason = pricing.exclusion_reason(a, m, F.when(F.col("l_suppkey") % 7 != 0, 1), F.lit(None), F.col("l_discount") * 200)
    return x.groupBy(F.coalesce(reason, F.lit("eligible")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def part_scores(q: topk.Columns, c: topk.Columns) -> np.ndarray:
    """Size, price and type as home size, distance and packing."""
    gaps = {"home_size": similarity.scaled_gaps(q["p_size"], c["p_size"], 10.0), "distance_miles": similarity.scaled_gaps(q["p_retailprice"], c["p_retailprice"], 500.0), "packing_service": similarity.unequal(q["p_type"], c["p_type"])}
    return similarity.pair_scores(gaps)


def _similar(spark, d):
    """The best matches of every part whose key is divisible by 100."""
    p = t(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_partkey").alias("tie"), F.col("p_size").cast("double").alias("p_size"), F.col("p_retailprice").cast("double").alias("p_retailprice"), "p_type")
    q = p.where("id % 100 = 0").withColumnRenamed("id", "query_id").drop("tie")
    return topk.top_k_of_kinds(q, p, part_scores, 10)


SIMILAR_EACH = """WITH q AS (SELECT * FROM part WHERE p_partkey % 100 = 0),
s AS (SELECT q.p_partkey AS query_id, p.p_partkey, p.p_retailprice, (30 * least(abs(p.p_size - q.p_size) / 10.0, 1) + 20 * least(abs(p.p_retailprice - q.p_retailprice) / 500.0, 1) + 8 * CASE WHEN p.p_type = q.p_type THEN 0 ELSE 1 END) / 58.0 AS gap
  FROM part p, q WHERE p.p_partkey <> q.p_partkey), r AS (SELECT query_id, p_partkey, p_retailprice, round(1 - gap, 4) AS score FROM s),
k AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, p_partkey) <= 10)"""


@query(SIMILAR_EACH + " SELECT query_id, p_partkey, score FROM k")
def similar_topk(spark, d):
    return _similar(spark, d).select("query_id", F.col("id").alias("p_partkey"), "score")


@query(SIMILAR_EACH + """ SELECT query_id, (SELECT count(*) - 1 FROM part) AS comparable_count, count(*) AS used, round(median(p_retailprice), 6) AS median_price, round(quantile_cont(p_retailprice::DOUBLE, 0.25), 6) AS q1, round(quantile_cont(p_retailprice::DOUBLE, 0.75), 6) AS q3 FROM k GROUP BY 1""")
def similar_signals(spark, d):
    every = t(spark, d, "part").agg((F.count(F.lit(1)) - 1).alias("comparable_count"))
    found = _similar(spark, d).join(t(spark, d, "part").select(F.col("p_partkey").alias("id"), "p_retailprice"), "id")
    top = found.groupBy("query_id").agg(F.count(F.lit(1)).alias("used"), F.round(F.median("p_retailprice"), 6).alias("median_price"), F.expr("round(percentile(p_retailprice, 0.25), 6)").alias("q1"), F.expr("round(percentile(p_retailprice, 0.75), 6)").alias("q3"))
    return top.crossJoin(F.broadcast(every))  # one row on the right


@query("""WITH x AS (SELECT event_id, user_id % 7 AS tenant, CASE WHEN event_id % 3 = 0 THEN json_extract_string(props, '$.k') END AS ref, user_id || ':' || event_type AS fp FROM events),
a AS (SELECT *, ref IS NOT NULL AND row_number() OVER (PARTITION BY tenant, ref ORDER BY event_id) > 1 AS rd FROM x),
b AS (SELECT *, max(CASE WHEN rd THEN 0 ELSE 1 END) OVER (PARTITION BY tenant, fp ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM a)
SELECT event_id, CASE WHEN ref IS NOT NULL THEN rd ELSE coalesce(seen, 0) = 1 END AS duplicate FROM b""")
def dedup_two_keys(spark, d):
    x = t(spark, d, "events").select("event_id", (F.col("user_id") % 7).alias("tenant"), F.when(F.col("event_id") % 3 == 0, F.get_json_object("props", "$.k")).alias("ref"), F.concat_ws(":", "user_id", "event_type").alias("fp"))
    return relational.flag_duplicates(x, "event_id", "ref", "fp", tenant="tenant").select("event_id", "duplicate")


@query("SELECT event_type, count(*) AS n, sum(json_extract_string(props, '$.k')::BIGINT)::BIGINT AS total, max(json_extract_string(props, '$.k')::BIGINT) AS most FROM events GROUP BY 1")
def parse_props_json(spark, d):
    k = F.from_json("props", "k long").getField("k")
    return t(spark, d, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum(k).alias("total"), F.max(k).alias("most"))


NORMAL = r"""regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '\r\n?', chr(10), 'g'), '[\x00-\x08\x0B\x0C\x0E-\x1F]', ' ', 'g'),
'<[^>]{0,200}>', ' ', 'g'), '[ \t]+', ' ', 'g'), ' ?\n ?', chr(10), 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '^[ \n]+|[ \n]+$', '', 'g')"""


@query(f"SELECT doc_id, sha256({NORMAL}) AS normal_sha FROM documents")
def text_normalise(spark, d):
    return t(spark, d, "documents").select("doc_id", F.sha2(text.normalize(F.col("text")), 256).alias("normal_sha"))


@query("SELECT page_id, length(regexp_replace(html, '<[^>]{0,200}>', ' ', 'g')) AS n_chars, greatest(1, length(html) // 4)::INTEGER AS n_tokens FROM pages")
def html_strip(spark, d):
    return t(spark, d, "pages").select("page_id", F.length(F.regexp_replace("html", "<[^>]{0,200}>", " ")).cast("long").alias("n_chars"), text.estimate_tokens(F.col("html")).alias("n_tokens"))


STOP = ", ".join(f"'{w}'" for w in text.STOPWORDS)
TOKENS = f"""list_sort(list_distinct(list_transform(list_filter(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda w: length(w) >= 3 AND w NOT IN ({STOP})),
lambda w: CASE WHEN length(w) > 4 AND w LIKE '%ies' THEN w[:-4] || 'y' WHEN length(w) > 4 AND regexp_matches(w, '(s|x|z|ch|sh)es$') THEN w[:-3] WHEN length(w) > 3 AND w LIKE '%s' AND w NOT LIKE '%ss' THEN w[:-2] ELSE w END)))"""


@query(f"SELECT item_id, length(tok) AS n_tokens, sha256(array_to_string(tok, ' ')) AS token_sha FROM (SELECT item_id, {TOKENS} AS tok FROM benchmark)")
def token_stats(spark, d):
    tok = text.search_tokens(F.col("text"))
    return t(spark, d, "benchmark").select("item_id", F.size(tok).cast("long").alias("n_tokens"), F.sha2(F.array_join(tok, " "), 256).alias("token_sha"))


@query(f"""WITH q AS (SELECT conv_id * 100 + turn AS query_id, unnest({TOKENS}) AS token FROM conversations WHERE role = 'user'),
e AS (SELECT p_partkey AS entry_id, {TOKENS.replace('lower(text)', 'lower(p_name)')} AS a, {TOKENS.replace('lower(text)', 'lower(p_type)')} AS b FROM part),
w AS (SELECT entry_id, unnest(a) AS word, 3 AS w FROM e UNION ALL SELECT entry_id, unnest(b), 1 FROM e),
m AS (SELECT DISTINCT token, word FROM (SELECT DISTINCT token FROM q) x, (SELECT DISTINCT word FROM w) y WHERE word = token OR (length(token) >= 4 AND starts_with(word, token))),
s AS (SELECT query_id, entry_id, q.token, max(w.w) AS best FROM q JOIN m ON q.token = m.token JOIN w ON w.word = m.word GROUP BY ALL)
SELECT query_id, entry_id, sum(best)::BIGINT AS score FROM s GROUP BY 1, 2""")
def keyword_search(spark, d):
    q = t(spark, d, "conversations").where("role = 'user'").select((F.col("conv_id") * 100 + F.col("turn")).alias("query_id"), "text")
    return retrieval.keyword_scores(t(spark, d, "part"), q, {"title": "p_name", "content": "p_type"}, "p_partkey", "query_id", "text")


@query(f"""WITH q AS (SELECT conv_id * 100 + turn AS query_id, unnest({TOKENS}) AS token FROM conversations WHERE role = 'user'),
e AS (SELECT p_partkey AS entry_id, {TOKENS.replace('lower(text)', 'lower(p_name)')} AS a, {TOKENS.replace('lower(text)', 'lower(p_type)')} AS b FROM part),
w AS (SELECT entry_id, unnest(a) AS word, 3 AS w FROM e UNION ALL SELECT entry_id, unnest(b), 1 FROM e),
m AS (SELECT DISTINCT token, word FROM (SELECT DISTINCT token FROM q) x, (SELECT DISTINCT word FROM w) y WHERE word = token OR (length(token) >= 4 AND starts_with(word, token))),
s AS (SELECT query_id, entry_id, q.token, max(w.w) AS best FROM q JOIN m ON q.token = m.token JOIN w ON w.word = m.word GROUP BY ALL),
r AS (SELECT query_id, entry_id, sum(best)::BIGINT AS score FROM s GROUP BY 1, 2)
SELECT query_id, entry_id, p_name AS title, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, p_name, entry_id) AS place FROM r JOIN part ON p_partkey = entry_id QUALIFY place <= 3""")
def keyword_top(spark, d):
    q = t(spark, d, "conversations").where("role = 'user'").select((F.col("conv_id") * 100 + F.col("turn")).alias("query_id"), "text")
    found = retrieval.keyword_top(t(spark, d, "part"), q, {"title": "p_name", "content": "p_type"}, "p_partkey", "p_name", "query_id", "text")
    return found.select("query_id", "entry_id", "title", "score", F.col("place").cast("long").alias("place"))


@query("SELECT doc_id, sha256('text:' || text) AS content_hash, substr(sha256(lower(regexp_replace(regexp_replace(text, '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g'), '^ | $', '', 'g'))), 1, 12) AS print FROM documents")
def content_fingerprint(spark, d):
    return t(spark, d, "documents").select("doc_id", text.content_hash(F.col("text")).alias("content_hash"), text.query_fingerprint(F.col("text")).alias("print"))


VECTOR = """WITH q AS (SELECT vec_id AS query_id, embedding AS e, label AS ql FROM embeddings WHERE vec_id % 100 = 0), s AS (SELECT query_id, vec_id AS chunk_id, ql = label AS relevant, round(list_cosine_similarity(e::DOUBLE[], embedding::DOUBLE[]), 6) AS similarity FROM q, embeddings WHERE vec_id <> query_id),
v AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, sha256('vector:' || chunk_id), chunk_id) AS vector_rank FROM s),"""


def vector_scores(q: topk.Columns, c: topk.Columns) -> np.ndarray:
    return topk.not_itself(q, c, np.round(topk.cosines(q["e"], c["e"]), 6))


def _vector(spark, d):
    """The nearest vectors of the stated query set, the rows divisible by 100, by cosine, then content hash."""
    e = t(spark, d, "embeddings")
    c = e.select(F.col("vec_id").alias("id"), F.sha2(F.concat(F.lit("vector:"), F.col("vec_id").cast("string")), 256).alias("tie"), F.col("embedding").cast("array<double>").alias("e"))
    q = e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").cast("array<double>").alias("e"))
    found = topk.top_k(q, c, vector_scores, retrieval.ARM_LIMIT).select("query_id", F.col("id").alias("chunk_id"), F.col("place").alias("vector_rank"), F.col("score").alias("similarity"))
    labels = e.select("vec_id", "label")
    met = found.join(labels.select(F.col("vec_id").alias("query_id"), F.col("label").alias("ql")), "query_id").join(labels.select(F.col("vec_id").alias("chunk_id"), "label"), "chunk_id")
    return met.withColumn("relevant", F.col("ql") == F.col("label")).drop("ql", "label")


@query(VECTOR.rstrip(",") + " SELECT query_id, chunk_id, vector_rank, similarity FROM v WHERE vector_rank <= 20")
def vector_topk(spark, d):
    return _vector(spark, d).select("query_id", "chunk_id", F.col("vector_rank").cast("long").alias("vector_rank"), "similarity")


def _lexical(spark, d):
    """The words of the part with a vector's number are its text; a query asks for name and type of its part."""
    p = t(spark, d, "part").join(t(spark, d, "embeddings").select(F.col("vec_id").alias("p_partkey")), "p_partkey", "left_semi")
    c = p.select(F.col("p_partkey").alias("chunk_id"), F.concat_ws(" ", "p_name", "p_type", "p_brand").alias("text"))
    q = p.where("p_partkey % 100 = 0").select(F.col("p_partkey").alias("query_id"), F.concat_ws(" ", "p_name", "p_type").alias("text"))
    return evidence.lexical_arm(c, q)


LEXICAL = f"""b AS (SELECT p_partkey, p_name || ' ' || p_type || ' ' || p_brand AS body, p_name || ' ' || p_type AS asked FROM part WHERE p_partkey IN (SELECT vec_id FROM embeddings)), w AS (SELECT *, {TOKENS.replace('lower(text)', 'lower(body)')} AS have, {TOKENS.replace('lower(text)', 'lower(asked)')} AS want FROM b),
l AS (SELECT x.p_partkey AS query_id, y.p_partkey AS chunk_id, row_number() OVER (PARTITION BY x.p_partkey ORDER BY sha256('text:' || y.body), y.p_partkey) AS lexical_rank FROM w x JOIN w y ON x.p_partkey % 100 = 0 AND list_has_all(y.have, x.want)),"""


@query(VECTOR + LEXICAL + """
f AS (SELECT query_id, chunk_id, lexical_rank, similarity, coalesce(1.0 / (60 + lexical_rank), 0) + coalesce(1.0 / (60 + vector_rank), 0) AS score FROM (SELECT * FROM l WHERE lexical_rank <= 20) FULL JOIN (SELECT * FROM v WHERE vector_rank <= 20) USING (query_id, chunk_id)),
g AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS position FROM f WHERE lexical_rank IS NOT NULL OR similarity >= 0.35)
SELECT query_id, chunk_id, round(score, 9) AS score, position FROM g WHERE position <= 5""")
def rrf_hybrid(spark, d):
    fused = retrieval.fuse(_lexical(spark, d), _vector(spark, d))
    return retrieval.gate(fused).select("query_id", "chunk_id", F.round("score", 9).alias("score"), F.col("position").cast("long").alias("position"))


@query(VECTOR + """r AS (SELECT query_id, min(CASE WHEN relevant THEN vector_rank END) AS rank FROM v WHERE vector_rank <= 20 GROUP BY 1)
SELECT count(*) AS cases, round(avg(coalesce((rank <= 1)::INT, 0)), 6) AS recall_at_1, round(avg(coalesce((rank <= 3)::INT, 0)), 6) AS recall_at_3, round(avg(coalesce((rank <= 5)::INT, 0)), 6) AS recall_at_5, round(avg(coalesce(1.0 / rank, 0)), 6) AS mrr FROM r""")
def ir_metrics(spark, d):
    ranks = _vector(spark, d).groupBy("query_id").agg(F.min(F.when(F.col("relevant"), F.col("vector_rank"))).alias("rank"))
    return retrieval.ir_metrics(ranks)


@query(VECTOR + """x AS (SELECT unnest([0.0, 0.1, 0.2, 0.3, 0.4])::DOUBLE AS floor), r AS (SELECT floor, query_id, min(CASE WHEN relevant AND similarity >= floor THEN vector_rank END) AS rank, count(CASE WHEN NOT relevant AND similarity >= floor THEN 1 END) AS false_hits FROM v, x WHERE vector_rank <= 20 GROUP BY 1, 2)
SELECT floor, count(*) AS cases, round(avg(coalesce((rank <= 5)::INT, 0)), 6) AS recall_at_5, sum(false_hits)::BIGINT AS false_hits FROM r GROUP BY 1""")
def threshold_sweep(spark, d):
    floors = F.explode(F.array(*[F.lit(x) for x in (0.0, 0.1, 0.2, 0.3, 0.4)])).alias("floor")
    over = F.col("similarity") >= F.col("floor")
    r = _vector(spark, d).select("*", floors).groupBy("floor", "query_id").agg(F.min(F.when(F.col("relevant") & over, F.col("vector_rank"))).alias("rank"), F.count_if(~F.col("relevant") & over).alias("false_hits"))
    return r.groupBy("floor").agg(F.count(F.lit(1)).alias("cases"), F.round(F.avg(F.coalesce((F.col("rank") <= 5).cast("int"), F.lit(0))), 6).alias("recall_at_5"), F.sum("false_hits").alias("false_hits"))


@query(VECTOR + LEXICAL + """ a AS (SELECT query_id, list(chunk_id ORDER BY vector_rank) AS r FROM v WHERE vector_rank <= 5 GROUP BY 1), k AS (SELECT query_id, list(chunk_id ORDER BY lexical_rank) AS l FROM l WHERE lexical_rank <= 5 GROUP BY 1)
SELECT CASE WHEN l = r THEN 'identical' WHEN length(list_intersect(l, r)) = length(l) AND length(l) = length(r) THEN 'same_set' WHEN length(list_intersect(l, r)) > 0 THEN 'overlap' ELSE 'disjoint' END AS agreement, count(*) AS n FROM a JOIN k USING (query_id) GROUP BY 1""")
def retriever_agreement(spark, d):
    ids = lambda x, r: x.where(F.col(r) <= 5).groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct(r, "chunk_id"))).getField("chunk_id").alias(r[0]))
    both = ids(_lexical(spark, d), "lexical_rank").join(ids(_vector(spark, d), "vector_rank"), "query_id")
    return both.groupBy(retrieval.agreement(F.col("l"), F.col("v")).alias("agreement")).agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT lang, source, count(*) AS docs, count(quality) AS labelled, count(CASE WHEN quality = 1 THEN 1 END) AS good, count(CASE WHEN toxic = 1 THEN 1 END) AS toxic FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1, 2""")
def quality_slices(spark, d):
    x = t(spark, d, "documents").select("doc_id", "lang", "source").join(t(spark, d, "labels"), "doc_id", "left")
    return x.groupBy("lang", "source").agg(F.count(F.lit(1)).alias("docs"), F.count("quality").alias("labelled"), F.count_if(F.col("quality") == 1).alias("good"), F.count_if(F.col("toxic") == 1).alias("toxic"))


@query("""WITH m AS (SELECT conv_id, turn * 2 AS pos, role, text FROM conversations UNION ALL SELECT conv_id, turn * 2 + 1, 'tool', text FROM conversations WHERE role = 'assistant')
SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY pos, role, text) AS position, role, sha256(text) AS text_sha FROM m""")
def transcript_replay(spark, d):
    return _transcript(spark, d, F.col("text"))


def _transcript(spark, d, tool_text):
    own = F.struct((F.col("turn") * 2).alias("pos"), "role", "text")
    tool = F.when(F.col("role") == "assistant", F.struct((F.col("turn") * 2 + 1).alias("pos"), F.lit("tool").alias("role"), tool_text.alias("text")))
    m = t(spark, d, "conversations").select("conv_id", F.explode(F.array_compact(F.array(own, tool))).alias("m")).select("conv_id", "m.*")
    return m.select("conv_id", F.row_number().over(Window.partitionBy("conv_id").orderBy("pos", "role", "text")).cast("long").alias("position"), "role", F.sha2("text", 256).alias("text_sha"))


@query("SELECT user_id, event_type, min(event_id) AS event_id FROM events GROUP BY 1, 2")
def event_claim(spark, d):
    return state.claim(t(spark, d, "events").select("user_id", "event_type", "event_id"), None, ["user_id", "event_type"], "event_id")


@query()
def sliding_limit(spark, d):
    return state.limit_batch(t(spark, d, "events").withColumn("s", F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01', ts)") / 1e6), "user_id", "s", "event_id", 3, 86400.0)


@query("""WITH x AS (SELECT user_id, list(CASE event_type WHEN 'purchase' THEN 'succeeded' WHEN 'error' THEN 'failed' ELSE 'ignored' END) AS k FROM events GROUP BY 1)
SELECT user_id, CASE WHEN list_contains(k, 'succeeded') THEN 'succeeded' WHEN list_contains(k, 'failed') THEN 'failed' ELSE 'pending' END AS status FROM x""")
def payment_status(spark, d):
    kind = F.when(F.col("event_type") == "purchase", "succeeded").when(F.col("event_type") == "error", "failed").otherwise("ignored")
    # Success wins over all and failure over pending, so two flags in one aggregation stand for the ordered fold.
    e = t(spark, d, "events").groupBy("user_id").agg(F.bool_or(kind == "succeeded").alias("s"), F.bool_or(kind == "failed").alias("f"))
    return e.select("user_id", state.payment_state(F.array(F.when(F.col("f"), "failed").otherwise("ignored"), F.when(F.col("s"), "succeeded").otherwise("ignored"))).alias("status"))


@query("""WITH x AS (SELECT o_orderkey, o_custkey, row_number() OVER w AS rn, (row_number() OVER w - 1) // 8 AS grp FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey))
SELECT o_orderkey AS key, last_value(o_orderkey) OVER w AS head, (max(rn) OVER w - rn)::INTEGER AS hops FROM x WINDOW w AS (PARTITION BY o_custkey, grp ORDER BY rn ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)""")
def revision_chain_head(spark, d):
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    x = t(spark, d, "orders").select("o_orderkey", F.lead("o_orderkey").over(w).alias("nxt"), F.row_number().over(w).alias("rn"))
    return relational.chain_heads(x.withColumn("nxt", F.when(F.col("rn") % 8 != 0, F.col("nxt"))), "o_orderkey", "nxt")


@query("SELECT p_partkey, p_name FROM part WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_quantity > 45)")
def anti_coverage(spark, d):
    return t(spark, d, "part").join(t(spark, d, "lineitem").where("l_quantity > 45"), F.col("p_partkey") == F.col("l_partkey"), "left_anti").select("p_partkey", "p_name")


@query("""SELECT o_orderkey, o_orderdate::DATE::VARCHAR AS day, round(o_totalprice::DECIMAL(18,2) * 100)::BIGINT AS cents FROM orders""")
def parse_sheet_values(spark, d):
    o = t(spark, d, "orders").select("o_orderkey", F.date_format("o_orderdate", "dd/MM/yyyy").alias("written"), F.concat(F.lit("$"), F.format_number(F.col("o_totalprice"), 2)).alias("money"))
    return o.select("o_orderkey", parse.parse_date(F.col("written"), "dmy").cast("string").alias("day"), parse.parse_money_cents(F.col("money"), "dot").alias("cents"))


@query("""WITH w AS (SELECT o_orderkey, day(o_orderdate) AS a, month(o_orderdate) AS b, format('{:,.2f}', o_totalprice) AS m FROM orders), v AS (SELECT o_orderkey, CASE WHEN a > 12 THEN 'dmy' WHEN b > 12 THEN 'mdy' END AS dv,
CASE WHEN m LIKE '%.%' AND m LIKE '%,%' THEN CASE WHEN strpos(reverse(m), '.') < strpos(reverse(m), ',') THEN 'dot' ELSE 'comma' END WHEN m LIKE '%.%' AND length(split_part(m, '.', 2)) <> 3 THEN 'dot' END AS mv FROM w)
SELECT coalesce(min_by(dv, o_orderkey) FILTER (dv IS NOT NULL), 'ambiguous') AS date_order, coalesce(min_by(mv, o_orderkey) FILTER (mv IS NOT NULL), 'ambiguous') AS decimal_style FROM v""")
def inferred_formats(spark, d):
    o = t(spark, d, "orders").select("o_orderkey", F.date_format("o_orderdate", "dd/MM/yyyy").alias("written"), F.concat(F.lit("$"), F.format_number(F.col("o_totalprice"), 2)).alias("money"))
    return parse.detect_date_order(o, "written", "o_orderkey").crossJoin(parse.detect_decimal_style(o, "money", "o_orderkey"))  # one row each


@query("""WITH x AS (SELECT o_orderkey, concat_ws(',', CASE WHEN o_totalprice <= 20000 THEN 'total' END, CASE WHEN o_orderdate >= TIMESTAMP '1998-01-01' THEN 'date' END) AS errors,
  concat_ws(',', CASE WHEN o_totalprice > 300000 THEN 'total' END, CASE WHEN o_orderpriority LIKE '%LOW%' THEN 'priority' END) AS warnings FROM orders)
SELECT o_orderkey, errors, warnings, CASE WHEN errors <> '' THEN 'error' WHEN warnings <> '' THEN 'warning' ELSE 'ok' END AS status FROM x""")
def row_verdicts(spark, d):
    return _verdicts(spark, d).select("o_orderkey", F.array_join("errors.field", ",").alias("errors"), F.array_join("warnings.field", ",").alias("warnings"), "status")


def _verdicts(spark, d):
    total, day = F.col("o_totalprice"), F.col("o_orderdate")
    rules = [
        ("total", "error", total <= 20000, "too small"), ("date", "error", day >= F.lit("1998-01-01").cast("timestamp"), "in the future"),
        ("total", "warning", total > 300000, "unusually large"), ("priority", "warning", F.col("o_orderpriority").contains("LOW"), "not urgent"),
    ]
    return validation.verdicts(t(spark, d, "orders"), rules)


@query(f"""SELECT count(*) AS n_rows, count(*) FILTER (status = 'ok') AS n_ok, count(*) FILTER (status = 'warning') AS n_warning, count(*) FILTER (status = 'error') AS n_error FROM ({ORACLE["row_verdicts"]})""")
def verdict_counts(spark, d):
    return validation.verdict_counts(_verdicts(spark, d))


@query("""WITH m AS (SELECT DISTINCT date_trunc('month', o_orderdate)::DATE AS month FROM orders),
g AS (SELECT month, dayofweek(month) AS lead, day(last_day(month)) AS days, unnest(range(((dayofweek(month) + day(last_day(month)) + 6) // 7) * 7)) AS cell FROM m)
SELECT month::VARCHAR AS month, cell::BIGINT AS cell, CASE WHEN cell >= lead AND cell - lead < days THEN (month + (cell - lead)::INT)::VARCHAR END AS day FROM g""")
def month_grid(spark, d):
    months = t(spark, d, "orders").select(F.trunc("o_orderdate", "month").alias("month")).distinct()
    return relational.month_grid(months).select(F.col("month").cast("string").alias("month"), F.col("cell").cast("long").alias("cell"), F.col("day").cast("string").alias("day"))


@query("""WITH old AS (SELECT l_orderkey AS parent_id, list(l_linenumber::VARCHAR || ':' || md5(l_returnflag) ORDER BY l_linenumber, md5(l_returnflag)) AS had FROM lineitem WHERE l_shipdate < TIMESTAMP '1998-01-01' GROUP BY 1),
new AS (SELECT l_orderkey AS parent_id, list(l_linenumber::VARCHAR || ':' || md5(l_returnflag) ORDER BY l_linenumber, md5(l_returnflag)) AS want FROM lineitem WHERE l_returnflag <> 'R' GROUP BY 1)
SELECT parent_id, CASE WHEN want IS NULL THEN 'remove' WHEN had IS NOT DISTINCT FROM want THEN 'current' ELSE 'index' END AS plan FROM old FULL JOIN new USING (parent_id)""")
def backfill_plan(spark, d):
    x = t(spark, d, "lineitem").select(F.col("l_orderkey").alias("parent_id"), F.col("l_linenumber").alias("chunk_index"), F.md5("l_returnflag").alias("content_hash"), "l_shipdate", "l_returnflag")
    return relational.backfill_plan(x.where(F.col("l_shipdate") < F.lit("1998-01-01").cast("timestamp")), x.where("l_returnflag <> 'R'"))


@query("""WITH x AS (SELECT c_nationkey AS company_id, o_orderkey, o_totalprice AS v FROM orders JOIN customer ON o_custkey = c_custkey),
a AS (SELECT *, row_number() OVER (PARTITION BY company_id ORDER BY o_orderkey) AS r FROM x),
b AS (SELECT company_id, v AS permuted, row_number() OVER (PARTITION BY company_id ORDER BY md5('99:' || o_orderkey::VARCHAR), o_orderkey) AS r FROM x)
SELECT company_id, o_orderkey, v, permuted FROM a JOIN b USING (company_id, r)""")
def label_permutation(spark, d):
    o = t(spark, d, "orders").join(t(spark, d, "customer").select("c_custkey", F.col("c_nationkey").alias("company_id")), F.col("o_custkey") == F.col("c_custkey"))
    return stats.permuted(o.select("company_id", "o_orderkey", F.col("o_totalprice").alias("v")), "company_id", "o_orderkey", "v")


@query("""WITH w AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS w FROM documents), n AS (SELECT doc_id, w, count(*) AS n, sha256(w) AS h FROM w GROUP BY 1, 2),
s AS (SELECT doc_id, ('0x' || substr(h, 1, 8))::BIGINT % 256 AS dim, n::DOUBLE AS x FROM n UNION ALL SELECT doc_id, ('0x' || substr(h, 9, 8))::BIGINT % 256, n * -0.5::DOUBLE FROM n),
v AS (SELECT doc_id, dim, sum(x) AS x FROM s GROUP BY 1, 2 HAVING sum(x) <> 0) SELECT doc_id, dim, round(x / sqrt(sum(x * x) OVER (PARTITION BY doc_id)), 9) AS weight FROM v""")
def hashed_vectors(spark, d):
    return retrieval.hashed_vectors(t(spark, d, "documents"), "doc_id", "text").withColumn("weight", F.round("weight", 9))


_AFTER = ORACLE["price_kernel"].replace("['none', 'partial', 'full'][(l_orderkey % 3 + 1)::BIGINT]", "'full'").replace("(l_quantity::INT % 6) AS floor", "1 AS floor")


@query(f"""SELECT l_orderkey, before_cents, after_cents, after_cents - before_cents AS delta_cents, after_hours - before_hours AS delta_hours FROM
(SELECT l_orderkey, sum(total_cents)::BIGINT AS before_cents, sum(estimated_hours) AS before_hours FROM ({ORACLE["price_kernel"]}) GROUP BY 1)
JOIN (SELECT l_orderkey, sum(total_cents)::BIGINT AS after_cents, sum(estimated_hours) AS after_hours FROM ({_AFTER}) GROUP BY 1) USING (l_orderkey)""")
def requote_preview(spark, d):
    """What each order's jobs would cost with full packing from the first floor; both prices are made in one pass."""
    both = _priced(_priced(_jobs(spark, d), "b"), "a", {"packing": F.lit("full"), "floor": F.lit(1)})
    x = both.groupBy("l_orderkey")
    sums = x.agg(F.sum("b.total_cents").alias("before_cents"), F.sum("a.total_cents").alias("after_cents"), F.sum(F.col("a.estimated_hours") - F.col("b.estimated_hours")).alias("delta_hours"))
    return sums.select("l_orderkey", "before_cents", "after_cents", (F.col("after_cents") - F.col("before_cents")).alias("delta_cents"), "delta_hours")
