"""Queries of the import path: a sheet of text made from the driver's orders is read, judged, identified and kept."""

from __future__ import annotations

from pyspark.sql import functions as F

from cartage.functions import parse
from cartage.functions.staging import cut, shared_folder
from cartage.operators import imports
from cartage.plans.queries import query, t
from cartage.sources import commits

MAPPING = {"move_date": "Move Date", "home_size": "Size", "actual_hours": "Hours", "actual_crew_size": "Men", "actual_total_cents": "Total", "external_ref": "Job #"}
TODAY = "1998-06-01"
WRITTEN = ("1 bedroom", "2BR", " Two  bedroom ", "house", "castle", "Studio", "3bd")


def sheet(spark, d):
    """Rows of text with faults: unreadable dates, unknown sizes, missing outcomes, crews out of bounds, repeated job numbers."""
    k, p = F.col("o_orderkey"), F.col("o_custkey")
    none = (p % 7 == 0) & (k % 7 == 1)
    return t(spark, d, "orders").select(
        k.alias("row_number"), F.when(k % 7 == 5, "soon").otherwise(F.date_format("o_orderdate", "dd/MM/yyyy")).alias("Move Date"),
        F.element_at(F.array(*map(F.lit, WRITTEN)), (k % 7 + 1).cast("int")).alias("Size"),
        F.when(none, "").when(p % 11 == 0, "6:30").otherwise(F.concat((p % 50 + 1).cast("string"), F.lit(" hrs"))).alias("Hours"),
        (p % 25).cast("string").alias("Men"), F.when(none, " ").otherwise(F.concat(F.lit("$"), F.format_number("o_totalprice", 2))).alias("Total"),
        F.when(k % 4 == 0, F.concat(F.lit("J"), (k % 1000).cast("string"))).alias("Job #"),
    )


SHEET = """SELECT o_orderkey AS row_number, o_orderdate::DATE AS day, o_orderkey % 7 <> 5 AS dated, ['1br', '2br', '2br', '5br_plus', NULL, 'studio', '3br'][(o_orderkey % 7 + 1)::BIGINT] AS size,
CASE WHEN o_custkey % 7 = 0 AND o_orderkey % 7 = 1 THEN NULL WHEN o_custkey % 11 = 0 THEN 6.5 ELSE o_custkey % 50 + 1 END::DOUBLE AS hours, CASE WHEN o_custkey % 25 BETWEEN 1 AND 20 THEN o_custkey % 25 END AS men,
CASE WHEN NOT (o_custkey % 7 = 0 AND o_orderkey % 7 = 1) THEN (o_totalprice::DECIMAL(18,2) * 100)::BIGINT END AS cents, CASE WHEN o_orderkey % 4 = 0 THEN 'J' || (o_orderkey % 1000) END AS ref FROM orders"""
VALID = f"""WITH s AS ({SHEET}), v AS (SELECT *, (NOT dated)::INT + (size IS NULL)::INT + (hours IS NULL AND cents IS NULL)::INT + (dated AND day > DATE '{TODAY}')::INT AS n_errors, (men IS NULL)::INT AS n_warnings FROM s),
p AS (SELECT *, sha256(to_json([day::VARCHAR, size, NULL, NULL, hours::VARCHAR, men::VARCHAR, cents::VARCHAR, NULL])::VARCHAR) AS print FROM v),
g AS (SELECT *, ref IS NOT NULL AND row_number() OVER (PARTITION BY ref ORDER BY row_number) > 1 AS rd FROM p WHERE n_errors = 0),
h AS (SELECT *, CASE WHEN ref IS NOT NULL THEN rd ELSE coalesce(max((NOT rd)::INT) OVER (PARTITION BY print ORDER BY row_number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 1 END AS dup FROM g),
j AS (SELECT p.row_number, CASE WHEN p.n_errors > 0 THEN 'error' WHEN dup THEN 'duplicate' WHEN p.n_warnings > 0 THEN 'warning' ELSE 'ok' END AS status, p.n_errors, CASE WHEN dup THEN 1 ELSE p.n_warnings END AS n_warnings,
  CASE WHEN NOT dup THEN p.day END AS day, CASE WHEN NOT dup THEN p.size END AS size, CASE WHEN NOT dup THEN p.hours END AS hours, CASE WHEN NOT dup THEN p.men END AS men, CASE WHEN NOT dup THEN p.cents END AS cents,
  CASE WHEN p.n_errors = 0 THEN p.ref END AS external_ref, CASE WHEN p.n_errors = 0 AND p.ref IS NULL THEN p.print END AS row_hash FROM p LEFT JOIN h USING (row_number))"""


def judged(spark, d):
    return imports.judge(sheet(spark, d), MAPPING, TODAY, date_order="dmy", decimal_style="dot")


@query(VALID + " SELECT row_number, status, n_errors::INTEGER AS n_errors, n_warnings::INTEGER AS n_warnings, day::VARCHAR AS move_date, size AS home_size, hours AS actual_hours, men::BIGINT AS crew, cents AS total_cents, external_ref, row_hash FROM j")
def import_verdicts(spark, d):
    ref, row_hash = imports.identity(F.col("external_ref"), F.col("fingerprint"))
    return judged(spark, d).select("row_number", "status", F.size("errors").alias("n_errors"), F.size("warnings").alias("n_warnings"), F.col("move_date").cast("string").alias("move_date"), "home_size", "actual_hours", F.col("actual_crew_size").alias("crew"), F.col("actual_total_cents").alias("total_cents"), ref.alias("external_ref"), row_hash.alias("row_hash"))


@query(VALID + """ SELECT count(*) AS total, count(*) FILTER (status IN ('ok', 'warning')) AS importable, count(*) FILTER (status = 'warning') AS warnings, count(*) FILTER (status = 'error') AS rejected, count(*) FILTER (status = 'duplicate') AS duplicates FROM j""")
def import_counts(spark, d):
    return imports.counts(judged(spark, d))


@query(VALID + " SELECT row_number, status FROM j ORDER BY list_position(['error', 'warning', 'duplicate', 'ok'], status), row_number LIMIT 200")
def import_preview(spark, d):
    return imports.preview(judged(spark, d)).select("row_number", "status")


@query(f"""WITH s AS ({SHEET}), w AS (SELECT row_number, CASE WHEN dated THEN day(day) END AS a, CASE WHEN dated THEN month(day) END AS b, CASE WHEN cents IS NULL THEN '' ELSE format('{{:,.2f}}', cents / 100.0) END AS m FROM s),
v AS (SELECT row_number, CASE WHEN a > 12 THEN 'dmy' WHEN b > 12 THEN 'mdy' END AS dv, CASE WHEN m LIKE '%.%' AND m LIKE '%,%' THEN CASE WHEN strpos(reverse(m), '.') < strpos(reverse(m), ',') THEN 'dot' ELSE 'comma' END
  WHEN m LIKE '%.%' AND length(split_part(m, '.', 2)) <> 3 THEN 'dot' END AS mv FROM w)
SELECT min_by(dv, row_number) FILTER (dv IS NOT NULL) AS date_order, min_by(mv, row_number) FILTER (mv IS NOT NULL) AS decimal_style, count(dv) = 0 AS date_ambiguous, count(mv) = 0 AS money_ambiguous, 0 AS n_ambiguous FROM v""")
def import_file_options(spark, d):
    found = imports.file_options(sheet(spark, d), MAPPING)
    return found.select("date_order", "decimal_style", "date_ambiguous", "money_ambiguous", F.size("ambiguous_money_fields").alias("n_ambiguous"))


BATCHES = " SELECT (row_number % 3)::VARCHAR AS batch, external_ref, row_hash, status FROM j"


def history(spark, d):
    """The importable rows in three batches, beside as many rows of the platform's own as there are orders."""
    rows = judged(spark, d).where(F.col("status").isin("ok", "warning"))
    ref, row_hash = imports.identity(F.col("external_ref"), F.col("fingerprint"))
    own = t(spark, d, "orders").select(F.lit("platform").alias("source"), F.lit(None).cast("string").alias("import_batch_id"), F.lit(None).cast("string").alias("external_ref"), F.lit(None).cast("string").alias("row_hash"))
    return rows.select(F.lit("import").alias("source"), (F.col("row_number") % 3).cast("string").alias("import_batch_id"), ref.alias("external_ref"), row_hash.alias("row_hash")).unionByName(own)


@query(VALID + f""", k AS (SELECT * FROM ({BATCHES}) WHERE status IN ('ok', 'warning') AND batch <> '1')
SELECT 'import' AS source, batch, count(*) AS n, count(external_ref) AS refs, count(row_hash) AS hashes FROM k GROUP BY 2 UNION ALL SELECT 'platform', NULL, count(*), 0, 0 FROM orders""")
def import_revert(spark, d):
    """History after batch 1 is reverted: its imported rows go, the platform's stay."""
    empty = spark.createDataFrame([], "import_batch_id string, reverted_on date")
    left, _, _ = imports.revert(history(spark, d), empty, "1", TODAY)
    return left.groupBy("source", F.col("import_batch_id").alias("batch")).agg(F.count(F.lit(1)).alias("n"), F.count("external_ref").alias("refs"), F.count("row_hash").alias("hashes"))


@query("""WITH b AS (SELECT DISTINCT o_custkey % 500 AS batch, (o_custkey % 500) % 3 = 1 AS was FROM orders), a AS (SELECT c_custkey % 600 AS batch FROM customer GROUP BY 1)
SELECT a.batch::VARCHAR AS batch, CASE WHEN b.batch IS NULL THEN 'not_found' WHEN was THEN 'conflict' ELSE 'reverted' END AS verdict FROM a LEFT JOIN b USING (batch)""")
def import_revert_verdicts(spark, d):
    """What each asked revert comes to: batches of orders, a third of them reverted before, and batches that nobody made."""
    stamps = t(spark, d, "orders").select((F.col("o_custkey") % 500).alias("n")).distinct().select(F.col("n").cast("string").alias("import_batch_id"), F.when(F.col("n") % 3 == 1, F.to_date(F.lit("1998-01-01"))).alias("reverted_on"))
    asked = t(spark, d, "customer").select((F.col("c_custkey") % 600).cast("string").alias("batch")).distinct()
    return imports.revert_verdicts(asked, stamps, "batch")


@query("""WITH x AS (SELECT l_orderkey * 10 + l_linenumber AS row_number, CASE WHEN l_linenumber = 6 THEN NULL ELSE l_shipdate::DATE END AS day, l_linenumber <= 4 AS sized, l_quantity - 3 AS hours, l_suppkey % 14 AS crew, l_extendedprice AS total FROM lineitem)
SELECT row_number, CASE WHEN array_to_string(e, ',') = '' THEN round(total * 100)::BIGINT END AS cents, array_to_string(e, ',') AS errors FROM (SELECT *, list_filter([CASE WHEN day IS NULL THEN 'move_date' END, CASE WHEN NOT sized THEN 'home_size' END,
  CASE WHEN hours <= 0 THEN 'actual_hours' END, CASE WHEN crew NOT BETWEEN 1 AND 10 THEN 'actual_crew_size' END], lambda z: z IS NOT NULL) AS e FROM x)""")
def strict_import(spark, d):
    li = t(spark, d, "lineitem").select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("row_number"), F.when(F.col("l_linenumber") == 6, "1996/01/02").otherwise(F.date_format("l_shipdate", "yyyy-MM-dd")).alias("move_date"),
        F.element_at(F.array(*map(F.lit, ("studio", "1BR", " 2br", "3br", "cottage", "cottage", "cottage"))), F.col("l_linenumber")).alias("home_size"), F.lit("Partial").alias("packing_service"), F.lit("3.5").alias("distance_miles"),
        (F.col("l_quantity") - 3).cast("string").alias("actual_hours"), (F.col("l_suppkey") % 14).cast("string").alias("actual_crew_size"), F.col("l_extendedprice").cast("string").alias("actual_total_dollars"),
    )
    jobs = imports.strict_jobs(li)
    return jobs.select("row_number", F.when(F.size("errors") == 0, F.col("actual_total_cents")).alias("cents"), F.array_join("errors", ",").alias("errors"))


@query("""SELECT c_custkey, upper(left(n_name, 2)) AS state, CASE WHEN c_custkey % 9 = 0 THEN NULL ELSE lpad((c_custkey % 100000)::VARCHAR, 5, '0') END AS zip,
substr(lower(c_name) || '|' || CASE WHEN c_custkey % 9 = 0 THEN 'x!' ELSE lpad((c_custkey % 100000)::VARCHAR, 5, '0') END, 1, 320) AS building, floor(c_acctbal)::BIGINT - CASE WHEN c_acctbal < 0 AND floor(c_acctbal) <> c_acctbal THEN -1 ELSE 0 END AS whole,
c_custkey % 3 = 0 AS flag FROM customer JOIN nation ON c_nationkey = n_nationkey""")
def typed_cells(spark, d):
    """States, ZIPs, building keys, whole numbers and yes/no read back from text."""
    k = F.col("c_custkey")
    c = t(spark, d, "customer").join(F.broadcast(t(spark, d, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))
    zipped = F.when(k % 9 == 0, " X!").otherwise(F.lpad((k % 100000).cast("string"), 5, "0"))
    state = F.concat(F.lower(F.substring("n_name", 1, 1)), F.lit(". "), F.substring("n_name", 2, 1), F.lit("."))
    x = c.select("c_custkey", F.regexp_replace(state, " ", "").alias("state"), zipped.alias("zip"), F.concat(F.lit("  "), F.col("c_name"), F.lit(" ")).alias("street"), F.col("c_acctbal").cast("string").alias("number"), F.when(k % 3 == 0, " YES").otherwise("-").alias("flag"))
    return x.select("c_custkey", parse.parse_state(F.col("state")).alias("state"), parse.parse_zip(F.col("zip")).alias("zip"), parse.building_key(F.col("street"), F.col("zip")).alias("building"), parse.parse_int(F.col("number")).alias("whole"), parse.parse_bool(F.col("flag")).alias("flag"))


@query("""WITH s AS (SELECT count(*) AS total, count(o_orderdate) AS a, count(o_orderkey) AS b, count(CASE WHEN o_totalprice > 100000 THEN 1 END) AS c, count(o_orderpriority) AS e FROM orders)
SELECT field, header, 'exact' AS confidence, filled, total FROM s, LATERAL (VALUES ('move_date', 'Job Date', a), ('external_ref', 'Order ID', b), ('actual_total_cents', 'Final Amount ($)', c), ('notes', 'Remarks', e)) v(field, header, filled)""")
def header_mapping(spark, d):
    """Fields that the headers of an order export suggest, with how many of its rows fill each of them."""
    o = t(spark, d, "orders")
    export = o.select(F.col("o_orderdate").cast("string").alias("Job Date"), F.col("o_orderkey").cast("string").alias("Order ID"), F.when(F.col("o_totalprice") > 100_000, F.col("o_totalprice").cast("string")).alias("Final Amount ($)"), F.col("o_orderpriority").alias("Remarks"), F.col("o_orderstatus").alias("Status code"))
    return imports.suggested(export)


TWICE = VALID + f""", k AS (SELECT * FROM ({BATCHES}) WHERE status IN ('ok', 'warning'))"""


@query(TWICE + """, r AS (SELECT batch, count(*) AS n FROM k GROUP BY 1), a AS (SELECT (row_number % 3)::VARCHAR AS batch, count(*) AS total FROM j GROUP BY 1)
SELECT a.batch, total, n AS importable, batch = '1' AS reverted, CASE WHEN batch <> '1' THEN n ELSE 0 END AS stored FROM a JOIN r USING (batch)""")
def import_commits(spark, d):
    """Three batches stored with their provenance, one of them twice (a retry) and one reverted twice; read back from storage."""
    root = shared_folder(spark, "imports")
    every = cut(judged(spark, d).select("status", "errors", "warnings", "external_ref", "fingerprint", (F.col("row_number") % 3).cast("string").alias("batch")))
    for batch in ("0", "1", "2", "2"):
        rows, stamp = imports.batch_rows(every.where(F.col("batch") == batch).drop("batch"), "c1", batch, TODAY)
        commits.import_batch(spark, root, rows.select("company_id", "import_batch_id", "source", "external_ref", "row_hash"), stamp, batch)
    for _ in range(2):
        commits.revert_import(spark, root, "1", TODAY)
    stored = commits.read(spark, root, "history").groupBy(F.col("import_batch_id").alias("batch")).agg(F.count(F.lit(1)).alias("stored"))
    batches = commits.read(spark, root, "batches").select(F.col("import_batch_id").alias("batch"), "total", "importable", F.col("reverted_on").isNotNull().alias("reverted"))
    return batches.join(stored, "batch", "left").withColumn("stored", F.coalesce("stored", F.lit(0)))
