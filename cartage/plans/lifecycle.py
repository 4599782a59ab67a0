"""Queries of quotes, documents, entries, payments, requests and distances; the driver's tables stand for them."""

from __future__ import annotations

from pyspark.sql import functions as F

from cartage.operators import geo, lifecycle, pricing
from cartage.plans.queries import query, t

NOW = "1996-06-01"


def quotes(spark, d):
    k = F.col("o_orderkey")
    status = F.when(F.col("o_orderstatus") == "F", "sent").when(F.col("o_orderstatus") == "O", "draft").otherwise("accepted")
    low = F.round(F.col("o_totalprice") * 100).cast("long")
    return t(spark, d, "orders").select(
        k.alias("quote_id"), status.alias("status"), (F.col("o_orderdate") + F.expr("INTERVAL 30 DAYS")).alias("valid_until"), F.element_at(F.array(*map(F.lit, ("approve", "accept", "decline"))), (k % 3 + 1).cast("int")).alias("action"),
        low.alias("amount_min_cents"), (low + 10_000).alias("amount_max_cents"), (F.col("o_custkey") % 4 == 0).alias("reviewed"), (F.col("o_custkey") % 6).alias("new_floor"), (F.col("o_custkey") % 3).alias("floor"), F.lit(None).cast("long").alias("superseded_by"),
    )


QUOTES = """WITH q AS (SELECT o_orderkey AS quote_id, CASE o_orderstatus WHEN 'F' THEN 'sent' WHEN 'O' THEN 'draft' ELSE 'accepted' END AS status, o_orderdate + INTERVAL 30 DAY AS valid_until, ['approve', 'accept', 'decline'][(o_orderkey % 3 + 1)::BIGINT] AS action,
round(o_totalprice * 100)::BIGINT AS low, o_custkey % 4 = 0 AS reviewed, o_custkey % 6 AS new_floor, o_custkey % 3 AS floor FROM orders)"""


@query(QUOTES + f""", s AS (SELECT *, CASE WHEN status = 'sent' AND valid_until < TIMESTAMP '{NOW}' THEN 'expired' ELSE status END AS now_is, quote_id % 5 = 0 AS bad FROM q),
e AS (SELECT *, CASE WHEN action = 'approve' THEN CASE WHEN status <> 'draft' THEN 'only drafts can be approved' WHEN bad THEN 'invalid range' END WHEN now_is = 'expired' THEN 'expired' WHEN now_is <> 'sent' THEN 'not on offer' END AS error FROM s)
SELECT quote_id, CASE WHEN error IS NOT NULL THEN now_is WHEN action = 'approve' THEN 'sent' WHEN action = 'accept' THEN 'accepted' ELSE 'declined' END AS status, error, CASE WHEN error IS NULL AND action = 'accept' THEN 'booked' WHEN error IS NULL AND action = 'decline' THEN 'lost' END AS lead_status, error IS NULL AND action = 'accept' AS booked FROM e""")
def quote_lifecycle(spark, d):
    q = quotes(spark, d)
    low = F.when(F.col("quote_id") % 5 == 0, F.col("amount_max_cents")).otherwise(F.col("amount_min_cents"))
    step = lifecycle.quote_step(F.col("status"), F.col("action"), F.col("valid_until"), F.lit(NOW).cast("timestamp_ntz"), low, F.when(F.col("quote_id") % 5 == 0, F.col("amount_min_cents")).otherwise(F.col("amount_max_cents")))
    return q.select("quote_id", step.alias("s")).select("quote_id", "s.status", "s.error", "s.lead_status", "s.booked")


@query(QUOTES + """, o AS (SELECT *, (low * 0.88)::BIGINT AS own_low, (low * 1.12)::BIGINT AS own_high FROM q), g AS (SELECT *, CASE WHEN quote_id % 4 = 0 THEN own_high + 1 WHEN quote_id % 4 = 1 THEN own_low - 5 END AS new_low, CASE WHEN quote_id % 6 = 2 THEN -5 WHEN quote_id % 6 = 4 THEN own_high + 100 END AS new_high FROM o),
b AS (SELECT *, coalesce(new_low, own_low) AS lo, coalesce(new_high, own_high) AS hi, new_low IS NOT NULL OR new_high IS NOT NULL AS given FROM g), e AS (SELECT *, CASE WHEN status <> 'draft' THEN 'only drafts can be approved' WHEN given AND NOT (lo > 0 AND hi >= lo) THEN 'invalid range' END AS error FROM b)
SELECT quote_id, error, error IS NULL AND given AS adjusted, CASE WHEN error IS NULL AND given THEN lo ELSE own_low END AS amount_min_cents, CASE WHEN error IS NULL AND given THEN hi ELSE own_high END AS amount_max_cents FROM e""")
def quote_adjustments(spark, d):
    """Approvals that set both bounds, one or none of a quote's range; the other bound is the quote's own."""
    q = quotes(spark, d)
    k, low = F.col("quote_id"), F.round(F.col("amount_min_cents").cast("decimal(18,0)") * F.lit("0.88").cast("decimal(3,2)")).cast("long")
    high = F.round(F.col("amount_min_cents").cast("decimal(18,0)") * F.lit("1.12").cast("decimal(3,2)")).cast("long")
    new_low = F.when(k % 4 == 0, high + 1).when(k % 4 == 1, low - 5)
    new_high = F.when(k % 6 == 2, F.lit(-5).cast("long")).when(k % 6 == 4, high + 100)
    step = lifecycle.quote_step(F.col("status"), F.lit("approve"), F.col("valid_until"), F.lit(NOW).cast("timestamp_ntz"), new_low, new_high, low, high)
    return q.select(k, step.alias("s")).select("quote_id", "s.error", "s.adjusted", "s.amount_min_cents", "s.amount_max_cents")


@query(QUOTES + """, x AS (SELECT *, CASE WHEN quote_id % 4 = 0 THEN 0 WHEN quote_id % 4 = 1 THEN least(5000, low) ELSE CASE WHEN round_even(low * 10 / 100.0, 0) < 100 THEN 0 ELSE least(round_even(low * 10 / 100.0, 0)::BIGINT, low) END END AS deposit FROM q),
c AS (SELECT *, CASE WHEN status = 'accepted' THEN 'accepted already' WHEN status <> 'sent' THEN 'not payable' WHEN deposit <= 0 THEN 'no deposit' END AS error FROM x)
SELECT quote_id, CASE WHEN status <> 'draft' THEN low END AS shown_cents, CASE WHEN status = 'sent' THEN 'change_date,edit_move,accept_quote' ELSE '' END AS actions, CASE WHEN status = 'accepted' THEN 'booked already' WHEN status <> 'sent' THEN 'closed' WHEN reviewed THEN 'the company confirms changes' END AS edit_refusal,
error AS checkout_error, CASE WHEN error IS NULL THEN deposit END AS checkout_cents FROM c""")
def quote_page(spark, d):
    """What a customer sees of a quote: price, actions, whether it may be edited, the deposit to pay."""
    q = quotes(spark, d)
    kind = F.element_at(F.array(*map(F.lit, ("none", "fixed", "percent", "percent"))), (F.col("quote_id") % 4 + 1).cast("int"))
    deposit = pricing.deposit_cents(kind, F.when(kind == "fixed", 5000).otherwise(10), F.col("amount_min_cents"))
    pay = lifecycle.checkout(F.col("status"), deposit)
    shown = lifecycle.public_view(F.col("status"), {"low": F.col("amount_min_cents")})
    return q.select("quote_id", shown["low"].alias("shown_cents"), F.array_join(lifecycle.quote_actions(F.col("status")), ",").alias("actions"), lifecycle.edit_refusal(F.col("status"), F.col("reviewed")).alias("edit_refusal"), pay["error"].alias("checkout_error"), pay["amount_cents"].alias("checkout_cents"))


@query(QUOTES + """ SELECT status, count(*) AS n, sum(floor)::BIGINT AS floors, count(superseded_by) AS pointers, count(supersedes) AS revisions FROM (
SELECT CASE WHEN status = 'sent' AND edited THEN 'superseded' ELSE status END AS status, floor, CASE WHEN status = 'sent' AND edited THEN quote_id + 10000000 END AS superseded_by, NULL AS supersedes FROM (SELECT *, quote_id % 2 = 0 AND new_floor <> floor AS edited FROM q)
UNION ALL SELECT status, new_floor, NULL, quote_id FROM q WHERE status = 'sent' AND quote_id % 2 = 0 AND new_floor <> floor) GROUP BY 1""")
def quote_revisions(spark, d):
    """Sent quotes whose floor is edited get a revision; both are kept and point to each other."""
    q = quotes(spark, d)
    changed = q.where("quote_id % 2 = 0").select("quote_id", F.col("new_floor").alias("floor"), lifecycle.changes({"floor": F.col("floor")}, {"floor": F.col("new_floor")}).alias("c")).where(F.size("c") > 0).drop("c")
    old, new = lifecycle.revise(q, changed, "quote_id", F.col("quote_id") + 10_000_000)
    return old.unionByName(new).groupBy("status").agg(F.count(F.lit(1)).alias("n"), F.sum("floor").alias("floors"), F.count("superseded_by").alias("pointers"), F.count("supersedes").alias("revisions"))


@query("""WITH x AS (SELECT doc_id, text, lang, doc_id > min(doc_id) OVER (PARTITION BY sha256('text:' || text)) AS dup, doc_id % 4 AS n, doc_id % 3 AS e FROM documents),
r AS (SELECT *, CASE WHEN lang = 'fr' THEN 'unknown kind' WHEN length(text) < 80 THEN 'too little text' WHEN dup THEN 'same text as another document' WHEN n = 0 THEN 'no passages' END AS reason FROM x)
SELECT doc_id, CASE WHEN reason IS NULL THEN 'ready' ELSE 'failed' END AS status, reason, reason IS NULL AND e < n AS keyword_only, reason IS NOT NULL AS can_retry FROM r""")
def document_lifecycle(spark, d):
    """Ingest verdicts: texts of French documents stand for unknown kinds, of equal texts the first document is kept."""
    x = t(spark, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), "lang", F.sha2(F.concat(F.lit("text:"), F.col("text")), 256).alias("h"))
    first = x.groupBy("h").agg(F.min("doc_id").alias("first"))
    both = x.select("doc_id", "h", F.length("text").alias("size"), "lang").join(first, "h")
    step = lifecycle.document_status(F.when(F.col("lang").isNull() | (F.col("lang") != "fr"), "txt"), F.col("size"), F.col("doc_id") > F.col("first"), F.col("doc_id") % 3, F.col("doc_id") % 4)
    return both.select("doc_id", step.alias("s")).select("doc_id", "s.*")


@query("""SELECT event_id, CASE WHEN event_type IN ('purchase', 'click') THEN CASE WHEN value > 50 THEN 'succeeded' ELSE 'ignored' END WHEN event_type = 'error' THEN 'failed' WHEN event_type = 'logout' THEN 'expired' ELSE 'ignored' END AS kind,
coalesce(json_extract_string(props, '$.k')::INT, -1) AS k, coalesce(json_extract_string(props, '$.none')::INT, 7) AS fallback FROM events""")
def payment_events(spark, d):
    """Provider events as kinds, and settings read from JSON with defaults."""
    e = t(spark, d, "events")
    # Which of the driver's event types stand for the provider's.
    names = {"purchase": "checkout.session.completed", "click": "checkout.session.async_payment_succeeded", "error": "checkout.session.async_payment_failed", "logout": "checkout.session.expired"}
    kind = F.lit("other")
    for own, theirs in names.items():
        kind = F.when(F.col("event_type") == own, theirs).otherwise(kind)
    return e.select("event_id", lifecycle.payment_kind(kind, F.when(F.col("value") > 50, "paid")).alias("kind"), lifecycle.setting(F.col("props"), "k", -1, "int").alias("k"), lifecycle.setting(F.col("props"), "none", 7, "int").alias("fallback"))


@query("""SELECT c_custkey, array_to_string(list_filter([CASE WHEN c_custkey % 9 = 0 THEN 'zip' END, CASE WHEN c_custkey % 8 = 0 THEN 'state' END, CASE WHEN c_nationkey * 6 NOT BETWEEN 1 AND 100 THEN 'floor' END, CASE WHEN c_nationkey > 20 THEN 'stairs_flights' END,
CASE WHEN c_custkey % 5 = 0 THEN 'move_date' END, CASE WHEN c_custkey % 30 > 20 THEN 'special_items' END, CASE WHEN c_custkey % 4 = 0 THEN 'email' END], lambda x: x IS NOT NULL), ',') AS problems FROM customer""")
def request_checks(spark, d):
    k, n = F.col("c_custkey"), F.col("c_nationkey")
    zipped = F.when(k % 9 == 0, "1234").otherwise(F.lpad((k % 100000).cast("string"), 5, "0"))
    found = lifecycle.request_problems(
        zipped, F.when(k % 8 == 0, "Texas").otherwise("tx"), n * 6, n, F.when(k % 5 == 0, F.lit("1996-05-31")).otherwise(F.lit(NOW)).cast("date"), F.lit(NOW).cast("date"),
        F.array_repeat(F.lit("piano"), (k % 30).cast("int")), F.when(k % 4 == 0, "nobody").otherwise("a@b.example"),
    )
    return t(spark, d, "customer").select("c_custkey", F.array_join(found, ",").alias("problems"))


@query("""WITH o AS (SELECT p_partkey AS id, p_name AS title, p_size > 10 AS is_active FROM part WHERE p_partkey % 5 <> 0), n AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 3 = 0 THEN upper(p_name) ELSE p_name END AS title, p_size > 20 AS is_active FROM part WHERE p_partkey % 7 <> 0)
SELECT coalesce(o.id, n.id) AS id, CASE WHEN o.id IS NULL THEN 'create' WHEN n.id IS NULL THEN 'delete' WHEN o.title <> n.title THEN 'reindex' WHEN o.is_active <> n.is_active THEN 'visibility' ELSE 'keep' END AS step FROM o FULL JOIN n ON o.id = n.id""")
def entry_plan(spark, d):
    p = t(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("title"), "p_size")
    old = p.where("id % 5 <> 0").select("id", "title", (F.col("p_size") > 10).alias("is_active"))
    new = p.where("id % 7 <> 0").select("id", F.when(F.col("id") % 3 == 0, F.upper("title")).otherwise(F.col("title")).alias("title"), (F.col("p_size") > 20).alias("is_active"))
    return lifecycle.entry_step(old, new, "id", ["title"])


@query("""WITH s AS (SELECT l_orderkey AS parent_id, l_linenumber AS chunk_index, 1 + l_orderkey % 3 AS generation FROM lineitem WHERE l_orderkey % 4 <> 0), f AS (SELECT l_orderkey AS parent_id, l_linenumber AS chunk_index FROM lineitem WHERE l_orderkey % 6 = 0)
SELECT parent_id, generation, count(*) AS n FROM (SELECT * FROM s WHERE parent_id NOT IN (SELECT parent_id FROM f) UNION ALL SELECT parent_id, chunk_index, coalesce((SELECT max(generation) FROM s WHERE s.parent_id = f.parent_id), 0) + 1 FROM f) GROUP BY 1, 2""")
def generation_swap(spark, d):
    x = t(spark, d, "lineitem").select(F.col("l_orderkey").alias("parent_id"), F.col("l_linenumber").alias("chunk_index"))
    stored = x.where("parent_id % 4 <> 0").withColumn("generation", 1 + F.col("parent_id") % 3)
    return lifecycle.swap_generation(stored, x.where("parent_id % 6 = 0")).groupBy("parent_id", "generation").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH m AS (SELECT n_regionkey AS company, n_nationkey AS version, CASE n_nationkey % 4 WHEN 0 THEN 'active' WHEN 1 THEN 'retired' ELSE 'shadow' END AS status FROM nation), c AS (SELECT r_regionkey AS company, (SELECT max(version) FROM m WHERE company = r_regionkey) - r_regionkey % 2 AS v FROM region),
h AS (SELECT m.*, coalesce(version = v AND status <> 'retired', false) AS hit FROM m JOIN c USING (company)), w AS (SELECT *, bool_or(hit) OVER (PARTITION BY company) AS works FROM h)
SELECT company, version, CASE WHEN hit THEN 'active' WHEN works AND status = 'active' THEN 'retired' ELSE status END AS status FROM w""")
def model_promotion(spark, d):
    """Nations stand for model versions, regions for companies; each chooses its last version or the number before it."""
    m = t(spark, d, "nation").select(F.col("n_regionkey").alias("company"), F.col("n_nationkey").alias("version"), F.when(F.col("n_nationkey") % 4 == 0, "active").when(F.col("n_nationkey") % 4 == 1, "retired").otherwise("shadow").alias("status"))
    chosen = m.groupBy("company").agg((F.max("version") - F.col("company") % 2).alias("version"))
    return lifecycle.promote(m, "company", "version", chosen)


@query("""WITH j AS (SELECT c_custkey AS job, CASE WHEN c_custkey % 3 <> 0 THEN lpad((c_nationkey * 37 % 100000)::VARCHAR, 5, '0') END AS o, lpad((c_custkey % 40 * 11)::VARCHAR, 5, '0') AS z, CASE WHEN c_custkey % 4 = 0 THEN 12.5 END AS own FROM customer)
SELECT job, coalesce(own, CASE WHEN o IS NULL THEN NULL WHEN o = '00037' THEN 99.0 WHEN o = z THEN 3.0 ELSE (5 + abs(o::INT - z::INT) % 56)::DOUBLE END) AS miles, own IS NULL AND o IS NOT NULL AS derived FROM j""")
def job_distances(spark, d):
    """Distances of jobs: their own, remembered ones for one ZIP, else the steady source's for every new pair once."""
    k = F.col("c_custkey")
    jobs = t(spark, d, "customer").select(k.alias("job"), F.when(k % 3 != 0, F.lpad((F.col("c_nationkey") * 37 % 100000).cast("string"), 5, "0")).alias("origin_zip"), F.concat(F.lit(" "), F.lpad((k % 40 * 11).cast("string"), 5, "0")).alias("destination_zip"), F.when(k % 4 == 0, 12.5).alias("distance_miles"))
    known = spark.range(40).select(F.lit("00037").alias("origin_zip"), F.lpad((F.col("id") * 11).cast("string"), 5, "0").alias("destination_zip"), F.lit(99.0).alias("miles"))
    memo = geo.resolved(jobs, known, geo.steady_distance(F.col("origin_zip"), F.col("destination_zip")))
    return geo.with_distances(jobs, memo).select("job", "miles", "derived")


@query("""SELECT o_orderkey, '$' || format('{:,.2f}', o_totalprice) AS price, lower(o_orderpriority[3:]) AS title, '.pdf' AS extension, split_part(o_orderpriority, '-', 1) AS hop FROM orders""")
def display_labels(spark, d):
    """Prices as text, titles and extensions from file names, the first hop of a forwarding header."""
    name = F.concat(F.lit("in/box\\"), F.lower(F.expr("substring(o_orderpriority, 3)")), F.lit(".PDF"))
    return t(spark, d, "orders").select("o_orderkey", lifecycle.money(F.round(F.col("o_totalprice") * 100)).alias("price"), lifecycle.title_of(name).alias("title"), lifecycle.extension_of(name).alias("extension"), lifecycle.first_hop(F.concat(F.substring("o_orderpriority", 1, 1), F.lit(" , 10.0.0.1"))).alias("hop"))


@query("""SELECT l_orderkey AS job_id, l_linenumber AS part, o_custkey AS customer, o_orderdate::DATE::VARCHAR AS move_date, l_quantity AS actual_hours, '{"hours":' || l_quantity::VARCHAR || ',"cents":' || (round(l_extendedprice * 100)::BIGINT)::VARCHAR || '}' AS snapshot
FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey WHERE l_linestatus = 'F'""")
def job_rows(spark, d):
    """Finished work with its order and customer as one flat row and the inputs as JSON."""
    li, o, c = (t(spark, d, n) for n in ("lineitem", "orders", "customer"))
    x = li.where("l_linestatus = 'F'").join(o, F.col("o_orderkey") == F.col("l_orderkey")).join(c.select("c_custkey"), F.col("c_custkey") == F.col("o_custkey"))
    snapshot = F.to_json(F.struct(F.col("l_quantity").alias("hours"), F.round(F.col("l_extendedprice") * 100).cast("long").alias("cents")))
    return x.select(F.col("l_orderkey").alias("job_id"), F.col("l_linenumber").alias("part"), F.col("o_custkey").alias("customer"), F.to_date("o_orderdate").cast("string").alias("move_date"), F.col("l_quantity").alias("actual_hours"), snapshot.alias("snapshot"))
