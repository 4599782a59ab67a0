"""Queries of lists, details, bound reads, defaults on first use, flat payloads and usage by turn."""

from __future__ import annotations

from pyspark.sql import functions as F

from cartage.operators import views
from cartage.plans.queries import ORACLE, _jobs, _priced, query, t


@query("""SELECT c_nationkey AS company_id, o_orderkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY o_orderdate DESC, o_orderkey) AS place FROM orders JOIN customer ON o_custkey = c_custkey
QUALIFY place <= least(greatest(CASE c_nationkey % 3 WHEN 0 THEN -5 WHEN 1 THEN 40 ELSE 5000 END, 1), 1000)""")
def history_list(spark, d):
    """Each company's newest moves, as many as it asks for: at least one, at most a thousand."""
    rows = t(spark, d, "orders").join(t(spark, d, "customer").select("c_custkey", F.col("c_nationkey").alias("company_id")), F.col("o_custkey") == F.col("c_custkey"))
    asked = F.when(F.col("company_id") % 3 == 0, -5).when(F.col("company_id") % 3 == 1, 40).otherwise(5000)
    return views.first_of_each(rows, "company_id", [F.desc("o_orderdate"), F.col("o_orderkey")], asked).select("company_id", "o_orderkey", F.col("place").cast("long").alias("place"))


@query("""WITH f AS (SELECT s_nationkey AS company_id, s_suppkey % 4 + 1 AS version, max(s_acctbal) AS rate FROM supplier WHERE s_nationkey % 4 <> 1 GROUP BY ALL), a AS (SELECT *, version = max(version) OVER (PARTITION BY company_id) AS is_active FROM f)
SELECT c_custkey, coalesce(version, 1) AS version, version IS NULL AS seeded, coalesce(rate, 140.0) AS rate FROM customer LEFT JOIN (SELECT * FROM a WHERE is_active) ON company_id = c_nationkey""")
def active_tariffs(spark, d):
    """The tariff that prices each customer: their company's active one, or the default, which is stored on first use."""
    f = t(spark, d, "supplier").where("s_nationkey % 4 <> 1").groupBy(F.col("s_nationkey").alias("company_id"), (F.col("s_suppkey") % 4 + 1).alias("version")).agg(F.max("s_acctbal").alias("rate"))
    newest = f.groupBy("company_id").agg(F.max("version").alias("__v"))
    configs = f.join(newest, "company_id").withColumn("is_active", F.col("version") == F.col("__v")).drop("__v")
    c = t(spark, d, "customer").select("c_custkey", F.col("c_nationkey").alias("company_id"))
    found, _ = views.seeded_configs(c, configs, {"rate": F.lit(140.0)})
    return found.select("c_custkey", F.col("version").cast("long").alias("version"), "seeded", "rate")


@query("""SELECT doc_id, sha256(coalesce(substr(text, 1, 40000), '')) AS text_sha, length(coalesce(text, '')) > 40000 AS truncated, coalesce(nullif(trim(source), ''), 'Company policy') AS heading FROM documents""")
def document_details(spark, d):
    """The detail of every document: up to 40 000 characters of its text and whether it was cut."""
    x = t(spark, d, "documents").select("doc_id", views.document_detail(F.col("text")).alias("x"), views.or_default(F.col("source"), views.HEADING).alias("heading"))
    return x.select("doc_id", F.sha2(F.coalesce("x.text", F.lit("")), 256).alias("text_sha"), "x.truncated", "heading")


@query("""WITH q AS (SELECT DISTINCT o_custkey AS quote_id FROM orders), s AS (SELECT DISTINCT conv_id AS quote_id FROM conversations)
SELECT quote_id, s.quote_id IS NULL AS created FROM q LEFT JOIN s USING (quote_id)""")
def conversation_threads(spark, d):
    """The conversation of every customer with an order: the stored one, or a new one, once for all their orders."""
    stored = t(spark, d, "conversations").select(F.col("conv_id").alias("quote_id")).distinct()
    every, _ = views.opened(t(spark, d, "orders").select(F.col("o_custkey").alias("quote_id")), stored, "quote_id", {})
    return every.select("quote_id", "created")


@query("""SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders WHERE (o_orderkey, o_custkey) IN (SELECT l_orderkey, l_partkey FROM lineitem) """)
def bound_quotes(spark, d):
    """Orders that a caller's scope owns, by both keys, with allowed fields only; line items stand for scopes."""
    scope = t(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_partkey").alias("o_custkey"))
    return views.bound(t(spark, d, "orders"), scope, ["o_orderkey", "o_custkey"], ["o_orderstatus", "o_totalprice"])


@query(f"""SELECT l_orderkey, l_linenumber, total_cents - subtotal_cents AS adjustment_cents, CASE WHEN total_cents = subtotal_cents THEN 'labor,travel' ELSE 'labor,travel,date_adjustment' END AS codes FROM ({ORACLE["price_kernel"]})""")
def line_item_codes(spark, d):
    """Line items as a customer sees them: code and amount, without what was computed beside them."""
    p = _priced(_jobs(spark, d), "p").withColumn("items", F.transform("p.line_items", lambda x: F.struct(x["code"].alias("code"), x["amount_cents"].alias("amount_cents"), F.lit("internal").alias("meta"))))
    seen = p.select("l_orderkey", "l_linenumber", views.without(F.col("items"), "meta", fields=("code", "amount_cents", "meta")).alias("items"))
    extra = F.aggregate(F.filter("items", lambda x: x["code"] == "date_adjustment"), F.lit(0).cast("long"), lambda a, x: a + x["amount_cents"])
    return seen.select("l_orderkey", "l_linenumber", extra.alias("adjustment_cents"), F.array_join("items.code", ",").alias("codes"))


@query("""SELECT event_id, json_extract_string(props, '$.k')::BIGINT AS payload_k, user_id AS payload_user, event_type AS kind FROM events""")
def flat_payloads(spark, d):
    """Nested payloads as flat columns."""
    e = t(spark, d, "events")
    nested = e.select("event_id", F.struct(F.get_json_object("props", "$.k").cast("long").alias("k"), F.col("user_id").alias("user")).alias("payload"), F.col("event_type").alias("kind"))
    return views.flattened(nested, "payload")


@query("""SELECT conv_id, turn, coalesce(sum(greatest(1, length(text) // 4)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS input_tokens, greatest(1, length(text) // 4) AS output_tokens
FROM conversations QUALIFY role = 'assistant'""")
def usage_by_turn(spark, d):
    """Tokens in and out of every answer."""
    return views.usage_by_turn(t(spark, d, "conversations"), "conv_id", "turn", F.col("role"), F.greatest(F.lit(1), F.floor(F.length("text") / 4)))


@query("""SELECT p_type AS category, array_to_string(list_transform(string_split(trim(regexp_replace(p_type, '[_\\-\\s]+', ' ', 'g')), ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ') AS title, count(*) AS n FROM part GROUP BY 1""")
def category_titles(spark, d):
    """Categories as headings of a page, with the entries of each."""
    return t(spark, d, "part").groupBy(F.col("p_type").alias("category")).agg(F.count(F.lit(1)).alias("n")).select("category", views.category_title(F.col("category")).alias("title"), "n")
