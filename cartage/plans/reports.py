"""Queries of the dashboard and of similar moves: signals over whole comparable sets, overviews, usage, invariants, upload plans."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from cartage.functions.staging import cut
from cartage.operators import relational, similarity, topk
from cartage.plans.queries import ORACLE, _jobs, _priced, query, t

MAX_CANDIDATES, WINDOW, TOP = 5_000, 2, 10


def _moves(spark, d):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    items = F.when(k % 4 == 0, F.array().cast("array<string>")).when(k % 4 == 1, F.array(F.lit("piano"))).when(k % 4 == 2, F.array(F.lit("piano"), F.lit("safe")))
    tags = F.when(k % 3 == 0, F.array(F.lit("Late "), F.lit("damage"))).when(k % 3 == 1, F.array(F.lit("damage")))
    o = t(spark, d, "orders").join(t(spark, d, "customer").select("c_custkey", F.col("c_nationkey").alias("tenant")), c == F.col("c_custkey"))
    return o.select(
        "tenant", k.alias("id"), F.col("o_orderdate").alias("day"), (k % 6).cast("int").alias("size"), F.when(c % 7 != 0, (c % 120).cast("double")).alias("miles"), (k % 4).cast("double").alias("stairs_o"), F.when(k % 5 != 0, (k % 3).cast("double")).alias("stairs_d"),
        (c % 6 + 1).cast("double").alias("floor_o"), (k % 2 == 0).alias("lift_o"), (k % 3).cast("int").alias("packing"), items.alias("items"), (c % 10).cast("string").alias("zip"), tags.alias("tags"), (k % 9 + 2).cast("double").alias("hours"), F.when(k % 8 != 0, (c % 9 + 2).cast("double")).alias("quoted"),
    )


def move_gaps(q: topk.Columns, c: topk.Columns) -> dict[str, np.ndarray]:
    s = lambda x, scale: similarity.scaled_gaps(q[x], c[x], scale)
    return {
        "home_size": s("size", len(similarity.HOME_SIZES) - 1.0), "distance_miles": s("miles", 50.0), "stairs": similarity.mean_gaps(s("stairs_o", 5.0), s("stairs_d", 5.0)), "floors": s("floor_o", 5.0), "elevators": s("lift_o", 1.0),
        "packing_service": s("packing", len(similarity.PACKING) - 1.0), "special_items": similarity.jaccard_gaps(q["items"], c["items"]), "geography": similarity.equal_gaps(q["zip"], c["zip"]),
    }


def _similar_moves(spark, d):
    """Comparable moves of each query (ids divisible by 100): same tenant, home size within two steps, the most recent candidates, scored and ranked."""
    m = _moves(spark, d).withColumn("items", F.to_json("items"))
    pool = cut(similarity.recent_pool(m, "tenant", "size", "day", "id", WINDOW, MAX_CANDIDATES))
    inside = pool.where((F.col("pool_size") == F.col("size")) & (F.col("id") % 100 == 0)).select("id", F.lit(True).alias("inside"))
    q = m.where("id % 100 = 0").join(inside, "id", "left").withColumns({"inside": F.coalesce("inside", F.lit(False)), "pool_size": F.col("size"), "query_id": F.col("id")})
    has = ["size", "miles", "stairs_o", "stairs_d", "floor_o", "lift_o", "packing", "items", "zip"]
    keep = ["tags", "hours", "quoted"]
    return similarity.best_of_pools(q.select("query_id", "tenant", "pool_size", "inside", *has), pool.select("id", "tenant", "pool_size", "pool_rank", *has, *keep), "tenant", move_gaps, TOP, MAX_CANDIDATES, keep).withColumnRenamed("query_id", "q_id")


MOVES = """WITH m AS (SELECT c_nationkey AS tenant, o_orderkey AS id, o_orderdate AS day, o_orderkey % 6 AS size, CASE WHEN o_custkey % 7 <> 0 THEN (o_custkey % 120)::DOUBLE END AS miles, (o_orderkey % 4)::DOUBLE AS so, CASE WHEN o_orderkey % 5 <> 0 THEN (o_orderkey % 3)::DOUBLE END AS sd, (o_custkey % 6 + 1)::DOUBLE AS fo, o_orderkey % 2 = 0 AS lift,
o_orderkey % 3 AS packing, CASE o_orderkey % 4 WHEN 0 THEN []::VARCHAR[] WHEN 1 THEN ['piano'] WHEN 2 THEN ['piano', 'safe'] END AS items, o_custkey % 10 AS zip, CASE o_orderkey % 3 WHEN 0 THEN ['late', 'damage'] WHEN 1 THEN ['damage'] END AS tags, (o_orderkey % 9 + 2)::DOUBLE AS hours, CASE WHEN o_orderkey % 8 <> 0 THEN (o_custkey % 9 + 2)::DOUBLE END AS quoted FROM orders JOIN customer ON o_custkey = c_custkey),
n AS (SELECT q.id AS q_id, m.*, abs(m.size - q.size) / 5.0 AS g1, CASE WHEN abs(m.miles - q.miles) IS NOT NULL THEN least(abs(m.miles - q.miles) / 50.0, 1) END AS g2, CASE WHEN m.sd IS NULL OR q.sd IS NULL THEN least(abs(m.so - q.so) / 5.0, 1) ELSE (least(abs(m.so - q.so) / 5.0, 1) + least(abs(m.sd - q.sd) / 5.0, 1)) / 2 END AS g3, least(abs(m.fo - q.fo) / 5.0, 1) AS g4, (m.lift <> q.lift)::INT AS g5, abs(m.packing - q.packing) / 2.0 AS g6,
  CASE WHEN m.items IS NOT NULL AND q.items IS NOT NULL THEN CASE WHEN len(m.items) + len(q.items) = 0 THEN 0 ELSE 1 - len(list_intersect(m.items, q.items)) / len(list_distinct(list_concat(m.items, q.items)))::DOUBLE END END AS g7, (m.zip <> q.zip)::INT AS g8
  FROM m JOIN m q ON q.tenant = m.tenant AND q.id % 100 = 0 AND m.id <> q.id AND abs(m.size - q.size) <= 2 QUALIFY row_number() OVER (PARTITION BY q.id ORDER BY m.day DESC, m.id) <= 5000),
s AS (SELECT *, 72 + CASE WHEN g2 IS NULL THEN 0 ELSE 20 END + CASE WHEN g7 IS NULL THEN 0 ELSE 8 END AS present, 30 * g1 + 20 * coalesce(g2, 0) + 12 * g3 + 10 * g4 + 8 * g5 + 8 * g6 + 8 * coalesce(g7, 0) + 4 * g8 AS gap FROM n),
r AS (SELECT *, round(1 - gap / present, 4) AS score, count(*) OVER (PARTITION BY q_id) AS comparable_count FROM s), k AS (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY score DESC, day DESC, id) AS place FROM r QUALIFY place <= 10)"""


@query(MOVES + " SELECT q_id, id, score, round(present / 100.0, 4) AS coverage, place FROM k")
def similar_moves(spark, d):
    return _similar_moves(spark, d).select("q_id", "id", "score", "coverage", F.col("place").cast("long").alias("place"))


@query(MOVES + """, e AS (SELECT *, CASE WHEN quoted <> 0 THEN round((hours - quoted) / quoted * 100, 2) END AS err FROM k), t AS (SELECT q_id, tag, count(*) AS n, min(place * 100 + pos) AS seen FROM (SELECT q_id, place, unnest(tags) AS tag, generate_subscripts(tags, 1) AS pos FROM k) GROUP BY ALL),
c AS (SELECT q_id, string_agg(tag, ',' ORDER BY n DESC, seen) AS common_tags FROM t GROUP BY 1)
SELECT e.q_id, any_value(comparable_count) AS comparable_count, count(hours) AS with_hours, count(err) AS with_estimate, round(median(hours), 2) AS median_hours, round(avg(hours), 2) AS mean_hours, round(CASE WHEN count(hours) >= 4 THEN quantile_cont(hours, 0.25) ELSE min(hours) END, 2) AS p25,
round(CASE WHEN count(hours) >= 4 THEN quantile_cont(hours, 0.75) ELSE max(hours) END, 2) AS p75, round(median(err), 3) AS median_error_pct, round(count(*) FILTER (err > 0) * 100 / nullif(count(err), 0), 1) AS overrun_share_pct, any_value(common_tags) AS common_tags FROM e LEFT JOIN c USING (q_id) GROUP BY 1""")
def move_signals(spark, d):
    """What the ten best matches of each query did; the count is over all comparable ones."""
    top = cut(_similar_moves(spark, d)).withColumn("err", F.when(F.col("quoted") != 0, F.round((F.col("hours") - F.col("quoted")) / F.col("quoted") * 100, 2)))
    quart = lambda p, few: F.round(F.when(F.count("hours") >= 4, F.expr(f"percentile(hours, {p})")).otherwise(few("hours")), 2)
    own = top.groupBy("q_id").agg(
        F.max("comparable_count").alias("comparable_count"), F.count("hours").alias("with_hours"), F.count("err").alias("with_estimate"), F.round(F.median("hours"), 2).alias("median_hours"), F.round(F.avg("hours"), 2).alias("mean_hours"), quart(0.25, F.min).alias("p25"),
        quart(0.75, F.max).alias("p75"), F.round(F.median("err"), 3).alias("median_error_pct"), F.round(F.try_divide(F.count_if(F.col("err") > 0) * 100, F.count("err")), 1).alias("overrun_share_pct"),
    )
    tag = top.select("q_id", "place", F.posexplode("tags").alias("pos", "tag")).groupBy("q_id", F.lower(F.trim("tag")).alias("tag")).agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("place", "pos")).alias("seen"))
    common = tag.groupBy("q_id").agg(F.array_join(F.transform(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), "seen", "tag"))), 1, 5), lambda s: s["tag"]), ",").alias("common_tags"))
    return own.join(common, "q_id", "left")


@query("""SELECT c_nationkey AS tenant, count(*) FILTER (o_orderstatus = 'O') AS drafts, count(*) FILTER (o_orderstatus = 'F') AS confirmed, string_agg(o_orderkey::VARCHAR, ',' ORDER BY rn) FILTER (rn <= 5) AS latest
FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY o_orderdate DESC, o_orderkey) AS rn FROM orders JOIN customer ON o_custkey = c_custkey) GROUP BY 1""")
def overview(spark, d):
    """Drafts and confirmed per tenant, and the five latest; the latest are found by a bounded aggregate, not by sorting a tenant."""
    o = t(spark, d, "orders").join(t(spark, d, "customer").select("c_custkey", F.col("c_nationkey").alias("tenant")), F.col("o_custkey") == F.col("c_custkey"))
    day = o.groupBy("tenant", F.to_date("o_orderdate").alias("on")).agg(F.count_if(F.col("o_orderstatus") == "O").alias("drafts"), F.count_if(F.col("o_orderstatus") == "F").alias("confirmed"), F.slice(F.array_sort(F.collect_list(F.struct((-F.expr("timestampdiff(SECOND, TIMESTAMP_NTZ'1970-01-01', o_orderdate)")).alias("at"), "o_orderkey"))), 1, 5).alias("l"))
    place = day.withColumn("__r", F.row_number().over(Window.partitionBy("tenant").orderBy(F.desc("on"))))
    late = F.slice(F.array_sort(F.flatten(F.collect_list(F.when(F.col("__r") <= 5, F.col("l"))))), 1, 5)
    return place.groupBy("tenant").agg(F.sum("drafts").alias("drafts"), F.sum("confirmed").alias("confirmed"), F.array_join(F.transform(late, lambda s: s["o_orderkey"].cast("string")), ",").alias("latest"))


@query("""SELECT m.conv_id, m.turn, m.role, c.tenant, sum(greatest(1, length(text) // 4)) OVER (PARTITION BY m.conv_id)::BIGINT AS tokens FROM conversations m JOIN (SELECT DISTINCT conv_id, conv_id % 7 AS tenant FROM conversations) c ON c.conv_id = m.conv_id AND c.tenant = m.conv_id % 7""")
def conversation_usage(spark, d):
    """Messages with their conversation, the tenant checked on both sides, and the tokens of the whole conversation."""
    m = t(spark, d, "conversations")
    c = m.select("conv_id", (F.col("conv_id") % 7).alias("tenant")).distinct()
    used = m.groupBy("conv_id").agg(F.sum(F.greatest(F.lit(1), F.floor(F.length("text") / 4))).cast("long").alias("tokens"))
    return m.withColumn("__t", F.col("conv_id") % 7).join(c, "conv_id").where(F.col("__t") == F.col("tenant")).join(used, "conv_id").select("conv_id", "turn", "role", "tenant", "tokens")


@query(f"""SELECT l_orderkey, l_linenumber, (estimated_hours * map {{2: 140, 3: 190, 4: 240, 5: 290}}[crew_size] * 100)::BIGINT AS labor_cents, true AS adds_up FROM ({ORACLE["price_kernel"]})""")
def price_line_items(spark, d):
    """The labour line of each price, and whether all lines add up to the total."""
    lines = F.col("p.line_items")
    total = F.aggregate(lines, F.lit(0).cast("long"), lambda a, x: a + x["amount_cents"])
    labour = F.try_element_at(F.filter(lines, lambda x: x["code"] == "labor"), F.lit(1))
    return _priced(_jobs(spark, d), "p").select("l_orderkey", "l_linenumber", labour["amount_cents"].alias("labor_cents"), (F.abs(total - F.col("p.total_cents")) <= 1).alias("adds_up"))


@query("""SELECT p_type, count(*) AS n, min(p_partkey) AS first_key, row_number() OVER (ORDER BY min(p_partkey)) AS position FROM part GROUP BY 1""")
def grouped_entries(spark, d):
    """Categories in the order in which they first occur, as a knowledge page lists them."""
    g = t(spark, d, "part").groupBy("p_type").agg(F.count(F.lit(1)).alias("n"), F.min("p_partkey").alias("first_key"))
    return g.withColumn("position", F.row_number().over(Window.orderBy("first_key")).cast("long"))  # one row a category


@query("""SELECT count(*) AS chunks, count(*) FILTER (l_returnflag <> 'R') AS active, count(*) FILTER (l_tax > 0) AS embedded, count(DISTINCT l_orderkey) FILTER (l_returnflag <> 'R') AS parents FROM lineitem""")
def index_stats(spark, d):
    x = t(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("l_returnflag") != "R").alias("a"), F.count_if(F.col("l_tax") > 0).alias("e"))
    return x.agg(F.sum("n").alias("chunks"), F.sum("a").alias("active"), F.sum("e").alias("embedded"), F.count_if(F.col("a") > 0).alias("parents"))


@query("""WITH x AS (SELECT doc_id, source, sha256('source:' || text) AS h, doc_id % 3 = 0 AS stored, doc_id % 6 = 0 AS deleted FROM documents), o AS (SELECT source, h, bool_or(NOT deleted) AS live FROM x WHERE stored GROUP BY ALL), l AS (SELECT source, count(*) FILTER (live) AS n FROM o GROUP BY 1),
u AS (SELECT x.*, live, row_number() OVER (PARTITION BY x.source, x.h ORDER BY doc_id) AS nth FROM x LEFT JOIN o ON o.source IS NOT DISTINCT FROM x.source AND o.h = x.h WHERE NOT stored),
g AS (SELECT *, CASE WHEN live OR nth > 1 THEN 'duplicate' WHEN live IS NOT NULL THEN 'revive' ELSE 'create' END AS step FROM u), w AS (SELECT g.*, coalesce(n, 0) AS had, count(*) FILTER (step <> 'duplicate') OVER (PARTITION BY g.source ORDER BY doc_id) AS rank FROM g LEFT JOIN l ON l.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, CASE WHEN step <> 'duplicate' AND had + rank > 200 THEN 'refused' ELSE step END AS step FROM w""")
def upload_plan(spark, d):
    """Uploads of each source against what is stored: duplicates of live files, deleted files that come back, new ones, and those beyond 200 live files."""
    return relational.upload_plan(t(spark, d, "documents").select("doc_id", "source", F.sha2(F.concat(F.lit("source:"), F.col("text")), 256).alias("h")), "doc_id % 3 = 0", "doc_id % 6 = 0")
