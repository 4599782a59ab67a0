"""Lists, details, defaults and flat payloads on small rows."""

from pyspark.sql import functions as F

from cartage.operators import views


def test_lists_are_clamped(spark):
    asked = spark.createDataFrame([(-3,), (0,), (7,), (99999,)], "n int")
    assert [r[0] for r in asked.select(views.clamped(F.col("n"))).collect()] == [1, 1, 7, 1000]
    rows = spark.createDataFrame([("a", i) for i in range(5)] + [("b", 9)], "o string, v int")
    got = views.first_of_each(rows, "o", [F.desc("v")], F.lit(2)).collect()
    assert {(r.o, r.v, r.place) for r in got} == {("a", 4, 1), ("a", 3, 2), ("b", 9, 1)}


def test_a_company_without_a_tariff_gets_the_default_once(spark):
    companies = spark.createDataFrame([(1,), (2,), (3,), (3,)], "company_id int")
    configs = spark.createDataFrame([(1, 1, False, 5.0), (1, 2, True, 6.0), (2, 1, False, 7.0)], "company_id int, version int, is_active boolean, rate double")
    found, new = views.seeded_configs(companies, configs, {"rate": F.lit(1.0)})
    assert sorted((r.company_id, r.version, r.seeded, r.rate) for r in found.collect()) == [(1, 2, False, 6.0), (3, 1, True, 1.0), (3, 1, True, 1.0)]  # 2 has switched its own off
    assert [(r.company_id, r.version, r.is_active, r.rate) for r in new.collect()] == [(3, 1, True, 1.0)]


def test_details_are_cut_and_empty_ones_null(spark):
    df = spark.createDataFrame([("x" * 40_000,), ("x" * 40_001,), ("",), (None,)], "t string")
    got = [r.d for r in df.select(views.document_detail(F.col("t")).alias("d")).collect()]
    assert [(x.text and len(x.text), x.truncated) for x in got] == [(40_000, False), (40_000, True), (None, False), (None, False)]


def test_threads_are_opened_once(spark):
    keys = spark.createDataFrame([(1, "c"), (1, "c"), (2, "c"), (3, "d")], "quote int, company string")
    stored = spark.createDataFrame([(2, "c", "old")], "quote int, company string, note string")
    every, new = views.opened(keys, stored, "quote", {"note": F.lit("new")})
    assert sorted((r.quote, r.note, r.created) for r in every.collect()) == [(1, "new", True), (2, "old", False), (3, "new", True)]
    assert sorted(r.quote for r in new.collect()) == [1, 3]


def test_payloads_are_flat_and_reads_are_bound(spark):
    df = spark.createDataFrame([(1, (2, True), "k")], "id int, origin struct<floor: int, lift: boolean>, kind string")
    assert views.flattened(df, "origin").columns == ["id", "origin_floor", "origin_lift", "kind"]
    rows = spark.createDataFrame([(1, "a", "secret"), (2, "b", "secret")], "id int, own string, token string").withColumn("tenant", F.col("id") % 2)
    scope = spark.createDataFrame([(1, 1), (2, 1)], "id int, tenant int")
    assert [tuple(r) for r in views.bound(rows, scope, ["id", "tenant"], ["own"]).collect()] == [(1, 1, "a")]
    one = spark.range(1).select(views.answered(F.array(F.lit("x")), F.lit(True)).alias("f"), views.answered(F.lit(None).cast("array<string>"), F.lit(False)).alias("e"), views.category_title(F.lit("refund_policy - EU")).alias("c"), views.or_default(F.lit("  "), "policy").alias("d")).first()
    assert (one.f, one.e, one.c, one.d) == (None, [], "Refund Policy Eu", "policy")


def test_usage_counts_what_stands_before_an_answer(spark):
    rows = spark.createDataFrame([(1, 0, "user", 5), (1, 1, "assistant", 7), (1, 2, "user", 2), (1, 3, "assistant", 3), (2, 0, "assistant", 4)], "c int, turn int, role string, n int")
    got = views.usage_by_turn(rows, "c", "turn", F.col("role"), F.col("n")).collect()
    assert sorted(tuple(r) for r in got) == [(1, 1, 5, 7), (1, 3, 14, 3), (2, 0, 0, 4)]
