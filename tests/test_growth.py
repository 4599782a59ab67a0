"""Work that must not grow with the square of a group: rows that any step of a plan makes, and results on many equal rows."""

import duckdb
import pytest
from pyspark.sql import functions as F

from cartage.operators import evidence, imports, retrieval, topk, vector_index
from cartage.plans import knowledge, queries, reports  # noqa: F401
from test_queries import plain


def most_rows(df):
    """(rows of the result, the most rows that an operator of the executed plan put out)."""
    rows = df.collect()

    def walk(plan):
        kind = plan.getClass().getSimpleName()
        inner = [plan.executedPlan()] if kind == "AdaptiveSparkPlanExec" else [plan.plan()] if kind.endswith("QueryStageExec") else []
        children = plan.children()
        inner += [children.apply(i) for i in range(children.size())]
        m = plan.metrics().get("numOutputRows")
        return max([m.get().value() if m.isDefined() else 0, *map(walk, inner)])

    return rows, walk(df._jdf.queryExecution().executedPlan())


def test_lexical_arm_meets_equal_texts_and_questions_once(spark):
    chunks = spark.range(3000).select(F.col("id").alias("chunk_id"), F.concat(F.lit("harp and piano "), (F.col("id") % 3).cast("string"), F.lit("00")).alias("text"))
    asked = spark.range(300).select(F.col("id").alias("query_id"), F.lit("piano harp").alias("text"))
    rows, most = most_rows(evidence.lexical_arm(chunks, asked))
    first = chunks.select("chunk_id", F.sha2(F.concat(F.lit("text:"), "text"), 256).alias("h")).orderBy("h", "chunk_id").limit(20).collect()
    want = {(q, r.chunk_id, i + 1) for q in range(300) for i, r in enumerate(first)}
    assert {tuple(r) for r in rows} == want and len(rows) == len(want)
    assert most <= 10_000  # 300 x 3000 pairs by the common word


def parts(spark, folder, n):
    """``n`` parts of few texts."""
    k = F.col("id")
    names = F.concat(F.lit("harp "), F.element_at(F.array(*map(F.lit, ("ring", "gear", "bolt"))), (k % 3 + 1).cast("int")))
    p = spark.range(n).select(k.alias("p_partkey"), names.alias("p_name"), F.concat(F.lit("Brand#"), (k % 2).cast("string")).alias("p_brand"), F.lit("LARGE").alias("p_type"), (k % 50 + 1).cast("int").alias("p_size"), (900 + k % 1000 / 10).alias("p_retailprice"))
    p.write.parquet(f"{folder}/part.parquet")
    return str(folder)


@pytest.mark.parametrize("name", ["retrieval_evaluation", "recommended_depth"])
def test_judging_the_lexical_arm_meets_equal_texts_once(spark, tmp_path, name):
    rows, most = most_rows(queries.QUERIES[name](spark, parts(spark, tmp_path, 6000)))
    assert len(rows) >= 1 and most <= 12_000  # 60 x 2 000 pairs by the rarest word


def test_hybrid_search_has_one_vector_a_text(spark, tmp_path, monkeypatch):
    seen, fit = [], vector_index.fit
    monkeypatch.setattr(vector_index, "fit", lambda vectors, *a: seen.append(vectors.count()) or fit(vectors, *a))
    got = queries.QUERIES["hybrid_search"](spark, parts(spark, tmp_path, 6000)).collect()
    assert seen == [6] and {r.query_id for r in got} == set(range(0, 6000, 100))


def test_chunks_of_one_text_are_found_as_if_each_had_a_vector(spark):
    words = F.element_at(F.array(*map(F.lit, ("piano move", "piano fee", "move piano", "box", "fee box piano"))), (F.col("id") * 7 % 5 + 1).cast("int"))
    chunks = spark.range(150).select(F.col("id").alias("chunk_id"), words.alias("text"))
    asked = chunks.where("chunk_id < 20").select(F.col("chunk_id").alias("query_id"), "text")
    vectors = lambda rows, key: retrieval.dense_vectors(retrieval.hashed_vectors(rows, key, "text"), key)
    want = evidence.vector_arm(vectors(chunks, "chunk_id"), vectors(asked, "query_id"), 40).collect()
    got = evidence.text_vector_arm(chunks, asked, 40).collect()
    row = lambda r: (r.query_id, r.chunk_id, r.similarity, r.vector_rank)
    assert sorted(map(row, got)) == sorted(map(row, want)) and len(got) > 500


def moves(spark, folder, n):
    """``n`` orders of two customers, all of them queries, with days in common."""
    k = F.col("id") * 100
    o = spark.range(n).select(k.alias("o_orderkey"), (F.col("id") % 2 + 6).alias("o_custkey"), F.expr("TIMESTAMP_NTZ'1996-01-01' + make_dt_interval(CAST(id * 7 % 90 AS INT))").alias("o_orderdate"), F.lit("O").alias("o_orderstatus"))
    o.write.parquet(f"{folder}/orders.parquet")
    spark.range(10).select(F.col("id").alias("c_custkey"), F.lit(3).alias("c_nationkey")).write.parquet(f"{folder}/customer.parquet")
    return str(folder)


@pytest.mark.parametrize("name", ["similar_moves", "move_signals"])
@pytest.mark.parametrize("most", [5000, 40])
def test_moves_of_a_tenant_are_not_paired_as_rows(spark, tmp_path, monkeypatch, name, most):
    monkeypatch.setattr(reports, "MAX_CANDIDATES", most)
    rows, made = most_rows(queries.QUERIES[name](spark, moves(spark, tmp_path, 600)))
    c = duckdb.connect()
    for t in ("orders", "customer"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    found = c.execute(queries.ORACLE[name].replace("<= 5000", f"<= {most}"))
    at = [[x[0] for x in found.description].index(k) for k in sorted(rows[0].asDict())]
    assert sorted(tuple(plain(r[k]) for k in sorted(r.asDict())) for r in rows) == sorted(tuple(plain(r[i]) for i in at) for r in found.fetchall())
    assert made <= 20_000  # 240 000 pairs without the limit


@pytest.mark.parametrize("name", ["similar_topk", "similar_signals"])
def test_equal_parts_are_scored_once(spark, tmp_path, monkeypatch, name):
    seen, top_k = [], topk.top_k
    monkeypatch.setattr(topk, "top_k", lambda q, c, *a: seen.append((q.count(), c.count())) or top_k(q, c, *a))
    rows = queries.QUERIES[name](spark, parts(spark, tmp_path, 12_000)).collect()
    c = duckdb.connect()
    c.execute(f"CREATE VIEW part AS SELECT * FROM '{tmp_path}/part.parquet/*.parquet'")
    found = c.execute(queries.ORACLE[name])
    at = [[x[0] for x in found.description].index(k) for k in sorted(rows[0].asDict())]
    assert sorted(tuple(plain(r[k]) for k in sorted(r.asDict())) for r in rows) == sorted(tuple(plain(r[i]) for i in at) for r in found.fetchall())
    assert seen == [(10, 1000)]  # of 120 and 12 000


@pytest.mark.parametrize("name", ["keyword_top", "keyword_search"])
def test_equal_entries_are_read_once(spark, tmp_path, monkeypatch, name):
    seen, postings = [], retrieval._postings
    monkeypatch.setattr(retrieval, "_postings", lambda e, *a: seen.append(e.count()) or postings(e, *a))
    said = [(1, 0, "user", "A harp or two rings"), (1, 1, "assistant", "bolt"), (2, 0, "user", "large bolt"), (3, 0, "user", "")]
    spark.createDataFrame(said, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    rows = queries.QUERIES[name](spark, parts(spark, tmp_path, 6000)).collect()
    c = duckdb.connect()
    for t in ("part", "conversations"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    found = c.execute(queries.ORACLE[name])
    at = [[x[0] for x in found.description].index(k) for k in sorted(rows[0].asDict())]
    assert sorted(tuple(plain(r[k]) for k in sorted(r.asDict())) for r in rows) == sorted(tuple(plain(r[i]) for i in at) for r in found.fetchall())
    assert seen == [3]  # of 6 000


def test_a_sheet_is_read_once_when_it_is_judged(spark):
    read = spark.sparkContext.accumulator(0)

    def seen(x):
        read.add(1)
        return x

    rows = spark.createDataFrame([(i, "03/02/2025", "2br", "6.5", f"J{i % 4}" if i % 2 else None) for i in range(40)], "row_number long, day string, size string, hours string, ref string")
    rows = rows.withColumn("hours", F.udf(seen)("hours"))
    out = imports.judge(rows, {"move_date": "day", "home_size": "size", "actual_hours": "hours", "external_ref": "ref"}, "2026-01-01", date_order="dmy", decimal_style="dot")
    found = imports.counts(out).first()
    assert (found.total, found.importable, found.duplicates) == (40, 3, 37)  # kept: the first row, J1 and J3
    assert read.value == 40
