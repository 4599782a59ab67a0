"""Block top-k, ranked keyword search and the vector index against brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cartage.functions.text import search_tokens
from cartage.operators import evidence, retrieval, similarity, topk, vector_index


@pytest.mark.parametrize(("query_block", "candidate_block"), [(5000, 20_000), (3, 7), (1, 100)])
def test_every_query_has_its_own_best_matches(spark, query_block, candidate_block):
    def line_scores(q, c):
        gaps = {"home_size": similarity.scaled_gaps(q["v"], c["v"], 50.0), "distance_miles": np.zeros((len(q["v"]), len(c["v"]))) * c["v"][None, :]}
        return topk.not_itself(q, c, similarity.pair_scores(gaps))

    rows = spark.createDataFrame([(i, i, float(i)) for i in range(40)] + [(99, 99, None)], "id int, tie int, v double").repartition(3)
    q = rows.where("id % 10 = 0").select(F.col("id").alias("query_id"), "v")
    got = topk.top_k(q, rows, line_scores, 2, query_block=query_block, candidate_block=candidate_block).collect()
    assert {(r.query_id, r.id) for r in got} == {(0, 1), (0, 2), (10, 9), (10, 11), (20, 19), (20, 21), (30, 29), (30, 31)}


def test_matrix_scores_equal_column_scores(spark):
    rng = random.Random(3)
    rows = [(i, rng.choice([None, rng.uniform(0, 90)]), rng.choice([None, rng.uniform(0, 9)]), rng.choice("abc")) for i in range(30)]
    df = spark.createDataFrame(rows, "id int, a double, b double, c string")
    q = df.select(*[F.col(x).alias(f"q_{x}") for x in df.columns])
    gaps = {"home_size": similarity.scaled_gap(F.col("a"), F.col("q_a"), 40.0), "distance_miles": similarity.scaled_gap(F.col("b"), F.col("q_b"), 5.0), "packing_service": F.when(F.col("c") == F.col("q_c"), 0.0).otherwise(1.0)}
    want = {(r.q_id, r.id): (r.score, r.comparable) for r in df.crossJoin(q).select("q_id", "id", similarity.compare(gaps).alias("x")).select("q_id", "id", "x.score", "x.comparable").collect()}
    a, b, c = (np.array([np.nan if r[k] is None else r[k] for r in rows]) if k < 3 else np.array([r[k] for r in rows], object) for k in (1, 2, 3))
    got = similarity.pair_scores({"home_size": similarity.scaled_gaps(a, a, 40.0), "distance_miles": similarity.scaled_gaps(b, b, 5.0), "packing_service": similarity.unequal(c, c)})
    for (i, j), (score, comparable) in want.items():
        assert got[i, j] == (score if comparable else -np.inf)


def test_ties_in_scores_go_to_the_smallest_tie():
    rng = np.random.default_rng(2)
    q = {"query_id": np.arange(5), "v": np.zeros(5)}
    c = {"id": np.arange(60), "tie": rng.permutation(60).astype(str).astype(object), "v": rng.integers(0, 3, 60).astype(float)}
    score = lambda a, b: np.where(b["v"][None, :] == 2, -np.inf, b["v"][None, :] + 0 * a["v"][:, None])
    at, number, s = topk.best_pairs(q, c, score, 12)
    want = sorted((i for i in range(60) if c["v"][i] < 2), key=lambda i: (-c["v"][i], c["tie"][i]))[:12]
    for k in range(5):
        assert sorted(number[at == k]) == sorted(want)


def test_vectors_of_other_lengths_are_an_error():
    with pytest.raises(ValueError, match="different lengths"):
        topk.cosines(np.ones((1, 2)), np.ones((1, 3)))
    assert topk.cosines(np.array([[3.0, 4.0], [0.0, 0.0]]), np.array([[6.0, 8.0]])).tolist() == [[1.0], [0.0]]


def test_keyword_top_is_the_top_of_all_scores(spark):
    rng = random.Random(5)
    words = ["piano", "pianos", "cancellation", "cancel", "fees", "fee", "insurance", "parking", "storage", "box", "boxes", "truck"]
    entry = [(i, rng.choice("xy"), " ".join(rng.choices(words, k=2)), " ".join(rng.choices(words, k=1)), " ".join(rng.choices(words[:4], k=6))) for i in range(120)]
    asked = [(i, rng.choice("xy"), " ".join(rng.choices([*words, "unknownword"], k=rng.randrange(6)))) for i in range(60)]
    e = spark.createDataFrame(entry, "id int, tenant string, title string, keywords string, body string")
    q = spark.createDataFrame(asked, "q int, tenant string, text string")
    fields = {"title": "title", "keywords": "keywords", "content": "body"}
    got = {(r.query_id, r.place): (r.entry_id, r.score) for r in retrieval.keyword_top(e, q, fields, "id", "title", "q", "text", "tenant").collect()}
    every = retrieval.keyword_scores(e, q, fields, "id", "q", "text", "tenant").collect()
    title = {r[0]: r[2] for r in entry}
    want = {}
    for query in {r.query_id for r in every}:
        rows = sorted((-r.score, title[r.entry_id], r.entry_id) for r in every if r.query_id == query)
        want |= {(query, i + 1): (r[2], -r[0]) for i, r in enumerate(rows[:3])}
    assert got == want and len(got) > 60


def test_keyword_top_leaves_common_words_to_rare_ones(spark):
    """A word of every entry's text that cannot decide is not followed: only entries with the rare word come back."""
    e = spark.createDataFrame([(i, "Harp" if i < 4 else f"Entry {i}", "moving day") for i in range(300)], "id int, title string, body string")
    q = spark.createDataFrame([(1, "moving harp day")], "q int, text string")
    got = retrieval.keyword_top(e, q, {"title": "title", "content": "body"}, "id", "title", "q", "text").collect()
    assert sorted((r.entry_id, r.score) for r in got) == [(0, 5), (1, 5), (2, 5)]


def _vectors(spark, n, seed):
    rng = random.Random(seed)
    words = [f"word{i}" for i in range(60)]
    topics = [rng.sample(words, 8) for _ in range(25)]
    rows = [(i, " ".join(rng.choices(topics[i % 25], k=7) + rng.choices(words, k=2))) for i in range(n)]
    df = spark.createDataFrame(rows, "id long, text string").repartition(4)
    return retrieval.dense_vectors(retrieval.hashed_vectors(df, "id", "text"), "id")


def test_recall_of_the_index(spark):
    vectors = _vectors(spark, 3000, 4).persist()
    own, asked = vectors.withColumnRenamed("id", "chunk_id"), vectors.where("id % 100 = 0").withColumnRenamed("id", "query_id")
    index = vector_index.fit(own, "chunk_id", sample=800)
    assert 1 <= index.probes < len(index.centres)
    assert index.assigned(own).count() == 3000  # every row is indexed
    exact = evidence.vector_arm(own, asked).collect()
    found = evidence.vector_arm(own, asked, index=index).collect()
    score = {(r.query_id, r.vector_rank): r.similarity for r in exact}
    # A hit is a chunk at least as near as the true one of the last rank: equal texts tie.
    last = {q: min(s for (k, _), s in score.items() if k == q) for q, _ in score}
    hits = sum(r.similarity >= last[r.query_id] for r in found)
    assert hits >= 0.9 * len(exact)
    assert evidence.vector_arm(own.limit(0), asked, index=vector_index.fit(own.limit(0), "chunk_id")).count() == 0


def test_one_arm_answers_when_the_other_fails(spark):
    lexical = spark.createDataFrame([(1, 10, 1), (1, 11, 2)], "query_id long, chunk_id long, lexical_rank int")
    vector = spark.createDataFrame([(1, 40, 0.9, 1), (1, 50, 0.1, 2)], "query_id long, chunk_id long, similarity double, vector_rank int")
    chunks = spark.createDataFrame([(10, "a", 1, "h1"), (11, "b", 2, "h2"), (40, "c", 1, "h4"), (50, "c", 9, "h5")], "chunk_id long, document_id string, chunk_index int, content_hash string")
    assert [r.chunk_id for r in evidence.hybrid(lexical, None, chunks).orderBy("position").collect()] == [10, 11]
    assert [r.chunk_id for r in evidence.hybrid(None, vector, chunks).orderBy("position").collect()] == [40]
    with pytest.raises(ValueError, match="both arms"):
        evidence.hybrid(None, None, chunks)


def test_words_of_a_query(spark):
    assert sorted(spark.range(1).select(search_tokens(F.lit("Cancellations of PIANOS")).alias("t")).first().t) == ["cancellation", "piano"]


def test_pools_hold_the_newest_rows_of_each_tenant_and_size(spark):
    import datetime

    rng = random.Random(8)
    rows = [(i, rng.choice("ab"), rng.randrange(4), datetime.date(2020 + i % 3, i % 12 + 1, rng.randrange(1, 28)) if i % 11 else None) for i in range(300)]
    df = spark.createDataFrame(rows, "id int, tenant string, size int, day date")
    got = {}
    for r in similarity.recent_pool(df, "tenant", "size", "day", "id", 1, 20).collect():
        got.setdefault((r.tenant, r.pool_size), set()).add(r.id)
    for tenant in "ab":
        for size in range(4):
            own = sorted((r for r in rows if r[1] == tenant and abs(r[2] - size) <= 1), key=lambda r: (-(r[3] or datetime.date(1, 1, 1)).toordinal(), r[0]))
            assert got[tenant, size] == {r[0] for r in own[:21]}
    few = df.where("id % 11 = 0")  # no day is known
    assert {r.id for r in similarity.recent_pool(few, "tenant", "size", "day", "id", 3, 500).collect()} == {r[0] for r in rows if r[0] % 11 == 0}
