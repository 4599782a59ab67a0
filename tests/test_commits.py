"""Commits: writers that die between two writes, retries, reverts, visibility, cascades, indexes and memos."""

import pytest
from pyspark.sql import functions as F

from cartage.sources import commits

HISTORY = "company_id string, import_batch_id string, source string, v int"
BATCH = "import_batch_id string, importable long, reverted_on date"


def _batch(spark, name, values):
    return spark.createDataFrame([("c", name, "import", v) for v in values], HISTORY), spark.createDataFrame([(name, len(values), None)], BATCH)


def _values(spark, root):
    rows = commits.read(spark, root, "history")
    return [] if rows is None else sorted(r.v for r in rows.collect())


def test_a_writer_that_dies_leaves_nothing_and_its_retry_gives_the_rows_once(spark, tmp_path, monkeypatch):
    root = f"file://{tmp_path}/s"
    assert commits.read(spark, root, "history") is None
    seal = commits._seal

    def die(*_):
        raise OSError("killed")

    monkeypatch.setattr(commits, "_seal", die)
    with pytest.raises(OSError, match="killed"):
        commits.import_batch(spark, root, *_batch(spark, "a", [1, 2, 3]), "a")
    assert (tmp_path / "s" / "history" / "commit=import-a").exists()  # rows lie there,
    assert commits.read(spark, root, "history") is None and commits.read(spark, root, "batches") is None  # and nobody sees them
    monkeypatch.setattr(commits, "_seal", seal)
    assert commits.import_batch(spark, root, *_batch(spark, "a", [1, 2]), "a")
    assert not commits.import_batch(spark, root, *_batch(spark, "a", [7]), "a")
    assert _values(spark, root) == [1, 2] and commits.read(spark, root, "batches").count() == 1
    # A writer that dies between its two tables.
    _batch(spark, "b", [9])[0].write.parquet(f"{root}/history/commit=import-b")
    assert _values(spark, root) == [1, 2]
    assert commits.import_batch(spark, root, *_batch(spark, "b", [9]), "b") and _values(spark, root) == [1, 2, 9]


def test_reverts_are_seen_whole_and_once(spark, tmp_path, monkeypatch):
    root = f"file://{tmp_path}/s"
    for name, values in (("a", [1, 2]), ("b", [3])):
        commits.import_batch(spark, root, *_batch(spark, name, values), name)
    commits.publish(spark, root, "own", {"history": spark.createDataFrame([("c", "a", "platform", 50)], HISTORY)})
    seal = commits._seal
    monkeypatch.setattr(commits, "_seal", lambda *_: (_ for _ in ()).throw(OSError("killed")))
    with pytest.raises(OSError):
        commits.revert_import(spark, root, "a", "2026-01-01")
    monkeypatch.setattr(commits, "_seal", seal)
    assert _values(spark, root) == [1, 2, 3, 50]
    assert [commits.revert_import(spark, root, b, "2026-01-01") for b in ("a", "a", "x")] == ["reverted", "conflict", "not_found"]
    assert _values(spark, root) == [3, 50]
    stamps = {r.import_batch_id: r.reverted_on for r in commits.read(spark, root, "batches").collect()}
    assert str(stamps["a"]) == "2026-01-01" and stamps["b"] is None and len(stamps) == 2


def test_visibility_cascade_and_index(spark, tmp_path):
    root = f"file://{tmp_path}/s"
    docs = spark.createDataFrame([(i, True, None) for i in range(4)], "document_id int, is_active boolean, deleted_at timestamp")
    chunk = "document_id int, chunk_index int, content string, is_active boolean"
    rows = spark.createDataFrame([(i, k, f"{i}.{k}", True) for i in range(4) for k in range(2)], chunk)
    commits.publish(spark, root, "one", {"documents": docs.where("document_id < 2"), "passages": rows.where("document_id < 2")})
    commits.publish(spark, root, "two", {"documents": docs.where("document_id >= 2"), "passages": rows.where("document_id >= 2")})
    seen = lambda table, *cols: sorted(tuple(r) for r in commits.read(spark, root, table).select(*cols).collect())
    assert commits.set_visible(spark, root, "off", "document_id", [1], False) and not commits.set_visible(spark, root, "off", "document_id", [1], False)
    assert seen("passages", "document_id", "is_active") == [(0, True)] * 2 + [(1, False)] * 2 + [(2, True)] * 2 + [(3, True)] * 2
    assert seen("documents", "document_id", "is_active") == [(0, True), (1, False), (2, True), (3, True)]
    assert {r[0] for r in commits.live(spark, root, "passages").collect()} == {"two", "off"}  # the other commit was not written anew
    assert commits.delete_documents(spark, root, "gone", "document_id", [2], F.lit("2026-01-01").cast("timestamp"))
    assert [r[0] for r in seen("passages", "document_id")] == [0, 0, 1, 1, 3, 3]
    assert [r[1] is not None for r in seen("documents", "document_id", "deleted_at")] == [False, False, True, False]
    fresh = spark.createDataFrame([(0, 0, "new", True), (9, 0, "first", True)], chunk)
    assert commits.replace_passages(spark, root, "index-1", "document_id", fresh) and not commits.replace_passages(spark, root, "index-1", "document_id", fresh)
    assert seen("passages", "document_id", "content") == [(0, "new"), (1, "1.0"), (1, "1.1"), (3, "3.0"), (3, "3.1"), (9, "first")]


def test_memo_keeps_failures_and_asks_once(spark, tmp_path):
    root, asked = f"file://{tmp_path}/s", []

    def resolve(new):
        asked.append(new.count())
        return new.withColumn("miles", F.when(F.col("a") != F.col("b"), (F.col("b") - F.col("a")).cast("double")))

    pairs = spark.createDataFrame([(1, 2), (1, 2), (3, 3)], "a int, b int")
    first = {tuple(r) for r in commits.memoise(spark, root, "m1", pairs, ["a", "b"], resolve).collect()}
    more = spark.createDataFrame([(1, 2), (3, 3), (4, 9)], "a int, b int")
    second = {tuple(r) for r in commits.memoise(spark, root, "m2", more, ["a", "b"], resolve).collect()}
    assert first == {(1, 2, 1.0), (3, 3, None)} and second == {(1, 2, 1.0), (3, 3, None), (4, 9, 5.0)} and asked == [2, 1]
