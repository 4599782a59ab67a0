"""Ingest as a stream: two runs over one folder give the rows of one, restarts change nothing, failures are rows."""

from pyspark.sql import functions as F

from cartage.sources import commits
from cartage.streaming import ingest

TEXT = "# Fees\n\nThe fee is ten dollars for every floor of the building, payable on the day of the move.\n\n# Refunds\n\nDeposits are returned within ten days of a cancelled booking, to the card that paid."


def _run(spark, tmp_path, checkpoint="checkpoint", files_a_batch=2):
    ingest.ingest_stream(spark, f"file://{tmp_path}/in", f"file://{tmp_path}/store", f"file://{tmp_path}/{checkpoint}", files_a_batch).awaitTermination(300)


def _rows(spark, tmp_path):
    docs = ingest.latest_documents(commits.read(spark, f"file://{tmp_path}/store", "documents"))
    passages = commits.read(spark, f"file://{tmp_path}/store", "passages")
    return {r.path.rsplit("/", 1)[1]: r for r in docs.collect()}, sorted((r.document.rsplit("/", 1)[1], r.chunk_index, r.heading) for r in passages.collect())


def test_two_runs_over_a_folder_give_the_rows_of_one(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a_policy.txt").write_text(TEXT)
    (folder / "b.txt").write_bytes(("﻿" + TEXT).encode())  # other bytes, the same text
    (folder / "c.txt").write_text("short")
    (folder / "d.pdf").write_bytes(b"not a pdf")
    (folder / "e.txt").write_bytes(b"x" * 100 + b"\0" * 100)
    _run(spark, tmp_path)
    docs, passages = _rows(spark, tmp_path)
    ready = [n for n, r in docs.items() if r.status == "ready"]
    assert len(docs) == 5 and len(ready) == 1 and ready[0] in ("a_policy.txt", "b.txt")
    assert {n: r.status for n, r in docs.items() if n not in ("a_policy.txt", "b.txt")} == {"c.txt": "failed", "d.pdf": "failed", "e.txt": "failed"}
    assert docs["c.txt"].reason == "too little text" and {docs[n].status for n in ("a_policy.txt", "b.txt")} == {"ready", "duplicate"}
    assert [p[2] for p in passages] == ["Fees", "Refunds"]
    _run(spark, tmp_path)  # nothing new
    _run(spark, tmp_path, "another-checkpoint", 100)  # a stream that has lost its place sees all files again
    assert _rows(spark, tmp_path)[1] == passages and {n: r.status for n, r in _rows(spark, tmp_path)[0].items()} == {n: r.status for n, r in docs.items()}
    (folder / "f.txt").write_text(TEXT + "\n\n# More\n\nPianos are moved by four people and insured up to their value in the contract.")
    _run(spark, tmp_path)
    assert _rows(spark, tmp_path)[0]["f.txt"].status == "ready" and len(_rows(spark, tmp_path)[1]) == 5


def test_a_batch_that_runs_again_changes_nothing(spark, tmp_path):
    (tmp_path / "a.txt").write_text(TEXT)
    found = spark.read.format("binaryFile").load(f"file://{tmp_path}/a.txt")
    root = f"file://{tmp_path}/store"
    assert ingest.ingest_batch(spark, root, found, "ingest-1") and not ingest.ingest_batch(spark, root, found, "ingest-1")
    assert ingest.ingest_batch(spark, root, found, "ingest-2")  # the same file in a later batch
    docs = commits.read(spark, root, "documents")
    assert docs.count() == 1 and docs.first().title == "a" and commits.read(spark, root, "passages").agg(F.count("content")).first()[0] == 2
