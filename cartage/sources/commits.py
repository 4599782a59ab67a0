"""Tables that change by commits: what a commit writes and what it takes away is seen at once or not at all.

A commit writes each of its tables under ``<root>/<table>/commit=<name>`` and is then published by one small file, created whole under
``<root>/_published``.  Readers take the folders that published commits name, less those that published commits drop.  A
writer that dies before it publishes leaves folders that nobody reads; the retry of the same name overwrites them.  A name
that is published already is not written again, so a retry after success changes nothing.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_ENTRY = "name string, adds array<string>, drops array<struct<table: string, commit: string>>, fields map<string, string>, at long"


def _file(spark: SparkSession, path: str) -> tuple[object, object]:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def is_published(spark: SparkSession, root: str, name: str) -> bool:
    fs, p = _file(spark, f"{root}/_published/{name}.json")
    return fs.exists(p)


def _entries(spark: SparkSession, root: str) -> DataFrame:
    fs, p = _file(spark, f"{root}/_published")
    return spark.read.schema(_ENTRY).json(f"{root}/_published") if fs.exists(p) else spark.createDataFrame([], _ENTRY)


def live(spark: SparkSession, root: str, table: str) -> DataFrame:
    """(commit): the commits whose rows of ``table`` count."""
    e = _entries(spark, root)
    gone = e.select(F.explode("drops").alias("d")).where(F.col("d.table") == table).select(F.col("d.commit").alias("commit"))
    return e.where(F.array_contains("adds", table)).select(F.col("name").alias("commit")).join(gone, "commit", "left_anti")


def last(spark: SparkSession, root: str, table: str) -> str:
    """The greatest name of a commit that added to ``table``; names that end in a number of fixed width count up."""
    return _entries(spark, root).where(F.array_contains("adds", table)).agg(F.max("name")).first()[0]


def read(spark: SparkSession, root: str, table: str) -> DataFrame | None:
    """The published rows of ``table`` with the ``commit`` of each; None before its first commit."""
    first = _entries(spark, root).where(F.array_contains("adds", table)).orderBy("at").first()
    if first is None:
        return None
    schema = f"{first['fields'][table]}, commit string"
    # One name a commit; only their folders are listed, so leftovers of dead writers are never touched.
    paths = [f"{root}/{table}/commit={r[0]}" for r in live(spark, root, table).collect()]
    return spark.read.schema(schema).option("basePath", f"{root}/{table}").parquet(*paths) if paths else spark.createDataFrame([], schema)


def publish(spark: SparkSession, root: str, name: str, adds: Mapping[str, DataFrame], drops: Mapping[str, list[str]] | None = None) -> bool:
    """Write ``adds`` and make them seen together, and the commits in ``drops`` (by table) unseen.  False if ``name`` was published before."""
    if is_published(spark, root, name):
        return False
    for table, df in adds.items():
        df.write.mode("overwrite").parquet(f"{root}/{table}/commit={name}")
    fields = {table: ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema) for table, df in adds.items()}
    entry = {"name": name, "adds": list(adds), "drops": [{"table": t, "commit": c} for t, cs in (drops or {}).items() for c in cs], "fields": fields, "at": spark._jvm.System.currentTimeMillis()}
    return _seal(spark, root, name, json.dumps(entry))


def _seal(spark: SparkSession, root: str, name: str, entry: str) -> bool:
    """Put the whole file of a commit in its place in one step; False where another writer's file is."""
    fs, made = _file(spark, f"{root}/_publishing/{uuid.uuid4().hex}")
    out = fs.create(made, False)
    out.write(entry.encode())
    out.close()
    _, place = _file(spark, f"{root}/_published/{name}.json")
    fs.mkdirs(place.getParent())
    if fs.exists(place):
        return False
    return bool(fs.rename(made, place))


def rewrite(spark: SparkSession, root: str, name: str, changes: Mapping[str, tuple[Column, Callable[[DataFrame], DataFrame]]], adds: Mapping[str, DataFrame] | None = None) -> bool:
    """One commit that changes rows of several tables: of each table, the commits that hold a touched row are written anew.

    ``changes``: table to (which rows are touched, what becomes of all rows of their commits).
    """
    if is_published(spark, root, name):
        return False
    new, drops = dict(adds or {}), {}
    for table, (touched, change) in changes.items():
        rows = read(spark, root, table)
        if rows is None:
            continue
        hit = rows.where(touched).select("commit").distinct()
        drops[table] = sorted(r[0] for r in hit.collect())  # names of commits
        if drops[table]:
            new[table] = change(rows.join(F.broadcast(hit), "commit", "left_semi").drop("commit"))
    return publish(spark, root, name, new, drops)


# What the engine stores with commits.


def import_batch(spark: SparkSession, root: str, rows: DataFrame, stamp: DataFrame, batch: str) -> bool:
    """An import: its rows and its provenance row in one commit; nothing if no row is importable."""
    return bool(stamp.first()["importable"]) and publish(spark, root, f"import-{batch}", {"history": rows, "batches": stamp})


def revert_import(spark: SparkSession, root: str, batch: str, today: str) -> str:
    """not_found, conflict (reverted before) or reverted: the rows go and the provenance row is stamped, in one commit."""
    batches = read(spark, root, "batches")
    mine = None if batches is None else batches.where(F.col("import_batch_id") == batch).select(F.col("reverted_on").isNotNull()).first()
    if mine is None:
        return "not_found"
    if mine[0]:
        return "conflict"
    gone = F.col("import_batch_id").eqNullSafe(batch) & (F.col("source") == "import")
    stamp = F.when(F.col("import_batch_id") == batch, F.lit(today).cast("date")).otherwise(F.col("reverted_on"))
    done = rewrite(spark, root, f"revert-{batch}", {"history": (gone, lambda df: df.where(~gone)), "batches": (F.col("import_batch_id") == batch, lambda df: df.withColumn("reverted_on", stamp))})
    return "reverted" if done else "conflict"


def set_visible(spark: SparkSession, root: str, name: str, parent: str, ids: list[object], active: bool) -> bool:
    """The switch of parents (documents or entries) and its mirror on all their passages."""
    hit = F.col(parent).isin(ids)
    turn = lambda df: df.withColumn("is_active", F.when(hit, F.lit(active)).otherwise(F.col("is_active")))
    return rewrite(spark, root, name, {"documents": (hit, turn), "passages": (hit, turn)})


def delete_documents(spark: SparkSession, root: str, name: str, parent: str, ids: list[object], now: Column) -> bool:
    """Documents stay with the time of their deletion, their passages go."""
    hit = F.col(parent).isin(ids)
    stamp = lambda df: df.withColumns({"deleted_at": F.when(hit, F.coalesce("deleted_at", now)).otherwise(F.col("deleted_at")), "is_active": F.col("is_active") & ~hit})
    return rewrite(spark, root, name, {"documents": (hit, stamp), "passages": (hit, lambda df: df.where(~hit))})


def replace_passages(spark: SparkSession, root: str, name: str, parent: str, fresh: DataFrame) -> bool:
    """A new index of the parents in ``fresh``: their passages of before go as the new ones come; parents without new ones keep theirs."""
    keys = fresh.select(parent).distinct()
    rows = read(spark, root, "passages")
    if rows is None:
        return publish(spark, root, name, {"passages": fresh})
    hit = rows.join(keys, parent, "left_semi").select("commit").distinct()
    names = sorted(r[0] for r in hit.collect())
    kept = rows.join(F.broadcast(hit), "commit", "left_semi").drop("commit").join(keys, parent, "left_anti")
    return publish(spark, root, name, {"passages": kept.select(*fresh.columns).unionByName(fresh)}, {"passages": names})


def memoise(spark: SparkSession, root: str, name: str, pairs: DataFrame, keys: list[str], resolve: Callable[[DataFrame], DataFrame], table: str = "distances") -> DataFrame:
    """``pairs`` with what ``resolve`` adds; known pairs are read, new ones resolved once and kept, failures (nulls) too."""
    known = read(spark, root, table)
    asked = pairs.select(*keys).distinct()
    new = resolve(asked if known is None else asked.join(known.select(*keys), keys, "left_anti"))
    publish(spark, root, name, {table: new})
    return pairs.join(read(spark, root, table).drop("commit"), keys, "left")
