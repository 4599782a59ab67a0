"""Tables that cut lineage, kept in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_paths: list[str] = []
#: Local folders by application, where the session names no shared one.
_local_roots: dict[str, str] = {}


def scratch_root(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``; a local one only where that is unset and the session is of one machine."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        app = spark.sparkContext.applicationId
        if app not in _local_roots:
            _local_roots[app] = f"file://{tempfile.mkdtemp(prefix='cartage-')}"
        root = _local_roots[app]
    return root.rstrip("/")


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: lost executors cost one read, not the whole lineage."""
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/cartage-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _delete_on_exit(spark, path)
    return spark.read.schema(df.schema).parquet(path)


def _delete_on_exit(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(p)
    _paths.append(path)


def drop_scratch(spark: SparkSession, since: int = 0, keep: int = 0) -> int:
    """Delete the scratch tables of this process from number ``since`` on, but the last ``keep``; call it when results that read them are written."""
    gone = _paths[since : len(_paths) - keep]
    for path in gone:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
        _paths.remove(path)
    return len(gone)


def scratch_tables() -> int:
    """How many there are now, as a place for ``drop_scratch``."""
    return len(_paths)


def broadcast_if(df: DataFrame, max_rows: int) -> tuple[DataFrame, bool]:
    """``df`` with a broadcast hint if a count shows at most ``max_rows`` rows, else as it is (the join then shuffles).

    ``df`` should be materialised: it is counted here and read again by the join.
    """
    small = df.count() <= max_rows
    return (F.broadcast(df) if small else df), small


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Arrow batches of at most ``rows`` rows from now on in this session: texts are long, and a batch lies in memory whole."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > rows:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def unused(df: DataFrame, *names: str) -> list[str]:
    """``names``, each with signs added until ``df`` has no column of that name, whatever its case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def join_spread(rows: DataFrame, table: DataFrame, key: str, spread: list[str], share: int = 1000, how: str = "inner", counts: DataFrame | None = None) -> DataFrame:
    """Inner or left join on ``key``, one row of ``table`` a key, in which no key's rows are all one task's.

    Keys of at least one in ``share`` rows are no more than ``share``.  Their rows are dealt by a hash of ``spread`` to as
    many parts as they have that many rows, and their row of ``table`` goes to each part.  ``rows`` is read twice, unless
    ``counts`` has (key, n), the rows of each key, as a table.
    """
    if counts is None:
        counts = materialize(rows.groupBy(key).agg(F.count(F.lit(1)).alias("n")))
    floor = max(1, (counts.agg(F.sum("n")).first()[0] or 0) // share)
    hot = F.broadcast(counts.where(F.col("n") > floor).select(key, F.ceil(F.col("n") / floor).cast("int").alias("__parts")))
    left = rows.join(hot, key, "left").withColumn("__part", F.pmod(F.xxhash64(*spread), F.coalesce("__parts", F.lit(1))).cast("int")).drop("__parts")
    right = table.join(hot, key, "left").withColumn("__part", F.explode(F.sequence(F.lit(0), F.coalesce("__parts", F.lit(1)) - 1))).drop("__parts")
    return left.join(right, [key, "__part"], how).drop("__part")


def attach_groups(rows: DataFrame, groups: DataFrame, keys: list[str], size: str, share: int = 1000) -> DataFrame:
    """``rows`` with the columns of ``groups``, as a left join, without sending a hot group to one task.

    Groups of at least one in ``share`` rows are no more than ``share``; they are broadcast, the others are shuffled.
    ``rows`` is read twice, so it should be a table.
    """
    groups = materialize(groups)
    floor = max(1, (groups.agg(F.sum(size)).first()[0] or 0) // share)
    big = F.broadcast(groups.where(F.col(size) >= floor).withColumn("__hit", F.lit(True)))
    hit = rows.join(big, keys).drop("__hit")
    rest = rows.join(big.select(*keys), keys, "left_anti").join(groups.where(F.col(size) < floor), keys, "left")
    return hit.unionByName(rest)
