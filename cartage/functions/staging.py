"""Steps that the optimiser keeps apart, and tables that are made once."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def staged(df: DataFrame, columns: Mapping[str, Column], keep: Sequence[str] | None = None) -> DataFrame:
    """``df`` (its columns ``keep``) with ``columns``, each computed once a row however often later steps use it.

    Projections would be merged and a costly expression repeated wherever it is named; they are not merged across a
    generator, so the values pass through one of a single row.
    """
    left = df.columns if keep is None else keep
    return df.select(*(F.col(f"`{c}`") for c in left), F.inline(F.array(F.struct(*(c.alias(n) for n, c in columns.items())))))


def cut(df: DataFrame) -> DataFrame:
    """``df`` made now and read from then on: a checkpoint in the folder that the session names for them, which lost executors
    do not touch; where none is named (a single machine), a cached table that can be made again."""
    if df.sparkSession.conf.get("spark.checkpoint.dir", None):
        return df.checkpoint()
    df = df.persist()
    df.count()
    return df


def shared_folder(spark: SparkSession, purpose: str) -> str:
    """A new folder under the one that the session names for checkpoints; on a single machine without one, a temporary one."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = f"file://{tempfile.mkdtemp(prefix='cartage-')}"
    path = f"{root.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(p)
    return path
