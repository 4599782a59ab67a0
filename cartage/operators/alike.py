"""Rows that are alike stand for each other: work on pairs is done once for each kind of row and then given to its rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def first_of_kind(rows: DataFrame, by: list[str], order: str, most: int) -> DataFrame:
    """``rows`` that are among the ``most`` first of those equal in ``by`` (nulls are equal), with ``place`` (from 1) and ``kind``, the first one's ``order``.

    A search for the best ``most`` rows by what kinds have and then by ``order`` finds them among these: if a kind is behind
    ``most`` others, so are all of its rows.
    """
    one = Window.partitionBy(*by)
    first = rows.withColumn("place", F.row_number().over(one.orderBy(order))).where(F.col("place") <= most)
    return first.withColumn("kind", F.min(order).over(one))


def with_kind(rows: DataFrame, by: list[str], key: str, name: str = "kind") -> DataFrame:
    """``rows`` with the smallest ``key`` of those equal in ``by`` (nulls are equal)."""
    kinds = rows.groupBy(*by).agg(F.min(key).alias(name)).alias("k")
    return rows.alias("r").join(kinds, [F.col(f"r.{c}").eqNullSafe(F.col(f"k.{c}")) for c in by]).select("r.*", f"k.{name}")
