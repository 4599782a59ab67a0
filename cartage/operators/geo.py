"""Distances between ZIPs: a deterministic source, and a table that remembers what was resolved."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartage.functions.parse import normalize_zip


def zip_pair(origin: Column, destination: Column) -> Column:
    """Struct of both normalised ZIPs; null unless both are known."""
    o, d = normalize_zip(origin), normalize_zip(destination)
    return F.when(o.isNotNull() & d.isNotNull(), F.struct(o.alias("origin_zip"), d.alias("destination_zip")))


def steady_distance(origin: Column, destination: Column) -> Column:
    """3 miles inside a ZIP, else 5 and the gap of the first five digits modulo 56; null where a ZIP has no digits."""
    number = lambda z: F.substring(F.regexp_replace(z, r"\D", ""), 1, 5).try_cast("int")
    return F.when(origin == destination, 3.0).otherwise((5 + F.abs(number(origin) - number(destination)) % 56).cast("double"))


def resolved(jobs: DataFrame, memo: DataFrame, distance: Column) -> DataFrame:
    """``memo`` (origin_zip, destination_zip, miles) with the pairs of ``jobs`` that it lacks; a failure is remembered as null."""
    pairs = jobs.where(F.col("distance_miles").isNull()).select(zip_pair(F.col("origin_zip"), F.col("destination_zip")).alias("p")).where("p IS NOT NULL").select("p.*").distinct()
    new = pairs.join(memo.select("origin_zip", "destination_zip"), ["origin_zip", "destination_zip"], "left_anti")
    return memo.unionByName(new.withColumn("miles", distance))


def with_distances(jobs: DataFrame, memo: DataFrame) -> DataFrame:
    """``jobs`` with miles: their own distance, or else that of their pair in ``memo``; derived says which."""
    pair = zip_pair(F.col("origin_zip"), F.col("destination_zip"))
    known = memo.select(F.struct("origin_zip", "destination_zip").alias("__p"), F.col("miles").alias("__m"))
    both = jobs.withColumn("__pair", pair).join(known, F.col("__pair") == F.col("__p"), "left")
    return both.withColumns({"miles": F.coalesce("distance_miles", "__m"), "derived": F.col("distance_miles").isNull() & F.col("__m").isNotNull()}).drop("__pair", "__p", "__m")
