"""Weighted similarity of jobs: features unknown on either side drop out and the weights are rescaled."""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from cartage.functions.staging import cut
from cartage.operators.topk import Columns, best_columns, columns, half_up, rows_at

#: Fixed weights, scales and orders.
WEIGHTS = {"home_size": 30.0, "distance_miles": 20.0, "stairs": 12.0, "floors": 10.0, "elevators": 8.0, "packing_service": 8.0, "special_items": 8.0, "geography": 4.0}
HOME_SIZES = ("studio", "1br", "2br", "3br", "4br", "5br_plus")
PACKING = ("none", "partial", "full")
MIN_COVERAGE, MATCHED = 0.5, 0.25
#: Pairs that are scored at once.
PAIRS = 500_000


def scaled_gap(a: Column, b: Column, scale: float) -> Column:
    """From 0 to 1 at ``scale`` and beyond; null unless both are known (``least`` alone would pass over a null)."""
    return F.when(a.isNotNull() & b.isNotNull(), F.least(F.abs(a - b) / F.lit(scale), F.lit(1.0)))


def ordinal_gap(a: Column, b: Column, order: tuple[str, ...]) -> Column:
    place = F.create_map(*[c for i, v in enumerate(order) for c in (F.lit(v), F.lit(float(i)))])
    return F.abs(F.try_element_at(place, a) - F.try_element_at(place, b)) / F.lit(float(len(order) - 1))


def mean_known(*parts: Column) -> Column:
    """The mean of the parts that are known; null if none is."""
    known = F.array_compact(F.array(*parts))
    return F.when(F.size(known) > 0, F.aggregate(known, F.lit(0.0), lambda a, x: a + x) / F.size(known))


def jaccard_gap(a: Column, b: Column) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when(a.isNotNull() & b.isNotNull(), F.when(union == 0, 0.0).otherwise(1.0 - F.size(F.array_intersect(a, b)) / union))


def geography_gap(q: dict[str, Column], o: dict[str, Column]) -> Column:
    """Same ZIP 0, same city 0.3, same state 0.6, else 1; the first level known on both sides decides."""
    out = F.lit(None).cast("double")
    for level, same in (("state", 0.6), ("city", 0.3), ("zip", 0.0)):
        both = (F.coalesce(q[level], F.lit("")) != "") & (F.coalesce(o[level], F.lit("")) != "")
        out = F.when(both, F.when(F.lower(q[level]) == F.lower(o[level]), same).otherwise(1.0)).otherwise(out)
    return out


def compare(gaps: dict[str, Column], weights: dict[str, float] | None = None) -> Column:
    """Struct: score (4 places), coverage, comparable, matched features."""
    weights = weights or WEIGHTS
    parts = F.filter(F.array(*[F.struct(F.lit(k).alias("name"), F.greatest(F.least(g, F.lit(1.0)), F.lit(0.0)).alias("d"), F.lit(weights[k]).alias("w"), g.isNotNull().alias("known")) for k, g in gaps.items()]), lambda f: f["known"])
    present = F.aggregate(parts, F.lit(0.0), lambda a, f: a + f["w"])
    gap = F.aggregate(parts, F.lit(0.0), lambda a, f: a + f["w"] * f["d"])
    coverage = F.least(present / F.lit(sum(weights.values())), F.lit(1.0))
    return F.struct(
        F.when(present > 0, F.round(1 - F.try_divide(gap, present), 4)).otherwise(0.0).alias("score"), F.round(coverage, 4).alias("coverage"), (coverage >= MIN_COVERAGE).alias("comparable"),
        F.transform(F.filter(parts, lambda f: f["d"] <= MATCHED), lambda f: f["name"]).alias("matched"),
    )


def scaled_gaps(q: np.ndarray, c: np.ndarray, scale: float) -> np.ndarray:
    """``scaled_gap`` of all pairs of two columns, NaN where unknown."""
    return np.minimum(np.abs(c[None, :] - q[:, None]) / scale, 1.0)


def unequal(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """1 where two texts of known value differ, else 0."""
    names = {x: i for i, x in enumerate(set(q.tolist()))}
    mine, theirs = (np.array([names.get(x, -1) for x in side.tolist()]) for side in (q, c))
    return (mine[:, None] != theirs[None, :]).astype(np.float64)


def mean_gaps(*parts: np.ndarray) -> np.ndarray:
    """``mean_known`` for matrices of gaps."""
    known = sum((~np.isnan(p)).astype(np.float64) for p in parts)
    return np.where(known > 0, sum(np.nan_to_num(p) for p in parts) / np.where(known > 0, known, 1.0), np.nan)


def equal_gaps(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """0 where two texts are equal, 1 where they differ, NaN where one is empty or not known."""
    blank = lambda side: np.array([not x for x in side.tolist()], bool)
    return np.where(blank(q)[:, None] | blank(c)[None, :], np.nan, unequal(q, c))


def jaccard_gaps(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """``jaccard_gap`` of all pairs of two columns of JSON lists; each two different lists are compared once."""
    sides = []
    for side in (q, c):
        kinds = {x: i for i, x in enumerate(dict.fromkeys(side.tolist()))}
        sides.append(([None if x is None else set(json.loads(x)) for x in kinds], np.array([kinds[x] for x in side.tolist()], int)))
    (mine, at), (theirs, to) = sides
    far = [[np.nan if a is None or b is None else 1.0 - len(a & b) / len(a | b) if a | b else 0.0 for b in theirs] for a in mine]
    return np.array(far, np.float64).reshape(len(mine), len(theirs))[at][:, to]


def pair_scores(gaps: dict[str, np.ndarray], weights: dict[str, float] | None = None) -> np.ndarray:
    """``compare`` for matrices of gaps: scores of 4 places, minus infinity where too little is known."""
    return scores_and_coverage(gaps, weights)[0]


def scores_and_coverage(gaps: dict[str, np.ndarray], weights: dict[str, float] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """``pair_scores``, and the share of the weights that is known."""
    weights = weights or WEIGHTS
    present = gap = 0.0
    for name, d in gaps.items():
        known = ~np.isnan(d)
        present = present + np.where(known, weights[name], 0.0)
        gap = gap + np.where(known, weights[name] * np.clip(d, 0.0, 1.0), 0.0)
    score = np.where(present > 0, half_up(1 - gap / np.where(present > 0, present, 1.0), 4), 0.0)
    coverage = np.minimum(present / sum(weights.values()), 1.0)
    return np.where(coverage >= MIN_COVERAGE, score, -np.inf), coverage


def recent_pool(rows: DataFrame, tenant: str, size: str, day: str, key: str, window: int, most: int) -> DataFrame:
    """(rows, pool_size, pool_rank): for each tenant and size the ``most`` newest rows of sizes within ``window``, and one more for a query that is among them.

    Queries of one tenant and size share candidates, so these are chosen once for all of them.  Months are counted first and
    only the rows of those that reach the number are repeated for the sizes and sorted, so a large tenant's history is not gathered.
    """
    month = F.coalesce(F.trunc(day, "month"), F.to_date(F.lit("0001-01-01")))
    counted = cut(rows.groupBy(tenant, size, month.alias("__m")).agg(F.count(F.lit(1)).alias("__n")))
    asked = counted.select(tenant, F.col(size).alias("pool_size")).distinct()
    near = counted.withColumn("pool_size", F.explode(F.sequence(F.col(size) - window, F.col(size) + window))).join(asked, [tenant, "pool_size"], "left_semi")
    newer = F.coalesce(F.sum("__n").over(Window.partitionBy(tenant, "pool_size").orderBy(F.desc("__m")).rangeBetween(Window.unboundedPreceding, Window.currentRow)) - F.sum("__n").over(Window.partitionBy(tenant, "pool_size", "__m")), F.lit(0))
    wanted = near.withColumn("__newer", newer).where(F.col("__newer") <= most).groupBy(tenant, size, "__m").agg(F.collect_list("pool_size").alias("__pools"))
    spread = rows.withColumn("__m", month).join(wanted, [tenant, size, "__m"]).withColumn("pool_size", F.explode("__pools"))
    place = F.row_number().over(Window.partitionBy(tenant, "pool_size").orderBy(F.desc(day), key))
    return spread.withColumn("pool_rank", place).where(F.col("pool_rank") <= most + 1).select(*rows.columns, "pool_size", "pool_rank")


def best_of_pools(queries: DataFrame, pool: DataFrame, tenant: str, gaps: Callable[[Columns, Columns], dict[str, np.ndarray]], k: int, most: int, keep: Sequence[str], block: int = 1_000) -> DataFrame:
    """(query_id, id, score, coverage, comparable_count, place, ``keep``): the ``k`` best comparable rows of each query's pool, by score, then rank in the pool.

    ``pool`` is a ``recent_pool`` (of at most ``most`` and one more rows each, ids in ``id``), ``queries`` has query_id, the tenant, pool_size, and whether
    it is in its pool itself (inside); one that is has all others for candidates, one that is not all but the last.  Both have the columns that ``gaps`` asks for.
    Pairs are scored as matrices of a block of queries and a pool; ``keep`` are columns of the pool.
    """
    spark = queries.sparkSession
    kinds = {f.name: f.dataType.simpleString() for f in [*pool.schema, *queries.schema]}
    ddl = ", ".join(f"`{c}` {x}" for c, x in [("query_id", kinds["query_id"]), ("id", kinds["id"]), ("score", "double"), ("coverage", "double"), ("comparable_count", "bigint"), ("place", "int"), *((c, kinds[c]) for c in keep)])
    schema = to_arrow_schema(spark.createDataFrame([], ddl).schema)

    def both(a: pa.Table, b: pa.Table) -> pa.Table:
        b = b.take(pc.sort_indices(b, [("pool_rank", "ascending")]))
        q, c = columns(a.select(asked)), columns(b.select(offered))
        out, step = [], max(1, PAIRS // max(len(b), 1))
        for lo in range(0, len(a) if len(b) else 0, step):
            own = rows_at(q, slice(lo, lo + step))
            s, coverage = scores_and_coverage(gaps(own, c))
            s = np.where((own["query_id"][:, None] != c["id"][None, :]) & ((c["pool_rank"] <= most)[None, :] | (own["inside"] > 0)[:, None]), s, -np.inf)
            n = (s > -np.inf).sum(axis=1)
            at, number = np.nonzero(best_columns(s, k))
            order = np.lexsort((number, -s[at, number], at))
            at, number = at[order], number[order]
            place = np.arange(len(at)) - np.searchsorted(at, at) + 1
            made = [own["query_id"][at], c["id"][number], s[at, number], half_up(coverage[at, number], 4), n[at], place]
            out.append(pa.Table.from_arrays([*(pa.array(x, type=f.type) for x, f in zip(made, schema, strict=False)), *(b.column(x).take(pa.array(number)).cast(schema.field(x).type) for x in keep)], schema=schema))
        return pa.concat_tables(out) if out else schema.empty_table()

    keys = [tenant, "pool_size", "__b"]
    asked, offered = [c for c in queries.columns if c not in keys], [c for c in pool.columns if c not in keys and c not in keep]
    sides = -(-max(1, queries.groupBy(tenant, "pool_size").count().agg(F.max("count")).first()[0] or 0) // block)
    parts = 4 * max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    left = queries.withColumn("__b", (F.monotonically_increasing_id() % sides).cast("int")).repartition(parts, *keys)
    right = pool.withColumn("__b", F.explode(F.sequence(F.lit(0), F.lit(sides - 1)))).repartition(parts, *keys)
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(both, ddl)
