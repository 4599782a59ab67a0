"""Exact order statistics of groups of any size in bounded memory.

A group's values never meet in one buffer or task.  A pass takes 129 approximate quantiles of each large group (a sketch of
bounded size), so the wanted rank lies between two of them; rows below, at and between these two are counted exactly, and
only those strictly between go on.  Ranks that fall on a bound are answered; a pass leaves at most about a fortieth
of a group, and rows equal to a bound, however many, do not go on.  Groups of at most ``limit`` rows are sorted by Spark.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cartage.functions.staging import cut

GRID, ACCURACY, LIMIT = 128, 2000, 1_000_000
#: Groups whose rows of a table are sent to all tasks, at most.
SENT = 50_000
KEYS = ["__g", "__w"]


def _met(rows: DataFrame, table: DataFrame, groups: int, how: str = "inner") -> DataFrame:
    """``rows`` with their group's row of ``table``: sent to all tasks if it is small, else joined by shuffle (large groups are split at run time)."""
    return rows.join(F.broadcast(table) if groups <= SENT else table, KEYS, how)


def _pivots() -> Column:
    return F.percentile_approx("__v", [i / GRID for i in range(GRID + 1)], ACCURACY)


def _sorted_ranks(rows: DataFrame, want: DataFrame) -> DataFrame:
    """Values at ranks r1 and r2 of small groups by sorting; ``rows``: (__g, __w, __v)."""
    place = F.row_number().over(Window.partitionBy(*KEYS).orderBy("__v")) - 1
    at = rows.withColumn("__at", place).join(want.select(*KEYS, "r1", "r2"), KEYS).where("__at = r1 OR __at = r2")
    return at.groupBy(*KEYS).agg(F.max(F.when(F.col("__at") == F.col("r1"), F.col("__v"))).alias("s1"), F.max(F.when(F.col("__at") == F.col("r2"), F.col("__v"))).alias("s2"))


def _narrowed(rows: DataFrame, want: DataFrame, groups: int) -> tuple[DataFrame, DataFrame]:
    """One pass: (rows with the bounds of their group, want with its open ranks counted from the lower bound and with found values).

    ``want``: (__g, __w, inside: rows, p: pivots, r1, r2, v1, v2).
    """
    first, last = F.coalesce("r1", "r2"), F.coalesce("r2", "r1")
    low = F.greatest(F.floor(first / F.col("inside") * GRID).cast("int") - 1, F.lit(0))
    high = F.least(F.ceil((last + 1) / F.col("inside") * GRID).cast("int") + 1, F.lit(GRID))
    bounds = want.select(*KEYS, "r1", "r2", "v1", "v2", F.col("p")[low].alias("a"), F.col("p")[high].alias("b"))
    met = _met(rows, bounds.select(*KEYS, "a", "b"), groups)
    v, a, b = F.col("__v"), F.col("a"), F.col("b")
    counts = met.groupBy(*KEYS).agg(F.count_if(v < a).alias("below"), F.count_if(v == a).alias("at_a"), F.count_if((v > a) & (v < b)).alias("inside"), F.count_if((v == b) & (b > a)).alias("at_b"))
    start = F.col("below") + F.col("at_a")

    def found(r: str, v_: str) -> Column:
        on_a = (F.col(r) >= F.col("below")) & (F.col(r) < start)
        on_b = (F.col(r) >= start + F.col("inside")) & (F.col(r) < start + F.col("inside") + F.col("at_b"))
        return F.coalesce(F.col(v_), F.when(on_a, a).when(on_b, b))

    state = counts.join(bounds, KEYS).withColumns({"v1": found("r1", "v1"), "v2": found("r2", "v2"), "o1": F.col("r1"), "o2": F.col("r2")})
    state = state.withColumns({r: F.when(F.col(v_).isNull(), F.col(r) - start) for r, v_ in (("r1", "v1"), ("r2", "v2"))})
    lost = (F.least("r1", "r2") < 0) | (F.greatest("r1", "r2") >= F.col("inside"))
    return met.where((v > a) & (v < b)).select(*KEYS, "__v"), cut(state.withColumn("lost", F.coalesce(lost, F.lit(False))))


def select_ranks(rows: DataFrame, want: DataFrame, limit: int = LIMIT) -> DataFrame:
    """(__g, __w, v1, v2): the values at ranks r1 and r2 (from 0) of each group in ascending order.

    ``rows``: (__g, __w, __v double without nulls); ``want``: (__g, __w, n rows, r1, r2).  ``rows`` is read once where all
    groups are small, and four times for large ones.
    """
    want = cut(want.select(*KEYS, F.col("n").alias("inside"), "r1", "r2", F.lit(None).cast("double").alias("v1"), F.lit(None).cast("double").alias("v2")))
    done: list[DataFrame] = []
    while True:
        few, many = want.agg(F.count_if(F.col("inside") <= limit), F.count_if(F.col("inside") > limit)).first()
        small, large = want.where(F.col("inside") <= limit), want.where(F.col("inside") > limit)
        if few:
            part = _met(rows, small.select(*KEYS), few, "left_semi") if many else rows
            found = small.join(_sorted_ranks(part, small), KEYS, "left")
            done.append(found.select(*KEYS, F.coalesce("v1", "s1").alias("v1"), F.coalesce("v2", "s2").alias("v2")))
        if not many:
            break
        own = _met(rows, large.select(*KEYS), many, "left_semi") if few else rows
        inner, state = _narrowed(own, cut(large.join(own.groupBy(*KEYS).agg(_pivots().alias("p")), KEYS)), many)
        answered = F.col("r1").isNull() & F.col("r2").isNull()
        lost, open_ = state.agg(F.count_if("lost"), F.count_if(~F.col("lost") & ~answered)).first()
        done.append(state.where(answered).select(*KEYS, "v1", "v2"))
        if lost:  # a sketch was outside its bound: these groups are sorted as they are
            again = state.where("lost").select(*KEYS, F.col("o1").alias("r1"), F.col("o2").alias("r2"), "v1", "v2")
            found = again.join(_sorted_ranks(_met(rows, again.select(*KEYS), lost, "left_semi"), again), KEYS)
            done.append(found.select(*KEYS, F.coalesce("v1", "s1").alias("v1"), F.coalesce("v2", "s2").alias("v2")))
        if not open_:
            break
        left = state.where(~F.col("lost") & ~answered).select(*KEYS, "inside", "r1", "r2", "v1", "v2")
        rows, want = cut(_met(inner, left.select(*KEYS), open_, "left_semi")), left
    out = want.limit(0).select(*KEYS, "v1", "v2")
    for more in done:
        out = out.unionByName(more)
    return out


def linear(q: float) -> tuple[Column, Column, Column]:
    """Ranks r1, r2 and the weight of the second of the interpolated quantile of ``n`` values."""
    at = F.lit(q) * (F.col("n") - 1)
    return F.floor(at).cast("long"), F.ceil(at).cast("long"), at - F.floor(at)


def nearest(q: float) -> tuple[Column, Column, Column]:
    """The smallest value that at least a share ``q`` of the values do not exceed."""
    r = F.greatest(F.ceil(F.lit(q) * F.col("n")).cast("long") - 1, F.lit(0).cast("long"))
    return r, r, F.lit(0.0)


def upper_middle() -> tuple[Column, Column, Column]:
    """The element at n div 2: the upper one of two middles."""
    r = F.expr("n div 2")
    return r, r, F.lit(0.0)


def exact_quantiles(rows: DataFrame, by: list[str], wanted: Mapping[str, tuple[Column, object]], limit: int = LIMIT) -> DataFrame:
    """One row a group of ``by`` (one in all if it is empty) with a column for each of ``wanted``: name to (value, kind).

    ``kind`` is a share (the interpolated quantile) or the result of ``nearest`` or ``upper_middle``.  Nulls of a value are left
    out; a group without values has null.
    """
    kinds = [linear(k) if isinstance(k, float) else k for _, k in wanted.values()]
    group = F.struct(*by) if by else F.struct(F.lit(0).alias("__all"))
    pairs = F.array(*[F.struct(F.lit(i).alias("__w"), v.cast("double").alias("__v")) for i, (v, _) in enumerate(wanted.values())])
    long = rows.select(group.alias("__g"), F.inline(pairs)).where("__v IS NOT NULL")
    sizes = long.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("n"))

    def pick(part: int) -> Column:
        out = kinds[-1][part]
        for i in range(len(kinds) - 2, -1, -1):
            out = F.when(F.col("__w") == i, kinds[i][part]).otherwise(out)
        return out

    want = cut(sizes.withColumns({"r1": pick(0), "r2": pick(1), "weight": pick(2)}))
    found = select_ranks(long, want, limit).join(want.select(*KEYS, "weight"), KEYS)
    value = F.when(F.col("v1") == F.col("v2"), F.col("v1")).otherwise(F.col("v1") * (1 - F.col("weight")) + F.col("v2") * F.col("weight"))
    each = found.select(*KEYS, value.alias("__x"))
    out = each.groupBy("__g").agg(*[F.max(F.when(F.col("__w") == i, F.col("__x"))).alias(name) for i, name in enumerate(wanted)])
    return out.select(*([F.col(f"__g.`{c}`") for c in by]), *wanted) if by else out.select(*wanted)


def with_quantiles(rows: DataFrame, by: list[str], aggregates: list[Column], wanted: Mapping[str, tuple[Column, object]], limit: int = LIMIT) -> DataFrame:
    """``rows.groupBy(by).agg(aggregates)`` with the columns of ``exact_quantiles``."""
    plain = rows.groupBy(*by).agg(*aggregates)
    found = exact_quantiles(rows, by, wanted, limit)
    if not by:
        return plain.join(found, F.lit(True), "left")  # a row each
    renamed = found.select(*[F.col(c).alias(f"__q{i}") for i, c in enumerate(by)], *wanted)
    same = [F.col(c).eqNullSafe(F.col(f"__q{i}")) for i, c in enumerate(by)]
    on = same[0]
    for s in same[1:]:
        on = on & s
    return plain.join(renamed, on, "left").drop(*[f"__q{i}" for i in range(len(by))])
