"""Operator 4: mixing sources to target weights by Poisson replication.

A source whose target share of the output is t and that has n of the N documents gets the mean repetition rate
t * size * N / n.  Each document draws its count from a Poisson distribution with that mean by inverting its distribution
function at a uniform number hashed from seed and id, is exploded by the count, and all copies are put in one global
order by another hash.  Nothing is random, so lost tasks repeat exactly.

Everything is a column expression.  Rates are one row per source, found by an aggregation that combines before the
shuffle; they are joined by broadcast while there are at most ``max_sources``, else by shuffle.

Defined cases: a null source is a source of its own; null and empty texts are replicated like others; null ids draw as
"null"; rows that repeat an id draw the same count; a source without a target has weight n ** alpha (``alpha`` below 1
favours small sources); texts of any length are carried whole and never read; an empty table gives an empty result; columns named like the added ones are kept out of the way
by prefixes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import broadcast_if, materialize

SEED, ALPHA, SIZE, MAX_COUNT_TERMS = "mix-1", 0.5, 1.0, 64


def hashed_uniform(seed: str, *parts: Column) -> Column:
    """A number in [0, 1) with 48 bits, from md5 of seed and parts."""
    text = F.concat_ws(":", F.lit(seed), *(F.coalesce(p.cast("string"), F.lit("null")) for p in parts))
    return F.conv(F.substring(F.md5(text), 1, 12), 16, 10).cast("double") / F.lit(float(1 << 48))


def source_rates(docs: DataFrame, source_col: str = "source", targets: dict[str, float] | None = None, size: float = SIZE, alpha: float = ALPHA) -> DataFrame:
    """(source, n, rate) for every source; ``targets`` are weights of any scale, ``size`` is output over input."""
    counts = materialize(docs.groupBy(F.col(source_col).alias("source")).agg(F.count(F.lit(1)).alias("n")))
    weight = F.pow(F.col("n").cast("double"), F.lit(alpha))
    if targets is not None:
        pairs = F.create_map(*(F.lit(x) for kv in targets.items() for x in kv)) if targets else None
        weight = F.coalesce(F.try_element_at(pairs, F.coalesce("source", F.lit(""))), F.lit(0.0)).cast("double") if targets else F.lit(0.0)
    weighed = counts.withColumn("w", weight)
    total = weighed.agg(F.sum("w").alias("all_w"), F.sum("n").alias("all_n"))
    return weighed.crossJoin(F.broadcast(total)).select("source", "n", F.when(F.col("all_w") > 0, F.col("w") / F.col("all_w") * F.lit(size) * F.col("all_n") / F.col("n")).otherwise(F.lit(0.0)).alias("rate"))


def poisson_steps(rates: DataFrame, terms: int = MAX_COUNT_TERMS) -> DataFrame:
    """(source, n, rate, whole, rest, steps): a rate is cut into ``whole`` draws of mean 16 and one of mean ``rest``.

    steps[i] is the distribution function of the rest at i, steps16 that of mean 16; 64 terms leave less than 1e-15.
    """
    whole = F.floor(F.col("rate") / F.lit(16.0)).cast("int")

    def steps(mean: Column) -> Column:
        start = F.struct(F.exp(-mean).alias("term"), F.lit(0.0).alias("total"), F.array().cast("array<double>").alias("out"))
        k = F.sequence(F.lit(1), F.lit(terms))
        return F.aggregate(
            k,
            start,
            lambda a, i: F.struct((a["term"] * mean / i).alias("term"), (a["total"] + a["term"]).alias("total"), F.concat(a["out"], F.array(a["total"] + a["term"])).alias("out")),
            lambda a: a["out"],
        )

    cut = rates.withColumn("whole", whole).withColumn("rest", F.col("rate") - F.col("whole") * F.lit(16.0))
    return cut.withColumn("steps", steps(F.col("rest"))).withColumn("steps16", steps(F.lit(16.0)))


def mix_sources(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", targets: dict[str, float] | None = None, size: float = SIZE, alpha: float = ALPHA, seed: str = SEED, max_sources: int = 100_000) -> DataFrame:
    """``docs`` replicated and in global random order, with __rate, __copy (from 0), __copies and __order added."""
    rates = materialize(poisson_steps(source_rates(docs, source_col, targets, size, alpha)))
    rates, _ = broadcast_if(rates.select(F.col("source").alias("__source"), F.col("rate").alias("__rate"), "whole", "steps", "steps16"), max_sources)
    rates = rates.select("__source", "__rate", F.struct("whole", "steps", "steps16").alias("__draw"))

    def draw(steps: Column, u: Column) -> Column:
        return F.size(F.filter(steps, lambda s: s <= u))

    more = F.aggregate(
        F.sequence(F.lit(1), F.col("__draw.whole")), F.lit(0), lambda a, i: a + draw(F.col("__draw.steps16"), hashed_uniform(seed + "/16", F.col(id_col), i))
    )
    joined = docs.join(rates, docs[source_col].eqNullSafe(F.col("__source")))
    count = draw(F.col("__draw.steps"), hashed_uniform(seed, F.col(id_col))) + F.when(F.col("__draw.whole") > 0, more).otherwise(F.lit(0))
    counted = joined.withColumn("__copies", count.cast("int")).where("__copies > 0").drop("__source", "__draw")
    copies = counted.withColumn("__copy", F.explode(F.sequence(F.lit(0), F.col("__copies") - 1)))
    order = hashed_uniform(seed + "/order", F.col(id_col), F.col("__copy"))
    # Keys are uniform in [0, 1), so equal ranges are equal parts: no sample is drawn, and the draws run once.
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = copies.withColumn("__order", order)
    return ordered.repartitionById(parts, F.least(F.floor(F.col("__order") * parts), F.lit(parts - 1)).cast("int")).sortWithinPartitions("__order")


def mixed_documents(docs: DataFrame, **options: object) -> DataFrame:
    """The mixture with the columns of ``docs`` only."""
    return mix_sources(docs, **options).select(*[F.col(f"`{c}`") for c in docs.columns])
