"""What a caller may see and in which order: clamped lists, details, bound reads, defaults on first use, flat payloads, usage by turn."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from cartage.operators import relational

#: The longest list, the longest text of a detail, what stands for a missing heading or category.
LIST_MOST, DETAIL_CHARS, HEADING, CATEGORY = 1000, 40_000, "Company policy", "policy"


def clamped(limit: Column) -> Column:
    return F.least(F.greatest(limit, F.lit(1)), F.lit(LIST_MOST))


def first_of_each(rows: DataFrame, owner: str, order: list[Column], limit: Column) -> DataFrame:
    """The first rows of each owner in ``order``, with ``place``; ``limit`` is what was asked for, clamped."""
    place = F.row_number().over(Window.partitionBy(owner).orderBy(*order))
    return rows.withColumn("place", place).where((F.col("place") <= LIST_MOST) & (F.col("place") <= clamped(limit)))


def seeded_configs(companies: DataFrame, configs: DataFrame, default: Mapping[str, Column], key: str = "company_id") -> tuple[DataFrame, DataFrame]:
    """(the active configuration of every company, the rows to store): a company without one gets version 1 of the default."""
    active = configs.where("is_active")
    missing = companies.select(key).distinct().join(configs.select(key).distinct(), key, "left_anti")
    seeds = missing.select(key, F.lit(1).alias("version"), F.lit(True).alias("is_active"), *[v.alias(k) for k, v in default.items()])
    every = active.select(*seeds.columns).withColumn("seeded", F.lit(False)).unionByName(seeds.withColumn("seeded", F.lit(True)))
    return companies.join(every, key), relational.new_version(configs.limit(0), seeds.drop("version", "is_active"), key)


def document_detail(text: Column) -> Column:
    """Struct: the text up to ``DETAIL_CHARS`` (null if empty) and whether it was cut."""
    body = F.coalesce(text, F.lit(""))
    return F.struct(F.nullif(F.substring(body, 1, DETAIL_CHARS), F.lit("")).alias("text"), (F.length(body) > DETAIL_CHARS).alias("truncated"))


def opened(keys: DataFrame, stored: DataFrame, key: str, new: Mapping[str, Column]) -> tuple[DataFrame, DataFrame]:
    """(a row of ``stored`` or a new one for each key, the new rows): get or create under a unique key, each created once."""
    made = keys.select(*[c for c in keys.columns if c == key or c in stored.columns]).dropDuplicates([key]).join(stored.select(key), key, "left_anti").withColumns(dict(new))
    every = stored.withColumn("created", F.lit(False)).unionByName(made.withColumn("created", F.lit(True)), allowMissingColumns=True)
    return keys.select(key).distinct().join(every, key), made


def bound(rows: DataFrame, scope: DataFrame, keys: Sequence[str], allowed: Sequence[str]) -> DataFrame:
    """Rows that belong to a caller's scope, with the allowed fields only; a scope that owns nothing gets nothing."""
    return rows.join(scope.select(*keys).distinct(), list(keys), "left_semi").select(*keys, *allowed)


def without(items: Column, *dropped: str, fields: Sequence[str]) -> Column:
    """An array of structs without some of their fields."""
    kept = [f for f in fields if f not in dropped]
    return F.transform(items, lambda x: F.struct(*[x[f].alias(f) for f in kept]))


def flattened(rows: DataFrame, *nested: str, sep: str = "_") -> DataFrame:
    """``rows`` with the fields of the nested columns as columns of their own: origin.floor as origin_floor."""
    out = []
    for f in rows.schema:
        if f.name in nested and isinstance(f.dataType, StructType):
            out += [F.col(f"`{f.name}`.`{x.name}`").alias(f"{f.name}{sep}{x.name}") for x in f.dataType]
        elif f.name not in nested:
            out.append(F.col(f"`{f.name}`"))
    return rows.select(*out)


def or_default(value: Column, default: str) -> Column:
    return F.coalesce(F.nullif(F.trim(value), F.lit("")), F.lit(default))


def category_title(category: Column) -> Column:
    """refund_policy as Refund Policy."""
    return F.initcap(F.trim(F.regexp_replace(F.coalesce(category, F.lit("")), r"[_\-\s]+", " ")))


def usage_by_turn(messages: DataFrame, thread: str, turn: str, role: Column, tokens: Column) -> DataFrame:
    """(thread, turn, input_tokens, output_tokens) of each answer: what stands before it is its input, sent anew each time."""
    before = Window.partitionBy(thread).orderBy(turn).rowsBetween(Window.unboundedPreceding, -1)
    step = messages.select(thread, turn, (role == "assistant").alias("__answer"), tokens.cast("long").alias("__n"))
    step = step.withColumn("__in", F.coalesce(F.sum("__n").over(before), F.lit(0)))
    return step.where("__answer").select(thread, turn, F.col("__in").alias("input_tokens"), F.col("__n").alias("output_tokens"))


def answered(found: Column, failed: Column) -> Column:
    """A list of answers that tells no answer (an empty list) from a failed search (null)."""
    return F.when(failed, F.lit(None)).otherwise(F.coalesce(found, F.array().cast("array<string>")))
