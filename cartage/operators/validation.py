"""Row validation: every rule looks at every row, and a row's worst finding is its verdict."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: (field, level: error or warning, condition that is true for a bad row, message).
Rule = tuple[str, str, Column, str]


def _findings(rules: Sequence[Rule], level: str) -> Column:
    found = [F.when(bad, F.struct(F.lit(field).alias("field"), F.lit(message).alias("message"))) for field, of, bad, message in rules if of == level]
    return F.array_compact(F.array(*found)).cast("array<struct<field:string,message:string>>")


def verdicts(rows: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """``rows`` with errors, warnings (arrays of field and message, in the rules' order) and status: error, warning or ok.

    A condition that is null finds nothing.
    """
    out = rows.withColumns({"errors": _findings(rules, "error"), "warnings": _findings(rules, "warning")})
    return out.withColumn("status", F.when(F.size("errors") > 0, "error").when(F.size("warnings") > 0, "warning").otherwise("ok"))


def verdict_counts(judged: DataFrame) -> DataFrame:
    """One row: rows by status."""
    return judged.agg(F.count(F.lit(1)).alias("n_rows"), *(F.count_if(F.col("status") == s).alias(f"n_{s}") for s in ("ok", "warning", "error")))
