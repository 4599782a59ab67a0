"""A corpus pipeline of five of the operators; each stage works on all that the one before it kept.

A stage gets a table and returns one, so a lost executor costs a stage at most; a stage's own scratch tables go when its
result is written.

Defined cases: a row is known by its id and text, so rows with null or repeated ids share no verdict unless their texts are
equal too; null texts count as empty, are never toxic, and one row of them stays; of rows without words one stays; texts of
any length are worked on whole; columns of any name are carried to the mixing stage unchanged; an empty table gives an
empty result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from cartage.llm.dart_minhash import drop_near_duplicates
from cartage.llm.exact_dedup import drop_exact_duplicates
from cartage.llm.mixing import mixed_documents
from cartage.llm.packing import pack
from cartage.llm.scratch import drop_scratch, materialize, scratch_tables
from cartage.llm.toxicity import drop_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the lexicon model predicts toxic go."""
    return drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the one with the largest id stays."""
    return drop_exact_duplicates(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class stays."""
    return drop_near_duplicates(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources are replicated to weights of the square root of their size, in a global random order."""
    return mixed_documents(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in token-budget batches of optimal length buckets."""
    return pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxicity), ("exact_dedup", exact_dedup), ("minhash_near_dedup", near_dedup), ("mixing", mix), ("packing", packing),
]

#: MinHash classes, learnt lexicons and optimal buckets are beyond SQL; the tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    since = scratch_tables()
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
        drop_scratch(spark, since, keep=1)
    return STAGES[-1][1](spark, docs, sf_dir)
