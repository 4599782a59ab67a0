"""Operator 1: exact duplicates by progressive refinement.

Length groups first, then a hash of a short prefix inside them, then a full digest of the texts that are left.  Each level
passes on only keys that two or more rows share.  The key sets prune through broadcasts of at most ``max_keys`` rows; of a
larger set the slots that its keys fall in are sent, so some unique texts are hashed too, which changes no result.  No text is ever shuffled: rows are
met again by (length, prefix hash, digest), and only groups of two or more are joined back: the few largest, bounded in
number, by broadcast, the others by shuffle.

Defined cases: null text counts as empty; all empty texts are one group; a null id is smaller than any other; rows that
repeat an id with the same text are all members and share the verdict; a text of any length is hashed in place; other
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import attach_groups, materialize, unused


def _alive(rows: DataFrame, key: str, max_keys: int) -> DataFrame:
    """``rows`` with ``alive``: true for every key that two rows or more have, false for others as far as the broadcast tells."""
    keys = materialize(rows.select(key).where(F.col(key).isNotNull()).groupBy(key).count().where("count > 1").select(key))
    slot = F.col(key) if keys.count() <= max_keys else F.pmod(F.xxhash64(key), F.lit(max_keys))
    shared = F.broadcast(keys.select(slot.alias("slot"), F.lit(True).alias("shared")).distinct())  # at most max_keys rows
    return rows.withColumn("slot", slot).join(shared, "slot", "left").withColumn("alive", F.coalesce("shared", F.lit(False))).drop("shared", "slot")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", prefix_chars: int = 128, max_keys: int = 1_000_000, digest_all: bool = False) -> DataFrame:
    """One row per row of ``docs``: id, keep_id (largest id of the group), group_size, kept, digest (sha-256, binary).

    The digest is null for rows that a shorter key already proved unique, unless ``digest_all``.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("body"))
    rows = rows.withColumn("n_bytes", F.octet_length("body").cast("long"))
    for level, key in (("n_bytes", F.col("n_bytes")), ("prefix", F.xxhash64("n_bytes", F.substring("body", 1, prefix_chars)))):
        if level == "prefix":
            rows = rows.withColumn("prefix", F.when(F.col("alive"), key))
        rows = _alive(rows, level, max_keys)
    full = F.unhex(F.sha2(F.col("body").cast("binary"), 256))
    keys = materialize(rows.select("id", "n_bytes", "prefix", "alive", (full if digest_all else F.when(F.col("alive"), full)).alias("digest")))
    groups = keys.where("alive").groupBy("n_bytes", "prefix", "digest").agg(F.max("id").alias("keep"), F.count(F.lit(1)).alias("size")).where("size > 1")
    keys = keys.withColumn("prefix", F.when(F.col("alive"), F.col("prefix")))
    out = attach_groups(keys, groups, ["n_bytes", "prefix", "digest"], "size")
    keep = F.when(F.col("size").isNotNull(), F.col("keep")).otherwise(F.col("id"))
    return out.select(F.col("id").alias(id_col), keep.alias("keep_id"), F.coalesce("size", F.lit(1)).cast("long").alias("group_size"), F.col("id").eqNullSafe(keep).alias("kept"), "digest")


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the rows that are not kept; of rows that repeat an id and text, one stays.  Columns are unchanged."""
    gone, lost, body_key = unused(docs, "__gone", "__digest", "__body")
    losers = exact_dedup(docs, id_col, text_col).where(~F.col("kept")).select(F.col(id_col).alias(gone), F.col("digest").alias(lost))
    body = F.sha2(F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary"), 256)
    losers = materialize(losers.distinct())
    side = F.broadcast(losers) if losers.count() <= 1_000_000 else losers
    stay = docs.join(side, F.col(id_col).eqNullSafe(F.col(gone)) & (F.unhex(body) == F.col(lost)), "left_anti")
    again = materialize(stay.groupBy(F.col(id_col).alias("__id")).count().where("count > 1").select("__id"))
    if again.isEmpty():
        return stay
    return stay.withColumn(body_key, F.sha2(F.coalesce(F.col(text_col).cast("string"), F.lit("")), 256)).dropDuplicates([id_col, body_key]).drop(body_key)
