"""Operator 6: packing by optimal length buckets.

A document is a run of tokens (words between blanks, and one end); runs longer than ``max_len`` are cut into pieces of
``max_len`` and a rest, so nothing is dropped.  The histogram of piece lengths has at most ``max_len`` rows whatever the
corpus; dynamic programming over it puts ``buckets`` upper bounds where the total padding is least.  In a bucket of
bound b, batches hold budget // b pieces.  Pieces are numbered without a single-task window: each bucket is dealt to
shards by a hash of id and piece, numbered inside its shard, and the shard's offset is added; so a hot bucket and a very
long document are spread, and only the last batch of a bucket is partly filled.  There is a shard for every ``per_shard``
rows, at least 256 and at most 65 536, so the table of offsets has at most buckets * 65 536 rows.

Defined cases: null and empty texts are one end token; null ids are dealt together by text hash; rows that repeat an id
are packed each; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import materialize

MAX_LEN, BUCKETS, BUDGET, PER_SHARD = 2048, 8, 16384, 500_000


def token_length(text: Column) -> Column:
    """Tokens between blanks (space, \\t to \\r), and one end."""
    found = F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+"))
    return (found + 1).cast("long")


def optimal_bounds(histogram: dict[int, int], buckets: int) -> list[int]:
    """Upper bounds of at most ``buckets`` buckets with the least total padding; exact, by dynamic programming.

    cost(i, j) pads lengths i+1..j to the j-th length: n(i..j) * length_j - tokens(i..j).
    """
    lengths = sorted(k for k, n in histogram.items() if n > 0)
    if not lengths:
        return []
    size = np.array(lengths, np.int64)
    n = np.concatenate([[0], np.cumsum([histogram[k] for k in lengths])]).astype(np.int64)
    tokens = np.concatenate([[0], np.cumsum([histogram[k] * k for k in lengths])]).astype(np.int64)
    m = len(lengths)
    best = np.full(m + 1, np.iinfo(np.int64).max // 4, np.int64)
    best[0] = 0
    cuts = []
    for _ in range(min(buckets, m)):
        nxt, cut = best.copy(), np.full(m + 1, -1, np.int64)
        for j in range(1, m + 1):
            cost = best[:j] + (n[j] - n[:j]) * size[j - 1] - (tokens[j] - tokens[:j])
            i = int(np.argmin(cost))
            if cost[i] < nxt[j]:
                nxt[j], cut[j] = cost[i], i
        cuts.append(cut)
        best = nxt
    bounds, j = [], m
    for cut in reversed(cuts):
        if j and cut[j] >= 0:
            bounds.append(int(size[j - 1]))
            j = int(cut[j])
    return sorted(bounds)


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_len: int = MAX_LEN, buckets: int = BUCKETS, budget: int = BUDGET, per_shard: int = PER_SHARD, length: Column | None = None) -> DataFrame:
    """One row per piece: doc_id, piece (from 0), start (token), length, bucket (its bound), batch, slot, capacity, padding."""
    n = token_length(F.col(text_col).cast("string")) if length is None else F.greatest(length.cast("long"), F.lit(1).cast("long"))
    salt = F.xxhash64(F.col(id_col), F.when(F.col(id_col).isNull(), F.col(text_col)))
    runs = materialize(docs.select(F.col(id_col).alias("doc_id"), n.alias("n"), salt.alias("salt")))
    shards = min(max(256, runs.count() // per_shard), 65_536)
    many = F.ceil(F.col("n") / F.lit(max_len)).cast("int")
    pieces = runs.withColumn("piece", F.explode(F.sequence(F.lit(0), many - 1)))
    pieces = pieces.withColumn("start", F.col("piece").cast("long") * max_len).withColumn("length", F.least(F.lit(max_len).cast("long"), F.col("n") - F.col("start")))
    pieces = pieces.withColumn("shard", F.pmod(F.xxhash64("salt", "piece"), F.lit(shards)).cast("int"))
    histogram = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}  # at most max_len rows
    bounds = optimal_bounds(histogram, buckets)
    upper = F.lit(None).cast("long")
    for b in reversed(bounds):
        upper = F.when(F.col("length") <= b, F.lit(b).cast("long")).otherwise(upper)
    pieces = pieces.withColumn("bucket", upper)
    place = Window.partitionBy("bucket", "shard").orderBy("doc_id", "piece", "n")
    numbered = materialize(pieces.withColumn("row", F.row_number().over(place) - 1))
    before = Window.partitionBy("bucket").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    sizes = numbered.groupBy("bucket", "shard").agg(F.count(F.lit(1)).alias("n_rows"))
    offset = F.coalesce(F.sum("n_rows").over(before), F.lit(0).cast("long"))
    table = F.broadcast(sizes.select("bucket", "shard", offset.alias("offset")))  # at most buckets * shards rows
    capacity = F.greatest(F.lit(1).cast("long"), F.floor(F.lit(budget) / F.col("bucket")).cast("long"))
    rank = F.col("row") + F.col("offset")
    out = numbered.join(table, ["bucket", "shard"]).withColumn("capacity", capacity)
    return out.select("doc_id", "piece", "start", "length", "bucket", F.floor(rank / F.col("capacity")).cast("long").alias("batch"), (rank % F.col("capacity")).cast("long").alias("slot"), "capacity", (F.col("bucket") - F.col("length")).alias("padding"))
