"""Operator 5: media columns in a content-defined chunk store.

A payload (UTF-8 text, zero-padded to a positive multiple of 64) is stored losslessly as 8-bit samples of a mono WAV
file.  A rolling gear hash cuts the file where the bytes say so, so shared passages give shared chunks.

1. A scan without bytes makes each file's ordered chunk list (digests and sizes).
2. Equal files are one; Spark joins on the digests choose one owner for every distinct chunk.
3. A second scan writes each owner's chunks, one row a file; files that repeat chunks skip them.  Which to skip is a table
   of exceptions only, broadcast while it lists at most ``max_exceptions`` chunks, else shuffled.
4. Files are put together from their chunk lists: most have all their chunks in their own row; others borrow shared ones
   through a join.  Sizes and sha-256 must match the list, or the job fails.

Features are computed from the bytes read back.

Defined cases: null and empty texts are 64 zero bytes; equal texts share everything; repeated ids are rows of their own;
null ids own chunks after all others; a text is as long as a row can hold (2 GiB), under the 4 GiB that the form's header counts,
and is cut whole by one task; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import _delete_on_exit, attach_groups, broadcast_if, join_spread, materialize, scratch_root, small_batches

RATE, UNIT = 8000, 64
MIN_CHUNK, MASK_BITS, MAX_CHUNK = 1024, 12, 16384
GEAR = np.random.default_rng(7).integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
CHUNK = "array<struct<pos: int, digest: binary, bytes: binary>>"


def payload_of(text: str | None) -> tuple[bytes, int]:
    """(padded payload, its bytes without padding)."""
    raw = (text or "").encode()
    return raw + bytes(-len(raw) % UNIT if raw else UNIT), len(raw)


def to_wav(payload: bytes) -> bytes:
    """8-bit mono PCM: one sample a byte."""
    head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(payload), b"WAVE", b"fmt ", 16, 1, 1, RATE, RATE, 1, 8, b"data", len(payload))
    return head + payload


def from_wav(media: bytes) -> bytes:
    size = struct.unpack_from("<I", media, 40)[0]
    if media[:4] != b"RIFF" or media[36:40] != b"data" or len(media) != 44 + size:
        raise ValueError("not a stored media file")
    return media[44:]


def cut_points(media: bytes) -> list[int]:
    """Ends of the chunks: where the top bits of a gear hash of the last 64 bytes are 0, within the size limits."""
    n = len(media)
    if n <= MIN_CHUNK:
        return [n]
    h = GEAR[np.frombuffer(media, np.uint8)]
    wide = 1
    while wide < 64:
        h[wide:] = h[wide:] + (h[:-wide] << np.uint64(wide))
        wide *= 2
    ends, last = [], 0
    for c in (np.flatnonzero(h >> np.uint64(64 - MASK_BITS) == 0) + 1).tolist():
        while c - last > MAX_CHUNK:
            last += MAX_CHUNK
            ends.append(last)
        if c - last >= MIN_CHUNK:
            ends.append(c)
            last = c
    while n - last > MAX_CHUNK:
        last += MAX_CHUNK
        ends.append(last)
    return ends if last == n else [*ends, n]


def chunks_of(media: bytes) -> Iterator[tuple[bytes, bytes]]:
    """(digest, bytes) in order."""
    at = 0
    for end in cut_points(media):
        part = media[at:end]
        yield hashlib.blake2b(part, digest_size=16).digest(), part
        at = end


def feature_of(payload: bytes) -> str:
    """Mean, root mean square, zero crossings and peak of the samples around 128."""
    x = np.frombuffer(payload, np.uint8).astype(np.int64) - 128
    crossings = int(np.count_nonzero((x[1:] < 0) != (x[:-1] < 0)))
    return f"mean={x.mean():.4f};rms={np.sqrt((x * x).mean()):.4f};zc={crossings};peak={int(np.abs(x).max())}"


def _list(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = []
        for text in b.column(2).to_pylist():
            payload, n = payload_of(text)
            media = to_wav(payload)
            rows.append((n, hashlib.sha256(media).digest(), [d for d, _ in chunks_of(media)]))
        cols = list(zip(*rows, strict=True)) or [()] * 3
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.binary()), pa.array(cols[2], pa.list_(pa.binary()))], names=["doc_id", "t", "n_bytes", "media", "list"])


def _store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("pos", pa.int32()), ("digest", pa.binary()), ("bytes", pa.binary())]))
    for b in batches:
        out = []
        for text, skip, lend in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
            skip, lend = set(skip or ()), set(lend or ())
            media = to_wav(payload_of(text)[0])
            parts = list(chunks_of(media))
            own = [{"pos": i, "digest": d, "bytes": x} for i, (d, x) in enumerate(parts) if i not in skip]
            out.append((own, [c for c in own if c["pos"] in lend], not skip, hashlib.sha256(media).digest(), [d for d, _ in parts]))
        cols = list(zip(*out, strict=True)) or [()] * 5
        yield pa.RecordBatch.from_arrays(
            [b.column(0), pa.array([[{**c, "bytes": None} if c["pos"] in {x["pos"] for x in lent} else c for c in own] for own, lent in zip(cols[0], cols[1], strict=True)], kind), pa.array(cols[1], kind), pa.array(cols[2], pa.bool_()), pa.array(cols[3], pa.binary()), pa.array(cols[4], pa.list_(pa.binary()))],
            names=["t", "own", "lent", "whole", "media", "list"],
        )


def _rebuild(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (t, digest of the media, list of digests, chunks): the verified media's values."""
    for b in batches:
        rows = []
        for sha, wanted, parts in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
            by_pos = {c["pos"]: c for c in parts if c["bytes"] is not None}
            media = b"".join(by_pos[i]["bytes"] for i in range(len(wanted)))
            if hashlib.sha256(media).digest() != sha or any(by_pos[i]["digest"] != d for i, d in enumerate(wanted)):
                raise ValueError("a media file read back differs from what was stored")
            payload = from_wav(media)
            rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-UNIT:]), len(media), sha.hex(), feature_of(payload), len(wanted)))
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
        cols = list(zip(*rows, strict=True)) or [()] * 7
        yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], names=["t", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "n_chunks"])


VALUES = "t binary, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, n_chunks long"


def store_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, max_exceptions: int = 1_000_000) -> tuple[DataFrame, DataFrame]:
    """Write the chunk store; (lists: doc_id, t, n_bytes, media, list; store: t, own, lent, whole, media, list)."""
    spark = docs.sparkSession
    small_batches(spark)
    body = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.unhex(F.sha2(body.cast("binary"), 256)).alias("t"), body.alias("text"))
    lists = materialize(rows.mapInArrow(_list, "doc_id long, t binary, n_bytes long, media binary, list array<binary>"))
    files = lists.groupBy("t").agg(F.min("doc_id").alias("owner"), F.min("list").alias("list"), F.count(F.lit(1)).alias("n"))
    uses = materialize(files.select("t", "owner", F.posexplode("list").alias("pos", "digest")))
    owners = uses.groupBy("digest").agg(F.min(F.struct(F.col("owner").isNull(), F.col("owner"), F.col("t"), F.col("pos"))).alias("at"), F.count(F.lit(1)).alias("refs")).where("refs > 1")
    shared = attach_groups(uses, owners, ["digest"], "refs").where("refs > 1")
    mine = (F.col("t") == F.col("at.t")) & (F.col("pos") == F.col("at.pos"))
    plan = shared.groupBy("t").agg(F.collect_list(F.when(~mine, F.col("pos"))).alias("skip"), F.collect_list(F.when(mine, F.col("pos"))).alias("lend"))
    plan = materialize(plan)
    if (plan.agg(F.sum(F.size("skip") + F.size("lend"))).first()[0] or 0) <= max_exceptions:
        plan = F.broadcast(plan)
    copies = attach_groups(lists.select("doc_id", "t"), files.where("n > 1").select("t", "owner", "n"), ["t"], "n").where(F.col("n").isNotNull() & ~F.col("doc_id").eqNullSafe(F.col("owner"))).select("doc_id", "t")
    copies, _ = broadcast_if(materialize(copies.distinct()), max_exceptions)
    firsts = rows.join(copies, rows["doc_id"].eqNullSafe(copies["doc_id"]) & (rows["t"] == copies["t"]), "left_anti")
    path = path or f"{scratch_root(spark)}/media-{uuid.uuid4().hex}"
    written = firsts.join(plan, "t", "left").select("t", "text", "skip", "lend").mapInArrow(_store, f"t binary, own {CHUNK}, lent {CHUNK}, whole boolean, media binary, list array<binary>")
    written.write.option("compression", "zstd").parquet(path)
    _delete_on_exit(spark, path)
    return lists, spark.read.schema(written.schema).parquet(path)


def read_media(store: DataFrame) -> DataFrame:
    """(t, values of the media read back), one row for each distinct file."""
    # Files with all chunks in their own row need no other rows.
    near = store.where("whole").select("t", "media", "list", F.concat("own", "lent").alias("parts"))
    lent = store.select(F.explode("lent").alias("c")).select("c.digest", "c.bytes").dropDuplicates(["digest"])
    rest = store.where("NOT whole")
    have = rest.select("t", F.explode(F.concat("own", "lent")).alias("c")).where("c.bytes IS NOT NULL")
    need = rest.select("t", F.posexplode("list").alias("pos", "digest"))
    need = need.join(rest.select("t", F.explode("own.pos").alias("pos")), ["t", "pos"], "left_anti").distinct()
    borrowed = join_spread(materialize(need), lent, "digest", ["t", "pos"]).select("t", F.struct("pos", "digest", "bytes").alias("c"))
    far = have.unionByName(borrowed).groupBy("t").agg(F.collect_list("c").alias("parts")).join(rest.select("t", "media", "list").dropDuplicates(["t"]), "t")
    return near.unionByName(far.select("t", "media", "list", "parts")).mapInArrow(_rebuild, VALUES)


def media_columns(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """One row per row of ``docs`` with the values of its media, read back from the store."""
    lists, store = store_media(docs, id_col, text_col, path)
    values = materialize(read_media(store)).dropDuplicates(["t"])
    sizes = lists.groupBy("t").agg(F.count(F.lit(1)).alias("copies"))
    return attach_groups(lists.select("doc_id", "t", "n_bytes"), values.join(sizes, "t"), ["t"], "copies").drop("t", "copies")
