"""Operator 12: whitening of embeddings by a compensated covariance and a tridiagonal divide-and-conquer eigen-solve.

1. Entries become whole numbers x; Spark adds up S exactly.
2. Tasks centre x by S / n in double-double.  Outer products are error-free transformations: centred values are cut into
   slices of 20 bits, so that products of slices over a block of 2 048 rows are exact in doubles, and these are added in
   double-double.  High and low parts meet by matrix row in a shuffle and are merged there; no task and not the driver holds
   more than the square of the dimension.
3. The covariance (bounded by the dimension, not by the rows) is solved on the driver: reduction to tridiagonal form and
   divide and conquer (LAPACK's syevd), then two refining steps in extended precision, so that close eigenvalues cost no digits.
4. Rows are projected by tasks; the covariance of the result is taken in the same way and held against the identity.

Defined cases: a null vector and one that holds null, NaN or an infinity is left out; empty vectors have no components and
give no rows; vectors of different lengths are an error; entries beyond 2**52 count as that; components without variance
(equal rows, fewer rows than dimensions, a single row) are left out; null or repeated ids and repeated rows count each; other
columns are ignored; an empty table gives an empty result.  ``deviation`` is null where it passes 64 bits; ``deviation_text``
always has all its digits.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import materialize

COMPONENTS, BLOCK, SLICE_BITS, SLICES = 8, 2048, 20, 5


def two_sum(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """a + b without error: the rounded sum and what rounding took."""
    s = a + b
    t = s - a
    return s, (a - (s - t)) + (b - t)


def add_pair(hi: np.ndarray, lo: np.ndarray, b: np.ndarray, b_lo: np.ndarray | float = 0.0) -> tuple[np.ndarray, np.ndarray]:
    """(hi, lo) + (b, b_lo) in double-double."""
    s, e = two_sum(hi, b)
    return two_sum(s, e + (lo + b_lo))


def outer_products(hi: np.ndarray, lo: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sum of outer products of a block of rows of double-double values, in double-double."""
    d = hi.shape[1]
    _, power = np.frexp(np.abs(hi).max(axis=0, initial=0.0))
    rest = np.ldexp(hi, -power)  # below 1
    tail = np.ldexp(lo, -power)
    slices = []
    for k in range(SLICES):
        if k == 2:
            rest = rest + np.ldexp(tail, 2 * SLICE_BITS)
        rest = np.ldexp(rest, SLICE_BITS)
        slices.append(np.rint(rest))
        rest = rest - slices[-1]
    c_hi, c_lo = np.zeros((d, d)), np.zeros((d, d))
    for total in range(SLICES - 1, -1, -1):  # small ones first
        for i in range(total // 2 + 1):
            j = total - i
            p = slices[i].T @ slices[j]
            for q in (p, p.T) if i < j else (p,):
                c_hi, c_lo = add_pair(c_hi, c_lo, np.ldexp(q, -SLICE_BITS * (total + 2)))
    scale = power[:, None] + power[None, :]
    return np.ldexp(c_hi, scale), np.ldexp(c_lo, scale)


def _matrix(column: pa.Array) -> np.ndarray:
    """Lists of one length, without nulls, as rows."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    size = np.diff(column.offsets.to_numpy())
    if len(size) and (size != size[0]).any():
        raise ValueError("vectors of different lengths")
    return flat.reshape(len(size), int(size[0]) if len(size) else 0)


def whole_numbers(c: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.floor(np.clip(c.astype(np.float64), -(2.0**52), 2.0**52) * 1024).astype(np.int64) + 100_000


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (vector) to (i, n, high, low): sums of the upper and lower 32 bits of each dimension."""
    held: dict[int, list] = {}
    for b in batches:
        x = whole_numbers(_matrix(b.column(0)))
        if not x.size:
            continue
        n, high, low = held.setdefault(x.shape[1], [0, np.zeros(x.shape[1], np.int64), np.zeros(x.shape[1], np.int64)])
        held[x.shape[1]] = [n + len(x), high + (x >> 32).sum(axis=0), low + (x & 0xFFFFFFFF).sum(axis=0)]
    for d, (n, high, low) in held.items():
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(d)), pa.array(np.full(d, d)), pa.array(np.full(d, n)), pa.array(high), pa.array(low)], names=["i", "d", "n", "high", "low"])


class Centre:
    """The exact mean S / n of each dimension: a whole part, and the rest below 1 in double-double."""

    def __init__(self, n: int, sums: list[int]) -> None:
        self.n, self.sums = n, sums
        self.whole = np.array([s // n for s in sums], np.int64)
        rest = [Fraction(s % n, n) for s in sums]
        self.hi = np.array([float(r) for r in rest])
        self.lo = np.array([float(r - Fraction(h)) for r, h in zip(rest, self.hi, strict=True)])
        self.remainder = np.array([s % n for s in sums], np.int64)

    def __call__(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """x - S / n in double-double."""
        d = x - self.whole
        top = d.astype(np.float64)
        hi, lo = two_sum(top, -self.hi)
        return two_sum(hi, lo + ((d - top.astype(np.int64)).astype(np.float64) - self.lo))

    def deviations(self, x: np.ndarray) -> list[int]:
        """The sum over dimensions of (n x - S) ** 2 of each row, exactly."""
        d = x - self.whole
        far = (int(np.abs(d).max(initial=0)) + 1) * self.n
        if far * far * max(1, x.shape[1]) < 1 << 63:
            return ((d * self.n - self.remainder) ** 2).sum(axis=1).tolist()
        if far < 1 << 62 and x.shape[1] < 1 << 20:  # limbs of 21 bits
            z = d * self.n - self.remainder
            a, b, c = z >> 42, (z >> 21) & 0x1FFFFF, z & 0x1FFFFF
            parts = [(p * q).sum(axis=1).tolist() for p, q in ((a, a), (a, b), (a, c), (b, b), (b, c), (c, c))]
            return [(aa << 84) + (ab << 64) + (((ac << 1) + bb) << 42) + (bc << 22) + cc for aa, ab, ac, bb, bc, cc in zip(*parts, strict=True)]
        z = d.astype(object) * self.n - np.array([s % self.n for s in self.sums], object)
        return (z * z).sum(axis=1).tolist()


def _blocks(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[np.ndarray]:
    for b in batches:
        m = _matrix(b.column(column))
        for i in range(0, len(m), BLOCK):
            yield m[i : i + BLOCK]


def _covariance(batches: Iterator[pa.RecordBatch], centre: Centre | np.ndarray) -> Iterator[pa.RecordBatch]:
    """Rows (vector) to (i, hi, lo): row i of the sum of centred outer products."""
    hi = lo = None
    for m in _blocks(batches, 0):
        u = centre(whole_numbers(m)) if isinstance(centre, Centre) else two_sum(m, -centre)
        part = outer_products(*u)
        hi, lo = part if hi is None else add_pair(hi, lo, *part)
    if hi is not None:
        yield _rows(dict(enumerate(zip(hi, lo, strict=True))))


def _rows(found: dict[int, tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(found)), *[pa.array([list(v[k]) for v in found.values()], pa.list_(pa.float64())) for k in (0, 1)]], names=["i", "hi", "lo"])


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for b in batches:
        for i, hi, lo in zip(b.column(0).to_pylist(), _matrix(b.column(1)), _matrix(b.column(2)), strict=True):
            held[i] = add_pair(*held[i], hi, lo) if i in held else (hi, lo)
    if held:
        yield _rows(held)


def covariance(vectors: DataFrame, centre: Centre | np.ndarray, n: int, d: int) -> np.ndarray:
    """The covariance (divisor n) in extended precision; ``vectors`` has one column of lists."""
    kind = "i long, hi array<double>, lo array<double>"
    rows = vectors.mapInArrow(partial(_covariance, centre=centre), kind).repartition(min(d, 64), "i").mapInArrow(_merged, kind).toArrow()  # d rows
    out = np.zeros((d, d), np.longdouble)
    for i, hi, lo in zip(rows.column(0).to_pylist(), rows.column(1).to_pylist(), rows.column(2).to_pylist(), strict=True):
        out[i] = np.array(hi, np.longdouble) + np.array(lo, np.longdouble)
    return out / n


def eigen(v: np.ndarray, steps: int = 2) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors (columns) of a symmetric matrix of extended precision.

    Divide and conquer on the tridiagonal form gives them to the precision of doubles relative to the largest; each refining
    step (Ogita and Aishima, 2018) squares the error.  The largest entry of a vector is positive.
    """
    e, x = np.linalg.eigh(v.astype(np.float64))
    x = x.astype(np.longdouble)
    one = np.eye(len(v), dtype=np.longdouble)
    for _ in range(steps):
        r = one - x.T @ x
        s = x.T @ (v @ x)
        e = np.diag(s) / (1 - np.diag(r))
        off = s - np.diag(e)
        close = 2 * (np.linalg.norm(off.astype(np.float64)) + np.linalg.norm(v.astype(np.float64)) * np.linalg.norm(r.astype(np.float64)))
        gap = e[None, :] - e[:, None]
        apart = np.abs(gap) > close
        x = x + x @ np.where(apart, (s + e[None, :] * r) / np.where(apart, gap, 1), r / 2)
    order = np.argsort(-np.asarray(e, np.float64), kind="stable")
    e, x = np.asarray(e)[order], x[:, order]
    x = x / np.sqrt((x * x).sum(axis=0))
    top = np.abs(x).argmax(axis=0)
    return e, x * np.where(x[top, np.arange(len(e))] < 0, -1, 1)


def _whiten(batches: Iterator[pa.RecordBatch], centre: Centre, axes: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Rows (vec_id, vector) to (vec_id, deviation, deviation_text, w)."""
    for b in batches:
        x = whole_numbers(_matrix(b.column(1)))
        hi, lo = centre(x)
        w = hi @ axes + lo @ axes
        far = centre.deviations(x)
        yield pa.RecordBatch.from_arrays(
            [b.column(0), pa.array([v if v < 1 << 63 else None for v in far], pa.int64()), pa.array([str(v) for v in far]), pa.ListArray.from_arrays(pa.array(np.arange(len(w) + 1, dtype=np.int32) * w.shape[1]), pa.array(w.ravel()))],
            names=["vec_id", "deviation", "deviation_text", "w"],
        )


SCHEMA = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double, deviation_text string"


def whiten(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """One row for each vector and component: vec_id, component, n, deviation, whitened, explained, identity_error, deviation_text."""
    spark = rows.sparkSession
    vectors = rows.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    bad = F.exists("v", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == F.lit(float("inf"))))
    vectors = vectors.where(F.col("v").isNotNull() & ~bad & (F.size("v") > 0))
    sums = vectors.select("v").mapInArrow(_sums, "i long, d long, n long, high long, low long").groupBy("i").agg(F.sum("n"), F.sum(F.col("high").cast("decimal(38,0)")), F.sum(F.col("low").cast("decimal(38,0)")), F.min("d"), F.max("d")).orderBy("i").collect()  # a row a dimension
    if not sums:
        return spark.createDataFrame([], SCHEMA)
    n, d = sums[0][1], len(sums)
    if any(r[4] != r[5] for r in sums):
        raise ValueError("vectors of different lengths")
    centre = Centre(n, [(int(r[2]) << 32) + int(r[3]) for r in sums])
    e, x = eigen(covariance(vectors.select("v"), centre, n, d))
    trace = e.sum()
    kept = int(min(components, (e > trace * d * np.finfo(np.float64).eps).sum()))
    if not kept:
        return spark.createDataFrame([], SCHEMA)
    axes = (x[:, :kept] / np.sqrt(e[:kept])).astype(np.float64)
    found = materialize(vectors.mapInArrow(partial(_whiten, centre=centre, axes=axes), "vec_id long, deviation long, deviation_text string, w array<double>"))
    mean = np.array(found.agg(*[F.avg(F.col("w")[k]) for k in range(kept)]).first())
    error = float(np.abs(covariance(found.select("w"), mean, n, kept) - np.eye(kept)).max())
    share = F.array(*[F.lit(float(v)) for v in e[:kept] / trace])
    each = found.select("vec_id", "deviation", "deviation_text", F.posexplode("w").alias("k", "whitened"))
    return each.select("vec_id", (F.col("k") + 1).cast("int").alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened", share[F.col("k")].alias("explained"), F.lit(error).alias("identity_error"), "deviation_text")
