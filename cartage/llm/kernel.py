"""Vectorised byte and word primitives that run inside Arrow batches.

Texts of a batch lie end to end in one byte array; every function works on the whole array, so no Python runs per
document.  Hashes are polynomials mod 2**64 over random byte values, read off prefix sums and then mixed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20
_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_rng = np.random.default_rng(20240607)
BYTE_VALUE = _rng.integers(1, 2**63, 256, dtype=np.uint64)
#: Lower-cases A-Z only.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes of words: 0-9, a-z and everything beyond ASCII (A-Z is lower-cased first).
WORD_BYTE = np.zeros(256, bool)
WORD_BYTE[48:58] = WORD_BYTE[97:123] = WORD_BYTE[128:] = True
#: Blank bytes between plain tokens: space and \t to \r.
SPACE_BYTE = np.zeros(256, bool)
SPACE_BYTE[[32, 9, 10, 11, 12, 13]] = True
_pow = np.ones(1, np.uint64)
_inv = np.ones(1, np.uint64)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i mod 2**64 for i below ``n`` at least."""
    global _pow, _inv
    if len(_pow) < n:
        size = max(n, SLICE_BYTES + 4096)
        tables = []
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            t = np.full(size, base, np.uint64)
            t[0] = 1
            tables.append(np.cumprod(t, dtype=np.uint64))
        _pow, _inv = tables
    return _pow, _inv


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every output bit depends on every input bit."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def prefix_sums(buf: np.ndarray) -> np.ndarray:
    p, _ = powers(len(buf) + 1)
    out = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(BYTE_VALUE[buf] * p[: len(buf)], out=out[1:])
    return out


def span_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash of each byte string buf[start:end], the same wherever the string stands."""
    _, inv = powers(len(sums))
    return mix((sums[end] - sums[start]) * inv[start])


def slices(column: pa.Array | pa.ChunkedArray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, bytes, offsets) of runs of texts of about ``limit`` bytes; a longer text is a run of its own.

    The column is of strings or of binary; nulls count as empty.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()).fill_null(b"")
    n = len(column)
    if not n:
        return
    _, offs, data = column.buffers()
    off = np.frombuffer(offs, np.int64)[column.offset : column.offset + n + 1]
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(off, off[at] + limit, "right")) - 1)
        to = min(to, n)
        yield at, to, whole[off[at] : off[to]], off[at : to + 1] - off[at]
        at = to


def runs(inside: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of True, cut where a document ends."""
    n = len(inside)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    first = np.zeros(n + 1, bool)
    first[off[:-1]] = True
    before = np.zeros(n, bool)
    before[1:] = inside[:-1]
    start = inside & (~before | first[:n])
    after = np.zeros(n, bool)
    after[:-1] = inside[1:]
    end = inside & (~after | first[1:])
    end[-1] = inside[-1]
    return np.flatnonzero(start), np.flatnonzero(end) + 1


def words(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, document index) of every word; ``buf`` is lower-cased already."""
    s, e = runs(WORD_BYTE[buf], off)
    return span_hash(prefix_sums(buf), s, e), np.searchsorted(off, s, "right") - 1


def shingles(word: np.ndarray, doc: np.ndarray, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(hash, document index) of every ``width``-word shingle; a document with fewer words has one, of all its words."""
    if not len(word):
        return word, doc
    p, inv = powers(max(len(word) + 1, SLICE_BYTES))
    sums = np.zeros(len(word) + 1, np.uint64)
    np.cumsum(word * p[: len(word)], out=sums[1:])
    lo = np.searchsorted(doc, doc, "left")
    hi = np.searchsorted(doc, doc, "right")
    at = np.arange(len(word))
    keep = (at + width <= hi) | (at == lo)
    at, end = at[keep], np.minimum(at + width, hi)[keep]
    return mix((sums[end] - sums[at]) * inv[at]), doc[keep]


def hash_ints(x: np.ndarray, seed: int) -> np.ndarray:
    return mix(x.astype(np.uint64) * _U(0xD6E8FEB86659FD93) + _U((seed * 0xA0761D6478BD642F + 0x632BE59BD9B4E019) % (1 << 64)))


def uniform(h: np.ndarray) -> np.ndarray:
    return (h >> _U(11)).astype(np.float64) * 2.0**-53
