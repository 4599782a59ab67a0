"""Operator 13: language of a text by prediction by partial matching.

Each language has a tree of byte contexts of 0 to ``depth`` bytes.  A byte is coded in its longest known context; a byte that
is new there costs an escape (method C: as probable as the number of different bytes of the context) and is coded in the
next shorter one, without the bytes that the longer one has already ruled out; below the empty context all bytes left are
alike.  Statistics are frozen, so the code length of a text is exact: a sum over its bytes and one end.  The shortest code wins.

1. The model is fitted on a bounded sample of labelled rows: whole texts by a hash of the text, ``sample_bytes`` in all, dealt
   evenly to the languages.  Texts longer than a language's share, and copies, are not in the sample.
2. Spark counts the sample's strings of depth + 1 bytes; shorter contexts are sums of these.  The tables are bounded by the
   sample and are broadcast.
3. Every row is scored on its whole text.  Code lengths of strings that occur in the sample are worked out once for all
   languages; others are worked out where they occur.

Defined cases: ``und`` with score 0 for a null text and one without a letter, and where nothing was learned; of equal code
lengths the first language in order wins; rows with a null language, null or empty texts don't train, rows with null ids do;
repeated rows score each; a text of any length is one task's, in slices of whole texts; other columns are ignored; an
empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import kernel as K
from .context_tree import Lookup, grams
from .scratch import materialize, small_batches

DEPTH, SAMPLE_BYTES = 4, 6_000_000
#: Code lengths worked out beforehand, at most (rows times languages).
READY = 32_000_000
_U = np.uint64


def held_out(id_col: Column) -> Column:
    return F.coalesce(F.crc32(id_col.cast("string")) % 4 == 2, F.lit(False))


def _sums(key: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """Each key once, in order, with the sums of its values."""
    order = np.argsort(key, kind="stable")
    key = key[order]
    head = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    return key[head], *[np.add.reduceat(v[order], head) if len(head) else v for v in values]


def _count(batches: Iterator[pa.RecordBatch], depth: int) -> Iterator[pa.RecordBatch]:
    """Rows (lang number, text) to (lang, key, n)."""
    for b in batches:
        number = b.column(0).to_numpy().astype(np.int64)
        for lo, hi, buf, off in K.slices(b.column(1)):
            key, edge = grams(K.LOWER[buf], off, depth)
            whose = np.repeat(number[lo:hi], np.diff(edge))
            for lang in np.unique(whose):
                k, n = np.unique(key[whose == lang], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(k), lang)), pa.array(k.view(np.int64)), pa.array(n)], names=["lang", "key", "n"])


class Tree:
    """The context tree of one language; the keys of level k are k bytes of context and the byte after them."""

    def __init__(self, key: np.ndarray, n: np.ndarray, depth: int) -> None:
        self.depth = depth
        levels = [(key, n)]
        for k in range(depth - 1, -1, -1):
            levels.append(_sums(levels[-1][0] & _U((1 << (8 * (k + 1))) - 1), levels[-1][1]))
        levels.reverse()
        self.strings = [Lookup(k, c.astype(np.float64), bits=16) for k, c in levels]
        #: By level, of each context: occurrences, different bytes, and the occurrences of these bytes one level up.
        self.contexts = []
        for k, (key, n) in enumerate(levels):
            above = self.strings[k - 1](key & _U((1 << (8 * k)) - 1))[0] if k else np.zeros(len(key))
            context, total, different, ruled = _sums(key >> _U(8), n.astype(np.float64), np.ones(len(key)), above)
            self.contexts.append((Lookup(context, np.arange(len(context), dtype=np.float64), bits=14), total, different, ruled))

    def code_lengths(self, key: np.ndarray) -> np.ndarray:
        """Bits of the last byte of each string of depth + 1 bytes after the bytes before it."""
        bits = np.zeros(len(key))
        open_ = np.arange(len(key))
        ruled, ruled_kinds = np.zeros(len(key)), np.zeros(len(key))  # by the longer context
        for k in range(self.depth, -1, -1):
            string = key[open_] & _U((1 << (8 * (k + 1))) - 1)
            context, total, different, above = self.contexts[k]
            at, known = context(string >> _U(8))
            at = at.astype(np.int64)
            pick = lambda values: np.where(known, values[at] if len(values) else 0.0, 0.0)  # noqa: E731, B023
            left, kinds = pick(total) - ruled, pick(different) - ruled_kinds
            count, seen = self.strings[k](string)
            fresh = known & (kinds > 0)
            whole = np.where(fresh, left + kinds, 1.0)
            seen &= fresh
            part = np.where(seen, count, np.where(fresh, kinds, 1.0))
            bits[open_] += np.log2(whole) - np.log2(part)
            keep = ~seen
            open_, ruled, ruled_kinds = open_[keep], np.where(known, pick(above), 0.0)[keep], np.where(known, pick(different), 0.0)[keep]
        bits[open_] += np.log2(256 - ruled_kinds)
        return bits


def fit(rows: DataFrame, depth: int = DEPTH, sample_bytes: int = SAMPLE_BYTES) -> tuple[list[str], dict]:
    """(languages, tables) from labelled rows (lang, text)."""
    rows = rows.where("lang IS NOT NULL AND text IS NOT NULL AND text != ''").withColumn("size", F.octet_length("text")).withColumn("u", F.pmod(F.xxhash64("text"), F.lit(1 << 52)) / float(1 << 52))
    sizes = {r[0]: r[1] for r in rows.groupBy("lang").agg(F.sum("size")).orderBy("lang").collect()}  # a row a language
    if not sizes:
        return [], {}
    langs, share = list(sizes), sample_bytes // len(sizes)
    spark = rows.sparkSession
    least = spark.createDataFrame([(name, k, min(1.0, 4.0 * share / max(1, sizes[name]))) for k, name in enumerate(langs)], "lang string, number int, most double")
    drawn = rows.where(F.col("size") <= share).join(F.broadcast(least), "lang").where(F.col("u") < F.col("most"))
    once = drawn.groupBy("number", "u", "size").agg(F.min("text").alias("text"))
    before = Window.partitionBy("number").orderBy("u", "size").rowsBetween(Window.unboundedPreceding, 0)  # a few times the share
    sample = once.withColumn("filled", F.sum("size").over(before)).where(F.col("filled") <= share).select("number", "text")
    counts = materialize(sample.mapInArrow(partial(_count, depth=depth), "lang long, key long, n long").groupBy("lang", "key").agg(F.sum("n").alias("n")))
    t = counts.toArrow()  # at most sample_bytes rows
    lang, key, n = (t.column(c).to_numpy() for c in ("lang", "key", "n"))
    key = key.view(np.uint64)
    tables = {}
    for k in range(len(langs)):
        own = np.flatnonzero(lang == k)
        own = own[np.argsort(key[own])]
        tables[k] = (key[own], n[own])
    every, uses = _sums(key, n)
    if len(every) * len(langs) > READY:
        every = np.sort(every[np.argsort(-uses, kind="stable")[: READY // len(langs)]])
    return langs, {"depth": depth, "trees": tables, "ready": every}


class Model:
    """Code lengths of strings in all languages."""

    def __init__(self, tables: dict) -> None:
        self.depth = tables["depth"]
        self.trees = [Tree(*t, self.depth) for _, t in sorted(tables["trees"].items())]
        self.values = self.work_out(tables["ready"])
        self.place = Lookup(tables["ready"], np.arange(len(tables["ready"]), dtype=np.float64))

    def work_out(self, key: np.ndarray) -> np.ndarray:
        return np.stack([t.code_lengths(key) for t in self.trees], axis=1)

    def __call__(self, key: np.ndarray) -> np.ndarray:
        at, known = self.place(key)
        out = self.values[at.astype(np.int64)] if len(self.values) else np.zeros((len(key), len(self.trees)))
        miss = np.flatnonzero(~known)
        if len(miss):
            new, back = np.unique(key[miss], return_inverse=True)
            out[miss] = self.work_out(new)[back]
        return out


_models: dict[int, tuple[dict, Model]] = {}


def _model(tables: dict) -> Model:
    """Worked out once a worker, not once a task; the worker's broadcast value stays the same object."""
    if id(tables) not in _models:
        _models.clear()
        _models[id(tables)] = (tables, Model(tables))
    return _models[id(tables)][1]


def _score(batches: Iterator[pa.RecordBatch], shared: Broadcast) -> Iterator[pa.RecordBatch]:
    """Rows (doc_id, text, has_letter) to (doc_id, has_letter, n_bytes, bits: by language)."""
    model = _model(shared.value)
    for b in batches:
        for lo, hi, buf, off in K.slices(b.column(1)):
            key, edge = grams(K.LOWER[buf], off, model.depth)
            bits = np.add.reduceat(model(key), edge[:-1], axis=0)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(hi - lo + 1, dtype=np.int32) * bits.shape[1]), pa.array(bits.ravel()))
            yield pa.RecordBatch.from_arrays([b.column(0)[lo:hi], b.column(2)[lo:hi], pa.array(np.diff(off).astype(np.int64)), lists], names=["doc_id", "has_letter", "n_bytes", "bits"])


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", depth: int = DEPTH, sample_bytes: int = SAMPLE_BYTES) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, lang_pred, score, bits_per_byte.

    ``score`` is the probability of the language if all are equally likely before, with code lengths as log-likelihoods.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    out = held_out(F.col("doc_id")).alias("held_out")
    langs, tables = fit(rows.where(~held_out(F.col("doc_id"))).select("lang", "text"), depth, sample_bytes)
    if not langs:
        return rows.select("doc_id", out, F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(None).cast("double").alias("bits_per_byte"))
    shared = docs.sparkSession.sparkContext.broadcast(tables)
    letter = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("has_letter")
    found = rows.select("doc_id", "text", letter).mapInArrow(partial(_score, shared=shared), "doc_id long, has_letter boolean, n_bytes long, bits array<double>")
    best = F.array_min("bits")
    name = F.array(*[F.lit(x) for x in langs])[(F.array_position("bits", best) - 1).cast("int")]
    odds = F.aggregate("bits", F.lit(0.0), lambda s, x: s + F.pow(F.lit(2.0), best - x))
    return found.select("doc_id", out, F.when(F.col("has_letter"), name).otherwise("und").alias("lang_pred"), F.when(F.col("has_letter"), 1 / odds).otherwise(0.0).alias("score"), F.when(F.col("has_letter"), best / (F.col("n_bytes") + 1)).alias("bits_per_byte"))
