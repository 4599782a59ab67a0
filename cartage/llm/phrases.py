"""Operator 11: collocations of two to four words by dictionary codes, binary keys, radix sort and run lengths.

1. Tasks count (language, word) pairs; Spark adds them up.  Words of at least ``min_count`` occurrences in their language get
   dense codes: no other word can stand in a candidate.  A code names the language too.
2. Texts are written in codes; a piece is broken at every other word.  Each position gives one key: the codes of the four
   words from there on, zeros after the break, each of a fixed width.  A task sorts its keys by radix and sends run lengths.
3. Keys are partitioned by range and sorted by radix again.  Runs of equal first two, three and four codes are the counts of
   all phrases; a run at the edge of a partition is added to its other part by Spark.
4. Cuts, containment and the first phrases of each language are joins and aggregates of the phrases that are left.

At most ``max_keys`` codes, the most used ones, are sent to all tasks; a word outside them gets its code by a shuffle join,
and results do not depend on ``max_keys``.  Words are told apart by 64-bit hashes, those of over 512 bytes by a digest.

Defined cases: null or empty text has no words; a null language is ``und`` and one with a language of that name; null ids and
repeated rows count each; a text of any length is one task's; a language without candidates has no row; other columns are
ignored, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import kernel as K
from .context_tree import Lookup, most_used
from .scratch import materialize, small_batches

MIN_COUNT, WORDS, TOP, MAX_KEYS = 30, 4, 2000, 1_000_000
#: Keys held by a task before it sends; rows of one window in the last choice.
HELD, CHOICE = 3_000_000, 50_000
_U = np.uint64
#: Bytes that end a piece: . , ; : ! ? and line feed to carriage return.  Blank and tab part words.
BREAK = np.zeros(256, bool)
BREAK[[0x2E, 0x2C, 0x3B, 0x3A, 0x21, 0x3F, 0x0A, 0x0B, 0x0C, 0x0D]] = True
INSIDE = ~BREAK
INSIDE[[0x20, 0x09]] = False
CODES = ["w1", "w2", "w3", "w4"]


def split_words(low: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, document, whether the next word stands in the same piece) of every word."""
    s, e = K.runs(INSIDE[low], off)
    doc = np.searchsorted(off, s, "right") - 1
    breaks = np.concatenate([[0], np.cumsum(BREAK[low])])
    joined = np.zeros(len(s), bool)
    joined[:-1] = (doc[1:] == doc[:-1]) & (breaks[s[1:]] == breaks[e[:-1]])
    return s, e, doc, joined


def word_keys(low: np.ndarray, s: np.ndarray, e: np.ndarray, lang: np.ndarray) -> np.ndarray:
    """A key of each (language, word)."""
    h = K.span_hash(K.prefix_sums(low), s, e)
    for i in np.flatnonzero(e - s > 512):
        h[i] = int.from_bytes(hashlib.blake2b(low[s[i] : e[i]].tobytes(), digest_size=8).digest(), "big")
    return K.mix(h ^ lang)


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (lang, hash of lang, text) to (h, lang, word, n); a task names each word once (n is 0) and adds up before it sends."""
    known = np.zeros(0, np.uint64)
    held: list[tuple[np.ndarray, np.ndarray]] = []
    size = 0

    def added() -> tuple[np.ndarray, np.ndarray]:
        h, n = (np.concatenate(x) for x in zip(*held, strict=True))
        h, back = np.unique(h, return_inverse=True)
        return h, np.bincount(back, n).astype(np.int64)

    def send() -> Iterator[pa.RecordBatch]:
        h, n = added()
        for i in range(0, len(h), 100_000):
            part = h[i : i + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(part.view(np.int64)), pa.nulls(len(part), pa.string()), pa.nulls(len(part), pa.binary()), pa.array(n[i : i + 100_000])], names=["h", "lang", "word", "n"])

    for b in batches:
        hashed = b.column(1).to_numpy().view(np.uint64)
        for lo, _hi, buf, off in K.slices(b.column(2)):
            low = K.LOWER[buf]
            s, e, doc, _ = split_words(low, off)
            h, first, n = np.unique(word_keys(low, s, e, hashed[lo + doc]), return_index=True, return_counts=True)
            held.append((h, n))
            size += len(h)
            new = first[~np.isin(h, known, assume_unique=True)]
            if len(new):
                h = h[~np.isin(h, known, assume_unique=True)]
                word = [low[i:j].tobytes() for i, j in zip(s[new].tolist(), e[new].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), b.column(0).take(pa.array(lo + doc[new])), pa.array(word, pa.binary()), pa.array(np.zeros(len(h), np.int64))], names=["h", "lang", "word", "n"])
                known = np.union1d(known, h) if len(known) < 1_000_000 else h
            if size > 2_000_000:
                held[:] = [added()]
                size = len(held[0][0])
                if size > 1_000_000:
                    yield from send()
                    held.clear()
                    size = 0
    if held:
        yield from send()


def count_words(rows: DataFrame) -> DataFrame:
    """(h, lang, word, n) of every (language, word); ``rows``: lang, lang_hash, text."""
    counted = rows.mapInArrow(_count_words, "h long, lang string, word binary, n long")
    return counted.groupBy("h").agg(F.max("lang").alias("lang"), F.max("word").cast("string").alias("word"), F.sum("n").alias("n"))


def dense_codes(words: DataFrame) -> DataFrame:
    """``words`` with a code from 1 without gaps; partitions are numbered on, so nothing is sorted as a whole."""
    at = materialize(words.withColumn("part", F.spark_partition_id()).withColumn("local", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offset = at.groupBy("part").count().select("part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("offset"))  # a row a partition
    return at.join(F.broadcast(offset), "part").select((F.col("offset") + F.col("local") + 1).alias("code"), "h", "lang", "word", "n")


def radix_order(digits: np.ndarray) -> np.ndarray:
    """The order of the rows of 16-bit digits, most significant first: one counting pass for each digit that differs."""
    order = np.arange(len(digits))
    for column in range(digits.shape[1] - 1, -1, -1):
        d = digits[:, column]
        if len(d) and d.min() != d.max():
            order = order[np.argsort(d[order], kind="stable")]  # of 16-bit numbers a radix sort
    return order


def heads(digits: np.ndarray) -> np.ndarray:
    """Where runs of equal rows begin."""
    new = np.ones(len(digits), bool)
    new[1:] = (digits[1:] != digits[:-1]).any(axis=1)
    return np.flatnonzero(new)


def run_lengths(digits: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each key once, in order, with the sum of its counts."""
    order = radix_order(digits)
    digits, n = digits[order], n[order]
    at = heads(digits)
    return digits[at], (np.add.reduceat(n, at) if len(at) else n)


def windows(code: np.ndarray, joined: np.ndarray, width: int) -> np.ndarray:
    """Keys as 16-bit digits (``width`` a code) of all positions whose next word has a code in the same piece."""
    link = joined & (code > 0)
    link[:-1] &= code[1:] > 0
    link[-1:] = False
    at = np.flatnonzero(link)
    digits = np.zeros((len(at), WORDS, width), np.uint16)
    going = np.ones(len(at), bool)
    for k in range(WORDS):
        here = np.where(going, code[np.minimum(at + k, len(code) - 1)], 0)
        for d in range(width):
            digits[:, k, d] = (here >> _U(16 * (width - 1 - d))) & _U(0xFFFF)
        going &= link[np.minimum(at + k, len(link) - 1)]
    return digits.reshape(len(at), WORDS * width)


def _as_binary(digits: np.ndarray) -> pa.Array:
    size = digits.shape[1] * 2
    ends = np.arange(len(digits) + 1, dtype=np.int32) * size
    return pa.Array.from_buffers(pa.binary(), len(digits), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(digits.astype(">u2")))])


def _as_digits(keys: pa.Array, width: int) -> np.ndarray:
    keys = keys.cast(pa.binary(WORDS * width * 2))
    raw = np.frombuffer(keys.buffers()[1], np.uint8)[keys.offset * WORDS * width * 2 :][: len(keys) * WORDS * width * 2]
    return raw.view(">u2").astype(np.uint16).reshape(len(keys), WORDS * width)


def _keys(batches: Iterator[pa.RecordBatch], codes: Broadcast, width: int, most: int) -> Iterator[pa.RecordBatch]:
    """Rows (lang_hash, text, more: places and codes that the broadcast lacks) to (key, n); a task sends when it holds ``most`` keys."""
    code_of = Lookup(*codes.value)
    held: list[tuple[np.ndarray, np.ndarray]] = []
    size = 0

    def send() -> Iterator[pa.RecordBatch]:
        digits, n = run_lengths(*map(np.concatenate, zip(*held, strict=True)))
        held.clear()
        for i in range(0, len(n), 200_000):
            yield pa.RecordBatch.from_arrays([_as_binary(digits[i : i + 200_000]), pa.array(n[i : i + 200_000])], names=["key", "n"])

    for b in batches:
        hashed = b.column(0).to_numpy().view(np.uint64)
        for lo, hi, buf, off in K.slices(b.column(1)):
            low = K.LOWER[buf]
            s, e, doc, joined = split_words(low, off)
            code = code_of(word_keys(low, s, e, hashed[lo + doc]))[0].astype(np.uint64)
            first = np.searchsorted(doc, np.arange(hi - lo))
            if b.column(2).null_count < len(b.column(2)):
                for i, more in enumerate(b.column(2)[lo:hi].to_pylist()):
                    for m in more or ():
                        code[first[i] + m["place"]] = m["code"]
            keys = windows(code, joined, width)
            held.append((keys, np.ones(len(keys), np.int64)))
            size += len(keys)
            if size > most:
                yield from send()
                size = 0
    if held:
        yield from send()


def _unknown(batches: Iterator[pa.RecordBatch], codes: Broadcast) -> Iterator[pa.RecordBatch]:
    """Rows (lang_hash, text, row) to (row, place, h) of the words that the broadcast lacks."""
    code_of = Lookup(*codes.value)
    for b in batches:
        hashed = b.column(0).to_numpy().view(np.uint64)
        for lo, hi, buf, off in K.slices(b.column(1)):
            low = K.LOWER[buf]
            s, e, doc, _ = split_words(low, off)
            h = word_keys(low, s, e, hashed[lo + doc])
            miss = np.flatnonzero(~code_of(h)[1])
            place = np.arange(len(s)) - np.searchsorted(doc, np.arange(hi - lo))[doc]
            yield pa.RecordBatch.from_arrays([b.column(2).take(pa.array(lo + doc[miss])), pa.array(place[miss]), pa.array(h[miss].view(np.int64))], names=["row", "place", "h"])


def _phrases(batches: Iterator[pa.RecordBatch], width: int, least: int) -> Iterator[pa.RecordBatch]:
    """One range of (key, n) to counts of phrases; runs at its edges are sent whatever their count."""
    parts = [(_as_digits(b.column(0), width), b.column(1).to_numpy()) for b in batches if len(b)]
    if not parts:
        return
    digits, n = run_lengths(*map(np.concatenate, zip(*parts, strict=True)))
    parts.clear()
    for size in range(2, WORDS + 1):
        at = heads(digits[:, : size * width])
        count = np.add.reduceat(n, at)
        keep = count >= least
        keep[0] = keep[-1] = True
        keep &= digits[at, (size - 1) * width : size * width].any(axis=1)
        found, count = digits[at[keep]].astype(np.int64), count[keep]
        code = []
        for k in range(WORDS):
            c = np.zeros(len(found), np.int64)
            for d in range(width if k < size else 0):
                c = (c << 16) | found[:, k * width + d]
            code.append(c)
        for i in range(0, len(count), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(x[i : i + 100_000]) for x in (*code, count)], names=[*CODES, "n"])


def count_phrases(rows: DataFrame, codes: DataFrame, min_count: int, max_keys: int) -> DataFrame:
    """(w1, w2, w3, w4, n) of every phrase of two words or more with at least ``min_count`` occurrences.

    ``rows``: lang_hash, text; ``codes``: code, h, n.
    """
    spark = rows.sparkSession
    total = codes.count()
    width = 1 if total < 1 << 16 else 2 if total < 1 << 32 else 3
    often = most_used(codes.withColumn("uses", F.col("n")), max_keys)
    sized = codes.withColumn("uses", F.col("n"))
    t = sized.where(often).select("h", "code").toArrow()  # at most max_keys rows
    h = t.column(0).to_numpy().view(np.uint64)
    order = np.argsort(h)
    table = spark.sparkContext.broadcast((h[order], t.column(1).to_numpy()[order].astype(np.float64)))
    rest = sized.where(~often).select("h", "code")
    if total <= t.num_rows:
        rows = rows.withColumn("more", F.lit(None).cast("array<struct<place: long, code: long>>"))
    else:
        rows = rows.withColumn("row", F.struct(F.xxhash64("lang_hash", "text").alias("a"), F.xxhash64("text", "lang_hash").alias("b")))
        lacking = rows.select("lang_hash", "text", "row").mapInArrow(partial(_unknown, codes=table), "row struct<a: long, b: long>, place long, h long")
        more = lacking.distinct().join(rest, "h").groupBy("row").agg(F.collect_list(F.struct("place", "code")).alias("more"))
        rows = rows.join(more, "row", "left")
    keys = materialize(rows.select("lang_hash", "text", "more").mapInArrow(partial(_keys, codes=table, width=width, most=HELD), "key binary, n long"))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-keys.count() // 1_000_000))
    found = keys.repartitionByRange(parts, "key").mapInArrow(partial(_phrases, width=width, least=min_count), "w1 long, w2 long, w3 long, w4 long, n long")
    return found.groupBy(*CODES).agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)


def _part(first: int, last: int) -> Column:
    """Words ``first`` to ``last`` of a phrase as a key of its own."""
    return F.struct(*[(F.col(CODES[first + k]) if first + k <= last else F.lit(0).cast("long")).alias(c) for k, c in enumerate(CODES)])


def _length() -> Column:
    return F.when(F.col("w4") > 0, 4).when(F.col("w3") > 0, 3).otherwise(2)


def lowest_cuts(phrases: DataFrame, codes: DataFrame) -> DataFrame:
    """(w1 .. w4, a, l, r, score): of all cuts of a phrase into two parts the one of lowest score."""
    parts = phrases.select(F.struct(*CODES).alias("part"), "n").unionByName(codes.select(F.struct(F.col("code").alias("w1"), *[F.lit(0).cast("long").alias(c) for c in CODES[1:]]).alias("part"), "n"))
    cuts = F.array(*[F.struct(F.lit(length).alias("size"), F.lit(k).alias("k"), _part(0, k - 1).alias("first"), _part(k, length - 1).alias("rest")) for length in range(2, WORDS + 1) for k in range(1, length)])
    cut = phrases.select(*CODES, F.col("n").alias("a"), F.explode(F.filter(cuts, lambda c: c["size"] == _length())).alias("c")).select(*CODES, "a", "c.k", "c.first", "c.rest")
    cut = cut.join(parts.select(F.col("part").alias("first"), F.col("n").alias("l")), "first").join(parts.select(F.col("part").alias("rest"), F.col("n").alias("r")), "rest")
    score = F.expr("(CAST(a AS DECIMAL(20, 0)) * 2000000) div (CAST(l AS DECIMAL(20, 0)) + r)")
    best = cut.groupBy(*CODES, "a").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("best"))
    return best.select(*CODES, "a", "best.l", "best.r", "best.score")


def not_contained(best: DataFrame, phrases: DataFrame) -> DataFrame:
    """``best`` without phrases that stand in a longer one of at least four fifths of their occurrences."""
    spans = F.array(*[F.struct(F.lit(size).alias("size"), _part(i, j).alias("part")) for size in range(3, WORDS + 1) for i in range(size) for j in range(i + 1, size) if j - i + 1 < size])
    inner = phrases.where("w3 > 0").select(F.explode(F.filter(spans, lambda s: s["size"] == _length())).alias("s"), "n")
    around = inner.groupBy(F.col("s.part").alias("part")).agg(F.max("n").alias("around")).select("part.*", "around")
    open_ = F.col("around").isNull() | (F.col("around").cast("decimal(20,0)") * 100 < F.col("a").cast("decimal(20,0)") * 80)
    return best.join(around, CODES, "left").where(open_).drop("around")


def first_rows(df: DataFrame, group: str, order: list[Column], k: int, ties: bool) -> DataFrame:
    """The first ``k`` rows of each group (with ``ties`` all that tie with the last); large groups are dealt into parts that choose on their own first."""
    key = F.xxhash64(*CODES)
    while True:
        df = materialize(df)
        largest = df.groupBy(group).count().agg(F.max("count")).first()[0] or 0
        parts = largest // max(CHOICE, 2 * k)
        if not parts:
            return df
        place = F.rank() if ties else F.row_number()
        chosen = materialize(df.withColumn("__part", F.pmod(key, F.lit(parts + 1))).withColumn("__place", place.over(Window.partitionBy(group, "__part").orderBy(*order))).where(F.col("__place") <= k).drop("__part", "__place"))
        if (chosen.groupBy(group).count().agg(F.max("count")).first()[0] or 0) > 0.8 * largest:
            return chosen  # nearly all rows tie
        df = chosen


def collocations(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", min_count: int = MIN_COUNT, top: int = TOP, max_keys: int = MAX_KEYS) -> DataFrame:
    """The first ``top`` phrases of each language: lang, rank, phrase, a, l, r, n, score."""
    small_batches(docs.sparkSession)
    lang = F.coalesce(F.col(lang_col).cast("string"), F.lit("und"))
    rows = docs.select(lang.alias("lang"), F.xxhash64(lang).alias("lang_hash"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    words = materialize(count_words(rows))
    totals = words.groupBy("lang").agg(F.sum("n").alias("total"))
    codes = materialize(dense_codes(words.where(F.col("n") >= min_count)))
    phrases = materialize(count_phrases(rows.select("lang_hash", "text"), codes, min_count, max_keys))
    best = not_contained(lowest_cuts(phrases, codes), phrases)
    best = best.join(codes.select(F.col("code").alias("w1"), "lang", F.col("word").alias("s1")), "w1")
    order = [F.desc("score"), F.desc("a")]
    best = first_rows(best, "lang", order, top, ties=True)
    for k in range(2, WORDS + 1):
        best = best.join(codes.select(F.col("code").alias(f"w{k}"), F.col("word").alias(f"s{k}")), f"w{k}", "left")
    best = best.withColumn("phrase", F.concat_ws(" ", *[f"s{k}" for k in range(1, WORDS + 1)]))
    order.append(F.asc("phrase"))
    best = first_rows(best.select("lang", "phrase", "a", "l", "r", "score", *CODES), "lang", order, top, ties=False)
    best = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return best.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", F.col("total").alias("n"), "score")
