"""Operator 10: toxicity by a weighted lexicon.

Texts are folded first: ASCII and lookalike letters to one lower-case form, digits that stand for letters inside words,
zero-width characters dropped.  Terms are whole words and word beginnings of 4 to 6 letters, so that inflected and
suffixed forms count.  Their weights are smoothed log odds over the labelled training rows; a term counts once for all
rows that share a MinHash of their shingles, so that copies do not make their rare words look toxic.  Phrases of two words that hold a
lexicon word but stand mostly in clean rows become exceptions.  One Aho-Corasick pass finds terms and exceptions; a
word counts by its heaviest term, each word once, and the sum is divided by a slow function of the text's length.

The training sample is bounded by ``sample`` rows a class, the smallest by hash of the id.  ``max_terms`` is out of the reach of such a sample.

Defined cases: null text is empty; an empty text has no matches and the lowest score; null labels and labels without a
document are ignored; without labels of both classes every score is the same, below 0.5; null ids of labels
are ignored, null ids of documents are scored and not held out; rows are scored one by one, whatever their length, so
repeated rows get equal scores; other columns of either table are ignored, whatever their names; an empty table gives an
empty result.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from functools import partial

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import kernel as K
from .scratch import broadcast_if, materialize, small_batches, unused

SAMPLE, MAX_TERMS, PREFIXES = 20_000, 500_000, (4, 5, 6)
MIN_ROWS, MIN_WEIGHT, LENGTH_SCALE = 5, 3.0, 200.0
#: Letters of other scripts that look like Latin ones.
LOOKALIKES = dict(zip("аеорсхуіјѕһԁɡӏⅼкмтнвαορνικτυβεηχ", "aeopcxyijshdgllkmthbaopviktubenx", strict=True))
#: Digits and signs that stand for letters inside words.
DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b"}
SIGNS = {"@": "a", "$": "s", "!": "i"}
#: Fixed phrases in which a lexicon word is harmless.
EXCEPTIONS = ("trash can", "trash bin", "class clown", "clown fish", "pond scum", "sore loser", "circus clown")
FOLD = {ord(k): v for k, v in LOOKALIKES.items()} | {ord(k.upper()): v for k, v in LOOKALIKES.items() if len(k.upper()) == 1}
FOLD |= {0xFF01 + i: chr(0x21 + i).lower() for i in range(94)} | dict.fromkeys((0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF, 0xAD), "") | {c: chr(c + 32) for c in range(65, 91)}
WORD = re.compile(r"[^\W_]+")
INNER_DIGIT = re.compile(r"(?<=[^\W\d_])[0134578]+(?=[^\W\d_])|\b[0134578](?=[^\W\d_]{2})")
INNER_SIGN = re.compile(r"(?<=[^\W_])[@$!](?=[^\W_])")


def fold(text: str | None) -> list[str]:
    """The words of a text in folded form."""
    low = (text or "").translate(FOLD)
    if not low.isascii():
        low = low.lower()
    if "@" in low or "$" in low or "!" in low:
        low = INNER_SIGN.sub(lambda m: SIGNS[m[0]], low)
    low = INNER_DIGIT.sub(lambda m: "".join(DIGITS[c] for c in m[0]), low)
    return WORD.findall(low)


def terms_of(words: list[str]) -> set[str]:
    """Whole words as "word " and beginnings as "begi"."""
    out = set()
    for w in set(words):
        out.add(w + " ")
        out.update(w[:n] for n in PREFIXES if len(w) > n)
    return out


def _count(batches: Iterator[pa.RecordBatch], keep: set[str] | None) -> Iterator[pa.RecordBatch]:
    """The terms of every row (toxic, text) with its sketch, or with ``keep`` two-word phrases that hold one of those words.

    Equal texts of a class have equal terms and are read once.
    """
    seen: set[tuple[int, bytes]] = set()
    terms: list[str] = []
    whose: list[tuple[int, int, int]] = []  # class, sketch and number of terms of each row
    for b in batches:
        for lo, hi, buf, off in K.slices(b.column(1)):
            sh, doc = K.shingles(*K.words(K.LOWER[buf], off))
            least = np.full(hi - lo, np.iinfo(np.uint64).max, np.uint64)
            np.minimum.at(least, doc, K.hash_ints(sh, 23))
            for toxic, text, h in zip(b.column(0)[lo:hi].to_pylist(), b.column(1)[lo:hi].to_pylist(), least.tolist(), strict=True):
                same = (toxic, hashlib.blake2b((text or "").encode(), digest_size=16).digest())
                if same in seen:
                    continue
                seen.add(same)
                words = fold(text)
                found = terms_of(words) if keep is None else {f"{a} {z} " for a, z in zip(words, words[1:], strict=False) if a in keep or z in keep}
                terms += ["", *found]
                whose.append((toxic, h >> 1, len(found) + 1))
                if len(terms) >= 50_000:
                    yield _terms(terms, whose)
                    terms, whose = [], []
    if terms:
        yield _terms(terms, whose)


def _terms(terms: list[str], whose: list[tuple[int, int, int]]) -> pa.RecordBatch:
    toxic, sketch, n = (np.array(x) for x in zip(*whose, strict=True))
    return pa.RecordBatch.from_arrays([pa.array(terms), pa.array(np.repeat(toxic, n).astype(np.int32)), pa.array(np.repeat(sketch, n).astype(np.int64))], names=["term", "toxic", "sketch"])


def training_rows(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(toxic, text) of at most ``sample`` labelled rows a class whose crc32(doc_id) mod 5 is not 0."""
    fit = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & (F.crc32(F.col("doc_id").cast("string")) % 5 != 0)).select("doc_id", F.col("toxic").cast("int").alias("toxic"))
    ids = [fit.where(F.col("toxic") == t).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample) for t in (0, 1)]
    chosen = F.broadcast(materialize(ids[0].union(ids[1]).distinct()))  # at most 2 * sample rows
    return materialize(docs.select("doc_id", F.col("text").cast("string").alias("text")).join(chosen, "doc_id").select("toxic", "text"))


def _weights(rows: DataFrame, keep: set[str] | None = None) -> tuple[DataFrame, int, int]:
    """Rows per class for each term, and in all."""
    found = rows.mapInArrow(partial(_count, keep=keep), "term string, toxic int, sketch long").distinct()
    counts = materialize(found.groupBy("term").agg(F.count_if(F.col("toxic") == 1).alias("t"), F.count_if(F.col("toxic") == 0).alias("n")))
    total = counts.where("term = ''").first()
    return counts.where("term <> ''"), (total["t"] if total else 0), (total["n"] if total else 0)


def learn_lexicon(rows: DataFrame, max_terms: int = MAX_TERMS) -> dict:
    """{"terms": weights, "exceptions": phrases, "middle": raw score where the classes part}."""
    counts, t, n = _weights(rows)
    if not t or not n:
        return {"terms": {}, "exceptions": [], "middle": 1.0}
    weight = F.ln((F.col("t") + 0.5) / F.lit(t + 1.0)) - F.ln((F.col("n") + 0.5) / F.lit(n + 1.0))
    best = counts.where(F.col("t") >= MIN_ROWS).withColumn("w", weight).where(F.col("w") >= MIN_WEIGHT).orderBy(F.desc("t"), "term").limit(max_terms)
    terms = {r["term"]: float(r["w"]) for r in best.collect()}
    whole = {x[:-1] for x in terms if x.endswith(" ")}
    exceptions = list(EXCEPTIONS)
    if whole:
        phrases, _, _ = _weights(rows, whole)
        clean = phrases.where("n >= 3 AND n > 10 * t").orderBy(F.desc("n"), "term").limit(max_terms)
        exceptions += [r["term"].strip() for r in clean.collect()]
    model = {"terms": terms, "exceptions": exceptions, "middle": 1.0}
    raw = rows.select(F.lit(0).cast("long").alias("doc_id"), "text", "toxic").mapInArrow(partial(_score, model=model, keep=True), "doc_id long, raw double, matches long, toxic int")
    table = raw.groupBy("toxic", F.least(F.round(F.col("raw") * 20), F.lit(2000)).cast("int").alias("x")).count().collect()  # at most 2 * 2001 rows
    model["middle"] = _middle({(r["toxic"], r["x"]): r["count"] for r in table}) / 20
    return model


def _middle(table: dict[tuple[int, int], int]) -> float:
    """The cut with the fewest errors, each class weighing as much as the other; in the middle of its gap."""
    total = [max(1, sum(c for (k, _), c in table.items() if k == t)) for t in (0, 1)]
    places = sorted({x for _, x in table})
    best, cut = math.inf, 1.0
    for a, b in zip(places, [*places[1:], places[-1] + 2], strict=True):
        wrong = sum(c / total[k] for (k, x), c in table.items() if (x > a) != (k == 1))
        if wrong < best - 1e-12:
            best, cut = wrong, (a + b) / 2
    return max(cut, 0.5)


def automaton(model: dict) -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for term, w in model["terms"].items():
        a.add_word(f" {term}", (len(term) + 1, w))
    for phrase in model["exceptions"]:
        a.add_word(f" {phrase} ", (len(phrase) + 2, None))
    a.add_word("\0", (1, 0.0))
    a.make_automaton()
    return a


def raw_score(words: list[str], a: ahocorasick.Automaton) -> tuple[float, int]:
    """(weights of the matched words over the length's norm, matched words)."""
    flat = f" {' '.join(words)} "
    best: dict[int, float] = {}
    spared: list[tuple[int, int]] = []
    for end, (size, w) in a.iter(flat):
        start = end - size + 1
        if w is None:
            spared.append((start, end))
        elif w > best.get(start, 0.0):
            best[start] = w
    distinct: dict[str, float] = {}
    for start, w in best.items():
        if not any(s <= start < e for s, e in spared):
            word = flat[start + 1 : flat.index(" ", start + 1)]
            distinct[word] = w
    return sum(distinct.values()) / (1 + math.log1p(len(words) / LENGTH_SCALE)), len(distinct)


def _score(batches: Iterator[pa.RecordBatch], model: dict, keep: bool = False) -> Iterator[pa.RecordBatch]:
    a = automaton(model)
    for b in batches:
        found = [raw_score(fold(t), a) for t in b.column(1).to_pylist()]
        cols = [b.column(0), pa.array([x[0] for x in found], pa.float64()), pa.array([x[1] for x in found], pa.int64())]
        yield pa.RecordBatch.from_arrays([*cols, *([b.column(2)] if keep else [])], names=[b.schema.names[0], "raw", "matches", *(["toxic"] if keep else [])])


def score_toxicity(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, max_terms: int = MAX_TERMS) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, score, predicted, matches."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    scored, score = _scores(docs, labels, rows, "doc_id long", sample, max_terms)
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), score.alias("score"), (score >= 0.5).cast("int").alias("predicted"), "matches")


def _scores(docs: DataFrame, labels: DataFrame, rows: DataFrame, key: str, sample: int = SAMPLE, max_terms: int = MAX_TERMS) -> tuple[DataFrame, Column]:
    """(``rows`` of a key and a text with raw score and matches, the column of the score), learnt from ``docs``."""
    small_batches(docs.sparkSession)
    model = learn_lexicon(training_rows(docs, labels, sample), max_terms)
    scored = rows.mapInArrow(partial(_score, model=model), f"{key}, raw double, matches long")
    return scored, F.lit(1.0) / (F.lit(1.0) + F.exp(-F.lit(2.0) * (F.col("raw") - F.lit(model["middle"]))))


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without the rows predicted toxic; columns are unchanged.  The verdict follows the text, so rows go by its digest, not by id."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    digest = F.unhex(F.sha2(text.cast("binary"), 256))
    (key,) = unused(docs, "__bad")
    scored, score = _scores(docs, labels, docs.select(digest.alias(key), text.alias("text")), f"`{key}` binary")
    bad, _ = broadcast_if(materialize(scored.where(score >= 0.5).select(key).distinct()), 1_000_000)  # digests of 32 bytes
    return docs.join(bad, digest == F.col(key), "left_anti")
