"""Operator 7: language-model scores by context-tree weighting.

A byte is eight binary decisions; each decision has a tree of contexts of 0 to ``depth`` bytes before it.  Every node has
counts of zeros and ones and a Krichevsky-Trofimov estimate; the weighted probability of a node is half its own estimate
and half the product of its children's.  Trained in a batch, a node's own share is fixed, so a decision's probability is
mixed along one path from the root down.

1. Tasks count (depth + 1)-byte strings and tokens over all rows; Spark adds them up.  Counts of training rows make the
   model, counts of all rows say how often a string will be looked up.
2. Strings are split into decisions and folded up the tree, each level one aggregation; the shares are then carried down,
   each level one join with its parents.  The tree is a set of tables of any size; its depth is the same for every corpus.
3. Every distinct string gets its probability from the tree by joins.  The base score, an add-one unigram over
   blank-separated tokens (by 64-bit hash), gets a value for each token in the same way.
4. Documents look up the most used strings and tokens, at most ``max_keys`` of each, in a broadcast; the others reach their
   documents through a shuffle join.  None is cut, and the scores do not depend on ``max_keys``.

Defined cases: null text is empty; an empty text is one end; null ids train (crc32 of null is not 2); repeated rows count
and score each; a text of any length is one task's, in slices of their own; without training rows every decision has probability 1/2; other columns are ignored; an empty table gives
an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import kernel as K
from .scratch import materialize, small_batches

DEPTH, MAX_KEYS = 4, 1_000_000
_U = np.uint64
#: Keys of tokens have this bit and are negative as signed numbers; those of byte strings are not.
TOKEN_BIT = _U(1 << 63)
END_TOKEN = TOKEN_BIT | _U(0x5EED0E4D)


def held_out(id_col: Column) -> Column:
    return F.coalesce(F.crc32(id_col.cast("string")) % 7 == 2, F.lit(False))


def grams(buf: np.ndarray, off: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(key, edges): the bytes of each document and one end, each with ``depth`` bytes before it; zeros stand outside.

    A key has the current byte lowest; document i has keys edges[i] to edges[i + 1].
    """
    n = len(off) - 1
    size = np.diff(off)
    wide = np.zeros(len(buf) + (n + 1) * depth + n, np.uint64)
    shift = np.arange(n) * (depth + 1) + depth
    place = np.arange(len(buf)) + np.repeat(shift, size)
    wide[place] = buf
    ends = off[1:] + shift
    scored = np.zeros(len(wide), bool)
    scored[place] = scored[ends] = True
    key = np.zeros(len(wide), np.uint64)
    for back in range(depth, -1, -1):
        key[depth:] = (key[depth:] << _U(8)) | wide[depth - back : len(wide) - back]
    return key[scored], off + np.arange(n + 1)


def tokens(low: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, document) of every token and one end for each document."""
    s, e = K.runs(~K.SPACE_BYTE[low], off)
    h = K.span_hash(K.prefix_sums(low), s, e) | TOKEN_BIT
    n = len(off) - 1
    return np.concatenate([h, np.full(n, END_TOKEN)]), np.concatenate([np.searchsorted(off, s, "right") - 1, np.arange(n)])


def _added(keys: np.ndarray, n: np.ndarray, uses: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each key once, with its sums."""
    order = np.argsort(keys)
    keys, n, uses = keys[order], n[order], uses[order]
    if not len(keys):
        return keys, n, uses
    head = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[head], np.add.reduceat(n, head), np.add.reduceat(uses, head)


def _count(batches: Iterator[pa.RecordBatch], depth: int) -> Iterator[pa.RecordBatch]:
    """Rows (held out, text) to (key, n: uses in training rows, uses).  A task adds up before it sends; it sends when it holds much."""
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    size = 0

    def send() -> Iterator[pa.RecordBatch]:
        for i in range(0, size, 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(x[i : i + 100_000].view(np.int64)) for x in held[0]], names=["key", "n", "uses"])
        held.clear()

    for b in batches:
        out = np.asarray(b.column(0).to_numpy(zero_copy_only=False), bool)
        for lo, hi, buf, off in K.slices(b.column(1)):
            low = K.LOWER[buf]
            strings, edge = grams(low, off, depth)
            words, of = tokens(low, off)
            key = np.concatenate([strings, words])
            train = ~out[lo:hi][np.concatenate([np.repeat(np.arange(hi - lo), np.diff(edge)), of])]
            held.append(_added(key, train.astype(np.int64), np.ones(len(key), np.int64)))
            size += len(held[-1][0])
            if size > 4_000_000 and len(held) > 1:
                held[:] = [_added(*map(np.concatenate, zip(*held, strict=True)))]
                size = len(held[0][0])
                if size > 3_000_000:
                    yield from send()
                    size = 0
    if held:
        held[:] = [_added(*map(np.concatenate, zip(*held, strict=True)))]
        size = len(held[0][0])
        yield from send()


def log_gamma(x: Column) -> Column:
    """ln of the gamma function: Stirling's series seven places further on."""
    z = x + F.lit(7.0)
    product = x
    for k in range(1, 7):
        product = product * (x + F.lit(float(k)))
    return (z - 0.5) * F.ln(z) - z + F.lit(0.9189385332046727) + F.lit(1 / 12) / z - F.lit(1 / 360) / (z * z * z) + F.lit(1 / 1260) / F.pow(z, F.lit(5.0)) - F.ln(product)


def log_kt(n0: Column, n1: Column) -> Column:
    """ln of the Krichevsky-Trofimov probability of n0 zeros and n1 ones."""
    return log_gamma(n0 + F.lit(0.5)) + log_gamma(n1 + F.lit(0.5)) - log_gamma(n0 + n1 + F.lit(1.0)) - F.lit(1.1447298858494002)


def decisions() -> Column:
    """The eight decisions of a string's last byte: (d: the bits before it after a 1, bit)."""
    byte = F.col("key").bitwiseAND(255)
    return F.explode(F.array(*[F.struct(F.expr(f"(1 << {i}) | shiftright(key & 255, {8 - i})").cast("long").alias("d"), F.shiftright(byte, 7 - i).bitwiseAND(1).alias("bit")) for i in range(8)]))


def node_at(depth: int) -> Column:
    """The node of a string's decision whose context is the last ``depth`` bytes before it."""
    context = F.shiftright("key", 8).bitwiseAND((1 << (8 * depth)) - 1)
    return F.shiftleft(context, 8).bitwiseOR(F.col("x.d"))


def fold_tree(counts: DataFrame, depth: int) -> list[DataFrame]:
    """Levels ``depth`` to 0 of the tree: (node, n0, n1, share of the node's own estimate).

    ``counts`` has (key, n) of byte strings of depth + 1 bytes; a node's key is its context, then the decision.
    """
    rows = counts.select("key", decisions().alias("x"), "n")
    level = rows.groupBy(node_at(depth).alias("node")).agg(F.sum(F.when(F.col("x.bit") == 0, F.col("n")).otherwise(0)).cast("double").alias("n0"), F.sum(F.when(F.col("x.bit") == 1, F.col("n")).otherwise(0)).cast("double").alias("n1"))
    levels = [materialize(level.withColumn("lw", log_kt(F.col("n0"), F.col("n1"))).withColumn("share", F.lit(1.0)))]
    for d in range(depth - 1, -1, -1):
        keep = (1 << (8 * d)) - 1
        up = F.shiftleft(F.shiftright("node", 8).bitwiseAND(keep), 8).bitwiseOR(F.col("node").bitwiseAND(255))
        level = levels[-1].groupBy(up.alias("node")).agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"), F.sum("lw").alias("below"))
        own = log_kt(F.col("n0"), F.col("n1"))
        level = level.withColumn("own", own).withColumn("top", F.greatest("own", "below"))
        level = level.withColumn("lw", F.col("top") + F.ln((F.exp(F.col("own") - F.col("top")) + F.exp(F.col("below") - F.col("top"))) / 2))
        levels.append(materialize(level.withColumn("share", F.exp(F.col("own") - F.lit(0.6931471805599453) - F.col("lw"))).select("node", "n0", "n1", "lw", "share")))
    return levels


def carry_down(levels: list[DataFrame]) -> list[DataFrame]:
    """Levels 0 to depth: (node, a, b).  The probability of a one is a + b * what the node below on the path says.

    A node has at most 256 children, so no join key is hot.
    """
    out: list[DataFrame] = []
    for d, level in enumerate(reversed(levels)):
        own = level.select("node", ((F.col("n1") + 0.5) / (F.col("n0") + F.col("n1") + 1.0)).alias("p1"), "share")
        if out:
            up = F.shiftleft(F.shiftright("node", 8).bitwiseAND((1 << (8 * (d - 1))) - 1), 8).bitwiseOR(F.col("node").bitwiseAND(255))
            own = own.withColumn("up", up).join(out[-1].select(F.col("node").alias("up"), "a", "b"), "up")
        else:
            own = own.withColumn("a", F.lit(0.0)).withColumn("b", F.lit(1.0))
        out.append(materialize(own.select("node", (F.col("a") + F.col("b") * F.col("share") * F.col("p1")).alias("a"), (F.col("b") * (1 - F.col("share"))).alias("b"))))
    return out


def string_values(strings: DataFrame, tree: list[DataFrame]) -> DataFrame:
    """(key, uses, v): log10 of the probability of each string's last byte after the bytes above.  ``strings``: key, n, uses."""
    depth = len(tree) - 1
    log = F.log10(F.when(F.col("x.bit") == 1, F.col("p")).otherwise(1 - F.col("p")))
    each = strings.select("key", "uses", decisions().alias("x"), "n")
    # Strings of the training rows have all their nodes; the deepest one, whose share is 1, says it all.
    seen = each.where("n > 0").withColumn("node", node_at(depth)).join(tree[depth], "node").withColumn("p", F.col("a"))
    new = each.where("n = 0")
    p = F.lit(0.5)
    for d in range(depth + 1):  # the deepest known node decides
        side = tree[d].select(F.col("node").alias(f"node{d}"), (F.col("a") + F.col("b") * 0.5).alias(f"p{d}"))
        new = new.withColumn(f"node{d}", node_at(d)).join(F.broadcast(side) if d < 2 else side, f"node{d}", "left")  # depths 0 and 1 have at most 65 536 nodes
        p = F.coalesce(f"p{d}", p)
    both = seen.select("key", "uses", "x", "p").unionByName(new.select("key", "uses", "x", p.alias("p")))
    return both.groupBy("key").agg(F.first("uses").alias("uses"), F.sum(log).alias("v"))


def most_used(values: DataFrame, max_keys: int) -> Column:
    """Whether a row of (key, uses) is among the most used ones, at most ``max_keys``: a bound on uses, from a table of counts by size."""
    size = F.floor(F.log2("uses") * 4).cast("int")
    table = values.groupBy(size.alias("size")).count().orderBy(F.desc("size")).collect()  # at most 4 * 64 rows
    left, least = max_keys, 1 << 20
    for r in table:
        left -= r["count"]
        if left < 0:
            break
        least = r["size"]
    return size >= least


def train(rows: DataFrame, depth: int = DEPTH, max_keys: int = MAX_KEYS) -> tuple[dict, DataFrame]:
    """The model's bounded tables, and (key, v) of the strings and tokens that are not among them.  ``rows``: held, text."""
    raw = materialize(rows.mapInArrow(partial(_count, depth=depth), "key long, n long, uses long").groupBy("key").agg(F.sum("n").alias("n"), F.sum("uses").alias("uses")))
    strings, words = raw.where("key >= 0"), raw.where("key < 0")
    sums = words.where("n > 0").agg(F.sum("n"), F.count(F.lit(1))).first()
    tree = carry_down(fold_tree(strings.where("n > 0").select("key", "n"), depth))
    tables, rare = {"depth": depth, "total": sums[0] or 0, "distinct": sums[1]}, []
    for name, found in (("string", string_values(strings, tree)), ("token", words.select("key", "uses", F.log10(F.col("n") + 1.0).alias("v")))):
        found = materialize(found)
        often = most_used(found, max_keys)
        t = found.where(often).select("key", "v").toArrow()  # at most max_keys rows
        key, v = t.column(0).to_numpy().view(np.uint64), t.column(1).to_numpy()
        order = np.argsort(key)
        tables[name] = (key[order], v[order])
        rare.append(found.where(~often).select("key", "v"))
    return tables, rare[0].unionByName(rare[1])


class Lookup:
    """Values of keys: a direct-mapped table before a search of the sorted keys."""

    def __init__(self, key: np.ndarray, value: np.ndarray, bits: int = 21) -> None:
        self.known, self.value, self.bits = key, value, bits
        self.key = np.zeros(1 << bits, np.int64) - 1
        slot = self._slot(key)
        self.key[slot] = np.arange(len(key))

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key * _U(0x9E3779B97F4A7C15)) >> _U(64 - self.bits)).astype(np.int64)

    def __call__(self, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(values, 0 where unknown; whether they are known)."""
        if not len(self.known):
            return np.zeros(len(key)), np.zeros(len(key), bool)
        at = np.maximum(self.key[self._slot(key)], 0)
        hit = self.known[at] == key
        miss = np.flatnonzero(~hit)
        if len(miss):
            at[miss] = np.minimum(np.searchsorted(self.known, key[miss]), len(self.known) - 1)
            hit[miss] = self.known[at[miss]] == key[miss]
        return np.where(hit, self.value[at], 0.0), hit


def _score(batches: Iterator[pa.RecordBatch], model: Broadcast) -> Iterator[pa.RecordBatch]:
    """Rows (doc_id, text, row); ``rare`` has the keys that the broadcast lacks."""
    m = model.value
    string_of, token_of = Lookup(*m["string"]), Lookup(*m["token"])
    for b in batches:
        for lo, hi, buf, off in K.slices(b.column(1)):
            n, low = hi - lo, K.LOWER[buf]
            key, edge = grams(low, off, m["depth"])
            word, of = tokens(low, off)
            v, hit = string_of(key)
            log_c, met = token_of(word)
            rest = np.concatenate([key[~hit], word[~met]])
            whose = np.concatenate([np.repeat(np.arange(n), np.diff(edge))[~hit], of[~met]])
            order = np.argsort(whose, kind="stable")
            ends = np.concatenate([[0], np.cumsum(np.bincount(whose, minlength=n))]).astype(np.int32)
            rare = pa.ListArray.from_arrays(pa.array(ends), pa.array(rest[order].view(np.int64)))
            sums = (np.bincount(of, minlength=n), np.bincount(of[log_c > 0], minlength=n), np.bincount(of, log_c, n), np.add.reduceat(v, edge[:-1]), np.diff(off).astype(np.int64))
            yield pa.RecordBatch.from_arrays([b.column(0)[lo:hi], b.column(2)[lo:hi], *map(pa.array, sums), rare], names=["doc_id", "row", "n_tokens", "n_known", "log_c", "score", "n_bytes", "rare"])


def score_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", depth: int = DEPTH, max_keys: int = MAX_KEYS) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    model, rare = train(rows.select(held_out(F.col("doc_id")).alias("held"), "text"), depth, max_keys)
    total, distinct = int(model["total"]), int(model["distinct"])
    shared = docs.sparkSession.sparkContext.broadcast(model)
    del model
    found = rows.select("doc_id", "text", F.struct(F.xxhash64("doc_id", "text").alias("a"), F.xxhash64("text", "doc_id").alias("b")).alias("row")).mapInArrow(partial(_score, model=shared), "doc_id long, row struct<a: long, b: long>, n_tokens long, n_known long, log_c double, score double, n_bytes long, rare array<long>")
    if not rare.isEmpty():
        found = materialize(found)
        which = ["row", "n_bytes"]
        each = found.select(*which, F.explode("rare").alias("key")).groupBy(*which, "key").agg(F.count(F.lit(1)).alias("k"))
        token = F.col("key") < 0
        more = each.join(rare, "key").groupBy(*which).agg(F.sum(F.when(token & (F.col("v") > 0), F.col("k"))).alias("known"), F.sum(F.when(token, F.col("k") * F.col("v"))).alias("l"), F.sum(F.when(~token, F.col("k") * F.col("v"))).alias("s"))
        same = found.where(F.size("rare") > 0).groupBy(*which).agg(F.count(F.lit(1)).alias("same"))  # equal rows have gathered together
        more = more.join(same, which).select(*which, *[F.coalesce(F.col(c) / F.col("same"), F.lit(0.0)).alias(c) for c in ("known", "l", "s")])
        gain = lambda c: F.coalesce(c, F.lit(0.0))
        found = found.join(more, which, "left").select("doc_id", "n_tokens", (F.col("n_known") + gain("known")).cast("long").alias("n_known"), (F.col("log_c") + gain("l")).alias("log_c"), (F.col("score") + gain("s")).alias("score"), "n_bytes")
    base = F.col("log_c") - F.col("n_tokens") * F.log10(F.lit(float(total + distinct + 1)))
    bits = -F.col("score") * F.lit(3.321928094887362) / (F.col("n_bytes") + 1)
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), base.alias("base_score"), "score", bits.alias("bits_per_byte"))
