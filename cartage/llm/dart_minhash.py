"""Operator 9: near-duplicates by DartMinHash.

Elements are 5-word shingles, each of weight 1, as what is accepted is the similarity of plain sets: the search then finds a
pair by the very measure that accepts it, however often a text repeats itself.  Every unit of weight throws hashed darts: in cell c of the rank
axis a Poisson number of them, at hashed ranks and weights; a dart counts if its weight lies below the element's.  Ranks
are thrown up to a bound that gives about k ln k + 2k darts a document, so the work follows the number of darts, not
elements times coordinates.  A dart falls on one of ``k`` coordinates and each coordinate keeps its earliest dart; where one
stays empty the bound is doubled.  Two documents agree on a coordinate with the probability of their similarity.

Bands of coordinates are joined.  Inside a bucket every document is compared exactly (set similarity of shingles) with one
leader, its most central member, never all pairs.  Members that reach the threshold are settled.  What a member lacks or has
beyond the leader is its difference; the symmetric difference of two members is that of their differences, so a link of an
open member to any other needs shared elements of the differences, which are few: both are met by their rarest elements
(prefix filter with positions), then compared exactly.  Open members of a bucket meet again under a leader of their own;
at the last level all open pairs are met by their differences.  No pair that a bucket holds is left out.  Links become
classes by label propagation with pointer jumping on shared tables.

Vertices are distinct shingle sets, so copies cost one row in one aggregation.

Defined cases: null text is empty; texts without words are one class (equal sets); a text of fewer than five words has one
shingle of all its words; rows that repeat an id are members like any other; a class's id is its smallest id that is
not null; the row with that id stays, of several the one with the smallest text digest, so a class keeps one text; rows that
repeat an id and text share the verdict; other columns are ignored; a text of any length is
one task's, its set one value of four bytes a shingle; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import kernel as K
from .scratch import attach_groups, broadcast_if, join_spread, materialize, small_batches, unused

WIDTH, THRESHOLD, BANDS, ROWS = 5, 0.8, 20, 4
#: Leaders a bucket has in turn; the last one's open members are met with each other.
LEVELS = 3
_U = np.uint64


#: Cells of the rank axis below 1; above, every unit is a cell.  A dart's place depends on its cell alone, not on the document.
LOW_CELLS = ((0.0, 1 / 32), (1 / 32, 1 / 16), (1 / 16, 1 / 8), (1 / 8, 1 / 4), (1 / 4, 1 / 2), (1 / 2, 1.0))


@lru_cache(maxsize=16)
def _poisson_steps(mean: float) -> np.ndarray:
    term, total, steps = np.exp(-mean), 0.0, []
    for k in range(1, 16):
        total += term
        steps.append(total)
        term *= mean / k
    return np.array(steps)


def dart_signatures(element: np.ndarray, doc: np.ndarray, weight: np.ndarray, n_docs: int, k: int) -> np.ndarray:
    """(n_docs, k) signatures of weighted sets; rows of documents without elements are 0.

    ``doc`` is sorted; ``weight`` is at least 1.
    """
    sig = np.zeros((n_docs, k), np.uint64)
    best = np.full((n_docs, k), np.inf)
    total = np.bincount(doc, weights=weight, minlength=n_docs)
    # Unit slabs of weight: slab s of an element spans weights s to s + 1.
    slabs = np.ceil(weight).astype(np.int64)
    unit = np.repeat(np.arange(len(element)), slabs)
    slab = np.arange(len(unit)) - np.repeat(np.cumsum(slabs) - slabs, slabs)
    key, owner, room = K.hash_ints(element[unit], 1) + slab.astype(np.uint64) * _U(0x9E3779B97F4A7C15), doc[unit], weight[unit] - slab
    darts = k * np.log(k) + 2 * k
    bound = np.where(total > 0, darts / np.maximum(total, 1e-9), 0.0)
    done = np.zeros(n_docs)
    open_docs = total > 0
    flat_best, flat_sig = best.ravel(), sig.ravel()

    def throw(u: np.ndarray, number: np.ndarray | int, lo: np.ndarray | float, size: float) -> None:
        """The darts of one cell for each of the units ``u``; earlier ranks win their coordinate."""
        c_key = K.mix(key[u] + (np.atleast_1d(np.asarray(number)).astype(np.uint64) + _U(1)) * _U(0xD6E8FEB86659FD93))
        count = np.searchsorted(_poisson_steps(size), K.uniform(c_key), "right")
        at = np.repeat(np.arange(len(u)), count)
        if not len(at):
            return
        nth = np.arange(len(at)) - np.repeat(np.cumsum(count) - count, count)
        dart = K.hash_ints(c_key[at] + nth.astype(np.uint64) * _U(0xC2B2AE3D27D4EB4F), 7)
        rank = (lo if np.isscalar(lo) else lo[at]) + size * K.uniform(K.hash_ints(dart, 11))
        d = owner[u][at]
        ok = (K.uniform(K.hash_ints(dart, 13)) < room[u][at]) & (rank < bound[d]) & (rank >= done[d])
        d, dart, rank = d[ok], dart[ok], rank[ok]
        flat = d * k + (K.hash_ints(dart, 17) % _U(k)).astype(np.int64)
        order = np.argsort(rank)[::-1]  # later ranks are written first, so that the earliest stays
        flat, dart, rank = flat[order], dart[order], rank[order]
        better = rank < flat_best[flat]
        flat, dart, rank = flat[better], dart[better], rank[better]
        flat_best[flat] = rank
        flat_sig[flat] = dart

    while open_docs.any():
        live = np.flatnonzero(open_docs[owner])
        u_bound, u_done = bound[owner[live]], done[owner[live]]
        for number, (lo, hi) in enumerate(LOW_CELLS):
            want = live[(u_bound > lo) & (u_done < hi)]
            if len(want):
                throw(want, number, lo, hi - lo)
        from_cell = np.maximum(np.floor(u_done), 1)
        cells = np.maximum(np.ceil(u_bound) - from_cell, 0).astype(np.int64)
        if cells.any():
            u = np.repeat(np.arange(len(live)), cells)
            lo_cell = from_cell[u] + np.arange(len(u)) - np.repeat(np.cumsum(cells) - cells, cells)
            throw(live[u], len(LOW_CELLS) + lo_cell.astype(np.int64), lo_cell, 1.0)
        done[open_docs] = bound[open_docs]
        bound[open_docs] *= 2
        open_docs = open_docs & np.isinf(best).any(axis=1)
    return sig


def weighted_shingles(buf: np.ndarray, off: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(shingle, document, count), distinct and sorted by document and shingle."""
    word, doc = K.words(K.LOWER[buf], off)
    sh, doc = K.shingles(word, doc, width)
    if not len(sh):
        return sh, doc, np.zeros(0)
    order = np.lexsort((sh, doc))
    sh, doc = sh[order], doc[order]
    head = np.ones(len(sh), bool)
    head[1:] = (sh[1:] != sh[:-1]) | (doc[1:] != doc[:-1])
    at = np.flatnonzero(head)
    return sh[at], doc[at], np.diff(np.append(at, len(sh))).astype(float)


def _set_hash(sh: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    """One key for each document's shingle set."""
    acc = np.zeros(n + 1, np.uint64)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(K.hash_ints(sh, 3), dtype=np.uint64)])
    edge = np.searchsorted(doc, np.arange(n + 1))
    acc = sums[edge[1:]] - sums[edge[:-1]]
    return K.mix(acc + np.diff(edge).astype(np.uint64))


def _sign(batches: Iterator[pa.RecordBatch], bands: int, rows: int, width: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for lo, hi, buf, off in K.slices(b.column(1)):
            n = hi - lo
            sh, doc, _ = weighted_shingles(buf, off, width)
            key = _set_hash(sh, doc, n)
            sig = dart_signatures(sh, doc, np.ones(len(sh)), n, bands * rows)
            band = np.zeros((n, bands), np.uint64)
            for r in range(rows):
                band = K.mix(band * _U(0x9E3779B97F4A7C15) + sig[:, r::rows][:, :bands])
            band += np.arange(bands, dtype=np.uint64) * _U(0xA0761D6478BD642F)
            size = np.bincount(doc, minlength=n).astype(np.int64)
            flat = pa.ListArray.from_arrays(pa.array(np.arange(0, n * bands + 1, bands, dtype=np.int32)), pa.array(band.ravel().view(np.int64)))
            yield pa.RecordBatch.from_arrays([b.column(0)[lo:hi], b.column(2)[lo:hi], pa.array(key.view(np.int64)), pa.array(size), flat], names=["doc_id", "digest", "v", "size", "bands"])


def _sets(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """Shingle sets as sorted 4-byte hashes in one binary value."""
    for b in batches:
        for lo, hi, buf, off in K.slices(b.column(0)):
            n = hi - lo
            sh, doc, _ = weighted_shingles(buf, off, width)
            key = _set_hash(sh, doc, n)
            small = (sh >> _U(32)).astype("<u4")  # sorted, as the shingles are
            edge = (np.searchsorted(doc, np.arange(n + 1)) * 4).astype(np.int32)
            blob = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(edge.tobytes()), pa.py_buffer(small.tobytes())])
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), blob], names=["v", "blob"])


def signatures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bands: int = BANDS, rows: int = ROWS, width: int = WIDTH) -> DataFrame:
    """(doc_id, digest of the text, v: key of the shingle set, size, bands) of every row."""
    small_batches(docs.sparkSession)
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), _digest(text_col).alias("digest"))
    return src.mapInArrow(partial(_sign, bands=bands, rows=rows, width=width), "doc_id long, digest binary, v long, size long, bands array<long>")


def _digest(text_col: str) -> Column:
    return F.unhex(F.sha2(F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary"), 256))


def _similarity(batches: Iterator[pa.RecordBatch], differences: bool) -> Iterator[pa.RecordBatch]:
    """Set similarity of two blobs, the sets' sizes and, if asked for, the elements of one of them only."""
    for b in batches:
        sims, sizes, diffs = [], [[], []], []
        for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
            p, q = np.unique(np.frombuffer(x, "<u4")), np.unique(np.frombuffer(y, "<u4"))
            apart = np.setxor1d(p, q, assume_unique=True)
            both = len(p) + len(q)
            common = (both - len(apart)) // 2
            sims.append(common / (both - common) if both else 1.0)
            sizes[0].append(len(p))
            sizes[1].append(len(q))
            diffs.append(apart.view("<i4") if differences else None)
        arrays = [b.column(0), b.column(1), pa.array(sims, pa.float64()), *(pa.array(n, pa.int32()) for n in sizes), pa.array(diffs, pa.list_(pa.int32()))]
        yield pa.RecordBatch.from_arrays(arrays, names=["x", "y", "sim", "nx", "ny", "diff"])


def _compare(pairs: DataFrame, sets: DataFrame, differences: bool = False) -> DataFrame:
    """(x, y, sim, nx, ny, diff) of every pair (x, y)."""
    # The leader of a crowded bucket has very many partners, a partner at most one leader a band.
    full = join_spread(pairs, sets.select(F.col("v").alias("x"), F.col("blob").alias("p")), "x", ["y"]).join(sets.select(F.col("v").alias("y"), F.col("blob").alias("q")), "y")
    return full.select("x", "y", "p", "q").mapInArrow(partial(_similarity, differences=differences), "x long, y long, sim double, nx int, ny int, diff array<int>")


def _meet_by_differences(compared: DataFrame, threshold: float, among_open: bool) -> DataFrame:
    """Pairs (x, y) under one leader that may link: an open member with a settled one and, if asked, with an open one.

    With k = (1 - t) / (1 + t) a link needs a symmetric difference of at most k (|x| + |y|), so the differences to the leader
    share at least (dx + dy - k (|x| + |y|)) / 2 elements, which is positive if one of the two is open.
    """
    k = (1 - threshold) / (1 + threshold)
    uneven = compared.groupBy("x").agg(F.max(F.col("sim") < threshold).alias("any_open"), F.count(F.lit(1)).alias("n")).where("any_open AND n > 1").select("x", "n")
    size, lead, d = F.col("ny"), F.col("nx"), F.size("diff")
    settled = F.col("sim") >= threshold
    # The least overlap any partner asks for: partners are at most |v| / t long and differ from the leader by d - (1 - t) / t |v| at least.
    least = F.greatest(d - (1 - threshold) / threshold * size, F.when(settled, (d + k * (lead - size)) / 2).otherwise((d - k * (size + lead)) / 2))
    prefix = d - F.greatest(F.lit(1), F.ceil(least - 1e-6)) + 1
    cell = attach_groups(compared, uneven, ["x"], "n").where(F.col("n").isNotNull() & (d > 0)).select(F.col("x").alias("m"), F.col("y").alias("v"), size.alias("s"), d.alias("d"), (~settled).alias("open"), prefix.cast("int").alias("prefix"), F.explode("diff").alias("e"))
    cell = materialize(cell)
    often = cell.groupBy("m", "e").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    # Elements nobody else has come first and meet nobody; they only move the others back.
    shared = cell.join(often, ["m", "e"]).groupBy("m", "v", "s", "d", "open", "prefix").agg(F.array_sort(F.collect_list(F.struct("n", "e"))).alias("es"))
    alone = F.col("d") - F.size("es")
    post = shared.where(alone < F.col("prefix")).select("m", "v", "s", "d", "open", alone.alias("alone"), F.posexplode(F.slice("es", F.lit(1), F.col("prefix") - alone)).alias("i", "h"))
    post = materialize(post.select("m", F.col("h.e").alias("e"), "v", "s", "open", "d", (F.col("d") - F.col("alone") - F.col("i")).alias("left")))
    x, y = post.where("open").alias("x"), (post if among_open else post.where("NOT open")).alias("y")
    enough = F.least("x.left", "y.left") >= (F.col("x.d") + F.col("y.d") - k * (F.col("x.s") + F.col("y.s"))) / 2 - 1e-6
    alike = F.least("x.s", "y.s") >= threshold * F.greatest("x.s", "y.s") - 1e-6
    once = ~F.col("y.open") | (F.col("x.v") < F.col("y.v"))
    met = x.join(y, (F.col("x.m") == F.col("y.m")) & (F.col("x.e") == F.col("y.e")) & (F.col("x.v") != F.col("y.v")) & once & enough & alike)
    return met.select(F.least("x.v", "y.v").alias("x"), F.greatest("x.v", "y.v").alias("y")).distinct()


def classes_of(links: DataFrame) -> DataFrame:
    """(v, c): the smallest vertex that links lead to, for every vertex of ``links`` (x, y).

    Each step takes the smallest label among the neighbours, then the label's label; the tables are cut each time.
    """
    both = materialize(links.select(F.col("x").alias("v"), F.col("y").alias("w")).union(links.select("y", "x")).distinct())
    degree = materialize(both.groupBy("w").agg(F.count(F.lit(1)).alias("n")))  # a hub's neighbours are dealt to several tasks
    labels = materialize(degree.select(F.col("w").alias("v"), F.col("w").alias("c")))
    while True:
        near = join_spread(both, labels.select(F.col("v").alias("w"), "c"), "w", ["v"], counts=degree).groupBy("v").agg(F.min("c").alias("m"))
        step = materialize(labels.join(near, "v").select("v", F.col("c").alias("was"), F.least("c", "m").alias("c")))
        jump = labels.select(F.col("v").alias("c"), F.col("c").alias("d"))
        labels_new = materialize(join_spread(step, jump, "c", ["v"], how="left").select("v", "was", F.least("c", F.coalesce("d", "c")).alias("c")))
        changed = not labels_new.where("was <> c").isEmpty()
        labels = labels_new.select("v", "c")
        if not changed:
            return labels


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, bands: int = BANDS, rows: int = ROWS, width: int = WIDTH) -> DataFrame:
    """One row per row of ``docs``: doc_id, class_id (smallest id of its class), class_size, kept, n_shingles."""
    return _verdicts(docs, id_col, text_col, threshold, bands, rows, width).drop("digest")


def _verdicts(docs: DataFrame, id_col: str, text_col: str, threshold: float = THRESHOLD, bands: int = BANDS, rows: int = ROWS, width: int = WIDTH) -> DataFrame:
    """The rows of ``near_duplicates`` with the digest of their text."""
    sig = materialize(signatures(docs, id_col, text_col, bands, rows, width))
    vertices = sig.where("size > 0").groupBy("v").agg(F.min("bands").alias("bands"))
    at = materialize(vertices.select("v", F.explode("bands").alias("b")))
    shared = materialize(at.groupBy("b").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
    inside = materialize(join_spread(at, shared, "b", ["v"], counts=shared))
    central = materialize(inside.groupBy("v").agg(F.sum("n").alias("w")))
    inside = materialize(inside.select("b", "v").join(central, "v"))
    wanted, _ = broadcast_if(central.select("v"), 1_000_000)
    texts = docs.select(F.col(text_col).cast("string").alias("text"))
    sets = materialize(texts.mapInArrow(partial(_sets, width=width), "v long, blob binary").join(wanted, "v", "left_semi").groupBy("v").agg(F.min("blob").alias("blob")))
    links = None
    for level in range(LEVELS):
        if inside.isEmpty():
            break
        lead = materialize(inside.groupBy("b").agg(F.max(F.struct("w", "v")).alias("m"), F.count(F.lit(1)).alias("n")).where("n > 1").select("b", F.col("m.v").alias("m"), "n"))
        met = materialize(join_spread(inside, lead.select("b", "m"), "b", ["v"], counts=lead.select("b", "n")).where("v <> m"))
        compared = materialize(_compare(met.select(F.col("m").alias("x"), F.col("v").alias("y")).distinct(), sets, True))
        maybe = materialize(_meet_by_differences(compared, threshold, level == LEVELS - 1))
        tried = materialize(compared.select("x", "y", "sim").unionByName(_compare(maybe, sets).select("x", "y", "sim")))
        new = tried.where(F.col("sim") >= threshold).select("x", "y")
        links = new if links is None else links.unionByName(new)
        still = compared.where(F.col("sim") < threshold).select(F.col("x").alias("m"), F.col("y").alias("v"))
        inside = materialize(met.join(still, ["m", "v"]).select("b", "v", "w"))
    labels = classes_of(links) if links is not None else None
    rowsets = sig.select("doc_id", "digest", "v", "size")
    if labels is not None:
        # Copies of one text share a key; they are dealt to several tasks.
        rowsets = materialize(join_spread(rowsets, labels, "v", ["doc_id", "digest"], how="left").select("doc_id", "digest", F.coalesce("c", "v").alias("c"), "size"))
    else:
        rowsets = rowsets.withColumnRenamed("v", "c")
    lead = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "digest"))
    groups = rowsets.groupBy("c").agg(lead.alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    out = attach_groups(rowsets, groups, ["c"], "n")
    alone = F.col("n").isNull()
    first = F.when(alone, F.col("doc_id")).otherwise(F.col("first.doc_id"))
    kept = alone | (F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("digest") == F.col("first.digest")))
    return out.select("doc_id", first.alias("class_id"), F.coalesce("n", F.lit(1)).cast("long").alias("class_size"), kept.alias("kept"), F.col("size").alias("n_shingles"), "digest")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each class, known by id and text; columns are unchanged."""
    verdicts = materialize(_verdicts(docs, id_col, text_col))
    key, digest, gone_key, gone_digest = unused(docs, "__id", "__digest", "__gone", "__lost")
    gone = materialize(verdicts.where(~F.col("kept")).select(F.col("doc_id").alias(gone_key), F.col("digest").alias(gone_digest)).distinct())
    keyed = docs.withColumns({key: F.col(id_col).cast("long"), digest: _digest(text_col)})
    gone, _ = broadcast_if(gone, 1_000_000)  # ids and digests of 32 bytes
    stay = keyed.join(gone, F.col(key).eqNullSafe(F.col(gone_key)) & (F.col(digest) == F.col(gone_digest)), "left_anti")
    again = verdicts.where("kept").groupBy("doc_id", "digest").count().where("count > 1")
    return (stay if again.isEmpty() else stay.dropDuplicates([key, digest])).drop(key, digest)
