"""Operator 3: removal of long repeated byte strings.

A repeat of ``length`` bytes is found where it can be found once: every window of that many bytes is assigned to the
smallest hash of the ``gram``-byte strings inside it (its minimiser), so equal windows always meet under one key.
Neighbouring windows under one key travel together as a stretch; equal stretches are a class.

1. Each task cuts its texts into stretches and sends the first two of a class among its own rows on.
2. Stretches are dealt by minimiser and streamed in sorted order.  The first two of each class are passed on to the
   tree, unless a stretch is the only one of its minimiser and no two windows of it can be equal.
3. An enhanced suffix array per block of minimisers decides: suffixes of at least ``length`` bytes are sorted, their
   longest common prefixes form an interval tree, a stack scan walks it, and every interval whose left extensions differ
   is a maximal repeat with all its occurrences.  All but the first occurrence are removed.  A third or later stretch of
   a class goes as the second does, so a class of any size puts two texts into the tree.
4. A minimiser with more than ``hot`` stretches would make one task's block unbounded.  Its stretches are cut anew with
   longer grams and take the same way; with grams of ``length`` bytes a minimiser has a bounded number of classes.

Defined cases: null text is empty; texts shorter than ``length`` keep every byte; a text of any length is cut in one
task, in memory of some 100 times its size; null ids come before all others; rows that repeat an id and text are one
document, so neither loses bytes to the other; different texts of one id are different documents, ordered by a hash of
the text; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernel as K
from .scratch import materialize, small_batches

LENGTH, GRAM, MAX_WINDOWS, BLOCK, MEMORY = 100, 28, 256, 300_000, 500_000
NO_ID = -(2**63)
STRETCH = "mh long, sk long, doc long, sub long, start int, windows int, inner boolean, done boolean"
NAMES = ["mh", "sk", "doc", "sub", "start", "windows", "inner", "done"]
TYPES = (np.int64, np.int64, np.int64, np.int64, np.int32, np.int32, bool)
Columns = tuple[np.ndarray, ...]  # the first seven of NAMES


def stretches(buf: np.ndarray, off: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """(minimiser, content hash, document index, start in the document, windows, inner) of every stretch of windows with one minimiser.

    ``inner`` is set if two windows of the stretch may be equal: its minimiser then stands in it twice.
    """
    n = len(buf) - length + 1
    if n <= 0:
        return tuple(np.zeros(0, t) for t in (np.uint64, np.uint64, np.int64, np.int64, np.int64, bool))
    sums = K.prefix_sums(buf)
    at = np.arange(len(buf) - gram + 1)
    least = own = K.span_hash(sums, at, at + gram)
    span, wide = length - gram + 1, 1
    while wide * 2 <= span:
        least = np.minimum(least[:-wide], least[wide:])
        wide *= 2
    least = np.minimum(least[: len(least) - (span - wide)], least[span - wide :])[:n]
    valid = np.zeros(n, bool)
    edge = np.zeros(n + 1, np.int32)
    lo, hi = np.minimum(off[:-1], n), np.clip(off[1:] - length + 1, 0, n)
    real = hi > lo
    np.add.at(edge, lo[real], 1)
    np.add.at(edge, hi[real], -1)
    valid = np.cumsum(edge[:-1]) > 0
    new = np.ones(n, bool)
    new[1:] = (least[1:] != least[:-1]) | ~valid[:-1]
    new[off[:-1][off[:-1] < n]] = True
    head = np.flatnonzero(valid & new)
    if not len(head):
        return tuple(np.zeros(0, t) for t in (np.uint64, np.uint64, np.int64, np.int64, np.int64, bool))
    doc = np.searchsorted(off, head, "right") - 1
    end = np.minimum(np.append(head[1:], n), off[doc + 1] - length + 1)
    place = _least_places(own, least, span)
    twin = np.flatnonzero(own[place[1:]] == own[place[:-1]])
    # Between two places of a stretch's minimiser no window of it has another one, so they are neighbours here.
    begin, finish = place[twin], np.append(place[twin + 1], len(buf) + length)
    inner = finish[np.searchsorted(begin, head)] < end + span - 1
    if (parts := (end - head + MAX_WINDOWS - 1) // MAX_WINDOWS).max() > 1:  # a periodic text
        nth = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        end, doc, inner = np.repeat(end, parts), np.repeat(doc, parts), np.repeat(inner, parts)
        head = np.repeat(head, parts) + nth * MAX_WINDOWS
        end = np.minimum(end, head + MAX_WINDOWS)
    return least[head], K.span_hash(sums, head, end + length - 1), doc, head - off[doc], end - head, inner


def _least_places(own: np.ndarray, least: np.ndarray, span: int) -> np.ndarray:
    """Places whose hash is the least of a window of ``span`` places, ``least`` having that of each window."""
    most, wide = np.concatenate([np.zeros(span - 1, np.uint64), least, np.zeros(span - 1, np.uint64)]), 1
    while wide * 2 <= span:
        most = np.maximum(most[:-wide], most[wide:])
        wide *= 2
    most = np.maximum(most[: len(most) - (span - wide)], most[span - wide :])
    return np.flatnonzero(own == most[: len(own)])


def merged(doc: np.ndarray, sub: np.ndarray, start: np.ndarray, end: np.ndarray) -> Columns:
    """(doc, sub, start, end) of the unions of spans that touch or overlap, by document."""
    order = np.lexsort((start, sub, doc))
    doc, sub, start, end = doc[order], sub[order], start[order].astype(np.int64), end[order].astype(np.int64)
    if not len(doc):
        return doc, sub, start, end
    fresh = np.ones(len(doc), bool)
    fresh[1:] = (doc[1:] != doc[:-1]) | (sub[1:] != sub[:-1])
    shift = (np.cumsum(fresh) - 1) * (int(end.max()) + 1)
    reach = np.maximum.accumulate(end + shift)
    fresh[1:] |= (start + shift)[1:] > reach[:-1]
    first = np.flatnonzero(fresh)
    return doc[first], sub[first], start[first], np.maximum.reduceat(end, first)


def _rows(columns: Columns, done: bool) -> Iterator[pa.RecordBatch]:
    for i in range(0, len(columns[0]), 50_000):
        part = [np.ascontiguousarray(c[i : i + 50_000]).astype(t, copy=False) for c, t in zip(columns, TYPES, strict=True)]
        yield pa.RecordBatch.from_arrays([*(pa.array(c) for c in part), pa.array(np.full(len(part[0]), done))], names=NAMES)


def _nth(new_class: np.ndarray, same: np.ndarray, before: int) -> np.ndarray:
    """Number of each row among the different ones of its class, from 0; ``before`` are those of the first row's class in earlier batches."""
    different = np.cumsum(~same)
    nth = different - different[np.maximum.accumulate(np.where(new_class, np.arange(len(same)), 0))]
    first = np.cumsum(new_class) == 0
    nth[first] = different[first] + before - 1
    return nth


def _after(known: list[np.ndarray], of: np.ndarray, doc: np.ndarray, sub: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Whether a stretch stands after the place that ``known`` has for its class."""
    if not len(known[0]):
        return np.zeros(len(of), bool)
    at = np.minimum(np.searchsorted(known[0], of), len(known[0]) - 1)
    d, u, s = (k[at] for k in known[1:])
    return (known[0][at] == of) & ((doc > d) | (doc == d) & ((sub > u) | (sub == u) & (start > s)))


def _cut(batches: Iterator[pa.RecordBatch], length: int, gram: int) -> Iterator[pa.RecordBatch]:
    """Rows (doc, sub, base, text): text is what a document has from base on.  Out: the first two stretches of each class, and the others (done).

    Classes that a block had twice are remembered, up to MEMORY of them with the place of the second: what stands after
    that place in a later block of the task is a third or later one too.
    """
    held: list[Columns] = []
    size = 0
    known = [np.zeros(0, np.uint64), *(np.zeros(0, np.int64) for _ in range(3))]  # class, doc, sub and start of the second, sorted by class

    def settle() -> Iterator[pa.RecordBatch]:
        mh, sk, doc, sub, start, win, inner = (np.concatenate(x) for x in zip(*held, strict=True))
        held.clear()
        order = np.lexsort((start, sub, doc, sk, mh))
        columns = mh, sk, doc, sub, start, win, inner = tuple(c[order] for c in (mh, sk, doc, sub, start, win, inner))
        new, same = np.ones(len(mh), bool), np.zeros(len(mh), bool)
        new[1:] = (mh[1:] != mh[:-1]) | (sk[1:] != sk[:-1])
        same[1:] = ~new[1:] & (doc[1:] == doc[:-1]) & (sub[1:] == sub[:-1]) & (start[1:] == start[:-1])
        nth = _nth(new, same, 0)
        of = K.mix(mh.view(np.uint64) ^ K.mix(sk.view(np.uint64)))
        late = (nth >= 2) | _after(known, of, doc, sub, start)
        yield from _rows(tuple(c[~late & ~same] for c in columns), False)
        late &= ~same
        second = np.flatnonzero((nth == 1) & ~same)[: MEMORY - len(known[0])]
        if len(second):
            at = np.argsort(joined := np.concatenate([known[0], of[second]]), kind="stable")
            known[:] = [joined[at], *(np.concatenate([k, c[second]])[at] for k, c in zip(known[1:], (doc, sub, start.astype(np.int64)), strict=True))]
        d, u, s, e = merged(doc[late], sub[late], start[late], start[late] + win[late] + length - 1)
        spread = K.hash_ints(d.view(np.uint64) ^ s.astype(np.uint64), 5).view(np.int64)
        yield from _rows((spread, spread, d, u, s, e - s - length + 1, np.zeros(len(d), bool)), True)

    for b in batches:
        ids, subs, bases = (np.asarray(b.column(i)) for i in range(3))
        for lo, hi, buf, off in K.slices(b.column(3)):
            mh, sk, doc, start, win, inner = stretches(buf, off, length, gram)
            held.append((mh.view(np.int64), sk.view(np.int64), ids[lo:hi][doc], subs[lo:hi][doc], start + bases[lo:hi][doc], win, inner))
            size += len(mh)
            if size >= BLOCK:
                yield from settle()
                size = 0
    if size:
        yield from settle()


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by (mh, sk, doc, sub, start).  Out: the first two stretches of each class for the tree, the others (done).

    A stretch that is alone under its minimiser is left out, unless it is ``inner``.
    """
    last: tuple | None = None  # mh, sk, doc, sub, start of the row before
    seen = 0  # different rows of its class
    lone: Columns | None = None  # that row, if it is the only one of its minimiser so far and not sent
    for b in batches:
        if not b.num_rows:
            continue
        columns = mh, sk, doc, sub, start, _, inner = tuple(np.asarray(b.column(i).to_numpy(zero_copy_only=False)) for i in range(7))
        passed = np.asarray(b.column(7).to_numpy(zero_copy_only=False), bool)
        new_mh, new_sk, same = np.ones(len(mh), bool), np.ones(len(mh), bool), np.zeros(len(mh), bool)
        new_mh[1:] = mh[1:] != mh[:-1]
        new_sk[1:] = new_mh[1:] | (sk[1:] != sk[:-1])
        same[1:] = ~new_sk[1:] & (doc[1:] == doc[:-1]) & (sub[1:] == sub[:-1]) & (start[1:] == start[:-1])
        if last is not None and last[0] == mh[0]:
            new_mh[0], new_sk[0] = False, last[1] != sk[0]
            same[0] = not new_sk[0] and last[2:] == (doc[0], sub[0], start[0])
        nth = _nth(new_sk, same, seen)
        group = np.cumsum(new_mh)
        rows = np.bincount(group[~same], minlength=int(group[-1]) + 1)
        carried = not new_mh[0]
        sent = (nth < 2) & ~same & ~passed & ((rows[group] > 1) | inner.astype(bool) | (carried & (group == 0)))
        if carried and rows[0] and lone is not None:
            yield from _rows(lone, False)
        if rows[0] or new_mh.any():
            lone = None
        yield from _rows(tuple(c[(nth >= 2) & ~same | passed] for c in columns), True)
        yield from _rows(tuple(c[sent] for c in columns), False)
        tail = np.flatnonzero((group == group[-1]) & ~same)
        if new_mh.any() and len(tail) == 1 and not sent[tail[0]] and not passed[tail[0]]:
            lone = tuple(c[tail] for c in columns)
        last, seen = (mh[-1], sk[-1], doc[-1], sub[-1], start[-1]), int(nth[-1]) + 1


def suffix_array(buf: np.ndarray, off: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes whose first ``least`` bytes occur again, in order, and the longest common prefix of each with the one before.

    A suffix ends where its text ends.  Only prefixes of ``least`` bytes and more are of interest, so the order starts
    with a hash of that prefix and goes on with the bytes after it, eight at a time; suffixes with a common prefix still
    stand together.  Runs of one hash are sorted with others that go on for about as long.
    """
    counts = np.maximum(np.diff(off) - least + 1, 0)
    owner = np.repeat(np.arange(len(off) - 1), counts)
    starts = np.arange(len(owner)) + (off[:-1] - (np.cumsum(counts) - counts))[owner]
    if not len(starts):
        return starts, starts
    head = K.span_hash(K.prefix_sums(buf), starts, starts + least)
    order = np.argsort(head, kind="stable")
    first = np.flatnonzero(np.append(True, head[order][1:] != head[order][:-1]))
    room = off[owner[order] + 1] - starts[order] - least
    size = np.diff(np.append(first, len(order)))
    words = np.repeat(np.where(size > 1, (np.maximum.reduceat(room, first) + 7) // 8, -1), size)
    eight = np.ndarray(len(buf) + 1, ">u8", np.concatenate([buf, np.zeros(8, np.uint8)]), strides=(1,))  # the eight bytes from each place on
    found = []
    for low, high in zip((-1, 1, 3, 6, 9), (1, 3, 6, 9, int(words.max())), strict=True):
        part = order[(words > low) & (words <= high)]
        if len(part):
            found.append(_sorted_runs(eight, starts[part], head[part], off[owner[part] + 1] - starts[part] - least, least))
    return tuple(np.concatenate([f[i] for f in found]) if found else np.zeros(0, np.int64) for i in range(2))


def _sorted_runs(eight: np.ndarray, starts: np.ndarray, head: np.ndarray, room: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes in order and common prefixes; ``room`` has the bytes of each after its first ``least``."""
    keys = []
    for at in range(0, int(room.max(initial=0)), 8):
        word = eight[np.minimum(starts + least + at, len(eight) - 1)].astype(np.uint64)
        beyond = np.clip(8 * (at + 8 - room), 0, 64)  # bits after the end of the text
        shift = np.minimum(beyond, 63).astype(np.uint64)
        keys.append(np.where(beyond < 64, word >> shift << shift, np.uint64(0)))
    order = np.lexsort((room, *keys[::-1], head))
    sa, head, room = starts[order], head[order], room[order]
    lcp = np.zeros(len(sa), np.int64)
    open_pair = head[1:] == head[:-1]
    got = np.where(open_pair, least, 0)
    for key in keys:
        at = np.flatnonzero(open_pair)
        diff = key[order[at + 1]] ^ key[order[at]]
        got[at] += sum((diff >> np.uint64(bits)) == 0 for bits in range(56, -8, -8))  # leading bytes that agree
        open_pair[at[diff != 0]] = False
    lcp[1:] = np.where(head[1:] == head[:-1], np.minimum(got, np.minimum(room[1:], room[:-1]) + least), 0)
    return sa, lcp


def maximal_intervals(buf: np.ndarray, off: np.ndarray, sa: np.ndarray, lcp: np.ndarray, least: int) -> Iterator[tuple[int, int, int]]:
    """(depth, first, last + 1) of the common-prefix intervals whose left extensions differ, inner before outer: a stack scan."""
    if len(sa) < 2:
        return
    starts = np.zeros(len(buf) + 1, bool)
    starts[off] = True
    before = np.where(starts[sa], -1, buf[sa - 1].astype(np.int64))
    # Suffixes with one prefix of ``least`` bytes stand in a run; where all have the same byte on the left, no interval counts.
    heads = np.flatnonzero(lcp < least)
    ends = np.append(heads[1:], len(sa))
    low, high = np.minimum.reduceat(before, heads), np.maximum.reduceat(before, heads)
    open_runs = (ends - heads > 1) & ((low != high) | (low < 0))
    for lo, hi in zip(heads[open_runs].tolist(), ends[open_runs].tolist(), strict=True):
        depth_of, left_of = lcp[lo:hi].tolist(), before[lo:hi].tolist()
        stack: list[list[int]] = []  # depth, first index, left byte (-1: they differ)
        for k in range(1, hi - lo + 1):
            depth = depth_of[k] if k < hi - lo else 0
            first, char = k - 1, left_of[k - 1]
            while stack and stack[-1][0] > depth:
                d, first, c = stack.pop()
                char = c if c == char else -1
                if char == -1:
                    yield d, lo + first, lo + k
            if depth and stack and stack[-1][0] == depth:
                stack[-1][2] = char if stack[-1][2] == char else -1
            elif depth:
                stack.append([depth, first, char])


def maximal_repeats(buf: np.ndarray, off: np.ndarray, least: int) -> Iterator[tuple[int, np.ndarray]]:
    """(length, all start positions) of every repeat of ``least`` bytes or more that can't be extended on either side."""
    sa, lcp = suffix_array(buf, off, least)
    for depth, lo, hi in maximal_intervals(buf, off, sa, lcp, least):
        yield depth, sa[lo:hi]


def later_occurrences(buf: np.ndarray, off: np.ndarray, least: int, doc: np.ndarray, sub: np.ndarray, at: np.ndarray) -> Columns:
    """(doc, sub, start, end) of each occurrence of a maximal repeat but the first, for the longest repeat that it is not the first of.

    Text i is what document (doc[i], sub[i]) has from at[i] on.  Intervals come inner first, so an occurrence is settled
    once, by the deepest interval in which another one stands before it; only the first ones go on to the outer interval.
    """
    sa, lcp = suffix_array(buf, off, least)
    own = np.searchsorted(off, sa, "right") - 1
    d, u, s = doc[own], sub[own], at[own] + sa - off[own]
    order = np.lexsort((s, u, d))
    step = np.ones(len(sa), np.int64)
    step[1:] = (d[order][1:] != d[order][:-1]) | (u[order][1:] != u[order][:-1]) | (s[order][1:] != s[order][:-1])
    rank_at = np.empty(len(sa), np.int64)
    rank_at[order] = np.cumsum(step)
    rank = rank_at.tolist()
    skip, depth_of = list(range(len(sa) + 1)), np.zeros(len(sa), np.int64)

    def open_from(k: int) -> int:
        root = k
        while skip[root] != root:
            root = skip[root]
        while skip[k] != root:
            skip[k], k = root, skip[k]
        return root

    for depth, lo, hi in maximal_intervals(buf, off, sa, lcp, least):
        members, k = [], open_from(lo)
        while k < hi:
            members.append(k)
            k = open_from(k + 1)
        first = min((rank[k] for k in members), default=0)
        for k in members:
            if rank[k] > first:
                depth_of[k] = depth
                skip[k] = k + 1
    late = depth_of > 0
    return d[late], u[late], s[late], s[late] + depth_of[late]


def _compare(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Rows (mh, doc, sub, start, body), sorted by mh.  Out: removed spans (doc, sub, start, bytes)."""
    held: list[tuple[int, int, int, int, bytes]] = []
    size = 0

    def settle() -> pa.RecordBatch:
        _, docs, subs, at, texts = zip(*held, strict=True)
        held.clear()
        off = np.concatenate([[0], np.cumsum([len(x) for x in texts])]).astype(np.int64)
        buf = np.frombuffer(b"".join(texts), np.uint8)
        d, u, s, e = merged(*later_occurrences(buf, off, length, *(np.array(x, np.int64) for x in (docs, subs, at))))
        return pa.RecordBatch.from_arrays([pa.array(d), pa.array(u), pa.array(s.astype(np.int32)), pa.array((e - s).astype(np.int32))], names=["doc", "sub", "start", "bytes"])

    for b in batches:
        for row in zip(*(b.column(i).to_pylist() for i in range(5)), strict=True):
            if size > 1_000_000 and row[0] != held[-1][0]:
                yield settle()
                size = 0
            held.append(row)
            size += len(row[4])
    if held:
        yield settle()


def _documents(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, doc, sub, text): two rows are one document if both id and text agree."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(F.col(id_col).cast("long").alias("id"), text.alias("text")).select("id", F.coalesce("id", F.lit(NO_ID)).alias("doc"), F.xxhash64("text").alias("sub"), F.col("text").cast("binary").alias("text"))


def removed_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM, hot: int = 1_000) -> DataFrame:
    """(doc, sub, start, bytes) of spans that are covered by a repeated string of ``length`` bytes; they may overlap."""
    spark = docs.sparkSession
    small_batches(spark)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    full = _documents(docs, id_col, text_col).drop("id").withColumn("base", F.lit(0))
    rows, spans, gram = full.where(F.octet_length("text") >= length), None, min(gram, length)
    while True:
        cut = rows.select("doc", "sub", "base", "text").mapInArrow(partial(_cut, length=length, gram=gram), STRETCH)
        met = materialize(cut.repartition(parts, "mh").sortWithinPartitions("mh", "sk", "doc", "sub", "start").mapInArrow(_meet, STRETCH))
        firsts = met.where("NOT done").select("mh", F.col("doc").alias("of"), F.col("sub").alias("of_sub"), "start", "windows")
        inside = (F.col("doc") == F.col("of")) & (F.col("sub") == F.col("of_sub")) & (F.col("start") >= F.col("base")) & (F.col("start") + F.col("windows") + F.lit(length - 1) <= F.col("base") + F.octet_length("text"))
        body = F.substring(F.col("text"), F.col("start") - F.col("base") + 1, F.col("windows") + F.lit(length - 1))
        bodies = materialize(rows.join(firsts, inside).select("mh", "doc", "sub", "start", body.alias("body")))
        crowded = materialize(bodies.groupBy("mh").count().where(F.col("count") > hot).select("mh"))  # at most 1/hot of the rows
        last = gram == length or crowded.isEmpty()
        few = bodies if last else bodies.join(crowded, "mh", "left_anti")
        tree = few.repartition(parts, "mh").sortWithinPartitions("mh").mapInArrow(partial(_compare, length=length), "doc long, sub long, start int, bytes int")
        found = met.where("done").select("doc", "sub", "start", (F.col("windows") + F.lit(length - 1)).alias("bytes")).unionByName(tree)
        spans = found if spans is None else spans.unionByName(found)
        if last:
            return spans
        rows, gram = bodies.join(crowded, "mh", "left_semi").select("doc", "sub", F.col("start").alias("base"), F.col("body").alias("text")), (gram + length + 1) // 2 if length - gram > length // 2 else length


def _finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out: list[tuple] = []
        for doc, raw, starts, sizes in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
            if starts:
                s, none = np.array(starts, np.int64), np.zeros(len(starts), np.int64)
                _, _, s, e = merged(none, none, s, s + np.array(sizes, np.int64))
                edges = [0, *np.stack([s, e], 1).ravel().tolist(), len(raw)]
                kept = b"".join(raw[a:z] for a, z in zip(edges[::2], edges[1::2], strict=True))
                out.append((doc, len(raw), len(raw) - len(kept), len(s), kept))
            else:
                out.append((doc, len(raw), 0, 0, raw))
        cols = list(zip(*out, strict=True)) or [()] * 5
        yield pa.RecordBatch.from_arrays([*(pa.array(cols[i], pa.int64()) for i in range(4)), pa.array(cols[4], pa.binary())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, **options: int) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_bytes, n_removed, n_spans and the bytes that are kept."""
    spans = materialize(removed_spans(docs, id_col, text_col, length, **options))
    found = spans.groupBy("doc", "sub").agg(F.collect_list(F.struct("start", "bytes")).alias("spans"))
    both = _documents(docs, id_col, text_col).join(found, ["doc", "sub"], "left")
    return both.select("id", "text", F.col("spans.start").alias("starts"), F.col("spans.bytes").alias("sizes")).mapInArrow(_finish, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")
