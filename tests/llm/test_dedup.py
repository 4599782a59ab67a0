import hashlib
import random
from collections import defaultdict

import numpy as np
import pytest

from cartage.llm import dart_minhash, exact_dedup, kernel, repeats
from cartage.llm.license_scan import ASCII_LOWER, WORD

from .fixtures import documents, rows, texts, words


def test_exact_dedup_is_the_brute_force(spark):
    groups = defaultdict(list)
    for i, t, *_ in rows():
        groups[t or ""].append(i)
    want = []
    for i, t, *_ in rows():
        g = groups[t or ""]
        keep = max((x for x in g if x is not None), default=None)
        want.append((i, keep, len(g), i == keep, hashlib.sha256((t or "").encode()).hexdigest()))
    for limit in (1, 7, 1_000_000):  # key sets too large to broadcast prune by slots and change nothing
        got = [(r.doc_id, r.keep_id, r.group_size, r.kept, bytes(r.digest).hex()) for r in exact_dedup.exact_dedup(documents(spark), max_keys=limit, digest_all=True).collect()]
        assert sorted(got, key=str) == sorted(want, key=str)


def test_drop_exact_keeps_one_row_of_each_text_and_all_columns(spark):
    docs = documents(spark)
    out = exact_dedup.drop_exact_duplicates(docs)
    assert out.columns == docs.columns
    kept = [r.text or "" for r in out.collect()]
    assert sorted(kept) == sorted({t or "" for _, t, *_ in rows()})
    assert exact_dedup.drop_exact_duplicates(documents(spark, [])).count() == 0


def removed_by_force(data, length):
    order = sorted(((i if i is not None else -(2**63)), (t or "").encode()) for i, t in set(data))
    seen, gone = {}, defaultdict(set)
    for i, raw in order:
        for at in range(len(raw) - length + 1):
            s = raw[at : at + length]
            if s in seen and seen[s] < (i, at):
                gone[i, raw].update(range(at, at + length))
            seen.setdefault(s, (i, at))
    out = []
    for i, t in data:
        raw = (t or "").encode()
        g = gone[(i if i is not None else -(2**63)), raw]
        spans = sum(1 for x in g if x - 1 not in g)
        out.append((i, len(raw), len(g), spans, bytes(b for k, b in enumerate(raw) if k not in g)))
    return out


@pytest.mark.parametrize(("seed", "hot"), [(1, 5000), (2, 5000), (3, 1)])
def test_repeats_are_the_brute_force(spark, seed, hot):
    rng = random.Random(seed)
    passages = [words(rng, 12) for _ in range(4)] + ["ab" * 60, "x" * 90, "é漢" * 12]
    data = []
    for i in range(40):
        parts = [rng.choice(passages)[rng.randrange(10) :] if rng.random() < 0.6 else words(rng, rng.randrange(1, 20), 50) for _ in range(rng.randrange(1, 6))]
        data.append((i, " ".join(parts)))
    data += [(90, None), (91, ""), (None, passages[0]), (7, data[7][1]), (92, data[3][1])]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = [tuple(r)[:4] + (bytes(r.kept),) for r in repeats.remove_repeats(documents(spark, texts(data)), length=30, gram=9, hot=hot).collect()]
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    assert sorted(got, key=str) == sorted(removed_by_force(data, 30), key=str)


def test_repeats_of_defined_cases(spark):
    data = [(i, t) for i, t, *_ in rows() if i != 303]
    got = [tuple(r)[:4] + (bytes(r.kept),) for r in repeats.remove_repeats(documents(spark, texts(data))).collect()]
    assert sorted(got, key=str) == sorted(removed_by_force(data, 100), key=str)
    assert repeats.remove_repeats(documents(spark, [])).count() == 0


@pytest.mark.parametrize(
    "data",
    [["a" * 200], [" auf" * 42], ["a" * 611], ["a" * 611, "a" * 611], ["x" * 30 + "".join(map(chr, range(40, 113))) * 4], [" ".join(f"n{i}" for i in range(90)) + "ab" * 75 + " ".join(f"m{i}" for i in range(90))]],
)
def test_repeats_inside_one_stretch_are_the_brute_force(spark, data):
    data = list(enumerate(data))
    got = [tuple(r)[:4] + (bytes(r.kept),) for r in repeats.remove_repeats(documents(spark, texts(data))).collect()]
    assert sorted(got, key=str) == sorted(removed_by_force(data, 100), key=str)
    assert sum(r[2] for r in got) > 0


def test_periodic_texts_of_every_period_are_the_brute_force(spark):
    rng = random.Random(11)
    for data in ([(p, ("".join(rng.choices("abcdefgh ", k=p)) * 400)[: rng.randrange(100, 401)]) for p in range(1, 100)],):
        alone = repeats.remove_repeats(documents(spark, texts(data))).collect()
        assert sorted((tuple(r)[:4] + (bytes(r.kept),) for r in alone), key=str) == sorted(removed_by_force(data, 100), key=str)


@pytest.mark.parametrize("hot", [1, 3])
def test_different_texts_of_one_id_are_different_documents(spark, hot):
    rng = random.Random(5)
    passage = words(rng, 40)
    data = [(7, passage + "".join(rng.choices("abc", k=150))) for _ in range(3)] + [(7, "".join(rng.choices("xyz", k=300))), (None, "q" * 130), (None, words(rng, 60))]
    got = {bytes(r.kept): r.n_removed for r in repeats.remove_repeats(documents(spark, texts(data)), hot=hot).collect()}
    assert sorted(x == 0 for x in got.values()) == [False, False, False, True, True, True]
    assert sum(x > len(passage) - 10 for x in got.values()) == 2
    assert got[b"q"] == 129


@pytest.mark.parametrize("period", [1, 2, 5, 40, 73])
def test_stretches_that_hold_equal_windows_are_marked(period):
    rng = random.Random(period)
    for _ in range(20):
        text = "".join(rng.choices("abcdefgh", k=60)) + ("".join(rng.choices("abcdefgh", k=period)) * 400)[: rng.randrange(90, 420)] + "".join(rng.choices("abcdefgh", k=60))
        raw = text.encode()
        buf, off = np.frombuffer(raw, np.uint8), np.array([0, len(raw)])
        for *_, start, n, inner in zip(*repeats.stretches(buf, off, 100, 28), strict=True):
            windows = [raw[i : i + 100] for i in range(start, start + n)]
            assert inner or len(set(windows)) == n


def test_maximal_repeats_have_all_occurrences():
    parts = [b"xabcdefgy", b"zabcdefgw", b"qabcdefgabcde"]
    buf, off = np.frombuffer(b"".join(parts), np.uint8), np.cumsum([0, *map(len, parts)])
    found = {buf[at[0] : at[0] + n].tobytes(): sorted(at.tolist()) for n, at in repeats.maximal_repeats(buf, off, 4)}
    assert found[b"abcdefg"] == [1, 10, 19]
    assert found[b"abcde"] == [1, 10, 19, 26]


def shingle_set(text):
    w = WORD.findall((text or "").translate(ASCII_LOWER))
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def classes_by_force(data):
    sets = [shingle_set(t) for _, t in data]
    parent = list(range(len(data)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(data)):
        for b in range(a):
            both = len(sets[a] | sets[b])
            if (len(sets[a] & sets[b]) / both if both else 1.0) >= 0.8:
                parent[root(a)] = root(b)
    size, first = defaultdict(int), {}
    for k, (i, _) in enumerate(data):
        size[root(k)] += 1
        if i is not None:
            first[root(k)] = min(first.get(root(k), i), i)
    return sorted((str(i), str(first.get(root(k), i)), size[root(k)]) for k, (i, _) in enumerate(data)), set(first.values())


def test_near_duplicate_classes_are_the_brute_force(spark):
    want, first = classes_by_force([(i, t) for i, t, *_ in rows()])
    got = sorted((str(r.doc_id), str(r.class_id), r.class_size) for r in dart_minhash.near_duplicates(documents(spark)).collect())
    assert got == want
    out = dart_minhash.drop_near_duplicates(documents(spark))
    assert {r.doc_id for r in out.collect()} >= first
    assert dart_minhash.near_duplicates(documents(spark, [])).count() == 0


def family(rng, base, count, edits):
    out = []
    for _ in range(count):
        w = list(base)
        for _ in range(rng.randrange(edits)):
            at = rng.randrange(len(w))
            w[at : at + rng.choice((0, 1, 1))] = [f"w{rng.randrange(40)}"]
        out.append(" ".join(w))
    return out


def test_near_duplicate_classes_of_large_groups_are_the_brute_force(spark):
    rng = random.Random(11)
    base = words(rng, 90).split()
    second = base[:30] + words(rng, 8).split() + base[36:]  # a second centre in the same buckets
    data = list(enumerate(family(rng, base, 120, 9) + family(rng, second, 80, 6) + family(rng, words(rng, 40).split(), 40, 4)))
    got = sorted((str(r.doc_id), str(r.class_id), r.class_size) for r in dart_minhash.near_duplicates(documents(spark, texts(data))).collect())
    assert got == classes_by_force(data)[0]


def test_texts_written_several_times_over_meet_the_single_one(spark):
    rng = random.Random(21)
    data = []
    for k in range(120):
        text = words(rng, 60, 10**6)
        data += [(2 * k, text), (2 * k + 1, " ".join([text] * (2, 3, 5, 10)[k % 4]))]
    got = sorted((str(r.doc_id), str(r.class_id), r.class_size) for r in dart_minhash.near_duplicates(documents(spark, texts(data))).collect())
    assert got == sorted((str(i), str(i - i % 2), 2) for i, _ in data)


def test_differences_meet_all_links_of_open_members(spark):
    rng = random.Random(5)
    base = [rng.randrange(2**32) for _ in range(60)]
    sets = {}
    for v in range(1, 161):
        own = list(sets[rng.randrange(1, v)]) if v > 1 and rng.random() < 0.5 else list(base)
        for _ in range(rng.randrange(1, 9)):
            own[rng.randrange(len(own))] = rng.randrange(2**32)
        sets[v] = set(own[rng.randrange(4) :])
    sets[0] = set(base)
    blobs = spark.createDataFrame([(v, bytearray(np.array(sorted(s), "<u4").tobytes())) for v, s in sets.items()], "v long, blob binary")
    compared = dart_minhash._compare(spark.createDataFrame([(0, v) for v in range(1, 161)], "x long, y long"), blobs, True)
    alike = lambda a, b: len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.8
    links = [(a, b) for a in range(1, 161) for b in range(a + 1, 161) if alike(a, b)]
    for among_open in (False, True):
        met = {tuple(r) for r in dart_minhash._meet_by_differences(compared, 0.8, among_open).collect()}
        want = {(a, b) for a, b in links if not (alike(0, a) and alike(0, b)) and (among_open or alike(0, a) or alike(0, b))}
        assert len(want) > 10 and met >= want
        assert not any(alike(0, a) and alike(0, b) for a, b in met)


def test_dart_signatures_agree_as_often_as_weighted_sets_overlap():
    rng = np.random.default_rng(3)
    shared, own = rng.integers(1, 2**62, 300, dtype=np.uint64), rng.integers(1, 2**62, 100, dtype=np.uint64)
    weights = 1 + rng.random(400) * 2
    el = np.concatenate([shared, own, shared])
    doc = np.concatenate([np.zeros(400, np.int64), np.ones(300, np.int64)])
    sig = dart_minhash.dart_signatures(el, doc, np.concatenate([weights, weights[:300]]), 2, 4096)
    assert abs((sig[0] == sig[1]).mean() - weights[:300].sum() / weights.sum()) < 0.03
    assert len(kernel.shingles(np.zeros(0, np.uint64), np.zeros(0, np.int64))[0]) == 0
