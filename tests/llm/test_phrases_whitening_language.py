"""Operators 11 to 13 against brute force, exact fractions and held-out rows."""

import math
import random
import re
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest

import __spark_entry__
from cartage.llm import language_id, phrases, scratch, whitening

from .fixtures import SCHEMA, documents

SF = "/root/testdata/sf0.001"


# ---- operator 11


def phrases_by_force(data, least, top):
    """Contract of operator 11 in plain Python; ``data``: (lang, text)."""
    f, n = Counter(), Counter()
    for lang, text in data:
        lang = "und" if lang is None else lang
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", low):
            w = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(w)
            for i in range(len(w)):
                for k in range(1, 5):
                    if i + k <= len(w):
                        f[lang, tuple(w[i : i + k])] += 1
    rows = []
    for (lang, g), a in f.items():
        if len(g) < 2 or a < least:
            continue
        inside = any(len(h) > len(g) and other == lang and b >= least and 100 * b >= 80 * a and any(h[i : i + len(g)] == g for i in range(len(h))) for (other, h), b in f.items() if b >= least)
        if not inside:
            score, _, left, right = min((2000000 * a // (f[lang, g[:k]] + f[lang, g[k:]]), k, f[lang, g[:k]], f[lang, g[k:]]) for k in range(1, len(g)))
            rows.append((lang, -score, -a, " ".join(g).encode(), left, right))
    out, place = [], Counter()
    for lang, score, a, g, left, right in sorted(rows):
        place[lang] += 1
        if place[lang] <= top:
            out.append((lang, place[lang], g.decode(), -a, left, right, n[lang], -score))
    return out


def phrase_rows(seed=3):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(12)] + ["Éa", "b\x01c", "x\x00y", "ab-c", "z" * 600, "Q"]
    data = []
    for i in range(150):
        text = "".join(rng.choice(vocabulary[: rng.choice((3, 18))]) + rng.choice([" ", " ", " ", "  ", "\t", ", ", ".\n", "\r", "!"]) for _ in range(rng.randrange(60)))
        data.append((rng.choice(["en", "en", "de", "und", None]), text))
    data += [("en", "w1 w2 w3 w4 w5")] * 40 + [("de", "w1 w2 w3 w4 w5 w6")] * 35  # copies
    data += [("xx", "once only"), ("en", None), (None, ""), ("de", "..., ;"), ("en", "w1 w1 " * 3000)]
    return data


@pytest.mark.parametrize(("least", "top", "max_keys", "held"), [(30, 2000, 1_000_000, 3_000_000), (8, 25, 1_000_000, 500), (8, 25, 5, 3_000_000)])
def test_phrases_equal_brute_force(spark, monkeypatch, least, top, max_keys, held):
    """Also with a broadcast of five words, with tasks that send often, and with choices in several rounds."""
    monkeypatch.setattr(phrases, "HELD", held)
    monkeypatch.setattr(phrases, "CHOICE", 50)
    data = phrase_rows()
    df = documents(spark, [(i, t, lang, "web", 0) for i, (lang, t) in enumerate(data)]).repartition(5)
    got = sorted(map(tuple, phrases.collocations(df, min_count=least, top=top, max_keys=max_keys).collect()), key=lambda r: r[:2])
    assert got == phrases_by_force(data, least, top)
    assert len(got) > 10


def test_phrases_of_empty_tables_and_without_candidates(spark):
    assert phrases.collocations(spark.createDataFrame([], SCHEMA)).count() == 0
    df = documents(spark, [(1, "a b c", "en", None, 1), (None, None, None, None, None)])
    assert phrases.collocations(df).count() == 0
    assert [f.name for f in phrases.collocations(df).schema] == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def test_radix_order_and_wide_keys():
    rng = np.random.default_rng(5)
    digits = rng.integers(0, 5, (4000, 12)).astype(np.uint16) * 13_001
    assert (digits[phrases.radix_order(digits)] == np.array(sorted(map(tuple, digits)))).all()
    code = np.array([5, 1 << 33, 7, 0, 9, 1 << 40], np.uint64)
    keys = phrases.windows(code, np.array([True, True, True, True, True, False]), 3).reshape(-1, 4, 3).astype(np.int64)
    assert [[(int(w[0]) << 32) + (int(w[1]) << 16) + int(w[2]) for w in k] for k in keys] == [[5, 1 << 33, 7, 0], [1 << 33, 7, 0, 0], [9, 1 << 40, 0, 0]]
    assert (phrases._as_digits(phrases._as_binary(digits), 3) == digits).all()


def test_scores_pass_64_bits(spark):
    big = 1 << 62
    codes = spark.createDataFrame([(1, big, ), (2, big)], "code long, n long")
    pairs = spark.createDataFrame([(1, 2, 0, 0, big - 7)], "w1 long, w2 long, w3 long, w4 long, n long")
    row = phrases.lowest_cuts(pairs, codes).first()
    assert (row.score, row.l, row.r) == (2000000 * (big - 7) // (2 * big), big, big)


# ---- operator 12


def whitening_by_force(vectors):
    """(n, deviations, exact covariance as fractions, centred x) of clean vectors."""
    x = [[math.floor(1024 * c) + 100000 for c in v] for v in vectors]
    n, d = len(x), len(x[0])
    s = [sum(r[j] for r in x) for j in range(d)]
    z = [[n * r[j] - s[j] for j in range(d)] for r in x]
    cov = [[Fraction(sum(r[i] * r[j] for r in z), n**3) for j in range(d)] for i in range(d)]
    return n, [sum(c * c for c in r) for r in z], cov, [[Fraction(c, n) for c in r] for r in z]


VECTORS = "vec_id long, embedding array<double>, label int"


def check_whitened(got, ids, vectors, parts=8):
    n, far, cov, centred = whitening_by_force(vectors)
    trace = float(sum(cov[i][i] for i in range(len(cov))))
    v = np.array([[float(c) for c in row] for row in cov])
    e = np.linalg.eigvalsh(v)[::-1]
    assert sorted((r.vec_id, r.component) for r in got) == sorted((i, c + 1) for i in ids for c in range(parts))
    by = {(r.vec_id, r.component): r for r in got}
    w = np.array([[by[i, c + 1].whitened for c in range(parts)] for i in ids])
    u = np.array([[float(c) for c in row] for row in centred])
    axes = np.linalg.lstsq(u, w, rcond=None)[0] * np.sqrt(e[:parts])  # the components, from the result
    assert np.allclose(np.linalg.norm(axes, axis=0), 1, atol=1e-9)
    assert np.abs(v @ axes - axes * e[:parts]).max() < 1e-9 * e[0]
    assert np.abs(w.T @ w / n - np.eye(parts)).max() < 1e-9
    for i, d in zip(ids, far, strict=True):
        for c in range(parts):
            r = by[i, c + 1]
            assert (r.n, int(r.deviation_text)) == (n, d)
            assert r.deviation == (d if d < 1 << 63 else None)
            assert abs(r.explained - e[c] / trace) <= 1e-9 * r.explained
            assert r.identity_error < 1e-9


def test_whitening_equals_exact_fractions(spark):
    rng = np.random.default_rng(7)
    vectors = (rng.normal(size=(60, 10)) * np.linspace(3, 0.05, 10)).tolist()
    vectors[5] = vectors[4]  # a repeated row
    bad = [(900, None, 1), (901, [1.0, None] * 5, 1), (902, [float("nan")] * 10, 1), (903, [float("inf")] + [0.0] * 9, 1), (904, [], 1)]
    rows = [(i, v, i % 3) for i, v in enumerate(vectors)]
    got = whitening.whiten(spark.createDataFrame(rows + bad, VECTORS).repartition(4)).collect()
    check_whitened(got, range(60), vectors)


def test_whitening_of_far_close_and_huge_entries(spark):
    rng = np.random.default_rng(8)
    scale = np.array([1e9, 1.0, 1.0, 1e-3, 5.0, 5.0])
    vectors = (rng.normal(size=(40, 6)) * scale + np.array([1e12, 5, -7, 0, 1e6, 0])).tolist()
    got = whitening.whiten(spark.createDataFrame([(i, v, 0) for i, v in enumerate(vectors)], VECTORS).repartition(3)).collect()
    n, far, cov, _ = whitening_by_force(vectors)
    by = {(r.vec_id, r.component): r for r in got}
    assert all(int(by[i, 1].deviation_text) == d and by[i, 1].deviation is None for i, d in enumerate(far))
    assert {r.component for r in got} >= {1} and max(r.identity_error for r in got) < 1e-4


def test_deviations_of_any_size_are_exact():
    rng = np.random.default_rng(9)
    for top, n in ((1000, 50), (1 << 40, 1000), (1 << 55, 1 << 40)):
        x = rng.integers(-top, top, (30, 4))
        sums = [int(s) for s in rng.integers(-top, top, 4)]
        sums = [s * n + 17 for s in sums] if n > 1000 else [s + 3 for s in sums]
        centre = whitening.Centre(n, sums)
        assert centre.deviations(x) == [sum((n * int(c) - s) ** 2 for c, s in zip(r, sums, strict=True)) for r in x]
        hi, lo = centre(x)
        exact = [[Fraction(int(c)) - Fraction(s, n) for c, s in zip(r, sums, strict=True)] for r in x]
        assert all(abs(Fraction(hi[i, j]) + Fraction(lo[i, j]) - exact[i][j]) <= abs(exact[i][j]) * Fraction(1, 2**95) for i in range(30) for j in range(4))


def test_outer_products_are_compensated():
    rng = np.random.default_rng(0)
    hi = rng.normal(size=(300, 4)) * [1, 1e3, 1e-3, 1e6]
    hi, lo = whitening.two_sum(hi, hi * 1e-17 * rng.normal(size=hi.shape))
    got = whitening.add_pair(*whitening.outer_products(hi[:200], lo[:200]), *whitening.outer_products(hi[200:], lo[200:]))
    both = [[Fraction(h) + Fraction(t) for h, t in zip(*r, strict=True)] for r in zip(hi, lo, strict=True)]
    for i in range(4):
        for j in range(4):
            exact = sum(r[i] * r[j] for r in both)
            assert abs(Fraction(got[0][i, j]) + Fraction(got[1][i, j]) - exact) < sum(abs(r[i] * r[j]) for r in both) * Fraction(1, 2**90)


def test_close_eigenvalues_keep_their_vectors():
    rng = np.random.default_rng(1)
    q = np.linalg.qr(rng.normal(size=(6, 6)))[0].astype(np.longdouble)
    for _ in range(3):  # orthogonal in extended precision
        q = q @ (1.5 * np.eye(6, dtype=np.longdouble) - 0.5 * (q.T @ q))
    e = np.array([5, 2 + 1e-9, 2, 1, 1e-3, 1e-6], np.longdouble)
    value, vector = whitening.eigen((q * e) @ q.T)
    assert np.abs(value - e).max() < 1e-15
    assert np.abs(np.abs((q * vector).sum(axis=0)) - 1).max() < 1e-14
    assert np.abs((q.T @ vector)[2, 1]) < 1e-9


def test_whitening_without_variance_or_rows(spark):
    empty = spark.createDataFrame([], VECTORS)
    assert whitening.whiten(empty).count() == 0
    assert whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0], 0)], VECTORS)).count() == 0
    assert whitening.whiten(spark.createDataFrame([(i, [1.0, 2.0], 0) for i in range(4)], VECTORS)).count() == 0
    line = spark.createDataFrame([(i, [float(i), 2.0 * i, 0.0], 0) for i in range(6)], VECTORS)
    assert {r.component for r in whitening.whiten(line).collect()} == {1}  # of one dimension
    with pytest.raises(Exception, match="different lengths"):
        whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0], 0), (2, [1.0], 0)], VECTORS).coalesce(1)).collect()


# ---- operator 13


def lengths_by_force(strings, depth):
    """Bits of ``s`` (depth context bytes and one byte) by partial matching, from the list of training strings."""
    counts = [Counter() for _ in range(depth + 1)]
    for s in strings:
        for k in range(depth + 1):
            counts[k][s[depth - k :]] += 1

    def bits(s):
        out, ruled = 0.0, set()
        for k in range(depth, -1, -1):
            here = {g[-1]: c for g, c in counts[k].items() if g[:-1] == s[depth - k : depth] and g[-1] not in ruled}
            if here:
                total = sum(here.values()) + len(here)
                if s[-1] in here:
                    return out - math.log2(here[s[-1]] / total)
                out -= math.log2(len(here) / total)
            ruled |= set(here)
        return out + math.log2(256 - len(ruled))

    return bits


def test_code_lengths_equal_brute_force():
    rng = random.Random(4)
    for depth in (1, 2, 4):
        strings = [bytes(rng.choice(b"ab\x00c") for _ in range(depth + 1)) for _ in range(60)]
        strings += [bytes([255] * (depth + 1))] * 5
        pack = lambda s: int.from_bytes(s, "big")
        key, n = np.unique(np.array([pack(s) for s in strings], np.uint64), return_counts=True)
        tree, bits = language_id.Tree(key, n, depth), lengths_by_force(strings, depth)
        asked = strings[:30] + [bytes(rng.choice(b"abcxy\xff") for _ in range(depth + 1)) for _ in range(80)]
        got = tree.code_lengths(np.array([pack(s) for s in asked], np.uint64))
        assert np.allclose(got, [bits(s) for s in asked], rtol=1e-12)


def test_probabilities_of_all_bytes_add_up_to_one():
    rng = random.Random(6)
    key, n = np.unique(np.array([int.from_bytes(bytes(rng.choice(b"abc") for _ in range(4)), "big") for _ in range(90)], np.uint64), return_counts=True)
    tree = language_id.Tree(key, n, 3)
    for context in (b"abc", b"xab", b"xyz", b"cca"):
        every = np.array([int.from_bytes(context + bytes([s]), "big") for s in range(256)], np.uint64)
        assert abs((2 ** -tree.code_lengths(every)).sum() - 1) < 1e-12


def test_languages_of_whole_rows(spark):
    rng = random.Random(2)
    pool = {"aa": "alpha omega delta kappa".split(), "bb": "uno dos tres cuatro".split(), "cc": "ichi ni san yon".split()}
    data, truth = [], {}
    for i in range(300):
        lang = rng.choice(list(pool))
        truth[i] = lang
        out = zlib.crc32(str(i).encode()) % 4 == 2
        data.append((i, " ".join(rng.choice(pool[lang]) for _ in range(12)), None if out else lang, "web", 1))
    data += [(1000, None, "aa", None, 1), (1001, "", "aa", None, 1), (1002, "123 ... 456", "bb", None, 1), (None, "uno dos", "bb", None, 1), (1003, "omega " * 100_000, None, None, 1), (1004, "б", None, None, 1), (1005, "\U00010400", None, None, 1)]
    for sample in (language_id.SAMPLE_BYTES, 3000):
        got = {r.doc_id: r for r in language_id.identify(documents(spark, data).repartition(4), sample_bytes=sample).collect()}
        assert len(got) == len(data)
        assert all(got[i].lang_pred == truth[i] and got[i].score > 0.99 for i in truth)
        assert all(got[i].held_out == (i is not None and zlib.crc32(str(i).encode()) % 4 == 2) for i in got)
        assert [(got[i].lang_pred, got[i].score) for i in (1000, 1001, 1002)] == [("und", 0.0)] * 3
        assert (got[1003].lang_pred, got[None].lang_pred) == ("aa", "bb")
        assert got[1004].lang_pred in pool and got[1005].lang_pred in pool and 0 <= got[1004].score <= 1


def test_languages_do_not_depend_on_other_columns_or_ready_table(spark, monkeypatch):
    data = [(i, t, lang, s, 1) for i, (t, lang, s) in enumerate([("der die das", "de", "x"), ("the of and", "en", "y")] * 20)]
    other = [(i, t, lang if zlib.crc32(str(i).encode()) % 4 != 2 else "zz", "q", 1) for i, t, lang, _, _ in data]
    a = sorted(map(tuple, language_id.identify(documents(spark, data)).collect()))
    assert a == sorted(map(tuple, language_id.identify(documents(spark, other)).collect()))
    monkeypatch.setattr(language_id, "READY", 6)
    assert a == sorted(map(tuple, language_id.identify(documents(spark, data)).collect()))


def test_languages_of_empty_and_unlabelled_tables(spark):
    assert language_id.identify(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = language_id.identify(documents(spark, [(1, "abc", None, None, 1), (None, None, None, None, None)])).collect()
    assert {(r.lang_pred, r.score) for r in rows} == {("und", 0.0)}


def test_held_out_accuracy(spark):
    got = __spark_entry__.queries()["op13_language_id"](spark, SF)
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang")
    rows = got.where("held_out").join(docs, "doc_id").where("lang IS NOT NULL").collect()
    assert len(rows) > 30 and sum(r.lang == r.lang_pred for r in rows) >= 0.97 * len(rows)


# ---- scratch


def test_scratch_folder_without_a_setting(spark):
    class Conf:
        def get(self, key, default=None):
            return default

    class Session:
        conf, sparkContext = Conf(), spark.sparkContext

    first = scratch.scratch_root(Session())
    assert first == scratch.scratch_root(Session()) and first.startswith("file:///")
