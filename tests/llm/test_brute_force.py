"""Whole results of operators 5, 6, 9 and 10 and of the pipeline against plain Python."""

import math
import random
import re
from collections import Counter

import corpus_pipeline
from pyspark.sql import functions as F

from cartage.llm import dart_minhash, media, packing, toxicity

from .fixtures import SCHEMA, documents, rows, texts, words
from .test_mixing_packing_pipeline import packing_words, poisson, uniform
from .test_text_operators import lexicon_by_force

SF = "/root/testdata/sf0.01"


# ---- operator 5


def chunks_by_force(data):
    """Lengths of the chunks by a hash that rolls byte by byte."""
    gear, h, last, out = [int(x) for x in media.GEAR], 0, 0, []
    if len(data) <= media.MIN_CHUNK:
        return [len(data)]
    cuts = []
    for i, b in enumerate(data):
        h = ((h << 1) + gear[b]) % 2**64
        if h >> (64 - media.MASK_BITS) == 0:
            cuts.append(i + 1)
    cuts = set(cuts)
    for end in range(1, len(data) + 1):
        if end - last == media.MAX_CHUNK or (end - last >= media.MIN_CHUNK and end in cuts) or end == len(data):
            out.append(end - last)
            last = end
    return out


def feature_by_force(payload):
    x = [b - 128 for b in payload]
    crossings = sum((a < 0) != (b < 0) for a, b in zip(x, x[1:], strict=False))
    return f"mean={sum(x) / len(x):.4f};rms={math.sqrt(sum(v * v for v in x) / len(x)):.4f};zc={crossings};peak={max(map(abs, x))}"


def test_media_features_and_chunks_are_the_brute_force(spark):
    rng = random.Random(8)
    data = [(i, t) for i, t, *_ in rows() if i is not None and i != 303] + [(900, words(rng, 3000)), (901, "\x00" * 70_000), (902, "ab" * 9000)]
    got = {}
    for r in media.media_columns(documents(spark, texts(data))).collect():
        got.setdefault(r.doc_id, []).append(r)
    for i, t in data:
        raw = (t or "").encode()
        payload = raw + bytes(-len(raw) % 64 or (0 if raw else 64))
        stored = media.to_wav(payload)
        for r in got[i]:
            assert r.feature == feature_by_force(payload)
            assert r.n_chunks == len(chunks_by_force(stored))
        assert [len(x) for _, x in media.chunks_of(stored)] == chunks_by_force(stored)


# ---- operator 6


def test_batches_are_the_brute_force(spark):
    df = documents(spark)
    got = sorted(tuple(r) for r in packing.pack(df, max_len=64, buckets=3, budget=256).select("doc_id", "piece", "start", "length", "bucket", "batch", "slot", "capacity").collect() if r.doc_id is not None)
    salted = df.select("doc_id", "text", F.xxhash64("doc_id", F.when(F.col("doc_id").isNull(), F.col("text"))).alias("salt")).collect()
    pieces = []
    for r in salted:
        n = len(packing_words(r.text)) + 1
        pieces += [(r.doc_id, k, 64 * k, min(64, n - 64 * k), r.salt, n) for k in range(-(-n // 64))]
    shard = {(r.salt, r.piece): r.s for r in spark.createDataFrame([(p[4], p[1]) for p in pieces], "salt long, piece int").select("salt", "piece", F.pmod(F.xxhash64("salt", "piece"), F.lit(256)).alias("s")).collect()}
    sizes = sorted({p[3] for p in pieces})
    count = Counter(p[3] for p in pieces)
    cost = lambda bounds: sum(c * (min(b for b in bounds if b >= k) - k) for k, c in count.items())
    bounds = packing.optimal_bounds(dict(count), 3)
    assert cost(bounds) == min(cost([a, b, sizes[-1]]) for a in sizes for b in sizes)
    want = []
    for b in bounds:
        own = [p for p in pieces if min(x for x in bounds if x >= p[3]) == b]
        own.sort(key=lambda p: (shard[p[4], p[1]], p[0] is not None, p[0] or 0, p[1], p[5]))
        for rank, p in enumerate(own):
            capacity = max(1, 256 // b)
            want.append((*p[:4], b, rank // capacity, rank % capacity, capacity))
    ties = Counter((p[0], p[1]) for p in pieces)
    assert [g for g in got if ties[g[0], g[1]] == 1] == sorted(w for w in want if w[0] is not None and ties[w[0], w[1]] == 1)


# ---- operator 9


def similar_pairs(data, threshold=0.8):
    """All pairs of texts whose sets of five-word shingles are that similar, by an inverted index."""
    sets, where = {}, {}
    for i, t in data:
        w = re.findall(r"[0-9a-z\x80-\U0010ffff]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
        s = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
        if s:
            sets[i] = s
    for i, s in sets.items():
        for x in s:
            where.setdefault(x, []).append(i)
    shared = Counter()
    for ids in where.values():
        for a in range(len(ids)):
            for b in range(a + 1, len(ids)):
                shared[ids[a], ids[b]] += 1
    return [(a, b) for (a, b), n in shared.items() if n >= threshold * (len(sets[a]) + len(sets[b]) - n)]


def classes(ids, pairs):
    top = {i: i for i in ids}

    def find(i):
        while top[i] != i:
            top[i] = top[top[i]]
            i = top[i]
        return i

    for a, b in pairs:
        top[max(find(a), find(b))] = min(find(a), find(b))
    return {i: find(i) for i in ids}


def test_recall_of_near_duplicates_on_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    data = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    pairs = similar_pairs(data)
    got = {r.doc_id: r.class_id for r in dart_minhash.near_duplicates(docs).collect()}
    linked = [(a, b) for a, b in pairs if got[a] == got[b]]
    assert len(pairs) > 10 and len(linked) >= 0.97 * len(pairs)
    want = classes([i for i, _ in data], pairs)
    assert all(want[i] == want[c] for i, c in got.items() if want[i] in want and (i, c) and c in want and i != c)  # nothing else is joined


# ---- operator 10


def fold_by_force(text):
    """Folding as its rules say, character by character."""
    out = []
    for ch in text or "":
        o = ord(ch)
        if o in (0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF, 0xAD):
            continue
        if 0xFF01 <= o <= 0xFF5E:
            ch = chr(o - 0xFEE0).lower()
        elif ch in toxicity.LOOKALIKES:
            ch = toxicity.LOOKALIKES[ch]
        elif ch.lower() in toxicity.LOOKALIKES and len(ch.lower()) == 1:
            ch = toxicity.LOOKALIKES[ch.lower()]
        out.append(ch.lower() if len(ch.lower()) == 1 else ch)
    is_word = lambda c: c is not None and c.isalnum()
    is_letter = lambda c: c is not None and c.isalpha()
    at = lambda s, i: s[i] if 0 <= i < len(s) else None
    # Signs between signs of words first, from left to right: the neighbours are those of the text before.
    signed = [toxicity.SIGNS[c] if c in toxicity.SIGNS and is_word(at(out, i - 1)) and is_word(at(out, i + 1)) else c for i, c in enumerate(out)]
    done = list(signed)
    i = 0
    while i < len(signed):
        j = i
        while j < len(signed) and signed[j] in toxicity.DIGITS:
            j += 1
        if j > i:
            if is_letter(at(signed, i - 1)) and is_letter(at(signed, j)):
                done[i:j] = [toxicity.DIGITS[c] for c in signed[i:j]]
            elif j == i + 1 and not (is_word(at(signed, i - 1)) or at(signed, i - 1) == "_") and is_letter(at(signed, j)) and is_letter(at(signed, j + 1)):
                done[i] = toxicity.DIGITS[signed[i]]
            i = j
        else:
            i += 1
    return "".join(c if c.isalnum() else " " for c in "".join(done)).split()


def test_folding_is_the_brute_force():
    rng = random.Random(6)
    signs = list("abzmoronAB0134578269@$! .-_аеоРＡｂ​­ß")
    for _ in range(4000):
        text = "".join(rng.choice(signs) for _ in range(rng.randrange(14)))
        assert toxicity.fold(text) == fold_by_force(text), repr(text)


# ---- the pipeline


def test_pipeline_is_the_brute_force(spark, tmp_path):
    rng = random.Random(21)
    fresh = lambda i, n=50: " ".join(f"k{i}w{rng.randrange(10**6)}" for _ in range(n))
    data, labels = [], []
    for i in range(90):
        toxic = i % 3 == 0
        data.append((i, f"common start {fresh(i)} {'moron' if toxic else 'person'}", "en", rng.choice(["web", "web", "news", None]), 1))
        labels.append((i, 1, int(toxic)))
    kept = [r for r in data if r[0] % 3]
    data += [(200 + k, kept[k][1], "en", "news", 1) for k in range(8)]  # exact copies
    data += [(300 + k, kept[10 + k % 3][1] + f" tail{k}", "en", "web", 1) for k in range(9)]  # near copies
    data += [(400, None, None, None, None), (401, "", None, "web", 0), (402, words(rng, 5000), "en", "web", 1)]
    spark.createDataFrame(data, SCHEMA).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    import zlib

    train = [(t, data[i][1]) for i, _, t in labels if zlib.crc32(str(i).encode()) % 5 != 0]
    scores = lexicon_by_force(train, [r[1] or "" for r in data])
    left = [r for r, s in zip(data, scores, strict=True) if s < 0.5]
    assert {r[0] for r in left} == {r[0] for r in data if r[0] >= 90 or r[0] % 3}
    last = {}
    for r in left:
        last[r[1] or ""] = max(last.get(r[1] or "", -1), r[0])
    left = [r for r in left if last[r[1] or ""] == r[0]]
    top = classes([r[0] for r in left], similar_pairs([(r[0], r[1]) for r in left]))
    wordless = [r[0] for r in left if not re.findall(r"[0-9A-Za-z\x80-\U0010ffff]", r[1] or "")]
    for i in wordless:
        top[i] = min(wordless)
    left = [r for r in left if top[r[0]] == r[0]]
    n = Counter(r[3] for r in left)
    weight = {s: math.sqrt(c) for s, c in n.items()}
    rate = {s: weight[s] / sum(weight.values()) * len(left) / c for s, c in n.items()}
    want = Counter()
    for r in left:
        size = len(packing_words(r[1])) + 1
        copies = poisson(rate[r[3]], uniform(f"mix-1:{r[0]}"))
        for k in range(-(-size // packing.MAX_LEN)):
            want[r[0], k, k * packing.MAX_LEN, min(packing.MAX_LEN, size - k * packing.MAX_LEN)] += copies
    got = Counter(tuple(r) for r in corpus_pipeline.run(spark, str(tmp_path)).select("doc_id", "piece", "start", "length").collect())
    assert got == +want and len(got) > 25


def test_pipeline_carries_columns_of_any_name(spark):
    from cartage.llm.exact_dedup import drop_exact_duplicates

    rng = random.Random(31)
    own = words(rng, 60)
    data = [(1, own), (1, own), (2, own + " tail"), (3, words(rng, 60)), (None, own)]
    names = ["__id", "__digest", "__gone", "__lost", "__body", "__bad", "__ID_"]
    docs = documents(spark, texts(data)).withColumns({c: F.lit(f"mine {c}") for c in names})
    lab = spark.createDataFrame([(3, 1, 0)], "doc_id long, quality int, toxic int")
    for out in (drop_exact_duplicates(docs), dart_minhash.drop_near_duplicates(docs), toxicity.drop_toxic(docs, lab)):
        assert out.columns == docs.columns
        assert all(r[c] == f"mine {c}" for r in out.collect() for c in names)
    assert dart_minhash.drop_near_duplicates(docs).count() == 2
