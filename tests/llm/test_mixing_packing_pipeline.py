import hashlib
import itertools
import math
import random

import corpus_pipeline
from cartage.llm import dart_minhash, mixing, packing, toxicity
from pyspark.sql import functions as F

from .fixtures import documents, rows, texts


def uniform(text):
    return int(hashlib.md5(text.encode()).hexdigest()[:12], 16) / 2**48


def poisson(mean, u):
    k, term, total = 0, math.exp(-mean), math.exp(-mean)
    while total <= u:
        k += 1
        term *= mean / k
        total += term
    return k


def test_mixing_draws_are_the_brute_force(spark):
    data = rows()
    n = {}
    for r in data:
        n[r[3]] = n.get(r[3], 0) + 1
    for targets in (None, {"web": 1.0, "news": 3.0}):
        w = {s: (math.sqrt(c) if targets is None else targets.get(s or "", 0.0)) for s, c in n.items()}
        rate = {s: w[s] / sum(w.values()) * len(data) / c for s, c in n.items()}
        want = sorted((str(r[0]), str(r[3]), k) for r in data for k in range(poisson(rate[r[3]], uniform(f"mix-1:{'null' if r[0] is None else r[0]}"))))
        got = mixing.mix_sources(documents(spark), targets=targets)
        assert sorted((str(r.doc_id), str(r.source), r["__copy"]) for r in got.collect()) == want
    order = [r["__order"] for r in mixing.mix_sources(documents(spark)).collect()]
    assert order == sorted(order)
    assert mixing.mixed_documents(documents(spark)).columns == documents(spark).columns
    assert mixing.mix_sources(documents(spark, [])).count() == 0


def test_high_rates_are_drawn_whole(spark):
    docs = spark.createDataFrame([(i, "x", "en", "a", 1) for i in range(400)], "doc_id long, text string, lang string, source string, n_chars long")
    copies = [r["__copies"] for r in mixing.mix_sources(docs, size=50.0).select("doc_id", "__copies").distinct().collect()]
    mean = sum(copies) / 400
    assert abs(mean - 50) < 1.5
    assert abs(sum((c - mean) ** 2 for c in copies) / 400 - 50) < 12


def test_bounds_have_the_least_padding():
    rng = random.Random(2)
    for _ in range(30):
        hist = {rng.randrange(1, 40): rng.randrange(0, 9) for _ in range(9)}
        live = sorted(k for k, c in hist.items() if c)
        cost = lambda bounds: sum(c * (min(b for b in bounds if b >= k) - k) for k, c in hist.items() if c)
        for buckets in (1, 2, 3):
            found = packing.optimal_bounds(hist, buckets)
            if not live:
                assert found == []
                continue
            best = min(cost([*x, live[-1]]) for m in range(min(buckets, len(live))) for x in itertools.combinations(live[:-1], m))
            assert cost(found) == best
            assert len(found) <= buckets


def test_packing_loses_no_token_and_fills_batches(spark):
    out = packing.pack(documents(spark), max_len=64, buckets=3, budget=256).collect()
    lengths = [len([w for w in packing_words(t)]) + 1 for _, t, *_ in rows()]
    assert sum(r.length for r in out) == sum(lengths)
    batches = {}
    for r in out:
        assert r.length <= r.bucket and r.capacity == max(1, 256 // r.bucket) and r.padding == r.bucket - r.length
        batches.setdefault((r.bucket, r.batch), []).append(r.slot)
    last = {}
    for (b, k), slots in batches.items():
        assert sorted(slots) == list(range(len(slots)))
        last[b] = max(last.get(b, 0), k)
    assert all(len(s) == max(1, 256 // b) for (b, k), s in batches.items() if k < last[b])
    assert packing.pack(documents(spark, [])).count() == 0


def packing_words(text):
    import re

    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def test_pipeline_stages_keep_columns_and_clean_documents(spark, tmp_path):
    rng = random.Random(9)
    clean = [(i, " ".join(f"c{i}w{rng.randrange(10**6)}" for _ in range(60)), "en", "web", 1) for i in range(40)]
    bad = [(100 + i, f"calm words {i} moron " + " ".join(f"z{i}x{rng.randrange(10**6)}" for _ in range(30)), "en", "web", 1) for i in range(40)]
    copies = [(200, clean[0][1], "en", "web", 1), (201, clean[1][1] + " tail", "en", "web", 1), (202, None, None, None, None), (None, clean[2][1], "en", "web", 1)]
    spark.createDataFrame([*clean, *bad, *copies], "doc_id long, text string, lang string, source string, n_chars long").coalesce(2).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i >= 100)) for i in [*range(40), *range(100, 140)]], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    ids = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == docs.columns
            out.write.parquet(f"{tmp_path}/stage{k}")
            docs = spark.read.parquet(f"{tmp_path}/stage{k}")
            ids.append(sorted(r.doc_id for r in docs.where(F.col("doc_id").isNotNull()).collect()))
    assert not [i for i in ids[0] if 100 <= i < 200] and set(ids[0]) == {*range(40), 200, 201, 202}
    assert set(ids[1]) == set(ids[0]) - {0}
    assert len(ids[2]) == len(ids[1]) - 1 and {1, 201} & set(ids[2])
    assert set(ids[3]) <= set(ids[2])
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 0


def test_empty_pipeline(spark, tmp_path):
    documents(spark, texts([])).select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_rejected_rows_take_no_other_row_of_their_id_along(spark):
    rng = random.Random(12)
    text = [" ".join(f"q{k}w{rng.randrange(10**6)}" for _ in range(60)) for k in range(6)]
    data = [(None, text[0]), (None, text[1]), (1, text[1] + " tail"), (None, text[2]), (None, text[2] + " tail")]
    data += [(5, text[3]), (4, text[3] + " tail"), (5, text[4]), (9, text[4] + " tail"), (7, text[5]), (7, text[5] + " tail"), (7, text[5])]
    docs = documents(spark, texts(data))
    kept = sorted((str(r.doc_id), r.text) for r in dart_minhash.drop_near_duplicates(docs).collect())
    by_class = [[k for k in kept if k[1].startswith(t)] for t in text]
    assert [len(k) for k in by_class] == [1] * 6 and len(kept) == 6
    assert [k[0][0] for k in by_class] == ["None", "1", "None", "4", "5", "7"]
    flagged = dart_minhash.near_duplicates(docs).where("kept").collect()
    assert sorted({str(r.doc_id) for r in flagged}) == sorted({k[0] for k in kept})


def test_toxic_rows_take_no_clean_row_of_their_id_along(spark):
    rng = random.Random(13)
    train = [(i, f"calm words {rng.randrange(10**6)} {'moron' if i % 2 else 'person'} " + " ".join(f"z{rng.randrange(10**6)}" for _ in range(20))) for i in range(60)]
    mixed = [(None, "a moron"), (None, "a person"), (None, None), (500, "the moron"), (500, "the person")]
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(60)], "doc_id long, quality int, toxic int")
    kept = [(r.doc_id, r.text) for r in toxicity.drop_toxic(documents(spark, texts(train + mixed)), labels).collect()]
    assert sorted((k for k in kept if k[0] is None or k[0] >= 500), key=str) == sorted([(None, "a person"), (None, None), (500, "the person")], key=str)
