import random
import re
import zlib
from collections import Counter
from math import lgamma, log, log10

import numpy as np
import pytest

from pyspark.sql import functions as F

from cartage.llm import context_tree, license_scan, media, queries, token_counts, toxicity

from .fixtures import documents, rows, texts, words


def test_license_base_places_are_the_brute_force(spark):
    data = [(i, t) for i, t, *_ in rows()] + [(1000, "The MIT license, THE mit License; cc-by-nc and Apache License, Version 2.0"), (1001, "the mit the mit license cc by cc by nc"), (1002, "SPDX-License-Identifier: (MIT OR GPL-3.0) AND Apache-2.0 WITH LLVM-exception\n")]
    got = {(r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in license_scan.scan_licenses(documents(spark, texts(data))).collect()}
    want = set()
    for i, t in data:
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        hits = [(k, label) for p, label in license_scan.BASE_PHRASES.items() for k in range(len(w)) if w[k : k + len(p.split())] == p.split()]
        want.add((i, len(w), len(hits), min((k for k, _ in hits), default=None), max((k for k, _ in hits), default=None), ",".join(sorted({x for _, x in hits}))))
    assert got == want


def test_license_base_places_are_the_contracts(spark, tmp_path):
    """Phrases written out here, through the registered query and stored rows."""
    want = {
        (1, 4, 1, 0, 0, "mit", "mit", 0.95): "UNDER the\nMIT\x00License",
        (2, 3, 0, None, None, "", "mit", 0.95): "The MIT License.",
        (3, 5, 0, None, None, "", "mit", 0.95): "under é the MIT license",
        (4, 4, 0, None, None, "", "mit", 0.95): "sunder the MIT license",
        (5, 4, 0, None, None, "", "", 0.0): "under the MIT licenses",
        (6, 20, 5, 1, 16, "apache-2,cc-by-nc,mit", "apache-2,cc-by-nc,mit", 0.95): "🙂 under the mit license, Apache-License_Version:2 CC-BY-NC cc by nc under/under the mit license",
        (7, 4, 0, None, None, "", "", 0.0): "apache license version 2é",
        (8, 3, 0, None, None, "", "", 0.0): "cc by\u00a0 nc",
        (9, 0, 0, None, None, "", "", 0.0): None,
        (None, 4, 1, 0, 0, "mit", "mit", 0.95): "under the mit license",
    }
    spark.createDataFrame([(k[0], t) for k, t in want.items()], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op2_license_scan(spark, str(tmp_path)).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")
    assert {tuple(r) for r in got.collect()} == set(want)


@pytest.mark.parametrize(
    ("tokens", "ok", "names"),
    [("mit or gpl-3.0", True, ["mit", "gpl-3.0"]), ("mit and gpl-3.0", False, ["mit", "gpl-3.0"]), ("gpl-2.0 with classpath-exception-2.0 or bsd-3-clause", True, ["gpl-2.0", "bsd"]), ("( mit or gpl-3.0 ) and apache-2.0", True, ["mit", "gpl-3.0", "apache-2"]), ("gpl-3.0 or mit and gpl-2.0", False, ["gpl-3.0", "mit", "gpl-2.0"])],
)
def test_license_expressions(tokens, ok, names):
    assert license_scan.evaluate(license_scan.to_rpn(tokens.split())) == (ok, names)


@pytest.mark.parametrize("bad", ["mit or", "( mit", "mit )", "or mit", "mit gpl", ""])
def test_malformed_expressions_have_no_value(bad):
    assert license_scan.to_rpn(bad.split()) is None


@pytest.mark.parametrize("joined", [" AND {}", " AND ({}"])
def test_long_expressions_are_read_whole(joined):
    names = [f"lic-{i}" for i in range(80)]
    line = "SPDX-License-Identifier: MIT" + "".join(joined.format(x) for x in [*["ISC"] * 79, *names, "GPL-3.0"]) + ")" * (joined.count("(") * 160)
    got = license_scan.scan_text(f"a\n{line}\nb")
    assert set(got["labels"].split(",")) == {"mit", "isc", "gpl-3.0", *names}
    assert (got["permissive"], got["score"]) == (False, 1.0)
    assert got["expression"].endswith("gpl-3.0" + " )" * (joined.count("(") * 160))


def parsed(tokens):
    """Value and names by recursive descent; None if malformed."""
    pos = 0

    def take(*wanted):
        nonlocal pos
        if pos < len(tokens) and tokens[pos] in wanted:
            pos += 1
            return True
        return False

    def atom():
        nonlocal pos
        if take("("):
            value = either()
            if not take(")"):
                raise ValueError
            return value
        if pos == len(tokens) or tokens[pos] in ("and", "or", "with", ")"):
            raise ValueError
        name = license_scan.ALIASES.get(tokens[pos], tokens[pos])
        pos += 1
        return name in license_scan.PERMISSIVE, {name}

    def chain(word, below, join):
        value, names = below()
        while take(word):
            other, more = below()
            value, names = join(value, other), names if word == "with" else names | more
        return value, names

    def bound():
        return chain("with", atom, lambda a, b: a)

    def both():
        return chain("and", bound, lambda a, b: a and b)

    def either():
        return chain("or", both, lambda a, b: a or b)

    try:
        got = either()
    except ValueError:
        return None
    return got if pos == len(tokens) else None


def test_license_labels_expression_and_score_are_the_brute_force():
    rng = random.Random(3)
    names = ["mit", "gpl-3.0", "apache-2.0", "bsd-3-clause", "lgpl-2.1", "isc"]

    def expression(depth):
        kind = rng.random()
        if depth == 0 or kind < 0.3:
            return [rng.choice(names)]
        if kind < 0.5:
            return ["(", *expression(depth - 1), ")"]
        if kind < 0.6:
            return [rng.choice(names), "with", "classpath-exception-2.0"]
        return [*expression(depth - 1), rng.choice(["and", "or"]), *expression(depth - 1)]

    phrases = {**license_scan.NOTICES, **license_scan.BASE_PHRASES}
    for _ in range(400):
        tokens = expression(3)
        said = rng.sample(sorted(phrases), rng.randrange(3))
        strict = rng.random() < 0.5
        tag = rng.choice(["SPDX-License-Identifier:", "License-Expression:"]) if strict else "license:"
        text = " -- ".join(["lorem ipsum", *said]) + f"\n// {tag} {' '.join(tokens).upper()}" + rng.choice(["", " */"] if strict else ["", " applies to all of it", ", see the office"]) + "\nlicense: see the office\nLicense: none of it"
        got, (ok, named) = license_scan.scan_text(text), parsed(tokens)
        flat = f" {' '.join(re.findall('[a-z0-9]+', text.lower()))} "
        want = named | {label for p, label in phrases.items() if f" {p} " in flat}
        assert (got["labels"], got["expression"], got["permissive"], got["score"]) == (",".join(sorted(want)), " ".join(tokens), ok, 1.0)
    for text, labels, score in [("license: see the office", "", 0.0), ("License: none of it", "", 0.0), ("SPDX-License-Identifier: Own-1.0", "own-1.0", 1.0), ("SPDX-License-Identifier: is a tag", "", 0.0), ("license: mit license", "mit", 1.0), ("license: ruby on rails", "", 0.0), ("license: vim is great", "", 0.0), ("license: ruby", "ruby", 1.0), ("license: mit or ruby.\n", "mit,ruby", 1.0), ("license: mit or ruby shoes", "mit", 1.0), ("all rights reserved", "all-rights-reserved", 0.7), ("the MIT license", "mit", 0.95)]:
        got = license_scan.scan_text(text)
        assert (got["labels"], got["score"]) == (labels, score), text


def test_a_long_line_of_tags_is_read_in_time_and_empty_tables_are_empty(spark):
    import time

    for line in ("license: mit ", "license: mit or ", "license: ((", "spdx-license-identifier: mit or "):
        at = time.time()
        assert license_scan.scan_text(line * (1_000_000 // len(line)))["labels"] in ("mit", "")
        assert time.time() - at < 6
    assert license_scan.scan_licenses(documents(spark, [])).count() == 0
    clash = texts([(None, "license: mit"), (None, None)]), "doc_id long, text string"
    assert sorted(r.labels for r in license_scan.scan_licenses(documents(spark, clash[0]).withColumnRenamed("source", "labels")).collect()) == ["", "mit"]


def test_media_round_trip(spark):
    import hashlib

    data = [(i, t) for i, t, *_ in rows()]
    got = sorted(media.media_columns(documents(spark)).collect(), key=str)
    assert len(got) == len(data)
    by_id = {r.doc_id: r for r in got if r.doc_id is not None}
    for i, t in data:
        if i is None:
            continue
        raw = (t or "").encode()
        payload = raw + bytes(-len(raw) % 64 or (0 if raw else 64))
        r = by_id[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert (r.media_bytes, r.media_sha256) == (len(payload) + 44, hashlib.sha256(media.to_wav(payload)).hexdigest())
    assert media.media_columns(documents(spark, [])).count() == 0


def test_shared_chunks_are_stored_once_and_files_are_put_together(spark):
    rng = random.Random(5)
    long = words(rng, 8000)
    data = [(i, words(rng, 500 * i) + long) for i in range(4)]
    _, store = media.store_media(documents(spark, texts(data)))
    kept = sum(len(c.bytes) for r in store.collect() for c in [*r.own, *r.lent] if c.bytes is not None)
    assert kept < 0.5 * sum(len(t) for _, t in data)
    assert {r.payload_sha256 for r in media.read_media(store).collect()} == {r.payload_sha256 for r in media.media_columns(documents(spark, texts(data)), path=None).collect()}
    text = long.encode()
    assert b"".join(x for _, x in media.chunks_of(text)) == text


def tree_probability(train, text, depth):
    """log10 of the weighted trees' probability of each byte: ratios of whole weighted probabilities, by recursion."""
    counts = Counter()

    def bits(raw, at):
        ctx = bytes(depth - min(depth, at)) + raw[max(0, at - depth) : at]
        byte = raw[at]
        return [((ctx, (1 << k) | (byte >> (8 - k))), (byte >> (7 - k)) & 1) for k in range(8)]

    for raw in train:
        for at in range(len(raw)):
            for (ctx, d), bit in bits(raw, at):
                counts[ctx, d, bit] += 1

    def weighted(d, ctx, extra):
        """Natural log of the weighted probability of the node with the last len(ctx) bytes."""
        leaves = {c for (c, e, _) in counts if e == d and c.endswith(ctx)} | ({extra[0]} if extra and extra[0].endswith(ctx) else set())
        n = [sum(counts[c, d, b] for c in leaves) + (1 if extra and extra[0] in leaves and extra[1] == b else 0) for b in (0, 1)]
        kt = lgamma(n[0] + 0.5) + lgamma(n[1] + 0.5) - lgamma(n[0] + n[1] + 1) - log(3.141592653589793)
        if len(ctx) == depth:
            return kt
        below = sum(weighted(d, c, extra) for c in {x[depth - len(ctx) - 1 :] for x in leaves})
        from math import exp

        top = max(kt, below)
        return top + log((exp(kt - top) + exp(below - top)) / 2)

    total = 0.0
    for at in range(len(text)):
        for (ctx, d), bit in bits(text, at):
            total += (weighted(d, b"", (ctx, bit)) - weighted(d, b"", None)) / log(10)
    return total


def test_context_tree_scores_are_the_brute_force(spark):
    held = [i for i in range(60) if zlib.crc32(str(i).encode()) % 7 == 2]
    free = [i for i in range(60) if i not in held]
    data = [(free[0], "Abab abc"), (free[1], "abab"), (free[2], None), (held[0], "abab xyz abc"), (held[1], ""), (free[1], "abab"), (None, "bc\tab"), (held[0], "abab xyz abc")]
    train = [(t or "").lower() for i, t in data if i not in held]
    toks = Counter(w for t in train for w in [*re.findall(r"[^\x20\x09-\x0D]+", t), None])
    total = sum(toks.values())
    want = []
    for i, t in data:
        t = (t or "").lower()
        own = [*re.findall(r"[^\x20\x09-\x0D]+", t), None]
        base = sum(log10((toks[w] + 1) / (total + len(toks) + 1)) for w in own)
        score = tree_probability([x.encode() + b"\0" for x in train], t.encode() + b"\0", 4)
        want.append((i, i in held, len(own), sum(w in toks for w in own), total, round(base, 8), round(score, 8)))
    for most in (1_000_000, 4, 0):  # what is not broadcast is joined, with equal results
        got = [(r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 8), round(r.score, 8)) for r in context_tree.score_documents(documents(spark, texts(data)), max_keys=most).collect()]
        assert sorted(got, key=str) == sorted(want, key=str)


def test_context_tree_without_training_rows(spark):
    held = next(i for i in range(60) if zlib.crc32(str(i).encode()) % 7 == 2)
    r = context_tree.score_documents(documents(spark, texts([(held, "ab")]))).collect()
    assert (r[0].train_tokens, r[0].n_known) == (0, 0)
    assert r[0].bits_per_byte == pytest.approx(8)
    assert context_tree.score_documents(documents(spark, [])).count() == 0
    assert context_tree.score_documents(documents(spark)).count() == len(rows())


@pytest.mark.parametrize("seed", range(6))
def test_edited_counts_equal_fresh_counts(seed):
    rng = random.Random(seed)
    alphabet = ["a", "B", " ", "  ", "\n", "7", "'s", "漢", "🙂", "...", "don't", "é"]
    text = "".join(rng.choice(alphabet) for _ in range(rng.choice([0, 3, 900])))
    tree = token_counts.CountTree(text, token_counts.VOCABULARY)
    for _ in range(40):
        pos, gone = rng.randrange(len(text) + 5), rng.choice([0, 1, 5, 300])
        ins = "".join(rng.choice(alphabet) for _ in range(rng.choice([0, 1, 8])))
        tree.edit(pos, gone, ins)
        at = min(pos, len(text))
        text = text[:at] + ins + text[at + gone :]
        assert tree.text() == text
        assert tree.totals == token_counts.CountTree(text, token_counts.VOCABULARY).totals
        assert tree.totals[2] == len(tree.encoding.encode_ordinary(text))


def test_only_edited_regions_are_encoded_again():
    text = "plain words only " * 5000
    tree = token_counts.CountTree(text, token_counts.VOCABULARY)
    tree.edit(40_000, 5, "NEW")
    assert tree.encoded < 60


def test_count_tokens_with_edits(spark):
    edits = spark.createDataFrame([(1, 1, 0, 3, "xyz "), (1, 0, 5, 0, None), (1, 2, 10**6, 4, "end"), (999_999, 0, 0, 0, "a")], "doc_id long, seq long, pos long, del long, ins string")
    got = {(r.doc_id): r for r in token_counts.count_tokens(documents(spark), edits).collect()}
    text = next(t for i, t, *_ in rows() if i == 1)
    text = "xyz " + text[3:] + "end"
    assert got[1].n_tokens_after == len(token_counts.encoder(token_counts.VOCABULARY)[1].encode_ordinary(text))
    assert (got[1].n_edits, got[2].n_edits, got[300].n_tokens) == (3, 0, 0)
    assert token_counts.count_tokens(documents(spark)).count() == len(rows())
    assert token_counts.count_tokens(documents(spark, [])).count() == 0


def test_toxic_words_are_found_folded_and_exceptions_spared(spark):
    rng = random.Random(4)
    data, labels = [], []
    for i in range(600):
        toxic = i % 3 == 0
        text = words(rng, 40, 300)
        if toxic:
            at = rng.choice(["moron", "m0ron", "MORON", "mоron"])
            text = f"{text[:60]} {at} {text[60:]}"
        data.append((i, text))
        labels.append((i, 1, int(toxic)))
    data += [(700, None), (701, ""), (702, "trash can"), (None, "moron"), (703, "a moron "), (703, "a moron ")]
    labels += [(None, 1, 1), (703, None, None)]
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    out = toxicity.score_toxicity(documents(spark, texts(data)), lab).collect()
    assert len(out) == len(data)
    for r in out:
        if r.doc_id is not None and r.doc_id < 600 and r.held_out:
            assert r.predicted == int(r.doc_id % 3 == 0)
    by_id = {r.doc_id: r for r in out}
    assert (by_id[700].predicted, by_id[701].predicted, by_id[702].predicted, by_id[703].predicted) == (0, 0, 0, 1)
    docs = documents(spark, texts(data))
    kept = toxicity.drop_toxic(docs, lab)
    assert kept.columns == docs.columns
    none = toxicity.score_toxicity(docs, lab.where("toxic = 0"))
    assert {r.predicted for r in none.collect()} == {0}
    assert toxicity.score_toxicity(documents(spark, []), lab).count() == 0


def test_exceptions_spare_a_word_in_a_harmless_phrase():
    a = toxicity.automaton({"terms": {"trash ": 4.0}, "exceptions": ["trash can"]})
    assert toxicity.raw_score(["a", "trash", "can"], a)[0] == 0
    assert toxicity.raw_score(["trash", "talk"], a)[1] == 1


def test_toxicity_on_held_out_documents(spark):
    d = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{d}/labels.parquet")
    found = toxicity.score_toxicity(spark.read.parquet(f"{d}/documents.parquet"), labels).where("held_out").join(labels.where("toxic is not null"), "doc_id").select("predicted", "toxic").collect()
    right = [sum(r.predicted == r.toxic == k for r in found) / max(1, sum(r.toxic == k for r in found)) for k in (0, 1)]
    assert min(right) > 0.9, right


def test_words_of_all_rows_of_one_sketch_are_counted(spark):
    base = [f"t{k}" for k in range(400)]  # long, so that rows which differ in one word share their MinHash nearly always
    toxic = [(1, " ".join([*base, f"insult{i}"])) for i in range(6)]
    for order in (toxic, toxic[::-1]):
        rows_ = spark.createDataFrame(order + [(0, "calm words")], "toxic int, text string").coalesce(1)
        counts, t, n = toxicity._weights(rows_)
        assert {f"insult{i} " for i in range(6)} <= {r.term for r in counts.where("t >= 1").collect()}
        assert 1 <= t <= 6 and n == 1


def lexicon_by_force(train, scored):
    """Scores by counting sets and by searching every term at every word."""
    import math

    from cartage.llm import kernel as K

    def sketch(text):
        sh, _ = K.shingles(*K.words(K.LOWER[np.frombuffer(text.encode(), np.uint8)], np.array([0, len(text.encode())])))
        return min((int(x) >> 1 for x in K.hash_ints(sh, 23)), default=(2**64 - 1) >> 1)

    def terms(words):
        return {w + " " for w in words} | {w[:n] for w in words for n in (4, 5, 6) if len(w) > n}

    def count(of):
        rows = {(t, c, sketch(x)) for c, x in train for t in ["", *of(toxicity.fold(x))]}
        return Counter((t, c) for t, c, _ in rows)

    met = count(terms)
    t, n = met["", 1], met["", 0]
    weight = {w: math.log((met[w, 1] + 0.5) / (t + 1)) - math.log((met[w, 0] + 0.5) / (n + 1)) for w, _ in met if w}
    lexicon = {w: x for w, x in weight.items() if met[w, 1] >= toxicity.MIN_ROWS and x >= toxicity.MIN_WEIGHT}
    whole = {w[:-1] for w in lexicon if w.endswith(" ")}
    pairs = count(lambda ws: {f"{a} {b}" for a, b in zip(ws, ws[1:], strict=False) if a in whole or b in whole})
    spared = {p for p, _ in pairs if p and pairs[p, 0] >= 3 and pairs[p, 0] > 10 * pairs[p, 1]} | set(toxicity.EXCEPTIONS)

    def raw(text):
        words = toxicity.fold(text)
        safe = {k for p in spared for k in range(len(words)) if words[k : k + len(p.split())] == p.split() for k in range(k, k + len(p.split()))}
        found = {}
        for k, w in enumerate(words):
            best = max((x for term, x in lexicon.items() if (w + " ").startswith(term)), default=0.0)
            if best and k not in safe:
                found[w] = best
        return sum(found.values()) / (1 + math.log1p(len(words) / toxicity.LENGTH_SCALE))

    table = Counter((c, min(int(round(raw(x) * 20)), 2000)) for c, x in train)
    middle = toxicity._middle(dict(table)) / 20
    return [1 / (1 + math.exp(-2 * (raw(x) - middle))) for x in scored]


def test_toxicity_scores_are_the_brute_force(spark):
    rng = random.Random(4)
    bad, good = ["blorgish", "snarfing", "gronk", "vexatious"], [f"word{i}" for i in range(60)]
    data, labels = [], []
    for i in range(160):
        toxic = i % 3 == 0
        body = [rng.choice(good) for _ in range(rng.randrange(5, 60))]
        if toxic:
            body[1:1] = rng.sample(bad, 2)
        elif i % 5 == 0:
            body += ["gronk", "festival"]
        data.append((i, " ".join(body)))
        labels.append((i, 1, int(toxic), "clash"))
    data += [(None, "a gronk and blorgish thing"), (900, None), (901, ""), (902, "gr0nk " * 3 + "calm " * 20_000), (5, data[5][1])]
    lab = spark.createDataFrame([*labels, (None, 0, 1, "x"), (7777, 0, 1, "x"), (8, 0, None, "x")], "doc_id long, quality int, toxic int, text string")
    train = [(toxic, data[i][1]) for i, _, toxic, _ in labels if zlib.crc32(str(i).encode()) % 5] + [(labels[5][2], data[5][1])] * (zlib.crc32(b"5") % 5 > 0)
    got = toxicity.score_toxicity(documents(spark, texts(data)).withColumn("toxic", F.lit("clash")), lab).collect()
    want = lexicon_by_force(train, [t or "" for _, t in data])
    assert sorted((r.doc_id is None, r.doc_id or 0, round(r.score, 9), r.predicted) for r in got) == sorted((i is None, i or 0, round(s, 9), int(s >= 0.5)) for (i, _), s in zip(data, want, strict=True))
    assert {r.predicted for r in got} == {0, 1}
    assert toxicity.score_toxicity(documents(spark, []), lab).count() == 0


def test_leaves_that_grow_are_split():
    tree, text = token_counts.CountTree("one two three", token_counts.VOCABULARY), "one two three"
    for k in range(1500):
        tree.edit(4, 0, f"w{k} ")
        text = text[:4] + f"w{k} " + text[4:]
    assert max(map(len, tree.blocks)) <= 2 * token_counts.BLOCK
    assert tree.text() == text
    assert tree.totals == token_counts.CountTree(text, token_counts.VOCABULARY).totals
