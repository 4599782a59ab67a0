"""Small tables with the cases that every operator must stand: nulls, empty and long texts, ties, repeated rows, clashing names."""

import random

from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that operators use inside.
CLASHES = ("id", "body", "digest", "prefix", "size", "keep", "n", "c", "v", "row", "label", "toxic", "bucket", "batch", "whole", "steps", "list", "t", "doc", "start", "alive", "shared")


def words(rng, n, pool=4000):
    return " ".join(f"w{rng.randrange(pool)}" for _ in range(n))


def rows(seed=1):
    rng = random.Random(seed)
    base = [words(rng, rng.randrange(20, 120)) for _ in range(20)]
    out = [(i, b) for i, b in enumerate(base)]
    out += [(100 + i, base[0]) for i in range(30)]  # a third of all rows are one text
    near = base[1].split()
    out += [(200 + i, " ".join([*near[: len(near) - 1], f"x{i}"])) for i in range(5)]
    out += [(300, None), (301, ""), (302, "   "), (None, base[2]), (None, None), (303, words(rng, 20_000)), (304, "ab" * 400), (305, "é漢字🙂 The MIT License.\x00"), (306, "a"), (306, "a"), (307, base[3] + " " + base[4])]
    return [(i, t, None if k % 5 == 0 else "en", None if k % 7 == 0 else "web" if k % 3 else "news", k) for k, (i, t) in enumerate(out)]


def documents(spark, data=None):
    df = spark.createDataFrame(rows() if data is None else data, SCHEMA)
    return df.withColumns({c: F.lit("clash") for c in CLASHES})


def texts(data):
    """A frame of (id, text) pairs in the documents' schema."""
    return [(i, t, "en", "web", len(t or "")) for i, t in data]
