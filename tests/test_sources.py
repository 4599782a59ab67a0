"""Sheets read by Spark: whole-file encoding, true row numbers, the sheet source; chains of links; ranges set in part."""

import random
import zipfile

import pytest
from pyspark.sql import functions as F

from cartage.operators import lifecycle, relational
from cartage.sources import files, sheets


def test_a_late_latin_byte_decides_the_encoding(spark, tmp_path):
    lines = ["Move Date;City"] + [f"2025-01-{i % 28 + 1:02d};Town {i}" for i in range(80)] + ["2025-02-01;München"]
    (tmp_path / "latin.csv").write_bytes("\n".join(lines).encode("latin-1"))
    (tmp_path / "utf.csv").write_bytes("\n".join([*lines, "2025-02-02;a � sign"]).encode())
    got = files.read_table(spark, f"file://{tmp_path}/latin.csv").orderBy("row_number").collect()
    assert got[80]["City"] == "München" and [r.row_number for r in got] == list(range(1, 82))
    assert files.read_table(spark, f"file://{tmp_path}/utf.csv").orderBy("row_number").collect()[81]["City"] == "a � sign"


def test_rows_are_numbered_in_file_order_over_all_blocks(spark, tmp_path):
    text = "n,word\n" + "".join(f"{i},{'x' * (i % 50)}\n" + (",\n" if i % 9 == 0 else "") for i in range(1, 4001))
    (tmp_path / "long.csv").write_text(text)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "9000")
    try:
        rows = files.read_table(spark, f"file://{tmp_path}/long.csv")
        assert spark.read.text(f"file://{tmp_path}/long.csv").rdd.getNumPartitions() > 1
        assert all(int(r.n) == r.row_number for r in rows.collect()) and rows.count() == 4000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_sheet_source(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("Date;City\n" .encode() + b"".join(f"d{i};T\n".encode() for i in range(80)) + "e;Köln\n".encode("latin-1"))
    (tmp_path / "b.csv").write_text("Size,Hours\n,\n2br,7\n")
    (tmp_path / "c.csv").write_text("only,headers\n")
    with zipfile.ZipFile(tmp_path / "d.xlsx", "w") as z:
        z.writestr("nothing", "x")
    sheets.register(spark)
    df = spark.read.format("sheet").load(f"file://{tmp_path}")
    assert df.rdd.getNumPartitions() == 4
    rows = df.collect()
    by = {}
    for r in rows:
        by.setdefault(r.file[-5:], []).append(r)
    assert [r.row_number for r in by["a.csv"]] == list(range(1, 82)) and by["a.csv"][-1].cells == {"Date": "e", "City": "Köln"}
    assert [(r.row_number, r.cells) for r in by["b.csv"]] == [(1, {"Size": "2br", "Hours": "7"})]
    assert by["c.csv"][0].error and by[".xlsx"][0].error and by["c.csv"][0].cells is None
    empty = tmp_path / "none"
    empty.mkdir()
    assert spark.read.format("sheet").load(str(empty)).count() == 0
    with pytest.raises(Exception, match="path"):
        spark.read.format("sheet").load().count()


@pytest.mark.parametrize("hops", [1, 7, 50])
def test_chains_stay_at_the_last_row_that_is_there(spark, hops):
    rng = random.Random(hops)
    links = {1: 99, 2: 1, 3: None, 4: 4} | {i: i + 1 for i in range(100, 170)} | {170: None} | {200: 201, 201: 202, 202: 203, 203: 201}
    links |= {i: i + 1 for i in range(300, 359)} | {359: 310}
    links |= {1000 + i: 1000 + rng.randrange(80) for i in range(60)}  # some point to rows that are not there

    def resolve(key):
        seen, at, n = set(), key, 0
        while n < hops and links[at] is not None and at not in seen and links[at] in links:
            seen.add(at)
            at, n = links[at], n + 1
        return key, at, n

    got = {tuple(r) for r in relational.chain_heads(spark.createDataFrame(list(links.items()), "k int, nxt int"), "k", "nxt", hops).collect()}
    assert got == {resolve(k) for k in links}
    ends = spark.createDataFrame([(1, 99), (2, 1)], "k int, nxt int")
    assert {tuple(r) for r in relational.chain_heads(ends, "k", "nxt").collect()} == {(1, 1, 0), (2, 1, 1)}


def test_a_bound_that_is_not_given_is_the_quotes_own(spark):
    rows = [("both", 10, 20), ("low", 150, None), ("low over high", 250, None), ("high", None, 170), ("negative high", None, -5), ("high under low", None, 50), ("none", None, None)]
    df = spark.createDataFrame(rows, "name string, low long, high long")
    now = F.lit("2026-01-01").cast("timestamp")
    step = lifecycle.quote_step(F.lit("draft"), F.lit("approve"), now, now, F.col("low"), F.col("high"), F.lit(100).cast("long"), F.lit(200).cast("long"))
    got = {r.name: tuple(r.s) for r in df.select("name", step.alias("s")).collect()}
    assert got["both"][4:] == (10, 20, True) and got["low"][4:] == (150, 200, True) and got["high"][4:] == (100, 170, True)
    for bad in ("low over high", "negative high", "high under low"):
        assert got[bad][:2] == ("draft", "invalid range") and got[bad][4:] == (100, 200, False)
    assert got["none"][:2] == ("sent", None) and got["none"][4:] == (100, 200, False)
