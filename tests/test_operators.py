"""Small goldens of the engine's own functions and operators."""

import datetime
import io
import zipfile

import pytest
from pyspark.sql import functions as F

from cartage.functions import parse, text
from cartage.operators import pricing, relational, retrieval, similarity, stats
from cartage.sources import files
from cartage.streaming import state


def one_of(df, name):
    return df.first()[name]


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("values", "order"),
    [(["03/04/2025", "15/04/2025"], "dmy"), (["03/04/2025", "04/15/2025"], "mdy"), (["03/04/2025", "01/02/2025", "12/12/2025"], "ambiguous"), (["01/02/2025"] * 400 + ["25/02/2025"], "dmy"), (["2025-01-02"], "iso")],
)
def test_date_order(spark, values, order):
    rows = spark.createDataFrame(list(enumerate(values)), "i int, v string")
    assert parse.detect_date_order(rows, "v", "i").first()["date_order"] == order


@pytest.mark.parametrize(("values", "style"), [(["1.234"], "ambiguous"), (["1.234", "99.50"], "dot"), (["1200", "980"], "dot"), (["1.234,56"], "comma")])
def test_decimal_style(spark, values, style):
    rows = spark.createDataFrame(list(enumerate(values)), "i int, v string")
    assert parse.detect_decimal_style(rows, "v", "i").first()["decimal_style"] == style


@pytest.mark.parametrize(("written", "style", "cents"), [("$1,234.56", "dot", 123456), ("1.234,56", "comma", 123456), ("-5", "dot", None), ("x", "dot", None), (None, "dot", None)])
def test_money(spark, written, style, cents):
    assert one(spark, parse.parse_money_cents(F.lit(written).cast("string"), style)) == cents


@pytest.mark.parametrize(("written", "order", "day"), [("2025-2-3", "dmy", "2025-02-03"), ("03/04/25", "dmy", "2025-04-03"), ("03/04/25", "mdy", "2025-03-04"), ("Mar 5, 2024", "dmy", "2024-03-05"), ("5 march 1971", "dmy", "1971-03-05"), ("5 march 71", "dmy", None), ("31/02/2025", "dmy", None), ("", "dmy", None)])
def test_dates(spark, written, order, day):
    assert one(spark, parse.parse_date(F.lit(written), order)) == (datetime.date.fromisoformat(day) if day else None)


def test_small_parsers(spark):
    assert one(spark, parse.parse_bool(F.lit(" Yes "))) is True
    assert one(spark, parse.parse_bool(F.lit("maybe"))) is None
    assert one(spark, parse.parse_hours(F.lit("6:30"))) == 6.5
    assert one(spark, parse.parse_hours(F.lit("7.25 hrs"))) == 7.25
    assert one(spark, parse.parse_list(F.lit("a; b,,c"))) == ["a", "b", "c"]
    assert one(spark, parse.normalize_zip(F.lit(" ab 1 "))) == "AB1"
    assert one(spark, parse.normalize_header(F.lit("Move  Date (UTC)"))) == "move date utc"



@pytest.mark.parametrize(
    ("size", "packing", "items", "origin", "destination", "miles", "day", "want"),
    [
        ("2br", "partial", ["piano"], (3, 2, False), (1, 0, False), 10, "2026-10-13", {"estimated_hours": 10.0, "crew_size": 3, "subtotal_cents": 197000, "total_cents": 197000, "amount_min_cents": 173400, "amount_max_cents": 220600}),
        ("studio", "none", [], (1, 0, False), (1, 0, False), 3, "2026-05-30", {"estimated_hours": 3.0, "crew_size": 2, "subtotal_cents": 47600, "total_cents": 60476, "amount_min_cents": 53200, "amount_max_cents": 67700}),
        ("4br", "full", [], (5, 0, True), (8, 0, True), 25, "2026-10-13", {"estimated_hours": 14.5, "crew_size": 4, "total_cents": 358000}),
    ],
)
def test_price_goldens(spark, size, packing, items, origin, destination, miles, day, want):
    side = lambda s: dict(zip(("floor", "flights", "elevator"), map(F.lit, s), strict=True))
    got = one_of(pricing.priced(spark.range(1), "p", F.lit(size), F.lit(packing), F.array(*map(F.lit, items)).cast("array<string>"), side(origin), side(destination), F.lit(float(miles)), F.lit(day).cast("date")), "p")
    assert {k: got[k] for k in want} == want
    assert sum(x["amount_cents"] for x in got["line_items"]) == got["total_cents"]


def test_price_of_unknown_size_is_null(spark):
    side = {"floor": F.lit(1), "flights": F.lit(0), "elevator": F.lit(False)}
    assert one_of(pricing.priced(spark.range(1), "p", F.lit("castle"), F.lit("none"), F.lit(None), side, side, F.lit(3.0), F.lit("2026-05-30").cast("date")), "p") is None
    assert pricing.PricingConfig(crew={"studio": 9}).problems()


def test_deposits(spark):
    for kind, value, least, want in [("none", 5, 9000, 0), ("fixed", 5000, 9000, 5000), ("percent", 10, 9000, 900), ("fixed", 50, 9000, 0), ("fixed", 99999, 9000, 9000)]:
        assert one(spark, pricing.deposit_cents(F.lit(kind), F.lit(value), F.lit(least))) == want


def test_limiter_goldens(spark):
    for limit, window, times, want in [(3, 60.0, [0, 1, 2, 3], "TTTF"), (2, 10.0, [0, 5, 9, 11], "TTFT"), (2, 10.0, [0, 1, 2, 3, 4, 10.5, 11.5], "TTFFFTT")]:
        rows = spark.createDataFrame([(i, "a", float(t)) for i, t in enumerate(times)], "i long, k string, t double")
        got = "".join("T" if r.allowed else "F" for r in state.limit_batch(rows, "k", "t", "i", limit, window).orderBy("order_id").collect())
        assert got == want


def test_limiter_on_a_stream(spark, tmp_path):
    spark.createDataFrame([(i, "a" if i % 2 else "b", 1000.0 + i) for i in range(10)], "order_id long, key string, t double").coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("order_id long, key string, t double").parquet(f"{tmp_path}/in")
    q = state.limit_stream(stream, 3, 60.0).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {r.order_id for r in spark.read.parquet(f"{tmp_path}/out").where("allowed").collect()}
    assert got == {0, 1, 2, 3, 4, 5}


def test_payment_states(spark):
    for kinds, want in [([], "pending"), (["failed", "succeeded"], "succeeded"), (["succeeded", "failed"], "succeeded"), (["expired", "failed"], "cancelled"), (["ignored"], "pending")]:
        assert one(spark, state.payment_state(F.array(*map(F.lit, kinds)).cast("array<string>"))) == want


def test_fusion_goldens(spark):
    lex = spark.createDataFrame([("q", "a", 1), ("q", "b", 3)], "query_id string, chunk_id string, lexical_rank int")
    vec = spark.createDataFrame([("q", "b", 3, 0.4), ("q", "c", 1, 0.11)], "query_id string, chunk_id string, vector_rank int, similarity double")
    got = retrieval.gate(retrieval.fuse(lex, vec)).orderBy("position").collect()
    assert [r.chunk_id for r in got] == ["b", "a"]  # 3 and 3 beat 1; similarity 0.11 alone is under the floor
    assert got[1].score == pytest.approx(1 / 61)


def test_adjacent_chunks_collapse(spark):
    c = spark.createDataFrame([("q", "x", "d", 4, "h4", 1), ("q", "y", "d", 5, "h5", 2), ("q", "z", "d", 7, "h7", 3), ("q", "w", "e", 1, "h4", 4)], "query_id string, chunk_id string, document_id string, chunk_index int, content_hash string, o int")
    assert [r.chunk_id for r in retrieval.without_neighbours(c, F.col("o")).orderBy("pos").collect()] == ["x", "z"]


def test_agreement_classes(spark):
    for a, b, want in [(["1"], ["1"], "identical"), (["1", "2"], ["2", "1"], "same_set"), (["1", "2"], ["2", "3"], "overlap"), (["1"], ["2"], "disjoint"), ([], [], "both_empty"), (["1"], [], "left_only"), ([], ["1"], "right_only")]:
        arr = lambda x: F.array(*map(F.lit, x)).cast("array<string>")
        assert one(spark, retrieval.agreement(arr(a), arr(b))) == want


def test_similarity_drops_unknown_features(spark):
    got = one(spark, similarity.compare({"home_size": F.lit(0.0), "distance_miles": F.lit(1.0), "stairs": F.lit(None).cast("double")}))
    assert (got.score, got.coverage, got.matched) == (0.6, 0.5, ["home_size"])


def test_versions_overrides_and_batches(spark):
    old = spark.createDataFrame([(1, 1, True, "a"), (2, 1, True, "b")], "company_id int, version int, is_active boolean, body string")
    got = {(r.company_id, r.version, r.is_active) for r in relational.new_version(old, spark.createDataFrame([(1, "c"), (3, "d")], "company_id int, body string")).collect()}
    assert got == {(1, 1, False), (1, 2, True), (2, 1, True), (3, 1, True)}
    cur = spark.createDataFrame([(1, "d1", 3), (1, "d2", 4)], "company_id int, day string, cap int")
    new = spark.createDataFrame([(1, "d1", None), (1, "d3", 5)], "company_id int, day string, cap int")
    assert {tuple(r) for r in relational.merge_overrides(cur, new, ["company_id", "day"]).collect()} == {(1, "d2", 4), (1, "d3", 5)}
    rows = spark.createDataFrame([("import", "b1"), ("import", None), ("platform", "b1")], "source string, import_batch_id string")
    assert relational.revert_batch(rows, "b1").count() == 2


def test_shrinkage_and_folds(spark):
    rows = spark.createDataFrame([("a", 1.0)] * 10 + [("b", 3.0)] * 30, "s string, v double")
    got = {r.s: r.shrunk for r in stats.shrunk_medians(rows, "s", "v").collect()}
    assert got == {"a": 2.0, "b": 3.0}
    assert stats.rolling_folds(None, [], 60) == [(0, 30, 40), (1, 40, 50), (2, 50, 60)]


def test_sheets_and_documents(spark, tmp_path):
    heads, rows = files.read_sheet("a.csv", "﻿Move Date;Hours;\n2025-01-01;6,5;x\n;;\n".encode())
    assert heads == ["Move Date", "Hours"] and rows == [{"Move Date": "2025-01-01", "Hours": "6,5"}]
    with pytest.raises(ValueError):
        files.read_sheet("a.csv", b"a,b\n")
    with pytest.raises(ValueError):
        files.file_kind("a.pdf", b"nothing")
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        z.writestr("word/document.xml", '<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body><w:p><w:pPr><w:pStyle w:val="Heading1"/></w:pPr><w:r><w:t>Policy</w:t></w:r></w:p><w:p><w:r><w:t>' + "Word " * 30 + "</w:t></w:r></w:p></w:body></w:document>")
    (tmp_path / "a.docx").write_bytes(data.getvalue())
    (tmp_path / "b.txt").write_text("short")
    (tmp_path / "c.txt").write_text("long enough " * 20)
    got = {r.path.rpartition("/")[2]: r for r in files.read_documents(spark, str(tmp_path)).collect()}
    assert got["a.docx"].text.startswith("# Policy") and got["b.txt"].error == "too little text" and got["c.txt"].error is None


def test_token_estimates(spark):
    assert one(spark, text.estimate_tokens(F.lit("abc"))) == 1


def test_long_chains_and_cycles_stop_where_the_reference_does(spark):
    links = {i: i + 1 if i < 60 else None for i in range(61)} | {100: 101, 101: 102, 102: 103, 103: 101} | {200: 200}
    links |= {i: i + 1 if i < 359 else 310 for i in range(300, 360)}

    def resolve(key):
        seen, at, hops = set(), key, 0
        while hops < 50 and links[at] is not None and at not in seen:
            seen.add(at)
            at, hops = links[at], hops + 1
        return key, at, hops

    got = {tuple(r) for r in relational.chain_heads(spark.createDataFrame(list(links.items()), "k int, nxt int"), "k", "nxt").collect()}
    assert got == {resolve(k) for k in links} and (0, 50, 50) in got and (100, 101, 4) in got and (200, 200, 1) in got
