"""Header matching, typed cells, duplicates, batches and intervals against plain Python and goldens."""

import random
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from cartage.functions import fields, parse
from cartage.operators import geo, imports, lifecycle, relational, similarity, stats
from cartage.sources import commits, files
from cartage.streaming import state


def test_headers_are_matched_once_exact_first():
    got = fields.suggest(["Move Date", "From ZIP.", "To Zip", "Crew notes", "Crew", "Total", "Total Hours", "Hours", "Job #", "Street"])
    assert {(f, h) for f, h, _ in got} == {("move_date", "Move Date"), ("origin_zip", "From ZIP."), ("destination_zip", "To Zip"), ("actual_crew_size", "Crew"), ("actual_total_cents", "Total"), ("actual_hours", "Total Hours"), ("external_ref", "Job #"), ("notes", "Crew notes")}
    assert len({h for _, h, _ in got}) == len(got)
    assert not any(f.endswith("_line1") for f, *_ in fields.suggest(["Origin street address", "origin_line1"]))
    assert fields.mapping_problems(["a"], {"move_date": "b"}) == ["no such column: b", "not mapped: Home size", "neither hours nor a final total is mapped"]
    assert fields.remap({"move_date": "a", "notes": "b"}, "home_size", "b") == {"move_date": "a", "home_size": "b"}
    assert [f for g in fields.groups().values() for f in g].count("notes") == 1
    assert sorted(f for g in fields.groups().values() for f in g) == sorted(fields.BY_NAME)
    assert fields.unmapped(["a", "b"], {"notes": "a"}) == ["b"]


def test_date_and_amount_columns(spark):
    for values, want in [(["03/04/2025", "15/04/2025"], "dmy"), (["03/04/2025", "04/15/2025"], "mdy"), (["01/02/2025"] * 3, "ambiguous"), (["01/02/2025"] * 40 + ["25/02/2025"], "dmy"), (["2025-01-02", "3 Mar 2025"], "iso"), ([None, ""], "ambiguous")]:
        rows = spark.createDataFrame(list(enumerate(values)), "i int, v string")
        assert parse.detect_date_order(rows, "v", "i").first()[0] == want
    for values, want in [(["$1,234.56"], "dot"), (["1.234,56"], "comma"), (["1.234"], "ambiguous"), (["1.234", "99.50"], "dot"), (["1200", "980"], "dot"), (["1234.567"], "ambiguous"), (["1.234.567"], "comma")]:
        rows = spark.createDataFrame(list(enumerate(values)), "i int, v string")
        assert parse.detect_decimal_style(rows, "v", "i").first()[0] == want
    rows = spark.createDataFrame([("✔",), ("-",), ("",), ("none",), ("checked",)], "v string")
    assert [r[0] for r in rows.select(parse.parse_bool(F.col("v"))).collect()] == [True, False, None, None, None]
    rows = spark.createDataFrame([("4 march 2025",), ("Mar 4, 2025",), ("marzo 4, 2025",), ("sept 9 2024",), ("31/02/2025",), ("1/2/69",), ("1/2/70",)], "v string")
    assert [str(r[0]) for r in rows.select(parse.parse_date(F.col("v"), "dmy")).collect()] == ["2025-03-04", "2025-03-04", "None", "2024-09-09", "None", "2069-02-01", "1970-02-01"]


def test_a_sheet_is_judged_kept_and_reverted(spark, tmp_path):
    mapping = {"move_date": "Move Date", "home_size": "Size", "actual_hours": "Hours", "actual_total_cents": "Total", "origin_line1": "Street", "origin_zip": "Zip", "mystery": "Size"}
    rows = [(1, "2025-01-02", "2 bedroom", "6:30", "$1,450.00", " 1 Main  St ", "10001"), (2, "2025-01-02", "2br", "6.5h", "1450", "1 main st", "10001"), (3, "2025-01-03", "castle", "x", "", None, "!"), (4, "2999-01-01", "1br", "3", None, None, None), (5, "2025-01-04", "1br", "", "", None, None), (6, "2025-01-05", "1br", "9", "", None, "1!")]
    sheet = spark.createDataFrame(rows, "row_number long, `Move Date` string, Size string, Hours string, Total string, Street string, Zip string")
    got = {r.row_number: r for r in imports.judge(sheet, mapping, "2026-01-01").collect()}
    assert [got[i].status for i in range(1, 7)] == ["warning", "duplicate", "error", "error", "error", "warning"]
    assert got[1].origin_building_key == "1 main st|10001" and got[1].actual_total_cents == 145000
    assert [e.field for e in got[3].errors] == ["home_size", "actual_hours", None]
    assert [w.field for w in got[6].warnings] == ["origin_zip", "mystery"] and got[6].origin_zip is None
    judged = imports.judge(sheet, mapping, "2026-01-01")
    batch, stamp = imports.batch_rows(judged, "c1", "b1", "2026-01-01")
    root = f"file://{tmp_path}/store"
    assert commits.import_batch(spark, root, batch, stamp, "b1")
    kept, batches = commits.read(spark, root, "history"), commits.read(spark, root, "batches")
    assert kept.count() == 2
    assert kept.count() == 2 and batches.first().duplicates == 1
    assert imports.judge(sheet, mapping, "2026-01-01", kept.select("external_ref", "row_hash")).where("status = 'duplicate'").count() == 3
    left, stamped, verdict = imports.revert(kept, batches, "b1", "2026-01-02")
    assert left.count() == 0 and batches.agg(verdict).first()[0] == "reverted" and stamped.agg(verdict).first()[0] == "conflict"
    empty, none = imports.batch_rows(judged.where("status = 'error'"), "c1", "b2", "2026-01-01")
    assert not commits.import_batch(spark, root, empty, none, "b2") and commits.read(spark, root, "batches").count() == 1
    patched = {r.row_number: r for r in imports.patch(batch, spark.createDataFrame([(1, 8.0)], "row_number long, actual_hours double"), "row_number").collect()}
    before = {r.row_number: r for r in batch.collect()}
    assert patched[1].actual_hours == 8.0 and patched[1].row_hash != before[1].row_hash and patched[6].row_hash == before[6].row_hash
    assert sorted((r.header, r["values"]) for r in imports.samples(sheet.select("row_number", "Zip")).collect()) == [("Zip", ["10001", "10001", "!"])]


def test_duplicates_are_the_fold(spark):
    rng = random.Random(2)
    for _ in range(4):
        rows = [(i, rng.choice([None, None, "a", "b", "c"]), rng.choice("xyz") if rng.random() < 0.9 else None, rng.choice([None, "t", "u"])) for i in range(60)]
        refs, prints, want = {(None, "b")}, {("t", "y")}, {}
        for i, ref, p, tenant in rows:
            dup = (tenant, ref) in refs if ref is not None else (tenant, p) in prints
            want[i] = dup
            if not dup:
                if ref is not None:
                    refs.add((tenant, ref))
                if p is not None:
                    prints.add((tenant, p))
        known_refs = spark.createDataFrame([(None, "b")], "tenant string, ref string")
        known_prints = spark.createDataFrame([("t", "y")], "tenant string, p string")
        got = relational.flag_duplicates(spark.createDataFrame(rows, "i int, ref string, p string, tenant string"), "i", "ref", "p", known_refs, "tenant", known_prints)
        assert {r.i: r.duplicate for r in got.collect()} == want


def test_numbers_inside_tenants(spark):
    rng = random.Random(6)
    rows = [(rng.choice("ab"), rng.randrange(5), i, rng.random()) for i in range(80)]
    got = stats.numbered(spark.createDataFrame(rows, "t string, day int, i int, v double"), "t", F.col("day"), "day", "i").collect()
    for tenant in "ab":
        mine = sorted((r.day, r.i, r.rn) for r in got if r.t == tenant)
        assert [x[2] for x in mine] == list(range(1, len(mine) + 1))


def test_distances_guards_and_settings(spark):
    one = spark.range(1).select(
        geo.steady_distance(F.lit("10001"), F.lit("10001")).alias("same"), geo.steady_distance(F.lit("10001"), F.lit("10101-1")).alias("far"), geo.zip_pair(F.lit(" "), F.lit("1")).alias("none"),
        lifecycle.argument_problems(F.array(F.lit("query"), F.lit("token"), F.lit("x")), ["query"], ["query", "k"], ["token"]).alias("bad"),
        lifecycle.merged_settings(F.lit('{"a": "1", "b": "2"}'), F.lit('{"b": "3"}')).alias("m"), lifecycle.setting(F.lit('{"n": "x"}'), "n", 5, "int").alias("n"), lifecycle.accept_label(F.lit(5000)).alias("label"),
        lifecycle.draft_problems(F.lit(" "), F.lit("c"), F.lit("text"), F.lit("k" * 501)).alias("draft"), lifecycle.quote_actions(F.lit("expired")).alias("acts"),
    ).first()
    assert (one.same, one.far, one.none) == (3.0, 5.0 + 100 % 56, None)
    assert (one.bad.forbidden, one.bad.unknown, one.bad.missing) == (["token"], ["x"], ["k"])
    assert (one.m, one.n, one.label, one.draft, one.acts) == ({"a": "1", "b": "3"}, 5, "Accept & pay $50 deposit", ["title", "keywords"], [])


def test_unknown_gaps_stay_unknown(spark):
    null = F.lit(None).cast("double")
    one = spark.range(1).select(similarity.scaled_gap(null, F.lit(1.0), 5.0).alias("a"), similarity.mean_known(similarity.scaled_gap(F.lit(0.0), F.lit(0.0), 5.0), similarity.scaled_gap(null, F.lit(1.0), 5.0)).alias("b"), similarity.compare({"home_size": F.lit(0.0), "stairs": similarity.scaled_gap(null, null, 5.0)})["coverage"].alias("c")).first()
    assert (one.a, one.b, one.c) == (None, 0.0, 0.3)


def test_files_are_read_by_spark(spark, tmp_path):
    import zipfile

    (tmp_path / "a.csv").write_bytes("\ufeffMove Date;Hours;;Note\n2025-01-01;6,5;x; caf\u00e9 \n;;;\n2025-01-02;;;\n".encode())
    got = files.read_table(spark, f"file://{tmp_path}/a.csv").orderBy("row_number")
    assert got.columns == ["row_number", "Move Date", "Hours", "Note"]
    assert [tuple(r)[1:] for r in got.collect()] == [("2025-01-01", "6,5", "caf\u00e9"), ("2025-01-02", None, None)]
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    cells = lambda n, vs: f'<row r="{n}">' + "".join(f'<c r="{c}{n}" t="inlineStr"><is><t>{v}</t></is></c>' for c, v in zip("ABC", vs, strict=False) if v) + "</row>"
    with zipfile.ZipFile(tmp_path / "b.xlsx", "w") as z:
        z.writestr("xl/worksheets/sheet1.xml", f"<worksheet {ns}><sheetData>{cells(1, ['Size', '', 'Hours'])}{cells(2, ['2br', 'x', '7'])}{cells(3, ['', '', ''])}</sheetData></worksheet>")
    assert [tuple(r)[1:] for r in files.read_table(spark, f"file://{tmp_path}/b.xlsx").collect()] == [("2br", "7")]
    for name, data in (("c.csv", b"a,b\n"), ("d.doc", b"x")):
        (tmp_path / name).write_bytes(data)
        with pytest.raises(ValueError):
            files.read_table(spark, f"file://{tmp_path}/{name}")
    with pytest.raises(ValueError):
        files.read_table(spark, f"file://{tmp_path}/a.csv", max_rows=1)


def test_limits_do_not_share_hits(spark):
    rows = spark.createDataFrame([(i, "ip", f"t{i % 2}", float(i)) for i in range(6)], "i long, ip string, token string, t double")
    got = state.limit_all(rows, {"chat": ("ip", 3, 100.0), "token": ("token", 1, 100.0)}, "t", "i").collect()
    assert sorted(r.order_id for r in got if r.allowed and r.name == "chat") == [0, 1, 2]
    assert sorted(r.order_id for r in got if r.allowed and r.name == "token") == [0, 1]
