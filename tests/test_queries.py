"""Every query of the engine's own against its DuckDB SQL on the smallest tables."""

import decimal
import math
from pathlib import Path

import duckdb
import pytest

from cartage.plans import evaluation, imports, knowledge, lifecycle, reports, views  # noqa: F401
from cartage.plans import queries as plans

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.9g}"
    return str(v)


@pytest.mark.parametrize("name", sorted(plans.ORACLE))
def test_query_is_its_sql(spark, duck, name):
    df = plans.QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    found = duck.execute(plans.ORACLE[name])
    at = [[d[0] for d in found.description].index(c) for c in columns]
    assert got == sorted(tuple(plain(r[i]) for i in at) for r in found.fetchall())


def test_fingerprints_and_transcripts_are_whole(spark, duck):
    of = plans.QUERIES["content_fingerprint"](spark, DATA)
    assert sorted(r.doc_id for r in of.collect()) == sorted(x for (x,) in duck.execute("SELECT doc_id FROM documents").fetchall())
    said = {r.text_sha for r in plans.QUERIES["transcript_replay"](spark, DATA).where("role = 'assistant'").collect()}
    assert said == {r.text_sha for r in plans.QUERIES["transcript_replay"](spark, DATA).where("role = 'tool'").collect()}


def test_sliding_limit_is_the_fold(spark):
    rows = spark.read.parquet(f"{DATA}/events.parquet").collect()
    hits, want = {}, {}
    for r in sorted(rows, key=lambda r: (r.ts, r.event_id)):
        at = r.ts.timestamp()
        live = [h for h in hits.get(r.user_id, []) if h > at - 86400.0]
        want[r.event_id] = len(live) < 3  # refused hits are not remembered
        hits[r.user_id] = [*live, at] if want[r.event_id] else live
    got = {r.order_id: r.allowed for r in plans.QUERIES["sliding_limit"](spark, DATA).collect()}
    assert got == want


def test_entry_point_works_without_the_corpus_operators():
    import subprocess
    import sys

    code = "import sys; sys.modules['cartage.llm'] = None; import __spark_entry__ as e; assert 'price_kernel' in e.queries() and not any(k.startswith('op') for k in e.queries()); print(len(e.oracle_sql()))"
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=120, cwd=Path(__file__).resolve().parents[1])
    assert out.returncode == 0, out.stderr
