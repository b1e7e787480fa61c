"""Registered queries against their SQL on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
LLM = ("op", "pipeline")
NAMES = sorted(n for n in entry.oracle_sql() if not n.startswith(LLM))

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return con


def plain(v):
    if v is None or v != v:
        return "null"
    if isinstance(v, bool):
        return str(v)
    return f"{float(v):.9g}" if isinstance(v, (int, float)) else str(v)


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_its_sql(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    want = duck.execute(entry.oracle_sql()[name])
    columns = [c[0] for c in want.description]
    assert sorted(columns) == sorted(df.columns)
    found = sorted(tuple(plain(r[c]) for c in sorted(columns)) for r in df.collect())
    assert found == sorted(tuple(plain(v) for _, v in sorted(zip(columns, r, strict=True))) for r in want.fetchall())


def test_entry_runs(spark):
    assert entry.entry(spark).count() == 1


def test_every_name_with_sql_is_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
