"""Every registered query at the smallest scale; those with SQL are compared with DuckDB value by value."""

import math
import os
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import __spark_entry__ as entry_module  # noqa: E402

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUERIES, ORACLES = entry_module.queries(), entry_module.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    yield con
    con.close()


def plain(v):
    if v is None:
        return "null"
    if isinstance(v, bool) or not isinstance(v, (int, float)) and type(v).__name__ != "Decimal":
        return str(v)
    v = float(v)
    return "nan" if math.isnan(v) else repr(v + 0.0)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    rows = sorted(tuple(plain(r[c]) for c in cols) for r in df.collect())
    if name not in ORACLES:
        assert rows or name == "ar1_law"
        return
    cur = duck.execute(ORACLES[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == cols
    want = sorted(tuple(plain(r[names.index(c)]) for c in cols) for r in cur.fetchall())
    assert rows == want


def test_entry(spark):
    df = entry_module.entry(spark)
    assert [r["name"] for r in df.orderBy("rank").collect()][:2] == ["x[x1]", "bilinear[x1*x2]"]


def test_oracles_belong_to_queries():
    assert set(ORACLES) <= set(QUERIES)
