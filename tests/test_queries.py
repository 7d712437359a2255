"""Every query with SQL equals DuckDB on the small tables; the others run and have a stable schema."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry_point

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for f in os.listdir(SF):
        c.execute(f"create view {f.split('.')[0]} as select * from '{SF}/{f}'")
    return c


def canon(rows):
    def one(x):
        if x is None or (isinstance(x, float) and math.isnan(x)):
            return "null"
        return f"{x:.4f}" if isinstance(x, float) else str(x)

    return sorted(tuple(map(one, r)) for r in rows)


@pytest.mark.parametrize("name", sorted(entry_point.oracle_sql()))
def test_against_sql(spark, con, name):
    df = entry_point.queries()[name](spark, SF)
    cols = sorted(df.columns)
    got = canon([r[c] for c in cols] for r in df.collect())
    cur = con.execute(entry_point.oracle_sql()[name])
    heads = [d[0] for d in cur.description]
    assert sorted(heads) == cols
    want = canon([r[heads.index(c)] for c in cols] for r in cur.fetchall())
    assert got == want


def test_entry(spark):
    assert entry_point.entry(spark).count() > 0


def test_registered():
    names = set(entry_point.queries())
    assert set(entry_point.oracle_sql()) <= names and {"p2_found", "p3_found", "p6_found"} <= names
