"""Every query with SQL gives the rows that DuckDB gives for it; every other one runs."""

import collections
import os

import duckdb
import pytest

from deponent.plans import queries as core


def _plain(v):
    if isinstance(v, float):
        return round(v, 6)
    return float(v) if hasattr(v, "as_tuple") else v


@pytest.fixture(scope="module")
def duck():
    sf = os.environ.get("TEST_SF", "/root/testdata/sf0.001")
    con = duckdb.connect()
    for f in os.listdir(sf):
        con.execute(f"create view {f.split('.')[0]} as select * from '{sf}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(core.queries()))
def test_query(spark, sf, duck, name):
    df = core.queries()[name](spark, sf)
    columns = sorted(df.columns)
    ours = collections.Counter(tuple(_plain(r[c]) for c in columns) for r in df.collect())
    sql = core.oracle_sql().get(name)
    if sql is None:
        return
    result = duck.execute(sql)
    names = [x[0] for x in result.description]
    assert sorted(names) == columns
    theirs = collections.Counter(tuple(_plain(row[names.index(c)]) for c in columns) for row in result.fetchall())
    assert ours == theirs
