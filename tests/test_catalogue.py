"""Every query with SQL against DuckDB on the smallest tables; names and schemas of the entry."""

import math
import os

import duckdb
import pytest
from tracelens.plans import catalogue

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v)
    if isinstance(v, (list, tuple)):
        return str([plain(x) for x in v])
    return str(v)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in os.listdir(DATA):
        c.sql(f"create view {f.split('.')[0]} as select * from '{DATA}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_query_matches_sql(spark, con, name):
    df = catalogue.queries()[name](spark, DATA)
    cols = sorted(df.columns)
    mine = sorted([plain(r[c]) for c in cols] for r in df.collect())
    cur = con.execute(catalogue.oracle_sql()[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == cols
    at = [names.index(c) for c in cols]
    assert mine == sorted([plain(r[i]) for i in at] for r in cur.fetchall())


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 3 and set(catalogue.queries()) <= set(e.queries())
