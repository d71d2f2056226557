"""Every query with SQL against DuckDB, in the smallest tables, and partition invariance of a kernel query."""

import os

import duckdb
import pytest

from swayflow.plans import queries as Q

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="the driver's tables are not here")


def plain(v):
    if v is None or v != v:
        return None
    return round(float(v), 3) if isinstance(v, float) or type(v).__name__ == "Decimal" else v


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(Q.ORACLES))
def test_query_equals_sql(spark, con, name):
    got = Q.QUERIES[name](spark, DATA)
    cols = sorted(got.columns)
    want = con.execute(f"select {', '.join(chr(34) + c + chr(34) for c in cols)} from ({Q.ORACLES[name]})").fetchall()
    mine = [tuple(plain(v) for v in r) for r in got.select(cols).collect()]
    assert sorted(map(repr, mine)) == sorted(repr(tuple(plain(v) for v in r)) for r in want)


@pytest.mark.parametrize("name", sorted(set(Q.QUERIES) - set(Q.ORACLES)))
def test_query_without_sql_gives_rows(spark, name):
    assert Q.QUERIES[name](spark, DATA).count() > 0
