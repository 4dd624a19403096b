"""Every query with SQL against DuckDB on the smallest tables; the others must run."""

import glob
import os

import duckdb
import pytest

from granulon.plans import catalogue

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return con


def rows(columns, values):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    show = lambda v: "null" if v is None or v != v else f"{v + 0.0:.10g}" if isinstance(v, float) else str(v)
    return sorted(tuple(show(v[i]) for i in order) for v in values)


@pytest.mark.parametrize("name", list(catalogue.Q))
def test_query(spark, duck, name):
    got = catalogue.queries()[name](spark, SF)
    sql = catalogue.oracle_sql().get(name)
    values = got.collect()
    if sql is None:
        assert len(values) > 0
        return
    want = duck.execute(sql)
    columns = [c[0] for c in want.description]
    assert sorted(columns) == sorted(got.columns)
    assert rows(got.columns, values) == rows(columns, want.fetchall())
