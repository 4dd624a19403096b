"""The queries with SQL against DuckDB on the smallest tables."""

import pytest

from granulon.llm import queries
from tests.test_catalogue import SF, duck, rows  # noqa: F401


@pytest.mark.parametrize("name", list(queries.ORACLE))
def test_query(spark, duck, name):  # noqa: F811
    got = queries.QUERIES[name](spark, SF)
    want = duck.execute(queries.ORACLE[name])
    columns = [c[0] for c in want.description]
    assert sorted(columns) == sorted(got.columns)
    assert rows(got.columns, got.collect()) == rows(columns, want.fetchall())
