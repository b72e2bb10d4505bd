"""Every registered query with SQL text must equal DuckDB on the smallest tables."""

import pytest

from check import compare, connect
from kifulake.plans.catalog import QUERIES

FAST = [n for n, q in QUERIES.items() if q.sql]


@pytest.fixture(scope="session")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", FAST)
def test_query_matches_sql(spark, con, sf, name):
    ok, message, _ = compare(spark, con, sf, QUERIES[name])
    assert ok, message


@pytest.mark.parametrize("name", [n for n, q in QUERIES.items() if not q.sql])
def test_rows_only_query_runs(spark, sf, name):
    assert QUERIES[name].run(spark, sf).count() > 0
