"""Every query of this package with SQL gives the rows that DuckDB gives."""

import pytest

from strandflow.llm import queries
from tests.oracle import DATA, assert_same, connect


@pytest.fixture(scope="module")
def con():
    return connect()


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_matches_sql(spark, con, name):
    assert_same(queries.QUERIES[name](spark, DATA), con, queries.SQL[name])
