"""Every core query with SQL gives the rows that DuckDB gives."""

import pytest

from strandflow.plans import registry
from tests.oracle import DATA, assert_same, connect


@pytest.fixture(scope="module")
def con():
    return connect()


@pytest.mark.parametrize("name", sorted(registry.sql()))
def test_query_matches_sql(spark, con, name):
    assert_same(registry.queries()[name](spark, DATA), con, registry.sql()[name])
