import pytest

from linkwright.catalog import ORACLE_SQL, QUERIES

from .oracle import assert_same, connect


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_its_sql(spark, sf, con, name):
    assert_same(QUERIES[name](spark, sf), con, ORACLE_SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_query_without_sql_runs(spark, sf, name):
    df = QUERIES[name](spark, sf)
    assert df.columns and df.collect() is not None
