import pytest

from linkwright.llm.queries import ORACLE_SQL, QUERIES
from tests.oracle import assert_same, connect


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_its_sql(spark, sf, name):
    assert_same(QUERIES[name](spark, sf), connect(sf), ORACLE_SQL[name])
