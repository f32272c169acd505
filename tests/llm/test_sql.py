import pytest
from oracle import compare

from tessera.llm import queries


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_matches_its_sql(spark, name):
    compare(spark, "/root/testdata/sf0.01", queries.QUERIES[name], queries.ORACLE_SQL[name])
