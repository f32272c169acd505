import pytest
from conftest import SMALL
from oracle import compare

from tessera.plans import catalog, code_model, files, safety, source_text  # noqa: F401


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_matches_its_sql(spark, name):
    if name in catalog.ORACLE_SQL:
        compare(spark, SMALL, catalog.QUERIES[name], catalog.ORACLE_SQL[name])
    else:
        assert catalog.QUERIES[name](spark, SMALL).count() > 0
