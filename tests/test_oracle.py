import pytest
from conftest import SMALL
from oracle import compare

from sievestone.plans import registry


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_equals_sql(spark, name):
    assert compare(spark, registry.QUERIES[name], registry.ORACLE_SQL[name], SMALL) == ""


def test_every_oracle_has_a_query():
    assert set(registry.ORACLE_SQL) <= set(registry.QUERIES)
