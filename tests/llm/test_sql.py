import pytest

from starfold.llm import registry
from tests.oracle import same


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_against_sql(spark, name):
    same(spark, registry.QUERIES[name], registry.ORACLE_SQL[name])
