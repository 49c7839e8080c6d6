import pytest

from litgraph.plans import registry

from .oracle import connect, difference

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_matches_sql(spark, con, name):
    said = difference(spark, con, registry.QUERIES[name], registry.ORACLE_SQL[name], SF)
    assert said is None, said
