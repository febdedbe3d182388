import pytest
from oracle import connect, same

from weftgraph import catalog, oracles

SF = "/root/testdata/sf0.001"


def test_every_query_has_sql():
    assert set(catalog.QUERIES) == set(oracles.ORACLES)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, name):
    same(catalog.QUERIES[name](spark, SF), connect(SF), oracles.ORACLES[name])


def test_entry_and_registry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).columns
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
