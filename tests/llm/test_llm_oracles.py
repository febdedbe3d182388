import pytest
from oracle import connect, same

from weftgraph.llm import registry

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query(spark, name):
    same(registry.QUERIES[name](spark, SF), connect(SF), registry.ORACLES[name])


def test_all_ten_are_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in registry.QUERIES) == list(range(1, 11))
