import pytest

from tessera.plans import lens_queries
from tests.oracle import differences


@pytest.mark.parametrize("name", sorted(lens_queries.ORACLES))
def test_query_equals_its_oracle(spark, sf, name):
    _, ours, theirs = differences(spark, sf, lens_queries.QUERIES[name], lens_queries.ORACLES[name])
    assert ours == theirs == []


def test_every_query_has_an_oracle():
    assert set(lens_queries.QUERIES) == set(lens_queries.ORACLES)
