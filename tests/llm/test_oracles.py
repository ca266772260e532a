import pytest

from tessera.llm import queries
from tests.oracle import differences


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_its_oracle(spark, sf, name):
    rows, ours, theirs = differences(spark, sf, queries.QUERIES[name], queries.ORACLES[name])
    assert rows and ours == theirs == []
