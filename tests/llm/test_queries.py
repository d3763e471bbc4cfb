import pytest

from rootspan.llm import queries
from tests.oracle import compare

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_against_sql(spark, name):
    assert compare(spark, name, queries.QUERIES[name], queries.ORACLES[name], SF) > 0
