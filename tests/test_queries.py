import pytest

from rootspan.plans import catalog
from tests.oracle import compare

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_against_sql(spark, name):
    compare(spark, name, catalog.queries()[name], catalog.oracle_sql()[name], SF)


def test_every_query_has_sql():
    assert set(catalog.queries()) == set(catalog.oracle_sql())
