import pytest

from helixframe import plans
from tests.oracle import same


@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_matches_sql(spark, name):
    assert same(spark, name, plans.QUERIES[name], plans.ORACLES[name]) > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 10
    assert set(plans.QUERIES) <= set(e.queries())
