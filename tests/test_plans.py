"""Every registered query of the model's operators against its SQL."""

import pytest

from orrery.plans import ORACLES, QUERIES
from tests.same import assert_same


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, duck, data, name):
    assert_same(QUERIES[name](spark, data), duck, ORACLES[name])


def test_entry(spark):
    import __spark_entry__

    out = __spark_entry__.entry(spark)
    assert out.columns == ["type", "cnt"] and out.count() > 1
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_queries_without_sql():
    assert set(QUERIES) - set(ORACLES) == {"vector_search_approx"}  # see test_approximate.py
