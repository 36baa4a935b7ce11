"""Registered queries against SQL, over whole small tables."""

import pytest

from orrery.llm import license_scan
from orrery.llm.queries import ORACLES, QUERIES
from tests.same import assert_same


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, duck, data, name):
    assert_same(QUERIES[name](spark, data), duck, ORACLES[name])


def test_license_base_columns(spark, duck, data):
    out = QUERIES["op1_license_scan"](spark, data)
    assert_same(out.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels"), duck, license_scan.BASE_ORACLE)


def test_every_operator_has_a_query():
    assert {int(n[2:].split("_")[0]) for n in QUERIES} == set(range(1, 11))
