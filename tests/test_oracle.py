"""Every registered query against its checking SQL on the smallest tables."""

import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

import compare  # noqa: E402

import __spark_entry__ as contract  # noqa: E402

SF_DIR = "/root/testdata/sf0.001"
PLANS, CHECKS = contract.queries(), contract.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return compare.connect(SF_DIR)


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="test tables are not here")
@pytest.mark.parametrize("name", list(PLANS))
def test_query(spark, con, name):
    ok, message = compare.compare(spark, con, SF_DIR, name, PLANS[name], CHECKS.get(name))
    assert ok, message


def test_checks_belong_to_queries():
    assert set(CHECKS) <= set(PLANS)


def test_entry_has_rows(spark):
    assert contract.entry(spark).limit(1).count() == 1
