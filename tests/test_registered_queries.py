"""Every registered query against its SQL on the smallest data set."""

import os

import pytest

from __spark_entry__ import oracle_sql, queries
from tools.check_queries import compare, duck

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
ORACLES = oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck(SF_DIR)


@pytest.mark.parametrize("name", list(queries()))
def test_query(spark, con, name):
    text, ok = compare(spark, con, SF_DIR, name, queries()[name], ORACLES.get(name))
    assert ok, text


def test_every_check_has_a_query():
    assert set(ORACLES) <= set(queries())
