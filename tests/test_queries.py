"""Every registered query against its checking SQL, on the smallest test tables."""

import pytest

import __spark_entry__ as entry
from compare import compare, duck
from suite.queries import ORACLES, QUERIES

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(SF_DIR)


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_every_query_has_sql():
    assert QUERIES.keys() == ORACLES.keys()
    assert QUERIES.keys() <= entry.queries().keys()


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, name):
    rows, problem, _, _ = compare(spark, con, SF_DIR, name)
    assert problem is None
    assert rows > 0
