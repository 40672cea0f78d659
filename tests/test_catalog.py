"""Every registered query against its SQL on the smallest tables."""

import pytest

import __spark_entry__ as entry
from compare import connect, difference

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


def test_names():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() == 1


@pytest.mark.parametrize("name", list(entry.queries()))
def test_query(spark, con, name):
    problem = difference(spark, con, name, entry.queries()[name], entry.oracle_sql().get(name), FOLDER)
    assert problem is None, problem
