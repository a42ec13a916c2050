"""Every registered query beside its SQL on the smallest tables."""

import pytest

import __spark_entry__ as entry
from tests.oracle import CHECKED_ELSEWHERE, compare, duck

FOLDER = "/root/testdata/sf0.001"
QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def connection():
    return duck(FOLDER)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, connection, name):
    message, ok = compare(spark, connection, FOLDER, name, QUERIES[name], ORACLES.get(name))
    assert ok, message


def test_every_query_is_compared_or_listed():
    assert set(QUERIES) - set(ORACLES) <= CHECKED_ELSEWHERE


def test_entry(spark):
    assert entry.entry(spark).count() > 0
