"""Every registered query against its SQL, on the smallest tables."""

import pytest

import __spark_entry__ as entry
from tests.oracle import compare, connect

NAMES = sorted(entry.queries())


@pytest.fixture(scope="module")
def duck(sf):
    return connect(sf)


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(NAMES)


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, sf, duck, name):
    rows, status, _ = compare(spark, duck, sf, entry.queries()[name], entry.oracle_sql().get(name))
    assert status in ("ok", "rows-only"), status


def test_entry(spark):
    assert entry.entry(spark).count() > 0
