"""Every registered query against its reference SQL on the smallest data folder."""

import os

import pytest

from staylens.catalog import load
from tools.check import compare, connect

FOLDER = "/root/testdata/sf0.001"
QUERIES, SQL = load()
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test data")


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    ok, note = compare(spark, con, FOLDER, name, QUERIES[name], SQL.get(name))
    assert ok, note


def test_names_match():
    assert set(SQL) <= set(QUERIES)
    import __spark_entry__ as entry

    # The entry module may add queries of optional folders.
    assert set(entry.queries()) >= set(QUERIES)
    assert set(entry.oracle_sql()) >= set(SQL)
    assert set(entry.oracle_sql()) <= set(entry.queries())
