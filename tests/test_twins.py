"""Every registered query against its SQL twin at the smallest scale."""

import os

import pytest

import __spark_entry__ as entry
from twin import compare, duck

SF_DIR = os.environ.get("TWIN_SF_DIR", "/root/testdata/sf0.001")
QUERIES, SQL = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def connection():
    return duck(SF_DIR)


def test_every_twin_belongs_to_a_query():
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, connection, name):
    df = QUERIES[name](spark, SF_DIR)
    if name in SQL:
        assert compare(df, connection, SQL[name]) == []
    else:
        assert df.count() > 0


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns and df.count() > 0
