"""Every registered query against its DuckDB SQL on the smallest tables."""

import pytest
from compare import compare, duck

import __spark_entry__ as entry

SMALL = "/root/testdata/sf0.001"
QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck(SMALL)


def test_oracles_belong_to_queries():
    assert set(ORACLES) <= set(QUERIES)


def test_entry(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, name):
    if name in ORACLES:
        assert compare(spark, con, name, QUERIES[name], ORACLES[name], SMALL) == ""
    else:
        assert QUERIES[name](spark, SMALL).count() > 0
