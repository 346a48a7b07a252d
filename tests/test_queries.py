"""Every registered query of the core against DuckDB, and the driver's entry."""

import pytest

import __spark_entry__
from axisloom import queries as core
from tests.oracle import assert_same, connect

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(core.QUERIES))
def test_query(spark, con, name):
    df = core.QUERIES[name](spark, SF)
    if name in core.ORACLE:
        assert_same(df, con, core.ORACLE[name])
    else:  # test_algorithms.py says what they must give
        assert df.count() > 0


def test_entry(spark):
    df = __spark_entry__.entry(spark)
    assert df.count() > 0


def test_registered():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert set(core.QUERIES) <= set(__spark_entry__.queries())
