"""Every registered query against DuckDB on the test tables."""

import os

import pytest
from compare import connect, difference, duck_rows, spark_rows, type_difference

import __spark_entry__ as entry

DIRECTORY = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")
QUERIES, ORACLES = entry.queries(), entry.oracle_sql()

pytestmark = pytest.mark.skipif(not os.path.isdir(DIRECTORY), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    return connect(DIRECTORY)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, DIRECTORY)
    got = spark_rows(df)
    if name in ORACLES:
        assert type_difference(con, df, ORACLES[name]) is None
        assert difference(got, duck_rows(con, ORACLES[name])) is None
    else:
        assert got[1]


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
