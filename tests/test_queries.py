"""Every registered query: rows against DuckDB where there is SQL, else that it runs and has rows."""

import pytest

import __spark_entry__ as entry
from tests.oracle import compared, connection
from vibrata.plans.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def duck():
    return connection(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    table = QUERIES[name](spark, SF)
    if name in ORACLE_SQL:
        rows, wrong = compared(table, duck, ORACLE_SQL[name])
        assert not wrong
    else:
        rows = table.count()
    assert rows > 0
    spark.catalog.clearCache()


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
