"""Every registered query with SQL against that SQL, on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry_point
from check import TABLES, rows_of

ORACLES = entry_point.oracle_sql()


@pytest.fixture(scope="module")
def engine(sf):
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"create view {table} as select * from '{sf}/{table}.parquet'")
    return connection


@pytest.mark.parametrize("name", list(entry_point.queries()))
def test_query(spark, sf, engine, name):
    result = entry_point.queries()[name](spark, sf)
    mine = rows_of(result.columns, [tuple(r) for r in result.collect()])
    if name not in ORACLES:
        assert mine
        return
    cursor = engine.execute(ORACLES[name])
    columns = [d[0] for d in cursor.description]
    assert sorted(columns) == sorted(result.columns)
    assert mine == rows_of(columns, cursor.fetchall())


def test_entry(spark):
    assert entry_point.entry(spark).count() == 5
