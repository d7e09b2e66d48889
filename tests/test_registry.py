"""Every registered query against its SQL twin in DuckDB."""

import decimal

import duckdb
import pytest

from __spark_entry__ import entry, oracle_sql, queries
from checks import load
from conftest import SMALLEST, TABLES

# the text operators have tests of their own
QUERIES = {name: run for name, run in queries().items() if name in load()}
SQL = {name: sql for name, sql in oracle_sql().items() if name in load()}


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SMALLEST}/{name}.parquet'")
    return connection


def plain(value):
    return str(value) if isinstance(value, decimal.Decimal) else repr(value) if isinstance(value, float) else value


def ordered(records):
    return sorted((tuple(map(plain, r)) for r in records), key=lambda r: [(v is None, str(v)) for v in r])


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_its_sql(spark, duck, name):
    df = QUERIES[name](spark, SMALLEST)
    columns = sorted(df.columns)
    got = ordered(tuple(r[c] for c in columns) for r in df.collect())
    twin = duck.execute(SQL[name])
    names = [d[0] for d in twin.description]
    assert sorted(names) == columns
    want = ordered(tuple(r[names.index(c)] for c in columns) for r in twin.fetchall())
    assert got == want
    assert got


def test_entry_has_rows(spark):
    assert entry(spark).count() > 0


def test_every_query_has_a_twin():
    assert set(SQL) == set(QUERIES)
