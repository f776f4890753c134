"""Every registered query against its SQL in DuckDB."""

import duckdb
import pytest

import __spark_entry__ as entry
from tidelog.workload import registry

SF = "/root/testdata/sf0.001"
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()
QUERIES, SQL = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


def rows_of(columns, rows):
    order = sorted(columns)
    at = [list(columns).index(c) for c in order]
    return order, sorted(tuple(str(row[i]) for i in at) for row in rows)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query(spark, duck, name):
    found = QUERIES[name](spark, SF)
    expected = duck.sql(SQL[name])
    assert rows_of(found.columns, found.collect()) == rows_of(expected.columns, expected.fetchall())


def test_every_query_has_sql():
    own = registry()
    assert set(own.queries) == set(own.sql)
    assert set(own.queries) <= set(QUERIES)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
