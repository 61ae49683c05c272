"""Every registered query against its SQL in DuckDB, over whole tables."""

from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry_points

SF = "/root/testdata/sf0.001"
QUERIES, ORACLE = entry_points.QUERIES, entry_points.ORACLE


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for path in Path(SF).glob("*.parquet"):
        connection.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return connection


def table(columns, rows):
    places = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in places], sorted(repr(tuple(row[i] for i in places)) for row in rows)


def test_every_query_has_sql():
    assert list(QUERIES) == list(ORACLE)


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    result = duck.execute(ORACLE[name])
    want = table([column[0] for column in result.description], result.fetchall())
    assert table(df.columns, df.collect()) == want
    assert want[1]


def test_entry(spark):
    assert entry_points.entry(spark).columns == ["event_type", "hh", "n"]
