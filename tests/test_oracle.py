"""Every query with SQL gives the same rows as DuckDB; every other query runs."""

import os

import duckdb
import pytest

import __spark_entry__ as entry

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in os.listdir(FOLDER):
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{FOLDER}/{name}'")
    return con


def cell(x):
    if x is None or x != x:
        return ""
    if isinstance(x, bool):
        return str(x)
    return repr(round(float(x), 5)) if isinstance(x, (int, float)) else str(x)


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(cell(r[i]) for i in order) for r in data)


def test_names_match():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_same_as_sql(spark, db, name):
    got = entry.queries()[name](spark, FOLDER)
    relation = db.sql(entry.oracle_sql()[name])
    assert sorted(got.columns) == sorted(relation.columns)
    assert rows(got.columns, [tuple(r) for r in got.collect()]) == rows(relation.columns, relation.fetchall())


@pytest.mark.parametrize("name", sorted(set(entry.queries()) - set(entry.oracle_sql())))
def test_runs(spark, name):
    got = entry.queries()[name](spark, FOLDER)
    assert got.columns and got.count() >= 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
