"""Every query that has SQL, held against DuckDB on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from millrace import queries as core

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    db = duckdb.connect()
    for f in os.listdir(DATA):
        db.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{f}'")
    return db


@pytest.mark.parametrize("name", sorted(core.QUERIES))
def test_same_as_sql(spark, duck, name):
    df = core.QUERIES[name](spark, DATA)
    want = duck.sql(core.ORACLES[name])
    assert sorted(df.columns) == sorted(want.columns)
    got = sorted(repr(tuple(r[c] for c in want.columns)) for r in df.collect())
    assert got == sorted(map(repr, want.fetchall()))


def test_entry(spark):
    rows = entry.entry(spark).collect()
    assert rows and [r.n for r in rows] == sorted((r.n for r in rows), reverse=True)


def test_every_core_query_has_sql():
    assert set(core.QUERIES) == set(core.ORACLES) and len(core.QUERIES) >= 61
