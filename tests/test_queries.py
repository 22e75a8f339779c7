"""Every query with SQL gives the same rows as DuckDB."""

from __future__ import annotations

import os

import duckdb
import pytest

from keymoment import catalog

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
QUERIES, SQL = catalog.queries(), catalog.oracle_sql()


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for f in os.listdir(FOLDER):
        c.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{FOLDER}/{f}'")
    return c


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES) and len(QUERIES) >= 90


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, db, name):
    df = QUERIES[name](spark, FOLDER)
    columns = sorted(df.columns)
    rows = sorted(repr(tuple(r[c] for c in columns)) for r in df.collect())
    if name in SQL:
        out = db.sql(SQL[name])
        assert sorted(out.columns) == columns
        at = [out.columns.index(c) for c in columns]
        assert rows == sorted(repr(tuple(r[i] for i in at)) for r in out.fetchall())
    else:
        assert rows
