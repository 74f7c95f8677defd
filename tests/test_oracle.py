"""Every query with SQL gives the rows that DuckDB gives for that SQL."""

import os

import duckdb
import pytest

from docsift.plans import all as plans


def norm(v):
    if isinstance(v, float):
        return round(v, 9)
    if isinstance(v, (list, tuple)):
        return tuple(map(norm, v))
    return v


def rows_of(df):
    cols = sorted(df.columns)
    return cols, sorted((repr(tuple(norm(r[c]) for c in cols)) for r in df.collect()))


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    c.sql("SET timezone = 'UTC'")
    for t in os.listdir(sf):
        c.sql(f"CREATE VIEW {t.removesuffix('.parquet')} AS SELECT * FROM '{sf}/{t}'")
    return c


@pytest.mark.parametrize("name", sorted(plans.SQL))
def test_same_rows(spark, sf, con, name):
    cols, rows = rows_of(plans.QUERIES[name](spark, sf))
    rel = con.sql(plans.SQL[name])
    order = [rel.columns.index(c) for c in sorted(rel.columns)]
    assert cols == sorted(rel.columns)
    assert rows == sorted(repr(tuple(norm(r[i]) for i in order)) for r in rel.fetchall())


@pytest.mark.parametrize("name", sorted(set(plans.QUERIES) - set(plans.SQL)))
def test_runs(spark, sf, name):
    assert plans.QUERIES[name](spark, sf).count() > 0
