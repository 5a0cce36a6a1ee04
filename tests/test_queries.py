"""Every registered query with SQL gives the rows that DuckDB gives."""

import math

import duckdb
import pytest

import __spark_entry__ as entry
from spectraweave.plans import all_queries

QUERIES, SQL = all_queries()
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from read_parquet('{sf}/{t}.parquet')")
    return con


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    if isinstance(v, bool) or isinstance(v, str):
        return v
    return round(float(v), 5) + 0.0


def rows(names, got):
    order = sorted(range(len(names)), key=lambda k: names[k])
    return sorted((tuple(plain(r[k]) for k in order) for r in got), key=str)


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, sf, duck, name):
    df = QUERIES[name](spark, sf)
    ref = duck.sql(SQL[name])
    assert sorted(df.columns) == sorted(ref.columns)
    got, want = rows(df.columns, df.collect()), rows(ref.columns, ref.fetchall())
    assert len(got) == len(want)
    for a, b in zip(got, want):
        assert a == pytest.approx(b, rel=1e-6, abs=2e-5, nan_ok=True) if all(isinstance(x, float) for x in a + b) else str(a) == str(b) or all(
            x == y or isinstance(x, float) and isinstance(y, float) and abs(x - y) < 2e-5 for x, y in zip(a, b)
        )


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs_without_sql(spark, sf, name):
    df = QUERIES[name](spark, sf)
    assert df.count() > 0 and len(set(df.columns)) == len(df.columns)


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["fiber", "exp", "idx", "residual"] and df.limit(1).count() == 1
    assert set(entry.oracle_sql()) <= set(entry.queries())
