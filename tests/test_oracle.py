"""Every query with SQL gives the rows DuckDB gives on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
BASE = [n for n in entry.catalog.SQL]


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path if os.path.isfile(path) else path + '/*.parquet'}'")
    return con


def canonical(rows):
    return sorted((tuple(round(float(x), 6) if isinstance(x, float) else str(x) for x in r) for r in rows), key=str)


@pytest.mark.parametrize("name", BASE)
def test_matches_duckdb(name, spark, duck, sf):
    df = entry.queries()[name](spark, sf)
    columns = sorted(df.columns)
    got = canonical(tuple(r[c] for c in columns) for r in df.collect())
    res = duck.execute(entry.oracle_sql()[name])
    names = [d[0] for d in res.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    assert got == canonical(tuple(r[i] for i in at) for r in res.fetchall())


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0
