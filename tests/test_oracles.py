"""Registered queries against their SQL in DuckDB, on the smallest tables."""

import datetime
import math
import os

import pytest

import __spark_entry__ as entry
from cohorta.plans import catalog, extended  # noqa: F401

DATA = "/root/testdata/sf0.001"
SLOW = {"rf_strategies", "permutation_importance", "elbow_k", "kmeans_profiles"}


def plain(v):
    if isinstance(v, bool) or v is None:
        return str(v)
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(map(plain, v)) + "]"
    if isinstance(v, datetime.date):
        return v.isoformat()[:10] if not isinstance(v, datetime.datetime) or v.time() == datetime.time() else v.isoformat()
    try:
        return f"{float(v):.7g}" if not isinstance(v, str) else v
    except TypeError:
        return str(v)


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{DATA}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_matches_sql(spark, duck, name):
    df = catalog.QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    got = sorted(tuple(map(plain, r)) for r in df.select(*[f"`{c}`" for c in columns]).collect())
    r = duck.execute(catalog.ORACLE_SQL[name])
    names = [x[0] for x in r.description]
    assert sorted(names) == columns
    assert got == sorted(tuple(plain(x[names.index(c)]) for c in columns) for x in r.fetchall())


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE_SQL) - SLOW))
def test_runs_without_sql(spark, name):
    rows = catalog.QUERIES[name](spark, DATA).collect()
    assert rows and all(not (isinstance(v, float) and math.isnan(v)) for r in rows for v in r)


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_every_query_is_registered():
    assert set(catalog.QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
