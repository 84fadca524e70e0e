"""Every registered query against its DuckDB SQL on the smallest tables."""

from __future__ import annotations

import math
import os
from collections import Counter

import duckdb
import pytest

from loomgraph.jobs import queries as jobs

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.sql("set timezone = 'UTC'")
    for name in jobs.TABLES:
        con.sql(f"create view {name} as select * from read_parquet('{SF}/{name}.parquet')")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    return v


@pytest.mark.parametrize("name", sorted(jobs.SQL))
def test_query(spark, duck, name):
    df = jobs.QUERIES[name](spark, SF)
    rel = duck.sql(jobs.SQL[name])
    assert sorted(df.columns) == sorted(rel.columns)
    columns = sorted(df.columns)
    at = [rel.columns.index(c) for c in columns]
    got = Counter(tuple(plain(r[c]) for c in columns) for r in df.collect())
    assert got == Counter(tuple(plain(r[i]) for i in at) for r in rel.fetchall())
    assert got


@pytest.mark.parametrize("name", sorted(set(jobs.QUERIES) - set(jobs.SQL)))
def test_rows(spark, name):
    assert jobs.QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
