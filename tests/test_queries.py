"""Every registered query with SQL against DuckDB on the same tables; the rest must give rows."""

from __future__ import annotations

import math

import duckdb
import pytest

from lodestone.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 4)
    return v


def rows(columns, values):
    by = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(([plain(r[i]) for i in by] for r in values), key=repr)


@pytest.fixture(scope="module")
def oracle(data):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{data}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, data, oracle, name):
    df = catalog.QUERIES[name](spark, data)
    got = rows(df.columns, df.collect())
    if name not in catalog.ORACLE_SQL:
        assert got
        return
    want = oracle.sql(catalog.ORACLE_SQL[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert got == rows(want.columns, want.fetchall())
