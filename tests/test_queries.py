"""Every registered query against its SQL in DuckDB, at the smallest scale."""

import math

import duckdb
import pytest

from voxlake.plans.registry import QUERIES, SQL

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "null"
    if isinstance(v, bool):
        return str(v)
    return f"{float(v):.9g}" if isinstance(v, (int, float)) or type(v).__name__ == "Decimal" else str(v)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query(spark, con, name):
    df = QUERIES[name](spark, DATA)
    rel = con.sql(SQL[name])
    assert sorted(df.columns) == sorted(rel.columns)
    order = sorted(df.columns)
    want = [[plain(r[rel.columns.index(c)]) for c in order] for r in rel.fetchall()]
    assert sorted([plain(r[c]) for c in order] for r in df.collect()) == sorted(want)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, name):
    assert QUERIES[name](spark, DATA).count() > 0
