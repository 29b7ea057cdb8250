"""Every registered query against its DuckDB oracle (row multiset after
sorting columns by name, doubles at 6 dp) on the sf0.001 tables."""

import math
from collections import Counter

import duckdb
import pytest

import __spark_entry__ as E
from conftest import SF001

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    return v


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF001}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(E.oracle_sql()))
def test_query_matches_oracle(spark, con, name):
    df = E.queries()[name](spark, SF001)
    cols = sorted(df.columns)
    got = Counter(tuple(_norm(r[c]) for c in cols) for r in df.collect())
    res = con.sql(E.oracle_sql()[name])
    assert sorted(res.columns) == cols
    idx = [res.columns.index(c) for c in cols]
    want = Counter(tuple(_norm(r[i]) for i in idx) for r in res.fetchall())
    assert got == want


def test_every_query_has_builder_and_entry(spark):
    assert set(E.oracle_sql()) <= set(E.queries())
    out = E.entry(spark)
    assert out.count() == 4 and "auc" in out.columns
