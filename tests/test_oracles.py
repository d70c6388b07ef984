"""Every query with SQL gives what the SQL gives, on the smallest tables."""

import math

import duckdb
import pytest

import __spark_entry__ as E

SMALL = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SMALL}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v


@pytest.mark.parametrize("name", sorted(E.oracle_sql()))
def test_query_equals_sql(spark, sql, name):
    df = E.queries()[name](spark, SMALL)
    told = sql.sql(E.oracle_sql()[name])
    columns = sorted(df.columns)
    assert columns == sorted(told.columns)
    at = [told.columns.index(c) for c in columns]
    ours = sorted((tuple(map(plain, r)) for r in df.select(*columns).collect()), key=str)
    theirs = sorted((tuple(plain(r[i]) for i in at) for r in told.fetchall()), key=str)
    assert ours == theirs


@pytest.mark.parametrize("name", sorted(set(E.queries()) - set(E.oracle_sql()) - {n for n in E.queries() if n.startswith("op") or n == "pipeline"}))
def test_query_runs(spark, name):
    assert E.queries()[name](spark, SMALL).count() >= 0


def test_entry(spark):
    assert E.entry(spark).count() > 0
