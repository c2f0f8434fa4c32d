"""Every registered query of the library against its SQL on another engine, at the smallest scale."""

import decimal
import math

import duckdb
import pytest

from tonearm.plans import registry

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SQL = registry.oracle_sql()


def plain(v):
    if isinstance(v, bool) or v is None or isinstance(v, str):
        return v
    if isinstance(v, (int, float, decimal.Decimal)):
        v = float(v)
        return "nan" if math.isnan(v) else round(v, 6) + 0.0
    return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v


@pytest.fixture(scope="module")
def other():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(spark, other, name):
    got = registry.queries()[name](spark, DATA)
    result = other.execute(SQL[name])
    columns = [d[0] for d in result.description]
    assert sorted(columns) == sorted(got.columns)
    want = [tuple(plain(x) for x in row) for row in result.fetchall()]
    have = [tuple(plain(row[c]) for c in columns) for row in got.collect()]
    assert sorted(map(repr, have)) == sorted(map(repr, want))


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(SQL)))
def test_runs(spark, name):
    assert registry.queries()[name](spark, DATA).columns


def test_entry(spark):
    assert registry.entry(spark, DATA).count() > 0
