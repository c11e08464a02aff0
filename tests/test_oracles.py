"""Every query with an SQL twin gives DuckDB's rows on the smallest tables."""

import decimal
import os

import duckdb
import pytest

import __spark_entry__ as entry_module
from burrow.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, float) and v != v:
        return None
    if isinstance(v, decimal.Decimal):
        return float(v)
    return tuple(v) if isinstance(v, list) else v


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables aren't here")
@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_same_rows(spark, duck, name):
    df = registry.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    rel = duck.sql(registry.ORACLES[name])
    assert sorted(rel.columns) == columns
    want = sorted((tuple(plain(dict(zip(rel.columns, r))[c]) for c in columns) for r in rel.fetchall()), key=repr)
    assert got == want


def test_entry(spark):
    assert entry_module.entry(spark).count() > 0


def test_every_oracle_has_a_query():
    assert set(entry_module.oracle_sql()) <= set(entry_module.queries())
