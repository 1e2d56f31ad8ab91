"""Every query with SQL gives what the SQL gives; entry() and the registry hold together."""

import decimal

import duckdb
import pytest

import __spark_entry__ as entry
from sparkann.plans import registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    held = duckdb.connect()
    for t in ("embeddings", "documents", "pages"):
        held.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return held


def plain(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    value = lambda v: round(float(v), 5) if isinstance(v, (float, decimal.Decimal)) else v
    return sorted((tuple(value(r[i]) for i in order) for r in rows), key=str)


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_sql(spark, con, name):
    got = registry.QUERIES[name](spark, SF)
    want = con.sql(registry.SQL[name])
    columns = list(want.columns)
    assert sorted(got.columns) == sorted(columns)
    assert plain(got.collect(), got.columns) == plain(want.fetchall(), columns)


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_registry():
    assert set(registry.SQL) <= set(registry.QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
