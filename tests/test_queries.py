"""Every query with SQL agrees with DuckDB over whole tables; the others run and have a stable schema."""

import os

import duckdb
import pytest

from labspark import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in os.listdir(SF):
        con.sql(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{name}'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_against_duckdb(spark, duck, name):
    df = catalog.queries()[name](spark, SF)
    columns = sorted(df.columns)
    relation = duck.sql(catalog.oracle_sql()[name])
    assert sorted(relation.columns) == columns
    got = sorted(repr(tuple(r[c] for c in columns)) for r in df.collect())
    want = sorted(repr(tuple(dict(zip(relation.columns, r, strict=True))[c] for c in columns)) for r in relation.fetchall())
    assert got == want


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_without_sql(spark, name):
    df = catalog.queries()[name](spark, SF)
    assert df.collect() and df.columns


def test_entry_point(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 10
    assert set(catalog.queries()) <= set(__spark_entry__.queries())
