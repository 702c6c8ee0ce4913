"""Every registered query against its DuckDB statement at the smallest scale."""

import math

import duckdb
import pytest

import __spark_entry__ as entry_module

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
TYPES = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN", "timestamp_ntz": "TIMESTAMP", "date": "DATE", "decimal(10,7)": "DECIMAL(10,7)"}


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from '{sf_dir}/{name}.parquet'")
    return con


def text(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "~"
    return repr(v) if isinstance(v, float) else str(v)


def test_every_statement_has_a_query():
    assert set(entry_module.oracle_sql()) <= set(entry_module.queries())


@pytest.mark.parametrize("name", sorted(entry_module.queries()))
def test_query(spark, duck, sf_dir, name):
    df = entry_module.queries()[name](spark, sf_dir)
    columns = sorted(df.columns)
    got = sorted(tuple(text(r[c]) for c in columns) for r in df.collect())
    sql = entry_module.oracle_sql().get(name)
    if sql is None:
        assert got
        return
    cursor = duck.execute(sql)
    names = [c[0] for c in cursor.description]
    types = {c[0]: str(c[1]) for c in cursor.description}
    rows = cursor.fetchall()
    assert sorted(names) == columns
    assert {c: TYPES[t] for c, t in df.dtypes} == types
    at = [names.index(c) for c in columns]
    assert got == sorted(tuple(text(r[i]) for i in at) for r in rows)


def test_entry(spark):
    assert entry_module.entry(spark).count() >= 2
