"""Every registered operator against its SQL over the smallest tables."""

import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from textharbor.llm import queries

DATA = "/root/testdata/sf0.001"
TABLES = ("documents", "pages", "benchmark", "labels")


def plain(value):
    if value is None or value is pd.NaT or value != value:
        return None
    value = value.item() if hasattr(value, "item") else value
    return round(value, 6) if isinstance(value, float) else value


def test_names():
    names = set(entry.queries())
    assert set(queries.QUERIES) <= names and "pipeline" in names
    assert {n.split("_")[0] for n in queries.QUERIES} == {f"op{i}" for i in range(1, 14)}
    assert set(queries.ORACLE_SQL) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_sql_gives_the_same_rows(spark, name):
    con = duckdb.connect()
    for table in TABLES:
        path = f"{DATA}/{table}.parquet"
        con.sql(f"create view {table} as select * from read_parquet('{path + '/*.parquet' if os.path.isdir(path) else path}')")
    got = queries.QUERIES[name](spark, DATA)
    columns = sorted(got.columns)
    rows = sorted((tuple(map(plain, r)) for r in got.select(*columns).collect()), key=repr)
    wanted = con.sql(f"select {', '.join(columns)} from ({queries.ORACLE_SQL[name].strip()})").fetchall()
    assert rows == sorted((tuple(map(plain, r)) for r in wanted), key=repr)
    assert len(rows) > 0
