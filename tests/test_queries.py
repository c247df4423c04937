"""Every query with SQL against DuckDB at the smallest scale."""

import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from veritempo.queries import QUERIES
from veritempo.sql import ORACLE_SQL

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables here")


def plain(value):
    if isinstance(value, float):
        return None if pd.isna(value) else round(value, 6)
    if value is None or value is pd.NaT or value is pd.NA:
        return None
    if type(value).__name__ == "Decimal":
        return round(float(value), 6)
    if hasattr(value, "item"):
        return plain(value.item())
    return str(value)[:26] if hasattr(value, "year") else value


def rows(frame):
    frame = frame[sorted(frame.columns)].astype(object)
    return list(frame.columns), sorted(str([plain(x) for x in r]) for r in frame.itertuples(index=False, name=None))


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for name in os.listdir(DATA):
        con.sql(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{DATA}/{name}')")
    return con


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_against_sql(spark, tables, name):
    assert rows(QUERIES[name](spark, DATA).toPandas()) == rows(tables.sql(ORACLE_SQL[name]).df())


def test_all_queries_are_registered():
    assert set(QUERIES) <= set(entry.queries())
    assert set(ORACLE_SQL) <= set(QUERIES)
