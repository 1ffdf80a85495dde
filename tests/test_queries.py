"""Every registered query beside its SQL on the smallest sample tables."""

import os

import duckdb
import pandas as pd
import pytest

from framelake.plans import boxes, detail, evidence, ledger, registry, sampling, tracks, vision  # noqa: F401

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no sample tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in os.listdir(DATA):
        con.sql(f"create view {name.removesuffix('.parquet')} as select * from '{DATA}/{name}'")
    return con


def plain(v):
    if pd.api.types.is_scalar(v) and pd.isna(v):
        return None
    return f"{v:.9g}" if isinstance(v, float) else str(v)


def rows(df):
    return sorted((tuple(plain(v) for v in r) for r in df[sorted(df.columns)].itertuples(index=False)), key=str)


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query(spark, duck, name):
    got = registry.QUERIES[name](spark, DATA).toPandas()
    want = duck.sql(registry.ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_queries_without_sql_are_compared_with_plain_loops():
    with open(os.path.join(os.path.dirname(__file__), "test_plain_queries.py")) as f:
        text = f.read()
    assert [n for n in registry.QUERIES if n not in registry.ORACLE_SQL and f'run("{n}")' not in text] == []
