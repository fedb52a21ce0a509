"""Every registered query with SQL against DuckDB on the smallest tables, and entry()."""

import duckdb
import pandas as pd
import pytest

from sparkrecall.plans import oracle, oracle_durable, oracle_io, queries_durable, queries_io  # noqa: F401  the last two add to the queries
from sparkrecall.plans.queries import QUERIES
from tests.conftest import SMALL

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    return con


def plain(value):
    if value is None or pd.isna(value):
        return None
    if isinstance(value, float):
        return float(f"{value:.6g}")
    if type(value).__name__.startswith("bool"):
        return bool(value)
    return int(value) if hasattr(value, "__index__") else value


def rows(df):
    return sorted(repr(tuple(map(plain, r))) for r in df[sorted(df.columns)].itertuples(index=False))


SQL = oracle.SQL | oracle_io.SQL | oracle_durable.SQL


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, duck, name):
    got, want = QUERIES[name](spark, SMALL).toPandas(), duck.sql(SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
