"""Every query with an oracle against DuckDB on the smallest tables."""

from __future__ import annotations

import numbers

import duckdb
import pandas as pd
import pytest

import __spark_entry__
from lodestar.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def plain(frame: pd.DataFrame) -> list[tuple]:
    """Rows with columns by name, numbers as floats, in a fixed order."""

    def value(v: object) -> object:
        if pd.isna(v):
            return "null"
        return round(float(v), 5) + 0.0 if isinstance(v, numbers.Number) else str(v)

    frame = frame[sorted(frame.columns)]
    return sorted((tuple(value(v) for v in r) for r in frame.itertuples(index=False, name=None)), key=str)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query(spark, sf, duck, name):
    got, want = catalog.queries()[name](spark, sf).toPandas(), duck.execute(catalog.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert plain(got) == plain(want)


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_rows_only(spark, sf, name):
    assert catalog.queries()[name](spark, sf).count() >= 0


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
