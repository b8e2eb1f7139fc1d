"""Queries of the catalogue against DuckDB on the smallest tables."""

import math

import duckdb
import pandas as pd
import pytest

from harrow.plans import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for name in TABLES.split():
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{SF}/{name}.parquet')")
    return con


def plain(frame):
    def value(v):
        v = v.tolist() if hasattr(v, "tolist") else v
        if v is pd.NaT or isinstance(v, float) and math.isnan(v):
            return None
        return round(v, 6) if isinstance(v, float) else v

    return sorted(repr([value(v) for v in row]) for row in frame[sorted(frame.columns)].itertuples(index=False))


def test_every_query_has_sql():
    assert set(catalogue.SQL) == set(catalogue.QUERIES)


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_against_sql(spark, duck, name):
    assert plain(catalogue.QUERIES[name](spark, SF).toPandas()) == plain(duck.execute(catalogue.SQL[name]).df())
