"""Every query that has SQL, against DuckDB, over the smallest tables."""

import math
import os

import duckdb
import pytest

from statuta.plans import catalog

DATA = os.environ.get("STATUTA_TEST_DATA", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.sql("SET timezone = 'UTC'")
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


def rows(df):
    def cell(x):
        if x is None or isinstance(x, float) and math.isnan(x) or str(x) in ("<NA>", "NaT"):
            return "null"
        return f"{float(x):.6g}" if "float" in type(x).__name__ else str(x)

    return sorted(tuple(map(cell, r)) for r in df[sorted(df.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_query(spark, duck, name):
    got, want = catalog.QUERIES[name](spark, DATA).toPandas(), duck.sql(catalog.SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)
