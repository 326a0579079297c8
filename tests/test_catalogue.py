"""Every rule and operator against its DuckDB statement over the star tables."""

import os

import duckdb
import pytest

from girder import catalogue, oracles
from girder.plans.rules import RULES

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the driver's tables")
QUERIES = catalogue.queries()


def rows(df):
    def cell(v):
        if v is None or v != v:
            return None
        number = isinstance(v, (int, float)) and not isinstance(v, bool) or type(v).__name__.startswith(("int", "float", "Decimal"))
        return float(v) if number else str(v)

    return sorted(str([cell(v) for v in r]) for r in df[sorted(df.columns)].astype(object).values.tolist())


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(oracles.ORACLES)
    assert len(RULES) == 90


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_same_rows(spark, name):
    con = duckdb.connect()
    for t in ("region", "nation", "supplier", "part", "orders", "customer", "lineitem", "events", "labels"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    got, want = QUERIES[name](spark, DATA).toPandas(), con.sql(oracles.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)
