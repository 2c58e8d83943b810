"""Every registered query against its DuckDB oracle on the smallest tables."""

import math

import duckdb
import pytest

from trendlake.plans.registry import ORACLES, QUERIES
from trendlake.plans.views import TABLES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def norm(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, (int, float)):
        return "nan" if math.isnan(v) else round(float(v), 6)
    return v if isinstance(v, str) else round(float(v), 6)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_oracle(spark, duck, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    ours = sorted((tuple(norm(r[c]) for c in columns) for r in df.collect()), key=repr)
    result = duck.sql(ORACLES[name])
    names = list(result.columns)
    assert sorted(names) == columns
    theirs = sorted((tuple(norm(r[names.index(c)]) for c in columns) for r in result.fetchall()), key=repr)
    assert ours == theirs
