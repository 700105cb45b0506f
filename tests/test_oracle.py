"""Every query with SQL gives what DuckDB gives on the smallest tables."""

import collections
import math
from pathlib import Path

import duckdb
import pytest

from leadloom.plans import lifecycle, pages, problems, queries  # noqa: F401 - lifecycle and pages add queries


def _norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    return v


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for f in Path(sf).glob("*.parquet"):
        c.execute(f"create view {f.stem} as select * from '{f}'")
    return c


SQL = queries.S | problems.SQL


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(spark, sf, duck, name):
    df = (queries.Q | problems.QUERIES)[name](spark, sf)
    cols = sorted(df.columns)
    mine = collections.Counter(tuple(_norm(r[x]) for x in cols) for r in df.collect())
    r = duck.sql(SQL[name])
    assert sorted(r.columns) == cols
    at = [r.columns.index(x) for x in cols]
    assert mine == collections.Counter(tuple(_norm(x[i]) for i in at) for x in r.fetchall())


def test_core_queries_need_no_training_data_package():
    assert not [n for n in {**queries.Q, **problems.QUERIES} if n.startswith(("p1_", "p4_", "p5_", "p6_", "p7_", "p8_", "p9_", "p10_"))]


def test_filters_reach_the_scan(spark, sf):
    plan = queries.latest_applied(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(status), EqualTo(status,applied)" in plan and "raw_json" not in plan
