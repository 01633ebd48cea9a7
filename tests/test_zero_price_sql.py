"""A series with zeros: queries give the infinities that their SQL gives."""

import datetime as dt
import math

import duckdb
import pytest
from pyspark.sql import functions as F

from quantloom.plans.catalogue import ORACLES, QUERIES, rounded


@pytest.fixture(scope="module")
def zeros(spark, tmp_path_factory):
    """Zeros early, late, and two in a row."""
    begun, path = dt.datetime(2024, 1, 1), str(tmp_path_factory.mktemp("zeros"))
    at = {1: {3}, 2: {25}, 3: {10, 11}, 4: set(), 5: {0}, 6: {29}}
    rows = [(k * 100 + i, k, begun + dt.timedelta(days=i), "view", 0.0 if i in at[k] else 10.0 + (i * 7 + k) % 5 + i / 9) for k in at for i in range(30)]
    spark.createDataFrame(rows, "event_id long, user_id long, ts timestamp, event_type string, value double").coalesce(1).write.parquet(f"{path}/events.parquet")
    return path


def check(spark, path, name):
    con = duckdb.connect()
    con.sql(f"create view events as select * from read_parquet('{path}/events.parquet/*.parquet')")
    theirs = con.sql(ORACLES[name])
    columns, made = theirs.columns, QUERIES[name](spark, path)
    key = lambda r: [repr(v) for v in r if not isinstance(v, float)]
    ours, theirs = sorted(map(tuple, made.select(*columns).collect()), key=key), sorted(theirs.fetchall(), key=key)
    same = lambda a, b: (math.isnan(a) and math.isnan(b)) or math.isclose(a, b, abs_tol=2e-6) if isinstance(a, float) and isinstance(b, float) else a == b
    assert len(ours) == len(theirs)
    for a, b in zip(ours, theirs, strict=True):
        assert all(map(same, a, b)), (a, b)


@pytest.mark.parametrize("name", ["pct_change", "simple_returns", "log_returns"])
def test_returns(spark, zeros, name):
    check(spark, zeros, name)


def test_rounding(spark):
    assert spark.range(1).select(rounded((F.lit(57.63) - F.lit(6.4)) / F.lit(6.4))).first()[0] == 8.004687


def test_amihud(spark, zeros):
    check(spark, zeros, "amihud_lambda_rolling")


def test_chu_stinchcombe_white(spark, zeros):
    check(spark, zeros, "chu_stinchcombe_white")


def test_cusum(spark, zeros):
    check(spark, zeros, "cusum_filter")


def test_daily_volatility(spark, zeros):
    check(spark, zeros, "daily_volatility")


def test_infinite_differences_never_fade(spark):
    from quantloom.operators.scans import ewma_std

    rows = spark.range(9000).selectExpr("1 as key", "id as idx", "if(id = 5, double('inf'), 1.0d) as x")
    assert ewma_std(rows, ["key"], "idx", "x", 20).where("ewma_std < double('inf')").count() == 5


@pytest.mark.parametrize("name", ["get_events", "find_first_touch"])
def test_first_touch(spark, zeros, name):
    check(spark, zeros, name)
