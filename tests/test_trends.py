"""Trend scanning: slopes of exactly zero, long keys, keys that reach over batches, and prices that are missing."""

import datetime as dt
import math

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from quantloom.operators import scans as X
from quantloom.plans.catalogue import ORACLES, QUERIES


@pytest.fixture(scope="module")
def level(spark, tmp_path_factory):
    """Keys that end as they were two rows before, so their last window rises as much as it falls."""
    r, begun, path = np.random.default_rng(5), dt.datetime(2024, 1, 1), str(tmp_path_factory.mktemp("level"))
    rows = []
    for k in range(120):
        x = np.round(r.exponential(50, 40 + k % 7), 2)
        x[-1] = x[-3]
        rows += [(k * 100 + i, k, begun + dt.timedelta(days=i), "view", float(v)) for i, v in enumerate(x)]
    spark.createDataFrame(rows, "event_id long, user_id long, ts timestamp, event_type string, value double").coalesce(1).write.parquet(f"{path}/events.parquet")
    return path


@pytest.mark.parametrize("name", ["trend_scanning_labels", "trend_scanning_label_series"])
def test_level_windows(spark, level, name):
    con = duckdb.connect(config={"threads": 1})  # on more, the order of its sums and so the sign of a zero slope varies
    con.sql(f"create view events as select * from read_parquet('{level}/events.parquet/*.parquet')")
    theirs = con.sql(ORACLES[name])
    made = QUERIES[name](spark, level).select(*theirs.columns)
    assert sorted(map(tuple, made.collect())) == sorted(theirs.fetchall())


def test_equal_prices_late_in_a_long_key(spark):
    df = spark.range(60_000).selectExpr("1 as key", "id as idx", "if(id < 59900, 1e5 + 1e4 * sin(id * 1.7), 123.45d) as x")
    made = X.trend_scanning(df, ["key"], "idx", "x", 12, 3).where("idx >= 59900").agg(F.count(F.lit(1)), F.max(F.abs("label")), F.min("r_squared"), F.max("r_squared")).first()
    assert tuple(made) == (98, 0, 1.0, 1.0)


def test_windows_reach_over_batches(spark):
    r = np.random.default_rng(9)
    keys = {k: np.cumsum(r.normal(size=n)) for k, n in enumerate([1, 2, 3, 50, 400, 7])}
    rows = [(k, i, float(v)) for k, x in keys.items() for i, v in enumerate(x)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 16)
    try:
        df = spark.createDataFrame(rows, "key int, idx long, x double").repartition(3)
        made = {(m["key"], m["idx"]): m for m in X.trend_scanning(df, ["key"], "idx", "x", 12, 3).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(made) == sum(max(len(x) - 2, 0) for x in keys.values())
    for (k, i), m in made.items():
        tried = []
        for w in range(3, min(12, len(keys[k]) - i) + 1):
            y, x = keys[k][i : i + w], np.arange(w)
            c = np.corrcoef(x, y)[0, 1]
            tried.append((abs(c) * math.sqrt((w - 2) / (1 - c * c)), w, np.sign(c), c * c))
        a, w, s, r2 = max(tried)
        assert (m["best_window"], m["label"]) == (w, s) and m["t_stat"] == pytest.approx(a * s, rel=1e-6) and m["r_squared"] == pytest.approx(r2, rel=1e-6)


def test_missing_prices(spark):
    """A window leaves them out, as SQL's moments do; with none left a row has no trend."""
    rows = [(1, 0, 1.0), (1, 1, None), (1, 2, 3.0), (1, 3, 4.1), (2, 0, None), (2, 1, None), (2, 2, None)]
    made = {(m["key"], m["idx"]): m for m in X.trend_scanning(spark.createDataFrame(rows, "key int, idx long, x double"), ["key"], "idx", "x", 4, 3).collect()}
    assert made[1, 0]["label"] == 1 and made[1, 1]["label"] == 1 and made[2, 0]["label"] is None and made[2, 0]["t_stat"] is None
