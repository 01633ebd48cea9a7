"""Unit-root tests of many spans: as from one span at a time, and in a fraction of the time."""

import time

import numpy as np
import pytest

from quantloom.operators import scans as X

R = np.random.default_rng(1)
ODD = [R.normal(size=70).cumsum() + 100, np.r_[np.ones(30), R.normal(size=40)], np.r_[R.normal(size=40), np.full(30, 5.0)], np.arange(60.0), R.normal(size=60).round(), np.ones(50), R.normal(size=21), R.normal(size=4)]


@pytest.mark.parametrize("lags", [0, 1, 3])
@pytest.mark.parametrize("at_once", [1 << 15, 100])
def test_spans(monkeypatch, lags, at_once):
    monkeypatch.setattr(X, "SPANS_AT_ONCE", at_once)
    for y in ODD:
        for s, stats in enumerate(X.adf_spans(y, lags, 15, 40)):
            assert stats == pytest.approx([X.adf_array(y[s:e], lags)[0] for e in range(s + 15, len(y) + 1)], rel=1e-5, abs=1e-6)


def test_many_keys(spark):
    n = 2000
    values = R.normal(size=(n, 66)).cumsum(1)
    rows = spark.createDataFrame([(k, values[k].tolist()) for k in range(n)], "key long, v array<double>").selectExpr("key", "posexplode(v) as (idx, x)").cache()
    rows.count()
    begun = time.time()
    made = X.gsadf_stat(rows, ["key"], "idx", "x", 20, 1)
    assert len({r["key"] for r in made.collect()}) == n and time.time() - begun < 15
