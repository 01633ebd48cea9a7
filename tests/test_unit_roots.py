"""Unit-root tests against plain least squares, spans by blocks of starts, numbering and samples."""

import math
import random

import numpy as np
import pytest

from quantloom.operators import sampling as P
from quantloom.operators import scans as X
from quantloom.operators import series as W


def plain_adf(y, lags):
    """The t statistic of the level, by NumPy's least squares."""
    d = np.diff(y)
    n = len(d) - lags
    if n <= lags + 2:
        return 0.0
    x = np.column_stack([np.ones(n), y[lags:-1], *[d[lags - k : len(d) - k] for k in range(1, lags + 1)]])
    beta, _, rank, _ = np.linalg.lstsq(x, d[lags:], rcond=None)
    if rank < x.shape[1]:
        return 0.0
    rest = d[lags:] - x @ beta
    error = math.sqrt(rest @ rest / (n - x.shape[1]) * np.linalg.inv(x.T @ x)[1, 1])
    return beta[1] / error if error > 1e-15 else 0.0


SERIES = {
    "walk": np.cumsum(np.random.default_rng(1).normal(size=60)) + 100,
    "noise": np.random.default_rng(2).normal(size=45),
    "bubble": np.exp(np.arange(50) / 15) + np.random.default_rng(3).normal(size=50) / 10,
    "short": np.arange(12.0),
}


@pytest.fixture(scope="module")
def frame(spark):
    return spark.createDataFrame([(k, i, float(v)) for k, y in SERIES.items() for i, v in enumerate(y)], "key string, idx long, x double").repartition(3).cache()


@pytest.mark.parametrize("lags", [0, 1, 2])
def test_adf_and_sadf(frame, lags):
    made = {r["key"]: r["statistic"] for r in X.adf_test(frame, ["key"], "idx", "x", lags).collect()}
    for k in ("walk", "noise", "bubble"):
        assert math.isclose(made[k], plain_adf(SERIES[k], lags), rel_tol=1e-6)
    rows = {(r["key"], r["end"]): r["statistic"] for r in X.sadf(frame, ["key"], "idx", "x", 15, lags).collect()}
    assert sorted(rows) == sorted((k, e) for k, y in SERIES.items() for e in range(15, len(y) + 1))
    for (k, e), s in rows.items():
        assert math.isclose(s, plain_adf(SERIES[k][:e], lags), rel_tol=1e-6, abs_tol=1e-6)


@pytest.mark.parametrize("block", [64, 7])
def test_gsadf(frame, block):
    rows = {(r["key"], r["start"], r["end"]): r["statistic"] for r in X.gsadf(frame, ["key"], "idx", "x", 15, 1, block).collect()}
    assert sorted(rows) == sorted((k, a, b) for k, y in SERIES.items() for a in range(len(y)) for b in range(a + 15, len(y) + 1))
    for (k, a, b), s in rows.items():
        assert math.isclose(s, plain_adf(SERIES[k][a:b], 1), rel_tol=1e-5, abs_tol=1e-6)
    best = {r["key"]: r["statistic"] for r in X.gsadf_stat(frame, ["key"], "idx", "x", 15, 1, block).collect()}
    assert best.pop("short") == -math.inf
    assert all(math.isclose(v, max(s for (key, *_), s in rows.items() if key == k), rel_tol=1e-9) for k, v in best.items())


def test_numbered(spark):
    values = [random.Random(i).randrange(400) for i in range(900)]
    frame = spark.createDataFrame([(v, i) for i, v in enumerate(values)], "v int, i int").repartition(5)
    made = W.numbered(frame, ["v", "i"], "at").collect()
    assert {(r["v"], r["i"]): r["at"] for r in made} == {x: k for k, x in enumerate(sorted((v, i) for i, v in enumerate(values)))}
    assert W.numbered(frame.where("false"), ["v"]).count() == 0


def test_samples_of_each_key(spark):
    frame = spark.createDataFrame([(k, i) for k, n in (("a", 1000), ("b", 1), ("c", 7)) for i in range(n)], "key string, idx long")
    even = {}
    for r in P.linspace_rows(frame, ["key"], "idx", 5).orderBy("key", "i").collect():
        even.setdefault(r["key"], []).append(r["idx"])
    assert even == {"a": [0, 250, 500, 749, 999], "b": [0] * 5, "c": [0, 2, 3, 5, 6]}
    state, drawn = 7, {"a": set(), "b": set(), "c": set()}
    for _ in range(20):
        state = (state * 6364136223846793005 + 1442695040888963407) % 2**64
        for k, n in (("a", 1000), ("b", 1), ("c", 7)):
            drawn[k].add((state >> 16) % n)
    made = {}
    for r in P.uniform_sample(frame, ["key"], "idx", 10, 7).collect():
        made.setdefault(r["key"], []).append(r["idx"])
    assert {k: sorted(v) for k, v in made.items()} == {k: sorted(v)[:10] for k, v in drawn.items()} and max(made["a"]) > 100
    assert P.uniform_sample(frame, ["key"], "idx", 0, 7).count() == P.linspace_rows(frame, ["key"], "idx", 0).count() == 0
