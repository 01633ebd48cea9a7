"""Closed-form and hand-made vectors for what SQL doesn't express, and invariants."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quantloom.errors import InvalidParameter, NotPositiveDefinite
from quantloom.functions import register
from quantloom.functions import scalars as S
from quantloom.operators import bars as B
from quantloom.operators import matrix as M
from quantloom.operators import research as R
from quantloom.operators import sampling as P
from quantloom.operators import scans as X


def test_lempel_ziv():
    bits = lambda s: [c == "1" for c in s]
    assert X.lempel_ziv_array([]) == 0
    assert X.lempel_ziv_array(bits("0")) == 1
    assert X.lempel_ziv_array(bits("0000000")) == 1  # the last phrase reaches the end
    assert X.lempel_ziv_array(bits("01010101")) == 2
    assert X.lempel_ziv_array(bits("0001101001000101")) == 5


def test_longest_match():
    s = [0, 1, 0, 1, 0, 1]
    assert X.longest_match_length(s, 0, 4) == 0
    assert X.longest_match_length(s, 2, 4) == 3
    assert X.kontoyiannis_array([1, 2], 5) == 0.0


def test_frac_weights():
    assert np.allclose(X.frac_weights(0.5, 4), [1, -0.5, -0.125, -0.0625])
    assert [len(X.frac_weights_ffd(0.5, t)) for t in (1e-2, 1e-3, 1e-4)] == [10, 44, 200]
    assert [len(X.frac_weights_ffd(0.3, t)) for t in (1e-2, 1e-3, 1e-4)] == [12, 66, 388]


def test_adf_tells_walks_from_noise():
    rng = np.random.default_rng(1)
    noise = rng.normal(size=300)
    assert X.adf_array(noise, 1)[0] < -5 < X.adf_array(noise.cumsum(), 1)[0]
    assert X.adf_array(noise[:3], 1) == (0.0, [])


def test_gsadf_covers_the_whole_series(spark):
    rng = np.random.default_rng(2)
    y = {1: np.cumsum(rng.normal(size=70)) + 50, 2: np.concatenate([rng.normal(size=30), 1.1 ** np.arange(35)]), 3: rng.normal(size=9)}
    rows = spark.createDataFrame([(k, i, float(v)) for k, x in y.items() for i, v in enumerate(x)], "key int, idx long, x double")
    made = {r["key"]: r["statistic"] for r in X.gsadf_stat(rows, ["key"], "idx", "x", 20, 1).collect()}
    best = lambda x: max((X.adf_array(x[a:b], 1)[0] for a in range(len(x) - 19) for b in range(a + 20, len(x) + 1)), default=-math.inf)
    assert set(made) == {1, 2, 3} and made[3] == -math.inf
    assert all(math.isclose(made[k], best(y[k]), rel_tol=1e-6) for k in (1, 2))


def test_bootstraps_draw_from_the_whole_key(spark):
    from quantloom.plans.catalogue import QUERIES
    from quantloom.sources.tables import event_series

    sf = "/root/testdata/sf0.001"
    sizes = {r["key"]: r["count"] for r in event_series(spark, sf).groupBy("key").count().collect()}
    made = QUERIES["sequential_bootstrap"](spark, sf).groupBy("key").agg(F.count("*").alias("n"), F.max("event_id").alias("last")).collect()
    assert {r["key"]: r["n"] for r in made} == sizes and max(sizes.values()) > 41
    assert any(r["last"] >= 40 for r in made) and all(r["last"] < sizes[r["key"]] for r in made)
    assert {r["key"] for r in QUERIES["compare_bootstraps"](spark, sf).collect()} == set(sizes)


def test_trend_scanning_finds_the_line(spark):
    df = spark.createDataFrame([(1, i, float(i if i < 30 else 60 - i)) for i in range(60)], "key int, idx long, x double")
    made = {r["idx"]: r for r in X.trend_scanning(df, ["key"], "idx", "x", 10, 3).collect()}
    assert made[0]["label"] == 1 and made[40]["label"] == -1 and made[0]["best_window"] == 3
    assert set(made) == set(range(58))


def test_bar_states_restart_where_they_stopped():
    rng = np.random.default_rng(3)
    ticks = [(float(i), float(100 + rng.normal()), float(rng.integers(1, 50))) for i in range(500)]
    for kind in B.KINDS:
        rule = B.BarRule(kind, {"tick": 20, "time": 30, "volume": 300, "dollar": 30_000}.get(kind, 0), {"tick": 5, "volume": 100, "dollar": 10_000}.get(kind.split("_")[0], 0))
        whole, state, parts = B.BarState(rule), B.BarState(rule), []
        expected = [b for t in ticks if (b := whole.add(*t))]
        for at in range(0, 500, 37):
            state = B.BarState(rule, state.saved())
            parts += [b for t in ticks[at : at + 37] if (b := state.add(*t))]
        assert parts == expected and expected
    with pytest.raises(InvalidParameter):
        B.BarRule("other")


def test_scan_bars_do_not_depend_on_partitions(spark):
    df = spark.range(3000).select((F.col("id") % 5).alias("key"), F.col("id").alias("seq"), F.timestamp_seconds("id").alias("ts"), (100 + F.sin("id")).alias("price"), (1 + F.col("id") % 7).cast("double").alias("volume"))
    one = B.scan_bars(df.coalesce(1), ["key"], ["seq"], B.BarRule("volume", 50)).orderBy("key", "bar_id").collect()
    many = B.scan_bars(df.repartition(13), ["key"], ["seq"], B.BarRule("volume", 50)).orderBy("key", "bar_id").collect()
    assert one == many and one


def test_hrp_and_friends():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(300, 6)) * np.arange(1, 7)
    cov, corr = np.cov(x, rowvar=False), np.corrcoef(x, rowvar=False)
    for w in (M.hrp_from_moments(corr, cov), M.cla_min_variance(cov), M.optimal_portfolio(cov, np.ones(6))):
        assert math.isclose(w.sum(), 1.0)
    assert (M.hrp_from_moments(corr, cov) > 0).all()
    values, vectors = M.eigen(cov)
    assert np.allclose(vectors @ np.diag(values) @ vectors.T, cov)
    assert np.allclose(np.diag(M.denoise_corr(corr, 50.0)), 1) and np.allclose(np.diag(M.detone_corr(corr, 1)), 1)
    assert math.isclose(np.abs(M.pca_weights(cov)).sum(), 1.0)
    assert M.kullback_leibler_distance(corr, corr) < 1e-9
    assert sorted(M.quasi_diag(M.single_linkage(1 - corr), 6)) == list(range(6))
    with pytest.raises(NotPositiveDefinite):
        M.inverse(np.zeros((2, 2)))


def test_clusters_and_paths():
    x = np.vstack([np.zeros((4, 2)), np.ones((4, 2)) * 9]) + np.random.default_rng(0).normal(0, 0.1, (8, 2))
    labels, _, _ = R.lloyd(x, 2)
    assert len(set(labels[:4])) == len(set(labels[4:])) == 1 and labels[0] != labels[4]
    assert R.silhouette_values(x, labels).mean() > 0.9
    c = R.Cpcv(6, 2)
    assert len(c.splits()) == 15 and c.num_paths() == 5 and R.Cpcv(2, 2).splits() == []
    assert R.build_paths([t for _, t in R.Cpcv(4, 2).splits()], 4) == [[0, 5], [1, 4], [2, 3]]
    assert R.compositions(2, 2) == [[0, 2], [1, 1], [2, 0]]
    assert np.linalg.matrix_rank(R.random_matrix_of_rank(6, 5, 2)) == 2
    parts = R.nested_parts(100, 7)
    assert parts[0][0] == 0 and parts[-1][1] == 100 and all(a[1] == b[0] for a, b in zip(parts, parts[1:], strict=False))


def test_trials_do_not_depend_on_tasks(spark):
    one = R.simulate_ou(spark, 0.5, 1.0, 0.1, 0.0, 0.1, 20, 6, seed=3).orderBy("trial", "step").collect()
    assert one == R.simulate_ou(spark, 0.5, 1.0, 0.1, 0.0, 0.1, 20, 6, seed=3).repartition(3).orderBy("trial", "step").collect()
    best = R.best_trial(R.grid_search(spark, [("a", [1, 2, 3]), ("b", [0, 5])], lambda p: -((p["a"] - 2) ** 2) + p["b"])).first()
    assert best["params"] == {"a": 2.0, "b": 5.0} and best["trial"] == 3
    assert all(1 <= r["value"] <= 10 for r in R.LogUniform(1, 10).frame(spark, 20).collect())
    jobs = R.process_jobs(spark, [1, 0], lambda x: 1 / x).orderBy("trial").collect()
    assert jobs[0]["ok"] == 1.0 and "ZeroDivisionError" in jobs[1]["error"]
    assert R.index_product(spark, [2, 3]).count() == 6 and R.lin_parts(spark, 10, 3).collect()[1]["start"] == 3
    assert P.linspace_sample(spark, 0, 10, 5).select("idx").toPandas()["idx"].tolist() == [0, 3, 5, 8, 10]
    assert R.make_classification(spark, 30, 3, 2, 1).count() == 30


def test_sql_functions(spark):
    register(spark)
    assert spark.sql("select sigmoid_bet_size(0.75D) a, discrete_signal(0.26D, 0.1D) b").first()["a"] == 0.5
    row = spark.range(1).select(S.normal_cdf(F.lit(1.96)).alias("v")).first()
    assert math.isclose(row["v"], 0.9750021048517795, abs_tol=1e-12)
