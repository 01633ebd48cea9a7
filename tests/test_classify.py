"""Classifiers, purged scores and importances against NumPy, and a forest with golden scores."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quantloom.errors import InvalidParameter
from quantloom.operators import classify as C
from quantloom.operators.overlap import PurgedKFold
from quantloom.plans.catalogue import QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def rows(spark):
    r = np.random.default_rng(3)
    y = r.integers(0, 3, 240)
    x = r.normal(size=(240, 3)) + np.stack([y, y * 0.5, np.zeros(240)], 1)
    w = r.random(240)
    frame = spark.createDataFrame([(i, *map(float, v), int(c), float(u)) for i, (v, c, u) in enumerate(zip(x, y, w, strict=True))], "idx long, a double, b double, c double, y int, w double").repartition(3)
    return frame, x, y, w


def nearest(x, y, x_test, w=None):
    labels = np.unique(y)
    means = np.stack([np.average(x[y == c], 0, None if w is None else w[y == c]) for c in labels])
    return labels[((x_test[:, None, :] - means) ** 2).sum(2).argmin(1)]


@pytest.mark.parametrize("weight", [None, "w"])
def test_nearest_centroid(rows, weight):
    frame, x, y, w = rows
    made = C.NearestCentroid().fit(frame, ["a", "b", "c"], "y", weight).predict(frame).orderBy("idx").collect()
    assert [r["prediction"] for r in made] == nearest(x, y, x, w if weight else None).tolist()


def test_scores_and_importances(rows):
    frame, x, y, _ = rows
    folds = PurgedKFold(4, 0.02).split(frame.select(F.lit(0).alias("one"), "idx", F.col("idx").alias("start"), (F.col("idx") + 2).alias("end")), ["one"])
    roles = {}
    for r in folds.collect():
        roles.setdefault((r["fold"], r["role"]), []).append(r["idx"])

    def want(cols):
        out = []
        for f in range(4):
            a, b = np.array(roles[f, "train"]), np.array(roles[f, "test"])
            out.append((nearest(x[a][:, cols], y[a], x[b][:, cols]) == y[b]).mean())
        return out

    made = {r["fold"]: r["score"] for r in C.cv_scores(frame, ["a", "b", "c"], "y", folds, "idx", C.NearestCentroid()).collect()}
    assert [made[f] for f in range(4)] == pytest.approx(want([0, 1, 2]))
    single = {r["feature"]: r["score"] for r in C.single_feature_importance(frame, ["a", "b", "c"], "y", folds, "idx", C.NearestCentroid()).collect()}
    assert [single[c] for c in "abc"] == pytest.approx([np.mean(want([k])) for k in range(3)])
    assert C.cv_scores(frame, ["a"], "y", folds.where("role = 'test'"), "idx", C.NearestCentroid()).count() == 0
    model = C.NearestCentroid().fit(frame, ["a", "b", "c"], "y")
    drop = {r["feature"]: r["importance"] for r in C.mean_decrease_accuracy(frame, ["a", "b", "c"], "y", "idx", model, 1).collect()}
    assert drop["a"] > 0.1 > abs(drop["c"]) and drop == {r["feature"]: r["importance"] for r in C.mean_decrease_accuracy(frame.repartition(7), ["a", "b", "c"], "y", "idx", model, 1).collect()}


def test_values_are_exchanged(rows):
    frame, x, _, _ = rows
    made = C.exchanged(frame, ["a", "b"], "idx", 5).toPandas()
    for i, f in enumerate(["a", "b"]):
        part = made[made["__feature"] == i].sort_values("idx")
        assert sorted(part[f]) == sorted(x[:, i]) and (part[f].to_numpy() != x[:, i]).mean() > 0.9
        other = "b" if f == "a" else "a"
        assert (part[other].to_numpy() == x[:, 1 - i]).all()


def test_presets():
    assert C.rf_setup_1().parameters(100) == {"numTrees": 1000, "featureSubsetStrategy": "10", "subsamplingRate": 1.0, "minWeightFractionPerNode": 0.0}
    assert C.rf_setup_2().parameters(8)["featureSubsetStrategy"] == "3" and C.rf_setup_2().parameters(8)["minWeightFractionPerNode"] == 0.05
    assert C.rf_setup_3(9).parameters(9)["featureSubsetStrategy"] == "9"


def test_forest(rows, monkeypatch):
    frame, _, y, _ = rows
    forest = C.Forest(C.RandomForestConfig(10, ("sqrt", 0)), 3, 4, ("idx",))
    model = forest.fit(frame, ["a", "b", "c"], "y", "w")
    made = model.predict(frame).orderBy("idx").collect()
    assert np.mean([r["prediction"] == r["y"] for r in made]) > 0.6
    assert all(abs(sum(r["probability"]) - 1) < 1e-9 and len(r["probability"]) == 3 for r in made)
    again = forest.fit(frame.repartition(5), ["a", "b", "c"], "y", "w").predict(frame).orderBy("idx").collect()
    assert [r["probability"] for r in made] == [r["probability"] for r in again]
    sums = {r["tree"]: r["s"] for r in model.tree_importances().groupBy("tree").agg(F.sum("importance").alias("s")).collect()}
    assert len(sums) == 10 and all(abs(s - 1) < 1e-9 for s in sums.values())
    monkeypatch.setattr(C, "MAX_CLASSES", 2)
    with pytest.raises(InvalidParameter):
        C.classes(frame, "y")


def test_golden_forest(spark):
    scores = {r["fold"]: r["value"] for r in QUERIES["forest_accuracy"](spark, SF).collect()}
    assert scores == GOLDEN
    weights = {r["feature"]: r["value"] for r in QUERIES["forest_importances"](spark, SF).collect()}
    assert len(weights) == 8 and abs(sum(weights.values()) - 1) < 1e-5


GOLDEN = {0: 0.152, 1: 0.16, 2: 0.136, 3: 0.104}
