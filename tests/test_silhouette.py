"""The silhouette score of rows by tiles: many rows, copies, nulls and far outliers."""

import time

import numpy as np
import pytest

from quantloom.operators import research as R


def test_many_rows(spark):
    base = np.random.default_rng(3).normal(size=(100, 3)) + 1000.0
    labels, copies = np.arange(100) % 4, 100
    d = np.sqrt(((base[:, None, :] - base) ** 2).sum(2)) * copies
    sums = np.stack([d[:, labels == c].sum(1) for c in range(4)], 1)
    sizes = np.bincount(labels) * copies
    a = sums[np.arange(100), labels] / (sizes[labels] - 1)
    b = np.where(np.arange(4) == labels[:, None], np.inf, sums / sizes).min(1)
    rows = [(int(i + 100 * k), int(labels[i]), *base[i].tolist()) for k in range(copies) for i in range(100)]
    frame = spark.createDataFrame(rows, "id long, label int, x double, y double, z double")
    begun = time.time()
    made = R.silhouette_score(frame, ["x", "y", "z"], "label", "id").first()[0]
    assert time.time() - begun < 60
    assert made == pytest.approx(((b - a) / np.maximum(a, b)).mean(), abs=1e-12)


def test_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(R, "TILES", 3)
    x = np.concatenate([np.random.default_rng(4).normal(size=(40, 2)), [[1e6, -1e6], [1e6, -1e6]]])
    labels = [i % 3 for i in range(40)] + [7, 8]
    frame = spark.createDataFrame([(i, labels[i], *v.tolist()) for i, v in enumerate(x)], "id long, label int, x double, y double")
    assert R.silhouette_score(frame, ["x", "y"], "label", "id").first()[0] == pytest.approx(R.silhouette_values(x, np.array(labels)).mean(), abs=1e-12)
    assert R.silhouette_score(frame.where("label = 1"), ["x", "y"], "label", "id").first()[0] == 0
    assert R.silhouette_score(frame.where("id < 0"), ["x", "y"], "label", "id").first()[0] is None
    assert R.distance_sums(np.array([[0.0, 0.0], [np.nan, 1.0]]), np.array([[3.0, 4.0], [np.nan, 0.0]])).tolist() == [5.0, 0.0]
