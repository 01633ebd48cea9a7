"""Per-row functions whose cost was hundreds of interpreted steps a row."""

import math
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from quantloom.functions import scalars as S
from quantloom.operators import scans as X


def spent(df):
    begun = time.time()
    df.write.format("noop").mode("overwrite").save()
    return time.time() - begun


def test_normal_cdf(spark):
    xs = [*np.linspace(-10, 10, 4001).tolist(), -38.0, 40.0, 0.0, -0.0, 1e-300, math.inf, -math.inf, 0.46875 * math.sqrt(2), 4 * math.sqrt(2)]
    made = spark.createDataFrame([(x,) for x in xs], "x double").select("x", S.normal_cdf("x").alias("p")).collect()
    for r in made:
        assert r["p"] == pytest.approx(math.erfc(-r["x"] / math.sqrt(2)) / 2, rel=1e-13, abs=1e-300)
    assert spark.sql("select cast(null as double) as x").select(S.normal_cdf("x")).first()[0] is None
    assert spent(spark.range(500_000).select(S.normal_cdf(F.sin("id") * 3))) < 20


def test_weights(spark):
    ds = [0.0, 0.3, 0.5, 0.999, 1.0, 2.0, 3.5]
    made = spark.createDataFrame([(d, n) for d in ds for n in (0, 1, 7, 60)] + [(None, 3), (0.5, None)], "d double, n int")
    for r in made.select("d", "n", S.frac_weights("d", "n").alias("w"), S.frac_weights_ffd("d", 1e-3, 500).alias("f")).collect():
        assert r["w"] is None if r["d"] is None or r["n"] is None else r["w"] == pytest.approx(X.frac_weights(r["d"], r["n"]), rel=1e-12)
        assert r["f"] is None if r["d"] is None else r["f"] == pytest.approx(X.frac_weights_ffd(r["d"], 1e-3, 500), rel=1e-12)
    assert spent(spark.range(200_000).select(F.explode(S.frac_weights_ffd(F.col("id") / 200_000, 1e-2)))) < 20
