"""One call per key: keys that end anywhere in a batch, null keys, kinds of results; many keys cost little."""

import time

import numpy as np
from pyspark.sql import functions as F

from quantloom.operators import research as R
from quantloom.operators import scans as X


def test_batches(spark):
    rows = [(k, i, float(i)) for k, n in (("a", 25), (None, 7), ("b", 1), ("c", 40)) for i in range(n)]
    frame = spark.createDataFrame(rows, "key string, idx long, x double").repartition(3)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4")
    try:
        one = X.per_key(frame, ["key"], "idx", ["x"], "n long, v array<double>", lambda x: {"n": [len(x)], "v": [x[:2].tolist()]}).collect()
        many = X.per_key(frame, ["key"], "idx", ["idx", "x"], "i long, y double", lambda i, x: {"i": i[1:], "y": np.cumsum(x)[1:]}).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert {r["key"]: (r["n"], r["v"]) for r in one} == {"a": (25, [0, 1]), None: (7, [0, 1]), "b": (1, [0]), "c": (40, [0, 1])}
    assert sorted((r["key"] or "", r["i"], r["y"]) for r in many) == sorted((k or "", i, i * (i + 1) / 2) for k, i, _ in rows if i)


def test_many_keys(spark):
    n = 6000
    events = spark.range(n * 20).select((F.col("id") % n).alias("key"), F.floor(F.col("id") / n).alias("event_id")).withColumns({"start": F.col("event_id"), "end": F.col("event_id") + 3}).cache()
    events.count()
    begun = time.time()
    assert R.compare_bootstraps(events, ["key"], None, None, 1, 7).where("sequential > 0").count() == n
    assert time.time() - begun < 12
