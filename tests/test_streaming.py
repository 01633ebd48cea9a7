"""Streams give what batches give, whatever the micro-batches."""

import pytest
from pyspark.sql import functions as F

from quantloom.operators.bars import KINDS, BarRule, bars, scan_bars
from quantloom.operators.sampling import cusum_filter
from quantloom.streaming.bars import stream_bars, stream_cusum

LIMITS = {"tick": 7, "time": 200.0, "volume": 40.0, "dollar": 4000.0}
FIRST = {"tick": 3.0, "volume": 12.0, "dollar": 1200.0}


@pytest.fixture(scope="module")
def ticks(spark, tmp_path_factory):
    """Three keys of ticks, and the folder of their files: rows of a file in no order, files one after the other."""
    made = spark.range(400).select((F.col("id") % 3).cast("string").alias("key"), F.timestamp_seconds(1_000_000 + F.col("id") * 10).alias("ts"), F.col("id").alias("seq"), (100 + F.sin("id")).alias("price"), (1 + F.col("id") % 7).cast("double").alias("volume"))
    folder = str(tmp_path_factory.mktemp("ticks"))
    for k in range(4):
        made.where((F.col("seq") >= 100 * k) & (F.col("seq") < 100 * k + 100)).coalesce(1).orderBy(F.xxhash64("seq")).write.mode("append").parquet(folder)
    return made.cache(), folder


def streamed(spark, folder, schema, make, name, checkpoint):
    stream = make(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder))
    query = stream.writeStream.format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination(120)
    return spark.table(name).collect()


@pytest.mark.parametrize("kind", KINDS)
def test_bars_of_a_stream(spark, ticks, tmp_path, kind):
    rows, folder = ticks
    rule = BarRule(kind, LIMITS.get(kind, 0), FIRST.get(kind.split("_")[0], 0.0))
    made = {(r["key"], r["bar_id"]): r for r in streamed(spark, folder, rows.schema, lambda s: stream_bars(s, rule, "500 seconds"), f"bars_of_{kind}", str(tmp_path / "cp"))}
    whole = {(r["key"], r["bar_id"]): r for r in scan_bars(rows, ["key"], ["seq"], rule).collect()}
    assert made and {k: v for k, v in made.items() if whole[k] != v} == {}
    if kind == "tick":
        assert {k: (r["open"], r["close"], r["ticks"]) for k, r in whole.items()} == {(r["key"], r["bar_id"]): (r["open"], r["close"], r["ticks"]) for r in bars(rows, ["key"], ["seq"], rule).collect()}


def test_events_of_a_stream(spark, ticks, tmp_path):
    rows, folder = ticks
    made = {(r["key"], r["seq"]) for r in streamed(spark, folder, rows.schema, lambda s: stream_cusum(s, 1.5, "2000 seconds"), "events_of_stream", str(tmp_path / "cp"))}
    whole = {(r["key"], r["seq"]) for r in cusum_filter(rows, ["key"], "seq", "price", 1.5).collect()}
    assert made and made <= whole
