"""A series with a zero: the return after it is zero, and what is built on returns runs."""

import datetime as dt

from pyspark.sql import functions as F

from quantloom.plans.catalogue import QUERIES
from quantloom.sources.tables import event_series

NAMES = ["sharpe_ratio", "compute_drawdowns", "amihud_lambda_rolling", "get_bins", "get_meta_bins", "meta_labeler_labels", "hit_ratio", "amihud_lambda", "kyle_lambda", "hhi_concentration", "return_attribution_weights", "avg_active_signals", "cscv", "probability_of_backtest_overfitting"]


def test_zero_price(spark, tmp_path):
    begun = dt.datetime(2024, 1, 1)
    rows = [(k * 100 + i, k, begun + dt.timedelta(days=i), "view", 0.0 if i % 7 == 3 else 10.0 + (i * 7 + k) % 5) for k in range(1, 17) for i in range(30)]
    spark.createDataFrame(rows, "event_id long, user_id long, ts timestamp, event_type string, value double").write.parquet(str(tmp_path / "events.parquet"))
    after = event_series(spark, str(tmp_path)).where("p = 0").agg(F.count(F.lit(1)).alias("n"), F.max(F.abs("r")).alias("r")).first()
    assert after["n"] == 64 and after["r"] == 0
    for name in NAMES:
        assert QUERIES[name](spark, str(tmp_path)).count() > 0, name
