"""The flagship: per supplier tick bars, CUSUM events, triple-barrier labels and the hit ratio."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.aggregates import hit_ratio
from ..operators.bars import tick_bars
from ..operators.overlap import TripleBarrier, bins, first_touches
from ..operators.sampling import cusum_filter
from ..sources.tables import TRADE_ORDER, trades

BAR_SIZE, THRESHOLD, BARRIER, VOLATILITY = 5, 0.05, TripleBarrier(2.0, 2.0, 20), 0.02


def supplier_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """key, entry_idx, exit_idx, touch_type, return_value, label."""
    bars = tick_bars(trades(spark, sf_dir), ["key"], TRADE_ORDER, BAR_SIZE).select("key", F.col("bar_id").alias("idx"), F.col("close").alias("price"), F.log("close").alias("log_price"))
    entries = cusum_filter(bars, ["key"], "idx", "log_price", THRESHOLD).select("key", F.col("idx").alias("entry_idx"), F.lit(VOLATILITY).alias("vol"))
    return first_touches(entries, bars, ["key"], BARRIER).withColumn("label", bins("return_value"))


def supplier_hit_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """key, n_events, n_upper, n_lower, hit_ratio, mean_return."""
    e = supplier_events(spark, sf_dir)
    return e.groupBy("key").agg(F.count(F.lit(1)).alias("n_events"), F.sum((F.col("touch_type") == "upper").cast("long")).alias("n_upper"), F.sum((F.col("touch_type") == "lower").cast("long")).alias("n_lower"), F.round(hit_ratio("return_value"), 6).alias("hit_ratio"), F.round(F.avg("return_value"), 6).alias("mean_return"))


BARS_SQL = """b as (select l_suppkey as key, floor((row_number() over (partition by l_suppkey order by l_shipdate, l_orderkey, l_partkey, l_suppkey, l_linenumber) - 1) / {size})::bigint as idx,
 row_number() over (partition by l_suppkey order by l_shipdate, l_orderkey, l_partkey, l_suppkey, l_linenumber) - 1 as i, l_shipdate as ts, l_extendedprice / l_quantity as price, l_quantity as volume from lineitem where l_quantity > 0),
bars as (select key, idx, min_by(ts, i) as ts, min_by(price, i) as open, max(price) as high, min(price) as low, max_by(price, i) as close, sum(volume) as volume,
 case when sum(volume) > 0 then sum(price * volume) / sum(volume) else max_by(price, i) end as vwap, count(*) as ticks from b group by key, idx having count(*) = {size})"""

FLAGSHIP_SQL = f"""with recursive {BARS_SQL.format(size=BAR_SIZE)},
v as (select key, idx, close as price, ln(close) as x from bars),
c as (select key, idx, x, 0.0::double as up, 0.0::double as down, false as hit from v where idx = 0
 union all select key, idx, x, case when u >= {THRESHOLD} or d <= -{THRESHOLD} then 0.0 else u end, case when u >= {THRESHOLD} or d <= -{THRESHOLD} then 0.0 else d end, u >= {THRESHOLD} or d <= -{THRESHOLD}
 from (select v.key, v.idx, v.x, greatest(0.0, c.up + v.x - c.x) as u, least(0.0, c.down + v.x - c.x) as d from c join v on v.key = c.key and v.idx = c.idx + 1)),
n as (select key, max(idx) as last from v group by key),
t as (select c.key, c.idx as entry_idx, p.idx as exit_idx, p.price / q.price - 1 as r, p.idx = least(c.idx + 20, n.last) as is_end
 from c join n using (key) join v q on q.key = c.key and q.idx = c.idx join v p on p.key = c.key and p.idx > c.idx and p.idx <= least(c.idx + 20, n.last) where c.hit),
f as (select key, entry_idx, min_by(r, exit_idx) as r from t where r >= 2.0 * {VOLATILITY} or r <= -2.0 * {VOLATILITY} or is_end group by key, entry_idx)
select key, count(*) as n_events, sum((r >= 2.0 * {VOLATILITY})::int)::bigint as n_upper, sum((r <= -2.0 * {VOLATILITY})::int)::bigint as n_lower,
 round(avg((r > 0)::int::double), 6) as hit_ratio, round(avg(r), 6) as mean_return from f group by key"""
