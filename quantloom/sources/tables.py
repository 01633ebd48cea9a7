"""The given tables as ticks, series, spans and matrices; plus readers and writers of ticks in other formats."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import InvalidParameter
from ..operators.series import Ordered, simple_returns, with_idx
from ..shipping import ship_package

TICK_SCHEMA = "key string, ts timestamp, seq long, price double, volume double"
TRADE_ORDER = ["l_shipdate", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def read_ticks(spark: SparkSession, path: str, form: str = "parquet", **options) -> DataFrame:
    """Ticks in parquet, orc, csv or json with the schema TICK_SCHEMA."""
    if form not in ("parquet", "orc", "csv", "json"):
        raise InvalidParameter(form)
    return spark.read.format(form).schema(TICK_SCHEMA).options(**options).load(path)


def write_bars(bars: DataFrame, path: str, form: str = "parquet", partition_by: Sequence[str] = (), mode: str = "error") -> None:
    writer = bars.write.format(form).mode(mode)
    (writer.partitionBy(*partition_by) if partition_by else writer).save(path)


def trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem as trades: key (the supplier), the order columns, ts, price and volume."""
    t = table(spark, sf_dir, "lineitem").where("l_quantity > 0")
    return t.select(F.col("l_suppkey").alias("key"), *[c for c in TRADE_ORDER], F.col("l_shipdate").alias("ts"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"), F.col("l_quantity").alias("volume"))


def event_ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as an irregular tick stream per user: key, event_id, ts, price, volume."""
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("key"), "event_id", "ts", F.col("value").alias("price"), (F.col("event_id") % 97 + 1).cast("double").alias("volume"))


def event_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events per user in order: key, idx, ts, event_id, event_type, x, the one before (p), the simple return r (null first, 0 after a 0)."""
    d = with_idx(table(spark, sf_dir, "events").select(F.col("user_id").alias("key"), "ts", "event_id", "event_type", F.col("value").alias("x")), ["key"], ["ts", "event_id"])
    o = Ordered(["key"], ["idx"])
    return d.withColumns({"p": F.lag("x").over(o.over), "r": simple_returns("x", o)})


#: The same in SQL.
SERIES_SQL = "s as (select *, case when p = 0 then 0 else (x - p) / p end as r from (select user_id as key, row_number() over w - 1 as idx, ts, event_id, event_type, value as x, lag(value) over w as p from events window w as (partition by user_id order by ts, event_id)))"


def spans(series: DataFrame) -> DataFrame:
    """A span of 1 to 10 bars after each row, in its key: event_id, start, end, return_value."""
    return series.select("key", F.col("idx").alias("event_id"), F.col("idx").alias("start"), (F.col("idx") + 1 + F.col("event_id") % 10).alias("end"), F.coalesce("r", F.lit(0.0)).alias("return_value"))


#: The same in SQL, with the end at most the key's last position.
SPANS_SQL = f"{SERIES_SQL}, n as (select key, max(idx) as last from s group by key), e as (select s.key, idx as event_id, idx as start, least(idx + 1 + event_id % 10, last) as stop, coalesce(r, 0) as return_value from s join n using (key))"


def daily_assets(spark: SparkSession, sf_dir: str, kinds: Sequence[str] = ("click", "error", "purchase", "signup", "view")) -> DataFrame:
    """Mean value of each event type by day, as wide rows: day, a0, a1, ... of the types that ``kinds`` names."""
    day = table(spark, sf_dir, "events").groupBy(F.date_trunc("day", "ts").alias("day"))
    return day.agg(*[F.avg(F.when(F.col("event_type") == k, F.col("value"))).alias(f"a{i}") for i, k in enumerate(kinds)]).na.drop()


def embedding_columns(spark: SparkSession, sf_dir: str, k: int = 8) -> DataFrame:
    """The first k dimensions of the vectors: vec_id, label, e0, e1, ..."""
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", *[F.col("embedding")[i].cast("double").alias(f"e{i}") for i in range(k)])
