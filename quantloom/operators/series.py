"""Ordered series: positions, lags, rolling and cumulative windows, all on native window functions.

``Ordered(keys, order)`` names the partition and the total order; operators add columns and drop no rows. A window
without full history gives null.
"""

from __future__ import annotations

import tempfile
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..errors import InvalidParameter
from ..functions.scalars import _col, ieee_divide, ieee_log


@dataclass(frozen=True)
class Ordered:
    """Partition keys and a total order within them; no keys mean one partition, which one task sorts."""

    keys: Sequence[str] = field(default_factory=lambda: ["key"])
    order: Sequence[str] = field(default_factory=lambda: ["idx"])

    @property
    def over(self) -> WindowSpec:
        return Window.partitionBy(*self.keys).orderBy(*self.order)

    @property
    def whole(self) -> WindowSpec:
        return Window.partitionBy(*self.keys)

    @property
    def upto(self) -> WindowSpec:
        return self.over.rowsBetween(Window.unboundedPreceding, Window.currentRow)

    def last(self, n: int) -> WindowSpec:
        return self.over.rowsBetween(-(n - 1), Window.currentRow)


def with_idx(df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str = "idx") -> DataFrame:
    """The 0-based position within the keys."""
    return df.withColumn(name, (F.row_number().over(Ordered(keys, order).over) - 1).cast("long"))


def checkpointed(df: DataFrame) -> DataFrame:
    """The rows, written to ``spark.checkpoint.dir``, so that what follows reads them instead of making them again."""
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not context.master.startswith("local"):
            raise InvalidParameter("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-checkpoint-"))
    return df.checkpoint()


def numbered(df: DataFrame, order: Sequence[str], name: str = "idx") -> DataFrame:
    """All rows with their 0-based position by ``order``, by many tasks: a range sort, then the counts of its partitions.

    The sorted rows are checkpointed in ``spark.checkpoint.dir``, as their partitions must stay the same.
    """
    laid = checkpointed(df.repartitionByRange(*order).sortWithinPartitions(*order))  # as many partitions as the rows fill
    laid = laid.withColumns({"__part": F.spark_partition_id(), "__row": F.monotonically_increasing_id()})
    counts = laid.groupBy("__part").agg(F.count(F.lit(1)).alias("n"), F.min("__row").alias("first")).collect()  # a row for each partition
    shift, before = {}, 0
    for r in sorted(counts):
        shift[r["__part"]], before = before - r["first"], before + r["n"]
    if not shift:
        return df.withColumn(name, F.lit(0).cast("long"))
    shifts = F.create_map(*[F.lit(x) for pair in shift.items() for x in pair])
    return laid.withColumn(name, F.col("__row") + F.element_at(shifts, F.col("__part"))).drop("__part", "__row")


def slice_rows(df: DataFrame, start: int, end: int, idx: str = "idx") -> DataFrame:
    """Positions from start up to, not including, end."""
    if start > end or start < 0:
        raise InvalidParameter(f"{start}, {end}")
    return df.where((F.col(idx) >= start) & (F.col(idx) < end))


def full(n: int, o: Ordered, value: Column) -> Column:
    """``value`` where n rows of history are there, else null."""
    return F.when(F.row_number().over(o.over) >= n, value)


def shift(x, o: Ordered, n: int = 1) -> Column:
    return F.lag(_col(x), n).over(o.over)


def diff(x, o: Ordered) -> Column:
    return _col(x) - shift(x, o)


def simple_returns(x, o: Ordered, ieee: bool = False) -> Column:
    """Null first; 0 after a zero price, or with ``ieee`` an infinity, or NaN from zero to zero."""
    p = shift(x, o)
    if ieee:
        return ieee_divide(_col(x) - p, p)
    return F.when(p == 0, F.lit(0.0)).otherwise((_col(x) - p) / p)


pct_change = simple_returns


def log_returns(x, o: Ordered, ieee: bool = False) -> Column:
    """Null first; 0 where a price is not positive, or with ``ieee`` the logarithm of the quotient, whatever it is."""
    p = shift(x, o)
    if ieee:
        return ieee_log(ieee_divide(x, p))
    return F.when(p.isNotNull(), F.when((p <= 0) | (_col(x) <= 0), F.lit(0.0)).otherwise(F.log(_col(x) / p)))


def cumsum(x, o: Ordered) -> Column:
    return F.sum(_col(x)).over(o.upto)


def rolling_window(x, o: Ordered, n: int) -> Column:
    """The last n values as an array."""
    if n < 1:
        raise InvalidParameter(f"window {n}")
    return full(n, o, F.collect_list(_col(x)).over(o.last(n)))


def with_tick_rule(df: DataFrame, price: str, o: Ordered, initial: float = 0.0, name: str = "side") -> DataFrame:
    """The sign of the last price change, carried over ties; ``initial`` before the first change."""
    move = df.withColumn("__move", F.signum(diff(price, o)))
    carried = F.last(F.when(F.col("__move") != 0, F.col("__move")), ignorenulls=True).over(o.upto)
    return move.withColumn(name, F.coalesce(carried, F.lit(float(initial)))).drop("__move")


def parkinson_volatility(high, low, o: Ordered, n: int) -> Column:
    r = F.pow(F.log(_col(high) / _col(low)), F.lit(2.0))
    return full(n, o, F.sqrt(F.sum(r).over(o.last(n)) / (4 * n * F.log(F.lit(2.0)))))


def garman_klass_volatility(open_, high, low, close, o: Ordered, n: int) -> Column:
    hl, co = F.log(_col(high) / _col(low)), F.log(_col(close) / _col(open_))
    term = 0.5 * hl * hl - (2 * F.log(F.lit(2.0)) - 1) * co * co
    return full(n, o, F.sqrt(F.greatest(F.avg(term).over(o.last(n)), F.lit(0.0))))


def with_yang_zhang(df: DataFrame, o: Ordered, n: int, name: str = "yang_zhang") -> DataFrame:
    """Overnight, close-to-close and Rogers-Satchell variances combined; columns open, high, low, close."""
    k = 0.34 / (1.34 + (n + 1) / (n - 1)) if n > 1 else 0.0
    c0 = F.lag("close").over(o.over)
    hc, ho = F.log(F.col("high") / F.col("close")), F.log(F.col("high") / F.col("open"))
    lc, lo = F.log(F.col("low") / F.col("close")), F.log(F.col("low") / F.col("open"))
    d = df.withColumns({"__night": F.log(F.col("open") / c0), "__close": F.log(F.col("close") / c0), "__rs": hc * ho + lc * lo})
    var = lambda c: F.coalesce(F.var_samp(c).over(o.last(n)), F.lit(0.0))
    total = var("__night") + k * var("__close") + (1 - k) * F.avg("__rs").over(o.last(n))
    return d.withColumn(name, full(n + 1, o, F.sqrt(F.greatest(total, F.lit(0.0))))).drop("__night", "__close", "__rs")


def amihud_rolling(returns, dollar_volumes, o: Ordered, n: int, ieee: bool = False) -> Column:
    """The mean of |r| / v; rows without volume don't count, or with ``ieee`` give an infinity, or NaN without a return."""
    r, v = _col(returns), _col(dollar_volumes)
    if ieee:
        return full(n, o, F.avg(ieee_divide(F.abs(r), v)).over(o.last(n)))
    return full(n, o, F.coalesce(F.avg(F.when(v > 0, F.abs(r) / v)).over(o.last(n)), F.lit(0.0)))


def with_roll_spread_rolling(df: DataFrame, price: str, o: Ordered, n: int, name: str = "roll_spread") -> DataFrame:
    """The Roll spread of each window of n prices, from its n - 1 changes and n - 2 pairs of neighbouring changes."""
    if n < 3:
        raise InvalidParameter(f"window {n}")
    d = df.withColumn("__c", diff(price, o))
    d = d.withColumn("__p", F.lag("__c").over(o.over))
    changes, pairs = o.last(n - 1), o.last(n - 2)
    m = F.avg("__c").over(changes)
    cov = (F.sum(F.col("__c") * F.col("__p")).over(pairs) - m * (F.sum("__c").over(pairs) + F.sum("__p").over(pairs)) + m * m * (n - 2)) / (n - 2)
    return d.withColumn("__cov", cov).withColumn(name, full(n, o, F.when(F.col("__cov") < 0, 2 * F.sqrt(-F.col("__cov"))).otherwise(F.lit(0.0)))).drop("__c", "__p", "__cov")


def corwin_schultz_spread(high, low, o: Ordered) -> Column:
    """From this bar and the one before; null on the first."""
    h, l = _col(high), _col(low)  # noqa: E741
    h0, l0 = F.lag(h).over(o.over), F.lag(l).over(o.over)
    sq = lambda a, b: F.pow(F.log(a / b), F.lit(2.0))
    beta, gamma = sq(h, l) + sq(h0, l0), sq(F.greatest(h, h0), F.least(l, l0))
    k = 3 - 2 * 2**0.5
    alpha = (2**0.5 - 1) * F.sqrt(beta) / k - F.sqrt(gamma / k)
    return F.when(h0.isNotNull(), F.greatest(2 * (F.exp(alpha) - 1) / (1 + F.exp(alpha)), F.lit(0.0)))


def with_drawdowns(df: DataFrame, returns: str, o: Ordered) -> DataFrame:
    """wealth, drawdown and time_under_water of a series of returns above -1 (at -1 and below wealth is 0 from there on)."""
    r = F.coalesce(F.col(returns), F.lit(0.0))
    dead = F.max((r <= -1).cast("int")).over(o.upto) == 1
    d = df.withColumn("wealth", F.when(dead, F.lit(0.0)).otherwise(F.exp(F.sum(F.log1p(F.when(r > -1, r).otherwise(F.lit(0.0)))).over(o.upto))))
    d = d.withColumn("__top", F.max("wealth").over(o.upto))
    d = d.withColumn("drawdown", F.when(F.col("__top") > 0, (F.col("__top") - F.col("wealth")) / F.col("__top")).otherwise(F.lit(0.0)))
    d = d.withColumn("drawdown", F.when(F.col("drawdown") > 1e-15, F.col("drawdown")).otherwise(F.lit(0.0)))
    run = F.sum((F.col("drawdown") == 0).cast("long")).over(o.upto)
    d = d.withColumn("__run", run)
    under = F.sum((F.col("drawdown") > 0).cast("long")).over(Window.partitionBy(*o.keys, "__run").orderBy(*o.order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return d.withColumn("time_under_water", under).drop("__top", "__run")


def time_decay(weight, o: Ordered, oldest_weight: float) -> Column:
    """Weights scaled by position, linearly from ``oldest_weight`` to 1; a negative value zeroes the first |value| rows."""
    w, n, i = _col(weight), F.count(F.lit(1)).over(o.whole), F.row_number().over(o.over) - 1
    if oldest_weight >= 0:
        factor = F.when(n <= 1, F.lit(min(oldest_weight, 1.0))).otherwise(F.lit(float(oldest_weight)) + (1.0 - oldest_weight) * i / (n - 1))
        return w * factor
    zeroed = int(-oldest_weight)
    left = n - zeroed
    ramp = F.when(left <= 1, F.lit(1.0)).otherwise((i - zeroed) / (left - 1))
    return w * F.when(n <= 1, F.lit(0.0)).when(i < zeroed, F.lit(0.0)).otherwise(ramp)


def etf_trick(df: DataFrame, date: str, asset: str, price: str, weight: str) -> DataFrame:
    """(date, value): a portfolio's value from long rows of prices and weights, rebalanced each date.

    The value grows by the weighted price ratios of the assets, a cumulative product of per-date sums.
    """
    w = Window.partitionBy(asset).orderBy(date)
    d = df.withColumns({"__p0": F.lag(price).over(w), "__w0": F.lag(weight).over(w)})
    ratio = F.when(F.col("__p0") == 0, F.lit(0.0)).otherwise(F.col("__w0") * F.col(price) / F.col("__p0"))
    per_date = d.groupBy(date).agg(F.sum(ratio).alias("__g"), F.sum(F.col(weight) * F.col(price)).alias("__v"), F.sum("__w0").alias("__w"))
    # dates are few next to the rows they sum
    upto = Window.partitionBy(F.lit(0)).orderBy(date).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    first = F.first("__v").over(upto)
    logs = F.sum(F.when(F.col("__g") > 0, F.log("__g")).otherwise(F.lit(0.0))).over(upto)
    dead = F.max(F.coalesce(F.col("__g") <= 0, F.lit(False)).cast("int")).over(upto)
    return per_date.select(date, F.when(dead == 1, F.lit(0.0)).otherwise(first * F.exp(logs)).alias("value"))


def with_roll_gaps(df: DataFrame, price: str, is_roll: str, o: Ordered, name: str = "gap") -> DataFrame:
    """What the roll gaps from here on add up to: the total less those already passed."""
    d = df.withColumn("__gap", F.when(F.col(is_roll), F.coalesce(diff(price, o), F.lit(0.0))).otherwise(F.lit(0.0)))
    return d.withColumn(name, F.sum("__gap").over(o.whole) - F.sum("__gap").over(o.upto)).drop("__gap")


def with_non_negative_rolled(df: DataFrame, price: str, is_roll: str, o: Ordered, name: str = "rolled") -> DataFrame:
    """Prices with roll gaps added, shifted up if any is below zero."""
    d = with_roll_gaps(df, price, is_roll, o, "__sum").withColumn(name, F.col(price) + F.col("__sum")).drop("__sum")
    low = F.min(name).over(o.whole)
    return d.withColumn("__low", low).withColumn(name, F.col(name) - F.least(F.col("__low"), F.lit(0.0))).drop("__low")


def with_brown_durbin_evans(df: DataFrame, residual: str, o: Ordered, name: str = "cusum") -> DataFrame:
    """Cumulative standardised residuals over sqrt(n); 1.358 is the critical value at 5 %."""
    m, s, n = F.avg(residual).over(o.whole), F.stddev_samp(residual).over(o.whole), F.count(residual).over(o.whole)
    d = df.withColumns({"__z": (F.col(residual) - m) / s, "__n": n, "__s": s})
    return d.withColumn(name, F.when(F.col("__s") > 1e-15, F.sum("__z").over(o.upto) / F.sqrt("__n")).otherwise(F.lit(0.0))).drop("__z", "__n", "__s")


BROWN_DURBIN_EVANS_CRITICAL = 1.358


def with_chu_stinchcombe_white(df: DataFrame, log_price: str, o: Ordered, critical: float, name: str = "csw") -> DataFrame:
    """|S_t| over critical * sqrt(t) * (1 + 2 t / n) of changes standardised by the first half; null on the first row."""
    d = df.withColumns({"__d": diff(log_price, o), "__t": F.row_number().over(o.over) - 1, "__n": F.count(F.lit(1)).over(o.whole) - 1})
    early = F.when((F.col("__t") >= 1) & (F.col("__t") <= F.floor(F.col("__n") / 2)), F.col("__d"))
    d = d.withColumns({"__m": F.avg(early).over(o.whole), "__s": F.stddev_samp(early).over(o.whole)})
    total = F.sum(F.when(F.col("__s") > 1e-15, (F.col("__d") - F.col("__m")) / F.col("__s"))).over(o.upto)
    bound = critical * F.sqrt(F.col("__t").cast("double")) * (1 + 2 * F.col("__t") / F.col("__n"))
    return d.withColumn(name, F.when(F.col("__t") >= 1, F.when(F.col("__s") > 1e-15, F.abs(total) / bound).otherwise(F.lit(0.0)))).drop("__d", "__t", "__n", "__m", "__s")


def bonferroni(p, keys: Sequence[str]) -> Column:
    return F.least(_col(p) * F.count(F.lit(1)).over(Window.partitionBy(*keys)), F.lit(1.0))


def with_holm(df: DataFrame, p: str, keys: Sequence[str], tie: Sequence[str] = (), name: str = "holm") -> DataFrame:
    """Holm's step-down correction within the keys."""
    w = Window.partitionBy(*keys).orderBy(p, *tie)
    n, rank = F.count(F.lit(1)).over(Window.partitionBy(*keys)), F.row_number().over(w) - 1
    d = df.withColumn("__adj", F.least((n - rank) * F.col(p), F.lit(1.0)))
    return d.withColumn(name, F.max("__adj").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))).drop("__adj")


def adaboost_update(df: DataFrame, prediction: str, label: str, weight: str, keys: Sequence[str]) -> DataFrame:
    """One boosting step within the keys: columns alpha and new_weight."""
    w = Window.partitionBy(*keys)
    wrong = F.abs(F.col(prediction) - F.col(label)) > 1e-10
    err = F.sum(F.when(wrong, F.col(weight)).otherwise(F.lit(0.0))).over(w) / F.sum(weight).over(w)
    d = df.withColumn("__e", F.greatest(F.least(err, F.lit(1 - 1e-10)), F.lit(1e-10)))
    d = d.withColumn("alpha", 0.5 * F.log((1 - F.col("__e")) / F.col("__e")))
    d = d.withColumn("__w", F.col(weight) * F.exp(F.when(wrong, F.col("alpha")).otherwise(-F.col("alpha"))))
    return d.withColumn("new_weight", F.col("__w") / F.sum("__w").over(w)).drop("__e", "__w")


def sharpe_mesh(df: DataFrame, value: str, keys: Sequence[str], name: str = "sharpe") -> DataFrame:
    """Values over the population deviation of the whole grid; 0 without spread."""
    d = df.withColumn("__s", F.stddev_pop(value).over(Window.partitionBy(*keys)))
    return d.withColumn(name, F.when(F.col("__s") >= 1e-12, F.col(value) / F.col("__s")).otherwise(F.lit(0.0))).drop("__s")
