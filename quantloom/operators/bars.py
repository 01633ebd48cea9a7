"""Bars from ticks: columns key(s), an order, price and volume in; one row per complete bar out.

Tick bars and epoch-aligned time bars are plain windows and aggregates. The others decide from what came before where
a bar ends and drop the overshoot, so they scan each key in order, in Arrow batches, and carry the open bar from batch
to batch; keys run in parallel. The scan is a small state machine, the same for batches and streams. The incomplete
last bar of a key is never emitted.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import InvalidParameter
from .carry import carry_scan
from .series import Ordered, with_idx

BAR_COLUMNS = "bar_id long, ts timestamp, open double, high double, low double, close double, volume double, vwap double, ticks long"
KINDS = ("tick", "time", "volume", "dollar", "tick_imbalance", "volume_imbalance", "dollar_imbalance", "tick_runs", "volume_runs", "dollar_runs")


def tick_bars(ticks: DataFrame, keys: Sequence[str], order: Sequence[str], size: int) -> DataFrame:
    """A bar every ``size`` ticks (at least 1): one sort by key, then an aggregate on the same keys."""
    size = max(1, size)
    d = with_idx(ticks, keys, order, "__i").withColumn("bar_id", F.floor(F.col("__i") / size).cast("long"))
    traded = F.sum(F.col("price") * F.col("volume"))
    bars = d.groupBy(*keys, "bar_id").agg(
        F.min_by("ts", "__i").alias("ts"), F.min_by("price", "__i").alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", "__i").alias("close"),
        F.sum("volume").alias("volume"), traded.alias("__traded"), F.count(F.lit(1)).alias("ticks"),
    )
    vwap = F.when(F.col("volume") > 0, F.col("__traded") / F.col("volume")).otherwise(F.col("close"))
    return bars.where(F.col("ticks") == size).withColumn("vwap", vwap).select(*keys, "bar_id", "ts", "open", "high", "low", "close", "volume", "vwap", "ticks")


def aligned_time_bars(ticks: DataFrame, keys: Sequence[str], order: Sequence[str], interval: str) -> DataFrame:
    """Bars on a fixed grid from the epoch, the last included: the form that adds up in parts."""
    place = F.struct(*order)
    traded = F.sum(F.col("price") * F.col("volume"))
    bars = ticks.groupBy(*keys, F.window("ts", interval).alias("__w")).agg(
        F.min_by("price", place).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", place).alias("close"), F.sum("volume").alias("volume"), traded.alias("__traded"), F.count(F.lit(1)).alias("ticks")
    )
    vwap = F.when(F.col("volume") > 0, F.col("__traded") / F.col("volume")).otherwise(F.col("close"))
    return bars.select(*keys, F.col("__w.start").alias("ts"), "open", "high", "low", "close", "volume", vwap.alias("vwap"), "ticks")


@dataclass(frozen=True)
class BarRule:
    """Where a bar ends. threshold: volume, dollars or seconds; initial and span: the first expectation and its EWMA."""

    kind: str
    threshold: float = 0.0
    initial: float = 0.0
    span: float = 20.0

    def __post_init__(self):
        if self.kind not in KINDS:
            raise InvalidParameter(f"kind {self.kind!r}")


class Ewma:
    """The first value, then alpha * value + (1 - alpha) * mean with alpha = 2 / (span + 1)."""

    def __init__(self, span: float, value: float | None = None):
        self.alpha, self.value = 2 / (span + 1), value

    def add(self, x: float) -> float:
        self.value = x if self.value is None else self.alpha * x + (1 - self.alpha) * self.value
        return self.value


def _sums(before: float, x: np.ndarray) -> np.ndarray:
    """Running sums that go on from ``before``."""
    return np.cumsum(np.concatenate([[before], x]))[1:]


def _total(before: float, x: np.ndarray) -> float:
    return float(_sums(before, x)[-1])


class BarState:
    """The state of one key: the open bar, and what its rule remembers. ``add`` returns a complete bar or None."""

    def __init__(self, rule: BarRule, saved: dict | None = None):
        self.rule, self.bar_id, self.bar = rule, 0, None
        self.price, self.side, self.buy, self.sell, self.expected = None, 1.0, 0.0, 0.0, rule.initial
        self.means: list[float | None] = [None, None, None]
        if saved:
            self.__dict__.update(saved)

    def saved(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "rule"}

    def _mean(self, which: int, x: float) -> float:
        e = Ewma(self.rule.span, self.means[which])
        self.means[which] = e.add(x)
        return self.means[which]

    def add(self, ts: float, price: float, volume: float) -> tuple | None:
        kind = self.rule.kind
        if kind == "time" and self.bar is not None and ts >= self.bar[0] + self.rule.threshold:
            done = self._close()
            self._take(ts, price, volume)
            return done
        self._take(ts, price, volume)
        if kind == "time" or not self._full(price, volume):
            return None
        return self._close()

    def add_many(self, ts: np.ndarray, price: np.ndarray, volume: np.ndarray) -> list[tuple]:
        """What ``add`` returns for these ticks in turn: one by one while bars are short, else in stretches."""
        out, a, short = [], 0, True
        while a < len(price):
            c = min(len(price), a + (256 if short else 8192))
            part = ts[a:c], price[a:c], volume[a:c]
            made = [bar for t in zip(*(x.tolist() for x in part), strict=True) if (bar := self.add(*t)) is not None] if short else self._add_stretch(*part)
            out.extend(made)
            short, a = 32 * len(made) > c - a, c
        return out

    def _add_stretch(self, ts: np.ndarray, price: np.ndarray, volume: np.ndarray) -> list[tuple]:
        """The same on whole arrays.

        What ends a bar is fixed while the bar is open, so its end is the first tick at which a running sum meets it;
        sums go on from those of the open bar, tick by tick, so they are the same numbers.
        """
        out, a, width = [], 0, 64
        buys, sells = self._sides(price, volume) if self.rule.kind.endswith(("imbalance", "runs")) else (None, None)
        while a < len(price):
            c = min(len(price), a + width)
            met = np.flatnonzero(self._meets(ts[a:c], price[a:c], volume[a:c], *(x if x is None else x[a:c] for x in (buys, sells))))
            found = len(met) > 0
            if found:
                c = a + int(met[0]) + (self.rule.kind != "time")  # a tick beyond the time is the next bar's
            if c > a:
                self._take_many(ts[a:c], price[a:c], volume[a:c])
                if buys is not None:
                    self.buy, self.sell = _total(self.buy, buys[a:c]), _total(self.sell, sells[a:c])
            width = max(64, 2 * (c - a)) if found else 2 * width
            a = c
            if found:
                if buys is not None:
                    self._imbalanced() if self.rule.kind.endswith("imbalance") else self._runs()
                out.append(self._close())
        return out

    def _sides(self, price: np.ndarray, volume: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """What each tick adds to the buyers' and to the sellers' side; the first tick ever adds nothing."""
        n = len(price)
        if not n:
            return price, price
        before = np.concatenate([[price[0] if self.price is None else self.price], price[:-1]])
        move = np.where(price > before, 1.0, np.where(price != before, -1.0, 0.0))
        amount = {"tick": np.ones(n), "volume": volume, "dollar": price * volume}[self.rule.kind.split("_")[0]].astype(float)
        if self.price is None:
            move[0] = amount[0] = 0.0
        last = np.maximum.accumulate(np.where(move != 0, np.arange(n), -1))
        side = np.where(last >= 0, move[last], self.side)
        self.price, self.side = float(price[-1]), float(side[-1])
        return np.where(side > 0, amount, 0.0), np.where(side < 0, amount, 0.0)

    def _meets(self, ts: np.ndarray, price: np.ndarray, volume: np.ndarray, buys: np.ndarray | None, sells: np.ndarray | None) -> np.ndarray:
        """For each tick, whether the open bar ends with it (a time bar: before it)."""
        kind, limit, b = self.rule.kind, self.rule.threshold, self.bar or [ts[0], 0, 0, 0, 0, 0.0, 0.0, 0]
        if kind == "time":
            return (ts >= b[0] + limit) & ((self.bar is not None) | (np.arange(len(ts)) > 0))
        if kind == "tick":
            return b[7] + np.arange(1, len(ts) + 1) >= limit
        if kind == "volume":
            return _sums(b[5], volume) >= limit
        if kind == "dollar":
            return _sums(b[6], price * volume) >= limit
        buy, sell = _sums(self.buy, buys), _sums(self.sell, sells)
        return ((np.abs(buy - sell) if kind.endswith("imbalance") else np.maximum(buy, sell)) >= self.expected) & (self.expected > 0)

    def _take_many(self, ts: np.ndarray, price: np.ndarray, volume: np.ndarray) -> None:
        first = float(price[0])
        o = self.bar or [float(ts[0]), first, first, first, first, 0.0, 0.0, 0]
        self.bar = [o[0], o[1], max(o[2], float(price.max())), min(o[3], float(price.min())), float(price[-1]), _total(o[5], volume), _total(o[6], price * volume), o[7] + len(price)]

    def _take(self, ts: float, price: float, volume: float) -> None:
        if self.bar is None:
            self.bar = [ts, price, price, price, price, 0.0, 0.0, 0]
        b = self.bar
        b[2], b[3], b[4] = max(b[2], price), min(b[3], price), price
        b[5], b[6], b[7] = b[5] + volume, b[6] + price * volume, b[7] + 1

    def _close(self) -> tuple:
        ts, o, h, low, c, volume, traded, n = self.bar
        self.bar, self.bar_id = None, self.bar_id + 1
        return (self.bar_id - 1, ts, o, h, low, c, volume, traded / volume if volume > 0 else c, n)

    def _full(self, price: float, volume: float) -> bool:
        kind, rule, b = self.rule.kind, self.rule, self.bar
        if kind == "tick":
            return b[7] >= rule.threshold
        if kind == "volume":
            return b[5] >= rule.threshold
        if kind == "dollar":
            return b[6] >= rule.threshold
        if self.price is None:  # the first tick ever has no side
            self.price = price
            return False
        if price != self.price:
            self.side = 1.0 if price > self.price else -1.0
        self.price = price
        amount = {"tick": 1.0, "volume": volume, "dollar": price * volume}[kind.split("_")[0]]
        self.buy, self.sell = self.buy + (amount if self.side > 0 else 0.0), self.sell + (amount if self.side < 0 else 0.0)
        return self._imbalanced() if kind.endswith("imbalance") else self._runs()

    def _imbalanced(self) -> bool:
        theta = abs(self.buy - self.sell)
        if not (theta >= self.expected and self.expected > 0):
            return False
        self.expected = self._mean(0, float(self.bar[7])) * abs(self._mean(1, theta))
        self.buy = self.sell = 0.0
        return True

    def _runs(self) -> bool:
        most, total = max(self.buy, self.sell), self.buy + self.sell
        if not (most >= self.expected and self.expected > 0):
            return False
        ticks, buy, sell = self._mean(0, float(self.bar[7])), self._mean(1, self.buy / total if total > 0 else 0.0), self._mean(2, self.sell / total if total > 0 else 0.0)
        self.expected = ticks * max(buy, sell)
        self.buy = self.sell = 0.0
        return True


def scan_bars(ticks: DataFrame, keys: Sequence[str], order: Sequence[str], rule: BarRule) -> DataFrame:
    """Bars of any rule; ticks has the keys, the order, ts, price and volume. A key's open bar goes from batch to batch."""
    names = [c.split()[0] for c in BAR_COLUMNS.split(", ")]

    def step(state: BarState, ts: np.ndarray, price: np.ndarray, volume: np.ndarray) -> list[np.ndarray]:
        made = state.add_many(ts / 1e6, price, volume)
        columns = dict(zip(names, map(np.array, zip(*made, strict=True)), strict=True)) if made else {n: np.zeros(0) for n in names}
        return list((columns | {"ts": np.rint(columns["ts"] * 1e6).astype(np.int64)}).values())

    read = {"ts": F.col("ts").cast("timestamp"), "price": F.col("price").cast("double"), "volume": F.col("volume").cast("double")}
    return carry_scan(ticks, keys, order, read, BAR_COLUMNS, lambda: BarState(rule), step)


def bars(ticks: DataFrame, keys: Sequence[str], order: Sequence[str], rule: BarRule) -> DataFrame:
    """Bars of a rule by its cheapest plan."""
    return tick_bars(ticks, keys, order, int(rule.threshold)) if rule.kind == "tick" else scan_bars(ticks, keys, order, rule)


def bar_closes(made: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, Ordered]:
    """Bars as an ordered series with position idx."""
    return made.withColumn("idx", F.col("bar_id")), Ordered(list(keys), ["idx"])
