"""Per-series operators that scan or regress: recurrences, fractional differences, entropies, unit-root tests, trends.

Linear recurrences and fixed-length dot products are native; what depends on all that came before runs per key in
Arrow batches, keys in parallel. A key is one group, and its rows must fit a task.
"""

from __future__ import annotations

from array import array
from collections.abc import Callable, Sequence
from itertools import pairwise

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..shipping import ship_package
from .carry import carry_scan, key_starts
from .recurrence import affine_scan
from .series import Ordered, diff, log_returns


#: Rows of results that are handed on together.
ROWS_AT_ONCE = 1 << 17


def per_key(df: DataFrame, keys: Sequence[str], order: str, columns: Sequence[str], shape: str, make: Callable[..., dict]) -> DataFrame:
    """One call of ``make(*arrays)`` per key, over the columns in order; it returns columns of equal length or scalars.

    Spark deals the rows by key and sorts them; a task cuts its batches at the keys, so a key costs little beyond its call.
    """
    ship_package(df.sparkSession)
    keys, columns = list(keys), list(columns)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in (df.schema[k] for k in keys))
    schema = to_arrow_schema(StructType.fromDDL(f"{fields}, {shape}"))
    n_keys = len(keys)

    def run(batches):
        key, pieces, out, held = None, [], [], 0

        def close() -> int:
            made = make(*[np.concatenate(c) for c in zip(*pieces, strict=True)])
            made = {c: [v] if np.ndim(v) == 0 else v for c, v in made.items()}
            out.append((key, made))
            return max(map(len, made.values()))

        def flush() -> pa.RecordBatch:
            sizes = [len(next(iter(m.values()))) for _, m in out]
            again = pa.array(np.repeat(np.arange(len(out)), sizes))
            arrays = [pa.array([k[i] for k, _ in out], schema[i].type).take(again) for i in range(n_keys)]
            for f in list(schema)[n_keys:]:
                parts = [m[f.name] for _, m in out]
                joined = np.concatenate(parts) if all(isinstance(v, np.ndarray) for v in parts) else [v for part in parts for v in part]
                arrays.append(pa.array(joined).cast(f.type) if isinstance(joined, np.ndarray) else pa.array(joined, f.type))
            out.clear()
            return pa.RecordBatch.from_arrays(arrays, schema=schema)

        for batch in batches:
            if not batch.num_rows:
                continue
            found, values = batch.columns[:n_keys], [c.to_numpy(zero_copy_only=False) for c in batch.columns[n_keys + 1 :]]
            for a, b in pairwise([*key_starts(found), batch.num_rows]):
                now = tuple(c[a].as_py() for c in found)
                if pieces and now != key:
                    held += close()
                    pieces = []
                    if held > ROWS_AT_ONCE:
                        yield flush()
                        held = 0
                key = now
                pieces.append([v[a:b] for v in values])
        if pieces:
            close()
        if out:
            yield flush()

    read = df.select(*keys, F.col(order).alias("__o"), *[F.col(c).alias(f"__c{i}") for i, c in enumerate(columns)])
    return read.repartition(*keys).sortWithinPartitions(*keys, "__o").mapInArrow(run, f"{fields}, {shape}")


def ewma(df: DataFrame, keys: Sequence[str], idx: str, value: str, span: float) -> DataFrame:
    """(keys, idx, ewma): the first value, then a x + (1 - a) y with a = 2 / (span + 1); idx counts from 0."""
    a = 2 / (span + 1)
    x = F.col(value).cast("double")
    u = df.select(*keys, F.col(idx).cast("long").alias(idx), F.when(F.col(idx) == 0, x).otherwise(a * x).alias("__u"))
    return affine_scan(u, keys, idx, "__u", 1 - a).select(*keys, idx, F.col("__y").alias("ewma"))


def ewma_std(df: DataFrame, keys: Sequence[str], idx: str, value: str, span: float) -> DataFrame:
    """(keys, idx, ewma_std): the square root of the EWMA of squared differences, which is 0 first; idx counts from 0.

    An infinite or undefined difference never fades.
    """
    a, o = 2 / (span + 1), Ordered(keys, [idx])
    d = diff(value, o)
    u = df.select(*keys, F.col(idx).cast("long").alias(idx), F.coalesce(a * d * d, F.lit(0.0)).alias("__v"))
    finite = F.col("__v") < float("inf")  # NaN is above all numbers
    u = u.withColumns({"__u": F.when(finite, F.col("__v")).otherwise(F.lit(0.0)), "__stays": F.max(F.when(~finite, F.col("__v"))).over(o.upto)})
    return affine_scan(u, keys, idx, "__u", 1 - a).select(*keys, idx, F.sqrt(F.coalesce("__stays", "__y")).alias("ewma_std"))


def daily_volatility(df: DataFrame, keys: Sequence[str], idx: str, price: str, span: float = 100, ieee: bool = False) -> DataFrame:
    """(keys, idx, volatility): the EWMA deviation of differences of log returns, 0 on the first two rows; idx counts from 0.

    ``ieee`` as in ``log_returns``.
    """
    r = df.select(*keys, (F.col(idx).cast("long") - 1).alias(idx), log_returns(F.col(price).cast("double"), Ordered(keys, [idx]), ieee).alias("__r"))
    later = ewma_std(r.where(F.col(idx) >= 0), keys, idx, "__r", span)
    first = r.where(F.col(idx) < 0).select(*keys, idx, F.lit(0.0).alias("volatility"))
    return later.select(*keys, idx, F.col("ewma_std").alias("volatility")).unionByName(first).withColumn(idx, F.col(idx) + 1)


class VolumeBuckets:
    """Buckets of at least ``size`` of volume by the sides of the tick rule; what has no side yet is sold."""

    def __init__(self, size: float):
        self.size, self.made, self.price, self.side, self.buy, self.sell = size, 0, None, 0.0, 0.0, 0.0

    def add_many(self, price: np.ndarray, volume: np.ndarray) -> list[np.ndarray]:
        """(bucket, gap of the sides, total) of the buckets that are full."""
        first, out = self.made, []
        for p, v in zip(price.tolist(), volume.tolist(), strict=True):
            if self.price is not None and p != self.price:
                self.side = 1.0 if p > self.price else -1.0
            self.price = p
            if self.side > 0:
                self.buy += v
            else:
                self.sell += v
            if self.buy + self.sell >= self.size:
                out.append((abs(self.buy - self.sell), self.buy + self.sell))
                self.buy = self.sell = 0.0
        self.made += len(out)
        return [np.arange(first, self.made), *np.array(out, float).reshape(-1, 2).T]


def vpin(df: DataFrame, keys: Sequence[str], idx: str, price: str, volume: str, bucket_size: float = 1000.0, n_buckets: int = 10) -> DataFrame:
    """(keys, bucket, vpin) for each full run of ``n_buckets`` volume buckets; ticks are not split."""
    read = {price: F.col(price).cast("double"), volume: F.col(volume).cast("double")}
    made = carry_scan(df, keys, [idx], read, "bucket long, gap double, total double", lambda: VolumeBuckets(bucket_size), VolumeBuckets.add_many)
    w = Window.partitionBy(*keys).orderBy("bucket").rowsBetween(-(n_buckets - 1), Window.currentRow)
    total = F.sum("total").over(w)
    return made.withColumn("vpin", F.when(total > 0, F.sum("gap").over(w) / total).otherwise(F.lit(0.0))).where(F.col("bucket") >= n_buckets - 1).select(*keys, "bucket", "vpin")


def frac_weights(d: float, size: int) -> list[float]:
    """The first ``size`` weights of (1 - L)^d."""
    w = [1.0] if size > 0 else []
    for k in range(1, size):
        w.append(-w[-1] * (d - k + 1) / k)
    return w


def frac_weights_ffd(d: float, threshold: float, most: int = 1_000_000) -> list[float]:
    """Weights up to the first below the threshold."""
    w = [1.0]
    while len(w) < most:
        nxt = -w[-1] * (d - len(w) + 1) / len(w)
        if abs(nxt) < threshold:
            break
        w.append(nxt)
    return w


def _dot(frame, weights: list[float]):
    """Weights times the frame's values, newest first."""
    newest = F.reverse(frame)
    return F.aggregate(F.zip_with(newest, F.slice(F.array(*map(F.lit, weights)), F.lit(1), F.size(newest)), lambda x, w: x * w), F.lit(0.0), lambda a, b: a + b)


def with_frac_diff_ffd(df: DataFrame, value: str, o: Ordered, d: float, threshold: float = 1e-4, name: str = "ffd") -> DataFrame:
    """Fixed-width fractional difference; null until the window is full."""
    w = frac_weights_ffd(d, threshold)
    x = df.withColumn("__frame", F.collect_list(value).over(o.last(len(w))))
    return x.withColumn(name, F.when(F.size("__frame") == len(w), _dot(F.col("__frame"), w))).drop("__frame")


def frac_weights_above(d: float, threshold: float, most: int) -> np.ndarray:
    """The first ``most`` weights of (1 - L)^d, those below the threshold in absolute value as 0, without zeros at the end."""
    made, last, k, part = [np.ones(1)], 1.0, 1, 1 << 16
    while k < most:
        i = np.arange(k, min(k + part, most))
        w = last * np.cumprod(-(d - i + 1) / i)
        made.append(w)
        last, k = w[-1], k + len(w)
        if k > d + 1 and abs(last) < threshold:  # from here on they only fall
            break
    w = np.concatenate(made)[:most]
    w[np.abs(w) < threshold] = 0.0
    held = np.flatnonzero(w)
    return w[: held[-1] + 1] if len(held) else w[:1]


def filtered(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Sums of w[k] x[i - k] for each i, in one go or, where that is much, by FFT."""
    if len(x) * len(w) <= 1 << 22:
        return np.convolve(x, w)[: len(x)]
    size = 1 << (len(x) + len(w) - 2).bit_length()
    return np.fft.irfft(np.fft.rfft(x, size) * np.fft.rfft(w, size), size)[: len(x)]


def with_causal_filter(df: DataFrame, value: str, o: Ordered, weights: np.ndarray, name: str, block: int | None = None) -> DataFrame:
    """``df`` with ``name``: for each row the weights times the values up to it, newest first; nulls count as 0.

    Rows are cut into numbered blocks at least as long as the weights (a million rows at most), and a block gets the end of
    those before it, so each row goes to two blocks or so and a block is one convolution.
    """
    ship_package(df.sparkSession)
    reach = len(weights) - 1
    size = block or min(1 << 20, max(1 << 12, 1 << reach.bit_length()))
    held = df.sparkSession.sparkContext.broadcast(weights)
    own = F.floor(F.col("__i") / size).cast("long")
    rows = df.withColumn("__i", (F.row_number().over(o.over) - 1).cast("long"))
    to = F.filter(F.sequence(own, own + (reach + size - 1) // size), lambda c: (c == own) | (F.col("__i") >= c * size - reach))
    spread = rows.withColumn("__block", F.explode(to))
    rest = [c for c in df.columns if c not in (*o.keys, value)]
    spread = spread.withColumns({c: F.when(own == F.col("__block"), F.col(c)) for c in rest} | {name: F.lit(None).cast("double")})

    def convolve(part: pa.Table) -> pa.Table:
        part = part.sort_by("__i")
        x = np.nan_to_num(part[value].cast(pa.float64()).to_numpy())
        at = part.schema.get_field_index(name)
        part = part.set_column(at, name, pa.array(filtered(x, held.value)))
        return part.filter(pc.greater_equal(part["__i"], pc.multiply(part["__block"], size)))

    shape = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in spread.schema)
    return spread.groupBy(*o.keys, "__block").applyInArrow(convolve, shape).drop("__i", "__block")


def with_frac_diff_expanding(df: DataFrame, value: str, o: Ordered, d: float, threshold: float = 1e-4, name: str = "frac_diff", block: int | None = None) -> DataFrame:
    """Expanding fractional difference with all the weights at or above the threshold, in absolute value."""
    longest = df.groupBy(*o.keys).count().agg(F.max("count")).first()[0] or 1
    return with_causal_filter(df, value, o, frac_weights_above(d, threshold, longest), name, block)


def find_min_d_array(x: np.ndarray, max_d: float, step: float, threshold: float) -> float:
    if len(x) < 4 or step <= 0 or max_d <= 0:
        return max_d
    d = step
    while d <= max_d + 1e-10:
        w = np.array(frac_weights_ffd(d, threshold))
        if len(x) - len(w) + 1 >= 4 and _looks_stationary(np.convolve(x, w, "valid")):
            return d
        d += step
    return max_d


def _looks_stationary(x: np.ndarray) -> bool:
    if x.var(ddof=1) < 1e-15:
        return True
    a, b = x[: len(x) // 2], x[len(x) // 2 :]
    var = lambda v: ((v - v.mean()) ** 2).sum() / max(len(v) - 1, 1)
    low, high = sorted((var(a), var(b)))
    return (low / high if high > 1e-15 else 1.0) > 0.3 and abs(a.mean() - b.mean()) / x.std(ddof=1) < 1.0


def find_min_d(df: DataFrame, keys: Sequence[str], idx: str, value: str, max_d: float = 1.0, step: float = 0.1, threshold: float = 1e-4) -> DataFrame:
    """(keys, min_d): the least order of difference that passes a comparison of the halves' means and variances."""
    return per_key(df, keys, idx, [value], "min_d double", lambda x: {"min_d": find_min_d_array(x, max_d, step, threshold)})


def suffix_automaton(s: list[int], alphabet: int) -> tuple[list[array], array]:
    """Transitions by symbol (0: none), and for each state the end of its strings' first occurrence; state 1 is empty."""
    go, link, length, first_end = [array("q", [0, 0]) for _ in range(alphabet)], array("q", [0, 0]), array("q", [0, 0]), array("q", [0, -1])
    last = 1
    for i, c in enumerate(s):
        own, step = len(link), go[c]
        for g in go:
            g.append(0)
        link.append(1), length.append(i + 1), first_end.append(i)
        p = last
        while p and not step[p]:
            step[p] = own
            p = link[p]
        if p:
            q = step[p]
            if length[q] == length[p] + 1:
                link[own] = q
            else:  # the strings of q that end here, too, get a state of their own
                copy = len(link)
                for g in go:
                    g.append(g[q])
                link.append(link[q]), length.append(length[p] + 1), first_end.append(first_end[q])
                while p and step[p] == q:
                    step[p] = copy
                    p = link[p]
                link[q] = link[own] = copy
        last = own
    return go, first_end


def lempel_ziv_array(bits: Sequence[bool]) -> int:
    """Phrases of the LZ76 parse; a last phrase that reaches the end is not counted.

    A phrase grows while it occurs with an earlier end, which a suffix automaton tells for each further symbol.
    """
    s = [int(b) for b in bits]
    go, first_end = suffix_automaton(s, 2)
    start, count, n = 0, 0, len(s)
    while start < n:
        end, state = start, 1
        while end < n:
            state = go[s[end]][state]
            if first_end[state] >= end:
                count += 1
                break
            end += 1
        start = end + 1
    return count


def lempel_ziv(df: DataFrame, keys: Sequence[str], idx: str, bit: str) -> DataFrame:
    """(keys, complexity, normalized) of boolean series."""

    def make(x: np.ndarray) -> dict:
        c, n = lempel_ziv_array(x), len(x)
        return {"complexity": c, "normalized": c / (n / np.log2(n)) if n > 1 else 0.0}

    return per_key(df, keys, idx, [bit], "complexity long, normalized double", make)


def longest_matches(s: Sequence[int], window: int) -> np.ndarray:
    """For each i, 1 plus the longest run from i that also starts in the window before i and ends there.

    For each lag, the lengths of all runs of equal symbols at that lag are found in one pass over arrays.
    """
    s = np.asarray(s)
    n = len(s)
    best = np.zeros(n, np.int64)
    for lag in range(1, min(window, n - 1) + 1):
        at = np.arange(n - lag)
        stop = np.where(s[lag:] == s[:-lag], n - lag, at)
        run = np.minimum.accumulate(stop[::-1])[::-1] - at
        np.maximum(best[lag:], np.minimum(run, lag), out=best[lag:])
    return best + 1


def longest_match_length(s: Sequence[int], i: int, window: int) -> int:
    """1 plus the longest run from i that also starts in the window before i and ends there; 0 at the borders."""
    return int(longest_matches(s, window)[i]) if 0 < i < len(s) else 0


def kontoyiannis_array(s: Sequence[int], window: int) -> float:
    if len(s) <= window or window < 1:
        return 0.0
    return float(np.mean(1 / longest_matches(s, window)[window:]) * np.log2(window))


def kontoyiannis_entropy(df: DataFrame, keys: Sequence[str], idx: str, symbol: str, window: int = 10) -> DataFrame:
    """(keys, entropy)."""
    return per_key(df, keys, idx, [symbol], "entropy double", lambda x: {"entropy": kontoyiannis_array(x, window)})


def adf_array(y: np.ndarray, lags: int) -> tuple[float, list[float]]:
    """t statistic of the level and all coefficients of the difference on constant, level and lagged differences."""
    d = np.diff(y)
    n = len(d) - lags
    if n <= lags + 2:
        return 0.0, []
    x = np.column_stack([np.ones(n), y[lags:-1], *[d[lags - k : len(d) - k] for k in range(1, lags + 1)]])
    t = d[lags:]
    g = x.T @ x
    if np.linalg.matrix_rank(g) < g.shape[0]:
        return 0.0, []
    inverse = np.linalg.inv(g)
    beta = inverse @ (x.T @ t)
    free = n - x.shape[1]
    error = np.sqrt(max(((t - x @ beta) ** 2).sum() / free * inverse[1, 1], 0.0)) if free > 0 else 0.0
    return (float(beta[1] / error) if error > 1e-15 else 0.0), beta.tolist()


def adf_test(df: DataFrame, keys: Sequence[str], idx: str, value: str, lags: int = 1) -> DataFrame:
    """(keys, statistic, betas)."""

    def make(x: np.ndarray) -> dict:
        t, b = adf_array(x, lags)
        return {"statistic": [t], "betas": [b]}

    return per_key(df, keys, idx, [value], "statistic double, betas array<double>", make)


def sadf(df: DataFrame, keys: Sequence[str], idx: str, value: str, min_window: int = 20, lags: int = 1) -> DataFrame:
    """(keys, end, statistic) of the test on every prefix of at least ``min_window`` rows."""
    made = lambda x: {"end": np.arange(min_window, len(x) + 1), "statistic": adf_ends(x.astype(float), lags, min_window)}
    return per_key(df, keys, idx, [value], "end long, statistic double", made)


def adf_ends(y: np.ndarray, lags: int, min_window: int) -> np.ndarray:
    """t statistics of ``adf_array(y[:e], lags)`` for every e from ``min_window``."""
    return adf_spans(y, lags, min_window, 1)[0]


#: Spans whose moments are held at once.
SPANS_AT_ONCE = 1 << 15


def adf_spans(y: np.ndarray, lags: int, min_window: int, starts: int) -> list[np.ndarray]:
    """t statistics of ``adf_array(y[s:e], lags)`` for the first starts s, and for each of them every e from s + ``min_window``.

    Moments run along the ends, for many starts at once, and the level is the last regressor to be eliminated, so that
    its t statistic is the last pivot's. Spans with pivots too small to trust, or an exact fit, are tested on their own.
    """
    out = [np.zeros(max(0, len(y) - s - min_window + 1)) for s in range(starts)]
    d, k = np.diff(y), lags + 2
    n = len(d) - lags
    first = max(k + 1, min_window - 1 - lags)  # rows of the shortest span that is tested
    if n < first:
        return out
    level = y[lags:-1]
    spread = d.std() or 1.0
    columns = [np.ones(n), *[d[lags - j : len(d) - j] / spread for j in range(1, lags + 1)], (level - level.mean()) / (level.std() or 1.0), d[lags:] / spread]
    step = max(1, SPANS_AT_ONCE // n)
    for low in range(0, min(starts, n - first + 1), step):
        own = np.arange(low, min(low + step, starts, n - first + 1))
        reach = n - low
        at = np.minimum(own[:, None] + np.arange(reach), n - 1)
        g = {}  # moments of the columns, the target last, for each start and number of rows
        for i in range(k + 1):
            for j in range(i, k + 1):
                g[i, j] = np.cumsum((columns[i] * columns[j])[at], axis=1)[:, first - 1 :]
        size = np.arange(first, reach + 1)
        real = own[:, None] + size <= n
        most = np.maximum.reduce([g[i, i] for i in range(k)])
        total = g[k, k].copy()
        good = real.copy()
        with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
            for i in range(k):
                good &= g[i, i] > 1e-7 * most
                if i < k - 1:
                    for j in range(i + 1, k + 1):
                        share = g[i, j] / g[i, i]
                        for m in range(j, k + 1):
                            g[j, m] = g[j, m] - share * g[i, m]
            pivot, slope = g[k - 1, k - 1], g[k - 1, k] / g[k - 1, k - 1]
            rest = g[k, k] - slope * g[k - 1, k]
            good &= rest > 1e-7 * total
            t = slope / np.sqrt(rest / (size - k) / pivot)
        t = np.where(good, t, 0.0)
        for a, b in zip(*np.nonzero(real & ~good), strict=True):
            t[a, b] = adf_array(y[own[a] : own[a] + size[b] + 1 + lags], lags)[0]
        for a, s in enumerate(own):
            count = n - s - first + 1
            out[s][len(out[s]) - count :] = t[a, :count]
    return out


#: Starts that one row of a series serves.
START_BLOCK = 64


def _spans_by_start(df: DataFrame, keys: Sequence[str], idx: str, value: str, min_window: int, lags: int, shape: str, made: Callable[[int, np.ndarray], dict], block: int) -> DataFrame:
    """``made(start, statistics)`` of every start of each key; the statistics are those of its ends from ``min_window`` rows on.

    A block of starts is one row that carries the key's series from its first start on, so a series is sent once for
    every ``block`` starts, and the blocks of a long key are spread. The tests of a block's starts come from moments that run along their ends.
    """
    ship_package(df.sparkSession)
    keys = list(keys)
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in (df.schema[k] for k in keys))
    series = df.groupBy(*keys).agg(F.transform(F.sort_array(F.collect_list(F.struct(idx, value))), lambda r: r[value]).alias("__y"))
    n = F.greatest(F.size("__y") - min_window + 1, F.lit(1))
    blocks = series.select(*keys, "__y", F.explode(F.sequence(F.lit(0), n - 1, F.lit(block))).alias("__start"))
    blocks = blocks.repartition(*keys, "__start").select(*keys, "__start", F.expr("slice(__y, __start + 1, size(__y))").alias("__y"))

    def rows(frame: pd.DataFrame, at: list[int], parts: list[list[dict]]) -> pd.DataFrame:
        out = pd.DataFrame({c: np.concatenate([p[c] for of_row in parts for p in of_row]) for c in parts[0][0]})
        again = np.repeat(at, [sum(len(next(iter(p.values()))) for p in of_row) for of_row in parts])
        for i, k in enumerate(keys):
            out.insert(i, k, frame[k].iloc[again].array)
        return out

    def run(frames):
        for frame in frames:
            at, parts, held = [], [], 0
            for row, (start, y) in enumerate(zip(frame["__start"].tolist(), frame["__y"], strict=True)):
                y = np.asarray(y, float)
                tests = adf_spans(y, lags, min_window, min(block, max(1, len(y) - min_window + 1)))
                at.append(row)
                parts.append([made(start + k, t) for k, t in enumerate(tests)])
                held += sum(map(len, tests)) + block
                if held > ROWS_AT_ONCE:
                    yield rows(frame, at, parts)
                    at, parts, held = [], [], 0
            if at:
                yield rows(frame, at, parts)

    return blocks.mapInPandas(run, f"{fields}, {shape}")


def gsadf(df: DataFrame, keys: Sequence[str], idx: str, value: str, min_window: int = 20, lags: int = 1, block: int = START_BLOCK) -> DataFrame:
    """(keys, start, end, statistic) of the test on every span [start, end) of at least ``min_window`` rows, where it is finite."""

    def made(start: int, stats: np.ndarray) -> dict:
        at = np.flatnonzero(np.isfinite(stats))
        return {"start": np.full(len(at), start), "end": start + min_window + at, "statistic": stats[at]}

    return _spans_by_start(df, keys, idx, value, min_window, lags, "start long, end long, statistic double", made, block)


def gsadf_stat(df: DataFrame, keys: Sequence[str], idx: str, value: str, min_window: int = 20, lags: int = 1, block: int = START_BLOCK) -> DataFrame:
    """(keys, statistic): the largest finite test over every span of at least ``min_window`` rows; minus infinity without any."""

    def made(start: int, stats: np.ndarray) -> dict:
        stats = stats[np.isfinite(stats)]
        return {"statistic": np.array([stats.max() if len(stats) else -np.inf])}

    return sup_statistic(_spans_by_start(df, keys, idx, value, min_window, lags, "statistic double", made, block), keys)


def sup_statistic(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, statistic): the largest finite one, minus infinity without any."""
    finite = (F.abs("statistic") < float("inf")) & ~F.isnan("statistic")
    return df.groupBy(*keys).agg(F.coalesce(F.max(F.when(finite, F.col("statistic"))), F.lit(float("-inf"))).alias("statistic"))


def fused(a, b, c):
    """a * b + c rounded once: the errors of the product and of the sum are added back, so what cancels leaves its exact rest."""
    halves = lambda v: (lambda high: (high, v - high))(v * 134217729.0 - (v * 134217729.0 - v))
    (ah, al), (bh, bl), product = halves(a), halves(b), a * b
    lost = ((ah * bh - product) + ah * bl + al * bh) + al * bl
    total = product + c
    part = total - product
    lost = lost + ((product - (total - part)) + (c - part))
    return np.where(np.isfinite(lost), total + lost, total)


def best_trends(idx: np.ndarray, price: np.ndarray, known: np.ndarray, first: np.ndarray, max_window: int, min_window: int) -> tuple[np.ndarray, ...]:
    """(enough, t, r_squared, window) of each row: the best of its windows ahead; ``first`` is where a row's key begins.

    Windows grow backwards from their last row, all of a batch at once, by running moments of their own prices alone.
    Window 0, where no price is known, has none. Where the true slope is 0, the sign is that of its rounding, which depends on
    the order of the rows: the queries' SQL goes from the last to the first, too, and rounds product and sum once.
    """
    rows = len(idx)
    count, mx, my, xx, xy, yy = (np.zeros(rows) for _ in range(6))
    enough, best, r2, window = np.zeros(rows, bool), np.full(rows, np.nan), np.full(rows, np.nan), np.zeros(rows, np.int64)
    for n in range(1, min(max_window, rows) + 1):
        if n > 1:  # one more row before each; the first end has none
            count, mx, my, xx, xy, yy = (v[1:] for v in (count, mx, my, xx, xy, yy))
        starts = rows - n + 1
        x, y, use, within = idx[:starts], price[:starts], known[:starts], first[n - 1 :] <= np.arange(starts)
        count = count + use
        size = np.maximum(count, 1)
        nx, ny = mx + (x - mx) / size, my + (y - my) / size
        moved = nx, ny, xx + (x - nx) * (x - mx), fused(x - mx, y - ny, xy), yy + (y - ny) * (y - my)
        mx, my, xx, xy, yy = (np.where(use, new, old) for new, old in zip(moved, (mx, my, xx, xy, yy), strict=True))
        if n < min_window:
            continue
        if n == min_window:
            enough[:starts] = within
        slope, sxx, sxy, syy = (xy / size) / (xx / size), size * (xx / size), size * (xy / size), size * (yy / size)
        rest = np.maximum(syy - slope * sxy, 0.0)
        flat = syy <= 1e-9
        t = np.where(flat, 0.0, np.where(rest <= 1e-12 * syy, np.sign(slope) * np.finfo(float).max, slope / np.sqrt(rest / (n - 2) / sxx)))
        old = best[:starts]
        better = within & (count > 0) & ~np.isnan(t) & (np.isnan(old) | (np.abs(t) > np.abs(old)))
        for kept, new in ((best, t), (r2, np.where(flat, 1.0, 1 - rest / syy)), (window, np.full(starts, n))):
            kept[:starts][better] = new[better]
    return enough, best, r2, window


def trend_scanning(df: DataFrame, keys: Sequence[str], idx: str, price: str, max_window: int = 20, min_window: int = 3) -> DataFrame:
    """(keys, idx, t_stat, label, best_window, r_squared): the window ahead whose linear trend is most significant.

    Spark sorts each key; a task holds a batch and the rows before it whose windows reach into it. The first of equal
    windows wins; rows with fewer than ``min_window`` values ahead are left out.
    """
    ship_package(df.sparkSession)
    keys = list(keys)
    read = df.select(*keys, F.col(idx).alias("idx"), F.col(price).cast("double").alias("__y"))
    made = StructType([f for f in read.schema if f.name != "__y"] + StructType.fromDDL("t_stat double, label int, best_window long, r_squared double").fields)
    schema = to_arrow_schema(made)

    def found(held: pa.RecordBatch, last: bool) -> tuple[pa.RecordBatch, pa.RecordBatch]:
        """The results of the rows whose windows are whole, and the rows that wait for more."""
        rows, starts = held.num_rows, key_starts(held.columns[: len(keys)])
        first = np.repeat(starts, np.diff([*starts, rows]))
        ready = rows if last else max(starts[-1], rows - max_window + 1)
        place, y = (held.column(c).to_numpy(zero_copy_only=False).astype(float) for c in ("idx", "__y"))
        with np.errstate(all="ignore"):
            enough, t, r2, window = best_trends(place, y, held.column("__y").is_valid().to_numpy(zero_copy_only=False), first, max_window, min_window)
        at = np.flatnonzero(enough[:ready])
        t, r2, window = t[at], r2[at], window[at]
        none = window == 0
        columns = [pa.array(v, mask=none) for v in (t, np.sign(np.where(none, 0.0, t)).astype(np.int32), window, r2)]
        return pa.RecordBatch.from_arrays([*(held.column(c).take(pa.array(at)) for c in [*keys, "idx"]), *columns], schema=schema), held.slice(ready)

    def run(batches):
        held = None
        for batch in batches:
            held = pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0] if held else batch
            if held.num_rows >= 2 * max_window:
                out, held = found(held, False)
                yield out
        if held:
            yield found(held, True)[0]

    return read.repartition(*keys).sortWithinPartitions(*keys, "idx").mapInArrow(run, made)


def hasbrouck_lambda(df: DataFrame, returns: str, sign: str, keys: Sequence[str], iterations: int = 1000, seed: int = 0) -> DataFrame:
    """(keys, lambda): mean of a Gibbs chain for the impact of signed trades, after a quarter of burn-in.

    The chain needs four sums per key, which Spark adds up; a draw depends on the seed and the key alone.
    """
    ship_package(df.sparkSession)
    keys = list(keys)
    sums = df.groupBy(*keys).agg(F.sum(F.col(sign) * F.col(sign)).alias("qq"), F.sum(F.col(sign) * F.col(returns)).alias("qr"), F.sum(F.col(returns) * F.col(returns)).alias("rr"), F.count(F.lit(1)).alias("n"), F.first(F.xxhash64(*keys)).alias("key_hash"))
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in (df.schema[k] for k in keys))

    def chains(frames):
        for frame in frames:
            out = []
            for r in frame.itertuples(index=False):
                out.append(gibbs_impact(r.qq, r.qr, r.rr, r.n, iterations, [seed, r.key_hash & 0xFFFFFFFFFFFFFFFF]))
            made = frame[keys].copy()
            made["lambda"] = out
            yield made

    return sums.mapInPandas(chains, f"{fields}, lambda double")


def gibbs_impact(qq: float, qr: float, rr: float, n: int, iterations: int, seed) -> float:
    if n < 2 or qq <= 1e-15:
        return 0.0
    rng, var, kept = np.random.default_rng(seed), max(rr / n, 1e-12), []
    for i in range(iterations):
        lam = rng.normal(qr / qq, np.sqrt(var / qq))
        ssr = max(rr - 2 * lam * qr + lam * lam * qq, 1e-12)
        var = ssr / rng.chisquare(n)
        if i >= iterations // 4:
            kept.append(lam)
    return float(np.mean(kept)) if kept else 0.0
