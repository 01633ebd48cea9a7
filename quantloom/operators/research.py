"""Clustering, model validation, resampling and simulation.

Independent trials, folds, features, grid cells and subsets are rows that Spark spreads over tasks; a draw depends on
the seed and the row's number, never on how the rows are dealt.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import InvalidParameter
from ..shipping import ship_package
from .carry import key_starts
from .series import numbered
from .matrix import cla_min_variance, correlation_matrix, hrp_from_moments, to_numpy


def trials(spark: SparkSession, n: int, shape: str, run: Callable[[int], Sequence[tuple]], tasks: int | None = None) -> DataFrame:
    """``run(trial)`` for trials 0 to n - 1 over the cluster; each gives rows of ``shape``, to which trial is added."""
    ship_package(spark)
    names = [c.split()[0] for c in shape.split(", ")]

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [(t, *r) for t in frame["id"].tolist() for r in run(t)]
            yield pd.DataFrame(rows, columns=["trial", *names])

    return spark.range(0, n, 1, tasks or max(1, min(n, spark.sparkContext.defaultParallelism))).mapInPandas(work, f"trial long, {shape}")


# --- clustering of small matrices ----------------------------------------------------------------------------------


def lloyd(x: np.ndarray, k: int, max_iter: int = 300, n_init: int = 10, seed: int = 42) -> tuple[np.ndarray, np.ndarray, int]:
    """(labels, centroids, iterations) of the restart with least inertia; an empty cluster keeps its centroid."""
    if not 1 <= k <= len(x):
        raise InvalidParameter(f"k = {k}")
    best = None
    for start in range(n_init):
        centroids = x[np.random.default_rng([seed, start]).permutation(len(x))[:k]].copy()
        labels = None
        for step in range(1, max_iter + 1):
            d = ((x[:, None, :] - centroids) ** 2).sum(2)
            new = d.argmin(1)
            if labels is not None and (new == labels).all():
                break
            labels = new
            for c in range(k):
                if (labels == c).any():
                    centroids[c] = x[labels == c].mean(0)
        inertia = ((x - centroids[labels]) ** 2).sum()
        if best is None or inertia < best[0]:
            best = (inertia, labels, centroids, step)
    return best[1], best[2], best[3]


def silhouette_values(x: np.ndarray, labels: np.ndarray) -> np.ndarray:
    d = np.sqrt(((x[:, None, :] - x) ** 2).sum(2))
    out = np.zeros(len(x))
    for i in range(len(x)):
        own = (labels == labels[i]) & (np.arange(len(x)) != i)
        others = [d[i, labels == c].mean() for c in np.unique(labels) if c != labels[i]]
        if others:
            a, b = d[i, own].mean() if own.any() else 0.0, min(others)
            out[i] = (b - a) / max(a, b) if max(a, b) > 1e-15 else 0.0
    return out


#: Rows of a tile of the silhouette at most, and tiles at least.
TILE, TILES = 8192, 32


def distance_sums(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each row of ``a`` the sum of its Euclidean distances to the rows of ``b``.

    Squares come from products of centred vectors; those that are small next to their terms are taken again from the
    differences. A distance to or from a row with a null counts as 0.
    """
    with_null = np.isnan(a).any(1), np.isnan(b).any(1)
    centre = np.nan_to_num(b).mean(0)
    a, b = np.nan_to_num(a) - centre, np.nan_to_num(b) - centre
    aa, bb = (a * a).sum(1), (b * b).sum(1)
    left = np.column_stack([-2.0 * a, aa, np.ones(len(a))])
    right = np.column_stack([b, np.ones(len(b)), bb])
    out = np.zeros(len(a))
    for j in range(0, len(b), 512):
        for i in range(0, len(a), 256):
            d = left[i : i + 256] @ right[j : j + 512].T
            near = d < 1e-6 * (aa[i : i + 256].max() + bb[j : j + 512].max())
            if near.any():
                u, w = np.nonzero(near)
                d[u, w] = ((a[i + u] - b[j + w]) ** 2).sum(1)
            np.sqrt(d, out=d)
            if with_null[1].any():
                d[:, with_null[1][j : j + 512]] = 0.0
            out[i : i + 256] += d.sum(1)
    out[with_null[0]] = 0.0
    return out


class SilhouetteTile:
    """Rows that meet all rows, label by label: only the sums over the label at hand and the best so far are kept."""

    def __init__(self):
        self.held, self.x, self.label, self.n = [], None, None, 0

    def hold(self, label, x: np.ndarray) -> None:
        self.held.append((label, x))

    def meet(self, label, x: np.ndarray) -> None:
        if self.x is None:
            self.x = np.concatenate([v for _, v in self.held])
            self.own = [(c, len(v)) for c, v in self.held]
            self.held, self.a, self.b = None, np.zeros(len(self.x)), np.full(len(self.x), np.inf)
        if self.n == 0 or label != self.label:
            self.close()
            self.label, self.n, self.total = label, 0, np.zeros(len(self.x))
        self.total += distance_sums(self.x, x)
        self.n += len(x)

    def close(self) -> None:
        if self.n:
            at = 0
            for label, size in self.own:
                to = slice(at, at + size)
                if label == self.label:
                    self.a[to] = self.total[to] / (self.n - 1) if self.n > 1 else 0.0
                else:
                    self.b[to] = np.minimum(self.b[to], self.total[to] / self.n)
                at += size

    def values(self) -> np.ndarray:
        self.close()
        most = np.maximum(self.a, self.b)
        with np.errstate(invalid="ignore"):
            return np.where(np.isfinite(self.b) & (most > 1e-15), (self.b - self.a) / most, 0.0)


def silhouette_score(df: DataFrame, features: Sequence[str], label: str, row: str) -> DataFrame:
    """(silhouette): mean over all rows, from mean distances of every row to every cluster.

    The distances of a row to a cluster need all its rows: the work is quadratic by definition. Rows are dealt to tiles,
    and each tile is a task that holds its own rows and reads all rows, sorted by label, batch by batch: a row is
    sent once for each tile, distances are products of blocks of vectors, and nothing but a row's value leaves a task.
    """
    ship_package(df.sparkSession)
    vector = F.array(*[F.col(c).cast("double") for c in features])
    rows = df.select(F.xxhash64(row).alias("hash"), F.col(label).alias("label"), vector.alias("v"))
    tiles = max(TILES, -(-rows.count() // TILE))
    own = rows.select(F.pmod("hash", F.lit(tiles)).cast("int").alias("tile"), F.lit(0).alias("side"), "label", "v")
    met = rows.select(F.explode(F.sequence(F.lit(0), F.lit(tiles - 1))).alias("tile"), F.lit(1).alias("side"), "label", "v")
    laid = own.unionByName(met).repartitionById(tiles, "tile").sortWithinPartitions("tile", "side", "label")
    width = len(features)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, at = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            tile, side, labels = batch.columns[:3]
            x = batch.column(3).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, width)
            for a, b in itertools.pairwise([*key_starts([tile, side, labels]), batch.num_rows]):
                if made is None or at != tile[a].as_py():
                    if made is not None and made.x is not None:
                        yield pa.RecordBatch.from_arrays([pa.array(made.values())], ["value"])
                    made, at = SilhouetteTile(), tile[a].as_py()
                if side[a].as_py() == 0:
                    made.hold(labels[a].as_py(), x[a:b])
                elif made.x is not None or made.held:
                    made.meet(labels[a].as_py(), x[a:b])
        if made is not None and made.x is not None:
            yield pa.RecordBatch.from_arrays([pa.array(made.values())], ["value"])

    return laid.mapInArrow(run, "value double").agg(F.avg("value").alias("silhouette"))


def cluster_base(corr: np.ndarray, low: int = 2, high: int | None = None, n_init: int = 10, seed: int = 42) -> tuple[np.ndarray, float]:
    """Labels of the number of clusters, low to high (half the rows), with the best mean silhouette."""
    high = max(low, min(high or len(corr) // 2, len(corr) - 1))
    best = None
    for k in range(low, high + 1):
        labels, _, _ = lloyd(corr, min(k, len(corr)), n_init=n_init, seed=seed)
        score = silhouette_values(corr, labels).mean()
        if best is None or score > best[1]:
            best = (labels, score)
    return best


def cluster_top(corr: np.ndarray, high: int | None = None, n_init: int = 10, seed: int = 42) -> tuple[np.ndarray, float]:
    """The base clustering, with each cluster of over two members split again where that raises the overall score."""
    labels, score = cluster_base(corr, 2, high, n_init, seed)
    for c in sorted(set(labels.tolist())):
        members = np.flatnonzero(labels == c)
        if len(members) > 2:
            sub, _ = cluster_base(corr[np.ix_(members, members)], 2, None, n_init, seed)
            tried = labels.copy()
            tried[members] = labels.max() + 1 + sub
            if (new := silhouette_values(corr, tried).mean()) > score:
                labels, score = tried, new
    return np.unique(labels, return_inverse=True)[1], float(score)


def feature_clusters(df: DataFrame, columns: Sequence[str], high: int | None = None, seed: int = 42) -> DataFrame:
    """(i, cluster, silhouette) of the columns: their correlations from Spark, clusters of the k x k matrix."""
    labels, score = cluster_top(to_numpy(correlation_matrix(df, columns)), high, seed=seed)
    return df.sparkSession.createDataFrame([(i, int(c), float(score)) for i, c in enumerate(labels)], "i int, cluster int, silhouette double")


# --- validation ----------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Cpcv:
    """Combinatorial purged cross-validation: every choice of test groups."""

    n_groups: int
    n_test: int

    def splits(self) -> list[tuple[list[int], list[int]]]:
        """(train, test) groups, in lexicographic order of the test groups."""
        if not 0 < self.n_test < self.n_groups:
            return []
        return [([g for g in range(self.n_groups) if g not in c], list(c)) for c in itertools.combinations(range(self.n_groups), self.n_test)]

    def num_paths(self) -> int:
        return math.comb(self.n_groups, self.n_test) * self.n_test // self.n_groups if 0 < self.n_test <= self.n_groups else 0

    def frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(self.splits())], "split int, train array<int>, test array<int>")


def build_paths(test_groups: Sequence[Sequence[int]], n_groups: int, most: int = 10_000) -> list[list[int]]:
    """Sets of splits whose test groups cover every group exactly once."""
    out: list[list[int]] = []

    def extend(chosen: list[int], covered: set[int]) -> None:
        if len(out) >= most:
            return
        if len(covered) == n_groups:
            out.append(chosen)
            return
        first = min(g for g in range(n_groups) if g not in covered)
        for i, groups in enumerate(test_groups):
            if first in groups and not covered & set(groups):
                extend([*chosen, i], covered | set(groups))

    if test_groups and n_groups % len(test_groups[0]) == 0:
        extend([], set())
    return out


def mean_decrease_impurity(df: DataFrame, feature: str, importance: str) -> DataFrame:
    """(feature, importance): the mean over trees of rows (tree, feature, importance)."""
    return df.groupBy(feature).agg(F.avg(importance).alias("importance"))


def orthogonal_features(df: DataFrame, columns: Sequence[str], n: int) -> tuple[DataFrame, DataFrame]:
    """Rows with components pc0 ... and (component, ratio): principal components of the centred columns."""
    from .matrix import covariance_matrix, eigen

    cov = to_numpy(covariance_matrix(df, columns))
    values, vectors = eigen(cov, n)
    means = df.agg(*[F.avg(c).alias(c) for c in columns]).first()
    pcs = [sum(((F.col(c) - F.lit(means[c])) * F.lit(float(vectors[i, k])) for i, c in enumerate(columns)), F.lit(0.0)).alias(f"pc{k}") for k in range(len(values))]
    ratio = values / np.trace(cov)
    return df.select("*", *pcs), df.sparkSession.createDataFrame([(k, float(r)) for k, r in enumerate(ratio)], "component int, ratio double")


def grid_search(spark: SparkSession, grids: Sequence[tuple[str, Sequence[float]]], score: Callable[[dict[str, float]], float]) -> DataFrame:
    """(trial, params, score) of every combination, in order of the grids; sort by (-score, trial) for the best."""
    names, sizes = [g[0] for g in grids], [len(g[1]) for g in grids]
    n = math.prod(sizes) if grids else 0

    def run(t: int) -> list[tuple]:
        params, rest = {}, t
        for (name, values), size in zip(reversed(grids), reversed(sizes), strict=True):
            params[name], rest = values[rest % size], rest // size
        return [({k: float(params[k]) for k in names}, float(score(params)))]

    return trials(spark, n, "params map<string,double>, score double", run)


def random_search(spark: SparkSession, ranges: Sequence[tuple[str, float, float]], n: int, score: Callable[[dict[str, float]], float], seed: int = 0) -> DataFrame:
    """(trial, params, score) of uniform draws."""

    def run(t: int) -> list[tuple]:
        rng = np.random.default_rng([seed, t])
        params = {name: float(rng.uniform(low, high)) for name, low, high in ranges}
        return [(params, float(score(params)))]

    return trials(spark, n, "params map<string,double>, score double", run)


def best_trial(scored: DataFrame) -> DataFrame:
    """The row with the best score, the first of equals."""
    return scored.orderBy(F.desc("score"), "trial").limit(1)


@dataclass(frozen=True)
class LogUniform:
    low: float
    high: float

    def __post_init__(self):
        if self.low <= 0 or self.high <= self.low:
            raise InvalidParameter(f"{self}")

    def sample(self, rng: np.random.Generator) -> float:
        return float(np.exp(rng.uniform(np.log(self.low), np.log(self.high))))

    def frame(self, spark: SparkSession, n: int, seed: int = 0) -> DataFrame:
        return trials(spark, n, "value double", lambda t: [(self.sample(np.random.default_rng([seed, t])),)])


def make_classification(spark: SparkSession, n: int, n_informative: int, n_redundant: int, n_noise: int, seed: int = 0) -> DataFrame:
    """(trial, x, y): features in an array, labels -1 and 1 by a noisy linear rule."""
    rng = np.random.default_rng([seed, 1 << 32])
    w, mix = rng.normal(size=n_informative), rng.normal(size=(n_informative, n_redundant))

    def run(t: int) -> list[tuple]:
        r = np.random.default_rng([seed, t])
        a = r.normal(size=n_informative)
        y = 1.0 if a @ w + 0.1 * r.normal() > 0 else -1.0
        return [([*a.tolist(), *(a @ mix + 0.01 * r.normal(size=n_redundant)).tolist(), *r.normal(size=n_noise).tolist()], y)]

    return trials(spark, n, "x array<double>, y double", run)


# --- resampling and simulation -------------------------------------------------------------------------------------


def standard_bootstrap(df: DataFrame, idx: str, n_rows: int, n_samples: int, seed: int = 0) -> DataFrame:
    """Rows drawn with replacement, by position: draws are joined to the rows, so no row set is gathered."""
    draws = trials(df.sparkSession, n_samples, "idx long", lambda t: [(int(np.random.default_rng([seed, t]).integers(n_rows)),)])
    return df.join(draws.select("trial", F.col("idx").alias("__idx")), df[idx] == F.col("__idx")).drop("__idx")


def sequential_draws(spans: Sequence[tuple[int, int]], n_bars: int, n: int, rng: np.random.Generator) -> list[int]:
    """Events drawn one by one, each with probability by its uniqueness given those drawn before.

    An event is drawn evenly and taken with its uniqueness, which is at most 1, as probability; otherwise another one is
    drawn. That is the same distribution, and a draw looks at the bars of a few events in place of all.
    """
    chosen, tries, k = [], 1 << 12, 1 << 12
    ends = [(a, b + 1) for a, b in spans]
    full = any(a < b for a, b in ends)
    short = sum(b - a for a, b in ends) <= 32 * len(ends)  # then lists are faster than arrays
    cover = [0] * n_bars if short else np.zeros(n_bars)
    inverse = [1.0] * n_bars if short else np.ones(n_bars)
    while len(chosen) < n:
        if k == tries:
            drawn, luck, k = rng.integers(len(ends), size=tries).tolist(), rng.random(tries).tolist(), 0
        i, u, k = drawn[k], luck[k], k + 1
        a, b = ends[i]
        if full and (a >= b or u * (b - a) >= (sum(inverse[a:b]) if short else inverse[a:b].sum())):
            continue  # without any bars all are drawn evenly
        chosen.append(i)
        if short:
            for j in range(a, b):
                cover[j] += 1
                inverse[j] = 1 / (1 + cover[j])
        elif a < b:
            cover[a:b] += 1
            inverse[a:b] = 1 / (1 + cover[a:b])
    return chosen


def mean_uniqueness(spans: Sequence[tuple[int, int]], chosen: Sequence[int], n_bars: int) -> float:
    if not len(chosen):
        return 0.0
    first, stop = np.asarray(spans)[chosen].T + np.array([[0], [1]])
    stop = np.maximum(first, stop)
    steps = np.bincount(first, minlength=n_bars + 1) - np.bincount(stop, minlength=n_bars + 1)
    upto = np.concatenate([[0.0], np.cumsum(1 / np.maximum(np.cumsum(steps)[:n_bars], 1))])
    return float(np.mean((upto[stop] - upto[first]) / np.maximum(stop - first, 1)))


def clamped_spans(start: np.ndarray, end: np.ndarray, n_bars: int | None) -> tuple[list[tuple[int, int]], int]:
    """Spans that end at the last bar at most, and the number of bars: by default up to the key's last start."""
    bars = int(start.max()) + 1 if n_bars is None else n_bars
    return [(int(a), min(int(b), bars - 1)) for a, b in zip(start, end, strict=True)], bars


def sequential_bootstrap(events: DataFrame, keys: Sequence[str], n_bars: int | None = None, n: int | None = None, seed: int = 0) -> DataFrame:
    """(keys, draw, event_id): one sequential bootstrap per key, keys in parallel; by default of as many draws as events."""
    from .scans import per_key

    def make(event_id: np.ndarray, start: np.ndarray, end: np.ndarray) -> dict:
        spans, bars = clamped_spans(start, end, n_bars)
        draws = len(spans) if n is None else n
        chosen = sequential_draws(spans, bars, draws, np.random.default_rng([seed, int(start.sum()) & 0xFFFFFFFF]))
        return {"draw": np.arange(draws), "event_id": event_id[chosen]}

    return per_key(events, keys, "event_id", ["event_id", "start", "end"], "draw long, event_id long", make)


def compare_bootstraps(events: DataFrame, keys: Sequence[str], n_bars: int | None, n: int | None, n_trials: int, seed: int = 0) -> DataFrame:
    """(keys, sequential, standard): mean uniqueness of both bootstraps over trials; defaults as for one bootstrap."""
    from .scans import per_key

    def make(start: np.ndarray, end: np.ndarray) -> dict:
        spans, bars = clamped_spans(start, end, n_bars)
        draws = len(spans) if n is None else n
        pairs = np.array(spans)
        seq, std = [], []
        for t in range(n_trials):
            rng = np.random.default_rng([seed, t])
            seq.append(mean_uniqueness(pairs, sequential_draws(spans, bars, draws, rng), bars))
            std.append(mean_uniqueness(pairs, rng.integers(len(spans), size=draws).tolist(), bars))
        return {"sequential": float(np.mean(seq)), "standard": float(np.mean(std))}

    return per_key(events, keys, "event_id", ["start", "end"], "sequential double, standard double", make)


def ou_path(theta: float, mu: float, sigma: float, x0: float, dt: float, n: int, rng: np.random.Generator) -> np.ndarray:
    """Euler steps of a mean-reverting walk; the start alone for bad parameters."""
    if theta <= 0 or sigma < 0 or dt <= 0 or n < 1:
        return np.array([x0])
    noise, out = rng.normal(size=n) * sigma * math.sqrt(dt), np.empty(n + 1)
    out[0] = x0
    for i in range(n):
        out[i + 1] = out[i] + theta * (mu - out[i]) * dt + noise[i]
    return out


def simulate_ou(spark: SparkSession, theta: float, mu: float, sigma: float, x0: float, dt: float, n: int, paths: int = 1, seed: int = 0) -> DataFrame:
    """(trial, step, value)."""
    return trials(spark, paths, "step long, value double", lambda t: list(enumerate(ou_path(theta, mu, sigma, x0, dt, n, np.random.default_rng([seed, t])).tolist())))


def otr_mesh(params: DataFrame, profit_takes: Sequence[float], stop_losses: Sequence[float], n_simulations: int, seed: int = 0, dt: float = 0.01, steps: int = 10_000) -> DataFrame:
    """(keys of params, i, j, sharpe): the Sharpe ratio of exits at each profit taking and stop loss.

    params: key, theta, mu, sigma; paths start at mu, and one that touches neither barrier returns 0. Every key, cell and
    path is a row, so the mesh is spread evenly.
    """
    ship_package(params.sparkSession)
    ni, nj = len(profit_takes), len(stop_losses)
    cells = params.select("key", "theta", "mu", "sigma", F.explode(F.sequence(F.lit(0), F.lit(ni * nj * n_simulations - 1))).alias("cell"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for r in frame.itertuples(index=False):
                i, j = r.cell // n_simulations // nj, r.cell // n_simulations % nj
                gain = ou_path(r.theta, r.mu, r.sigma, r.mu, dt, steps, np.random.default_rng([seed, r.cell])) - r.mu
                hit = np.flatnonzero((gain >= profit_takes[i]) | (gain <= -stop_losses[j]))
                out.append((r.key, i, j, float(gain[hit[0]]) if len(hit) else 0.0))
            yield pd.DataFrame(out, columns=["key", "i", "j", "ret"])

    kind = params.schema["key"].dataType.simpleString()
    drawn = cells.mapInPandas(run, f"key {kind}, i int, j int, ret double")
    s = F.stddev_samp("ret")
    return drawn.groupBy("key", "i", "j").agg(F.coalesce(F.when(s > 1e-15, F.avg("ret") / s), F.lit(0.0)).alias("sharpe"))


def compare_allocations(returns: np.ndarray, spark: SparkSession, n_simulations: int, seed: int = 0) -> DataFrame:
    """(trial, method, sharpe, variance): allocations fitted on a noisy first half, judged on the second.

    The matrix of returns is small (dates x assets) and travels with the plan; trials are spread.
    """
    half = len(returns) // 2

    def run(t: int) -> list[tuple]:
        x = returns + np.random.default_rng([seed, t]).normal(0, 0.01, returns.shape)
        a, b = x[:half], x[half:]
        cov = np.cov(a, rowvar=False)
        inverse = 1 / np.maximum(np.diag(cov), 1e-15)
        out = []
        for name, w in (("hrp", hrp_from_moments(np.corrcoef(a, rowvar=False), cov)), ("cla", cla_min_variance(cov)), ("ivp", inverse / inverse.sum())):
            p = b @ w
            out.append((name, float(p.mean() / p.std(ddof=1)) if p.std(ddof=1) > 1e-15 else 0.0, float(p.var(ddof=1))))
        return out

    return trials(spark, n_simulations, "method string, sharpe double, variance double", run)


def backtest_splits(returns: DataFrame, idx: str, n_groups: int, shuffle_seed: int | None = None) -> DataFrame:
    """(split, strategy, inside, outside): sums of each strategy's returns on half the groups and on the others.

    returns: idx, strategy, ret. Groups are contiguous, the last takes the rest; with a seed rows are dealt to groups in
    a random order. Sums per group are made once; every choice of half the groups only adds them up.
    """
    if n_groups < 2 or n_groups % 2:
        raise InvalidParameter("an even number of groups")
    rows = returns.select(F.col(idx).alias("idx")).distinct()
    if shuffle_seed is None:
        rows = rows.withColumn("__o", F.col("idx"))
    else:
        rows = rows.withColumn("__o", F.md5(F.concat_ws(":", F.lit(shuffle_seed), F.col("idx").cast("string"))))
    placed = numbered(rows, ["__o", "idx"], "__at")
    n = placed.count()
    placed = placed.select("idx", F.least(F.floor(F.col("__at") / max(1, n // n_groups)), F.lit(n_groups - 1)).cast("int").alias("g"))
    sums = returns.withColumnRenamed(idx, "idx").join(placed, "idx").groupBy("strategy", "g").agg(F.sum("ret").alias("s"))
    per = sums.groupBy("strategy").agg(F.map_from_entries(F.collect_list(F.struct("g", "s"))).alias("m"))
    combos = list(itertools.combinations(range(n_groups), n_groups // 2))
    each = per.select("strategy", "m", F.posexplode(F.array(*[F.array(*map(F.lit, c)) for c in combos])).alias("split", "c"))
    add = lambda keep: F.aggregate(F.filter(F.map_entries("m"), lambda e: F.array_contains("c", e["key"]) == F.lit(keep)), F.lit(0.0), lambda a, e: a + e["value"])
    return each.select("split", "strategy", add(True).alias("inside"), add(False).alias("outside"))


def cscv(returns: DataFrame, idx: str, n_groups: int) -> DataFrame:
    """(split, rank, logit, overfit): where the best strategy inside ranks outside; the last of equals is the best."""
    s = backtest_splits(returns, idx, n_groups)
    best = s.groupBy("split").agg(F.max(F.struct("inside", "strategy", "outside")).alias("b"), F.count(F.lit(1)).alias("n"))
    ranked = s.join(best, "split").groupBy("split", "n").agg((F.sum((F.col("outside") > F.col("b.outside")).cast("long")) + 1).alias("rank"))
    return ranked.select("split", "rank", F.log(F.col("rank") / (F.col("n") + 1 - F.col("rank"))).alias("logit"), (F.col("rank") > F.floor(F.col("n") / 2)).alias("overfit"))


def probability_of_backtest_overfitting(returns: DataFrame, idx: str, n_groups: int, seed: int = 0) -> DataFrame:
    """(pbo): the share of splits whose best strategy inside is in the lower half outside, rows dealt at random."""
    s = backtest_splits(returns, idx, n_groups, seed)
    best = s.groupBy("split").agg(F.max(F.struct("inside", "strategy", "outside")).alias("b"), F.count(F.lit(1)).alias("n"))
    ranked = s.join(best, "split").groupBy("split", "n").agg(F.sum((F.col("outside") <= F.col("b.outside")).cast("long")).alias("rank"))
    return ranked.agg(F.avg((F.col("rank") <= F.floor(F.col("n") / 2)).cast("double")).alias("pbo"))


# --- combinatorics -------------------------------------------------------------------------------------------------


def lin_parts(spark: SparkSession, n_atoms: int, n_parts: int) -> DataFrame:
    """(part, start, end): contiguous ranges of nearly equal size."""
    k = max(1, min(n_parts, n_atoms)) if n_atoms > 0 else 0
    return spark.range(k).select(F.col("id").alias("part"), F.floor(F.col("id") * n_atoms / max(k, 1)).cast("long").alias("start"), F.floor((F.col("id") + 1) * n_atoms / max(k, 1)).cast("long").alias("end"))


def nested_parts(n_atoms: int, n_parts: int, upper: bool = False) -> list[tuple[int, int]]:
    """Ranges of rows of a triangle with nearly equal areas."""
    if n_atoms <= 0:
        return []
    k, edges = max(1, min(n_parts, n_atoms)), [0]
    for _ in range(k):
        last = edges[-1]
        edges.append(min(n_atoms, max(last + 1, round((-1 + math.sqrt(1 + 4 * (last * last + last + n_atoms * (n_atoms + 1) / k))) / 2))) if last < n_atoms else n_atoms)
    edges[-1] = n_atoms
    parts = [(a, b) for a, b in zip(edges, edges[1:], strict=False) if b > a]
    return [(n_atoms - b, n_atoms - a) for a, b in reversed(parts)] if upper else parts


def mp_apply(df: DataFrame, func: Callable[[pd.DataFrame], pd.DataFrame], shape: str) -> DataFrame:
    """``func`` on every Arrow batch, wherever it lies."""
    ship_package(df.sparkSession)
    return df.mapInPandas(lambda frames: map(func, frames), shape)


def process_jobs(spark: SparkSession, jobs: Sequence, func: Callable) -> DataFrame:
    """(trial, ok, error): ``func`` of each job on the cluster; an error is a row, not the end of the run."""

    def run(t: int) -> list[tuple]:
        try:
            return [(float(func(jobs[t])), None)]
        except Exception as error:  # reported, by contract
            return [(None, f"{type(error).__name__}: {error}")]

    return trials(spark, len(jobs), "ok double, error string", run)


def cartesian_product(frames: Sequence[DataFrame]) -> DataFrame | None:
    """Every combination of rows: the product is the result, so its size is the input's to bound."""
    out = None
    for frame in frames:
        out = frame if out is None else out.crossJoin(frame)
    return out


def index_product(spark: SparkSession, dims: Sequence[int]) -> DataFrame:
    """(i0, i1, ...) of a grid, from one range by division."""
    n, columns, rest = math.prod(dims), [], F.col("id")
    for k in reversed(range(len(dims))):
        columns.insert(0, F.pmod(rest, F.lit(dims[k])).cast("long").alias(f"i{k}"))
        rest = F.floor(rest / dims[k])
    return spark.range(n).select(*columns) if columns else spark.range(1).select()


def compositions(n: int, k: int) -> list[list[int]]:
    """All ways to write k as n ordered parts of 0 or more, in lexicographic order."""
    if n < 1:
        raise InvalidParameter("n")
    return [[k]] if n == 1 else [[i, *rest] for i in range(k + 1) for rest in compositions(n - 1, k - i)]


def random_matrix_of_rank(rows: int, cols: int, rank: int, seed: int = 0) -> np.ndarray:
    rng = np.random.default_rng(seed)
    return rng.normal(size=(rows, rank)) @ rng.normal(size=(rank, cols))


def trajectories(starts: DataFrame, state: str, moves: Sequence[float], steps: int) -> DataFrame:
    """Every path of ``steps`` moves from each row's state, as the array ``path``: rows times moves to the power of steps."""
    out = starts.withColumn("path", F.array(F.col(state).cast("double")))
    for _ in range(steps):
        out = out.withColumn("__m", F.explode(F.array(*[F.lit(float(m)) for m in moves]))).withColumn("path", F.concat("path", F.array(F.element_at("path", -1) + F.col("__m")))).drop("__m")
    return out


def expected_value(paths: DataFrame, payoff, keys: Sequence[str]) -> DataFrame:
    """(keys, value): the mean of a payoff Column over all paths."""
    return paths.groupBy(*keys).agg(F.coalesce(F.avg(payoff), F.lit(0.0)).alias("value"))


def kmeans_rows(df: DataFrame, features: Sequence[str], k: int, max_iter: int = 300, seed: int = 42) -> DataFrame:
    """``df`` with a column ``cluster``: k-means over all rows, for data too large for one matrix."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import VectorAssembler

    assembled = VectorAssembler(inputCols=list(features), outputCol="__features").transform(df)
    model = KMeans(k=k, maxIter=max_iter, seed=seed, featuresCol="__features", predictionCol="cluster").fit(assembled)
    return model.transform(assembled).drop("__features")
