"""Covariance, dependence, denoising and allocation.

Observations are wide rows of k asset columns. Spark adds up the k x k moments over all rows; what is left, eigenvalues
of a k x k matrix or a tree over k leaves, is NumPy on k x k numbers. Matrices leave as long rows (i, j, value).
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..errors import ComputationFailed, DimensionMismatch, InsufficientData, InvalidParameter, NotPositiveDefinite
from ..functions.aggregates import pearson
from ..functions.scalars import absolute_angular_distance_from_corr, angular_distance_from_corr, squared_angular_distance_from_corr


def _pairs(df: DataFrame, columns: Sequence[str], make) -> DataFrame:
    """One aggregate with a term for each pair i <= j, spread to long rows."""
    k = len(columns)
    sums = df.agg(*[make(columns[i], columns[j]).alias(f"m{i}_{j}") for i in range(k) for j in range(i, k)])
    cells = [F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.col(f"m{min(i, j)}_{max(i, j)}").alias("value")) for i in range(k) for j in range(k)]
    return sums.select(F.inline(F.array(*cells)))


def covariance_matrix(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(i, j, value), divisor n - 1."""
    return _pairs(df, columns, lambda a, b: F.covar_samp(a, b))


cov_matrix = covariance_matrix


def correlation_matrix(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(i, j, value); 1 on the diagonal, 0 for columns without spread."""
    return _pairs(df, columns, lambda a, b: F.lit(1.0) if a == b else pearson(a, b))


def to_numpy(matrix: DataFrame) -> np.ndarray:
    """A k x k matrix of long rows on the driver; k is the number of columns, not of rows of data."""
    rows = matrix.collect()
    k = max((r["i"] for r in rows), default=-1) + 1
    out = np.zeros((k, k))
    for r in rows:
        out[r["i"], r["j"]] = r["value"]
    return out


def to_frame(spark: SparkSession, matrix: np.ndarray) -> DataFrame:
    return spark.createDataFrame([(i, j, float(matrix[i, j])) for i in range(matrix.shape[0]) for j in range(matrix.shape[1])], "i int, j int, value double")


def vector_frame(spark: SparkSession, vector: np.ndarray, name: str = "weight") -> DataFrame:
    return spark.createDataFrame([(i, float(v)) for i, v in enumerate(vector)], f"i int, {name} double")


def distance_matrix(corr: DataFrame, metric: str = "angular") -> DataFrame:
    """Angular, absolute_angular or squared_angular distances of a long correlation matrix."""
    kinds = {"angular": angular_distance_from_corr, "absolute_angular": absolute_angular_distance_from_corr, "squared_angular": squared_angular_distance_from_corr}
    if metric not in kinds:
        raise InvalidParameter(metric)
    return corr.withColumn("value", kinds[metric]("value"))


def norm_distance(a: DataFrame, b: DataFrame) -> DataFrame:
    """(distance): Frobenius norm of the difference over the size."""
    d = a.alias("a").join(b.alias("b"), ["i", "j"]).agg(F.sqrt(F.sum(F.pow(F.col("a.value") - F.col("b.value"), F.lit(2.0)))).alias("s"), (F.max("i") + 1).alias("n"))
    return d.select((F.col("s") / F.col("n")).alias("distance"))


def cov_to_corr(cov: DataFrame) -> DataFrame:
    """(i, j, value, std_i): correlations and deviations; without spread 1 on the diagonal and 0 beside it."""
    std = cov.where("i = j").select(F.col("i").alias("k"), F.sqrt(F.greatest("value", F.lit(0.0))).alias("std"))
    d = cov.join(F.broadcast(std.select(F.col("k").alias("i"), F.col("std").alias("std_i"))), "i").join(F.broadcast(std.select(F.col("k").alias("j"), F.col("std").alias("std_j"))), "j")
    spread = (F.col("std_i") > 1e-15) & (F.col("std_j") > 1e-15)
    return d.select("i", "j", F.when(F.col("i") == F.col("j"), F.lit(1.0)).when(spread, F.col("value") / (F.col("std_i") * F.col("std_j"))).otherwise(F.lit(0.0)).alias("value"), "std_i")


def corr_to_cov(corr: DataFrame, std: DataFrame) -> DataFrame:
    """std: (k, std)."""
    return corr.join(std.select(F.col("k").alias("i"), F.col("std").alias("__a")), "i").join(std.select(F.col("k").alias("j"), F.col("std").alias("__b")), "j").select("i", "j", (F.col("value") * F.col("__a") * F.col("__b")).alias("value"))


def marcenko_pastur_pdf(spark: SparkSession, var: float, q: float, points: int) -> DataFrame:
    """(x, pdf) on an even grid over the support, 0 at its ends."""
    if q <= 0 or var <= 0 or points < 2:
        raise InvalidParameter("var, q or points")
    low, high = var * (1 - (1 / q) ** 0.5) ** 2, var * (1 + (1 / q) ** 0.5) ** 2
    x = F.lit(low) + F.col("id") * F.lit((high - low) / (points - 1))
    inside = F.greatest((F.lit(high) - F.col("x")) * (F.col("x") - F.lit(low)), F.lit(0.0))
    pdf = F.when(F.col("x") > 0, q / (2 * np.pi * var * F.col("x")) * F.sqrt(inside)).otherwise(F.lit(0.0))
    return spark.range(points).select("id", x.alias("x")).select("x", F.when((F.col("id") == 0) | (F.col("id") == points - 1), F.lit(0.0)).otherwise(pdf).alias("pdf"))


def fit_kde(observations: DataFrame, value: str, points: Sequence[float], bandwidth: float) -> DataFrame:
    """(x, density): Gaussian kernel density at given points; the points travel with each row as one array."""
    z = lambda p: (F.lit(float(p)) - F.col(value)) / bandwidth
    terms = [F.avg(F.exp(-0.5 * z(p) * z(p))) / (bandwidth * (2 * np.pi) ** 0.5) for p in points]
    sums = observations.agg(*[t.alias(f"d{i}") for i, t in enumerate(terms)])
    return sums.select(F.inline(F.array(*[F.struct(F.lit(float(p)).alias("x"), F.col(f"d{i}").alias("density")) for i, p in enumerate(points)])))


def inverse_variance_weights(cov: DataFrame) -> DataFrame:
    """(i, weight); without any variance all weigh the same, and an asset without gets 0."""
    inverse = F.when(F.col("value") > 0, 1 / F.col("value")).otherwise(F.lit(0.0))
    w = Window.partitionBy(F.lit(0))
    d = cov.where("i = j").select("i", inverse.alias("v"))
    total = F.sum("v").over(w)
    return d.select("i", F.when(total > 0, F.col("v") / total).otherwise(1 / F.count(F.lit(1)).over(w)).alias("weight"))


# --- k x k numbers -----------------------------------------------------------------------------------------------


def eigen(matrix: np.ndarray, n: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues by falling size and their vectors in columns, each turned towards sin(1), sin(2), ... shifted by its rank."""
    values, vectors = np.linalg.eigh(matrix)
    order = np.argsort(-np.abs(values), kind="stable")[: n or len(values)]
    values, vectors = values[order], vectors[:, order]
    for k in range(vectors.shape[1]):
        if vectors[:, k] @ np.sin(np.arange(len(matrix)) + k + 1.0) < 0:
            vectors[:, k] *= -1
    return values, vectors


def inverse(matrix: np.ndarray) -> np.ndarray:
    if matrix.ndim != 2 or matrix.shape[0] != matrix.shape[1]:
        raise DimensionMismatch("a square matrix is needed")
    try:
        out = np.linalg.inv(matrix)
    except np.linalg.LinAlgError as error:
        raise NotPositiveDefinite("singular matrix") from error
    if not np.isfinite(out).all() or np.linalg.cond(matrix) > 1e15:
        raise NotPositiveDefinite("singular matrix")
    return out


def pca_weights(cov: np.ndarray, risk_target: np.ndarray | None = None) -> np.ndarray:
    """Weights that load risk on principal components, all on the smallest by default; absolute weights add up to 1."""
    values, vectors = eigen(cov)
    n = len(values)
    risk = np.full(n, 1.0 / n) if risk_target is None else np.asarray(risk_target, float)
    loads = np.where(values > 1e-15, np.sqrt(risk / np.where(values > 1e-15, values, 1.0)), 0.0)
    w = vectors @ loads
    total = np.abs(w).sum()
    return w / total if total > 1e-15 else np.full(n, 1.0 / n)


def _normalised(w: np.ndarray) -> np.ndarray | None:
    return w / w.sum() if abs(w.sum()) > 1e-15 else None


def optimal_portfolio(cov: np.ndarray, mu: np.ndarray | None = None) -> np.ndarray:
    w = _normalised(inverse(cov) @ (np.ones(len(cov)) if mu is None else np.asarray(mu, float)))
    if w is None:
        raise ComputationFailed("weights add up to 0")
    return w


def cla_min_variance(cov: np.ndarray) -> np.ndarray:
    return optimal_portfolio(cov)


def cla_max_sharpe(mu: np.ndarray, cov: np.ndarray) -> np.ndarray:
    w = _normalised(inverse(cov) @ np.asarray(mu, float))
    return cla_min_variance(cov) if w is None else w


def static_optimization(mu: np.ndarray, cov: np.ndarray, risk_aversion: float) -> np.ndarray:
    if risk_aversion <= 0:
        raise InvalidParameter("risk_aversion")
    w = _normalised(inverse(cov) @ np.asarray(mu, float) / risk_aversion)
    return np.full(len(cov), 1 / len(cov)) if w is None else w


def dynamic_optimization(mus: Sequence[np.ndarray], covs: Sequence[np.ndarray], risk_aversion: float) -> list[np.ndarray]:
    if len(mus) != len(covs):
        raise DimensionMismatch("as many returns as matrices")
    return [static_optimization(m, c, risk_aversion) for m, c in zip(mus, covs, strict=True)]


def kullback_leibler_distance(a: np.ndarray, b: np.ndarray) -> float:
    logs = lambda m: np.log(np.maximum(np.linalg.eigvalsh(m), 1e-15)).sum()
    return float(max(0.5 * (np.trace(inverse(b) @ a) - len(a) + logs(b) - logs(a)), 0.0))


def _mp_density(var: float, q: float, x: np.ndarray) -> np.ndarray:
    low, high = var * (1 - (1 / q) ** 0.5) ** 2, var * (1 + (1 / q) ** 0.5) ** 2
    inside = np.maximum((high - x) * (x - low), 0.0)
    return np.where((x >= low) & (x <= high) & (x > 0), q * np.sqrt(inside) / (2 * np.pi * var * np.where(x > 0, x, 1.0)), 0.0)


def find_max_eigenvalue(values: np.ndarray, q: float, bandwidth: float, low: float = 1e-5, high: float = 0.99999, points: int = 1000) -> float:
    """The noise variance whose Marcenko-Pastur density is nearest to the eigenvalues' kernel density, on a grid."""
    x = np.asarray(values, float)
    kde = np.exp(-0.5 * ((x[:, None] - x[None, :]) / bandwidth) ** 2).mean(1) / (bandwidth * (2 * np.pi) ** 0.5)
    grid = low + np.arange(points) * (high - low) / max(points - 1, 1)
    return float(grid[np.argmin([((_mp_density(v, q, x) - kde) ** 2).sum() for v in grid])])


def _rescaled(matrix: np.ndarray) -> np.ndarray:
    d = np.sqrt(np.maximum(np.diag(matrix), 1e-15))
    out = np.clip(matrix / np.outer(d, d), -1, 1)
    np.fill_diagonal(out, 1.0)
    return out


def denoise_corr(corr: np.ndarray, q: float, bandwidth: float = 0.25, shrinkage: bool = False, alpha: float = 0.0) -> np.ndarray:
    """Eigenvalues up to the noise edge become their mean, or shrink towards it; the diagonal is 1 again."""
    values, vectors = eigen(corr)
    edge = find_max_eigenvalue(values, q, bandwidth) * (1 + (1 / q) ** 0.5) ** 2
    noise = values <= edge
    if noise.any():
        mean = values[noise].mean()
        values = np.where(noise, alpha * values + (1 - alpha) * mean if shrinkage else mean, values)
    return _rescaled(vectors @ np.diag(values) @ vectors.T)


def denoise_cov(cov: np.ndarray, q: float, bandwidth: float = 0.25) -> np.ndarray:
    d = np.sqrt(np.maximum(np.diag(cov), 0.0))
    safe = np.where(d > 1e-15, d, 1.0)
    corr = cov / np.outer(safe, safe)
    np.fill_diagonal(corr, 1.0)
    return denoise_corr(corr, q, bandwidth) * np.outer(d, d)


def detone_corr(corr: np.ndarray, n_components: int) -> np.ndarray:
    """The correlation without its first components, the market."""
    values, vectors = eigen(corr)
    top = vectors[:, :n_components] @ np.diag(values[:n_components]) @ vectors[:, :n_components].T
    return _rescaled(corr - top)


def single_linkage(dist: np.ndarray) -> list[tuple[int, int, float, int]]:
    """Merges (left, right, distance, size); the first least distance wins, the merged cluster takes the left slot."""
    n = len(dist)
    d = np.array(dist, float)
    np.fill_diagonal(d, np.inf)
    names, sizes, alive, out = list(range(n)), [1] * n, list(range(n)), []
    for step in range(n - 1):
        sub = d[np.ix_(alive, alive)]
        upper = np.where(np.triu(np.ones_like(sub, bool), 1), sub, np.inf)
        a, b = divmod(int(np.argmin(upper)), len(alive))
        i, j = alive[a], alive[b]
        out.append((names[i], names[j], float(upper[a, b]), sizes[i] + sizes[j]))
        d[i, :] = d[:, i] = np.minimum(d[i, :], d[j, :])
        d[i, i] = np.inf
        names[i], sizes[i] = n + step, sizes[i] + sizes[j]
        alive.remove(j)
    return out


def quasi_diag(linkage: Sequence[tuple], n: int) -> list[int]:
    """Leaves in the order of the tree."""
    if not linkage:
        return list(range(n))
    order = [n + len(linkage) - 1]
    while any(i >= n for i in order):
        order = [x for i in order for x in ((int(linkage[i - n][0]), int(linkage[i - n][1])) if i >= n else (i,))]
    return order


def _cluster_variance(cov: np.ndarray, items: list[int]) -> float:
    if len(items) == 1:
        return float(cov[items[0], items[0]])
    sub = cov[np.ix_(items, items)]
    w = 1 / np.maximum(np.diag(sub), 1e-15)
    w /= w.sum()
    return float(max(w @ sub @ w, 1e-15))


def recursive_bisection(cov: np.ndarray, order: Sequence[int]) -> np.ndarray:
    w, todo = np.ones(len(cov)), [list(order)]
    while todo:
        items = todo.pop()
        if len(items) < 2:
            continue
        left, right = items[: len(items) // 2], items[len(items) // 2 :]
        a, b = _cluster_variance(cov, left), _cluster_variance(cov, right)
        share = 1 - a / (a + b) if a + b > 0 else 0.5
        w[left] *= share
        w[right] *= 1 - share
        todo += [left, right]
    return w


def hrp_from_moments(corr: np.ndarray, cov: np.ndarray) -> np.ndarray:
    dist = np.sqrt(np.maximum(0.5 * (1 - corr), 0.0))
    return recursive_bisection(cov, quasi_diag(single_linkage(dist), len(cov)))


def hrp_weights(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(i, weight) of hierarchical risk parity; both k x k matrices come from one pass over the rows."""
    k = len(columns)
    if k == 0:
        raise InsufficientData("no columns")
    cov = to_numpy(covariance_matrix(df, columns))
    d = np.sqrt(np.diag(cov))
    safe = np.where(d > 1e-15, d, 1.0)
    corr = np.where(np.outer(d, d) > 1e-15, cov / np.outer(safe, safe), 0.0)
    np.fill_diagonal(corr, 1.0)
    return vector_frame(df.sparkSession, hrp_from_moments(np.clip(corr, -1, 1), cov))
