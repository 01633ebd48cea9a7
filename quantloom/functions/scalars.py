"""Per-row functions as Column expressions, native but for the weights of fractional differences; nulls give null unless said otherwise."""

from __future__ import annotations

import math
from functools import reduce
from statistics import NormalDist

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import InvalidParameter


def _col(x) -> Column:
    return x if isinstance(x, Column) else F.col(x) if isinstance(x, str) else F.lit(x)


def ieee_divide(a, b) -> Column:
    """a / b, where a divisor of zero gives an infinity, or NaN for zero over zero."""
    a, b = _col(a), _col(b)
    return F.when(b != 0, a / b).when(b == 0, a * F.lit(float("inf")))


def ieee_log(x) -> Column:
    """The natural logarithm: minus infinity at zero, NaN below."""
    x = _col(x)
    return F.when(x > 0, F.log(x)).when(x == 0, F.lit(float("-inf"))).when(x < 0, F.lit(float("nan")))


def clamp(x, low, high) -> Column:
    return F.greatest(F.least(_col(x), _col(high)), _col(low))


def sign(x) -> Column:
    """-1, 0 or 1; zero has none."""
    return F.signum(_col(x).cast("double"))


def mid_price(high="high", low="low") -> Column:
    return (_col(high) + _col(low)) / 2


def typical_price(high="high", low="low", close="close") -> Column:
    return (_col(high) + _col(low) + _col(close)) / 3


def dollar_volume(vwap="vwap", volume="volume") -> Column:
    return _col(vwap) * _col(volume)


def side_sign(side="side") -> Column:
    """1 for buy, -1 for sell."""
    return F.when(F.lower(_col(side)) == "buy", 1.0).when(F.lower(_col(side)) == "sell", -1.0)


def sigmoid_bet_size(prob, num_classes: int = 2) -> Column:
    """Signed size of a bet from the probability of its side; linear between no edge and certainty."""
    if num_classes < 2:
        return F.lit(0.0)
    p = _col(prob)
    return clamp(2 * p - 1, -1.0, 1.0) if num_classes == 2 else clamp((p - 1 / num_classes) / (1 - 1 / num_classes), -1.0, 1.0)


def power_bet_size(prob, num_classes: int = 2, exponent: float = 1.0) -> Column:
    if exponent <= 0:
        return F.lit(0.0)
    s = sigmoid_bet_size(prob, num_classes)
    return F.signum(s) * F.pow(F.abs(s), F.lit(float(exponent)))


def discrete_signal(signal, step_size: float = 0.1) -> Column:
    """To the next multiple of the step, halves away from zero; 0 if not finite."""
    if step_size <= 0:
        return F.lit(0.0)
    s = _col(signal).cast("double")
    steps = s / F.lit(float(step_size))
    finite = ~F.isnan(s) & (F.abs(s) < float("inf"))
    return F.when(finite, F.signum(steps) * F.floor(F.abs(steps) + 0.5) * F.lit(float(step_size))).otherwise(F.lit(0.0))


def dynamic_bet_size(forecast, current_position, max_position, sigma) -> Column:
    """struct(limit_delta, trade_size): the trade towards max_position * tanh(forecast), and the price move it stands for."""
    w, s = _col(max_position).cast("double"), _col(sigma).cast("double")
    target = w * F.tanh(_col(forecast))
    trade = target - _col(current_position)
    idle = (w <= 0) | (s <= 0) | (F.abs(trade) < 1e-12)
    limit = F.atanh(clamp(target / w, -1.0 + 1e-12, 1.0 - 1e-12)) * s
    return F.struct(F.when(idle, 0.0).otherwise(limit).alias("limit_delta"), F.when(idle, 0.0).otherwise(trade).alias("trade_size"))


def meta_bet_size(probability, min_probability: float) -> Column:
    p = _col(probability)
    return F.when(p < min_probability, 0.0).otherwise(clamp(2 * p - 1, 0.0, 1.0))


def vertical_barrier(entry_idx, max_holding: int, series_len) -> Column:
    return F.least(_col(entry_idx) + max_holding, _col(series_len) - 1)


def binary_encode(x) -> Column:
    x = _col(x).cast("double")
    return F.coalesce((x > 0) & ~F.isnan(x), F.lit(False))


def gaussian_entropy(variance) -> Column:
    v = _col(variance).cast("double")
    return F.when(v <= 0, F.lit(float("-inf"))).otherwise(0.5 * F.log2(F.lit(2 * math.pi * math.e) * v))


def entropy_implied_vol(entropy) -> Column:
    return F.sqrt(F.pow(F.lit(2.0), 2 * _col(entropy)) / (2 * math.pi * math.e))


def angular_distance_from_corr(rho) -> Column:
    return F.acos(clamp(rho, -1.0, 1.0)) / math.pi


def absolute_angular_distance_from_corr(rho) -> Column:
    return F.acos(clamp(F.abs(_col(rho)), -1.0, 1.0)) / math.pi


def squared_angular_distance_from_corr(rho) -> Column:
    return F.acos(clamp(_col(rho) * _col(rho), -1.0, 1.0)) / math.pi


def correlation_distance(rho) -> Column:
    return F.sqrt(F.greatest(0.5 * (1 - _col(rho)), F.lit(0.0)))


def optimal_number_of_bins(n, corr=None) -> Column:
    """Sturges' rule without a correlation, else by sample size and correlation."""
    n = _col(n)
    bins = F.ceil(F.log2(n.cast("double")) + 1) if corr is None else F.greatest(F.lit(1), F.floor(F.sqrt(n / 2) * F.abs(_col(corr))))
    return F.when(n <= 0, F.lit(1)).otherwise(bins).cast("long")


def sr_from_precision(precision, freq, ratio) -> Column:
    """Annual Sharpe ratio of bets that win ``ratio`` times what they lose."""
    p, f, r = (_col(x).cast("double") for x in (precision, freq, ratio))
    inside = (p > 0) & (p < 1) & (f > 0) & (r > 0)
    return F.when(inside, (p * r - (1 - p)) / F.sqrt(p * (1 - p) * F.pow(r + 1, F.lit(2.0))) * F.sqrt(f)).otherwise(F.lit(0.0))


def implied_frequency(target_sr, precision, ratio) -> Column:
    t, p, r = (_col(x).cast("double") for x in (target_sr, precision, ratio))
    per_bet = sr_from_precision(p, F.lit(1.0), r)
    none = F.when(t == 0, 0.0).otherwise(F.lit(float("inf")))
    return F.when((p <= 0) | (p >= 1) | (r <= 0), F.lit(0.0)).when(F.abs(per_bet) < 1e-15, none).otherwise(F.pow(t / per_bet, F.lit(2.0)))


def implied_precision(target_sr, freq, ratio) -> Column:
    """Precision that gives the target, in closed form: the root of a quadratic."""
    s, f, r = (_col(x).cast("double") for x in (target_sr, freq, ratio))
    t, u = s / F.sqrt(f), r + 1
    a, b = u * u * (1 + t * t), -(2 * u + t * t * u * u)
    p = (-b + F.when(t >= 0, 1.0).otherwise(-1.0) * F.sqrt(F.greatest(b * b - 4 * a, F.lit(0.0)))) / (2 * a)
    return F.when((f <= 0) | (r <= 0), F.lit(0.0)).otherwise(p)


#: W. J. Cody's rational approximations of the error function, to full double precision: (numerator, denominator) of
#: erf(y) / y in y^2 up to 0.46875, of erfc(y) exp(y^2) in y up to 4, and beyond in 1 / y^2; highest power first.
CODY = (
    ((1.85777706184603153e-1, 3.16112374387056560, 1.13864154151050156e2, 3.77485237685302021e2, 3.20937758913846947e3), (1.0, 2.36012909523441209e1, 2.44024637934444173e2, 1.28261652607737228e3, 2.84423683343917062e3)),
    (
        (2.15311535474403846e-8, 5.64188496988670089e-1, 8.88314979438837594, 6.61191906371416295e1, 2.98635138197400131e2, 8.81952221241769090e2, 1.71204761263407058e3, 2.05107837782607147e3, 1.23033935479799725e3),
        (1.0, 1.57449261107098347e1, 1.17693950891312499e2, 5.37181101862009858e2, 1.62138957456669019e3, 3.29079923573345963e3, 4.36261909014324716e3, 3.43936767414372164e3, 1.23033935480374942e3),
    ),
    ((1.63153871373020978e-2, 3.05326634961232344e-1, 3.60344899949804439e-1, 1.25781726111229246e-1, 1.60837851487422766e-2, 6.58749161529837803e-4), (1.0, 2.56852019228982242, 1.87295284992346725, 5.27905102951428412e-1, 6.05183413124413191e-2, 2.33520497626869185e-3)),
)


def normal_cdf(x) -> Column:
    """Standard normal distribution function, from rational approximations of the error function."""
    x = _col(x).cast("double")

    def ratio(part: int, y: Column) -> Column:
        horner = lambda c: reduce(lambda acc, v: acc * y + v, c[1:], F.lit(c[0]))
        over, under = CODY[part]
        return horner(over) / horner(under)

    def below(v: Column) -> Column:
        y = F.abs(v) / math.sqrt(2)
        inverse = 1 / (y * y)
        tail = F.exp(-y * y) * F.when(y <= 4, ratio(1, y)).otherwise((1 / math.sqrt(math.pi) - inverse * ratio(2, inverse)) / y) / 2
        return F.when(y <= 0.46875, 0.5 + v / math.sqrt(2) * ratio(0, y * y) / 2).when(v < 0, tail).otherwise(1 - tail)

    return F.element_at(F.transform(F.array(x), below), 1)  # the argument is computed once


def strategy_failure_probability(precision, n_observations, break_even) -> Column:
    p, n, b = (_col(x).cast("double") for x in (precision, n_observations, break_even))
    z = (p - b) / F.sqrt(b * (1 - b) / n)
    return F.when((n <= 0) | (b <= 0), F.lit(0.0)).when(b >= 1, F.lit(1.0)).otherwise(1 - normal_cdf(z))


def probabilistic_sharpe_ratio(sr, benchmark, n, skewness, kurtosis) -> Column:
    """Probability that the true Sharpe ratio exceeds the benchmark; kurtosis is raw (3 for a normal)."""
    s, b, n, g, k = (_col(x).cast("double") for x in (sr, benchmark, n, skewness, kurtosis))
    spread = 1 - g * s + (k - 1) / 4 * s * s
    return F.when((n < 2) | (spread <= 0), F.lit(0.0)).otherwise(normal_cdf((s - b) * F.sqrt(n - 1) / F.sqrt(spread)))


def expected_max_sharpe(sr_std, n_trials: int) -> Column:
    """Expected largest Sharpe ratio of unskilled trials."""
    if n_trials <= 1:
        return F.lit(0.0)
    gamma, z = 0.5772156649015329, NormalDist().inv_cdf
    q = lambda p: z(min(p, 1 - 1e-15))
    return _col(sr_std) * F.lit((1 - gamma) * q(1 - 1 / n_trials) + gamma * q(1 - 1 / (n_trials * math.e)))


def deflated_sharpe_ratio(sr, sr_std, n, n_trials: int, skewness, kurtosis) -> Column:
    return probabilistic_sharpe_ratio(sr, expected_max_sharpe(sr_std, n_trials), n, skewness, kurtosis)


def log_factorials(n: int) -> list[float]:
    return [math.lgamma(k + 1) for k in range(n + 1)]


def bagging_accuracy(n: int, p) -> Column:
    """Accuracy of a majority of ``n`` independent voters of accuracy ``p``; a tie counts half."""
    p = _col(p).cast("double")
    if n < 1:
        return F.lit(0.0)
    lf = log_factorials(n)
    terms = [(k, lf[n] - lf[k] - lf[n - k], 0.5 if 2 * k == n else 1.0) for k in range((n + 1) // 2, n + 1)]
    inside = sum((F.lit(w) * F.exp(F.lit(c) + k * F.log(p) + (n - k) * F.log(1 - p)) for k, c, w in terms), F.lit(0.0))
    return F.when(p <= 0, 0.0).when(p >= 1, 1.0).otherwise(inside)


def binomial(n, k) -> Column:
    """n over k, exact while it fits a long."""
    n, k = _col(n).cast("long"), _col(k).cast("long")
    m = F.least(k, n - k)
    product = F.aggregate(F.when(m > 0, F.sequence(F.lit(1).cast("long"), m)).otherwise(F.expr("cast(array() as array<long>)")), F.lit(1).cast("long"), lambda acc, i: ((acc * (n - m + i)).cast("decimal(38,0)") / i).cast("long"))
    return F.when((k < 0) | (k > n), F.lit(0).cast("long")).otherwise(product)


def partitions_count(n, k) -> Column:
    """Ways to split k into n ordered parts."""
    n, k = _col(n).cast("long"), _col(k).cast("long")
    return F.when(n <= 0, F.lit(0).cast("long")).otherwise(binomial(n + k - 1, k))


def cpcv_paths(n_groups, n_test) -> Column:
    n, k = _col(n_groups).cast("long"), _col(n_test).cast("long")
    return F.when((k <= 0) | (k > n), F.lit(0).cast("long")).otherwise((binomial(n, k) * k / n).cast("long"))


def max_features(kind: str, n_features: int, value: float = 0) -> int:
    """How many features a tree may look at: sqrt, log2, fraction or fixed."""
    if kind not in ("sqrt", "log2", "fraction", "fixed"):
        raise InvalidParameter(kind)
    raw = {"sqrt": lambda: math.ceil(math.sqrt(n_features)), "log2": lambda: math.ceil(math.log2(max(1, n_features))), "fraction": lambda: math.ceil(value * n_features), "fixed": lambda: min(int(value), n_features)}[kind]()
    return max(1, raw)


def _weights(d: np.ndarray, most: np.ndarray, threshold: float) -> pa.Array:
    """Lists of the weights of (1 - L)^d, ``most`` at most and up to the first below the threshold; all rows go on together."""
    at, w = np.flatnonzero(most > 0), np.ones(np.count_nonzero(most > 0))
    length, steps, k = np.zeros(len(d), np.int64), [], 0
    while len(at):
        length[at] += 1
        steps.append((at, w))
        k += 1
        on = most[at] > k
        at = at[on]
        w = w[on] * ((k - 1 - d[at]) / k)
        above = ~(np.abs(w) < threshold)
        at, w = at[above], w[above]
    offsets = np.concatenate([[0], np.cumsum(length)])
    values = np.empty(offsets[-1])
    for k, (at, w) in enumerate(steps):
        values[offsets[at] + k] = w
    return pa.LargeListArray.from_arrays(pa.array(offsets), pa.array(values)).cast(pa.list_(pa.float64()))


def frac_weights(d, size) -> Column:
    """The first ``size`` weights of (1 - L)^d as an array."""

    @F.arrow_udf("array<double>")
    def made(d: pa.Array, size: pa.Array) -> pa.Array:
        known = pc.and_(d.is_valid(), size.is_valid())
        lists = _weights(pc.fill_null(d, 0.0).to_numpy(zero_copy_only=False), pc.fill_null(size, 0).to_numpy(zero_copy_only=False), 0.0)
        return pc.if_else(known, lists, pa.scalar(None, lists.type))

    return made(_col(d).cast("double"), _col(size).cast("int"))


def frac_weights_ffd(d, threshold: float, most: int = 1000) -> Column:
    """The weights of (1 - L)^d up to the first below the threshold in absolute value, ``most`` at most, as an array."""

    @F.arrow_udf("array<double>")
    def made(d: pa.Array) -> pa.Array:
        lists = _weights(pc.fill_null(d, 0.0).to_numpy(zero_copy_only=False), np.full(len(d), most), threshold)
        return pc.if_else(d.is_valid(), lists, pa.scalar(None, lists.type))

    return made(_col(d).cast("double"))


def marcenko_pastur_density(x, var: float, q: float) -> Column:
    """The density of eigenvalues of a random covariance matrix with q observations for each series; 0 outside the support."""
    x, low, high = _col(x), var * (1 - (1 / q) ** 0.5) ** 2, var * (1 + (1 / q) ** 0.5) ** 2
    inside = (F.lit(high) - x) * (x - F.lit(low))
    return F.when((inside > 0) & (x > 0), q / (2 * math.pi * var * x) * F.sqrt(inside)).otherwise(F.lit(0.0))
