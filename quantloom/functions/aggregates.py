"""Series-to-scalar statistics as aggregate Columns for ``groupBy(...).agg``; Spark adds them up in parts.

Where an undefined case has a defined result it is stated; otherwise it is null. Functions named with ``lagged`` columns
expect those columns from ``operators.series``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .scalars import _col, absolute_angular_distance_from_corr, angular_distance_from_corr, squared_angular_distance_from_corr


def mean(x) -> Column:
    return F.avg(_col(x))


def variance(x, ddof: int = 1) -> Column:
    x = _col(x)
    n = F.count(x)
    return F.when(n > ddof, F.var_pop(x) * n / (n - ddof))


def std_dev(x, ddof: int = 1) -> Column:
    return F.sqrt(variance(x, ddof))


def array_mean(x) -> Column:
    return F.coalesce(F.avg(_col(x)), F.lit(0.0))


def array_std(x, ddof: int = 1) -> Column:
    return F.coalesce(std_dev(x, ddof), F.lit(0.0))


def skewness(x) -> Column:
    """Adjusted Fisher-Pearson; 0 for a constant series, null below 3 values."""
    x = _col(x)
    n = F.count(x)
    return F.when(n >= 3, F.when(F.var_pop(x) == 0, F.lit(0.0)).otherwise(F.sqrt(n * (n - 1)) / (n - 2) * F.skewness(x)))


def kurtosis(x) -> Column:
    """Bias-corrected excess kurtosis; 0 for a constant series, null below 4 values."""
    x = _col(x)
    n = F.count(x)
    return F.when(n >= 4, F.when(F.var_pop(x) == 0, F.lit(0.0)).otherwise((n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.kurtosis(x) + 6)))


def weighted_mean(x, weight) -> Column:
    total = F.sum(_col(weight))
    return F.when(total != 0, F.sum(_col(x) * _col(weight)) / total)


def sharpe_ratio(returns, risk_free: float = 0.0, periods: float = 252.0) -> Column:
    """0 below two returns, for no periods and for returns without spread."""
    r = _col(returns)
    usable = (F.count(r) >= 2) & (F.stddev_samp(r) >= 1e-15) & F.lit(periods > 0)
    return F.coalesce(F.when(usable, (F.avg(r) - risk_free) / F.stddev_samp(r) * periods**0.5 if periods > 0 else F.lit(0.0)), F.lit(0.0))


def hit_ratio(returns) -> Column:
    return F.coalesce(F.avg((_col(returns) > 0).cast("double")), F.lit(0.0))


def avg_holding_period(entry, exit_) -> Column:
    return F.coalesce(F.avg(F.greatest(_col(exit_) - _col(entry), F.lit(0)).cast("double")), F.lit(0.0))


def turnover(lagged_change) -> Column:
    """Mean absolute change of a position; ``lagged_change`` is null on the first row."""
    return F.coalesce(F.avg(F.abs(_col(lagged_change))), F.lit(0.0))


def hhi(weights) -> Column:
    """Sum of squared shares of the absolute weights."""
    w = F.abs(_col(weights))
    return F.coalesce(F.when(F.sum(w) >= 1e-15, F.sum(w * w) / F.pow(F.sum(w), F.lit(2.0))), F.lit(0.0))


def hhi_concentration(returns) -> Column:
    r = _col(returns)
    return F.struct(hhi(F.when(r > 0, r)).alias("positive"), hhi(F.when(r < 0, r)).alias("negative"))


def shannon_entropy(probs) -> Column:
    p = _col(probs)
    return F.coalesce(F.sum(F.when(p > 0, -p * F.log2(p))), F.lit(0.0))


def redundancy(probs) -> Column:
    n = F.count(_col(probs))
    return F.when(n <= 1, F.lit(0.0)).otherwise(1 - shannon_entropy(probs) / F.log2(n.cast("double")))


def amihud_lambda(returns, dollar_volumes) -> Column:
    r, v = _col(returns), _col(dollar_volumes)
    return F.coalesce(F.avg(F.when(v > 0, F.abs(r) / v)), F.lit(0.0))


def kyle_lambda(returns, signed_volume) -> Column:
    r, v = _col(returns), _col(signed_volume)
    return F.coalesce(F.when((F.count(r) >= 2) & (F.var_pop(v) > 1e-15), F.regr_slope(r, v)), F.lit(0.0))


def roll_spread(change, previous_change) -> Column:
    """From each price change and the one before; both null where there is none."""
    c, p = _col(change), _col(previous_change)
    n, m = F.count(c), F.avg(c)
    # sum over pairs of (c - m)(p - m), with the mean of all changes
    pairs = F.count(p)
    cov = (F.sum(c * p) - m * (F.sum(F.when(p.isNotNull(), c)) + F.sum(p)) + m * m * pairs) / (n - 1)
    return F.coalesce(F.when((n >= 2) & (cov < 0), 2 * F.sqrt(-cov)), F.lit(0.0))


def round_lot_fraction(volumes, lot: float = 100.0) -> Column:
    v = _col(volumes)
    rest = v % lot
    return F.coalesce(F.avg(F.when(v > 0, ((rest < 1e-6) | (lot - rest < 1e-6)).cast("double"))), F.lit(0.0))


def order_size_distribution(volumes) -> Column:
    return F.struct(array_mean(volumes).alias("mean"), array_std(volumes).alias("std"), F.coalesce(skewness(volumes), F.lit(0.0)).alias("skewness"), round_lot_fraction(volumes).alias("round_lots"))


def t_statistic(terms, least: int = 2) -> Column:
    """Mean over standard error; 0 below ``least`` terms or without spread."""
    t = _col(terms)
    n = F.count(t)
    error = F.stddev_samp(t) / F.sqrt(n)
    return F.coalesce(F.when((n >= least) & (error >= 1e-15), F.avg(t) / error), F.lit(0.0))


def sm_poly(change, degree: int) -> Column:
    """Sub- or super-martingale test with polynomial trend, from price changes."""
    d = _col(change)
    return F.lit(0.0) if degree <= 0 else t_statistic(F.signum(d) * F.pow(F.abs(d), F.lit(float(degree))))


def sm_exp(change) -> Column:
    return t_statistic(F.exp(_col(change)) - 1)


def sm_power(change, power: float) -> Column:
    d = _col(change)
    return F.lit(0.0) if power <= 0 else t_statistic(F.signum(d) * F.pow(F.abs(d), F.lit(float(power))))


def pearson(x, y) -> Column:
    """Correlation; 0 without spread."""
    x, y = _col(x).cast("double"), _col(y).cast("double")
    spread = F.stddev_pop(x) * F.stddev_pop(y)
    return F.when(F.coalesce(spread, F.lit(0.0)) < 1e-15, F.lit(0.0)).otherwise(F.corr(x, y))


def angular_distance(x, y) -> Column:
    return angular_distance_from_corr(pearson(x, y))


def absolute_angular_distance(x, y) -> Column:
    return absolute_angular_distance_from_corr(pearson(x, y))


def squared_angular_distance(x, y) -> Column:
    return squared_angular_distance_from_corr(pearson(x, y))


def f1_score(y_true, y_pred) -> Column:
    """Values above 0 are positive; 0 without true positives."""
    t, p = _col(y_true) > 0, _col(y_pred) > 0
    count = lambda c: F.sum(c.cast("long"))
    hit = count(t & p)
    return F.coalesce(F.when(hit > 0, 2.0 * hit / (2 * hit + count(~t & p) + count(t & ~p))), F.lit(0.0))


def accuracy_score(y_true, y_pred) -> Column:
    return F.coalesce(F.avg((F.abs(_col(y_true) - _col(y_pred)) < 1e-10).cast("double")), F.lit(0.0))


def neg_log_loss(y_true, y_proba) -> Column:
    t = _col(y_true).cast("double")
    p = F.greatest(F.least(_col(y_proba).cast("double"), F.lit(1 - 1e-15)), F.lit(1e-15))
    return F.coalesce(F.avg(t * F.log(p) + (1 - t) * F.log(1 - p)), F.lit(0.0))


def estimate_ou(x, next_x, dt: float) -> Column:
    """struct(theta, mu, sigma) of dx = theta (mu - x) dt + sigma dW by least squares on consecutive values.

    ``next_x`` is null on the last row. All are 0 below 3 values or without mean reversion.
    """
    x, d = F.when(_col(next_x).isNotNull(), _col(x)), _col(next_x) - _col(x)
    m, b, a = F.count(d), F.regr_slope(d, x), F.regr_intercept(d, x)
    theta = -b / dt
    residual = F.greatest(F.regr_syy(d, x) - b * F.regr_sxy(d, x), F.lit(0.0)) / m
    good = (m >= 2) & (theta > 0)
    made = F.struct(theta.alias("theta"), (a / (theta * dt)).alias("mu"), F.sqrt(residual / dt).alias("sigma"))
    zero = F.struct(F.lit(0.0).alias("theta"), F.lit(0.0).alias("mu"), F.lit(0.0).alias("sigma"))
    return F.when(F.coalesce(good, F.lit(False)), made).otherwise(zero)
