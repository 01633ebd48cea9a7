"""All queries over the given tables, and their SQL.

Doubles are rounded to six digits on both sides, with 0.0 added so that no negative zero is left.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import aggregates as A
from ..functions import scalars as S
from ..operators import bars as B
from ..operators import classify as C
from ..operators import codependence as D
from ..operators import matrix as M
from ..operators import overlap as O
from ..operators import research as R
from ..operators import sampling as P
from ..operators import scans as X
from ..operators import series as W
from ..sources.tables import SERIES_SQL, SPANS_SQL, TRADE_ORDER, daily_assets, embedding_columns, event_series, event_ticks, spans, table, trades
from .flagship import BARS_SQL, FLAGSHIP_SQL, supplier_hit_ratio

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
KEY = W.Ordered(["key"], ["idx"])


def rounded(c: Column | str, digits: int = 6) -> Column:
    """Rounded as DuckDB does: on the scaled value, not on its decimal form."""
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c * F.lit(10.0**digits), 0) / F.lit(10.0**digits) + F.lit(0.0)


def r6(sql: str) -> str:
    return f"round({sql}, 6) + 0.0"


def add(name: str, query: Callable[[SparkSession, str], DataFrame], sql: str | None = None) -> None:
    QUERIES[name] = query
    if sql is not None:
        ORACLES[name] = sql


# --- scalars over customer ------------------------------------------------------------------------------------------

#: id, p in [0, 1], k, x, n, rho
CUSTOMER_SQL = "c as (select c_custkey as id, (c_acctbal + 1000) / 11000 as p, 2 + c_custkey % 4 as k, c_acctbal / 1000 - 4.5 as x, 10 + c_custkey % 90 as n, (c_acctbal - 4500) / 5500 as rho from customer)"


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    b, k = F.col("c_acctbal"), F.col("c_custkey")
    return c.select(k.alias("id"), ((b + 1000) / 11000).alias("p"), (2 + k % 4).alias("k"), (b / 1000 - 4.5).alias("x"), (10 + k % 90).alias("n"), ((b - 4500) / 5500).alias("rho"))


def add_scalar(name: str, value: Callable[[], Column], sql: str, exact: bool = False) -> None:
    add(name, lambda s, d: customers(s, d).select("id", (value() if exact else rounded(value())).alias("value")), f"with {CUSTOMER_SQL} select id, {sql if exact else r6(sql)} as value from c")


def phi_sql(x: str) -> str:
    """The normal distribution function as a sum of positive terms."""
    a = f"least(abs({x}), 8.5)"
    total = f"list_sum(list_transform(range(0, 151), lambda n: exp((2 * n + 1) * ln({a}) - ((n + 1) * ln(2) + lgamma(n + 1.5) - 0.5 * ln(pi())))))"
    half = f"(case when {a} = 0 then 0.5 else 0.5 + exp(-({a}) * ({a}) / 2) / sqrt(2 * pi()) * {total} end)"
    return f"(case when {x} >= 0 then {half} else 1 - {half} end)"


def clamp_sql(x: str, low: str, high: str) -> str:
    return f"greatest(least({x}, {high}), {low})"


PSR_SQL = "(({sr}) - ({b})) * sqrt(n - 1) / sqrt(1 - ({g}) * ({sr}) + (({k}) - 1) / 4 * ({sr}) * ({sr}))"
DSR_BENCHMARK = 0.1 * ((1 - 0.5772156649015329) * S.NormalDist().inv_cdf(1 - 1 / 20) + 0.5772156649015329 * S.NormalDist().inv_cdf(1 - 1 / (20 * math.e)))
BAG = " + ".join(f"{0.5 if 2 * k == 10 else 1.0} * {math.comb(10, k)} * pow(p, {k}) * pow(1 - p, {10 - k})" for k in range(5, 11))

add_scalar("sign", lambda: S.sign("x"), "sign(x)::double")
add_scalar("side_sign", lambda: S.side_sign(F.when(F.col("x") > 0, "buy").otherwise("sell")), "case when x > 0 then 1.0::double else -1.0::double end")
add_scalar("sigmoid_bet_size", lambda: S.sigmoid_bet_size("p", 2), clamp_sql("2 * p - 1", "-1.0", "1.0"))
add_scalar("sigmoid_bet_size_classes", lambda: S.sigmoid_bet_size("p", 3), clamp_sql("(p - 1.0::double / 3) / (1 - 1.0::double / 3)", "-1.0", "1.0"))
add_scalar("power_bet_size", lambda: S.power_bet_size("p", 2, 1.5), f"sign({clamp_sql('2 * p - 1', '-1.0', '1.0')}) * pow(abs({clamp_sql('2 * p - 1', '-1.0', '1.0')}), 1.5)")
add_scalar("discrete_signal", lambda: S.discrete_signal("rho", 0.1), "sign(rho / 0.1::double) * floor(abs(rho / 0.1::double) + 0.5) * 0.1::double")
add_scalar("meta_bet_size", lambda: S.meta_bet_size("p", 0.55), f"case when p < 0.55 then 0.0 else {clamp_sql('2 * p - 1', '0.0', '1.0')} end")
add_scalar("vertical_barrier", lambda: S.vertical_barrier("n", 10, F.lit(95)), "least(n + 10, 94)", True)
add_scalar("binary_encode", lambda: S.binary_encode("x"), "x > 0", True)
add_scalar("gaussian_entropy", lambda: S.gaussian_entropy(F.col("p") + 0.5), "0.5 * log2(2 * pi() * exp(1.0) * (p + 0.5))")
add_scalar("entropy_implied_vol", lambda: S.entropy_implied_vol("p"), "sqrt(pow(2.0, 2 * p) / (2 * pi() * exp(1.0)))")
add_scalar("angular_distance_from_corr", lambda: S.angular_distance_from_corr("rho"), f"acos({clamp_sql('rho', '-1.0', '1.0')}) / pi()")
add_scalar("absolute_angular_distance_from_corr", lambda: S.absolute_angular_distance_from_corr("rho"), "acos(least(abs(rho), 1.0)) / pi()")
add_scalar("squared_angular_distance_from_corr", lambda: S.squared_angular_distance_from_corr("rho"), "acos(least(rho * rho, 1.0)) / pi()")
add_scalar("correlation_distance", lambda: S.correlation_distance("rho"), "sqrt(greatest(0.5 * (1 - rho), 0.0))")
add_scalar("optimal_number_of_bins", lambda: S.optimal_number_of_bins("n"), "ceil(log2(n::double) + 1)::bigint", True)
add_scalar("optimal_number_of_bins_corr", lambda: S.optimal_number_of_bins("n", "rho"), "greatest(1, floor(sqrt(n::double / 2) * abs(rho)))::bigint", True)
add_scalar("sr_from_precision", lambda: S.sr_from_precision("p", F.col("n"), F.lit(1.2)), "case when p > 0 and p < 1 then (p * 1.2::double - (1 - p)) / sqrt(p * (1 - p) * pow(2.2::double, 2)) * sqrt(n::double) else 0.0 end")
add_scalar("implied_frequency", lambda: S.implied_frequency(F.lit(1.5), F.lit(0.5) + F.col("p") / 4 + 0.01, F.lit(1.1)), "pow(1.5::double / (((0.51::double + p / 4) * 1.1::double - (1 - (0.51::double + p / 4))) / sqrt((0.51::double + p / 4) * (1 - (0.51::double + p / 4)) * pow(2.1::double, 2))), 2)")
add_scalar("implied_precision", lambda: S.implied_precision(F.lit(2.0) * F.col("p"), F.col("n"), F.lit(1.1)), "(2 * 2.1::double + t * t * 2.1::double * 2.1::double + sqrt(pow(2 * 2.1::double + t * t * 2.1::double * 2.1::double, 2) - 4 * 2.1::double * 2.1::double * (1 + t * t))) / (2 * 2.1::double * 2.1::double * (1 + t * t))")
ORACLES["implied_precision"] = ORACLES["implied_precision"].replace("as value from c", "as value from (select *, 2 * p / sqrt(n::double) as t from c)")
add_scalar("normal_cdf", lambda: S.normal_cdf("x"), phi_sql("x"))
add_scalar("strategy_failure_probability", lambda: S.strategy_failure_probability("p", "n", F.lit(0.5)), f"1 - {phi_sql('z')}")
ORACLES["strategy_failure_probability"] = ORACLES["strategy_failure_probability"].replace("as value from c", "as value from (select *, (p - 0.5) / sqrt(0.25::double / n) as z from c)")
add_scalar("probabilistic_sharpe_ratio", lambda: S.probabilistic_sharpe_ratio("p", F.lit(0.2), "n", F.lit(-0.3), F.lit(4.0)), phi_sql("z"))
ORACLES["probabilistic_sharpe_ratio"] = ORACLES["probabilistic_sharpe_ratio"].replace("as value from c", f"as value from (select *, {PSR_SQL.format(sr='p', b='0.2', g='-0.3', k='4.0')} as z from c)")
add_scalar("deflated_sharpe_ratio", lambda: S.deflated_sharpe_ratio("p", F.lit(0.1), "n", 20, F.lit(-0.3), F.lit(4.0)), phi_sql("z"))
ORACLES["deflated_sharpe_ratio"] = ORACLES["deflated_sharpe_ratio"].replace("as value from c", f"as value from (select *, {PSR_SQL.format(sr='p', b=repr(DSR_BENCHMARK), g='-0.3', k='4.0')} as z from c)")
add_scalar("bagging_accuracy", lambda: S.bagging_accuracy(10, "p"), BAG)
add_scalar("binomial", lambda: S.binomial("n", "k"), "case k when 2 then n * (n - 1) // 2 when 3 then n * (n - 1) * (n - 2) // 6 when 4 then n * (n - 1) * (n - 2) * (n - 3) // 24 else n * (n - 1) * (n - 2) * (n - 3) * (n - 4) // 120 end", True)
add_scalar("partitions_count", lambda: S.partitions_count("k", F.lit(3)), "(k + 2) * (k + 1) * k // 6", True)
add_scalar("cpcv_num_paths", lambda: S.cpcv_paths(F.col("n"), F.lit(2)), "(n * (n - 1) // 2) * 2 // n", True)
WEIGHT_SQL = "case when i = 0 then 1.0 else list_product(list_transform(range(1, i + 1), lambda j: (j - 1 - p) / j)) end"
add("get_weights", lambda s, d: customers(s, d).select("id", F.posexplode(S.frac_weights("p", "n")).alias("i", "w")).select("id", F.col("i").cast("long").alias("i"), rounded("w").alias("weight")),
    f"with {CUSTOMER_SQL} select id, i, {r6(WEIGHT_SQL)} as weight from c, lateral (select unnest(range(n)) as i)")
add("get_weights_ffd", lambda s, d: customers(s, d).select("id", F.posexplode(S.frac_weights_ffd("p", 1e-2)).alias("i", "w")).select("id", F.col("i").cast("long").alias("i"), rounded("w").alias("weight")),
    f"with {CUSTOMER_SQL}, w as (select id, i, {WEIGHT_SQL} as w from c, range(100) t(i)), f as (select id, min(i) as f from w where abs(w) < 1e-2 group by id) select id, i, {r6('w')} as weight from w left join f using (id) where f is null or i < f")
add_scalar("marcenko_pastur_pdf", lambda: S.marcenko_pastur_density(F.col("p") * 3, 1.0, 4.0), "case when (2.25 - p * 3) * (p * 3 - 0.25) > 0 then 4 / (2 * pi() * p * 3) * sqrt((2.25 - p * 3) * (p * 3 - 0.25)) else 0 end")
add("dynamic_bet_size", lambda s, d: customers(s, d).withColumn("b", S.dynamic_bet_size("rho", F.lit(0.1), F.lit(1.0), F.lit(2.0))).select("id", rounded("b.limit_delta").alias("limit_delta"), rounded("b.trade_size").alias("trade_size")),
    f"with {CUSTOMER_SQL} select id, {r6('atanh(greatest(least(tanh(rho), 1 - 1e-12), 1e-12 - 1)) * 2')} as limit_delta, {r6('tanh(rho) - 0.1')} as trade_size from c")
# --- series of events per user: windows -----------------------------------------------------------------------------

WIN = "window w as (partition by key order by idx)"


def last_sql(n: int) -> str:
    return f"(partition by key order by idx rows between {n - 1} preceding and current row)"


def add_window(name: str, make: Callable[[DataFrame], DataFrame], sql: str, more: str = "") -> None:
    """make adds ``value`` to the series; sql computes it over s."""
    add(name, lambda s, d: make(event_series(s, d)).select("key", "idx", rounded("value").alias("value")), f"with {SERIES_SQL}{more} select key, idx, {r6('value')} as value from ({sql})")


def col(make: Callable[[], Column]) -> Callable[[DataFrame], DataFrame]:
    return lambda df: df.withColumn("value", make())


add_window("shift", col(lambda: W.shift("x", KEY, 3)), f"select key, idx, lag(x, 3) over w as value from s {WIN}")
add_window("diff", col(lambda: W.diff("x", KEY)), "select key, idx, x - p as value from s")
add_window("pct_change", col(lambda: W.pct_change("x", KEY, ieee=True)), "select key, idx, (x - p) / p as value from s")
add_window("simple_returns", col(lambda: W.simple_returns("x", KEY, ieee=True)), "select key, idx, (x - p) / p as value from s")
add_window("log_returns", col(lambda: W.log_returns("x", KEY, ieee=True)), "select key, idx, ln(x / p) as value from s")
add_window("cumsum", col(lambda: W.cumsum("x", KEY)), f"select key, idx, sum(x) over w as value from s {WIN}")
add_window("series_slice", lambda df: W.slice_rows(df, 5, 15).withColumn("value", F.col("x")), "select key, idx, x as value from s where idx >= 5 and idx < 15")
add_window("tick_rule", lambda df: W.with_tick_rule(df, "x", KEY, 0.0, "value"), "select key, idx, coalesce(last_value(nullif(sign(x - p), 0) ignore nulls) over (partition by key order by idx), 0)::double as value from s")
add_window("classify_tick", lambda df: W.with_tick_rule(df, "x", KEY, 1.0, "value"), "select key, idx, coalesce(last_value(nullif(sign(x - p), 0) ignore nulls) over (partition by key order by idx), 1)::double as value from s")
add_window("amihud_lambda_rolling", col(lambda: W.amihud_rolling("r", F.col("x") * 10, KEY, 10, ieee=True)), f"select key, idx, case when idx >= 9 then avg(abs(r) / (x * 10)) over {last_sql(10)} end as value from s")
add_window("roll_spread_rolling", lambda df: W.with_roll_spread_rolling(df, "x", KEY, 10, "value"),
           f"select key, idx, case when idx >= 9 then case when c < 0 then 2 * sqrt(-c) else 0 end end as value from (select key, idx, (sum(d * e) over p - m * (sum(d) over p + sum(e) over p) + m * m * 8) / 8 as c from (select *, avg(d) over {last_sql(9)} as m from (select key, idx, x - p as d, lag(x - p) over w as e from s {WIN})) window p as {last_sql(8)})")
add_window("time_decay", col(lambda: W.time_decay(F.col("x") / 7, KEY, 0.3)), "select key, idx, case when count(*) over (partition by key) = 1 then x / 7 * 0.3 else x / 7 * (0.3 + 0.7 * idx / (count(*) over (partition by key) - 1)) end as value from s")
add_window("time_decay_negative", col(lambda: W.time_decay(F.col("x") / 7, KEY, -5.0)), "select key, idx, case when count(*) over (partition by key) = 1 or idx < 5 then 0 when count(*) over (partition by key) <= 6 then x / 7 else x / 7 * (idx - 5)::double / (count(*) over (partition by key) - 6) end as value from s")
add_window("brown_durbin_evans", lambda df: W.with_brown_durbin_evans(df, "x", KEY, "value"), f"select key, idx, case when sd > 1e-15 then sum((x - m) / sd) over w / sqrt(c) else 0 end as value from (select key, idx, x, avg(x) over (partition by key) as m, stddev_samp(x) over (partition by key) as sd, count(*) over (partition by key) as c from s) {WIN}")
add_window("chu_stinchcombe_white", lambda df: W.with_chu_stinchcombe_white(df.withColumn("l", S.ieee_log("x")), "l", KEY, 1.96, "value"),
           f"select key, idx, case when idx >= 1 then case when sd > 1e-15 then abs(sum((d - m) / sd) over w) / (1.96 * sqrt(idx) * (1 + 2 * idx::double / n)) else 0 end end as value from (select *, avg(case when idx between 1 and n // 2 then d end) over (partition by key) as m, stddev_samp(case when idx between 1 and n // 2 then d end) over (partition by key) as sd from (select key, idx, ln(x) - ln(p) as d, count(*) over (partition by key) - 1 as n from s)) {WIN}")
add_window("bonferroni_correction", col(lambda: W.bonferroni(1 / (1 + F.col("x")), ["key"])), "select key, idx, least(1 / (1 + x) * count(*) over (partition by key), 1.0) as value from s")
add_window("holm_correction", lambda df: W.with_holm(df.withColumn("q", 1 / (1 + F.col("x") * F.col("x"))), "q", ["key"], ["idx"], "value"),
           "select key, idx, max(a) over (partition by key order by q, idx rows unbounded preceding) as value from (select key, idx, q, least((count(*) over (partition by key) - row_number() over (partition by key order by q, idx) + 1) * q, 1.0) as a from (select *, 1 / (1 + x * x) as q from s))")
add_window("adaboost_update", lambda df: W.adaboost_update(df.withColumns({"y": F.when(F.col("x") > 50, 1.0).otherwise(-1.0), "yhat": F.when(F.col("x") + F.col("idx") % 30 > 60, 1.0).otherwise(-1.0), "w0": F.lit(1.0)}), "yhat", "y", "w0", ["key"]).withColumn("value", F.col("new_weight")),
           "select key, idx, v / sum(v) over (partition by key) as value from (select *, exp(case when bad then 0.5 * ln((1 - e) / e) else -0.5 * ln((1 - e) / e) end) as v from (select *, greatest(least(avg(bad::int::double) over (partition by key), 1 - 1e-10), 1e-10) as e from (select key, idx, (x > 50) <> (x + idx % 30 > 60) as bad from s)))")
add_window("sharpe_mesh", lambda df: W.sharpe_mesh(df, "x", ["key"], "value"), "select key, idx, case when stddev_pop(x) over (partition by key) >= 1e-12 then x / stddev_pop(x) over (partition by key) else 0 end as value from s")
add_window("drop_rare_labels", col(lambda: O.rare_label_mask("event_type", 0.2, ["key"]).cast("double")), "select key, idx, (count(*) over (partition by key, event_type)::double / count(*) over (partition by key) >= 0.2)::int::double as value from s")
add_window("get_bins", col(lambda: O.bins("r").cast("double")), "select key, idx, sign(r)::double as value from s")
add_window("get_meta_bins", lambda df: df.withColumn("g", F.when(F.col("idx") % 3 == 0, -1).otherwise(1)).withColumn("value", O.meta_bins("r", "g").cast("double")), "select key, idx, (r = 0 or sign(r) = case when idx % 3 = 0 then -1 else 1 end)::int::double as value from s")
add_window("meta_labeler_labels", lambda df: df.withColumn("g", F.when(F.col("idx") % 2 == 0, -1).otherwise(1)).withColumn("value", O.meta_bins("r", "g").cast("double")), "select key, idx, (r = 0 or sign(r) = case when idx % 2 = 0 then -1 else 1 end)::int::double as value from s")
add_window("quantile_encode", lambda df: P.with_quantile_code(df, "x", ["key"], ["idx"], 10, "value"),
           "select s.key, s.idx, coalesce(len(list_filter(cuts, lambda c: c <= x)), 0)::double as value from s join (select key, list(v) as cuts from (select key, x as v, row_number() over (partition by key order by x, idx) - 1 as r, count(*) over (partition by key) as n from s) cross join range(1, 10) t(i) where r = i * n // 10 group by key) using (key)")
add_window("sigma_encode", col(lambda: P.sigma_code("x", ["key"], 5).cast("double")), "select key, idx, case when coalesce(stddev_samp(x) over (partition by key), 0) < 1e-15 then 2 else greatest(least(floor((x - avg(x) over (partition by key)) / stddev_samp(x) over (partition by key) + 2), 4), 0) end::double as value from s")
add_window("roll_gaps", lambda df: W.with_roll_gaps(df.withColumn("z", F.col("idx") % 10 == 5), "x", "z", KEY, "value"), f"select key, idx, sum(g) over (partition by key) - sum(g) over w as value from (select key, idx, case when idx % 10 = 5 then coalesce(x - p, 0) else 0 end as g from s) {WIN}")
add_window("non_negative_rolled", lambda df: W.with_non_negative_rolled(df.withColumn("z", F.col("idx") % 10 == 5), "x", "z", KEY, "value"),
           f"select key, idx, v - least(min(v) over (partition by key), 0) as value from (select key, idx, x + sum(g) over (partition by key) - sum(g) over w as v from (select key, idx, x, case when idx % 10 = 5 then coalesce(x - p, 0) else 0 end as g from s) {WIN})")
FFD = X.frac_weights_ffd(0.5, 1e-2)
add_window("frac_diff_ffd", lambda df: X.with_frac_diff_ffd(df, "x", KEY, 0.5, 1e-2, "value"), "select key, idx, case when idx >= " + str(len(FFD) - 1) + " then " + " + ".join(f"({w!r}::double) * lag(x, {k}) over w" for k, w in enumerate(FFD)) + f" end as value from s {WIN}")
EXPANDING = X.frac_weights_ffd(0.4, 1e-2)
add_window("frac_diff_expanding", lambda df: X.with_frac_diff_expanding(df, "x", KEY, 0.4, 1e-2, "value"), "select key, idx, " + " + ".join(f"({w!r}::double) * coalesce(lag(x, {k}) over w, 0)" for k, w in enumerate(EXPANDING)) + f" as value from s {WIN}")
add("rolling_window", lambda s, d: event_series(s, d).withColumn("v", W.rolling_window("x", KEY, 5)).where("v is not null").select("key", "idx", F.array_join(F.transform("v", lambda x: F.round(x * 100).cast("long").cast("string")), ",").alias("value")),
    f"with {SERIES_SQL} select key, idx, array_to_string(list_transform(v, lambda x: round(x * 100)::bigint::varchar), ',') as value from (select key, idx, list(x) over {last_sql(5)} as v from s) where idx >= 4")
add("compute_drawdowns", lambda s, d: W.with_drawdowns(event_series(s, d).withColumn("q", F.coalesce("r", F.lit(0.0)) / 100), "q", KEY).select("key", "idx", rounded("drawdown").alias("drawdown"), F.col("time_under_water").alias("under_water")),
    f"with {SERIES_SQL}, a as (select key, idx, exp(sum(ln(1 + coalesce(r, 0) / 100)) over w) as v from s {WIN}), b as (select *, max(v) over w as h from a {WIN}), c as (select *, case when (h - v) / h > 1e-15 then (h - v) / h else 0 end as dd from b), d as (select *, sum((dd = 0)::int) over w as g from c {WIN}) select key, idx, {r6('dd')} as drawdown, sum((dd > 0)::int) over (partition by key, g order by idx)::bigint as under_water from d")
RECURSIVE = f"with recursive {SERIES_SQL}, "
add("ewma", lambda s, d: X.ewma(event_series(s, d), ["key"], "idx", "x", 10).select("key", "idx", rounded("ewma").alias("value")),
    RECURSIVE + f"e as (select key, idx, x as v from s where idx = 0 union all select s.key, s.idx, 2.0::double / 11 * x + (1 - 2.0::double / 11) * v from e join s on s.key = e.key and s.idx = e.idx + 1) select key, idx, {r6('v')} as value from e")
add("ewma_std", lambda s, d: X.ewma_std(event_series(s, d), ["key"], "idx", "x", 10).select("key", "idx", rounded("ewma_std").alias("value")),
    RECURSIVE + f"e as (select key, idx, 0.0::double as v from s where idx = 0 union all select s.key, s.idx, 2.0::double / 11 * (x - p) * (x - p) + (1 - 2.0::double / 11) * v from e join s on s.key = e.key and s.idx = e.idx + 1) select key, idx, {r6('sqrt(v)')} as value from e")
add("daily_volatility", lambda s, d: X.daily_volatility(event_series(s, d), ["key"], "idx", "x", 20, ieee=True).select("key", "idx", rounded("volatility").alias("value")),
    RECURSIVE + f"l as (select key, idx, ln(x / p) as g from s), q as (select key, idx, g - lag(g) over w as d from l {WIN}), e as (select key, idx, 0.0::double as v from q where idx = 1 union all select q.key, q.idx, 2.0::double / 21 * d * d + (1 - 2.0::double / 21) * v from e join q on q.key = e.key and q.idx = e.idx + 1) select key, idx, {r6('sqrt(v)')} as value from e union all select key, idx, 0.0 from s where idx = 0")
add("cusum_filter", lambda s, d: P.cusum_filter(event_series(s, d).withColumn("l", S.ieee_log("x")), ["key"], "idx", "l", 2.0),
    RECURSIVE + "c as (select key, idx, x, 0.0::double as up, 0.0::double as down, false as hit from s where idx = 0 union all select key, idx, x, case when u >= 2 or d <= -2 then 0.0 else u end, case when u >= 2 or d <= -2 then 0.0 else d end, u >= 2 or d <= -2 from (select s.key, s.idx, s.x, greatest(0.0, c.up + ln(s.x) - ln(c.x)) as u, least(0.0, c.down + ln(s.x) - ln(c.x)) as d from c join s on s.key = c.key and s.idx = c.idx + 1)) select key, idx from c where hit")

# --- series of events per user: aggregates --------------------------------------------------------------------------


def add_aggregate(name: str, value: Callable[[], Column], sql: str) -> None:
    add(name, lambda s, d: series_of_changes(s, d).groupBy("key").agg(value().alias("v")).select("key", rounded("v").alias("value")), f"with {SERIES_SQL}, t as (select *, x - p as c, lag(x - p) over w as c0, lead(x) over w as nx, idx + 1 + event_id % 10 as stop from s {WIN}) select key, {r6(sql)} as value from t group by key")


def series_of_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = event_series(spark, sf_dir).withColumn("c", F.col("x") - F.col("p"))
    return d.withColumns({"c0": F.lag("c").over(KEY.over), "nx": F.lead("x").over(KEY.over), "stop": F.col("idx") + 1 + F.col("event_id") % 10})


ADJ = "regr_slope(nx - x, case when nx is not null then x end)"
add_aggregate("mean", lambda: A.mean("x"), "avg(x)")
add_aggregate("variance", lambda: A.variance(F.col("x") / 100), "var_samp(x / 100)")
add_aggregate("variance_population", lambda: A.variance(F.col("x") / 100, 0), "var_pop(x / 100)")
add_aggregate("std_dev", lambda: A.std_dev("x"), "stddev_samp(x)")
add_aggregate("array_mean", lambda: A.array_mean("x"), "coalesce(avg(x), 0)")
add_aggregate("array_std", lambda: A.array_std("x"), "coalesce(stddev_samp(x), 0)")
add_aggregate("skewness", lambda: A.skewness("x"), "case when count(x) >= 3 then case when var_pop(x) = 0 then 0 else skewness(x) end end")
add_aggregate("kurtosis", lambda: A.kurtosis("x"), "case when count(x) >= 4 then case when var_pop(x) = 0 then 0 else kurtosis(x) end end")
add_aggregate("weighted_mean", lambda: A.weighted_mean("x", F.col("idx") + 1), "sum(x * (idx + 1)) / sum(idx + 1)")
add_aggregate("sharpe_ratio", lambda: A.sharpe_ratio("r", 0.001, 252.0), "coalesce(case when count(r) >= 2 and stddev_samp(r) >= 1e-15 then (avg(r) - 0.001) / stddev_samp(r) * sqrt(252.0::double) end, 0)")
add_aggregate("hit_ratio", lambda: A.hit_ratio("r"), "coalesce(avg((r > 0)::int::double), 0)")
add_aggregate("avg_holding_period", lambda: A.avg_holding_period("idx", "stop"), "avg(greatest(stop - idx, 0)::double)")
add_aggregate("turnover", lambda: A.turnover("c"), "coalesce(avg(abs(c)), 0)")
add_aggregate("hhi", lambda: A.hhi("x"), "sum(x * x) / pow(sum(abs(x)), 2)")
add_aggregate("shannon_entropy", lambda: A.shannon_entropy(F.col("x") / 500), "coalesce(sum(case when x > 0 then -x / 500 * log2(x / 500) end), 0)")
add_aggregate("redundancy", lambda: A.redundancy(F.col("x") / 500), "case when count(x) <= 1 then 0 else 1 - coalesce(sum(case when x > 0 then -x / 500 * log2(x / 500) end), 0) / log2(count(x)::double) end")
add_aggregate("amihud_lambda", lambda: A.amihud_lambda("r", F.col("x") * 10), "coalesce(avg(case when x > 0 then abs(r) / (x * 10) end), 0)")
add_aggregate("kyle_lambda", lambda: A.kyle_lambda("r", F.when(F.col("r").isNotNull(), F.signum("c") * F.col("x"))), "coalesce(case when count(r) >= 2 then regr_slope(r, case when r is not null then sign(c) * x end) end, 0)")
add_aggregate("roll_spread", lambda: A.roll_spread("c", "c0"), "coalesce(case when count(c) >= 2 and (sum(c * c0) - avg(c) * (sum(case when c0 is not null then c end) + sum(c0)) + avg(c) * avg(c) * count(c0)) / (count(c) - 1) < 0 then 2 * sqrt(-(sum(c * c0) - avg(c) * (sum(case when c0 is not null then c end) + sum(c0)) + avg(c) * avg(c) * count(c0)) / (count(c) - 1)) end, 0)")
add_aggregate("round_lot_fraction", lambda: A.round_lot_fraction(F.floor("x"), 10.0), "coalesce(avg(case when floor(x) > 0 then (floor(x)::bigint % 10 = 0)::int::double end), 0)")
add_aggregate("sm_poly", lambda: A.sm_poly("c", 2), "coalesce(case when stddev_samp(sign(c) * c * c) / sqrt(count(c)) >= 1e-15 then avg(sign(c) * c * c) / (stddev_samp(sign(c) * c * c) / sqrt(count(c))) end, 0)")
add_aggregate("sm_exp", lambda: A.sm_exp(F.col("c") / 100), "coalesce(case when stddev_samp(exp(c / 100) - 1) / sqrt(count(c)) >= 1e-15 then avg(exp(c / 100) - 1) / (stddev_samp(exp(c / 100) - 1) / sqrt(count(c))) end, 0)")
add_aggregate("sm_power", lambda: A.sm_power("c", 1.5), "coalesce(case when stddev_samp(sign(c) * pow(abs(c), 1.5)) / sqrt(count(c)) >= 1e-15 then avg(sign(c) * pow(abs(c), 1.5)) / (stddev_samp(sign(c) * pow(abs(c), 1.5)) / sqrt(count(c))) end, 0)")
add_aggregate("angular_distance", lambda: A.angular_distance("x", F.coalesce("p", F.lit(0.0))), "acos(greatest(least(case when stddev_pop(x) * stddev_pop(coalesce(p, 0)) < 1e-15 then 0 else corr(x, coalesce(p, 0)) end, 1), -1)) / pi()")
add_aggregate("absolute_angular_distance", lambda: A.absolute_angular_distance("x", F.coalesce("p", F.lit(0.0))), "acos(least(abs(case when stddev_pop(x) * stddev_pop(coalesce(p, 0)) < 1e-15 then 0 else corr(x, coalesce(p, 0)) end), 1)) / pi()")
add_aggregate("squared_angular_distance", lambda: A.squared_angular_distance("x", F.coalesce("p", F.lit(0.0))), "acos(least(pow(case when stddev_pop(x) * stddev_pop(coalesce(p, 0)) < 1e-15 then 0 else corr(x, coalesce(p, 0)) end, 2), 1)) / pi()")
add_aggregate("estimate_ou_theta", lambda: A.estimate_ou("x", "nx", 1.0)["theta"], f"case when count(nx - x) >= 2 and -{ADJ} > 0 then -{ADJ} else 0 end")
add_aggregate("estimate_ou_mu", lambda: A.estimate_ou("x", "nx", 1.0)["mu"], f"case when count(nx - x) >= 2 and -{ADJ} > 0 then regr_intercept(nx - x, case when nx is not null then x end) / -{ADJ} else 0 end")
add_aggregate("estimate_ou_sigma", lambda: A.estimate_ou("x", "nx", 1.0)["sigma"], f"case when count(nx - x) >= 2 and -{ADJ} > 0 then sqrt(greatest(regr_syy(nx - x, case when nx is not null then x end) - {ADJ} * regr_sxy(nx - x, case when nx is not null then x end), 0) / count(nx - x)) else 0 end")
add_aggregate("series_len", lambda: F.count(F.lit(1)).cast("double"), "count(*)::double")
add_aggregate("series_is_empty", lambda: (F.count("x") == 0).cast("double"), "(count(x) = 0)::int::double")
add("hhi_concentration", lambda s, d: event_series(s, d).groupBy("key").agg(A.hhi_concentration("r").alias("h")).select("key", rounded("h.positive").alias("positive"), rounded("h.negative").alias("negative")),
    f"with {SERIES_SQL} select key, {r6('coalesce(sum(r * r) filter (r > 0) / pow(sum(r) filter (r > 0), 2), 0)')} as positive, {r6('coalesce(sum(r * r) filter (r < 0) / pow(sum(r) filter (r < 0), 2), 0)')} as negative from s group by key")
add("order_size_distribution", lambda s, d: trades(s, d).groupBy("key").agg(A.order_size_distribution("volume").alias("o")).select("key", *[rounded(f"o.{c}").alias(c) for c in ("mean", "std", "skewness", "round_lots")]),
    f"select l_suppkey as key, {r6('avg(l_quantity)')} as mean, {r6('coalesce(stddev_samp(l_quantity), 0)')} as std, {r6('coalesce(case when count(*) >= 3 then case when var_pop(l_quantity) = 0 then 0 else skewness(l_quantity) end end, 0)')} as skewness, {r6('avg((l_quantity::bigint % 100 = 0)::int::double)')} as round_lots from lineitem where l_quantity > 0 group by l_suppkey")
add("plugin_entropy", lambda s, d: P.plugin_entropy(event_series(s, d).withColumn("b", F.floor(F.col("x") / 60)), "b", 8, ["key"]).select("key", rounded("entropy").alias("value")),
    f"with {SERIES_SQL} select key, {r6('coalesce(sum(case when b < 8 then -c / n * log2(c / n) end), 0)')} as value from (select key, b, count(*)::double as c, sum(count(*)) over (partition by key) as n from (select key, floor(x / 60) as b from s) group by key, b) group by key")
add("label_counts", lambda s, d: O.label_counts(event_series(s, d), "event_type", ["key"]), "select user_id as key, event_type, count(*) as n from events group by all")
add("drop_labels", lambda s, d: O.drop_labels(table(s, d, "events").withColumn("b", F.floor(F.col("value") / 50)), "b", 0.1).select("event_id", F.col("b").cast("long").alias("b")), "select event_id, b from (select event_id, floor(value / 50)::bigint as b, count(*) over (partition by floor(value / 50))::double / count(*) over () as q from events) where q >= 0.1")
add("balanced_class_weights", lambda s, d: O.balanced_class_weights(table(s, d, "events"), "event_type").select("event_type", rounded("weight").alias("weight")), f"select event_type, {r6('sum(count(*)) over () / (count(*) over () * count(*))')} as weight from events group by event_type")
add("scoring", lambda s, d: table(s, d, "labels").groupBy((F.col("doc_id") % 10).alias("key")).agg(rounded(A.f1_score("quality", "toxic")).alias("f1"), rounded(A.accuracy_score("quality", "toxic")).alias("accuracy"), rounded(A.neg_log_loss("quality", 0.2 + 0.5 * F.col("toxic"))).alias("log_loss")),
    f"select doc_id % 10 as key, {r6('case when sum(quality * toxic) > 0 then 2.0::double * sum(quality * toxic) / (2 * sum(quality * toxic) + sum((1 - quality) * toxic) + sum(quality * (1 - toxic))) else 0 end')} as f1, {r6('avg((quality = toxic)::int::double)')} as accuracy, {r6('avg(quality * ln(0.2 + 0.5 * toxic) + (1 - quality) * ln(1 - (0.2 + 0.5 * toxic)))')} as log_loss from labels group by doc_id % 10")

# --- codependence per user ------------------------------------------------------------------------------------------

PAIRS = "q as (select * from s where p is not null)"


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_series(spark, sf_dir).where("p is not null")


RANKS = f"{PAIRS}, k as (select key, rank() over (partition by key order by x) + (count(*) over (partition by key, x) - 1) / 2.0::double as a, rank() over (partition by key order by p) + (count(*) over (partition by key, p) - 1) / 2.0::double as b from q), rho as (select key, greatest(least(case when stddev_pop(a) * stddev_pop(b) < 1e-15 then 0 else corr(a, b) end, 1), -1) as rho from k group by key)"
BINNED = f"{PAIRS}, j0 as (select *, ceil(log2(count(*) over (partition by key)::double) + 1) as kk, min(x) over (partition by key) as lx, (max(x) over (partition by key) - min(x) over (partition by key)) * (1 + 1e-10) as wx, min(p) over (partition by key) as lp, (max(p) over (partition by key) - min(p) over (partition by key)) * (1 + 1e-10) as wp from q), j as (select key, case when wx > 0 then least(floor((x - lx) / (wx / kk)), kk - 1) else 0 end as bx, case when wp > 0 then least(floor((p - lp) / (wp / kk)), kk - 1) else 0 end as bp, count(*)::double as n from j0 group by all), t as (select key, sum(n) as n from j group by key), hxy as (select key, -sum(j.n / t.n * log2(j.n / t.n)) as h from j join t using (key) group by key), hx as (select key, -sum(m / n * log2(m / n)) as h from (select key, bx, sum(n) as m from j group by all) join t using (key) group by key), hp as (select key, -sum(m / n * log2(m / n)) as h from (select key, bp, sum(n) as m from j group by all) join t using (key) group by key), i as (select key, greatest(hx.h + hp.h - hxy.h, 0) as mi, greatest(2 * hxy.h - hx.h - hp.h, 0) as vi, least(hx.h, hp.h) as low, hxy.h as hxy from hxy join hx using (key) join hp using (key))"
add("spearmans_rho", lambda s, d: D.spearmans_rho(pairs(s, d), "x", "p", ["key"]).select("key", rounded("rho").alias("value")), f"with {SERIES_SQL}, {RANKS} select key, {r6('rho')} as value from rho")
add("gpr_distance", lambda s, d: D.gpr_distance(pairs(s, d), "x", "p", ["key"], 0.5).select("key", rounded("distance").alias("value")), f"with {SERIES_SQL}, {RANKS} select key, {r6('pow(0.5 * (1 - rho), 0.5)')} as value from rho")
add("gnpr_distance", lambda s, d: D.gnpr_distance(pairs(s, d), "x", "p", ["key"], 0.5).select("key", rounded("distance").alias("value")), f"with {SERIES_SQL}, {RANKS}, {BINNED[len(PAIRS) + 2:]} select key, {r6('pow(0.5 * (1 - rho), 0.5) * (1 - case when low > 1e-15 then mi / low else 0 end)')} as value from rho join i using (key)")
add("mutual_information", lambda s, d: P.information(pairs(s, d), "x", "p", ["key"]).select("key", rounded("mutual_information").alias("mi"), rounded("nmi").alias("nmi")), f"with {SERIES_SQL}, {BINNED} select key, {r6('mi')} as mi, {r6('case when low > 1e-15 then mi / low else 0 end')} as nmi from i")
add("variation_of_information", lambda s, d: P.information(pairs(s, d), "x", "p", ["key"]).select("key", rounded("variation_of_information").alias("vi"), rounded("nvi").alias("nvi")), f"with {SERIES_SQL}, {BINNED} select key, {r6('vi')} as vi, {r6('case when hxy > 1e-15 then vi / hxy else 0 end')} as nvi from i")
add("joint_mutual_information", lambda s, d: P.joint_information(joint_table(s, d), "event_type", "b", "pr", ["m"]).select("m", rounded("mutual_information").alias("value")),
    f"with j as (select user_id % 5 as m, event_type as a, floor(value / 50) as b, count(*)::double as c from events group by all), q as (select *, c / sum(c) over (partition by m) as pr from j), z as (select *, sum(pr) over (partition by m, a) as pa, sum(pr) over (partition by m, b) as pb from q) select m, {r6('sum(pr * log2(pr / (pa * pb)))')} as value from z group by m")


def joint_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = table(spark, sf_dir, "events").groupBy((F.col("user_id") % 5).alias("m"), "event_type", F.floor(F.col("value") / 50).alias("b")).count()
    return j.withColumn("pr", F.col("count") / F.sum("count").over(W.Window.partitionBy("m")))


DCOR = f"{PAIRS}, d as (select a.key, a.idx as i, b.idx as j, abs(a.x - b.x) as u, abs(a.p - b.p) as v from q a join q b using (key)), e as (select key, u - avg(u) over (partition by key, i) - avg(u) over (partition by key, j) + avg(u) over (partition by key) as u, v - avg(v) over (partition by key, i) - avg(v) over (partition by key, j) + avg(v) over (partition by key) as v from d), f as (select key, avg(u * v) as c, avg(u * u) as a, avg(v * v) as b from e group by key)"
add("distance_correlation", lambda s, d: D.distance_correlation(pairs(s, d), "x", "p", ["key"], "idx").select("key", rounded("distance_correlation").alias("value")), f"with {SERIES_SQL}, {DCOR} select key, {r6('case when a * b > 1e-30 then least(sqrt(greatest(c, 0) / sqrt(a * b)), 1) else 0 end')} as value from f")
add("optimal_transport_dependence", lambda s, d: D.optimal_transport_dependence(pairs(s, d), "x", "p", ["key"], "idx").select("key", rounded("dependence").alias("value")),
    f"with {SERIES_SQL}, {PAIRS}, k as (select key, idx, (rank() over (partition by key order by x) + (count(*) over (partition by key, x) - 1) / 2.0::double) / count(*) over (partition by key) as u, (rank() over (partition by key order by p) + (count(*) over (partition by key, p) - 1) / 2.0::double) / count(*) over (partition by key) as v from q), g as (select a.key, a.idx, avg((b.u <= a.u and b.v <= a.v)::int::double) - any_value(a.u * a.v) as d from k a join k b using (key) group by a.key, a.idx) select key, {r6('case when count(*) > 1 then least(sqrt(avg(d * d)) * sqrt(12.0::double), 1) else 0 end')} as value from g group by key")
add("weighted_kendall_tau", lambda s, d: D.weighted_kendall_tau(pairs(s, d).withColumn("w", 1.0 / (F.col("idx") + 1)), "x", "p", "w", ["key"], "idx").select("key", rounded("tau").alias("value")),
    f"with {SERIES_SQL}, {PAIRS}, g as (select a.key, 1.0::double / (a.idx + 1) / (b.idx + 1) as w, sign(a.x - b.x) as u, sign(a.p - b.p) as v from q a join q b on a.key = b.key and a.idx < b.idx), h as (select key, coalesce(sum(w * u * v), 0) as t, coalesce(sum(w) filter (u <> 0 and v <> 0), 0) as b, coalesce(sum(w) filter (u = 0 and v <> 0), 0) as tx, coalesce(sum(w) filter (u <> 0 and v = 0), 0) as ty from g group by key), n as (select distinct key from q) select n.key, {r6('coalesce(case when sqrt((b + tx) * (b + ty)) > 1e-15 then t / sqrt((b + tx) * (b + ty)) else 0 end, 0)')} as value from n left join h on n.key = h.key")
# --- bars of trades per supplier ------------------------------------------------------------------------------------

#: Prices are cents over small integers: eight digits avoid ties, and traded money is exact.
BAR_OUT = ["open", "high", "low", "close"]
BAR_SELECT = ", ".join(f"round({c}, 8) as {c}" for c in BAR_OUT) + ", volume, round(vwap * volume, 4) as traded"


def bar_columns() -> list[Column]:
    return [*[F.round(c, 8).alias(c) for c in BAR_OUT], F.col("volume"), F.round(F.col("vwap") * F.col("volume"), 4).alias("traded")]


def bar_query(rule: B.BarRule) -> Callable[[SparkSession, str], DataFrame]:
    return lambda s, d: B.bars(trades(s, d), ["key"], TRADE_ORDER, rule).select("key", "bar_id", *bar_columns(), "ticks")


TICKS_SQL = "t as (select l_suppkey as key, row_number() over (partition by l_suppkey order by l_shipdate, l_orderkey, l_partkey, l_suppkey, l_linenumber) - 1 as i, l_shipdate as ts, l_extendedprice / l_quantity as price, l_quantity as volume from lineitem where l_quantity > 0)"
OHLCV_SQL = "select key, bar_id, round(min_by(price, i), 8) as open, round(max(price), 8) as high, round(min(price), 8) as low, round(max_by(price, i), 8) as close, sum(volume) as volume, round(sum(price * volume), 4) as traded, count(*) as ticks from z join t using (key, i) group by key, bar_id"


def threshold_sql(amount: str, threshold: float) -> str:
    """Bars whose sum of an amount reaches a threshold: a recursion carries the sum and the number of the bar."""
    return f"with recursive {TICKS_SQL}, a as (select *, {amount} as v from t), c as (select key, i, v as total, 0 as bar_id from a where i = 0 union all select a.key, a.i, case when c.total >= {threshold} then a.v else c.total + a.v end, case when c.total >= {threshold} then c.bar_id + 1 else c.bar_id end from c join a on a.key = c.key and a.i = c.i + 1), f as (select key, bar_id from c where total >= {threshold}), z as (select c.key, c.i, c.bar_id::bigint as bar_id from c join f using (key, bar_id)) {OHLCV_SQL}"


add("tick_bars", bar_query(B.BarRule("tick", 20)), f"with {BARS_SQL.format(size=20)} select key, idx as bar_id, {BAR_SELECT}, ticks from bars")
add("volume_bars", bar_query(B.BarRule("volume", 500.0)), threshold_sql("volume", 500.0))
add("dollar_bars", bar_query(B.BarRule("dollar", 500_000.0)), threshold_sql("price * volume", 500_000.0))
add("time_bars", bar_query(B.BarRule("time", 30 * 86400.0)),
    f"with recursive {TICKS_SQL}, c as (select key, i, ts as anchor, 0 as bar_id from t where i = 0 union all select t.key, t.i, case when t.ts >= c.anchor + interval 30 day then t.ts else c.anchor end, case when t.ts >= c.anchor + interval 30 day then c.bar_id + 1 else c.bar_id end from c join t on t.key = c.key and t.i = c.i + 1), m as (select key, max(bar_id) as last from c group by key), z as (select c.key, c.i, c.bar_id::bigint as bar_id from c join m using (key) where bar_id < last) {OHLCV_SQL}")
for _kind, _initial in (("tick", 10.0), ("volume", 300.0), ("dollar", 400_000.0)):
    _amount = {"tick": "1.0::double", "volume": "volume", "dollar": "price * volume"}[_kind]
    _sides = f"a as (select *, {_amount} * coalesce(last_value(nullif(sign(price - lag_price), 0) ignore nulls) over (partition by key order by i), 1) as signed, {_amount} as v from (select *, lag(price) over (partition by key order by i) as lag_price from t))"
    # theta, ticks: of the open bar; e1, e2: means of ticks and of |theta|; done: the bar ends here
    _imbalance = (
        f"c as (select key, i, 0.0::double as theta, 1 as n, null::double as e1, null::double as e2, {_initial}::double as e, false as done, 0 as bar_id from a where i = 0 union all"
        f" select key, i, th, m, case when fin then coalesce(2.0::double / 21 * m + 19.0::double / 21 * e1, m) else e1 end, case when fin then coalesce(2.0::double / 21 * abs(th) + 19.0::double / 21 * e2, abs(th)) else e2 end,"
        f" case when fin then coalesce(2.0::double / 21 * m + 19.0::double / 21 * e1, m) * abs(coalesce(2.0::double / 21 * abs(th) + 19.0::double / 21 * e2, abs(th))) else e end, fin, b"
        f" from (select *, abs(th) >= e and e > 0 as fin from (select a.key, a.i, case when c.done then a.signed else c.theta + a.signed end as th, case when c.done then 1 else c.n + 1 end as m, c.e1, c.e2, c.e, case when c.done then c.bar_id + 1 else c.bar_id end as b from c join a on a.key = c.key and a.i = c.i + 1)))"
    )
    _runs = (
        f"c as (select key, i, 0.0::double as buy, 0.0::double as sell, 1 as n, null::double as e1, null::double as e2, null::double as e3, {_initial}::double as e, false as done, 0 as bar_id from a where i = 0 union all"
        f" select key, i, u, w, m, case when fin then f1 else e1 end, case when fin then f2 else e2 end, case when fin then f3 else e3 end, case when fin then f1 * greatest(f2, f3) else e end, fin, b"
        f" from (select *, greatest(u, w) >= e and e > 0 as fin, coalesce(2.0::double / 21 * m + 19.0::double / 21 * e1, m) as f1, case when u + w > 0 then coalesce(2.0::double / 21 * (u / (u + w)) + 19.0::double / 21 * e2, u / (u + w)) else coalesce(19.0::double / 21 * e2, 0) end as f2, case when u + w > 0 then coalesce(2.0::double / 21 * (w / (u + w)) + 19.0::double / 21 * e3, w / (u + w)) else coalesce(19.0::double / 21 * e3, 0) end as f3"
        f" from (select a.key, a.i, case when c.done then 0 else c.buy end + case when a.signed > 0 then a.v else 0 end as u, case when c.done then 0 else c.sell end + case when a.signed < 0 then a.v else 0 end as w, case when c.done then 1 else c.n + 1 end as m, c.e1, c.e2, c.e3, c.e, case when c.done then c.bar_id + 1 else c.bar_id end as b from c join a on a.key = c.key and a.i = c.i + 1)))"
    )
    _ended = f"f as (select key, bar_id from c where done), z as (select c.key, c.i, c.bar_id::bigint as bar_id from c join f using (key, bar_id)) {OHLCV_SQL}"
    add(f"{_kind}_imbalance_bars", bar_query(B.BarRule(f"{_kind}_imbalance", 0, _initial, 20.0)), f"with recursive {TICKS_SQL}, {_sides}, {_imbalance}, {_ended}")
    add(f"{_kind}_runs_bars", bar_query(B.BarRule(f"{_kind}_runs", 0, _initial, 20.0)), f"with recursive {TICKS_SQL}, {_sides}, {_runs}, {_ended}")


def bars20(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.tick_bars(trades(spark, sf_dir), ["key"], TRADE_ORDER, 20).withColumnRenamed("bar_id", "idx")


def add_bars(name: str, make: Callable[[DataFrame], DataFrame], sql: str) -> None:
    add(name, lambda s, d: make(bars20(s, d)).select("key", "idx", rounded("value").alias("value")), f"with {BARS_SQL.format(size=20)} select key, idx, {r6('value')} as value from ({sql})")


add_bars("bar_mid_price", col(lambda: S.mid_price()), "select key, idx, (high + low) / 2 as value from bars")
add_bars("bar_typical_price", col(lambda: S.typical_price()), "select key, idx, (high + low + close) / 3 as value from bars")
add_bars("bar_dollar_volume", col(lambda: S.dollar_volume()), "select key, idx, vwap * volume as value from bars")
add_bars("parkinson_volatility", col(lambda: W.parkinson_volatility("high", "low", KEY, 5)), f"select key, idx, case when idx >= 4 then sqrt(sum(pow(ln(high / low), 2)) over {last_sql(5)} / (20 * ln(2.0::double))) end as value from bars")
add_bars("garman_klass_volatility", col(lambda: W.garman_klass_volatility("open", "high", "low", "close", KEY, 5)), f"select key, idx, case when idx >= 4 then sqrt(greatest(avg(0.5 * pow(ln(high / low), 2) - (2 * ln(2.0::double) - 1) * pow(ln(close / open), 2)) over {last_sql(5)}, 0)) end as value from bars")
add_bars("yang_zhang_volatility", lambda df: W.with_yang_zhang(df, KEY, 5, "value"),
         f"select key, idx, case when idx >= 5 then sqrt(greatest(var_samp(a) over {last_sql(5)} + {0.34 / (1.34 + 6 / 4)!r} * var_samp(b) over {last_sql(5)} + (1 - {0.34 / (1.34 + 6 / 4)!r}) * avg(rs) over {last_sql(5)}, 0)) end as value from (select key, idx, ln(open / lag(close) over w) as a, ln(close / lag(close) over w) as b, ln(high / close) * ln(high / open) + ln(low / close) * ln(low / open) as rs from bars {WIN})")
add_bars("corwin_schultz_spread", col(lambda: W.corwin_schultz_spread("high", "low", KEY)),
         f"select key, idx, case when h0 is not null then greatest(2 * (exp(al) - 1) / (1 + exp(al)), 0) end as value from (select *, (sqrt(2.0::double) - 1) * sqrt(pow(ln(high / low), 2) + pow(ln(h0 / l0), 2)) / (3 - 2 * sqrt(2.0::double)) - sqrt(pow(ln(greatest(high, h0) / least(low, l0)), 2) / (3 - 2 * sqrt(2.0::double))) as al from (select *, lag(high) over w as h0, lag(low) over w as l0 from bars {WIN}))")
add("vpin", lambda s, d: X.vpin(W.with_idx(trades(s, d), ["key"], TRADE_ORDER), ["key"], "idx", "price", "volume", 500.0, 5).select("key", "bucket", rounded("vpin").alias("value")),
    f"with recursive {TICKS_SQL}, a as (select *, coalesce(last_value(nullif(sign(price - q), 0) ignore nulls) over (partition by key order by i), 0) > 0 as buy from (select *, lag(price) over (partition by key order by i) as q from t)), c as (select key, i, volume as total, 0 as b from a where i = 0 union all select a.key, a.i, case when c.total >= 500 then a.volume else c.total + a.volume end, case when c.total >= 500 then c.b + 1 else c.b end from c join a on a.key = c.key and a.i = c.i + 1), f as (select key, b from c where total >= 500), g as (select key, b, abs(sum(case when buy then volume else -volume end)) as gap, sum(volume) as total from c join f using (key, b) join a using (key, i) group by key, b) select key, b::bigint as bucket, {r6('v')} as value from (select key, b, sum(gap) over w / sum(total) over w as v from g window w as (partition by key order by b rows between 4 preceding and current row)) where b >= 4")
add("flagship_hit_ratio", supplier_hit_ratio, FLAGSHIP_SQL)
add("aligned_time_bars", lambda s, d: B.aligned_time_bars(event_ticks(s, d), ["key"], ["ts", "event_id"], "1 day").select("key", "ts", *bar_columns(), "ticks"),
    "select user_id as key, date_trunc('day', ts)::timestamp as ts, round(min_by(value, (ts, event_id)), 8) as open, round(max(value), 8) as high, round(min(value), 8) as low, round(max_by(value, (ts, event_id)), 8) as close, sum(event_id % 97 + 1)::double as volume, round(sum(value * (event_id % 97 + 1)), 4) as traded, count(*) as ticks from events group by all")
# --- spans per user -------------------------------------------------------------------------------------------------


def of_spans(make: Callable[[DataFrame, DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def query(s: SparkSession, d: str) -> DataFrame:
        x = event_series(s, d)
        return make(spans(x), x)

    return query


COUNT_SQL = f"{SPANS_SQL}, g as (select s.key, s.idx, count(e.event_id) as n from s left join e on e.key = s.key and e.start <= s.idx and e.stop >= s.idx group by s.key, s.idx)"
UNIQUE_SQL = f"{COUNT_SQL}, u as (select e.key, e.event_id, any_value(return_value) as rv, avg(1.0::double / n) as u from e join g on g.key = e.key and g.idx between e.start and e.stop group by e.key, e.event_id)"
add("num_co_events", of_spans(lambda e, x: O.num_co_events(e, x, ["key"])), f"with {COUNT_SQL} select key, idx, n from g")
add("indicator_matrix", of_spans(lambda e, x: O.indicator_matrix(e, x, ["key"])), f"with {SPANS_SQL} select e.key, e.event_id, s.idx from e join s on e.key = s.key and s.idx between e.start and e.stop")
add("average_uniqueness", of_spans(lambda e, x: O.average_uniqueness(e, x, ["key"]).select("key", "event_id", rounded("uniqueness").alias("value"))), f"with {UNIQUE_SQL} select key, event_id, {r6('u')} as value from u")
add("return_attribution_weights", of_spans(lambda e, x: O.return_attribution_weights(e, x, ["key"]).select("key", "event_id", rounded("weight").alias("value"))),
    f"with {UNIQUE_SQL} select key, event_id, {r6('case when sum(u * abs(rv)) over (partition by key) > 1e-15 then u * abs(rv) * count(*) over (partition by key) / sum(u * abs(rv)) over (partition by key) else u * abs(rv) end')} as value from u")
add("avg_active_signals", of_spans(lambda e, x: O.avg_active_signals(e.withColumn("value", F.col("return_value")), x, ["key"]).select("key", "idx", rounded("signal").alias("value"))),
    f"with {SPANS_SQL} select s.key, s.idx, {r6('coalesce(avg(e.return_value), 0)')} as value from s left join e on e.key = s.key and s.idx between e.start and e.stop group by s.key, s.idx")
add("purged_kfold", of_spans(lambda e, x: O.PurgedKFold(4, 0.02).split(e.select("key", F.col("event_id").alias("idx"), "start", "end"), ["key"])),
    f"with {SERIES_SQL}, e as (select key, idx, idx as start, idx + 1 + event_id % 10 as stop, count(*) over (partition by key) as n from s), p as (select *, case when idx < (n % 4) * (n // 4 + 1) then idx // (n // 4 + 1) else n % 4 + (idx - (n % 4) * (n // 4 + 1)) // greatest(n // 4, 1) end as f from e), b as (select key, f as fold, min(start) as a, max(stop) as z, max(idx) as last from p group by key, f), r as (select p.key, b.fold::int as fold, p.idx, case when p.f = b.fold then 'test' when not (start <= z and stop >= a) and not (idx > last and idx <= last + ceil(n * 0.02)) then 'train' end as role from p join b on p.key = b.key) select * from r where role is not null")


def barrier_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = event_series(spark, sf_dir)
    entries = x.select("key", F.col("idx").alias("entry_idx"), F.lit(0.2).alias("vol"))
    return O.first_touches(entries, x.select("key", "idx", F.col("x").alias("price")), ["key"], O.TripleBarrier(2.0, 1.5, 8), ieee=True)


BARRIER_SQL = f"{SERIES_SQL}, n as (select key, max(idx) as last from s group by key), t as (select a.key, a.idx as entry_idx, b.idx as exit_idx, b.x / a.x - 1 as r, b.idx = least(a.idx + 8, last) as fin from s a join n using (key) join s b on b.key = a.key and b.idx > a.idx and b.idx <= least(a.idx + 8, last)), f as (select key, entry_idx, min(exit_idx) as exit_idx, min_by(r, exit_idx) as r from t where r >= 2.0 * 0.2 or r <= -1.5 * 0.2 or fin group by key, entry_idx)"
add("get_events", lambda s, d: barrier_events(s, d).select("key", "entry_idx", "exit_idx", "touch_type", rounded("return_value").alias("return_value")), f"with {BARRIER_SQL} select key, entry_idx, exit_idx, case when r >= 2.0 * 0.2 then 'upper' when r <= -1.5 * 0.2 then 'lower' else 'vertical' end as touch_type, {r6('r')} as return_value from f")
add("find_first_touch", lambda s, d: barrier_events(s, d).groupBy("key", "touch_type").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("exit_idx") - F.col("entry_idx")).alias("held")), f"with {BARRIER_SQL} select key, case when r >= 2.0 * 0.2 then 'upper' when r <= -1.5 * 0.2 then 'lower' else 'vertical' end as touch_type, count(*) as n, sum(exit_idx - entry_idx)::bigint as held from f group by all")
TREND_SQL = f"{SERIES_SQL}, v as (select a.key, a.idx, w.w, count(*)::double as n, regr_slope(b.x, b.idx) as sl, regr_syy(b.x, b.idx) as syy, regr_sxx(b.x, b.idx) as sxx, regr_sxy(b.x, b.idx) as sxy from s a cross join range(3, 13) w(w) join s b on b.key = a.key and b.idx >= a.idx and b.idx < a.idx + w.w group by a.key, a.idx, w.w having count(*) = w.w), t as (select *, case when syy <= 1e-9 then 0 when greatest(syy - sl * sxy, 0) <= 1e-12 * syy then sign(sl) * 1.7976931348623157e308 else sl / sqrt(greatest(syy - sl * sxy, 0) / (n - 2) / sxx) end as t, case when syy <= 1e-9 then 1 else 1 - greatest(syy - sl * sxy, 0) / syy end as r2 from v), f as (select key, idx, max_by(t, abs(t)) as t, max_by(r2, abs(t)) as r2, max_by(w, abs(t)) as w from (select * from t order by key, idx, w) group by key, idx)"
add("trend_scanning_labels", lambda s, d: X.trend_scanning(event_series(s, d), ["key"], "idx", "x", 12, 3).select("key", "idx", F.col("label").cast("long").alias("label"), F.round("r_squared", 4).alias("r_squared")), f"with {TREND_SQL} select key, idx, sign(t)::bigint as label, round(r2, 4) as r_squared from f")
add("trend_scanning_label_series", lambda s, d: X.trend_scanning(event_series(s, d), ["key"], "idx", "x", 6, 3).groupBy("key").agg(F.sum(F.col("label").cast("long")).alias("total"), F.count(F.lit(1)).alias("n")), f"with {TREND_SQL.replace('range(3, 13)', 'range(3, 7)')} select key, sum(sign(t))::bigint as total, count(*) as n from f group by key")

# --- matrices -------------------------------------------------------------------------------------------------------

EMB = "v as (select vec_id, label, " + ", ".join(f"embedding[{i + 1}]::double as e{i}" for i in range(8)) + " from embeddings)"
DIMS = [f"e{i}" for i in range(8)]


def matrix_sql(cell: Callable[[str, str, int, int], str]) -> str:
    sums = ", ".join(f"{cell(DIMS[min(i, j)], DIMS[max(i, j)], min(i, j), max(i, j))} as m{i}_{j}" for i in range(8) for j in range(8))
    return f"{EMB}, m as (select {sums} from v), " + "x as (" + " union all ".join(f"select {i} as i, {j} as j, m{i}_{j} as value from m" for i in range(8) for j in range(8)) + ")"


COV_SQL = matrix_sql(lambda a, b, i, j: f"covar_samp({a}, {b})")
CORR_SQL = matrix_sql(lambda a, b, i, j: "1.0::double" if i == j else f"corr({a}, {b})")
CORR_STD_SQL = (f"with {EMB}, m as materialized (select " + ", ".join(f"{'1.0::double' if i == j else f'corr({DIMS[min(i, j)]}, {DIMS[max(i, j)]})'} as m{i}_{j}" for i in range(8) for j in range(8)) + ", " + ", ".join(f"stddev_samp({c}) as s{i}" for i, c in enumerate(DIMS)) + " from v) "
    + " union all ".join(f"select {i} as i, {j} as j, {r6(f'm{i}_{j}')} as value, {r6(f's{i}')} as std_i from m" for i in range(8) for j in range(8)))
add("covariance_matrix", lambda s, d: M.covariance_matrix(embedding_columns(s, d), DIMS).select("i", "j", rounded("value").alias("value")), f"with {COV_SQL} select i, j, {r6('value')} as value from x")
add("correlation_matrix", lambda s, d: M.correlation_matrix(embedding_columns(s, d), DIMS).select("i", "j", rounded("value").alias("value")), f"with {CORR_SQL} select i, j, {r6('value')} as value from x")
add("distance_matrix", lambda s, d: M.distance_matrix(M.correlation_matrix(embedding_columns(s, d), DIMS), "angular").select("i", "j", rounded("value").alias("value")), f"with {CORR_SQL} select i, j, {r6('acos(greatest(least(value, 1), -1)) / pi()')} as value from x")
add("cov_to_corr", lambda s, d: M.cov_to_corr(M.covariance_matrix(embedding_columns(s, d), DIMS)).select("i", "j", rounded("value").alias("value"), rounded("std_i").alias("std_i")), CORR_STD_SQL)
add("corr_to_cov", lambda s, d: (lambda e: M.corr_to_cov(M.correlation_matrix(e, DIMS), M.covariance_matrix(e, DIMS).where("i = j").select(F.col("i").alias("k"), F.sqrt("value").alias("std"))))(embedding_columns(s, d)).select("i", "j", rounded("value").alias("value")), f"with {COV_SQL} select i, j, {r6('value')} as value from x")
add("norm_distance", lambda s, d: (lambda e: M.norm_distance(M.correlation_matrix(e.where("label % 2 = 0"), DIMS), M.correlation_matrix(e.where("label % 2 = 1"), DIMS)))(embedding_columns(s, d)).select(rounded("distance").alias("value")),
    f"with {EMB}, g as (select label % 2 as h, " + ", ".join(f"corr({DIMS[i]}, {DIMS[j]}) as m{i}_{j}" for i in range(8) for j in range(i + 1, 8)) + f" from v group by label % 2) select {r6('sqrt(2 * (' + ' + '.join(f'pow(max(m{i}_{j}) - min(m{i}_{j}), 2)' for i in range(8) for j in range(i + 1, 8)) + ')) / 8')} as value from g")
add("inverse_variance_weights", lambda s, d: M.inverse_variance_weights(M.covariance_matrix(embedding_columns(s, d), DIMS)).select("i", rounded("weight").alias("value")), f"with {COV_SQL} select i, {r6('(1 / value) / sum(1 / value) over ()')} as value from x where i = j")
add("dependence_matrix", lambda s, d: D.dependence_matrix(embedding_columns(s, d), DIMS[:4], "vec_id", "spearman").select("i", "j", rounded("value").alias("value")),
    f"with {EMB}, " + ", ".join(f"k{i} as (select vec_id, rank() over (order by e{i}) + (count(*) over (partition by e{i}) - 1) / 2.0::double as r from v)" for i in range(4)) + " " + " union all ".join(f"select {i} as i, {j} as j, {r6('1.0::double' if i == j else 'corr(a.r, b.r)')} as value from k{i} a join k{j} b using (vec_id)" for i in range(4) for j in range(4) if i != j) + " union all " + " union all ".join(f"select {i}, {i}, 1.0::double" for i in range(4)))
KDE_POINTS = [-0.3, -0.1, 0.0, 0.1, 0.3]
add("fit_kde", lambda s, d: M.fit_kde(embedding_columns(s, d), "e0", KDE_POINTS, 0.05).select(rounded("x").alias("x"), rounded("density").alias("value")),
    f"with {EMB}, q(x) as (values " + ", ".join(f"({p}::double)" for p in KDE_POINTS) + f") select {r6('x')} as x, {r6('avg(exp(-0.5 * pow((x - e0) / 0.05, 2))) / (0.05 * sqrt(2 * pi()))')} as value from v cross join q group by x")
STRATEGIES_SQL = f"{SERIES_SQL}, t as (select date_diff('day', date '2024-01-01', ts::date)::bigint as day, key % 8 as strategy, avg(least(r, 3.0)) as ret from s where r is not null group by all)"


def splits_sql(order: str) -> str:
    """Sums of each strategy on half of six groups of days and on the others, for each of the twenty halves."""
    halves = ", ".join(f"({k}, {list(c)})" for k, c in enumerate(itertools.combinations(range(6), 3)))
    return (
        f"{STRATEGIES_SQL}, dd as (select day, row_number() over (order by {order}) - 1 as i, count(*) over () as n from (select distinct day from t)), pg as (select strategy, least(i // greatest(1, n // 6), 5) as g, sum(ret) as v from t join dd using (day) group by all), "
        f"c(split, half) as (values {halves}), io as (select split, strategy, sum(case when list_contains(half, g) then v else 0 end) as inside, sum(case when list_contains(half, g) then 0 else v end) as outside from pg, c group by all), "
        "b as (select split, max((inside, strategy, outside)) as b, count(*) as n from io group by split)"
    )


add("cscv", lambda s, d: R.cscv(strategies(s, d), "day", 6).select(F.col("split").cast("long").alias("split"), "rank", rounded("logit").alias("logit"), "overfit"),
    f"with {splits_sql('day')}, r as (select split, n, (sum((outside > b[3])::int) + 1)::bigint as rank from io join b using (split) group by split, n) select split::bigint as split, rank, {r6('ln(rank / (n + 1 - rank))')} as logit, rank > n // 2 as overfit from r")
PBO_ORDER = "md5('0:' || day), day"
add("probability_of_backtest_overfitting", lambda s, d: R.probability_of_backtest_overfitting(strategies(s, d), "day", 6),
    f"with {splits_sql(PBO_ORDER)}, r as (select split, n, sum((outside <= b[3])::int) as rank from io join b using (split) group by split, n) select avg((rank <= n // 2)::int)::double as pbo from r")


def strategies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily returns of eight strategies: users by remainder."""
    x = event_series(spark, sf_dir).where("r is not null")
    day = F.datediff(F.col("ts"), F.lit("2024-01-01")).cast("long")
    return x.groupBy(day.alias("day"), (F.col("key") % 8).alias("strategy")).agg(F.avg(F.least("r", F.lit(3.0))).alias("ret"))


def with_k(make: Callable, columns: Callable[[SparkSession, str], DataFrame] = daily_assets, n: int = 5) -> Callable[[SparkSession, str], DataFrame]:
    """A k x k operator on the covariance and correlation of daily assets, its vector or matrix as rows."""

    def query(s: SparkSession, d: str) -> DataFrame:
        x = columns(s, d)
        names = [c for c in x.columns if c.startswith("a")]
        import numpy as np

        cov = M.to_numpy(M.covariance_matrix(x, names))
        sd = np.sqrt(np.diag(cov))
        out = make(cov, cov / np.outer(sd, sd), x)
        return M.to_frame(s, out) if np.ndim(out) == 2 else M.vector_frame(s, np.atleast_1d(out), "value")

    return query


def means_of(x: DataFrame):
    import numpy as np

    names = [c for c in x.columns if c.startswith("a")]
    row = x.agg(*[F.avg(c).alias(c) for c in names]).first()
    return np.array([row[c] for c in names])


add("hrp_weights", lambda s, d: M.hrp_weights(daily_assets(s, d), [f"a{i}" for i in range(5)]))
add("eigen", with_k(lambda cov, corr, x: M.eigen(cov)[0]))
add("matrix_inverse", with_k(lambda cov, corr, x: M.inverse(cov)))
add("pca_weights", with_k(lambda cov, corr, x: M.pca_weights(cov)))
add("optimal_portfolio", with_k(lambda cov, corr, x: M.optimal_portfolio(cov)))
add("cla_min_variance", with_k(lambda cov, corr, x: M.cla_min_variance(cov)))
add("cla_max_sharpe", with_k(lambda cov, corr, x: M.cla_max_sharpe(means_of(x), cov)))
add("static_optimization", with_k(lambda cov, corr, x: M.static_optimization(means_of(x), cov, 2.0)))
add("denoise_corr", with_k(lambda cov, corr, x: M.denoise_corr(corr, 10.0)))
add("denoise_cov", with_k(lambda cov, corr, x: M.denoise_cov(cov, 10.0)))
add("detone_corr", with_k(lambda cov, corr, x: M.detone_corr(corr, 1)))
add("single_linkage_order", with_k(lambda cov, corr, x: [float(i) for i in M.quasi_diag(M.single_linkage((0.5 * (1 - corr)).clip(0) ** 0.5), len(corr))]))
add("kullback_leibler_distance", with_k(lambda cov, corr, x: M.kullback_leibler_distance(corr, M.denoise_corr(corr, 10.0))))
add("feature_clusters", lambda s, d: R.feature_clusters(embedding_columns(s, d), DIMS))
add("silhouette_score", lambda s, d: R.silhouette_score(embedding_columns(s, d).where("label is not null"), DIMS, "label", "vec_id").select(rounded("silhouette").alias("value")),
    f"with {EMB}, d as (select a.vec_id, a.label as own, b.label as other, sum(sqrt({' + '.join(f'pow(a.{c} - b.{c}, 2)' for c in DIMS)})) as t, count(*) as n from v a cross join v b group by all), m as (select vec_id, max(case when own = other then case when n > 1 then t / (n - 1) else 0 end end) as a, min(case when own <> other then t / n end) as b from d group by vec_id) select {r6('avg(case when b is null or greatest(a, b) <= 1e-15 then 0 else (b - a) / greatest(a, b) end)')} as value from m")
add("orthogonal_features", lambda s, d: R.orthogonal_features(embedding_columns(s, d), DIMS, 3)[0].select("vec_id", *[rounded(f"pc{k}").alias(f"pc{k}") for k in range(3)]))
# --- classifiers over vectors ---------------------------------------------------------------------------------------


def forest(sf_dir: str) -> C.Forest:
    """Twenty trees on the square root of the features; the same for the same rows."""
    return C.Forest(C.RandomForestConfig(20, ("sqrt", 0)), 7, 5, ("vec_id",))


def vector_folds(vectors: DataFrame, embargo: float) -> DataFrame:
    return O.PurgedKFold(4, embargo).split(vectors.select("idx", F.col("idx").alias("start"), (F.col("idx") + 3).alias("end")), [])


def labelled_sql() -> str:
    return f"{EMB}, x as (select *, label as y, row_number() over (order by vec_id) - 1 as idx from v)"


def folds_sql(embargo: float) -> str:
    """fold, idx and role of spans of three more rows, in four folds."""
    return (
        "n as (select count(*) as n from x), pf as (select idx, case when idx < (n % 4) * (n // 4 + 1) then idx // (n // 4 + 1) else (n % 4) + (idx - (n % 4) * (n // 4 + 1)) // (n // 4) end as own from x, n), "
        "sp as (select own as fold, min(idx) as a, max(idx) + 3 as b, max(idx) as last from pf group by own), "
        f"roles as (select fold, idx, case when own = fold then 'test' when not (idx <= b and idx + 3 >= a) and not (idx > last and idx <= last + ceil(n * {embargo})) then 'train' end as role from pf, sp, n)"
    )


def nearest_sql(dims: list[str]) -> str:
    return " + ".join(f"pow({c} - m{c}, 2)" for c in dims)


def fold_scores_sql(dims: list[str]) -> str:
    return (
        f"fm as (select fold, y as c, {', '.join(f'avg({c}) as m{c}' for c in dims)} from roles join x using (idx) where role = 'train' group by fold, y), "
        f"fp as (select fold, idx, any_value(y) as y, min((({nearest_sql(dims)}), c)) as n from roles join x using (idx) join fm using (fold) where role = 'test' group by fold, idx), scores as (select fold::int as fold, avg((n[2] = y)::int) as score from fp group by fold)"
    )


# --- scans without SQL ----------------------------------------------------------------------------------------------

add("lempel_ziv_complexity", lambda s, d: X.lempel_ziv(event_series(s, d).withColumn("b", F.coalesce(S.binary_encode(F.col("x") - F.col("p")), F.lit(False))), ["key"], "idx", "b"))
add("kontoyiannis_entropy", lambda s, d: X.kontoyiannis_entropy(P.with_quantile_code(event_series(s, d), "x", ["key"], ["idx"], 10), ["key"], "idx", "code", 10))
add("adf_test", lambda s, d: X.adf_test(event_series(s, d), ["key"], "idx", "x", 1))
add("sadf", lambda s, d: X.sadf(event_series(s, d), ["key"], "idx", "x", 20, 1))
add("sadf_stat", lambda s, d: X.sup_statistic(X.sadf(event_series(s, d), ["key"], "idx", "x", 20, 1), ["key"]))
add("gsadf_stat", lambda s, d: X.gsadf_stat(event_series(s, d), ["key"], "idx", "x", 20, 1))
MIN_D_GRID = list(itertools.accumulate([0.1] * 10))
FFD_GRID = " union all ".join(f"select key, {d!r}::double as d, idx, {' + '.join(f'({w!r}::double) * lag(x, {k}) over w' for k, w in enumerate(X.frac_weights_ffd(d, 1e-2)))} as v from s {WIN}" for d in MIN_D_GRID)
add("find_min_d", lambda s, d: X.find_min_d(event_series(s, d), ["key"], "idx", "x", 1.0, 0.1, 1e-2).select("key", rounded("min_d").alias("min_d")),
    f"with {SERIES_SQL}, f as ({FFD_GRID}), g as (select key, d, v, row_number() over q - 1 as i, count(*) over (partition by key, d) as n from f where v is not null window q as (partition by key, d order by idx)), "
    "h as (select key, d, n, var_samp(v) as vv, avg(v) filter (i < n // 2) - avg(v) filter (i >= n // 2) as gap, coalesce(var_samp(v) filter (i < n // 2), 0) as a, coalesce(var_samp(v) filter (i >= n // 2), 0) as b from g group by all), "
    "o as (select key, min(d) as d from h where n >= 4 and (vv < 1e-15 or (case when greatest(a, b) > 1e-15 then least(a, b) / greatest(a, b) else 1 end > 0.3 and abs(gap) / sqrt(vv) < 1.0)) group by key) "
    f"select key, {r6('coalesce(d, 1.0)')} as min_d from (select distinct key from s) left join o using (key)")  # fmt: skip
add("hasbrouck_lambda", lambda s, d: X.hasbrouck_lambda(event_series(s, d).where("r is not null").withColumn("g", F.signum(F.col("x") - F.col("p"))), "r", "g", ["key"], 400, 7))
add("sequential_bootstrap", lambda s, d: R.sequential_bootstrap(spans(event_series(s, d)), ["key"], None, None, 7))
add("compare_bootstraps", lambda s, d: R.compare_bootstraps(spans(event_series(s, d)), ["key"], None, None, 4, 7))
add("otr_mesh", lambda s, d: R.otr_mesh(ou_params(s, d), [0.5, 1.0], [0.5, 1.0], 4, 7, 0.01, 500))
add("mean_decrease_accuracy", lambda s, d: C.mean_decrease_accuracy(labelled_vectors(s, d), DIMS[:4], "y", "idx", C.NearestCentroid().fit(labelled_vectors(s, d), DIMS[:4], "y"), 7).select("feature", rounded("importance").alias("value")),
    f"with {labelled_sql()}, m as (select y as c, {', '.join(f'avg({c}) as m{c}' for c in DIMS[:4])} from x group by y), e as (select x.*, f, row_number() over (partition by f order by idx) as own, row_number() over (partition by f order by md5('7:' || f || ':' || idx), idx) as given from x cross join (values (0), (1), (2), (3)) t(f)), "
    f"w as (select a.idx, a.y, a.f, {', '.join(f'case when a.f = {i} then b.{c} else a.{c} end as {c}' for i, c in enumerate(DIMS[:4]))} from e a join e b on a.f = b.f and a.own = b.given), z as (select *, -1 as g from x), q as (select idx, y, f, {', '.join(DIMS[:4])} from w union all select idx, y, g, {', '.join(DIMS[:4])} from z), "
    f"p as (select q.idx, q.f, any_value(q.y) as y, min((({nearest_sql(DIMS[:4])}), c)) as n from q cross join m group by q.idx, q.f), r as (select f, avg((n[2] = y)::int) as score from p group by f) select 'e' || f as feature, {r6('(select score from r where f = -1) - score')} as value from r where f >= 0")  # fmt: skip
add("cv_score", lambda s, d: (lambda v: C.cv_scores(v, DIMS, "y", vector_folds(v, 0.01), "idx", C.NearestCentroid()))(labelled_vectors(s, d)).select("fold", rounded("score").alias("value")),
    f"with {labelled_sql()}, {folds_sql(0.01)}, {fold_scores_sql(DIMS)} select fold, {r6('score')} as value from scores")
add("single_feature_importance", lambda s, d: (lambda v: C.single_feature_importance(v, DIMS[:4], "y", vector_folds(v, 0.0), "idx", C.NearestCentroid()))(labelled_vectors(s, d)).select("feature", rounded("score").alias("value")),
    " union all ".join(f"select * from (with {labelled_sql()}, {folds_sql(0.0)}, {fold_scores_sql([c])} select '{c}' as feature, {r6('avg(score)')} as value from scores)" for c in DIMS[:4]))
add("forest_accuracy", lambda s, d: (lambda v: C.cv_scores(v, DIMS, "y", vector_folds(v, 0.01), "idx", forest(d)))(labelled_vectors(s, d)).select("fold", rounded("score").alias("value")))
add("forest_importances", lambda s, d: R.mean_decrease_impurity(forest(d).fit(labelled_vectors(s, d), DIMS, "y").tree_importances(), "feature", "importance").select("feature", rounded("importance").alias("value")))
add("mean_decrease_impurity", lambda s, d: R.mean_decrease_impurity(table(s, d, "lineitem"), "l_linenumber", "l_discount").select("l_linenumber", rounded("importance").alias("value")), f"select l_linenumber, {r6('avg(l_discount)')} as value from lineitem group by l_linenumber")
add("trajectories", lambda s, d: R.expected_value(R.trajectories(customers(s, d), "rho", [-0.1, 0.0, 0.2], 3), F.greatest(F.element_at("path", -1), F.lit(0.0)), ["id"]).select("id", rounded("value").alias("value")),
    f"with {CUSTOMER_SQL}, m(m) as (values (-0.1::double), (0.0::double), (0.2::double)) select id, {r6('avg(greatest(rho + a.m + b.m + e.m, 0))')} as value from c cross join m a cross join m b cross join m e group by id")
add("etf_trick", lambda s, d: W.etf_trick(monthly(s, d), "month", "asset", "price", "weight").select("month", rounded("value").alias("value")),
    f"with m as (select date_trunc('year', l_shipdate)::timestamp as month, l_returnflag as asset, avg(l_extendedprice / l_quantity) as price, 0.5::double as weight from lineitem where l_quantity > 0 group by all), g as (select month, sum(weight * price) as v, sum(w0 * price / p0) as f from (select *, lag(price) over w as p0, lag(weight) over w as w0 from m window w as (partition by asset order by month)) group by month) select month, {r6('first_value(v) over (order by month) * exp(coalesce(sum(ln(f)) over (order by month), 0))')} as value from g")
add("bootstrap_rows", lambda s, d: R.standard_bootstrap(W.with_idx(table(s, d, "part").withColumn("one", F.lit(0)), ["one"], ["p_partkey"]), "idx", table(s, d, "part").count(), table(s, d, "part").count(), 7).select("trial", "p_partkey"))
add("uniform_sample", lambda s, d: P.uniform_sample(event_series(s, d), ["key"], "idx", 10, 7).select("key", "idx", "x"),
    f"with recursive {SERIES_SQL}, g(i, state) as (select 0, 7::hugeint union all select i + 1, (state * 6364136223846793005 + 1442695040888963407) % 18446744073709551616 from g where i < 20), l as (select key, count(*) as n from s group by key), "
    "p as (select key, idx, row_number() over (partition by key order by idx) as k from (select distinct key, ((state // 65536) % n)::bigint as idx from g, l where i > 0)) select key, idx, x from p join s using (key, idx) where k <= 10")  # fmt: skip
add("linspace_sample", lambda s, d: P.linspace_rows(event_series(s, d), ["key"], "idx", 5).select("key", "i", "idx", "x"),
    f"with {SERIES_SQL}, l as (select key, max(idx) as last from s group by key), p as (select key, i, floor(i * (last / 4.0::double) + 0.5)::bigint as idx from l, range(5) t(i)) select key, i, idx, x from p join s using (key, idx)")
add("gsadf", lambda s, d: X.gsadf(event_series(s, d), ["key"], "idx", "x", 20, 1))


def monthly(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "lineitem").where("l_quantity > 0")
    return t.groupBy(F.date_trunc("year", "l_shipdate").alias("month"), F.col("l_returnflag").alias("asset")).agg(F.avg(F.col("l_extendedprice") / F.col("l_quantity")).alias("price"), F.lit(0.5).alias("weight"))


def ou_params(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = series_of_changes(spark, sf_dir).groupBy((F.col("key") % 10).alias("key")).agg(A.estimate_ou("x", "nx", 1.0).alias("o"))
    return e.select("key", "o.theta", "o.mu", "o.sigma").where("theta > 0")


def labelled_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.numbered(embedding_columns(spark, sf_dir).withColumn("y", F.col("label")), ["vec_id"])
