"""Pairwise dependence of long paired samples: rows (keys, x, y)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..errors import InvalidParameter
from ..functions.aggregates import pearson
from .dominance import dominance_sums, loose_positions, strict_positions
from .sampling import average_rank, information


def spearmans_rho(df: DataFrame, x: str, y: str, keys: Sequence[str], name: str = "rho") -> DataFrame:
    ranked = df.select(*keys, average_rank(x, keys).alias("__rx"), average_rank(y, keys).alias("__ry"))
    return ranked.groupBy(*keys).agg(F.greatest(F.least(pearson("__rx", "__ry"), F.lit(1.0)), F.lit(-1.0)).alias(name))


def gpr_distance(df: DataFrame, x: str, y: str, keys: Sequence[str], theta: float) -> DataFrame:
    if theta < 0:
        raise InvalidParameter("theta")
    return spearmans_rho(df, x, y, keys).select(*keys, F.pow(0.5 * (1 - F.col("rho")), F.lit(float(theta))).alias("distance"))


def gnpr_distance(df: DataFrame, x: str, y: str, keys: Sequence[str], theta: float, bins: int | None = None) -> DataFrame:
    g = gpr_distance(df, x, y, keys, theta)
    return g.join(information(df, x, y, keys, bins).select(*keys, "nmi"), list(keys)).select(*keys, (F.col("distance") * (1 - F.col("nmi"))).alias("distance"))


def distance_correlation(df: DataFrame, x: str, y: str, keys: Sequence[str], order: str, strip: int | None = None) -> DataFrame:
    """(keys, distance_correlation): Szekely's coefficient over all pairs of a key's rows, in n log n.

    Sums of distances to all rows come from running sums. The sum of products of distances is that of products of
    differences with the sign of discordant pairs turned, and concordant pairs are those of dominated points.
    ``order`` is unique in the key.
    """
    keys = list(keys)
    whole = Window.partitionBy(*keys)
    d = df.select(*keys, F.col(order).alias("__i"), F.col(x).cast("double").alias("__x"), F.col(y).cast("double").alias("__y"))
    d = d.withColumns({"__n": F.count(F.lit(1)).over(whole), "__x": F.col("__x") - F.avg("__x").over(whole), "__y": F.col("__y") - F.avg("__y").over(whole)})

    def distances(v: str):
        upto = Window.partitionBy(*keys).orderBy(v, "__i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        return F.col(v) * (2 * F.count(F.lit(1)).over(upto) - F.col("__n")) + F.sum(v).over(whole) - 2 * F.sum(v).over(upto)

    px, py = strict_positions("__x", "__y", keys, "__i")
    d = d.withColumns({"__a": distances("__x"), "__b": distances("__y"), "__px": px, "__py": py, "__one": F.lit(1.0), "__xy": F.col("__x") * F.col("__y")})
    d = dominance_sums(d, keys, "__px", "__py", ["__one", "__x", "__y", "__xy"], strip)
    concordant = F.sum(F.col("__xy") * F.col("__d0") - F.col("__x") * F.col("__d2") - F.col("__y") * F.col("__d1") + F.col("__d3"))
    of = lambda c: F.sum(F.col(c))
    made = d.groupBy(*keys).agg(
        F.count(F.lit(1)).cast("double").alias("n"), concordant.alias("p"), *(of(f"__{c}").alias(c) for c in ("x", "y", "xy", "a", "b")), *(F.sum(F.col(f"__{g}") * F.col(f"__{h}")).alias(g + h) for g, h in ("xx", "yy", "ab", "aa", "bb"))
    )
    cov = "2 * (2 * p - (n * xy - x * y)) / (n * n) + a / (n * n) * b / (n * n) - 2 * ab / (n * n * n)"
    var = lambda v, s: f"2 * (n * {v}{v} - {v} * {v}) / (n * n) + pow({s} / (n * n), 2) - 2 * {s}{s} / (n * n * n)"
    made = made.selectExpr(*[f"`{k}`" for k in keys], f"greatest({cov}, 0D) as cov", f"greatest({var('x', 'a')}, 0D) * greatest({var('y', 'b')}, 0D) as scale")
    return made.select(*keys, F.expr("case when scale > 1e-30 then least(sqrt(cov / sqrt(scale)), 1D) else 0D end").alias("distance_correlation"))


def optimal_transport_dependence(df: DataFrame, x: str, y: str, keys: Sequence[str], order: str, strip: int | None = None) -> DataFrame:
    """(keys, dependence): root mean square gap of the empirical copula to independence, times sqrt(12), within 0 and 1.

    The copula at a row counts the rows that are at most as large in both; ``order`` is unique in the key.
    """
    keys = list(keys)
    d = df.select(*keys, F.col(order).alias("__i"), F.col(x).cast("double").alias("__x"), F.col(y).cast("double").alias("__y"))
    px, py = loose_positions("__x", "__y", keys, "__i")
    n = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    d = d.withColumns({"__px": px, "__py": py, "__one": F.lit(1.0), "__n": n, "__u": average_rank("__x", keys) / n, "__v": average_rank("__y", keys) / n})
    d = dominance_sums(d, keys, "__px", "__py", ["__one"], strip)
    # of equal rows, the last one has all others below it
    equal = d.groupBy(*keys, "__u", "__v", "__n").agg(F.max("__d0").alias("__below"), F.count(F.lit(1)).alias("__copies"))
    gap = (F.col("__below") + 1) / F.col("__n") - F.col("__u") * F.col("__v")
    made = equal.groupBy(*keys).agg(F.sum(F.col("__copies") * gap * gap).alias("__s"), F.max("__n").alias("__n"))
    return made.select(*keys, F.when(F.col("__n") > 1, F.least(F.sqrt(F.col("__s") / F.col("__n")) * 12**0.5, F.lit(1.0))).otherwise(F.lit(0.0)).alias("dependence"))


def weighted_kendall_tau(df: DataFrame, x: str, y: str, weight: str, keys: Sequence[str], order: str, strip: int | None = None) -> DataFrame:
    """(keys, tau): tau-b with pair weights w_i w_j; pairs tied in both are left out. ``order`` is unique in the key.

    Values less than 1e-15 above the next smaller one are tied with it. Concordant weight comes from dominated points,
    tied weight from sums over equal values.
    """
    keys = list(keys)
    d = df.select(*keys, F.col(order).alias("__i"), F.col(x).cast("double").alias("__x"), F.col(y).cast("double").alias("__y"), F.col(weight).cast("double").alias("__w"))

    def tied(v: str):
        w = Window.partitionBy(*keys).orderBy(v, "__i")
        return F.when(F.col(v) - F.lag(v).over(w) < 1e-15, F.lit(0)).otherwise(F.lit(1))

    d = d.withColumns({"__sx": tied("__x"), "__sy": tied("__y")})
    classes = lambda s, v: F.sum(s).over(Window.partitionBy(*keys).orderBy(v, "__i").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    d = d.select(*keys, "__i", "__w", classes("__sx", "__x").alias("__x"), classes("__sy", "__y").alias("__y"))
    px, py = strict_positions("__x", "__y", keys, "__i")
    equal = lambda *by: F.sum("__w").over(Window.partitionBy(*keys).orderBy(*by).rangeBetween(Window.currentRow, Window.currentRow))
    d = d.withColumns({"__px": px, "__py": py, "__ex": equal("__x"), "__ey": equal("__y"), "__exy": equal("__x", "__y")})
    pairs = lambda e: F.sum(F.col("__w") * (F.col(e) - F.col("__w"))) / 2  # noqa: E731  the weight of the pairs within equal values
    w = F.sum("__w")
    found = dominance_sums(d, keys, "__px", "__py", ["__w"], strip).groupBy(*keys).agg(
        F.sum(F.col("__w") * F.col("__d0")).alias("c"), ((w * w - F.sum(F.col("__w") * F.col("__w"))) / 2).alias("t"), pairs("__ex").alias("x"), pairs("__ey").alias("y"), pairs("__exy").alias("xy")
    )
    found = found.selectExpr(*[f"`{k}`" for k in keys], "c", "t - x - y + xy as both", "case when least(t - x, t - y) > 1e-14 * t then sqrt((t - y) * (t - x)) else 0D end as scale")
    return found.select(*keys, F.expr("case when scale > 1e-15 then (2 * c - both) / scale else 0D end").alias("tau"))


def dependence_matrix(df: DataFrame, columns: Sequence[str], order: str, method: str = "pearson") -> DataFrame:
    """(i, j, value) for pearson, spearman, distance_correlation, mutual_information or variation_of_information.

    Pairs of columns become keys of long rows, so that all pairs are worked on at once.
    """
    k = len(columns)
    cells = [F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.col(columns[i]).cast("double").alias("x"), F.col(columns[j]).cast("double").alias("y")) for i in range(k) for j in range(i, k)]
    long = df.select(F.col(order).alias("idx"), F.inline(F.array(*cells)))
    keys = ["i", "j"]
    if method == "pearson":
        half = long.groupBy(*keys).agg(pearson("x", "y").alias("value"))
    elif method == "spearman":
        half = spearmans_rho(long, "x", "y", keys, "value")
    elif method == "distance_correlation":
        half = distance_correlation(long, "x", "y", keys, "idx").withColumnRenamed("distance_correlation", "value")
    elif method in ("mutual_information", "variation_of_information"):
        half = information(long, "x", "y", keys).select(*keys, F.col("nmi" if method == "mutual_information" else "nvi").alias("value"))
    else:
        raise InvalidParameter(method)
    if method in ("pearson", "spearman", "distance_correlation"):
        half = half.withColumn("value", F.when(F.col("i") == F.col("j"), F.lit(1.0)).otherwise(F.col("value")))
    return half.unionByName(half.where("i < j").select(F.col("j").alias("i"), F.col("i").alias("j"), "value"))
