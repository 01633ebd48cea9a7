"""Column functions, and their registration for SQL."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: SQL bodies of scalar functions by name and parameters.
SQL_FUNCTIONS = {
    "sigmoid_bet_size(p DOUBLE)": "greatest(least(2 * p - 1, 1.0D), -1.0D)",
    "discrete_signal(x DOUBLE, step DOUBLE)": "CASE WHEN step <= 0 OR isnan(x) THEN 0.0D ELSE signum(x / step) * floor(abs(x / step) + 0.5) * step END",
    "gaussian_entropy(v DOUBLE)": "0.5 * log2(2 * pi() * e() * v)",
    "entropy_implied_vol(h DOUBLE)": "sqrt(pow(2.0D, 2 * h) / (2 * pi() * e()))",
    "angular_distance(rho DOUBLE)": "acos(greatest(least(rho, 1.0D), -1.0D)) / pi()",
    "correlation_distance(rho DOUBLE)": "sqrt(greatest(0.5 * (1 - rho), 0.0D))",
}


def register(spark: SparkSession) -> list[str]:
    """Make the scalar functions available in SQL as temporary functions; their bodies are inlined by the optimizer."""
    for signature, body in SQL_FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {signature} RETURNS DOUBLE RETURN {body}")
    return [s.split("(")[0] for s in SQL_FUNCTIONS]
