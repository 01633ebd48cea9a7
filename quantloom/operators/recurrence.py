"""First-order linear recurrences as a blocked prefix scan, on native windows and joins.

Each step y = r y' + u is an affine map of the value before it. A series is cut into blocks; within a block the maps
compose to a weighted running sum, and a whole block is again one affine map, of ratio r to the block's length. So the
blocks are a shorter series of the same kind, which the same scan solves, and a second pass applies each block's
starting value to its rows. A long key is thus as many tasks' work as it has blocks.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..errors import InvalidParameter

#: Rows of a block at most, and how far (in powers of ten) a value may fade within one: its weights stay far from overflow.
BLOCK, FADE = 4096, 60.0


def block_length(ratio: float, block: int = BLOCK) -> int:
    return max(1, min(block, int(FADE / -math.log10(abs(ratio)))))


def affine_scan(df: DataFrame, keys: Sequence[str], idx: str, u: str, ratio: float, block: int = BLOCK) -> DataFrame:
    """The rows with ``__y``: y = ratio y' + u along idx, which counts a key's rows from 0; y' is 0 before the first.

    |ratio| is below 1. A value that has faded by 60 powers of ten within a block is carried one block further and no more.
    """
    keys = list(keys)
    if not -1 < ratio < 1:
        raise InvalidParameter(f"ratio {ratio}")
    if ratio == 0:
        return df.withColumn("__y", F.col(u))
    size = block_length(ratio, block)
    d = df.withColumns({"__block": F.floor(F.col(idx) / size).cast("long"), "__k": (F.col(idx) % size).cast("double")})
    within = Window.partitionBy(*keys, "__block").orderBy(idx).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    r = F.lit(float(ratio))
    d = d.withColumn("__own", F.pow(r, F.col("__k")) * F.sum(F.col(u) * F.pow(r, -F.col("__k"))).over(within))
    ends = d.groupBy(*keys, "__block").agg(F.max_by("__own", "__k").alias("__end"))
    if size < block:  # what came before the last block is nothing any more
        before = ends.select(*keys, (F.col("__block") + 1).alias("__block"), F.col("__end").alias("__before"))
    else:
        solved = affine_scan(ends.withColumnRenamed("__block", "__at"), keys, "__at", "__end", ratio**size, block)
        before = solved.select(*keys, (F.col("__at") + 1).alias("__block"), F.col("__y").alias("__before"))
    d = d.join(before, [*keys, "__block"], "left")
    y = F.col("__own") + F.coalesce(F.pow(r, F.col("__k") + 1) * F.col("__before"), F.lit(0.0))
    return d.withColumn("__y", y).drop("__block", "__k", "__own", "__before")
