"""Sums over dominated points: for each row, what the rows of its key with smaller x and smaller y hold.

Rows get two positions in their key, by x and by y, and are cut into strips of equal length along both. What a row
dominates lies in its own strip of x, in its own strip of y, or in a cell of the grid of strips that is below and left
of its own. Within a strip a binary tree over positions (one vectorised pass a level) gives the sums in n log n; the
grid's sums are prefix sums over few cells. A long key is the work of as many tasks as it has strips.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..shipping import ship_package

#: Rows of a strip at least, and strips along one side at most: the grid has a million cells.
STRIP, SIDE = 65_536, 1_000


def dominated(a: np.ndarray, b: np.ndarray, values: Sequence[np.ndarray]) -> list[np.ndarray]:
    """For each i the sum of each value over the j with a[j] < a[i] and b[j] < b[i]; no two b are equal.

    Two numbers differ first in some bit, above which they are equal: there the smaller one has a 0. For each bit, rows
    of equal upper bits are taken in the order of b, and a 1 gets what the 0s before it hold.
    """
    by_b = np.argsort(b, kind="stable")
    a, values = np.asarray(a, np.int64)[by_b], [np.asarray(v, float)[by_b] for v in values]
    sums = [np.zeros(len(a)) for _ in values]
    for bit in range(int(a.max()).bit_length() if len(a) else 0):
        order = np.argsort(a >> (bit + 1), kind="stable")
        group, one = a[order] >> (bit + 1), (a[order] >> bit & 1).astype(bool)
        begins = np.maximum.accumulate(np.where(np.r_[True, group[1:] != group[:-1]], np.arange(len(group)), 0))
        for v, s in zip(values, sums, strict=True):
            upto = np.cumsum(np.where(one, 0.0, v[order]))
            before = upto - np.where(one, 0.0, v[order])
            s[order] += np.where(one, upto - before[begins], 0.0)
    out = []
    for s in sums:
        placed = np.empty(len(s))
        placed[by_b] = s
        out.append(placed)
    return out


def strict_positions(x: str, y: str, keys: Sequence[str], tie: str) -> tuple[Column, Column]:
    """Positions by x and by y such that both are smaller just where x and y are both smaller; ``tie`` is unique in the key."""
    by = lambda *o: (F.row_number().over(Window.partitionBy(*keys).orderBy(*o)) - 1).cast("long")
    return by(F.asc(x), F.desc(y), F.asc(tie)), by(F.asc(y), F.desc(x), F.desc(tie))


def loose_positions(x: str, y: str, keys: Sequence[str], tie: str) -> tuple[Column, Column]:
    """Positions such that both are smaller where x and y are both smaller or equal; of equal rows, where ``tie`` is smaller."""
    by = lambda *o: (F.row_number().over(Window.partitionBy(*keys).orderBy(*o)) - 1).cast("long")
    return by(x, y, tie), by(y, x, tie)


def dominance_sums(df: DataFrame, keys: Sequence[str], px: str, py: str, values: Sequence[str], strip: int | None = None) -> DataFrame:
    """The rows with ``__d0``, ``__d1``, ...: for each value its sum over the key's rows of smaller px and smaller py.

    px and py each number the key's rows from 0. Values are doubles; the order of rows is not kept.
    """
    ship_package(df.sparkSession)
    keys, values = list(keys), list(values)
    names = [f"__d{i}" for i in range(len(values))]
    longest = df.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0
    strip = strip or max(STRIP, -(-longest // SIDE))
    df = df.withColumns({"__bx": F.floor(F.col(px) / strip).cast("long"), "__by": F.floor(F.col(py) / strip).cast("long")} | {n: F.lit(0.0) for n in names})
    shape = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)

    def adder(a: str, b: str):
        def add(rows: pa.Table) -> pa.Table:
            got = dominated(rows[a].to_numpy(), rows[b].to_numpy(), [rows[v].to_numpy() for v in values])
            for n, s in zip(names, got, strict=True):
                rows = rows.set_column(rows.schema.get_field_index(n), n, pa.array(rows[n].to_numpy() + s))
            return rows

        return add

    df = df.groupBy(*keys, "__bx").applyInArrow(adder(px, py), shape)
    if longest > strip:
        df = df.groupBy(*keys, "__by").applyInArrow(adder("__bx", py), shape)
        cells = df.groupBy(*keys, "__bx", "__by").agg(*(F.sum(v).alias(f"__v{i}") for i, v in enumerate(values)))
        kinds = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)

        def prefix(grid: pa.Table) -> pa.Table:
            grid = grid.sort_by([("__by", "ascending"), ("__bx", "descending")])  # so cells of one row of the grid don't count for each other
            got = dominated(grid["__bx"].to_numpy(), np.arange(grid.num_rows), [grid[f"__v{i}"].to_numpy() for i in range(len(values))])
            return pa.table([*(grid[c] for c in [*keys, "__bx", "__by"]), *map(pa.array, got)], [*keys, "__bx", "__by", *(f"__g{i}" for i in range(len(values)))])

        below = cells.groupBy(*keys).applyInArrow(prefix, f"{kinds}, __bx long, __by long, " + ", ".join(f"__g{i} double" for i in range(len(values))))
        df = df.join(below, [*keys, "__bx", "__by"]).withColumns({n: F.col(n) + F.col(f"__g{i}") for i, n in enumerate(names)}).drop(*(f"__g{i}" for i in range(len(values))))
    return df.drop("__bx", "__by")
