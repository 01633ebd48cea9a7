"""One pass over each key's rows in order, with a state that is carried from one Arrow batch to the next.

Spark shuffles the rows by key and sorts them, and its sort spills; a task then holds one batch and one state,
whatever the length of a key.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from itertools import pairwise
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..shipping import ship_package


def key_starts(columns: Sequence[pa.Array]) -> list[int]:
    """The rows at which a key begins, the first one included; nulls are equal."""
    n = len(columns[0])
    new = np.zeros(n - 1, bool)
    for c in columns:
        a, b = c.slice(1), c.slice(0, n - 1)
        differs = pc.fill_null(pc.not_equal(a, b), pa.scalar(False))
        new |= pc.or_(differs, pc.xor(a.is_null(), b.is_null())).to_numpy(zero_copy_only=False)
    return [0, *(np.flatnonzero(new) + 1).tolist()]


def carry_scan(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], columns: dict[str, Column], shape: str, start: Callable[[], Any], step: Callable[..., list[np.ndarray]]
) -> DataFrame:
    """Rows (keys, shape): what ``step(state, *arrays)`` returns for each stretch of a key's rows, as columns of one length.

    ``columns`` are what ``step`` reads, as numbers (timestamps as microseconds); ``start`` makes a key's state, which
    ``step`` changes in place.
    """
    ship_package(df.sparkSession)
    keys, order = list(keys), list(order)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in (df.schema[k] for k in keys))
    schema = to_arrow_schema(StructType.fromDDL(f"{fields}, {shape}"))
    read = df.select(*keys, *[df[o].alias(f"__o{i}") for i, o in enumerate(order)], *[c.alias(f"__c{i}") for i, c in enumerate(columns.values())])
    n_keys, n_order = len(keys), len(order)

    def numbers(column: pa.Array) -> np.ndarray:
        return (column.cast(pa.int64()) if pa.types.is_timestamp(column.type) else column).to_numpy(zero_copy_only=False)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            key_columns, values = batch.columns[:n_keys], [numbers(c) for c in batch.columns[n_keys + n_order :]]
            rows, made = [], []
            for a, b in pairwise([*key_starts(key_columns), batch.num_rows]):
                now = tuple(c[a].as_py() for c in key_columns)
                if key is None or now != key:
                    key, state = now, start()
                out = step(state, *(v[a:b] for v in values))
                if len(out[0]):
                    rows.append(np.full(len(out[0]), a))
                    made.append(out)
            if rows:
                at = pa.array(np.concatenate(rows))
                whole = [pa.array(np.concatenate(c)) for c in zip(*made, strict=True)]
                arrays = [*(c.take(at) for c in key_columns), *whole]
                yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(arrays, schema, strict=True)], schema=schema)

    laid = read.repartition(*keys).sortWithinPartitions(*keys, *[f"__o{i}" for i in range(n_order)])
    return laid.mapInArrow(run, f"{fields}, {shape}")
