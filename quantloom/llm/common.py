"""Helpers shared by the corpus operators."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shipping import ship_package

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: What separates words: space and \t \n \v \f \r.
BLANK_CLASS = r"\x20\x09-\x0D"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables."""
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: the session's ``spark.checkpoint.dir``.

    Where none is set, a local master (tests) gets a temporary folder; a cluster must name one.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if named is None:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="spark-checkpoint-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(named)
    return named.rstrip("/")


def cut_lineage(df: DataFrame) -> DataFrame:
    """Checkpoint in the folder that the cluster names, so that lost executors cost no recomputation."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


#: Bytes of a table, as Spark holds its rows, that may be broadcast; with more, a join shuffles.
BROADCAST_BYTES = 32 << 20
#: Bytes that a row takes beside its strings and arrays: the row's own header, eight a column, and its place in the hash table.
_ROW_BYTES = 48


def held_bytes(df: DataFrame) -> int:
    """About how many bytes the rows of a (checkpointed) table take in memory."""
    words = lambda n: F.octet_length(F.array_join(f"`{n}`", "")) + 24 * F.size(f"`{n}`")
    wide = [F.octet_length(f"`{n}`") if t == "string" else words(n) if t == "array<string>" else 16 + 8 * F.size(f"`{n}`") for n, t in df.dtypes if t == "string" or t.startswith("array")]
    more = [F.coalesce(w.cast("long"), F.lit(0)) for w in wide]
    return df.agg(F.coalesce(F.sum(sum(more, F.lit(_ROW_BYTES + 8 * len(df.columns)).cast("long"))), F.lit(0))).first()[0]


def bounded_broadcast(df: DataFrame, most: int = BROADCAST_BYTES) -> DataFrame:
    """The table, checkpointed; to be broadcast if it takes no more than ``most`` bytes."""
    df = cut_lineage(df)
    return F.broadcast(df) if held_bytes(df) <= most else df


def free_prefix(df: DataFrame) -> str:
    """Underscores, as many as it takes for no column of the table to begin with them: a prefix for helper columns."""
    prefix = "__"
    while any(c.startswith(prefix) for c in df.columns):
        prefix += "_"
    return prefix


def column(name: str) -> Column:
    """The column of exactly this name."""
    return F.col("`" + name.replace("`", "``") + "`")


def columns(df: DataFrame) -> list[Column]:
    return [column(c) for c in df.columns]


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once per row, however often the body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only; pure ASCII texts take the fast built-in."""
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))


def blank_words(text: Column) -> Column:
    """The words ``[^\\x20\\x09-\\x0D]+`` of a text as an array; null gives an empty one."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), f"[{BLANK_CLASS}]+"), "")


def n_blank_words(text: Column) -> Column:
    """How many words ``[^\\x20\\x09-\\x0D]+`` a text has; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(f"[^{BLANK_CLASS}]+")), F.lit(0)).cast("long")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
