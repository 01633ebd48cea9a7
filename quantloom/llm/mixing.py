"""Mixing sources to target weights by weighted fair queueing.

Each source is a queue of documents in a seeded random order, repeated for as many epochs as are allowed. A copy of a
document gets a virtual finish time: the words that its source has served up to and including it, over the source's
target. Served in order of finish time, all sources advance in proportion to their targets, and the mix is the
longest prefix within the total budget.

Cumulative sums come in two levels: the order of a source is cut into buckets by the hash that shuffles it, so a hot
source is as many groups as it has buckets; sums of buckets give each bucket's start. The place where the budget runs
out is found likewise, first among bins of finish times, then inside one bin. As finish times rise along a source's
queue, the mix is a prefix of each queue and epoch, so per source two or three bounds say what is taken, and texts
need never be shuffled.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_broadcast, column, columns, cut_lineage, free_prefix, n_blank_words

#: Bins of finish times, which are summed by one task and broadcast.
TIME_BINS = 4096
#: Copies of the bin in which the budget ends that one task puts in order; with more, the bin is binned again.
SPLIT_ROWS = 100_000


def source_targets(sized: DataFrame, weights: Sequence[int], budget_share: float, max_epochs: int) -> DataFrame:
    """Per source: source_size, weight and target.

    Sources by code point, null last, weigh ``weights`` in turn. The budget is ``budget_share`` of all words; a target
    stops at ``max_epochs`` times the size of its source and the excess is shared by weight among the rest. With the
    sources in order of cap over weight those at their cap come first, so running sums find them.
    """
    whole = Window.partitionBy(F.lit(0))
    rank = Window.partitionBy(F.lit(0)).orderBy(F.col("source").asc_nulls_last())
    s = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    s = s.withColumn("place", F.row_number().over(rank)).withColumn("weight", F.element_at(F.array(*[F.lit(int(w)) for w in weights]), (F.col("place") - 1) % len(weights) + 1).cast("long"))
    s = s.withColumn("cap", (max_epochs * F.col("source_size")).cast("long")).withColumn("budget", F.lit(float(budget_share)) * F.sum("source_size").over(whole))
    filled = Window.partitionBy(F.lit(0)).orderBy(F.col("cap") / F.col("weight"), "place").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    s = s.withColumn("left", F.col("budget") - (F.sum("cap").over(filled) - F.col("cap"))).withColumn("share", F.sum("weight").over(whole) - (F.sum("weight").over(filled) - F.col("weight")))
    s = s.withColumn("full", F.col("cap") * F.col("share") <= F.col("left") * F.col("weight"))
    free = F.col("budget") - F.coalesce(F.sum(F.when(F.col("full"), F.col("cap"))).over(whole), F.lit(0))
    among = F.sum(F.when(~F.col("full"), F.col("weight"))).over(whole)
    return s.select("source", "source_size", "weight", "budget", F.when(F.col("full"), F.col("cap").cast("double")).otherwise(free * F.col("weight") / among).alias("target"))


def with_queue_order(docs: DataFrame, seed: int) -> DataFrame:
    """doc_id, source and size with the seeded key that shuffles each source."""
    return docs.select("doc_id", "source", n_blank_words(F.col("text")).alias("size"), F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))).alias("key"))


def mix_bounds(docs: DataFrame, *, weights: Sequence[int] = (5, 2, 1), budget_share: float = 1.5, max_epochs: int = 2, seed: int = 0) -> DataFrame:
    """Per source: source_size, target and ``last``, an array with the last queue place taken in each epoch (null: none)."""
    sized = cut_lineage(with_queue_order(docs, seed))
    targets = cut_lineage(source_targets(sized, weights, budget_share, max_epochs))
    n_buckets = max(1, int(sized.count() ** 0.5))
    bucket = (F.conv(F.substring("key", 1, 6), 16, 10).cast("long") * n_buckets / F.lit(1 << 24)).cast("int")
    placed = sized.withColumn("bucket", bucket)
    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    starts = placed.groupBy("source", "bucket").agg(F.sum("size").alias("inside")).withColumn("start", F.sum("inside").over(before) - F.col("inside"))
    starts = starts.alias("starts").join(targets.where("target > 0").alias("targets"), F.expr("starts.source <=> targets.source")).select("starts.source", "bucket", "start", "source_size", "target", "budget")
    inside = Window.partitionBy("source", "bucket").orderBy("key", "doc_id", "size")  # equal rows share a place
    queued = placed.withColumn("upto", F.sum("size").over(inside)).alias("q").join(starts.alias("s"), F.expr("q.source <=> s.source and q.bucket = s.bucket"))
    place = F.struct("key", "doc_id", "size")
    times = F.array(*[((F.lit(e) * F.col("source_size") + F.col("start") + F.col("upto")) / F.col("target")) for e in range(max_epochs)])
    copies = queued.select("q.source", "q.size", "budget", place.alias("place"), F.posexplode(times).alias("epoch", "time"))
    copies = cut_lineage(copies.withColumn("bin", F.least(F.floor(F.col("time") * (TIME_BINS // 2)), F.lit(TIME_BINS - 1)).cast("int")))
    running = Window.partitionBy(F.lit(0)).orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    bins = copies.groupBy("bin").agg(F.sum("size").alias("inside"), F.max("budget").alias("budget")).withColumn("upto", F.sum("inside").over(running))
    bins = bins.select("bin", (F.col("upto") - F.col("inside")).alias("start"), (F.col("upto") <= F.col("budget")).alias("whole"), ((F.col("upto") > F.col("budget")) & (F.col("upto") - F.col("inside") < F.col("budget"))).alias("split"))
    binned = copies.join(F.broadcast(bins), "bin")  # TIME_BINS rows at most
    taken = binned.where("whole").select("source", "epoch", "place")
    left = cut_lineage(binned.where("split").drop("bin", "whole", "split"))
    while left.count() > SPLIT_ROWS:  # the bin in which the budget ends is binned again
        low, high = left.agg(F.min("time"), F.max("time")).first()
        if low == high:
            break
        finer = left.withColumn("bin", F.floor((F.col("time") - low) / (high - low) * (TIME_BINS - 1)).cast("int"))
        parts = finer.groupBy("bin").agg(F.sum("size").alias("inside"), F.max("budget").alias("limit"), F.max("start").alias("from")).withColumn("upto", F.col("from") + F.sum("inside").over(running))
        parts = parts.select("bin", (F.col("upto") - F.col("inside")).alias("start"), (F.col("upto") <= F.col("limit")).alias("whole"), ((F.col("upto") > F.col("limit")) & (F.col("upto") - F.col("inside") < F.col("limit"))).alias("split"))
        finer = finer.drop("start").join(F.broadcast(parts), "bin")  # TIME_BINS rows at most
        taken = taken.unionByName(finer.where("whole").select("source", "epoch", "place"))
        left = cut_lineage(finer.where("split").drop("bin", "whole", "split"))
    served = Window.partitionBy(F.lit(0)).orderBy("time", "place", "epoch")
    split = left.withColumn("upto", F.col("start") + F.sum("size").over(served)).where("upto <= budget")
    taken = taken.unionByName(split.select("source", "epoch", "place"))
    lasts = taken.groupBy("source").agg(*[F.max(F.when(F.col("epoch") == e, F.col("place"))).alias(f"e{e}") for e in range(max_epochs)])
    joined = targets.alias("t").join(lasts.alias("l"), F.expr("t.source <=> l.source"), "left")
    return joined.select("t.source", "source_size", "target", F.array(*[f"e{e}" for e in range(max_epochs)]).alias("last"))


def mix_sources(docs: DataFrame, *, weights: Sequence[int] = (5, 2, 1), budget_share: float = 1.5, max_epochs: int = 2, seed: int = 0, mix: str = "__mix") -> DataFrame:
    """All rows and columns of ``docs`` with size, source_size, target and taken (struct ``mix``, named ``__mix`` by default).

    ``taken`` counts the words that the mix takes of a document, repeats counted: up to ``max_epochs`` times its size.
    Words are ``[^\\x20\\x09-\\x0D]+``; null texts have none. Rows that agree in doc_id, source and size share a place in
    the queue and are taken or left together; a null doc_id is a value like any other. An empty table gives an empty
    result; if no source has words, targets and taken are 0. Columns of ``docs`` keep their names, whatever they are.
    """
    bounds = mix_bounds(docs, weights=weights, budget_share=budget_share, max_epochs=max_epochs, seed=seed)
    prefix = free_prefix(docs)
    of = lambda name: column(f"{prefix}{name}")
    bounds = bounds.select(*[F.col(c).alias(f"{prefix}{c}") for c in ("source", "source_size", "target", "last")])
    bounds = bounded_broadcast(bounds)
    keyed = docs.withColumns({f"{prefix}size": n_blank_words(F.col("text")), f"{prefix}key": F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))})
    placed = keyed.join(bounds, F.col("source").eqNullSafe(of("source")), "left")
    here = F.struct(of("key").alias("key"), F.col("doc_id"), of("size").alias("size"))
    taken = sum((F.when(here <= of("last")[e], of("size")).otherwise(F.lit(0)) for e in range(max_epochs)), F.lit(0))
    mix_of = F.struct(of("size").alias("size"), of("source_size").alias("source_size"), of("target").alias("target"), taken.cast("long").alias("taken"))
    return placed.select(*columns(docs), mix_of.alias(mix))
