"""The corpus pipeline: five stages, each a function of (spark, docs, sf_dir), applied to ``documents`` in order.

Each stage's result is written as Parquet and read again as the next one's input, so a lost executor costs one stage
at most. All stages but the last return the columns of ``documents``; the last adds the mix's columns.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quantloom.llm.common import columns, free_prefix, shared_folder, table
from quantloom.llm.decontaminate import keep_uncontaminated
from quantloom.llm.lines import keep_first_lines
from quantloom.llm.mixing import mix_sources
from quantloom.llm.quality import keep_quality
from quantloom.llm.simhash import keep_one
from quantloom.shipping import ship_package


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep. Null and empty texts have no words and go; equal rows stay or go together."""
    return keep_quality(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that match an earlier one; those left without words go.

    Lines come in order of doc_id, null first, and of their number; of equal rows neither is earlier. A null text stays.
    """
    ship_package(spark)
    return keep_first_lines(docs)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group: that of the smallest id. Texts without words are one group; of equal rows one stays."""
    ship_package(spark)
    return keep_one(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of a benchmark item occurs. A null text holds none and stays; so do equal rows, all of them."""
    return keep_uncontaminated(docs, table(spark, sf_dir, "benchmark"))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with what the mix takes of each: size, source_size, target and taken are added.

    Where ``docs`` has a column of such a name, it keeps it, and the mix's column gets an underscore in front, or as many
    as it takes. Null texts have no words; a null source is a source; equal rows are taken or left together.
    """
    mix, taken = f"{free_prefix(docs)}mix", {c.lower() for c in docs.columns}
    added = []
    for name in ("size", "source_size", "target", "taken"):
        shown = name
        while shown in taken:
            shown = f"_{shown}"
        added.append(F.col(f"`{mix}`.{name}").alias(shown))
        taken.add(shown)
    return mix_sources(docs, mix=mix).select(*columns(docs), *added)


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("simhash_near_dedup", simhash_near_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("source_mix", source_mix),
]

#: Similarity joins and components are iterative, so SQL doesn't express the whole; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what lies between them is kept beside the checkpoints, which executors share."""
    docs, place = table(spark, sf_dir, "documents"), f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{place}/{k}-{name}")
        docs = spark.read.parquet(f"{place}/{k}-{name}")
    return docs
