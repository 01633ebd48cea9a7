"""SimHash near-duplicates by multi-index hashing.

A fingerprint is two halves of 32 bits. If two fingerprints differ in at most 3 bits, one half differs in at most one,
so every fingerprint looks up, for each half, the 33 values within one bit of it in a table of the halves, and the hits
are kept if the whole distance is small enough. Equal fingerprints are one entry throughout, so groups of copies cost
one look-up. Linked fingerprints form components by alternating star contractions.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_broadcast, column, cut_lineage, free_prefix

SEED = 42


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """64 bits; a bit is 1 if it is set in over half of the XXH64 hashes of the word shingles, repeats included."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # of bytes: A-Z and ASCII blanks alone
    if not words:
        return 0
    digest = xxhash.xxh64_digest
    runs = zip(*[words[i:] for i in range(shingle)], strict=False) if len(words) >= shingle else [words]
    hashes = b"".join([digest(b" ".join(r), SEED) for r in runs])
    rows = np.frombuffer(hashes, np.uint8).reshape(-1, 8)
    ones = np.zeros(64, np.int64)
    for start in range(0, len(rows), 1 << 16):  # bounded memory for very long texts
        ones += np.unpackbits(rows[start : start + (1 << 16)], axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(rows)).tobytes(), "big", signed=True)


def with_fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """doc_id, text_hash and the fingerprint (as a signed long) of every row."""

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            marks = pa.array([fingerprint(t.as_py(), shingle) for t in batch.column(2)], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), marks], ["doc_id", "text_hash", "mark"])

    id_type = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text").mapInArrow(mark, f"doc_id {id_type}, text_hash long, mark long")


def near_pairs(marks: DataFrame, most: int = 3) -> DataFrame:
    """Pairs (a, b), a < b, of distinct fingerprints (column mark) that differ in ``most`` bits, 3 at most."""
    if not 0 <= most <= 3:
        raise ValueError("halves within one bit find distances up to 3")
    low = lambda x: x.bitwiseAND(F.lit(0xFFFFFFFF))
    halves = F.array(low(F.shiftrightunsigned("mark", 32)), low(F.col("mark")) + F.lit(1 << 32))  # bit 32 tells the halves apart
    table = marks.select(F.col("mark").alias("a"), F.explode(halves).alias("half"))
    ball = F.array(F.lit(0).cast("long"), *[F.lit(1 << i).cast("long") for i in range(32)])
    probes = marks.select(F.col("mark").alias("b"), F.explode(halves).alias("own")).select("b", F.explode(F.transform(ball, lambda x: x.bitwiseXOR(F.col("own")))).alias("half"))
    return table.join(probes, "half").where((F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= most)).select("a", "b").distinct()


def components(pairs: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of the pairs (a, b); root is the least node of its component.

    Each round is a large-star and a small-star step (Kiveris et al., 2014); both only move links to smaller nodes, and
    the forest is done when it stops changing.
    """
    edges, before = cut_lineage(pairs.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct()), None
    for _ in range(max_rounds):
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(least, "u")
        small = moved.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        edges = cut_lineage(small)
    else:
        raise RuntimeError("components didn't settle")
    return edges.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def near_duplicates(docs: DataFrame, *, shingle: int = 3, most: int = 3) -> DataFrame:
    """Per row: doc_id, text_hash, mark and component_id, the smallest doc_id that links of fingerprints reach.

    Texts are split into words at ASCII blanks with A-Z lower-cased; fewer words than a shingle are one shingle, and
    null or blank texts have the fingerprint 0, linked like any other. Repeated rows stay repeated. A null doc_id is
    never the smallest unless the component has no other.
    """
    rows = cut_lineage(with_fingerprints(docs, shingle))
    nodes = cut_lineage(rows.groupBy("mark").agg(F.min("doc_id").alias("least")))
    roots = components(near_pairs(nodes, most))
    rooted = nodes.join(roots.withColumnRenamed("node", "mark"), "mark", "left").select("mark", "least", F.coalesce("root", "mark").alias("root"))
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    by_mark = rooted.join(named, "root").select("mark", "component_id")
    return rows.join(by_mark, "mark").select("doc_id", "text_hash", "mark", "component_id")


def hex_mark(mark: Column) -> Column:
    """16 lower-case hex digits."""
    return F.lower(F.lpad(F.hex(mark), 16, "0"))


def keep_one(docs: DataFrame, *, shingle: int = 3, most: int = 3) -> DataFrame:
    """The rows of ``docs``, all columns unchanged, with one row of each component: that of the smallest doc_id.

    Among rows of that doc_id the least text hash stays, and one of equal rows.
    """
    found = near_duplicates(docs, shingle=shingle, most=most)
    counted = found.groupBy("component_id", "doc_id", "text_hash").agg(F.count(F.lit(1)).alias("n"))
    row = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash")
    kept = counted.groupBy("component_id").agg(F.min(row).alias("row"))
    marked = cut_lineage(counted.alias("c").join(kept.alias("k"), F.expr("c.component_id <=> k.component_id")).select("doc_id", "text_hash", "n", (row == F.col("k.row")).alias("stays")))
    doc, text = f"{free_prefix(docs)}doc_id", f"{free_prefix(docs)}text_hash"
    gone = bounded_broadcast(marked.where("not stays").select(F.col("doc_id").alias(doc), F.col("text_hash").alias(text)).distinct())
    same = F.col("doc_id").eqNullSafe(column(doc)) & F.xxhash64("text").eqNullSafe(column(text))
    left = docs.join(gone, same, "left_anti")
    repeats = marked.where("stays and n > 1").limit(1).count()
    return left.dropDuplicates(["doc_id", "text"]) if repeats else left
