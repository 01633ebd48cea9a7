"""Benchmark decontamination by a prefix-filtered join of word shingles with exact verification.

A window of an item can only occur in a document that holds every shingle of the window, so it is enough to join on
one: the rarest, by its count in the corpus. For containment of the whole window that is the necessary prefix of its
shingles in order of rarity, and a window with a shingle that the corpus lacks is out at once. A hit names the only
place where the window could start; it must leave room for the whole window, and the words there must be the window's.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_BYTES, ascii_lower, bounded_broadcast, column, cut_lineage, free_prefix, held_bytes


def alnum_words(text: Column) -> Column:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of a text with A-Z lower-cased; null has none."""
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), "")


def shingle_hashes(words: Column, size: int) -> Column:
    """A hash of each run of ``size`` words, in order."""
    n = F.greatest(F.size(words) - (size - 1), F.lit(0))
    runs = F.arrays_zip(*[F.slice(words, k + 1, n).alias(f"w{k}") for k in range(size)])
    return F.transform(runs, lambda r: F.xxhash64(*[r[f"w{k}"] for k in range(size)]))


def item_windows(items: DataFrame, window: int) -> DataFrame:
    """(item_id, window): every run of ``window`` words of an item, or all words of a shorter one."""
    worded = items.select("item_id", alnum_words(F.col("text")).alias("words")).where(F.size("words") > 0)
    runs = F.transform(F.sequence(F.lit(1), F.greatest(F.size("words") - (window - 1), F.lit(1))), lambda i: F.slice("words", i, window))
    return worded.select("item_id", F.explode(runs).alias("window")).distinct()


def _bounded(df: DataFrame, limit: int) -> tuple[DataFrame, bool]:
    """A table, broadcast if it takes no more bytes than the limit, and whether it does."""
    small = held_bytes(df) <= limit
    return (F.broadcast(df) if small else df), small


def find_windows(docs: DataFrame, windows: DataFrame, *, shingle: int = 5, limit: int = BROADCAST_BYTES) -> DataFrame:
    """(doc_id, text_hash, start, window) of each occurrence; ``windows`` has distinct arrays of words."""
    windows = windows.select("window", F.least(F.size("window"), F.lit(shingle)).alias("size"))
    sizes = sorted(r["size"] for r in windows.select("size").distinct().collect())  # ``shingle`` rows at most
    hashed = F.coalesce(*[F.when(F.col("size") == k, shingle_hashes(F.col("window"), k)) for k in sizes]) if sizes else F.expr("cast(array() as array<long>)")
    tokens = cut_lineage(windows.select("window", F.posexplode_outer(hashed).alias("offset", "token")))
    worded = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), alnum_words(F.col("text")).alias("words"))
    # the outer form of explode: for the other, a filter on the size would have the hashes computed twice
    spread = lambda df, *keep: [df.select(*keep, F.posexplode_outer(shingle_hashes(F.col("words"), k)).alias("place", "token")) for k in sizes]

    def union(frames: list[DataFrame]) -> DataFrame:
        out = frames[0]
        for frame in frames[1:]:
            out = out.unionByName(frame)
        return out

    if not sizes:
        return worded.where("false").select("doc_id", "text_hash", F.lit(0).alias("start"), F.col("words").alias("window"))
    vocabulary, _ = _bounded(tokens.select("token").distinct(), limit)
    counts = union(spread(worded)).select("token").join(vocabulary, "token").groupBy("token").agg(F.count("*").alias("n"))
    ranked = tokens.join(counts, "token", "left").groupBy("window").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "token", "offset")).alias("rarest"))
    prefix, small = _bounded(cut_lineage(ranked.where("rarest.n > 0").select("window", "rarest.token", "rarest.offset")), limit)
    start = F.col("place") - F.col("offset")
    if small:
        hits = union(spread(worded, "doc_id", "text_hash", "words")).join(prefix, "token")
        fits = (start >= 0) & (start + F.size("window") <= F.size("words")) & (F.slice("words", F.greatest(start, F.lit(0)) + 1, F.size("window")) == F.col("window"))
        return hits.where(fits).select("doc_id", "text_hash", start.alias("start"), "window")
    hits = union(spread(worded, "doc_id", "text_hash")).join(prefix, "token").where(start >= 0).select("doc_id", "text_hash", start.alias("start"), "window").distinct()
    per_doc = hits.groupBy("doc_id", "text_hash").agg(F.collect_list(F.struct("start", "window")).alias("hits")).alias("h")
    met = worded.alias("d").join(per_doc, F.expr("d.doc_id <=> h.doc_id and d.text_hash = h.text_hash"))
    true = F.filter("hits", lambda x: F.slice(F.col("words"), x["start"] + 1, F.size(x["window"])) == x["window"])
    return met.select("d.doc_id", "d.text_hash", F.explode_outer(true).alias("hit")).where("hit is not null").select("doc_id", "text_hash", "hit.start", "hit.window")


def covered_words(spans: Column) -> Column:
    """Words in the union of spans (start, end), given in order of start."""
    zero = F.struct(F.lit(0).cast("long").alias("total"), F.lit(0).alias("upto"))
    step = lambda a, s: F.struct((a["total"] + F.greatest(F.lit(0), s["end"] - F.greatest(a["upto"], s["start"]))).alias("total"), F.greatest(a["upto"], s["end"]).alias("upto"))
    return F.aggregate(spans, zero, step, lambda a: a["total"])


def contamination(docs: DataFrame, items: DataFrame, *, window: int = 10, shingle: int = 5) -> DataFrame:
    """Per document with a hit: doc_id, text_hash, n_hit and the ids of the items found (array items, as sorted strings).

    n_hit counts the words inside any occurrence of a window. Equal rows of ``docs`` give one row. Null texts have no
    words; items without words have no windows, and an item without an id is found but not listed.
    """
    listed = cut_lineage(item_windows(items, window))
    found = cut_lineage(find_windows(docs, listed.select("window").distinct(), shingle=shingle).distinct())
    spans = F.sort_array(F.collect_set(F.struct("start", (F.col("start") + F.size("window")).alias("end"))))
    hit = found.groupBy("doc_id", "text_hash").agg(covered_words(spans).alias("n_hit"))
    named = found.select("doc_id", "text_hash", "window").distinct().join(listed, "window").groupBy("doc_id", "text_hash").agg(F.sort_array(F.collect_set(F.col("item_id").cast("string"))).alias("items"))
    both = hit.alias("h").join(named.alias("n"), F.expr("h.doc_id <=> n.doc_id and h.text_hash = n.text_hash"))
    return both.select("h.doc_id", "h.text_hash", "n_hit", "items")


def report_contamination(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """Per row of ``docs``: doc_id, n_words, n_hit, n_items, items_sha256 and contaminated."""
    hits = cut_lineage(contamination(docs, items, **options)).alias("h")
    sized = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), F.size(alnum_words(F.col("text"))).cast("long").alias("n_words")).alias("d")
    joined = sized.join(hits, F.expr("d.doc_id <=> h.doc_id and d.text_hash = h.text_hash"), "left")
    names = F.coalesce("items", F.expr("cast(array() as array<string>)"))
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    return joined.select("d.doc_id", "n_words", n_hit.alias("n_hit"), F.size(names).cast("long").alias("n_items"), F.sha2(F.array_join(names, ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


def keep_uncontaminated(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """The rows of ``docs``, all columns unchanged, in which no window of an item occurs."""
    doc, text = f"{free_prefix(docs)}doc_id", f"{free_prefix(docs)}text_hash"
    hits = bounded_broadcast(contamination(docs, items, **options).select(F.col("doc_id").alias(doc), F.col("text_hash").alias(text)))
    same = F.col("doc_id").eqNullSafe(column(doc)) & (F.xxhash64("text") == column(text))
    return docs.join(hits, same, "left_anti")
