"""Language identification by bit-sliced Bloom filters of character trigrams.

Each language has a Bloom filter of its trigrams; the filters are stored by position, as a mask of the languages whose
bit is set there, so one lookup per hash function answers for all languages: the masks at a trigram's positions, and-ed,
are the languages that may contain it. Per language, the share of a text's trigrams that hit, less what the filter's
false positives would give, is the evidence; the largest decides.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Positions of a filter (2 to this power) and hash functions; also the bound on what the driver gathers.
FILTER_BITS, N_HASHES = 20, 3
#: Languages that one mask holds, and languages that are told apart at most, the most frequent ones.
MASK_LANGUAGES, MAX_LANGUAGES = 64, 1024
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)
#: Characters that are looked up at once.
_CHUNK = 2_000_000


@lru_cache(maxsize=1)
def letters() -> np.ndarray:
    """Whether a code point is a letter."""
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def trigrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys of all trigrams with a letter in the middle, other characters as blanks; each text's first key; its letters."""
    lower = [t.lower() for t in texts]
    codes = np.frombuffer((" " + " ".join(lower) + " ").encode("utf-32-le", "surrogatepass"), np.uint32)
    is_letter = letters()[codes]
    codes = np.where(is_letter, codes, 32).astype(np.uint64)
    ends = np.cumsum([len(t) + 1 for t in lower])
    middle = is_letter[1:-1]
    keys = (codes[:-2] | codes[1:-1] << np.uint64(21) | codes[2:] << np.uint64(42))[middle]
    upto = np.concatenate([[0], np.cumsum(middle)])
    n = upto[np.minimum(ends - 1, len(middle))]
    starts = np.concatenate([[0], n])
    return keys, starts, np.diff(starts)


def positions(keys: np.ndarray, which: int) -> np.ndarray:
    mixed = (keys ^ keys >> np.uint64(29)) * _ODD[which]
    return ((mixed ^ mixed >> np.uint64(32)) * _ODD[(which + 1) % N_HASHES] >> np.uint64(64 - FILTER_BITS)).astype(np.int64)


class LanguageFilters:
    """The bit-sliced filters of the languages, sorted by name: a row of masks for every 64 of them."""

    def __init__(self, languages: list[str], masks: np.ndarray):
        kind = np.uint8 if len(languages) <= 8 else np.uint16 if len(languages) <= 16 else np.uint64
        self.languages, self.masks = languages, masks.astype(kind)
        self.bits = [(i // MASK_LANGUAGES, kind(1 << i % MASK_LANGUAGES)) for i in range(len(languages))]
        self.false_rate = np.array([np.count_nonzero(self.masks[row] & b) / masks.shape[1] for row, b in self.bits]) ** N_HASHES

    def predict(self, texts: list[str]) -> tuple[list[str], list[float]]:
        """Language and score of each text; ``und`` and 0 without letters or languages."""
        keys, starts, n = trigrams(texts)
        masks = self.masks[:, positions(keys, 0)]
        for i in range(1, N_HASHES):
            masks = masks & self.masks[:, positions(keys, i)]
        share = np.zeros((len(texts), len(self.languages)))
        for i, (row, bit) in enumerate(self.bits):
            upto = np.concatenate([[0], np.cumsum((masks[row] & bit) != 0)])
            hits = (upto[starts[1:]] - upto[starts[:-1]]) / np.maximum(n, 1)
            share[:, i] = np.maximum(0, (hits - self.false_rate[i]) / max(1e-9, 1 - self.false_rate[i]))
        if not self.languages:
            return ["und"] * len(texts), [0.0] * len(texts)
        best, total = share.argmax(1), share.sum(1)
        score = np.where(total > 0, share.max(1) / np.maximum(total, 1e-12), 0.0)
        return [self.languages[b] if k else "und" for b, k in zip(best, n, strict=True)], [float(s) if k else 0.0 for s, k in zip(score, n, strict=True)]


def chunks(texts: list[str]) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about _CHUNK characters; a longer text is one range."""
    start, held = 0, 0
    for i, t in enumerate(texts):
        if held and held + len(t) > _CHUNK:
            yield start, i
            start, held = i, 0
        held += len(t)
    if texts:
        yield start, len(texts)


def learn_filters(docs: DataFrame, *, max_docs: int = 10_000, min_count: int = 3, min_ratio: float = 0.1) -> LanguageFilters:
    """Filters from the rows of ``docs`` (doc_id, lang, text) with a language and a text.

    The MAX_LANGUAGES most frequent languages are learned. Of each about ``max_docs`` documents, those with the least hashes of doc_id, are learned from: a documented
    bound on the sample. A trigram belongs to a language if it occurs at least ``min_count`` times and its share of the
    language's trigrams is at least ``min_ratio`` of its largest share in any language.
    """
    labelled = docs.where("lang is not null and text is not null")
    sizes = {r["lang"]: r["count"] for r in labelled.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(MAX_LANGUAGES).collect()}
    languages = sorted(sizes)
    if not languages:
        return LanguageFilters([], np.zeros((1, 1 << FILTER_BITS), np.uint64))
    by_language = lambda held: F.try_element_at(F.create_map(*[F.lit(x) for pair in held.items() for x in pair]), F.col("lang"))
    share = by_language({lang: min(1.0, max_docs / n) for lang, n in sizes.items()})
    sample = labelled.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < share * (1 << 20)).select("lang", "text")

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for lang, group in frame.groupby("lang"):
                texts = group["text"].tolist()
                for a, b in chunks(texts):
                    keys, n = np.unique(trigrams(texts[a:b])[0], return_counts=True)
                    yield pd.DataFrame({"lang": lang, "gram": keys.astype(np.int64), "n": n.astype(np.int64)})

    counts = sample.mapInPandas(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    totals = {r["lang"]: r["n"] for r in counts.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    if not totals:
        return LanguageFilters([], np.zeros((1, 1 << FILTER_BITS), np.uint64))
    total, bit = by_language({lang: float(n) for lang, n in totals.items()}), by_language({lang: i for i, lang in enumerate(languages)})
    grams = counts.withColumn("share", F.col("n") / total).groupBy("gram").agg(F.max("share").alias("most"), F.collect_list(F.struct(bit.alias("bit"), "n", "share")).alias("langs"))
    kept = F.filter("langs", lambda x: (x["n"] >= min_count) & (x["share"] >= min_ratio * F.col("most")))
    rows = F.array_distinct(F.transform(kept, lambda x: F.floor(x["bit"] / MASK_LANGUAGES).cast("int")))
    of_row = lambda row: F.filter(kept, lambda x: F.floor(x["bit"] / MASK_LANGUAGES) == row)
    mask = lambda row: F.aggregate(of_row(row), F.lit(0).cast("long"), lambda a, x: a.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), x["bit"] % MASK_LANGUAGES)))
    masked = grams.select("gram", F.explode(F.transform(rows, lambda row: F.struct(row.alias("row"), mask(row).alias("mask")))).alias("x")).select("gram", "x.*")

    def place(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            keys = frame["gram"].to_numpy().astype(np.uint64)
            for i in range(N_HASHES):
                yield pd.DataFrame({"position": positions(keys, i), "row": frame["row"], "mask": frame["mask"]})

    # 2 ** FILTER_BITS rows at most for every 64 languages
    made = masked.mapInPandas(place, "position long, row int, mask long").groupBy("position", "row").agg(F.bit_or("mask").alias("mask")).toPandas()
    masks = np.zeros((-(-len(languages) // MASK_LANGUAGES), 1 << FILTER_BITS), np.uint64)
    masks[made["row"].to_numpy(np.int64), made["position"].to_numpy(np.int64)] = made["mask"].to_numpy(np.int64).astype(np.uint64)
    return LanguageFilters(languages, masks)


def predict_languages(docs: DataFrame, filters: LanguageFilters) -> DataFrame:
    """Per document: doc_id, lang_pred and score, from the whole text alone; ``und`` if it is null or has no letter."""
    held = docs.sparkSession.sparkContext.broadcast(filters)

    def predict(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            texts = [t if isinstance(t, str) else "" for t in frame["text"]]
            for a, b in chunks(texts):
                lang, score = held.value.predict(texts[a:b])
                yield pd.DataFrame({"doc_id": frame["doc_id"].iloc[a:b].to_numpy(), "lang_pred": lang, "score": score})

    # doc_id as text, so that nulls among integers come through pandas unchanged
    id_type = docs.schema["doc_id"].dataType
    made = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text").mapInPandas(predict, "doc_id string, lang_pred string, score double")
    return made.withColumn("doc_id", F.col("doc_id").cast(id_type))


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept from learning: crc32 of doc_id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def identify_languages(docs: DataFrame, **learn) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every row, learned from the documents that are not held out.

    A null doc_id is not held out. Repeated rows stay repeated; without any labelled text all predictions are ``und``;
    ties go to the first language by name.
    """
    filters = learn_filters(docs.where(~held_out(F.col("doc_id"))), **learn)
    return predict_languages(docs, filters).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
