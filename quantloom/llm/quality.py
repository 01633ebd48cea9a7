"""Quality rules: counts of a text, and how far its histograms lie from those of its language.

Two histograms per document, of character classes and of common words, are compared with references by the
Jensen-Shannon distance (square root of the divergence, base 2, so 0 to 1). A reference is the sum of the histograms
of all documents of a language that pass the base rules, whichever languages there are, and its common words are the
most frequent of the language's documents. A document is judged by the reference of its own language; one without such a reference is not judged by
words, and by the nearest reference for characters. Texts too short to have a stable histogram are not judged by it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BLANK_CLASS, blank_words, column, columns, cut_lineage, free_prefix, let

#: Common words of a language, and how many candidates are counted exactly to find them.
N_COMMON, N_CANDIDATES = 15, 40
#: Words that a task follows for each language to find the candidates: what it misses is rarer than 1 in some 4,000.
N_TRACKED = 16_384
#: Symbols that the base rules count.
SYMBOLS = r"[#*$%&|<>]"


@dataclass(frozen=True)
class QualityRules:
    """Thresholds; a distance above its maximum rejects a document that reaches the minimum length.

    Short texts scatter more: ``word_slack`` over the number of words is added to the maximum for words. A language has
    a reference if at least ``min_reference_docs`` documents with a text are of it.
    """

    min_words: int = 50
    max_repeat_share: float = 0.5
    max_char_distance: float = 0.28
    min_chars_judged: int = 200
    max_word_distance: float = 0.285
    word_slack: float = 3.0
    min_words_judged: int = 100
    min_reference_docs: int = 20


#: Windows of a text are sorted as longs that hold their place in this many low bits, and a part of their hash above.
PLACE_BITS = 31


def common_candidates(docs: DataFrame, least_docs: int) -> dict[str, list[str]]:
    """The most frequent words, in lower case, of each language of at least ``least_docs`` documents, from all documents.

    Each task keeps a sketch of frequent words for each language, so no words are shuffled.
    """
    known = docs.where("lang is not null and text is not null").select("lang", "text")
    large = [r["lang"] for r in known.groupBy("lang").count().where(F.col("count") >= least_docs).collect()]
    if not large:
        return {}
    words = known.where(F.col("lang").isin(large)).select("lang", F.explode(blank_words(F.lower("text"))).alias("word"))
    found = words.groupBy("lang").agg(F.expr(f"approx_top_k(word, {N_CANDIDATES}, {N_TRACKED})").alias("top"))
    made = {r["lang"]: sorted(x["item"] for x in r["top"]) for r in found.collect()}
    return {lang: made.get(lang, []) for lang in sorted(large)}


def with_text_counts(docs: DataFrame, candidates: dict[str, list[str]]) -> DataFrame:
    """``docs`` with the struct ``counts`` of all counts of a text, and ``row``, both named behind its free prefix; null counts as empty.

    Each step is a column of its own, so that it is computed once per row and stays in generated code. The row number
    keeps the optimizer from pushing a filter on the counts below these steps, which would repeat them.
    """
    df, prefix = docs, free_prefix(docs)

    def add(name: str, value: Column) -> Column:
        nonlocal df
        df = df.withColumn(f"{prefix}{name}", value)
        return column(f"{prefix}{name}")

    text = F.coalesce(F.col("text"), F.lit(""))
    words = add("words", blank_words(text))
    lines = add("lines", F.filter(F.split(text, "\n"), lambda x: x.rlike(f"[^{BLANK_CLASS}]")))
    n_chars = add("n_chars", F.length(text))
    rest = add("rest", F.regexp_replace(text, r"[^A-Z0-9!-/:-@\[-`{-~]+", ""))  # little is left for the other classes to search
    word_chars = add("word_chars", F.length(F.array_join(words, "")))
    upper, digit, symbol = (add(name, F.regexp_count(rest, F.lit(kind))) for name, kind in (("upper", "[A-Z]"), ("digit", "[0-9]"), ("symbol", SYMBOLS)))
    marked, n = add("marked", F.length(rest)), add("n", F.size(words))
    dups = add("dups", F.size(lines) - F.size(F.array_distinct(lines)))

    # Words in repeated windows: windows sorted by a part of their hash; those with an equal neighbour are sorted by their
    # words; of those that have an equal neighbour still, the union of the spans.
    m = F.greatest(n - 2, F.lit(0))
    zipped = F.arrays_zip(*[F.slice(words, k, m).alias(f"w{k}") for k in (1, 2, 3)])
    hashes = add("hashes", F.transform(zipped, lambda z: F.xxhash64(z["w1"], z["w2"], z["w3"])))
    place_mask = (1 << PLACE_BITS) - 1
    packed = add("packed", F.when(F.size(F.array_distinct(hashes)) < m, F.sort_array(F.transform(hashes, lambda h, i: h.bitwiseAND(F.lit(~place_mask)).bitwiseOR(i.cast("long"))))))
    head = lambda x: F.shiftright(x, PLACE_BITS)
    beside = lambda same, k, of: F.coalesce(same(F.get(of, k - 1)), F.lit(False)) | F.coalesce(same(F.get(of, k + 1)), F.lit(False))
    doubles = add("doubles", F.filter(packed, lambda x, k: beside(lambda y: head(y) == head(x), k, packed)))
    worded = F.transform(doubles, lambda x: let(x.bitwiseAND(F.lit(place_mask)).cast("int"), lambda p: F.struct(F.slice(words, p + 1, 3).alias("words"), p.alias("place"))))
    runs = add("runs", F.sort_array(worded))
    equal = F.filter(runs, lambda x, k: beside(lambda y: y["words"] == x["words"], k, runs))
    places = add("places", F.sort_array(F.coalesce(F.transform(equal, lambda x: x["place"]), F.expr("cast(array() as array<int>)"))))
    gaps = F.transform(places, lambda p, k: F.least(F.lit(3), F.coalesce(F.get(places, k + 1), p + 3) - p))
    repeat = add("repeat", F.aggregate(gaps, F.lit(0), lambda a, b: a + b))

    # Runs of equal common words in sorted order give their counts.
    forms = sorted({f for words in candidates.values() for w in words for f in (w, w.capitalize(), w.upper())})
    common = add("common", F.sort_array(F.transform(F.filter(words, lambda x: x.isin(forms)), lambda x: F.lower(x))))
    ends = add("ends", F.filter(F.transform(common, lambda x, k: F.when(F.coalesce(F.get(common, k + 1) != x, F.lit(True)), k)), lambda k: k.isNotNull()))
    word_runs = F.transform(ends, lambda e, k: F.struct(F.get(common, e).alias("word"), (e - F.coalesce(F.get(ends, k - 1), F.lit(-1))).alias("n")))

    parts = [n_chars - word_chars, upper, digit, symbol, marked - upper - digit - symbol]
    sums = {"n_chars": n_chars, "n_words": n, "word_chars": word_chars, "n_symbols": symbol, "n_dup_lines": dups, "n_repeat_words": repeat}
    counts = F.struct(*[c.cast("long").alias(name) for name, c in sums.items()], F.array(*parts, n_chars - sum(parts[1:], parts[0])).alias("char_bins"), word_runs.alias("word_runs"))
    return df.select(*columns(docs), F.monotonically_increasing_id().alias(f"{prefix}row"), counts.alias(f"{prefix}counts"))


def language_references(counted: DataFrame, candidates: dict[str, list[str]], rules: QualityRules) -> dict[str, tuple[list[float], dict[str, float]]]:
    """Shares of character classes and of common words per language of ``candidates``, from all its documents that pass the base rules.

    counted: lang and the struct ``counts``. The driver gets a row for each language and candidate at most. Equally
    frequent words are taken in alphabetical order.
    """
    if not candidates:
        return {}
    # conditions within the sums, since a filter on the counts is pushed below all their steps, which repeats them
    known, ok = counted.where(F.col("lang").isin(list(candidates))), ~base_failed(F.col("counts"), rules)
    n = 6
    of = lambda c: F.coalesce(F.sum(F.when(ok, c)), F.lit(0))
    sums = known.groupBy("lang").agg(of(F.col("counts.n_words")).alias("words"), *[of(F.col("counts.char_bins")[i]).alias(f"c{i}") for i in range(n)]).collect()
    own = F.create_map(*[c for lang, words in candidates.items() for c in (F.lit(lang), F.array(*map(F.lit, words)).cast("array<string>"))])
    # the outer form, since for the other a filter on the size of the runs is pushed below all steps, too
    runs = known.select("lang", ok.alias("ok"), F.inline_outer("counts.word_runs")).where(F.array_contains(F.try_element_at(own, F.col("lang")), F.col("word"))).groupBy("lang", "word").agg(F.coalesce(F.sum(F.when(F.col("ok"), F.col("n"))), F.lit(0)).alias("n")).collect()
    made = {}
    for r in sorted(sums, key=lambda r: r["lang"]):
        chars = [r[f"c{i}"] for i in range(n)]
        words = dict(sorted(((x["word"], x["n"]) for x in runs if x["lang"] == r["lang"]), key=lambda x: (-x[1], x[0]))[:N_COMMON])
        words[""] = r["words"] - sum(words.values())
        made[r["lang"]] = ([v / max(1, sum(chars)) for v in chars], {w: v / max(1, r["words"]) for w, v in sorted(words.items())})
    return made


def divergence_terms(p: Column, q: Column) -> Column:
    """Twice a bin's part of the Jensen-Shannon divergence (base 2)."""
    side = lambda v: F.when(v > 0, v * F.log2(2 * v / (p + q))).otherwise(F.lit(0.0))
    return side(p) + side(q)


def distance(terms: Column) -> Column:
    return F.sqrt(F.greatest(F.lit(0.0), F.aggregate(terms, F.lit(0.0), lambda a, b: a + b) / 2))


def char_distance(counts: Column, shares: Column) -> Column:
    """Jensen-Shannon distance of the character classes to a reference, an array."""
    return distance(F.zip_with(counts["char_bins"], shares, lambda x, q: divergence_terms(x / counts["n_chars"], q)))


def word_distance(counts: Column, shares: Column) -> Column:
    """Jensen-Shannon distance of the common words, all others in one bin, to a reference, a map.

    A bin that the document lacks adds the reference's share, so only the words it has are visited.
    """
    own = F.filter(counts["word_runs"], lambda r: F.map_contains_key(shares, r["word"]))
    other = counts["n_words"] - F.aggregate(own, F.lit(0).cast("long"), lambda a, r: a + r["n"])
    runs = F.concat(F.transform(own, lambda r: F.struct(r["word"].alias("word"), r["n"].cast("long").alias("n"))), F.array(F.struct(F.lit("").alias("word"), other.alias("n"))))
    q = lambda r: F.coalesce(F.try_element_at(shares, r["word"]), F.lit(0.0))
    seen = F.transform(runs, lambda r: divergence_terms(r["n"] / counts["n_words"], q(r)) - q(r))
    return distance(F.concat(seen, F.array(F.aggregate(F.map_values(shares), F.lit(0.0), lambda a, b: a + b))))


def base_failed(counts: Column, rules: QualityRules) -> Column:
    return (counts["n_words"] < rules.min_words) | (100 * counts["n_repeat_words"] > 100 * rules.max_repeat_share * counts["n_words"])


def verdict(counts: Column, lang: Column, references: dict[str, tuple[list[float], dict[str, float]]], rules: QualityRules) -> Column:
    """Struct base_failed, char_distance, word_distance, kept; a distance that isn't judged is 0."""
    failed = base_failed(counts, rules)
    char = word = F.lit(0.0)
    if references:
        array = lambda shares: F.array(*map(F.lit, shares))
        chars = F.try_element_at(F.create_map(*[c for name, r in references.items() for c in (F.lit(name), array(r[0]))]), lang)
        words = F.try_element_at(F.create_map(*[c for name, r in references.items() for c in (F.lit(name), F.create_map(*[F.lit(x) for pair in r[1].items() for x in pair]))]), lang)
        nearest = F.array_min(F.array(F.lit(1.0), *[char_distance(counts, array(r[0])) for r in references.values()]))
        char = F.when(counts["n_chars"] >= rules.min_chars_judged, F.when(chars.isNotNull(), char_distance(counts, chars)).otherwise(nearest)).otherwise(char)
        word = F.when((counts["n_words"] >= rules.min_words_judged) & words.isNotNull(), word_distance(counts, words)).otherwise(word)
    made = F.struct(failed.alias("base_failed"), char.alias("char_distance"), word.alias("word_distance"))
    return let(made, lambda m: F.struct(m["base_failed"].alias("base_failed"), m["char_distance"].alias("char_distance"), m["word_distance"].alias("word_distance"), (~m["base_failed"] & (m["char_distance"] <= rules.max_char_distance) & (m["word_distance"] <= rules.max_word_distance + rules.word_slack / F.greatest(counts["n_words"], F.lit(1)))).alias("kept")))


def judge_quality(docs: DataFrame, rules: QualityRules = QualityRules()) -> DataFrame:
    """Per document: doc_id, the counts, both distances, base_failed and kept.

    Words are ``[^\\x20\\x09-\\x0D]+``. A null text has no words and fails; documents without a language, or of one that has
    no reference, take no part in the references; with no references at all only the base rules decide. Repeated rows
    stay repeated. Counts are checkpointed, so texts are read twice: for the common words, and for the counts.
    """
    candidates = common_candidates(docs, rules.min_reference_docs)
    own = docs.select("doc_id", "lang", "text")
    counted = cut_lineage(with_text_counts(own, candidates).select("doc_id", "lang", F.col("__counts").alias("counts")))
    judged = counted.withColumn("verdict", verdict(F.col("counts"), F.col("lang"), language_references(counted, candidates, rules), rules))
    return judged.select("doc_id", *[f"counts.{c}" for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")], "verdict.base_failed", "verdict.kept", "verdict.char_distance", "verdict.word_distance")


def keep_quality(docs: DataFrame, rules: QualityRules = QualityRules()) -> DataFrame:
    """The rows of ``docs`` that are kept, all columns unchanged. Texts are read three times, and never shuffled.

    Nulls, repeats and empty tables are treated as by ``judge_quality``.
    """
    prefix = free_prefix(docs)
    candidates = common_candidates(docs, rules.min_reference_docs)
    counted = with_text_counts(docs, candidates)
    counts, row = column(f"{prefix}counts"), column(f"{prefix}row")
    references = language_references(counted.select("lang", counts.alias("counts")), candidates, rules)
    return counted.where(verdict(counts, F.col("lang"), references, rules)["kept"] & (row >= 0)).select(*columns(docs))
