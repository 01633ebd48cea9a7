"""Token counts without materialising ids.

A BPE tokenizer splits a text into pre-tokens and encodes each on its own, so a text's count is the sum over its
pre-tokens. The distinct pre-tokens of the corpus are gathered with Spark, the library encodes each once, and the
piece counts are joined to the pre-token frequencies of the documents. The most frequent pre-tokens, a bounded head,
are handed to the tasks that split the texts, so only the rare rest is shuffled.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut_lineage

#: Pre-tokens whose piece counts every task may hold; the rest is joined.
HEAD_TOKENS = 400_000
#: Distinct pre-tokens that a task holds before it passes them on.
FLUSH_AT = 200_000
# The tokenizer's own split pattern, and the same for characters below U+0250 in Python's syntax.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_LETTERS, _NUMBERS, _BLANKS = "a-zA-Zªµº\xc0-\xd6\xd8-\xf6\xf8-ɏ", "0-9\xb2\xb3\xb9\xbc-\xbe", "\t-\r \x85\xa0"
SPLIT_LATIN = f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[{_NUMBERS}]|[^{_BLANKS}{_LETTERS}{_NUMBERS}]+"


class PreTokens:
    """Splits texts as the tokenizer at ``path`` does, which must be a lower-casing word BPE with the pattern SPLIT."""

    def __init__(self, path: str):
        import json
        import os

        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        if pattern != SPLIT:
            raise ValueError(f"the tokenizer splits by another pattern: {pattern}")
        special = [re.escape(t["content"]) for t in spec["added_tokens"]]
        self.special = re.compile("(" + "|".join(special) + ")") if special else None
        # what isn't below U+0250, or isn't once it is lower-cased
        self.other = re.compile("[" + "".join(c for c in map(chr, range(0x250)) if max(c.lower()) > "ɏ") + "ɐ-\U0010ffff]")
        self.separator = re.compile("[\x1c-\x1f]")
        self.latin, self.stand_ins = re.compile(SPLIT_LATIN), {}

    def _parts(self, text: str) -> list[str]:
        """The text cut at special tokens: every second part is one."""
        return self.special.split(text) if self.special and "<|" in text else [text]

    def split(self, text: str) -> tuple[list[str], int]:
        """The pre-tokens, and how many special tokens stand between them."""
        parts = self._parts(text)
        return (self._plain(text), 0) if len(parts) == 1 else ([t for p in parts[::2] for t in self._plain(p)], len(parts) // 2)

    def by_words(self, text: str) -> bool:
        """Whether the lower-cased text's blank-separated words can be split one by one, each by ``latin``.

        Python's split() takes the separators U+001C to U+001F for blanks, too; the library doesn't.
        """
        return not ("<|" in text or self.separator.search(text)) and (text.isascii() or not self.other.search(text))

    def sequence(self, text: str) -> list[str]:
        """The pre-tokens and special tokens in the order of the text."""
        parts = self._parts(text)
        return self._plain(text) if len(parts) == 1 else [t for k, p in enumerate(parts) for t in ([p] if k % 2 else self._plain(p))]

    def _plain(self, text: str) -> list[str]:
        if text.isascii() or not self.other.search(text):
            return self.latin.findall(text.lower())
        text = self.tokenizer.normalizer.normalize_str(text)
        for c in set(self.other.findall(text)):
            if ord(c) not in self.stand_ins:
                self.stand_ins[ord(c)] = self._stand_in(c)
        return [text[m.start() : m.end()] for m in self.latin.finditer(text.translate(self.stand_ins))]

    def _stand_in(self, c: str) -> str:
        """A character below U+0250 that the pattern treats as the library treats ``c``, whose Unicode tables may be its own."""
        ends = lambda text: [b for _, (_, b) in self.tokenizer.pre_tokenizer.pre_tokenize_str(text)]
        if ends(f"a{c}") == [2]:
            return "a"  # a letter
        if not ends(c):
            return " "
        return "\xa7" if ends(c + c) == [2] else "1"

    def pieces(self, tokens: list[str]) -> list[int]:
        return [len(e) for e in self.tokenizer.encode_batch(tokens, add_special_tokens=False)]


@lru_cache(maxsize=2)
def pre_tokens(path: str) -> PreTokens:
    return PreTokens(path)


def count_pieces(docs: DataFrame, path: str) -> DataFrame:
    """(token, n, pieces): the distinct pre-tokens of all texts, how often each occurs, and its number of tokens."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, seen = pre_tokens(path).split, Counter()
        out = lambda: pa.RecordBatch.from_pydict({"token": pa.array(list(seen), pa.string()), "n": pa.array(list(seen.values()), pa.int64())})
        for batch in batches:
            for text in batch.column(0):
                seen.update(split(text.as_py() or "")[0])
                if len(seen) > FLUSH_AT:
                    yield out()
                    seen.clear()
        yield out()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = pre_tokens(path).pieces(batch.column(0).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(counts, pa.int32())], ["token", "n", "pieces"])

    found = docs.select("text").where("text is not null").mapInArrow(gather, "token string, n long")
    return found.groupBy("token").agg(F.sum("n").alias("n")).mapInArrow(encode, "token string, n long, pieces int")


def head_of(pieces: DataFrame, most: int) -> dict[str, int]:
    """Piece counts of the most frequent pre-tokens, ``most`` at most: all that occur at least some number of times."""
    n_at = pieces.groupBy(F.least("n", F.lit(10_000)).alias("n")).count().collect()
    least, held = None, 0
    for n, count in sorted(((r["n"], r["count"]) for r in n_at), reverse=True):
        held += count
        if held > most:
            break
        least = n
    if least is None:
        return {}
    return {r["token"]: r["pieces"] for r in pieces.where(F.col("n") >= least).select("token", "pieces").toLocalIterator()}


def count_tokens(docs: DataFrame, path: str, *, limit: int = 2048, head_tokens: int = HEAD_TOKENS) -> DataFrame:
    """Per document: doc_id, n_bytes (UTF-8), n_tokens and over_limit (n_tokens > limit).

    Counts are those of the library for whole texts, without added special tokens; special strings inside texts count
    as one token each. A null text is empty and has 0 of both. Repeated rows stay repeated, a null doc_id is a value
    like any other; an empty table gives an empty result.
    """
    pieces = cut_lineage(count_pieces(docs, path))
    head = docs.sparkSession.sparkContext.broadcast(head_of(pieces, head_tokens))
    id_type = docs.schema["doc_id"].dataType

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, known = pre_tokens(path).split, head.value
        for batch in batches:
            take, tokens, counts = [], [], []
            hashes = batch.column(1).to_pylist()
            for row, text in enumerate(batch.column(2)):
                text = text.as_py() or ""
                found, inside = split(text)
                for token, n in Counter(found).items():
                    if (k := known.get(token)) is not None:
                        inside += k * n
                    else:
                        take.append(row), tokens.append(token), counts.append(n)
                # a row of its own for the document, with its length and the tokens of the head; no pre-token has a blank
                take.append(row), tokens.append(f" {len(text.encode())} {hashes[row]}"), counts.append(inside)
            rows = pa.array(take, pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), batch.column(1).take(rows), pa.array(tokens, pa.string()), pa.array(counts, pa.int64())], ["doc_id", "text_hash", "token", "n"])

    found = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text").mapInArrow(frequencies, f"doc_id {id_type.simpleString()}, text_hash long, token string, n long")
    own = F.col("token").startswith(" ")
    joined = found.join(pieces.select("token", "pieces"), "token", "left")
    length = F.when(own, F.split("token", " ")[1].cast("long"))
    summed = joined.groupBy("doc_id", "text_hash").agg(F.sum(F.when(own, F.col("n")).otherwise(F.col("n") * F.col("pieces"))).alias("n"), F.sum(length).alias("length"), F.sum(own.cast("int")).alias("copies"))
    # equal rows were summed together
    each = summed.withColumn("copy", F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int"))))
    each = each.select("doc_id", F.expr("length div copies").alias("n_bytes"), F.expr("n div copies").alias("n_tokens"))
    return each.withColumn("over_limit", F.col("n_tokens") > limit)
