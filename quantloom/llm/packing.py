"""Packing token ids into windows of equal capacity by multiway differencing (Karmarkar and Karp).

One pass over the texts encodes each document once, cuts it and notes a checksum for each piece, so neither texts nor
ids are shuffled. Whole windows that a document fills alone are done; the pieces that are left are dealt by hash into
blocks of bounded size, and each block is packed on its own: two partial partitions are merged at a time, the largest
sums of the one onto the smallest of the other, until one is left whose windows are nearly equal. Where its largest
window exceeds the capacity, the block gets more windows.
"""

from __future__ import annotations

import heapq
import struct
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers.pre_tokenizers import ByteLevel

from .common import cut_lineage
from .tokens import PreTokens, pre_tokens

#: Pieces of a block, on average: what one task packs at a time.
BLOCK_PIECES = 4096
#: Distinct texts whose ids a task remembers, and the longest of them.
CACHED_TEXTS, CACHED_LENGTH = 400_000, 64


class ByteNames(dict):
    """The characters by which the tokenizer's model knows a character's bytes."""

    def __init__(self):
        super().__init__()
        self.level = ByteLevel(add_prefix_space=False, use_regex=False)

    def __missing__(self, code: int) -> str:
        self[code] = self.level.pre_tokenize_str(chr(code))[0][0]
        return self[code]


class Remembered(dict):
    """Ids by text; a text is encoded by ``make`` when it isn't remembered."""

    def __init__(self, make: Callable[[str], bytes]):
        super().__init__()
        self.make = make

    def __missing__(self, text: str) -> bytes:
        ids = self.make(text)
        if len(text) <= CACHED_LENGTH:
            if len(self) >= CACHED_TEXTS:
                self.clear()
            self[text] = ids
        return ids


class Encoder:
    """Ids of whole texts, as little-endian 32-bit numbers. Pre-tokens, and words between blanks, are encoded once while they are remembered."""

    def __init__(self, tokens: PreTokens):
        self.tokens, self.names = tokens, ByteNames()
        self.token, self.word = Remembered(self._encode), Remembered(lambda word: b"".join([self.token[t] for t in tokens.latin.findall(word)]))

    def _encode(self, token: str) -> bytes:
        if token.startswith("<|") and self.tokens.special.fullmatch(token):
            ids = [self.tokens.tokenizer.token_to_id(token)]
        else:
            plain = token.isascii() and token.isprintable()  # such a character is its own name
            ids = [t.id for t in self.tokens.tokenizer.model.tokenize(token if plain else token.translate(self.names))]
        return struct.pack(f"<{len(ids)}I", *ids)

    def ids(self, text: str) -> bytes:
        if self.tokens.by_words(text):
            return b"".join([self.word[w] for w in text.lower().split()])
        return b"".join([self.token[t] for t in self.tokens.sequence(text)])


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(pre_tokens(path))


def cuts(n: int, capacity: int, piece: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: windows that it fills, then pieces of ``piece`` ids at most."""
    whole = n - n % capacity
    return [(a, capacity) for a in range(0, whole, capacity)] + [(a, min(piece, n - a)) for a in range(whole, n, piece)]


def difference(sizes: np.ndarray, k: int) -> tuple[np.ndarray, int]:
    """The window (0 to k - 1) of each item, and the largest window's sum.

    A partial partition is held as its windows that have items, by falling sum, each a chain of items with its first
    and last one. The two partitions of the largest spread are merged next.
    """
    n = len(sizes)
    after = np.full(n, -1)
    parts = {i: (sizes[i : i + 1], np.array([i]), np.array([i])) for i in range(n)}
    heap = [(-int(s) if k > 1 else 0, i) for i, s in enumerate(sizes.tolist())]
    heapq.heapify(heap)
    for merged in range(n, 2 * n - 1):
        (sum_a, first_a, last_a), (sum_b, first_b, last_b) = (parts.pop(heapq.heappop(heap)[1]) for _ in range(2))
        met = max(0, len(sum_a) + len(sum_b) - k)  # so many windows have items of both: small ones of one with large of the other
        own_a, own_b = len(sum_a) - met, len(sum_b) - met
        after[last_a[own_a:]] = first_b[own_b:][::-1]
        sums = np.concatenate([sum_a[:own_a], sum_a[own_a:] + sum_b[own_b:][::-1], sum_b[:own_b]])
        first, last = np.concatenate([first_a, first_b[:own_b]]), np.concatenate([last_a[:own_a], last_b[own_b:][::-1], last_b[:own_b]])
        order = np.argsort(-sums, kind="stable")
        parts[merged] = sums[order], first[order], last[order]
        spread = int(sums.max() - (sums.min() if len(sums) == k else 0))
        heapq.heappush(heap, (-spread, merged))
    sums, at, _ = parts.popitem()[1]
    window, number = np.empty(n, np.int64), np.arange(len(at))
    while len(at):
        window[at] = number
        at = after[at]
        at, number = at[at >= 0], number[at >= 0]
    return window, int(sums[0])


def near_equal_windows(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """The window of each item; as many windows as it takes for none to exceed the capacity, which no item does."""
    k = -(-int(sizes.sum()) // capacity)
    while True:
        window, largest = difference(sizes, k)
        if largest <= capacity:
            return window
        k = max(k + 1, k * largest // capacity)


def pack(docs: DataFrame, path: str, *, capacity: int = 2048, piece: int = 512, end_id: int = 1, block_pieces: int = BLOCK_PIECES) -> DataFrame:
    """Per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id and offset.

    A document is the tokenizer's ids of its whole text, then ``end_id``; a null text is empty, so it is ``end_id``
    alone. Sequences have at most ``capacity`` ids; ids of sequences are unique, not gapless. Repeated rows are
    documents of their own, and so are rows without doc_id; an empty table has no piece. Only doc_id and text are read.
    """
    kind = docs.schema["doc_id"].dataType
    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        end = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            rows, out = [], ([], [], [], [])
            for row, text in enumerate(batch.column(1)):
                ids = encoder(path).ids(text.as_py() or "") + end
                n = len(ids) // 4
                for a, length in cuts(n, capacity, piece):
                    rows.append(row)
                    for values, v in zip(out, (a, length, zlib.crc32(ids[4 * a : 4 * (a + length)]), n), strict=True):
                        values.append(v)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int32())), *(pa.array(v, pa.int64()) for v in out)], columns)

    fields = f"doc_id {kind.simpleString()}, start long, length long, ids_crc32 long, doc_tokens long"
    pieces = cut_lineage(docs.select("doc_id", "text").mapInArrow(cut, fields)).withColumn("piece", F.monotonically_increasing_id())
    whole, rest = pieces.where(F.col("length") == capacity), pieces.where(F.col("length") < capacity)
    blocks = -(-rest.count() // block_pieces) or 1

    def pack_block(block: pa.Table) -> pa.Table:
        block = block.sort_by("piece")
        sizes = block["length"].to_numpy()
        window = near_equal_windows(sizes, capacity)
        order = np.argsort(window, kind="stable")
        before = np.cumsum(sizes[order]) - sizes[order]
        offset = np.empty_like(before)
        offset[order] = before - before[np.searchsorted(window[order], window[order])]
        sequence = 2 * (block["block"].to_numpy() * (1 << 24) + window) + 1
        return block.select(columns).append_column("sequence_id", pa.array(sequence)).append_column("offset", pa.array(offset))

    packed = rest.withColumn("block", F.pmod(F.xxhash64("piece"), F.lit(blocks))).groupBy("block").applyInArrow(pack_block, f"{fields}, sequence_id long, offset long")
    return packed.unionByName(whole.select(*columns, (2 * F.col("piece")).alias("sequence_id"), F.lit(0).cast("long").alias("offset")))
