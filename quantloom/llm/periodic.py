"""Periodic runs of words: stretches that repeat a passage at least three times in a row.

An online sparse diagonal DP per document: each word's earlier occurrences are diagonals, known by their lag; an
occurrence lengthens its diagonal's match, and a diagonal that ends is a run if its match is long enough.

What makes it sparse: of a run's words the match at its period p is at least (repeats - 1) p words long, so a word
counts as occurring earlier only if a window of m words from it does. Windows of m = 16, 32, 64 ... words are looked
at; a period p belongs to the smallest m >= p, and there the nearest earlier occurrence of a window inside the run is
p words before, as a nearer one would make the period smaller. So each word has one earlier occurrence for each m at
most, whatever its frequency, and a text of n words takes n log n steps. Windows are named by pairs of names of their
halves, so equal names are equal words; a name that doesn't occur twice in its document is dropped at once.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import pairwise

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame

from ..errors import InvalidParameter

#: Bytes of text whose words are held at once; a longer text is held alone.
CHUNK_BYTES = 4 << 20
RUN_TYPE = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


@dataclass(frozen=True)
class RunRule:
    """A run has at least ``min_length`` words and ``min_repeats`` periods (3 at least)."""

    min_length: int = 24
    min_repeats: int = 3

    def __post_init__(self):
        if self.min_length < 2 or self.min_repeats < 3:
            raise InvalidParameter(f"{self}")

    def needs(self, period: int) -> int:
        return max(self.min_length, self.min_repeats * period)

    def window(self) -> int:
        """The largest power of two that the match of no run is shorter than."""
        shortest = min(self.needs(p) - p for p in range(1, self.min_length + 1))
        return 1 << (shortest.bit_length() - 1)


def repeated_windows(names: np.ndarray, width: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For m = width, 2 width, ...: (m, positions, names) of the windows of m words that occur twice or more."""
    at, m = np.arange(len(names)), 1
    while True:
        again = np.bincount(names)[names] > 1
        at, names = at[again], names[again]
        if not len(at):
            return
        if m >= width:
            yield m, at, names
        halves = np.full(at[-1] + m + 1, -1)
        halves[at] = names
        second = halves[at + m]
        at, first, second = at[second >= 0], names[second >= 0], second[second >= 0]
        names, m = pd.factorize(first * (len(halves) + 1) + second)[0], 2 * m


def earlier_occurrences(names: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(position, lag, m) by position: the nearest earlier occurrence of the window of m words, where the lag is one of m's."""
    found = []
    for m, at, same in repeated_windows(names, width):
        order = np.argsort(same, kind="stable")
        at, same = at[order], same[order]
        lag = at[1:] - at[:-1]
        fits = (same[1:] == same[:-1]) & (lag <= m) & ((lag > m // 2) | (m == width))
        found.append((at[1:][fits], lag[fits], np.full(fits.sum(), m)))
    if not found:
        return (np.zeros(0, np.int64),) * 3
    position, lag, m = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.argsort(position, kind="stable")
    return position[order], lag[order], m[order]


def diagonal_runs(names: np.ndarray, rule: RunRule) -> list[tuple[int, int, int]]:
    """(start, length, period) of all maximal runs, in the order in which they end; names: a number for each word."""
    runs, width = [], rule.window()
    live: dict[int, list[int]] = {}  # lag: matched windows so far, the last one's position, m

    def end(lag: int) -> None:
        windows, last, m = live.pop(lag)
        length = windows + m - 1 + lag
        if length >= rule.needs(lag):
            runs.append((last + m - length, length, lag))

    for i, lag, m in zip(*(x.tolist() for x in earlier_occurrences(names, width)), strict=True):
        for ended in [k for k, x in live.items() if x[1] < i - 1]:
            end(ended)
        diagonal = live.setdefault(lag, [0, i, m])
        diagonal[0], diagonal[1] = diagonal[0] + 1, i
    for lag in list(live):
        end(lag)
    return runs


def runs_of_texts(texts: list[bytes], rule: RunRule) -> list[tuple[int, list[dict], bytes]]:
    """Per text: its number of words, its runs by start and period, and the words that are left, joined by one space."""
    words = [t.split() for t in texts]
    name: defaultdict[bytes, int] = defaultdict()
    name.default_factory = name.__len__
    names, used = [np.zeros(0, np.int64)], 0
    for w in words:
        names.append(np.array([name[x] for x in w], np.int64) + used)  # names of one text are no other's
        used += len(name)
        name.clear()
    ends = np.cumsum([len(w) for w in words])
    per_text: defaultdict[int, list[tuple[int, int, int]]] = defaultdict(list)
    for start, length, period in diagonal_runs(np.concatenate(names), rule):
        row = int(np.searchsorted(ends, start, side="right"))
        per_text[row].append((start - int(ends[row]) + len(words[row]), length, period))
    out = []
    for row, w in enumerate(words):
        runs = sorted(per_text.get(row, ()), key=lambda r: (r[0], r[2]))
        kept = w
        if runs:
            keep = np.ones(len(w), bool)
            for start, length, period in runs:
                keep[start + period : start + length] = False
            kept = [w[i] for i in np.flatnonzero(keep).tolist()]
        out.append((len(w), [dict(zip(("start", "length", "period"), r, strict=True)) for r in runs], b" ".join(kept)))
    return out


def find_runs(docs: DataFrame, rule: RunRule | None = None) -> DataFrame:
    """Per document: doc_id, n_words, runs (start, length and period in words, by start and period) and text.

    Words are ``[^\\x20\\x09-\\x0D]+``. A run is a stretch of words with smallest period p that is as long as the rule
    asks for and that no neighbouring word extends with the same period; runs can overlap. In text all words that
    stand in a run behind its first period are left out; the others are joined by one space. A null text has no words,
    no runs and gives an empty text. No shuffle; rows stay as they are, repeated ones and those without doc_id, too.
    An empty table gives an empty result. Only doc_id and text are read.
    """
    rule = rule or RunRule()
    kind = docs.schema["doc_id"].dataType

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1)
            size = np.cumsum([0, *(len(t.as_buffer()) if t.is_valid else 0 for t in texts)])
            bounds = sorted({0, len(texts), *np.searchsorted(size, np.arange(CHUNK_BYTES, int(size[-1]), CHUNK_BYTES)).tolist()})
            for a, b in pairwise(bounds):
                made = runs_of_texts([t.as_buffer().to_pybytes() if t.is_valid else b"" for t in texts[a:b]], rule)
                n, runs, left = zip(*made, strict=True)
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], pa.array(n, pa.int64()), pa.array(runs, RUN_TYPE), pa.array(left, pa.binary()).cast(pa.string())], ["doc_id", "n_words", "runs", "text"])

    return docs.select("doc_id", "text").mapInArrow(scan, f"doc_id {kind.simpleString()}, n_words long, runs array<struct<start:long,length:long,period:long>>, text string")
