"""Line deduplication by an exact set-similarity join.

A line is the set of its words. Two lines match if the Jaccard similarity of their sets is at least the threshold, and
a line goes if one that comes earlier matches it. Lines with equal sets are one class, and only the first line of a
class takes part in the join. Classes meet on the rarest words of their sets: with words in one order of rarity for
all sets, a matching pair shares a word within the first |s| - ceil(t |s|) + 1 of each (prefix filter), the sizes are
within t of each other (length filter), the places of the first shared word leave room for the overlap (positional
filter), and the parity signatures, one bit flipped per word, differ in no more bits than the sets may in words.

A class needs one earlier partner, not all of them. The classes that share a rare word lie in one task in order of
their first lines, and each looks for the first partner that passes the filters, so a group of near copies costs about
its size and no list of its pairs is made. Partners are verified on the words of the two lines; a class whose partner
fails looks for further ones, always sixteen times as many, until one holds or none is left.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_BYTES, bounded_broadcast, column, columns, cut_lineage, free_prefix, held_bytes, shuffle_partitions

#: Buckets of word hashes whose counts rank words by rarity; the bound on what the driver gathers.
RANK_BITS = 18
#: Words of a set beyond which its parity signature is wider.
WIDE = 64
#: Bytes of text whose lines a task compares for equal sets, and of text that it takes apart at once, into arrays of about ten times as many.
CHUNK_BYTES, PIECE_BYTES = 4 << 20, 1 << 20


def line_words(line: str) -> set[bytes]:
    """The words ``[^\\x20\\x09-\\x0D]+`` of a line with A-Z lower-cased."""
    return set(line.encode("utf-8", "surrogatepass").lower().split())


def similar_lines(a: str, b: str, threshold: float) -> bool:
    """Whether the words of two lines are similar enough."""
    x, y = line_words(a), line_words(b)
    both = len(x & y)
    return both >= threshold * (len(x) + len(y) - both) - 1e-9


class Lines:
    """The lines with words of some texts, each as its distinct words, in arrays.

    ``words`` are the distinct words of all lines; line k has ``words[codes[starts[k] : starts[k + 1]]]``.
    """

    def __init__(self, texts: pa.Array):
        split = pc.split_pattern(pc.fill_null(texts.cast(pa.large_string()), ""), "\n")
        rows = pc.list_parent_indices(split).to_numpy()
        places = np.arange(len(rows)) - split.offsets.to_numpy()[rows] + (split.offsets[0].as_py() if len(split) else 0)
        parts = pc.ascii_split_whitespace(pc.ascii_lower(split.flatten()))
        flat, owner = parts.flatten(), pc.list_parent_indices(parts).to_numpy()
        full = pc.greater(pc.binary_length(flat), 0)
        flat, owner = flat.filter(full).dictionary_encode(), owner[full.to_numpy(zero_copy_only=False)]
        self.words, self.codes, self.owner = flat.dictionary, flat.indices.to_numpy(), owner
        self.rows, self.places = rows, places

    def restrict(self, wanted: np.ndarray) -> None:
        """Keep the lines that have one of the words for which ``wanted`` is true."""
        lines = np.zeros(len(self.rows), bool)
        lines[self.owner[wanted[self.codes]]] = True
        keep = lines[self.owner]
        self.codes, self.owner = self.codes[keep], self.owner[keep]

    def sorted_by(self, keys: np.ndarray) -> None:
        """Drop repeated words of a line and put the rest in order of their keys: adds line numbers, starts and keys."""
        order = np.argsort(keys, kind="stable")
        rank = np.empty(len(keys), np.int64)
        rank[order] = np.arange(len(keys))
        both = np.sort(self.owner.astype(np.int64) << 32 | rank[self.codes])
        both = both[np.concatenate([[True], both[1:] != both[:-1]])] if len(both) else both
        line, self.keys = both >> 32, keys[order][both & 0xFFFFFFFF]
        self.starts = np.flatnonzero(np.concatenate([[True], line[1:] != line[:-1]])) if len(line) else np.zeros(0, np.int64)
        held = line[self.starts]
        self.rows, self.places = self.rows[held], self.places[held]
        self.sizes = np.diff(np.concatenate([self.starts, [len(line)]])).astype(np.int64)

    def identities(self) -> tuple[np.ndarray, np.ndarray]:
        """Of each set 64 bits of the sum of its mixed keys and its parity signature, together its identity."""
        if not len(self.starts):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        mixed = (self.keys ^ self.keys >> np.uint64(31)) * np.uint64(0x9E3779B97F4A7C15)
        mixed = (mixed ^ mixed >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9)
        bits = np.left_shift(np.uint64(1), self.keys & np.uint64(63))
        sums = np.add.reduceat(mixed ^ mixed >> np.uint64(32), self.starts)
        return sums.view(np.int64), np.bitwise_xor.reduceat(bits, self.starts).view(np.int64)

    def checks(self) -> np.ndarray:
        """Of each set 64 further bits, by which lines are compared with the first line of their identity."""
        if not len(self.starts):
            return np.zeros(0, np.int64)
        mixed = (self.keys ^ self.keys >> np.uint64(33)) * np.uint64(0xFF51AFD7ED558CCD)
        mixed = (mixed ^ mixed >> np.uint64(27)) * np.uint64(0xC4CEB9FE1A85EC53)
        return np.add.reduceat(mixed ^ mixed >> np.uint64(33), self.starts).view(np.int64)

    def quarters(self) -> list[np.ndarray]:
        """The parities of 256 bits, but for the first 64, which follow from these and the parity of 64 bits; 0 for small sets.

        Sets of over WIDE words have 128 bits, of twice as many 256: where sets may differ in many words, few bits are
        full. The wider signatures fold to the narrower ones.
        """
        if not len(self.starts):
            return [np.zeros(0, np.int64)] * 3
        bits, part = np.left_shift(np.uint64(1), self.keys & np.uint64(63)), self.keys >> np.uint64(6) & np.uint64(3)
        q = [np.bitwise_xor.reduceat(np.where(part == np.uint64(k), bits, np.uint64(0)), self.starts).view(np.int64) for k in (1, 2, 3)]
        widest = self.sizes > 2 * WIDE
        first = np.where(widest, q[0], np.where(self.sizes > WIDE, q[0] ^ q[2], 0))
        return [first, np.where(widest, q[1], 0), np.where(widest, q[2], 0)]

    def heads(self, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of the first words of each line: the line, the place in it and the key."""
        total = int(lengths.sum())
        line = np.repeat(np.arange(len(lengths)), lengths)
        place = np.arange(total) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        return line, place, self.keys[self.starts[line] + place] if total else np.zeros(0, np.uint64)


#: Tabulation hashing: a random word for each of the first bytes of a word and each value of the byte.
_PLACES = 256
_TABLE = np.random.default_rng(8).integers(0, 1 << 64, (_PLACES, 256), np.uint64)


def word_hashes(words: pa.LargeStringArray) -> np.ndarray:
    """64-bit hashes of distinct, non-empty words; those longer than the table are hashed one by one."""
    if not len(words):
        return np.zeros(0, np.uint64)
    _, offsets, data = words.buffers()
    offsets = np.frombuffer(offsets, np.int64)[words.offset : words.offset + len(words) + 1]
    data, starts, sizes = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets[:-1] - offsets[0], np.diff(offsets)
    place = np.arange(len(data)) - np.repeat(starts, sizes)
    h = np.bitwise_xor.reduceat(_TABLE[np.minimum(place, _PLACES - 1), data], starts) ^ sizes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for k in np.flatnonzero(sizes > _PLACES):
        h[k] = xxhash.xxh64_intdigest(words[int(k)].as_py())
    return h


def word_keys(words: pa.Array, ranks: np.ndarray) -> np.ndarray:
    """64-bit keys of words that sort by rarity: the rank of the hash's bucket, then the rest of the hash."""
    h, rest = word_hashes(words), np.uint64(64 - RANK_BITS)
    return ranks[(h >> rest).astype(np.int64)].astype(np.uint64) << rest | h & ((np.uint64(1) << rest) - np.uint64(1))


def chunks(batch: pa.RecordBatch, text: int, size: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about ``size`` bytes of text; a longer text is a part of its own."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)) // size
    cuts = [0, *(np.flatnonzero(np.diff(sizes)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts, cuts[1:], strict=False):
        if b > a:
            yield batch.slice(a, b - a)


def rank_words(docs: DataFrame) -> np.ndarray:
    """Rank of each hash bucket by how many words of all lines fall into it, the rarest first."""

    def add(sums: np.ndarray, texts: pa.Array) -> None:
        split = pc.split_pattern(pc.fill_null(texts.cast(pa.large_string()), ""), "\n").flatten()  # fresh: ascii_lower takes a slice's bytes from the wrong place
        words = pc.ascii_split_whitespace(pc.ascii_lower(split)).flatten().dictionary_encode()
        full = pc.greater(pc.binary_length(words.dictionary), 0)
        times = np.bincount(words.indices.to_numpy(), minlength=len(words.dictionary))[full.to_numpy(zero_copy_only=False)]
        np.add.at(sums, (word_hashes(words.dictionary.filter(full)) >> np.uint64(64 - RANK_BITS)).astype(np.int64), times)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(1 << RANK_BITS, np.int64)
        for batch in batches:
            for piece in chunks(batch, 0, PIECE_BYTES):
                add(sums, piece.column(0))
        at = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(sums[at])], ["bucket", "n"])

    rows = docs.select("text").mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
    sums = np.zeros(1 << RANK_BITS, np.int64)
    sums[rows["bucket"].to_numpy(np.int64)] = rows["n"].to_numpy(np.int64)
    ranks = np.empty(1 << RANK_BITS, np.int32)
    ranks[np.argsort(sums, kind="stable")] = np.arange(1 << RANK_BITS)
    return ranks


#: Entries of one word that a task compares; the classes of a word with more are dealt to several tasks.
WORD_ENTRIES = 100_000
#: Entries that a task compares at once, about; and pairs of them.
BUCKET_ENTRIES, PAIRS_AT_ONCE = 50_000, 1 << 18
_LOW32 = 0xFFFFFFFF


def prefix_lengths(sizes: np.ndarray, threshold: float) -> np.ndarray:
    """How many of a set's rarest words to join on; 0 for sets so small that only an equal one can match."""
    lengths = sizes - np.ceil(threshold * sizes - 1e-9).astype(np.int64) + 1
    return np.where((sizes >= threshold * (sizes + 1) - 1e-9) | (sizes - 1 >= threshold * sizes - 1e-9), lengths, 0)


def _piece_sets(piece: pa.RecordBatch, ranks: np.ndarray, threshold: float) -> list[np.ndarray]:
    """Of each line with words: row, at, hash, parity, check, w1, w2, w3, size and prefix length; then the prefixes one after the other."""
    found = Lines(piece.column(2))
    found.sorted_by(word_keys(found.words, ranks))
    at = found.places.astype(np.int64) << 32 | piece.column(1).to_numpy()[found.rows]
    lengths = prefix_lengths(found.sizes, threshold)
    keys = found.heads(lengths)[2]
    tokens = ((keys ^ keys >> np.uint64(23)) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(32)).astype(np.uint32).view(np.int32)
    return [found.rows, at, *found.identities(), found.checks(), *found.quarters(), found.sizes, lengths, tokens]


def sets_of(part: pa.RecordBatch, ranks: np.ndarray, threshold: float) -> pa.RecordBatch:
    """The rows of ``line_sets`` for a part of the texts, which is taken apart by pieces."""
    made, before = [], 0
    for piece in chunks(part, 2, PIECE_BYTES):
        rows, *rest = _piece_sets(piece, ranks, threshold)
        made.append([rows + before, *rest])
        before += piece.num_rows
    rows, at, hashes, parities, checks, w1, w2, w3, sizes, lengths, tokens = map(np.concatenate, zip(*made, strict=True))
    once = first_of_sets(hashes, parities, order_of(part.column(0))[rows], at)
    tokens, lengths = tokens[np.repeat(once, lengths)], np.where(once, lengths, 0)
    offsets = np.concatenate([[0], np.cumsum(lengths)])
    return pa.RecordBatch.from_arrays([part.column(0).take(pa.array(rows)), *map(pa.array, (at, hashes, parities, checks, w1, w2, w3)), pa.array(sizes, pa.int32()), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(tokens))], ["doc_id", "at", "hash", "parity", "check", "w1", "w2", "w3", "size", "prefix"])


def line_sets(docs: DataFrame, ranks, threshold: float) -> DataFrame:
    """A row for every line with words: doc_id, at, the identity (hash, parity) and size of its set, and its prefix.

    ``at`` is the line's number, then the column ``text_bits``, so that (doc_id, at) orders all lines. ``prefix`` has
    32 bits of the key of each of the rarest words; it is empty where an earlier line of the same part has the set.
    """

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, 2):
                yield sets_of(part, ranks.value, threshold)

    id_type = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text_bits", "text").mapInArrow(make, f"doc_id {id_type}, at long, hash long, parity long, check long, w1 long, w2 long, w3 long, size int, prefix array<int>")


def _spread(tokens: np.ndarray, hashes: np.ndarray, heavy: tuple[np.ndarray, np.ndarray], n_buckets: int) -> np.ndarray:
    """The bucket of each entry: by its word, and for a word with many entries also by its set."""
    mixed = tokens.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    if len(heavy[0]) and len(tokens):
        at = np.minimum(np.searchsorted(heavy[0], tokens), len(heavy[0]) - 1)
        parts = np.where(heavy[0][at] == tokens, heavy[1][at], 1)
        mixed ^= (hashes.astype(np.int64) % parts).astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
    return ((mixed >> np.uint64(32)) % np.uint64(n_buckets)).astype(np.int32)


def first_entries(sets: DataFrame, heavy, n_buckets: int) -> DataFrame:
    """The prefix entries of all sets as arrays, dealt to buckets of words."""
    id_type = sets.schema["doc_id"].dataType.simpleString()

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, at, hashes, parities, _, w1, w2, w3, sizes, prefix = batch.columns
            tokens, rows = prefix.flatten().to_numpy(), pc.list_parent_indices(prefix).to_numpy()
            places = np.arange(len(rows)) - (prefix.offsets.to_numpy() - prefix.offsets[0].as_py())[rows]
            buckets = _spread(tokens, hashes.to_numpy()[rows], heavy.value, n_buckets)
            order = np.argsort(buckets, kind="stable")
            rows, buckets = rows[order], buckets[order]
            cuts = np.flatnonzero(np.concatenate([[True], buckets[1:] != buckets[:-1]])) if len(rows) else np.zeros(0, np.int64)
            ends, taken = pa.array(np.append(cuts, len(rows)), pa.int32()), pa.array(rows)
            flat = [pa.array(tokens[order]), *[c.take(taken) for c in (hashes, parities, w1, w2, w3, sizes)], pa.array(places[order], pa.int32()), doc.take(taken), at.take(taken)]
            yield pa.RecordBatch.from_arrays([pa.array(buckets[cuts]), *[pa.ListArray.from_arrays(ends, c) for c in flat]], names)

    shape = f"bucket int, token array<int>, hash array<long>, parity array<long>, w1 array<long>, w2 array<long>, w3 array<long>, size array<int>, place array<int>, doc_id array<{id_type}>, at array<long>"
    names = [c.split()[0] for c in shape.split(", ")]
    return sets.where(F.size("prefix") > 0).mapInArrow(deal, shape)


class Entries:
    """The prefix entries of one bucket; looks for the earlier partners of each set."""

    def __init__(self, rows: pa.Table, threshold: float):
        flat = {n: rows.column(n).combine_chunks().flatten() for n in rows.column_names if n != "bucket"}
        doc, at = flat["doc_id"], flat["at"].to_numpy()
        docs = order_of(doc)
        token, hashes, parity = flat["token"].to_numpy().astype(np.int64) & _LOW32, flat["hash"].to_numpy(), flat["parity"].to_numpy()
        rank = _dense(docs, at)
        # copies of a set meet here: the first line stands for all; a set in several parts seeks if any does
        sets = _dense(hashes, parity)
        both = token << 32 | sets
        order = np.lexsort((flat["place"].to_numpy(), rank, both))
        first = np.concatenate([[True], both[order][1:] != both[order][:-1]]) if len(order) else np.zeros(0, bool)
        seek = flat["seek"].to_numpy(zero_copy_only=False)[order] if "seek" in flat else np.ones(len(order), bool)
        seek = np.logical_or.reduceat(seek, np.flatnonzero(first)) if len(order) else seek
        order = order[first]
        size = flat["size"].to_numpy()[order].astype(np.int64)
        kind = np.floor(np.log(size) / np.log(max(1 / threshold, 1.1))).astype(np.int64)  # matching sets differ by one kind at most
        word = np.unique(token[order], return_inverse=True)[1]  # the bucket's words, numbered
        by = np.argsort(self._key(word, kind, rank[order]))
        order, self.kind, self.rank, self.token, self.seek, self.size = order[by], kind[by], rank[order][by], word[by], seek[by], size[by]
        self.place, self.hash, self.parity = flat["place"].to_numpy()[order].astype(np.int64), hashes[order], parity[order]
        self.doc, self.at, self.threshold = doc.take(pa.array(order)), at[order], threshold
        w1, w2, w3 = (flat[n].to_numpy()[order] for n in ("w1", "w2", "w3"))
        self.wide, self.widest = self.size > WIDE, self.size > 2 * WIDE
        odd = w1 ^ w3  # a set that is wide but not widest has its odd half in w1
        self.halves, self.quarters = (self.parity ^ odd, odd), (self.parity ^ w1 ^ w2 ^ w3, w1, w2, w3)
        self.keys = self._key(self.token, self.kind, self.rank)

    @staticmethod
    def _key(token: np.ndarray, kind: np.ndarray, rank: np.ndarray) -> np.ndarray:
        """In one number: 2^26 words, 2^8 kinds and 2^30 lines are far more than a task's memory holds."""
        return token.astype(np.uint64) << np.uint64(38) | (kind + 1).astype(np.uint64) << np.uint64(30) | rank.astype(np.uint64)

    def partners(self, most: int, whole: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Entries b and a, a's line being earlier and passing the filters; the score of each pair; and whether b may have more.

        A pair with a score up to 0 is most likely similar. Unless ``whole``, b stops at one such; else at ``most`` pairs.
        """
        made_b, made_a, made_s, found = [], [], [], np.zeros(len(self.keys), np.int64)
        for step in (0, -1, 1):
            active = np.flatnonzero(self.seek & (found < most))
            kind = self.kind[active] + step
            low = np.searchsorted(self.keys, self._key(self.token[active], kind, np.zeros(len(active), np.int64)))
            high = np.searchsorted(self.keys, self._key(self.token[active], kind, self.rank[active]))
            width = 4
            while (left := (low < high) & (found[active] < most)).any():
                active, low, high = active[left], low[left], high[left]
                stop = np.minimum(low + width, high)
                upto = np.cumsum(stop - low)
                cuts = np.append(np.flatnonzero(np.diff(upto // PAIRS_AT_ONCE, prepend=-1)), len(active))
                for x, y in zip(cuts, cuts[1:], strict=False):
                    n = stop[x:y] - low[x:y]
                    b = np.repeat(active[x:y], n)
                    a = np.arange(len(b)) + np.repeat(low[x:y] - (np.cumsum(n) - n), n)
                    b, a, score = self._pass(b, a)
                    if len(b):
                        starts = np.flatnonzero(np.concatenate([[True], b[1:] != b[:-1]]))
                        runs = np.diff(np.append(starts, len(b)))
                        keep = np.arange(len(b)) - np.repeat(starts, runs) < most - found[b]
                        best = np.minimum.reduceat(score, starts)
                        sure = (best <= 0) & (not whole)
                        keep |= np.repeat(sure, runs) & (score == np.repeat(best, runs))
                        found[b[starts]] = np.where(sure, most, np.minimum(found[b[starts]] + runs, most))
                        made_b.append(b[keep]), made_a.append(a[keep]), made_s.append(score[keep])
                low, width = stop, 4 * width
        none = np.zeros(0, np.int64)
        return np.concatenate([none, *made_b]), np.concatenate([none, *made_a]), np.concatenate([none, *made_s]), found >= most

    def _pass(self, b: np.ndarray, a: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The pairs that pass the length, positional and parity filters, and their scores."""
        size_b, size_a = self.size[b], self.size[a]
        sizes = size_b + size_a
        need = np.ceil(self.threshold / (1 + self.threshold) * sizes - 1e-9).astype(np.int64)
        ok = np.minimum(size_b - self.place[b], size_a - self.place[a]) >= need
        ok &= np.minimum(size_b, size_a) >= self.threshold * np.maximum(size_b, size_a) - 1e-9
        b, a, most = b[ok], a[ok], (sizes - 2 * need)[ok]  # words that the sets may differ in
        differ = self._differ((self.parity,), b, a)
        for parts, has in ((self.halves, self.wide), (self.quarters, self.widest)):
            both = np.flatnonzero((differ <= most) & has[b] & has[a])
            differ[both] = self._differ(parts, b[both], a[both])
        ok = (differ <= most) & ((self.hash[b] != self.hash[a]) | (differ > 0))
        return b[ok], a[ok], (10 * differ - 6 * most + 5)[ok]


    @staticmethod
    def _differ(parts: tuple[np.ndarray, ...], b: np.ndarray, a: np.ndarray) -> np.ndarray:
        # of signed numbers bitwise_count takes the absolute value
        return sum((np.bitwise_count((x[b] ^ x[a]).view(np.uint64)).astype(np.int64) for x in parts), np.zeros(len(b), np.int64))


def order_of(ids: pa.Array) -> np.ndarray:
    """Dense ranks of ids, null first."""
    return pc.rank(ids, sort_keys="ascending", null_placement="at_start", tiebreaker="dense").to_numpy().astype(np.int64)


def _dense(major: np.ndarray, minor: np.ndarray) -> np.ndarray:
    """Dense ranks of (major, minor)."""
    order = np.lexsort((minor, major))
    major, minor = major[order], minor[order]
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(np.concatenate([[False], (major[1:] != major[:-1]) | (minor[1:] != minor[:-1])])) if len(order) else 0
    return out


def earlier_partners(entries: DataFrame, threshold: float, most: int, whole: bool) -> DataFrame:
    """Per set (hash, parity): doc_id and at of its first line, ``partners`` (score, doc_a, at_a), the best first, and ``more``.

    entries: bucket and arrays. ``more`` tells that there may be other partners than those listed.
    """
    id_type = entries.schema["doc_id"].dataType.elementType.simpleString()
    shape = f"hash long, parity long, doc_id {id_type}, at long, doc_a {id_type}, at_a long, score int, more boolean"
    names = [c.split()[0] for c in shape.split(", ")]

    def look(rows: pa.Table) -> pa.RecordBatch:
        e = Entries(rows, threshold)
        b, a, score, more = e.partners(most, whole)
        # a set has several words here: each pair once, and a set with a sure partner keeps the best alone
        sets = _dense(e.hash[b], e.parity[b])
        others = np.zeros(len(b), bool)
        others[sets[more[b]]] = True
        order = np.lexsort((e.rank[a], sets))
        order = order[np.concatenate([[True], (np.diff(sets[order]) != 0) | (np.diff(e.rank[a[order]]) != 0)])] if len(order) else order
        order = order[np.lexsort((score[order], sets[order]))]
        first = np.concatenate([[True], np.diff(sets[order]) != 0]) if len(order) else np.zeros(0, bool)
        best = np.minimum.reduceat(score[order], np.flatnonzero(first)) if len(order) else score
        order = order[first | (best[np.cumsum(first) - 1] > 0) | whole]
        b, a, score, others = b[order], a[order], score[order], others[sets[order]]
        made = [pa.array(e.hash[b]), pa.array(e.parity[b]), e.doc.take(pa.array(b)), pa.array(e.at[b]), e.doc.take(pa.array(a)), pa.array(e.at[a]), pa.array(score, pa.int32()), pa.array(others)]
        return pa.RecordBatch.from_arrays(made, names)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, bucket = [], None
        for batch in batches:
            buckets = batch.column(0).to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(buckets)) + 1).tolist(), len(buckets)]
            for x, y in zip(cuts, cuts[1:], strict=False):
                if y > x:
                    if held and buckets[x] != bucket:
                        yield look(pa.Table.from_batches(held))
                        held = []
                    bucket = buckets[x]
                    held.append(batch.slice(x, y - x))
        if held:
            yield look(pa.Table.from_batches(held))

    found = entries.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(search, shape)
    by_set = found.groupBy("hash", "parity").agg(F.first(F.struct("doc_id", "at")).alias("own"), F.sort_array(F.collect_set(F.struct("score", "doc_a", "at_a"))).alias("partners"), F.max("more").alias("more"))
    listed = F.col("partners") if whole else F.when(F.col("partners")[0]["score"] <= 0, F.slice("partners", 1, 1)).otherwise(F.col("partners"))
    cut = F.lit(False) if whole else F.size("partners") > F.size("listed")
    return cut_lineage(by_set.withColumn("listed", listed).select("hash", "parity", "own.*", F.col("listed").alias("partners"), (F.col("more") | cut).alias("more")))


def heavy_words(sets: DataFrame) -> tuple[int, list[tuple[int, int]]]:
    """How many prefix entries there are; and the words of very many, each with the number of parts it is dealt to.

    Counts cover all entries: first by half a word's key, then exactly where that is over the limit. The limit grows
    with the entries up to what a task holds, so the driver gets a number for every 100,000 entries at most, and of 10^12
    entries half a million words.
    """
    tokens = sets.select(F.explode("prefix").alias("token"))
    coarse = cut_lineage(tokens.groupBy(F.shiftright("token", 16).alias("half")).agg(F.count(F.lit(1)).alias("n")))
    total = coarse.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    limit = max(WORD_ENTRIES, min(total // 20_000, 20 * WORD_ENTRIES))
    halves = [r["half"] for r in coarse.where(F.col("n") > limit).select("half").collect()]  # 65,536 rows at most
    if not halves:
        return total, []
    counts = tokens.join(F.broadcast(coarse.where(F.col("n") > limit).select("half")), F.shiftright("token", 16) == F.col("half"), "left_semi").groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    return total, sorted((r["token"], -(-r["n"] // limit)) for r in counts.where(F.col("n") > limit).collect())


def line_texts(docs: DataFrame, wanted: DataFrame, repeats: bool) -> DataFrame:
    """(key, line): the texts of the lines whose keys, structs of doc_id and at, ``wanted`` lists, once each.

    ``repeats`` if rows of ``docs`` may be equal.
    """
    bits = F.col("key.at").bitwiseAND(F.lit(_LOW32)).alias("bits")
    lines = wanted.groupBy(F.col("key.doc_id").alias("doc"), bits).agg(F.collect_set("key.at").alias("ats"))
    held = docs.join(bounded_broadcast(lines), F.col("doc_id").eqNullSafe(F.col("doc")) & (F.col("text_bits") == F.col("bits")))
    held = held.select("doc_id", F.split("text", "\n").alias("lines"), "ats")
    picked = F.transform("ats", lambda at: F.struct(F.struct(F.col("doc_id"), at.alias("at")).alias("key"), F.get("lines", F.shiftright(at, 32).cast("int")).alias("line")))
    texts = held.select(F.explode(picked).alias("x")).select("x.*")
    return texts.groupBy("key").agg(F.first("line").alias("line")) if repeats else texts


def verified(docs: DataFrame, pairs: DataFrame, threshold: float, repeats: bool) -> DataFrame:
    """``pairs`` (hash, parity, more, doc_id, at, doc_a, at_a) with the flag ``holds``: whether the words of both lines are similar enough.

    A line may be the partner of many others, so it goes out in as many copies as it takes.
    """
    pairs = pairs.select("hash", "parity", "more", F.struct("doc_id", "at").alias("key"), F.struct(F.col("doc_a").alias("doc_id"), F.col("at_a").alias("at")).alias("key_a"))
    partners = cut_lineage(pairs.groupBy("key_a").agg(F.ceil(F.count(F.lit(1)) / 2000).cast("int").alias("copies")))
    texts = line_texts(docs, pairs.select("key").unionByName(partners.select(F.col("key_a").alias("key"))), repeats)
    firsts = partners.join(texts, F.col("key_a") == F.col("key")).select(F.col("key_a").alias("key_f"), F.col("line").alias("line_a"), F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("copy"))
    many = bounded_broadcast(partners.where("copies > 1").select(F.col("key_a").alias("key_m"), "copies"))
    part = F.pmod(F.xxhash64("key"), F.coalesce("copies", F.lit(1))).cast("int").alias("part")
    parts = pairs.join(many, F.col("key_a") == F.col("key_m"), "left").select(*pairs.columns, part)
    met = parts.join(texts, "key").join(firsts, (F.col("key_a") == F.col("key_f")) & (F.col("part") == F.col("copy")))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # the sets of one pair at a time: those of a whole batch take over ten times its bytes
            holds = [similar_lines(x.as_py(), y.as_py(), threshold) for x, y in zip(batch.column(3), batch.column(4), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(holds, pa.bool_())], ["hash", "parity", "more", "holds"])

    return cut_lineage(met.select("hash", "parity", "more", "line", "line_a").mapInArrow(compare, "hash long, parity long, more boolean, holds boolean"))


class Seekers:
    """Some lines with all their words, which other lines are compared with."""

    def __init__(self, rows: pa.Table, ranks: np.ndarray, threshold: float):
        found = Lines(rows.column("line").combine_chunks())
        found.sorted_by(word_keys(found.words, ranks))
        rows = rows.take(pa.array(found.rows))
        self.lines = rows.column("line").combine_chunks()
        self.doc, self.at = rows.column("doc_id").combine_chunks(), rows.column("at").to_numpy()
        self.hash, self.parity = rows.column("hash").to_numpy(), rows.column("parity").to_numpy()
        self.sizes, self.starts, self.keys, self.threshold = found.sizes, found.starts, found.keys, threshold
        self.wide = wide_parities(found, np.arange(len(found.starts)))
        line, place, keys = found.heads(prefix_lengths(found.sizes, threshold))
        order = np.argsort(keys, kind="stable")
        self.prefix_keys, self.prefix_line, self.prefix_place = keys[order], line[order], place[order]

    def similar(self, k: int, text: pa.Scalar, place: int) -> bool:
        """Whether the words of seeker k and of a line of the text are similar enough."""
        return similar_lines(self.lines[k].as_py(), text.as_py().split("\n")[place], self.threshold)

    def orders(self, docs: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ranks of some doc_ids and of those of the seekers, in one order."""
        order = order_of(pa.concat_arrays([docs, self.doc]))
        return order[: len(docs)], order[len(docs) :]

    def matched_in(self, piece: pa.RecordBatch, own: np.ndarray, theirs: np.ndarray, ranks: np.ndarray) -> pa.RecordBatch:
        """(hash, parity) of the seekers for which a line of the texts is earlier and similar enough. own, theirs: see ``orders``."""
        found = Lines(piece.column(2))
        keys = word_keys(found.words, ranks)
        found.restrict(np.searchsorted(self.prefix_keys, keys) < np.searchsorted(self.prefix_keys, keys, side="right"))
        found.sorted_by(keys)
        at, own = found.places.astype(np.int64) << 32 | piece.column(1).to_numpy()[found.rows], own[found.rows]
        done = self.matched(found, first_of_sets(*found.identities(), own, at), own, theirs, at, piece.column(2))
        return pa.RecordBatch.from_arrays([pa.array(self.hash[done]), pa.array(self.parity[done])], ["hash", "parity"])

    def matched(self, found: Lines, once: np.ndarray, own: np.ndarray, theirs: np.ndarray, at: np.ndarray, texts: pa.Array) -> np.ndarray:
        """The seekers for which one of the lines is earlier and similar enough, by their words; ``once`` tells which lines count."""
        line, place, keys = found.heads(np.where(once, prefix_lengths(found.sizes, self.threshold), 0))
        low, high = np.searchsorted(self.prefix_keys, keys), np.searchsorted(self.prefix_keys, keys, side="right")
        line, place, low, high = (x[low < high] for x in (line, place, low, high))
        done = np.zeros(len(self.hash), bool)
        upto = np.cumsum(high - low)
        cuts = np.append(np.flatnonzero(np.diff(upto // PAIRS_AT_ONCE, prepend=-1)), len(line))
        hashes, parities = found.identities()
        for x, y in zip(cuts, cuts[1:], strict=False):
            n = high[x:y] - low[x:y]
            entry = np.arange(n.sum()) + np.repeat(low[x:y] - (np.cumsum(n) - n), n)
            a, b = np.repeat(line[x:y], n), self.prefix_line[entry]
            sizes = found.sizes[a] + self.sizes[b]
            need = np.ceil(self.threshold / (1 + self.threshold) * sizes - 1e-9).astype(np.int64)
            ok = np.minimum(found.sizes[a] - np.repeat(place[x:y], n), self.sizes[b] - self.prefix_place[entry]) >= need
            ok &= ~done[b] & ((own[a] < theirs[b]) | ((own[a] == theirs[b]) & (at[a] < self.at[b])))
            ok &= np.bitwise_count((parities[a] ^ self.parity[b]).view(np.uint64)) <= sizes - 2 * need
            pairs = np.unique(a[ok] << 32 | b[ok])
            a, b = pairs >> 32, pairs & _LOW32
            ok = (hashes[a] != self.hash[b]) | (parities[a] != self.parity[b])
            a, b = a[ok], b[ok]
            sizes = found.sizes[a] + self.sizes[b]
            need = np.ceil(self.threshold / (1 + self.threshold) * sizes - 1e-9).astype(np.int64)
            ok = np.bitwise_count(wide_parities(found, a) ^ self.wide[b]).sum(axis=1, dtype=np.int64) <= sizes - 2 * need
            for i, j, least in zip(a[ok].tolist(), b[ok].tolist(), need[ok].tolist(), strict=True):
                if not done[j]:
                    mine, other = found.keys[found.starts[i] : found.starts[i] + found.sizes[i]], self.keys[self.starts[j] : self.starts[j] + self.sizes[j]]
                    done[j] = len(np.intersect1d(mine, other, assume_unique=True)) >= least and self.similar(j, texts[int(found.rows[i])], int(found.places[i]))
        return np.flatnonzero(done)


def wide_parities(found: Lines, lines: np.ndarray) -> np.ndarray:
    """Parity signatures of 512 bits of some of the lines, as rows of eight numbers."""
    each, at = np.unique(lines, return_inverse=True)
    sizes = found.sizes[each]
    row = np.repeat(np.arange(len(each)), sizes)
    keys = found.keys[np.arange(len(row)) + np.repeat(found.starts[each] - (np.cumsum(sizes) - sizes), sizes)]
    out = np.zeros(8 * len(each), np.uint64)
    np.bitwise_xor.at(out, 8 * row + (keys >> np.uint64(6) & np.uint64(7)).astype(np.int64), np.uint64(1) << (keys & np.uint64(63)))
    return out.reshape(-1, 8)[at]


#: Bytes of lines that may be compared with all others in one pass over the texts; more of them meet in shuffles.
SEEKER_BYTES = 48 << 20


def compared_with_all(docs: DataFrame, seekers: DataFrame, ranks, threshold: float, repeats: bool) -> DataFrame | None:
    """(hash, parity) of the seekers (key, hash, parity) with an earlier similar line, found in one pass over the texts.

    The words of the seekers are handed to all tasks; None if that is too much.
    """
    lines = cut_lineage(line_texts(docs, seekers.select("key"), repeats).join(seekers, "key").select("key.doc_id", "key.at", "hash", "parity", "line"))
    if lines.agg(F.coalesce(F.sum(F.octet_length("line") + 64), F.lit(0))).first()[0] > SEEKER_BYTES:
        return None
    held = docs.sparkSession.sparkContext.broadcast(Seekers(lines.toArrow(), ranks.value, threshold))

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, theirs = held.value.orders(batch.column(0))
            before = 0
            for piece in chunks(batch, 2, PIECE_BYTES):
                yield held.value.matched_in(piece, own[before : before + piece.num_rows], theirs, ranks.value)
                before += piece.num_rows

    return cut_lineage(docs.select("doc_id", "text_bits", "text").mapInArrow(match, "hash long, parity long").distinct())


def first_of_sets(hashes: np.ndarray, parities: np.ndarray, docs: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Which of some lines are the earliest that have their set. docs: ranks of the lines' doc_ids."""
    sets = _dense(hashes, parities)
    order = np.lexsort((at, docs, sets))
    once = np.zeros(len(sets), bool)
    once[order[np.concatenate([[True], sets[order][1:] != sets[order][:-1]])] if len(order) else order] = True
    return once


def classes_with_earlier_match(docs: DataFrame, sets: DataFrame, ranks, threshold: float, repeats: bool) -> DataFrame:
    """(hash, parity) of every class for which a class of another set with an earlier first line is similar enough."""
    spark = docs.sparkSession
    total, heavy = heavy_words(sets)
    n_buckets = max(8 * shuffle_partitions(spark), total // BUCKET_ENTRIES)
    held = spark.sparkContext.broadcast((np.array([t for t, _ in heavy], np.int32), np.array([g for _, g in heavy], np.int64)))
    pairs = earlier_partners(first_entries(sets, held, n_buckets), threshold, 8, False)
    best = verified(docs, pairs.select("*", F.col("partners")[0].alias("a")).select("hash", "parity", "doc_id", "at", "more", "a.doc_a", "a.at_a"), threshold, repeats)
    matched = best.where("holds").select("hash", "parity")
    # a set whose best partner fails may have another
    failed = best.where("not holds").select("hash", "parity").join(pairs.where("more or size(partners) > 1"), ["hash", "parity"])
    seekers, most = cut_lineage(failed.select(F.struct("doc_id", "at").alias("key"), "hash", "parity")), 128
    found = None if heavy else compared_with_all(docs, seekers, ranks, threshold, repeats)
    if found is not None:
        return cut_lineage(matched.unionByName(found).distinct())
    seekers = seekers.drop("key")
    # also those that met only a part of a word's classes
    if heavy:
        words = spark.createDataFrame([t for t, _ in heavy], "int").withColumnRenamed("value", "token")
        wide = sets.where(F.size("prefix") > 0).select("hash", "parity", F.explode("prefix").alias("token")).join(F.broadcast(words), "token", "left_semi").select("hash", "parity").distinct()
        seekers = seekers.unionByName(wide.join(matched, ["hash", "parity"], "left_anti")).distinct()
    seekers = cut_lineage(seekers)
    while not seekers.isEmpty():
        pairs = earlier_partners(_entries_of(sets, seekers, held, n_buckets), threshold, most, True)
        done = verified(docs, pairs.select("hash", "parity", "doc_id", "at", "more", F.inline("partners")), threshold, repeats)
        state = cut_lineage(done.groupBy("hash", "parity").agg(F.max("holds").alias("holds"), F.max("more").alias("more")))
        matched = matched.unionByName(state.where("holds").select("hash", "parity"))
        seekers, most = state.where("not holds and more").select("hash", "parity"), 16 * most
    return cut_lineage(matched.distinct())


def _entries_of(sets: DataFrame, seekers: DataFrame, heavy, n_buckets: int) -> DataFrame:
    """The entries of all words of the seekers, those of the seekers marked and sent to every part of their words."""
    flat = sets.select("doc_id", "at", "hash", "parity", "w1", "w2", "w3", "size", F.posexplode("prefix").alias("place", "token"))
    seekers = bounded_broadcast(seekers)
    own = cut_lineage(flat.join(seekers, ["hash", "parity"], "left_semi"))
    words = bounded_broadcast(own.select("token").distinct())
    every = flat.join(words, "token", "left_semi").withColumn("seek", F.lit(False)).unionByName(own.withColumn("seek", F.lit(True)))
    id_type = sets.schema["doc_id"].dataType.simpleString()
    names = ["bucket", "token", "hash", "parity", "w1", "w2", "w3", "size", "place", "doc_id", "at", "seek"]

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, parts = heavy.value
        for batch in batches:
            columns = {n: batch.column(n) for n in names[1:]}
            token, hashes, seek = columns["token"].to_numpy(), columns["hash"].to_numpy(), columns["seek"].to_numpy(zero_copy_only=False)
            at = np.minimum(np.searchsorted(known, token), len(known) - 1) if len(known) else np.zeros(len(token), np.int64)
            times = np.where(seek & (known[at] == token), parts[at], 1) if len(known) else np.ones(len(token), np.int64)
            rows = np.repeat(np.arange(len(token)), times)
            part = np.arange(len(rows)) - np.repeat(np.cumsum(times) - times, times)
            spread = np.where(times[rows] > 1, part, hashes[rows])
            buckets = _spread(token[rows], spread, heavy.value, n_buckets)
            yield pa.RecordBatch.from_arrays([pa.array(buckets), *[columns[n].take(pa.array(rows)) for n in names[1:]]], names)

    shape = f"bucket int, token int, hash long, parity long, w1 long, w2 long, w3 long, size int, place int, doc_id {id_type}, at long, seek boolean"
    dealt = every.select(*names[1:]).mapInArrow(deal, shape)
    packed = dealt.groupBy("bucket").agg(F.collect_list(F.struct(*names[1:])).alias("e"))
    return packed.select("bucket", *[F.col(f"e.{n}").alias(n) for n in names[1:]])


def ids_repeat(docs: DataFrame) -> bool:
    return not docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty()


def text_bits(repeats: bool) -> Column:
    """32 bits of the text's hash, which tell texts of one doc_id apart; 0 if no doc_id repeats, which packs better."""
    return F.xxhash64("text").bitwiseAND(F.lit(_LOW32)) if repeats else F.lit(0).cast("long")


def later_lines(docs: DataFrame, threshold: float, repeats: bool) -> DataFrame:
    """Per document that loses lines: doc_id, text_bits and ``gone``, the sorted numbers of the lines."""
    docs = docs.select("doc_id", "text", text_bits(repeats).alias("text_bits"))
    ranks = docs.sparkSession.sparkContext.broadcast(rank_words(docs))
    sets = cut_lineage(line_sets(docs, ranks, threshold))
    matched = classes_with_earlier_match(docs, sets, ranks, threshold, repeats)
    lines = sets.select("doc_id", "at", "hash", "parity", "check")
    repeated = lines.groupBy("hash", "parity").agg(F.min(F.struct("doc_id", "at", "check")).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    # all lines of a matched class go, and those after the first of any other; a line whose check isn't the first one's has another set
    known = repeated.join(matched.withColumn("whole", F.lit(True)), ["hash", "parity"], "full").select("hash", "parity", F.coalesce("whole", F.lit(False)).alias("whole"), "first.*", F.coalesce("n", F.lit(1)).alias("n"))
    known = cut_lineage(known.select("hash", "parity", "whole", F.col("doc_id").alias("doc_f"), F.col("at").alias("at_f"), F.col("check").alias("check_f"), "n"))
    if held_bytes(known) <= BROADCAST_BYTES:
        met = lines.join(F.broadcast(known.drop("n")), ["hash", "parity"])
    else:
        large = known.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0] // 1000 + 1
        met = lines.join(F.broadcast(known.where(F.col("n") >= large)), ["hash", "parity"]).unionByName(lines.join(known.where(F.col("n") < large), ["hash", "parity"]))  # of the large ones there are 1,000 at most
    later = (F.col("whole") | (F.struct("doc_id", "at") > F.struct(F.col("doc_f").alias("doc_id"), F.col("at_f").alias("at")))) & F.coalesce(F.col("check") == F.col("check_f"), F.lit(True))
    gone = met.where(later)
    return gone.groupBy("doc_id", F.col("at").bitwiseAND(F.lit(_LOW32)).alias("text_bits")).agg(F.sort_array(F.collect_set(F.shiftright("at", 32).cast("int"))).alias("gone"))


def dedup_lines(docs: DataFrame, threshold: float = 0.8, gone: str = "__gone") -> DataFrame:
    """All rows and columns of ``docs`` with the later lines removed from ``text``, and an array ``gone`` of their numbers.

    Words are ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased; lines are split at \\n. Lines without words stay. A line goes
    if an earlier one matches it, whether or not that one stays itself. Lines come in order of doc_id (null first), line
    number, and for texts that share a doc_id a hash of the text; equal rows share their places, so neither is later than
    the other. A null text stays null; ``gone`` is null where no line goes; other columns are unchanged.
    """
    repeats = ids_repeat(docs)
    lost = later_lines(docs, threshold, repeats)
    doc, bits = f"{free_prefix(docs)}doc_id", f"{free_prefix(docs)}text_bits"
    lost = bounded_broadcast(lost.select(F.col("doc_id").alias(doc), F.col("text_bits").alias(bits), F.col("gone").alias(gone)))
    same = F.col("doc_id").eqNullSafe(column(doc)) & (text_bits(repeats) == column(bits))
    left = docs.join(lost, same, "left")
    kept = F.array_join(F.filter(F.split("text", "\n"), lambda x, i: ~F.array_contains(column(gone), i)), "\n")
    text = F.when(column(gone).isNull(), F.col("text")).otherwise(kept).alias("text")
    return left.select(*[text if c == "text" else column(c) for c in docs.columns], column(gone))


def keep_first_lines(docs: DataFrame, threshold: float = 0.8) -> DataFrame:
    """``docs`` without later lines; rows that lose lines and have no word left go. Columns stay as they are."""
    gone = f"{free_prefix(docs)}gone"
    done = dedup_lines(docs, threshold, gone)
    return done.where(column(gone).isNull() | F.col("text").rlike(r"[^\x20\x09-\x0D]")).select(*columns(docs))
