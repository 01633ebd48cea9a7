"""Packing, periodic runs and the manifest against brute force on small rows with nulls, empty and long texts, ties and repeats."""

import hashlib
import heapq
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quantloom.errors import InvalidParameter
from quantloom.llm import manifest, packing, periodic, queries, tokens

BPE = public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def crc(i) -> int:
    return zlib.crc32(str(i).encode())


# --- 11 ------------------------------------------------------------------------------------------------------------


def plain_difference(sizes, k):
    """Sums of the k windows, with whole tuples of k sums merged at a time."""
    heap = [(-s if k > 1 else 0, i, [s] + [0] * (k - 1)) for i, s in enumerate(sizes)]
    heapq.heapify(heap)
    n = len(sizes)
    while len(heap) > 1:
        (_, _, a), (_, _, b) = heapq.heappop(heap), heapq.heappop(heap)
        sums = sorted((x + y for x, y in zip(a, reversed(b), strict=True)), reverse=True)
        heapq.heappush(heap, (sums[-1] - sums[0], n, sums))
        n += 1
    return heap[0][2]


@pytest.mark.parametrize("k", [1, 2, 3, 7, 40])
def test_difference_is_that_of_whole_tuples(k):
    r = random.Random(k)
    for n in (1, 2, 5, 60):
        sizes = [r.randint(1, 90) for _ in range(n)]
        window, largest = packing.difference(np.array(sizes), k)
        sums = sorted(np.bincount(window, sizes, minlength=k).astype(int).tolist(), reverse=True)
        assert sums == plain_difference(sizes, k) and largest == sums[0]


def test_windows_grow_until_they_fit():
    assert sorted(packing.near_equal_windows(np.array([6, 6, 6, 6, 6]), 10).tolist()) == [0, 1, 2, 3, 4]
    assert len(set(packing.near_equal_windows(np.array([5, 5, 5, 5]), 10).tolist())) == 2


def check_packing(rows, made, capacity=2048):
    """Every id of every document lies in one piece; sequences are gapless and at most ``capacity`` long."""
    library = Tokenizer.from_file(BPE)
    want = Counter()
    ids = {}
    for i, text in rows:
        e = [*library.encode(text or "", add_special_tokens=False).ids, 1]
        ids[i, len(e)] = e
        want[i, len(e)] += len(e)
    got, sequences = Counter(), defaultdict(list)
    for r in made:
        e = ids[r["doc_id"], r["doc_tokens"]]
        piece = e[r["start"] : r["start"] + r["length"]]
        assert len(piece) == r["length"] > 0 and zlib.crc32(np.array(piece, "<u4").tobytes()) == r["ids_crc32"]
        got[r["doc_id"], r["doc_tokens"]] += r["length"]
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    assert got == want
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return sequences


def test_pack(spark, docs):
    r = random.Random(11)
    vocabulary = ["the", "Stone", "übermäßig", "Ərəb", "don't", "we're", "x9", "1,234.5", "<|endoftext|>", "<|startoftext|>", "日本語", "é", "—", "'S", "Ⱥ"]
    text = lambda n: " ".join(r.choice(vocabulary) for _ in range(n))
    rows = [(i, text(r.randint(0, 900))) for i in range(60)] + [(100, None), (101, ""), (102, " \n"), (None, "a b"), (None, "a b"), (103, text(30_000)), (104, "q" * 3000)]
    made = packing.pack(docs(rows).repartition(3).withColumns({"piece": F.lit(1), "block": F.lit(2)}), BPE).collect()
    check_packing(rows, made)
    small = packing.pack(docs(rows), BPE, capacity=64, piece=16, block_pieces=50).collect()
    check_packing(rows, small, 64)
    starts = lambda i: sorted(x["start"] for x in made if x["doc_id"] == i)
    assert starts(103)[:3] == [0, 2048, 4096] and starts(100) == starts(101) == [0]
    assert packing.pack(docs([]), BPE).count() == 0


def test_pack_pads_little(spark):
    rows = [(i, n) for i, n in enumerate(np.random.default_rng(3).lognormal(6.3, 1, 6000).astype(int).tolist())]
    frame = spark.createDataFrame(rows, "doc_id long, n int").select("doc_id", F.repeat(F.lit("stone "), F.col("n")).alias("text"))
    made = packing.pack(frame, BPE).groupBy("sequence_id").agg(F.sum("length").alias("n")).agg(F.sum("n"), F.count("*"), F.max("n")).first()
    assert made[2] <= 2048 and 1 - made[0] / (2048 * made[1]) < 0.01


def test_every_letter_below_u0250_alone():
    library, split = Tokenizer.from_file(BPE), tokens.pre_tokens(BPE)
    for c in map(chr, range(1, 0x250)):
        for text in (c, c + "'s", "caf" + c, c + "9", "§" + c):
            found, special = split.split(text)
            assert sum(split.pieces(found)) + special == len(library.encode(text, add_special_tokens=False)), (text, found)


# --- 12 ------------------------------------------------------------------------------------------------------------


def smallest_period(w):
    return next(p for p in range(1, len(w) + 1) if all(w[i] == w[i - p] for i in range(p, len(w))))


def plain_runs(w, least, repeats=3):
    found = set()
    for p in range(1, len(w) // repeats + 1):
        i = p
        while i < len(w):
            if w[i] != w[i - p]:
                i += 1
                continue
            a = i
            while i < len(w) and w[i] == w[i - p]:
                i += 1
            length = i - a + p
            if length >= max(least, repeats * p) and smallest_period(w[a - p : i]) == p:
                found.add((a - p, length, p))
    return sorted(found, key=lambda r: (r[0], r[2]))


def runs_of(words, rule):
    (_, runs, text), = periodic.runs_of_texts([" ".join(words).encode()], rule)
    return [(r["start"], r["length"], r["period"]) for r in runs], text.decode().split()


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from("ab"), max_size=60), st.integers(2, 8), st.integers(3, 4))
def test_runs_of_two_words(words, least, repeats):
    made, left = runs_of(words, periodic.RunRule(least, repeats))
    assert made == plain_runs(words, least, repeats)
    gone = {i for s, n, p in made for i in range(s + p, s + n)}
    assert left == [w for i, w in enumerate(words) if i not in gone]


@pytest.mark.parametrize("seed", range(30))
def test_planted_runs(seed):
    r = random.Random(seed)
    words = []
    for _ in range(6):
        words += [r.choice("abcdefgh") for _ in range(r.randint(0, 40))]
        block = [r.choice("abc") for _ in range(r.choice([1, 2, 3, 7, 8, 9, 16, 17, 31, 33, 50]))]
        words += (block * 9)[: r.randint(1, 5 * len(block))]
    assert runs_of(words, periodic.RunRule())[0] == plain_runs(words, 24)


def test_long_texts_take_n_log_n():
    words = ["a"] * 300_000
    assert runs_of(words, periodic.RunRule()) == ([(0, 300_000, 1)], ["a"])
    block = [f"w{i}" for i in range(20)]
    often = [x for i in range(5000) for x in (*block, f"own{i}")]
    assert runs_of(often, periodic.RunRule())[0] == []
    with pytest.raises(InvalidParameter):
        periodic.RunRule(24, 2)


def planted(i, text):
    words, h = text.split() if text else [], crc(i)
    n, g = len(words), h // 10
    if h % 10 or not n or i is None:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[k] if k < a else words[a + (k - a) % p] for k in range(n)]


def test_query_of_runs(spark, docs, tmp_path):
    r = random.Random(12)
    text = lambda n: "".join(r.choice(["stone", "river", "Ä", "far,"]) + r.choice([" ", "\n", "\t", "  "]) for _ in range(n))
    rows = [(i, text(r.randint(0, 400))) for i in range(120)] + [(200, None), (201, ""), (202, "x " * 100), (None, "y " * 50), (None, "y " * 50), (203, "  " * 30), (10, " ")]
    docs(rows).withColumn("runs", F.lit(1)).repartition(4).write.parquet(str(tmp_path / "documents.parquet"))
    want = []
    for i, t in rows:
        w = planted(i, t) if t and t.isascii() else (t or "").split(" ") if t == "  " * 30 else planted(i, t)
        w = [x for x in w if x]
        runs = plain_runs(w, 24)
        gone = {k for s, n, p in runs for k in range(s + p, s + n)}
        best = max(runs, key=lambda x: (x[1] / x[2], -x[0], -x[2]), default=(None,) * 3)
        lines = "".join(f"{s},{n},{p}\n" for s, n, p in runs)
        left = " ".join(x for k, x in enumerate(w) if k not in gone)
        want.append((i, len(runs), *best, 1000 * best[1] // best[2] if runs else None, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(left.encode()).hexdigest()))
    made = queries.op12_periodic_runs(spark, str(tmp_path)).select("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256").collect()
    assert sorted(map(str, map(tuple, made))) == sorted(map(str, want))
    assert any(w[1] for w in want) and periodic.find_runs(docs([])).count() == 0


# --- 13 ------------------------------------------------------------------------------------------------------------


def h(*parts) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(v) -> str:
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def tree_proofs(nodes):
    """(root, per node its (level's siblings left, siblings right) up to the root)."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for k in range(len(paths)):
            place, run = at[k] % 16, at[k] // 16
            run_nodes = nodes[16 * run : 16 * run + 16]
            paths[k].append((run_nodes[:place], run_nodes[place + 1 :]))
            at[k] = run
        nodes = [h(*nodes[a : a + 16]) for a in range(0, len(nodes), 16)]
    return nodes[0], paths


def plain_manifest(rows):
    leaf = lambda i, text, lang, source, n: h(field(i), field(source), field(lang), field(n), field(text))
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    groups = defaultdict(list)
    for r in rows:
        changed = leaf(r[0], r[1].translate(lower), *r[2:]) if r[0] is not None and crc(r[0]) % 5 == 0 and r[1] is not None else leaf(*r)
        groups[r[3]].append(((r[0] is not None, r[0] or 0), leaf(*r), changed, r[0]))
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    subroots, paths = {}, {}
    for s in order:
        groups[s].sort()
        subroots[s], paths[s] = tree_proofs([x[1] for x in groups[s]])
    root, above = tree_proofs([subroots[s] for s in order]) if order else (None, [])
    out = []
    for k, s in enumerate(order):
        for (_, own, changed, i), path in zip(groups[s], paths[s], strict=True):
            folded = changed
            for left, right in path + above[k]:
                folded = h(*left, folded, *right)
            out.append((i, own, subroots[s], root, h(*(x for left, right in path + above[k] for x in left + right)), folded, folded == root))
    return out


TABLES = {
    "many": lambda r: [(i, r.choice(["Abc", "abc", "Ünd", None, ""]) , r.choice(["en", None]), r.choice(["a", "a", "a", "a", "b", None, "é"]), r.choice([1, None])) for i in range(700)] + [(None, "A", None, "a", 1)] * 2 + [(5, "A", None, "a", 1)] * 20 + [(9999, "Z" * 2_000_000, "en", "lone", 3)],
    "groups": lambda r: [(i, "Text", "en", f"s{i % 300}", 4) for i in range(900)],
    "one": lambda r: [(7, "Text", "en", "s", 4)],
    "two": lambda r: [(7, "Text", "en", "s", 4), (8, "Text", "en", "t", 4)],
    "run": lambda r: [(i, "Text", "en", None, 4) for i in range(16)],
    "none": lambda r: [],
}


@pytest.mark.parametrize("upper", [40_000, 3])
@pytest.mark.parametrize("name", TABLES)
def test_manifest(spark, name, upper):
    rows = TABLES[name](random.Random(13))
    frame = spark.createDataFrame(rows, SCHEMA).withColumns({"tree": F.lit("x"), "pos": F.lit("y"), "leaf": F.lit(0), "n": F.lit(1)}).repartition(3)
    made = manifest.prove(frame, queries._crc_of_id() % 5 == 0, {"text": queries.ascii_lower(F.col("text"))}, upper_nodes=upper).collect()
    assert sorted(map(str, map(tuple, made))) == sorted(map(str, plain_manifest(rows)))


@pytest.mark.parametrize("name", ["op12_periodic_runs", "op13_merkle_manifest"])
def test_same_as_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    con.sql("create view documents as select * from '/root/testdata/sf0.001/documents.parquet'")
    made = queries.QUERIES[name](spark, "/root/testdata/sf0.001")
    want = con.sql(queries.ORACLES[name])
    assert sorted(want.columns) == sorted(made.columns)
    assert sorted(map(str, map(tuple, made.select(*want.columns).collect()))) == sorted(map(str, want.fetchall()))
