"""The pipeline against brute force, stage by stage, on a small table."""

import random
import re

import corpus_pipeline
from test_operators import WORD, counts, hits, prose

from pyspark.sql import functions as F

from quantloom.llm import quality, simhash

SYLLABLES = ("the", "of", "and", "to", "in", "is", "that", "cat", "sat", "mat", "stone", "river", "field", "house", "green", "quiet", "evening", "morning", "walked", "slowly", "toward", "bridge", "under", "old", "tower")


def make_rows():
    r = random.Random(8)
    story = lambda k: "\n".join(prose(1000 * k + j, 30, SYLLABLES) for j in range(5))
    rows = [(k, story(k), "en", r.choice("abc")) for k in range(40)]
    rows += [(100 + k, story(k), "en", "a") for k in range(3)]  # copies
    rows += [(200, story(50) + "\n" + prose(77, 14, SYLLABLES), "en", "b")]  # a benchmark passage
    rows += [(300, "too short", "en", "c"), (301, None, "en", "c"), (302, "a b c " * 60, "en", None)]
    return rows, [(1, prose(77, 14, SYLLABLES))]


def brute(rows, items):
    rows = [x for x in rows if counts(x[1])[0] >= 50 and 100 * counts(x[1])[4] <= 50 * counts(x[1])[0]]
    seen, left = [], []
    for i, text, lang, source in sorted(rows):
        kept = []
        for line in text.split("\n"):
            words = set(line.lower().split())
            if not words or not any(len(words & w) >= 0.8 * len(words | w) - 1e-9 for w in seen):
                kept.append(line)
            if words:
                seen.append(words)
        if WORD.search("\n".join(kept)):
            left.append((i, "\n".join(kept), lang, source))
    out = []
    for x in left:
        mark = simhash.fingerprint(x[1]) & (1 << 64) - 1
        if not any((mark ^ m).bit_count() <= 3 for _, m in out):
            out.append((x, mark))
    return [x for x, _ in out if not hits(x[1], items)[1]]


def test_pipeline(spark, docs, tmp_path, monkeypatch):
    rows, items = make_rows()
    docs(rows).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "line_dedup", "simhash_near_dedup", "benchmark_decontamination", "source_mix"]
    assert quality.QualityRules().min_words == 50
    want = {x[0]: x[1] for x in brute(rows, items)}
    made = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r["doc_id"]: r["text"] for r in made} == want and 200 not in want and want
    sizes = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t)) for i, t in want.items()}
    assert all(r["size"] == sizes[r["doc_id"]] and 0 <= r["taken"] <= 2 * r["size"] for r in made)
    assert sum(r["taken"] for r in made) <= 1.5 * sum(sizes.values())


def test_mix_stage_keeps_clashing_columns(spark, docs):
    frame = docs([(1, "a b c", "en", "s"), (2, None, "en", None)]).withColumns({"size": F.lit("own"), "Target": F.lit(1.5), "__mix": F.lit(7), "_size": F.lit(0)})
    made = corpus_pipeline.source_mix(spark, frame, "")
    assert made.columns == [*frame.columns, "__size", "source_size", "_target", "taken"]
    assert sorted((r["doc_id"], r["size"], r["Target"], r["__mix"], r["__size"], r["taken"]) for r in made.collect()) == [(1, "own", 1.5, 7, 3, 3), (2, "own", 1.5, 7, 0, 0)]


def test_stages_keep_clashing_columns(spark, docs, tmp_path):
    rows, items = make_rows()
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    frame = docs(rows).withColumns({"hash": F.lit(1), "__gone": F.lit(2), "mark": F.lit(3), "row": F.lit(4), "counts": F.lit(5)})
    for _, stage in corpus_pipeline.STAGES[:-1]:
        made = stage(spark, frame, str(tmp_path))
        assert made.columns == frame.columns and 0 < made.count() <= len(rows)
        assert {tuple(r) for r in made.select("hash", "__gone", "mark", "row", "counts").distinct().collect()} == {(1, 2, 3, 4, 5)}
