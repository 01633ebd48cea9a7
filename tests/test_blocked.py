"""Blocked and carried forms against plain loops: bars, CUSUM, recurrences, dominated points, first touches."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quantloom.errors import InvalidParameter
from quantloom.operators import bars as B
from quantloom.operators import codependence as D
from quantloom.operators import overlap as O
from quantloom.operators import recurrence as C
from quantloom.operators import research as R
from quantloom.operators import sampling as P
from quantloom.operators import scans as X
from quantloom.operators import series as W
from quantloom.operators.dominance import dominance_sums, dominated, loose_positions, strict_positions

RULES = [B.BarRule("tick", 7), B.BarRule("tick", 70), B.BarRule("volume", 600.0), B.BarRule("dollar_runs", 0, 9000.0), B.BarRule("time", 40.0), B.BarRule("volume", 60.0), B.BarRule("dollar", 900.0)]
RULES += [B.BarRule(f"{a}_{k}", 0, {"tick": 3.0, "volume": 20.0, "dollar": 250.0}[a], 20.0) for a in ("tick", "volume", "dollar") for k in ("imbalance", "runs")]


def make_ticks(seed, n):
    r = random.Random(seed)
    ts, price, out = 1.7e9, 10.0, []
    for _ in range(n):
        ts += r.choice([0, 0.5, 3, 50])
        price = max(1.0, price + r.choice([-0.25, 0, 0, 0.25, 0.1]))
        out.append((ts, price, float(r.randint(1, 9)) + r.choice([0, 0.1])))
    return out


@pytest.mark.parametrize("rule", RULES, ids=lambda r: r.kind)
def test_many_ticks_are_ticks_in_turn(rule):
    r = random.Random(rule.kind)
    for seed in range(8):
        ticks = make_ticks(seed, 1500)
        one, many, want, made = B.BarState(rule), B.BarState(rule), [], []
        want += [bar for t in ticks if (bar := one.add(*t)) is not None]
        a = 0
        while a < len(ticks):
            c = a + r.choice([1, 2, 30, 900])
            made += many.add_many(*map(np.array, zip(*ticks[a:c], strict=True)))
            many = B.BarState(rule, many.saved())
            a = c
        assert made == want and want
        assert many.saved() == one.saved()


def small_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")


@pytest.mark.parametrize("rule", [B.BarRule("time", 40.0), B.BarRule("volume", 60.0), B.BarRule("tick_imbalance", 0, 3.0)], ids=lambda r: r.kind)
def test_bars_go_on_from_batch_to_batch(spark, rule):
    rows = [(k, i, *t) for k, n in (("hot", 400), (None, 90), ("b", 1)) for i, t in enumerate(make_ticks(n, n))]
    frame = spark.createDataFrame(rows, "key string, i long, s double, price double, volume double").withColumn("ts", F.timestamp_micros((F.col("s") * 1e6).cast("long")))
    want = []
    for k in ("hot", None, "b"):
        state = B.BarState(rule)
        want += [(k, b[0], round(b[1], 6), *b[2:]) for x in rows if x[0] == k and (b := state.add(*x[2:])) is not None]
    small_batches(spark)
    try:
        made = B.scan_bars(frame.repartition(5), ["key"], ["i"], rule).withColumn("ts", F.unix_micros("ts") / 1e6).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted(map(str, map(tuple, made))) == sorted(map(str, want)) and len(want) > 5


def test_cusum_and_vpin_go_on(spark):
    rows = [(k, i, x, float(i % 5 + 1)) for k in ("a", "b") for i, x in enumerate(np.cumsum(np.random.default_rng(len(k)).normal(size=200)).tolist())]
    frame = spark.createDataFrame(rows, "key string, idx long, x double, v double").repartition(3)
    state = P.CusumState(1.5)
    want = [i for k, i, x, _ in rows if k == "a" and state.add(x)]
    whole = sorted(map(tuple, X.vpin(frame, ["key"], "idx", "x", "v", 12.0, 3).collect()))
    small_batches(spark)
    try:
        made = sorted(map(tuple, P.cusum_filter(frame, ["key"], "idx", "x", 1.5).collect()))
        parts = sorted(map(tuple, X.vpin(frame, ["key"], "idx", "x", "v", 12.0, 3).collect()))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert made == [(k, i) for k in ("a", "b") for i in want] and want
    assert whole == parts and whole


@pytest.mark.parametrize("ratio", [0.0, 0.5, -0.3, 0.99, 1e-9, 0.9999])
def test_affine_scan(spark, ratio):
    rows = [(k, i, x) for k, n in (("a", 333), ("b", 1), (None, 20)) for i, x in enumerate(np.random.default_rng(n).normal(size=n).tolist())]
    made = {(r["key"], r["i"]): r["__y"] for r in C.affine_scan(spark.createDataFrame(rows, "key string, i long, u double").where("key is not null"), ["key"], "i", "u", ratio, block=6).collect()}
    for k in ("a", "b"):
        y = 0.0
        for key, i, u in rows:
            if key == k:
                y = ratio * y + u
                assert math.isclose(made[k, i], y, rel_tol=1e-11, abs_tol=1e-11)
    with pytest.raises(InvalidParameter):
        C.affine_scan(spark.createDataFrame(rows, "key string, i long, u double"), ["key"], "i", "u", 1.0)


@pytest.mark.parametrize("span", [1, 3, 10, 400, 1e6])
def test_ewma_of_a_long_key(spark, span):
    x = np.cumsum(np.random.default_rng(1).normal(size=9000)) + 50
    frame = spark.createDataFrame([(1, i, v) for i, v in enumerate(x.tolist())], "key int, idx long, x double").repartition(4)
    made = [r["ewma"] for r in X.ewma(frame, ["key"], "idx", "x", span).orderBy("idx").collect()]
    a, y, want = 2 / (span + 1), x[0], []
    for i, v in enumerate(x):
        y = v if i == 0 else a * v + (1 - a) * y
        want.append(y)
    assert np.allclose(made, want, rtol=1e-11)


def test_dominated_points():
    r = np.random.default_rng(4)
    for n in (0, 1, 2, 50):
        a, b, v = r.integers(0, 9, n), r.permutation(n), r.normal(size=n)
        want = [sum(v[j] for j in range(n) if a[j] < a[i] and b[j] < b[i]) for i in range(n)]
        assert np.allclose(dominated(a, b, [v])[0], want)


PAIRS = {
    "ties": lambda r, n: (r.integers(0, 4, n) / 7, r.integers(0, 3, n) / 3),
    "plain": lambda r, n: (r.normal(size=n), r.normal(size=n)),
    "equal": lambda r, n: (np.ones(n), np.ones(n)),
    "line": lambda r, n: (np.arange(n) / 3, np.arange(n) * 2.0 - 5),
    "near": lambda r, n: (0.1 + r.integers(0, 5, n) * 2.8e-17, r.integers(0, 3, n) * 1.0),
}


def plain_dcor(x, y):
    def centred(v):
        d = np.abs(v[:, None] - v)
        return d - d.mean(0) - d.mean(1)[:, None] + d.mean()

    p, q = centred(x), centred(y)
    cov, scale = (p * q).mean(), (p * p).mean() * (q * q).mean()
    return math.sqrt(max(cov, 0) / math.sqrt(scale)) if scale > 1e-30 else 0.0


def plain_ot(x, y):
    n = len(x)
    u, v = (np.array([(s < t).sum() + ((s == t).sum() + 1) / 2 for t in s]) / n for s in (x, y))
    gap = [((u <= u[i]) & (v <= v[i])).mean() - u[i] * v[i] for i in range(n)]
    return min(math.sqrt(np.mean(np.square(gap)) * 12), 1.0) if n > 1 else 0.0


def plain_tau(x, y, w):
    s = both = tx = ty = 0.0
    for i in range(len(x)):
        for j in range(i):
            dx, dy, ww = x[i] - x[j], y[i] - y[j], w[i] * w[j]
            zx, zy = abs(dx) < 1e-15, abs(dy) < 1e-15
            if not zx and not zy:
                s, both = s + ww * np.sign(dx * dy), both + ww
            elif zx != zy:
                tx, ty = tx + ww * zx, ty + ww * zy
    scale = math.sqrt((both + tx) * (both + ty))
    return s / scale if scale > 1e-15 else 0.0


@pytest.mark.parametrize("strip", [None, 7])
def test_dependence_of_dominated_points(spark, strip):
    data = {}
    for k, make in PAIRS.items():
        for n in (1, 2, 60):
            r = np.random.default_rng(n)
            data[f"{k}{n}"] = (*make(r, n), r.random(n))
    rows = [(k, i, float(a), float(b), float(c)) for k, (x, y, w) in data.items() for i, (a, b, c) in enumerate(zip(x, y, w, strict=True))]
    frame = spark.createDataFrame(rows, "key string, idx long, x double, y double, w double").repartition(4).cache()
    read = lambda made: {r[0]: r[1] for r in made.collect()}
    dcor, ot, tau = (read(f) for f in (D.distance_correlation(frame, "x", "y", ["key"], "idx", strip), D.optimal_transport_dependence(frame, "x", "y", ["key"], "idx", strip), D.weighted_kendall_tau(frame, "x", "y", "w", ["key"], "idx", strip)))
    for k, (x, y, w) in data.items():
        if not k.startswith("near"):
            assert math.isclose(dcor[k], plain_dcor(x, y), abs_tol=2e-7), k
            assert math.isclose(ot[k], plain_ot(x, y), abs_tol=1e-9), k
        assert math.isclose(tau[k], plain_tau(x, y, w), abs_tol=1e-9), k


@pytest.mark.parametrize("positions", [strict_positions, loose_positions])
def test_dominance_over_strips(spark, positions):
    rows = [(k, i, float(v % 5), float(v % 7)) for k in ("a", "b") for i, v in enumerate(np.random.default_rng(len(k)).integers(0, 99, 80).tolist())]
    frame = spark.createDataFrame(rows, "key string, i long, x double, y double").withColumn("one", F.lit(1.0))
    px, py = positions("x", "y", ["key"], "i")
    made = dominance_sums(frame.withColumns({"px": px, "py": py}), ["key"], "px", "py", ["one", "x"], 9).collect()
    assert len(made) == len(rows)
    for r in made:
        below = [s for s in made if s["key"] == r["key"] and s["px"] < r["px"] and s["py"] < r["py"]]
        assert r["__d0"] == len(below) and math.isclose(r["__d1"], sum(s["x"] for s in below))
        if positions is strict_positions:
            assert len(below) == sum(s["key"] == r["key"] and s["x"] < r["x"] and s["y"] < r["y"] for s in made)


@pytest.mark.parametrize("barrier", [O.TripleBarrier(1.0, 1.5, 3), O.TripleBarrier(2.0, None, 33), O.TripleBarrier(3.0, 2.0, 500), O.TripleBarrier(None, 6.0, 40_000), O.TripleBarrier(None, None, 5)], ids=str)
def test_first_touches(spark, barrier):
    rng = np.random.default_rng(barrier.max_holding)
    prices = {"a": np.exp(np.cumsum(rng.normal(scale=0.01, size=1500))), "b": np.cumsum(rng.normal(size=90)), "c": np.array([2.0]), "d": np.array([1.0, 0.0, 3.0, 3.0])}
    rows = [(k, i, float(p)) for k, x in prices.items() for i, p in enumerate(x)]
    frame = spark.createDataFrame(rows, "key string, idx long, price double").repartition(3)
    vol = lambda k, i: (0.0 if k == "c" else -1.0 if i % 11 == 0 else 0.02 + i % 3 / 50) if k != "d" else None
    entries = spark.createDataFrame([(k, i, vol(k, i)) for k, i, _ in rows], "key string, entry_idx long, vol double")
    want = []
    for k, x in prices.items():
        for i in range(len(x) - 1):
            if x[i] == 0:
                continue
            v = vol(k, i)
            v = v if v is not None and v > 0 else 1e-10
            end = min(i + barrier.max_holding, len(x) - 1)
            for j in range(i + 1, end + 1):
                r = x[j] / x[i] - 1
                kind = "upper" if barrier.upper is not None and r >= barrier.upper * v else "lower" if barrier.lower is not None and r <= -barrier.lower * v else "vertical" if j == end else None
                if kind:
                    want.append((k, i, j, kind, r))
                    break
    made = O.first_touches(entries, frame, ["key"], barrier).collect()
    assert sorted(tuple(r) for r in made) == sorted(want)


def plain_lz(bits):
    s, start, count = "".join("01"[b] for b in bits), 0, 0
    while start < len(s):
        n = 1
        while start + n <= len(s) and s[start : start + n] in s[: start + n - 1]:
            n += 1
        if start + n > len(s):
            break
        count, start = count + 1, start + n
    return count


def test_lempel_ziv_is_the_plain_parse():
    r = random.Random(7)
    for _ in range(300):
        p = r.choice([0.1, 0.5])
        bits = [r.random() < p for _ in range(r.randint(0, 60))] * r.choice([1, 1, 3])
        assert X.lempel_ziv_array(bits) == plain_lz(bits)


def plain_match(s, i, window):
    most = 0
    for j in range(max(0, i - window), i):
        k = 0
        while i + k < len(s) and j + k < i and s[j + k] == s[i + k]:
            k += 1
        most = max(most, k)
    return most + 1


def test_longest_matches_are_those_of_the_loop():
    r = random.Random(8)
    for _ in range(120):
        s = [r.randrange(r.choice([1, 2, 5])) for _ in range(r.randint(1, 50))]
        window = r.randint(1, 60)
        assert X.longest_matches(s, window)[1:].tolist() == [plain_match(s, i, window) for i in range(1, len(s))]


def test_weights_above():
    assert X.frac_weights_above(0.4, 1e-3, 10_000).tolist() == pytest.approx([w for w in X.frac_weights(0.4, 10_000) if abs(w) >= 1e-3])
    assert X.frac_weights_above(2.0, 0.0, 10).tolist() == [1, -2, 1]
    assert len(X.frac_weights_above(0.4, 0.0, 200_000)) == 200_000  # no bound but the rows


@pytest.mark.parametrize("block", [None, 16])
def test_causal_filter(spark, block):
    rows = [(k, i, float(x), f"{k}{i}") for k, n in (("a", 300), ("b", 1), ("c", 17)) for i, x in enumerate(np.random.default_rng(n).normal(size=n))]
    frame = spark.createDataFrame(rows, "key string, idx long, x double, more string").repartition(3)
    for w in (np.array([1.0, -0.4, 0.1]), np.random.default_rng(1).normal(size=45), np.ones(1)):
        made = X.with_causal_filter(frame, "x", W.Ordered(["key"], ["idx"]), w, "y", block).collect()
        assert len(made) == len(rows)
        x = {k: [r[2] for r in rows if r[0] == k] for k in "abc"}
        for r in made:
            want = sum(w[j] * x[r["key"]][r["idx"] - j] for j in range(min(len(w), r["idx"] + 1)))
            assert math.isclose(r["y"], want, abs_tol=1e-12) and r["more"] == f"{r['key']}{r['idx']}"


def test_expanding_difference_of_a_long_series(spark):
    n = 100_000
    frame = spark.range(n).select(F.lit(1).alias("key"), F.col("id").alias("idx"), F.sin(F.col("id") / 50).alias("x"))
    made = X.with_frac_diff_expanding(frame, "x", W.Ordered(["key"], ["idx"]), 0.4, 0.0).where("idx % 9973 = 0 or idx > 99990").collect()
    x, w = np.sin(np.arange(n) / 50), np.array(X.frac_weights(0.4, n))
    assert len(made) == 20
    for r in made:
        i = r["idx"]
        assert math.isclose(r["frac_diff"], float(w[: i + 1] @ x[i::-1]), abs_tol=1e-9)


def test_sequential_draws_follow_uniqueness():
    spans, trials = [(0, 2), (1, 2), (5, 5), (4, 3)], 40_000
    rng, seen = np.random.default_rng(5), {}
    for _ in range(trials):
        d = tuple(R.sequential_draws(spans, 6, 2, rng))
        seen[d] = seen.get(d, 0) + 1

    def uniqueness(chosen):
        cover = np.zeros(6)
        for i in chosen:
            cover[spans[i][0] : spans[i][1] + 1] += 1
        return np.array([(1 / (1 + cover[a : b + 1])).mean() if b >= a else 0.0 for a, b in spans])

    first = uniqueness([]) / uniqueness([]).sum()
    for i in range(4):
        second = uniqueness([i]) / uniqueness([i]).sum()
        for j in range(4):
            p = first[i] * second[j]
            assert abs(seen.get((i, j), 0) / trials - p) < 5 * math.sqrt(p * (1 - p) / trials) + 1e-12
    assert sorted(set(R.sequential_draws([(1, 0), (2, 1)], 3, 50, rng))) == [0, 1]  # no event has a bar
    chosen = R.sequential_draws([(i, min(i + i % 7, 199)) for i in range(200)], 200, 200, rng)
    sums = [np.mean([1 / sum(a <= t <= b for a, b in ((c, min(c + c % 7, 199)) for c in chosen)) for t in range(i, min(i + i % 7, 199) + 1)]) for i in chosen]
    assert math.isclose(R.mean_uniqueness([(i, min(i + i % 7, 199)) for i in range(200)], chosen, 200), np.mean(sums))
