"""Folds and windows against plain loops on random series with gaps."""

import math
import random

import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillspan.operators import series


@pytest.fixture(scope="module")
def data():
    rng = random.Random(3)
    out = {}
    for k in range(12):
        xs, on = [], rng.random() < 0.5
        for _ in range(rng.randint(1, 60)):
            if rng.random() < 0.2:
                on = not on
            xs.append(rng.uniform(0, 100) if on else None)
        out[k] = xs
    out[90], out[91] = [None] * 5, [1.0]
    return out


@pytest.fixture(scope="module")
def frame(spark, data):
    return spark.createDataFrame([(k, i, x) for k, xs in data.items() for i, x in enumerate(xs)], "key int, i int, x double").cache()


def back(df, col="y"):
    out = {}
    for r in df.orderBy("key", "i").collect():
        out.setdefault(r["key"], []).append(r[col])
    return out


def test_ema(frame, data):
    def loop(xs):
        y, out = None, []
        for x in xs:
            y = None if x is None else x if y is None else y * 0.75 + x * 0.25
            out.append(y)
        return out

    assert back(series.ema(frame)) == {k: loop(xs) for k, xs in data.items()}


def test_one_euro(frame, data):
    def loop(xs, dt=1 / 25):
        alpha = lambda c: 1.0 / (1.0 + (1.0 / (series.TWO_PI * c)) / dt)
        last = s = d = None
        out = []
        for x in xs:
            if x is None:
                last = s = d = None
                out.append(None)
                continue
            v = 0.0 if last is None else (x - last) / dt
            d = v if d is None else alpha(1.0) * v + (1 - alpha(1.0)) * d
            a = alpha(1.0 + 0.3 * abs(d))
            s = x if s is None else a * x + (1 - a) * s
            last = x
            out.append(s)
        return out

    got = back(series.one_euro(frame))
    for k, xs in data.items():
        for a, b in zip(got[k], loop(xs), strict=True):
            assert (a is None) == (b is None) and (a is None or math.isclose(a, b, rel_tol=1e-12))


def test_gaps(frame, data):
    def bridge(xs):
        out, last = [], None
        for i, x in enumerate(xs):
            nxt = next(((j, xs[j]) for j in range(i + 1, len(xs)) if xs[j] is not None), None)
            if x is not None:
                last = (i, x)
                out.append((x, 1.0))
            elif last is None:
                out.append((nxt[1], 1 - (nxt[0] - i) / 8) if nxt and nxt[0] - i <= 8 else (None, 0.0))
            elif i - last[0] > 8:
                out.append((None, 0.0))
            elif nxt:
                t = (i - last[0]) / (nxt[0] - last[0])
                out.append((last[1] + ((last[1] * (1 - t) + nxt[1] * t) - last[1]), 1.0))
            else:
                out.append((last[1], 1 - (i - last[0]) / 8))
        return out

    d = series.gap_bridge(frame).withColumn("p", F.struct("y", "alpha"))
    assert {k: [tuple(p) for p in v] for k, v in back(d, "p").items()} == {k: bridge(xs) for k, xs in data.items()}
    full = back(series.gap_fill(frame))
    assert all(all(y is not None for y in full[k]) for k, xs in data.items() if any(x is not None for x in xs))


def test_denoise(spark):
    n, x = None, 1.0
    s = [n] * 9 + [x] * 3 + [n] * 9 + [x] * 4 + [n] * 8 + [x] + [n] * 2 + [x] * 2
    d = spark.createDataFrame([(0, i, v) for i, v in enumerate(s)], "key int, i int, x double")
    want = [n] * 21 + [x] * 4 + [n] * 8 + [x] + [n] * 2 + [x] * 2
    assert back(series.denoise(d))[0] == want


def test_small_ones(spark):
    d = spark.createDataFrame([(0, i, v) for i, v in enumerate([1.0, None, 3.0, 5.0])], "key int, i int, x double")
    up = [r.y for r in series.upsample(d).orderBy("i", "k").collect()]
    assert up == [1.0, 1.0, None, None, 3.0, 4.0, 5.0]
    assert back(series.hold_last(d, F.col("x") > 4))[0] == [1.0, None, 3.0, 3.0]
    plan = spark.createDataFrame([(0, i, v) for i, v in enumerate(["9.00", "5.00", "3.00", "1.00"])], "key int, i int, dur string").withColumn("dur", F.col("dur").cast("decimal(18,2)"))
    assert [r.included for r in series.duration_plan(plan, "10.00").orderBy("i").collect()] == [True, False, False, True]  # a dropped unit does not end the plan
    assert [r.included for r in series.duration_plan(plan, "2.00").orderBy("i").collect()] == [True, False, False, False]
    gate = spark.createDataFrame([("a", 0, 1.0, 2.0), ("a", 1, 2.0, 3.0), ("b", 0, 5.0, 6.0), ("b", 1, 1.0, 2.0), ("c", 0, 1.0, 2.0), ("c", 1, None, None), ("d", 0, None, None), ("e", 0, 1.0, None)], "key string, pos int, start_s double, end_s double")
    assert {r.key: r.verdict for r in series.interval_gate(gate).collect()} == {"a": "AUTO_ACCEPT", "b": "REJECT", "c": "REVIEW_REQUIRED", "d": "REJECT", "e": "REJECT"}


def test_global_number(spark):
    d = spark.range(0, 1000, 1, 7).select((F.col("id") * 7919 % 1000).alias("v"))
    assert all(r.v == r.number for r in series.global_number(d, "v").collect())


def _one_key(spark, n, gaps=()):
    rng = random.Random(n)
    rows = [("hot", i, None if i in gaps else rng.uniform(-50, 50)) for i in range(n)] + [(f"k{i % 7}", i // 7, float(i % 11)) for i in range(70)]
    return spark.createDataFrame(rows, "key string, i int, x double").repartition(5)


@pytest.mark.parametrize("f", ["ema", "one_euro"])
def test_ranges_of_a_hot_key_give_the_same_values(spark, monkeypatch, f):
    d = _one_key(spark, 6000, gaps={10, 11, 4000})
    want = sorted(map(tuple, getattr(series, f)(d).collect()), key=str)
    monkeypatch.setattr(series, "HOT_ROWS", 500)
    assert sorted(map(tuple, getattr(series, f)(d).collect()), key=str) == want


def test_a_single_key_is_walked_in_all_ranges(spark):
    d = _one_key(spark, 8000).where("key = 'hot'")
    step = lambda y, r: ((y * 0.75 + r["x"] * 0.25,) * 2 if y is not None else (r["x"],) * 2)
    one = lambda y, r: (lambda s: (s[0], (r["i"], s[1])))(step(y, r))
    rounds = []
    got = series.scan_ranges(d, ["key"], ["i"], "i int, y double", lambda: None, one, rounds)
    want = series.scan(d, ["key"], ["i"], "i int, y double", lambda: None, one)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert rounds[0] == 4 and len(rounds) <= 3  # states that forget agree after the first guess
    assert got.groupBy(F.spark_partition_id()).count().count() == 4


def test_ranges_for_plans_matchers_and_jumps(spark, monkeypatch):
    from decimal import Decimal

    rng = random.Random(8)
    units = spark.createDataFrame([("k", i, Decimal(rng.randint(100, 900)) / 100) for i in range(3000)], "key string, i int, dur decimal(18,2)")
    samples = spark.createDataFrame([("k", i, "abcd"[min(3, i // 800)] + "z") for i in range(3000)], "key string, i int, text string")
    labels = spark.createDataFrame([("k", i, c) for i, c in enumerate("abcd")], "key string, pos int, label string")
    jumps = _one_key(spark, 3000)
    make = (lambda: series.duration_plan(units, "60.00"), lambda: series.align_labels(samples, labels), lambda: series.state_changes(jumps))
    want = [sorted(map(str, m().collect())) for m in make]
    monkeypatch.setattr(series, "HOT_ROWS", 300)
    assert [sorted(map(str, m().collect())) for m in make] == want


def test_ranges_whose_states_never_forget(spark):
    d = spark.createDataFrame([("a", i) for i in range(400)] + [("b", i) for i in range(1500)], "key string, i int")
    count = lambda n, r: (n + r["i"] % 3, (r["i"], n + r["i"] % 3))
    got = series.scan_ranges(d, ["key"], ["i"], "i int, n int", lambda: 0, count)
    want = {(k, i): sum(j % 3 for j in range(i + 1)) for k, n in (("a", 400), ("b", 1500)) for i in range(n)}
    assert {(r.key, r.i): r.n for r in got.collect()} == want


def test_labels_meet_samples_however_partitions_are_joined(spark):
    """Small targets for partitions: the labels' and the samples' side of a union are then read in different ones."""
    n, per = 300, 40
    s = spark.range(n * per).selectExpr(f"id % {n} as key", "id as at", "element_at(array('view', 'click', 'none', 'error'), cast(1 + pmod(xxhash64(id), 4) as int)) as text")
    s = s.select("key", (F.row_number().over(W.partitionBy("key").orderBy("at")) - 1).alias("i"), "text")
    l = s.select("key").distinct().crossJoin(F.broadcast(spark.createDataFrame([(0, "view"), (1, "click"), (2, "error")], "pos int, label string")))
    conf = {"spark.sql.shuffle.partitions": "24", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16k", "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false", "spark.sql.adaptive.coalescePartitions.minPartitionSize": "1b"}
    old = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        got = {(r.key, r.i): r.pos for r in series.align_labels(s, l).collect()}
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    want, at = {}, {}
    for r in sorted(s.collect(), key=lambda r: (r.key, r.i)):
        cur = at.setdefault(r.key, 0)
        hit = next((p for p, t in enumerate(["view", "click", "error"]) if p >= cur and t in r.text), None)
        want[r.key, r.i] = hit
        at[r.key] = cur if hit is None else hit
    assert got == want


def test_global_number_beyond_what_is_sampled(spark):
    """Ranges are cut by samples, so the counts and the rows must be of one cut."""
    d = spark.range(0, 60_000, 1, 8).selectExpr("xxhash64(id) as v", "id")
    conf = {"spark.sql.shuffle.partitions": "16", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    old = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        got = series.global_number(d, "v").orderBy("v").select("number").collect()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert [r.number for r in got] == list(range(60_000))
