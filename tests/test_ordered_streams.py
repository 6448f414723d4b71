"""Keyed frames in any order on a stream: against the batch operators, with tiny batches, restarts, timers and lost frames."""

import os
import random
import time

import pytest
from pyspark.sql import functions as F

from quillspan.operators import series
from quillspan.streaming import event_log, ordered

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@pytest.fixture
def frames(spark):
    rng = random.Random(11)
    rows = []
    for k in range(6):
        n, on = rng.randint(1, 90), rng.random() < 0.5
        for i in range(n):
            if rng.random() < 0.12:
                on = not on
            rows.append((f"k{k}", i, rng.uniform(-9, 9) if on else None, i == n - 1))
    rng.shuffle(rows)
    return rows


def run(spark, tmp_path, name, make, parts, schema="key string, i long, x double, last boolean"):
    """Each part comes as files of its own in a run of its own, which ends before the next one begins."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4")
    try:
        for part in parts:
            spark.createDataFrame(part, schema).repartition(2).write.mode("append").json(str(tmp_path / "in"))
            stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
            q = make(stream).writeStream.outputMode("append").format("parquet").option("path", str(tmp_path / name)).option("checkpointLocation", str(tmp_path / f"{name}-cp")).trigger(availableNow=True).start()
            q.awaitTermination()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    return sorted(map(tuple, spark.read.parquet(str(tmp_path / name)).collect()))


def test_gap_bridge_equals_the_batch_operator(spark, tmp_path, frames):
    third = len(frames) // 3
    got = run(spark, tmp_path, "out", ordered.gap_bridge_stream, [frames[:third], frames[third : 2 * third], frames[2 * third :]])
    want = series.gap_bridge(spark.createDataFrame(frames, "key string, i long, x double, last boolean"))
    assert got == sorted(map(tuple, want.collect()))


def test_steps_take_frames_in_any_order(spark, tmp_path, frames):
    late = sorted(frames, key=lambda r: -r[1])  # the end of every key comes first
    got = run(spark, tmp_path, "out", lambda s: event_log.step_stream(s.drop("last")), [late[: len(late) // 2], late[len(late) // 2 :]])
    want = series.ema(spark.createDataFrame(frames, "key string, i long, x double, last boolean"))
    assert got == sorted(map(tuple, want.collect()))


def test_silent_keys_are_closed_by_event_time(spark, tmp_path):
    schema = "key string, i long, x double, ts timestamp"
    at = lambda s: F.timestamp_seconds(F.lit(1_700_000_000) + s)
    rows = spark.createDataFrame([("a", 0, 1.0, 0), ("a", 1, None, 1), ("a", 3, 5.0, 2), ("b", 0, None, 100)], "key string, i long, x double, s long").withColumn("ts", at(F.col("s"))).drop("s").collect()
    make = lambda s: ordered.gap_bridge_stream(s, patience="30 seconds")
    first = [tuple(r) for r in rows if r.key == "a"]
    got = run(spark, tmp_path, "out", make, [first, [tuple(r) for r in rows if r.key == "b"]], schema)
    # frame 2 never came: 1 still glides between 0 and 3, and 2 gives no row
    assert [r for r in got if r[0] == "a"] == [("a", 0, 1.0, 1.0), ("a", 1, 1.0 + ((1.0 * (1 - 1 / 3) + 5.0 * (1 / 3)) - 1.0), 1.0), ("a", 3, 5.0, 1.0)]


def test_walks_hold_few_frames():
    bridge, state = ordered.GapBridge(8), None
    for i in range(1000):
        state, _ = bridge.push(state, i, None)
        assert len(state[1]) <= 8
    state, rows = bridge.push(state, 1000, 2.0)
    assert [r[0] for r in rows] == [*range(992, 1001)] and rows[0] == (992, 2.0, 0.0)
    for i in range(1001, 1100):
        state, _ = bridge.push(state, i, None)
        assert len(state[1]) <= 8
    w = ordered.Walk(bridge)
    w.add(2, 1.0, True)
    w.add(2, 9.0, False)
    assert w.go() == [] and not w.over
    w.add(0, None, False)
    assert w.go() == [] and ordered.Walk(bridge, w.kept()).early == {2: 1.0}
    w.add(1, None, False)
    assert [r[0] for r in w.go()] == [0, 1, 2] and w.over


def test_scratch_is_named_by_the_session(spark):
    from quillspan.operators import durable

    assert os.path.isdir(durable.shared(spark))


def test_hands_are_carried_like_the_batch_operator(spark):
    from quillspan.operators import landmarks

    rng = random.Random(4)
    hands = [None if rng.random() < 0.45 else [rng.uniform(-5, 5) for _ in range(6)] for _ in range(200)]
    hands[:12], hands[-14:] = [None] * 12, [None] * 14
    order = list(range(200))
    rng.shuffle(order)
    walk, rows = ordered.Walk(ordered.HandBridge()), []
    for k in order:
        walk.add(k, hands[k], k == 199)
        rows += walk.go()
        walk = ordered.Walk(walk.walker, walk.kept())  # as if every frame were a batch of its own
    assert walk.over
    rows += walk.walker.close(walk.state)
    point = lambda h: None if h is None else [(h[0], h[1]), (h[2], h[3]), (h[4], h[5])]
    d = spark.createDataFrame([("k", i, point(h)) for i, h in enumerate(hands)], "key string, i int, hand array<struct<x:double,y:double>>")
    want = {r.i: (None if r.hand is None else [c for p in r.hand for c in p], r.alpha) for r in landmarks.hand_bridge(d).collect()}
    assert {i: (h, a) for i, h, a in rows} == want and len(rows) == 200


def test_a_reader_of_the_log_misses_nothing_and_sees_nothing_twice(spark):
    schema = "job_id string, seq long, stage string"
    log = [("a", i, "s") for i in range(5)] + [("b", 0, "s"), ("b", 2, "s")]
    ready, cursors = event_log.since(spark.createDataFrame(log + log[:2], schema), spark.createDataFrame([("a", 1), ("z", 9)], "job_id string, seq long"))
    assert sorted((r.job_id, r.seq) for r in ready.collect()) == [("a", 2), ("a", 3), ("a", 4), ("b", 0)]  # 1 of b is still to come
    assert sorted(map(tuple, cursors.collect())) == [("a", 4), ("b", 0), ("z", 9)]
    late = spark.createDataFrame([*log, ("b", 1, "s")], schema)
    ready, cursors = event_log.since(late, cursors)
    assert sorted((r.job_id, r.seq) for r in ready.collect()) == [("b", 1), ("b", 2)]


def test_keys_without_timers_share_calls(spark, tmp_path, monkeypatch):
    """Keys of a bucket are served by one call, and what waits of each is found again in the next run."""
    calls = tmp_path / "calls"
    calls.mkdir()
    old = ordered.BucketProcessor.handleInputRows

    def counted(self, key, rows, timerValues):
        (calls / f"{key[0]}-{time.time_ns()}").touch()
        yield from old(self, key, rows, timerValues)

    walker = ordered.GapBridge()
    processor = type("Counted", (ordered.BucketProcessor,), {"handleInputRows": counted, "__module__": "__main__"})
    monkeypatch.setattr(ordered, "BucketProcessor", processor)
    monkeypatch.setattr(ordered, "BUCKETS", 2)
    keys, n = 40, 9
    data = [(f"k{k}", i, float(i) if i % 4 else None, i == n - 1) for k in range(keys) for i in range(n)] + [(None, 0, 1.0, True)]
    schema = "key string, i long, x double, last boolean"
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    for part in (1, 0):
        spark.createDataFrame([r for r in data if r[1] % 2 == part], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
        ordered.walk_stream(stream, walker).writeStream.outputMode("append").format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    got = {(r.key, r.i): (r.y, r.alpha) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    state, want = None, {}
    for i in range(n):
        state, rows = walker.push(state, i, float(i) if i % 4 else None)
        want |= {j: (y, a) for j, y, a in rows}
    want |= {j: (y, a) for j, y, a in walker.close(state)}
    assert got == {(f"k{k}", i): want[i] for k in range(keys) for i in range(n)} | {(None, 0): (1.0, 1.0)}
    assert 2 <= len(list(calls.iterdir())) <= 2 * 3
