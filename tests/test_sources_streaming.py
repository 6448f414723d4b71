import json
import os

import pytest
from pyspark.sql import functions as F

from quillspan.operators import series
from quillspan.sources import readers, sinks
from quillspan.streaming import event_log


def fetch(offset, limit):
    return [(f"id{(offset + k) % 25}", f"page {offset}") for k in range(limit)]


def test_texts_and_manifest(spark, tmp_path):
    (tmp_path / "a.md").write_text("Hello\nworld")
    (tmp_path / "b.txt").write_text("شمس")
    (tmp_path / "c.html").write_text("no")
    d = readers.read_texts(spark, str(tmp_path))
    assert {(r.source_language, r.source_language_mode, r.source_text) for r in d.collect()} == {("en", "auto-detected", "Hello\nworld"), ("ar", "auto-detected", "شمس")}
    readers.write_manifest(d, str(tmp_path / "out"))
    assert "source_text" not in spark.read.json(str(tmp_path / "out")).columns
    with pytest.raises(ValueError):
        readers.read_texts(spark, str(tmp_path), "fr")


def test_catalog_alias_alphabet(spark, tmp_path):
    (tmp_path / "c.json").write_text(json.dumps([{"id": "a", "word_en": "Sun"}, {"id": "b", "word_en": "Moon", "word_ar": None}]))
    c = readers.read_catalog(spark, str(tmp_path / "c.json"))
    assert [(r.ord, r.id, r.word_ar) for r in c.orderBy("ord").collect()] == [(0, "a", None), (1, "b", None)]
    assert readers.read_catalog(spark, str(tmp_path / "none.json")).count() == 0
    (tmp_path / "al.json").write_text(json.dumps([{"catalog_id": "a", "aliases_en": ["x"], "aliases_ar": ["y"]}, {"catalog_id": "zz", "aliases_en": ["q"]}]))
    assert [r.alias for r in readers.read_aliases(spark, str(tmp_path / "al.json"), c).orderBy("ord").collect()] == ["x", "y"]
    e = spark.createDataFrame([(0, "ا", "n1", "w", "i"), (1, "ا", "n2", "w", "i")], "ord int, letter string, name_ar string, word_en string, catalog_id string")
    assert readers.read_alphabet(e).first().name_ar == "n2"


def test_logs_caches_listings(spark, tmp_path):
    (tmp_path / "l1.log").write_text('x\n=== {"acc": 0.5}')
    (tmp_path / "l2.log").write_text("nothing")
    got = readers.read_log_json(spark, str(tmp_path), "===", "acc double")
    assert sorted((os.path.basename(r.file), r.result and r.result.acc) for r in got.collect()) == [("l1.log", 0.5), ("l2.log", None)]
    todo = spark.createDataFrame([("m", i) for i in range(4)], "model string, idx long")
    answer = lambda d: d.withColumn("pred", F.lit(1))
    path = str(tmp_path / "answers")
    assert readers.append_answers(spark, todo.limit(3), path, ["model", "idx"], answer) == 3
    readers.append_answers(spark, todo, path, ["model", "idx"], answer)
    assert spark.read.json(path).count() == 4
    calls = []
    make = lambda d: calls.append(1) or d.withColumn("e", F.lit(0.0))
    for d in (todo, todo, todo.limit(2)):
        out = readers.cached_if_same(spark, d, "idx", str(tmp_path / "emb"), make).count()
    assert len(calls) == 2 and out == 2
    up = readers.upsert(todo, spark.createDataFrame([("n", 1)], "model string, idx long"), ["idx"])
    assert sorted(tuple(r) for r in up.collect()) == [("m", 0), ("m", 2), ("m", 3), ("n", 1)]
    assert [r.name for r in readers.listing(spark, str(tmp_path / "*.log"), ["l2.log"]).collect()] == ["l2.log"]
    s = readers.summary({"a": todo.limit(1), "b": None})
    assert {(r.artifact, r.available) for r in s.collect()} == {("a", True), ("b", False)}


def test_paged_source(spark):
    spark.dataSource.register(readers.PagedSource)
    d = spark.read.format("paged").option("total", "60").option("page", "20").option("module", "tests.test_sources_streaming").option("function", "fetch").load()
    rows = readers.last_per_id(d).collect()
    assert len(rows) == 25 and {r.id: r.text for r in rows}["id0"] == "page 40" and min(r.ord for r in rows) == (0, 0)


def test_event_log(spark, tmp_path):
    rows = [("j1", 0, "LOAD", "done"), ("j1", 1, "DONE", "done"), ("j2", 0, "LOAD", "done"), ("j3", 0, "VALIDATE", "blocked")]
    log = spark.createDataFrame([(*r, "", None, 0.0) for r in rows], event_log.EVENTS).withColumn("ts", F.to_timestamp(F.lit("2024-01-01 00:00:00")))
    event_log.append(log, str(tmp_path / "log"))
    stream = event_log.read_stream(spark, str(tmp_path / "log"))
    q = event_log.statuses(stream).writeStream.outputMode("complete").format("memory").queryName("st").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert {r.job_id: r.job_status for r in spark.sql("select * from st").collect()} == {"j1": "done", "j2": "error", "j3": "blocked"}
    for name, d in (("w", event_log.windowed(stream, "10 minutes", None, "0 seconds", "job_id")), ("s", event_log.sessions(stream, "job_id"))):
        q = d.writeStream.outputMode("append" if name == "s" else "update").format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).start()
        q.processAllAvailable()
        q.stop()
    assert spark.sql("select sum(n) n from w").first().n == 4


def walk(step, xs):
    state, out = None, []
    for x in xs:
        state, y = step(state, x)
        out.append(y)
    return out


XS = [1.0, 3.0, None, None, 2.0, 8.0, 8.0, None, 1.0]


def test_steps(spark):
    assert walk(event_log.ema_step, [1.0, 3.0, None, 2.0]) == [1.0, 1.5, None, 2.0]
    assert walk(lambda s, x: event_log.hold_step(s, x, 1), XS) == [1.0, 3.0, 3.0, None, 2.0, 8.0, 8.0, 8.0, 1.0]
    d = spark.createDataFrame([("k", i, x) for i, x in enumerate(XS)], "key string, i long, x double")
    for step, batch in ((event_log.ema_step, series.ema), (event_log.one_euro_step, series.one_euro)):
        assert walk(step, XS) == [r.y for r in batch(d).orderBy("i").collect()]


@pytest.mark.parametrize("step", [event_log.ema_step, event_log.one_euro_step, event_log.hold_step])
def test_step_stream(spark, tmp_path, step):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    name = f"steps_{step.__name__}"
    os.makedirs(tmp_path / "in")
    stream = spark.readStream.schema("key string, i long, x double").json(str(tmp_path / "in"))
    q = event_log.step_stream(stream, step).writeStream.outputMode("append").format("memory").queryName(name).option("checkpointLocation", str(tmp_path / "cp")).start()
    for at, part in ((0, XS[:4]), (4, XS[4:])):  # the state goes on from one batch to the next
        rows = [(k, at + j, x if x is None else x * f) for j, x in enumerate(part) for k, f in (("a", 1.0), ("b", 2.0))]
        spark.createDataFrame(rows, "key string, i long, x double").coalesce(1).write.mode("append").json(str(tmp_path / "in"))
        q.processAllAvailable()
    q.stop()
    got = {(r.key, r.i): r.y for r in spark.sql(f"select * from {name}").collect()}
    for k, f in (("a", 1.0), ("b", 2.0)):
        want = walk(step, [None if x is None else x * f for x in XS])
        assert [got[k, i] for i in range(len(XS))] == want


def test_run_stages_stops_at_a_block():
    def block(results):
        raise event_log.Blocked(f"after {results['LOAD']}")

    stages = [("LOAD", lambda r: 7), ("VALIDATE", block), ("RENDER", lambda r: 1 / 0)]
    got = [(e["stage"], e["status"], e["message"]) for e in event_log.run_stages("j", stages, lambda: 0.0)]
    assert got == [("LOAD", "started", ""), ("LOAD", "done", ""), ("VALIDATE", "started", ""), ("VALIDATE", "blocked", "after 7")]
    assert [e["status"] for e in event_log.run_stages("j", stages[2:])] == ["started", "error"]
    assert [e["stage"] for e in event_log.run_stages("j", stages[:1])] == ["LOAD", "LOAD", "DONE"]


def test_sinks_and_recovery(spark, tmp_path):
    d = spark.createDataFrame([("u1", 1), ("u2", 2)], "unit string, n int")
    for run in ("r1", "r2", "r1"):
        sinks.write_stage(d, str(tmp_path / "stages"), run, "plan")
    sinks.write_stage(d.limit(1), str(tmp_path / "stages"), "r1", "check")
    assert spark.read.json(str(tmp_path / "stages")).count() == 5
    assert sinks.read_stage(spark, str(tmp_path / "stages"), "r2", "plan", "unit string, n int").count() == 2
    sinks.write_markdown(spark.createDataFrame([("# a\nb",)], "m string"), "m", str(tmp_path / "md"))
    assert spark.read.text(str(tmp_path / "md"), wholetext=True).first().value == "# a\nb\n"
    sinks.write_trace(spark.createDataFrame([("s", 1, "b"), ("s", 0, "a")], "source string, pos int, term string"), "source", "pos", str(tmp_path / "trace"))
    assert [x.term for x in spark.read.json(str(tmp_path / "trace")).first().segments] == ["a", "b"]
    frames = spark.createDataFrame([("c", 1, 0.5), ("c", 0, 0.25)], "clip string, i int, x double")
    sinks.write_motion(frames, "clip", 25.0, str(tmp_path / "motion"), wrist=F.struct("x"))
    got = spark.read.json(str(tmp_path / "motion")).first()
    assert (got.fps, got.n_frames, [f.wrist.x for f in got.frames]) == (25.0, 2, [0.25, 0.5])
    files = spark.createDataFrame([("a.mp4", 3), ("b.mp4", 0)], "name string, size long")
    rows = spark.createDataFrame([("a.mp4",), ("b.mp4",), ("c.mp4",)], "clip string")
    assert {r.clip: r.asset_available for r in sinks.with_assets(rows, files, "clip").collect()} == {"a.mp4": True, "b.mp4": False, "c.mp4": False}
    log = spark.createDataFrame([("j1", 0, "DONE", "done", "", None, 0.0), ("j2", 0, "LOAD", "done", "", None, 0.0)], event_log.EVENTS)
    event_log.append(log, str(tmp_path / "log"))
    out = sinks.recover_jobs(spark, str(tmp_path / "log"), spark.createDataFrame([("j1",), ("j3",)], "job_id string"))
    assert {(r.job_id, r.job_status, r.has_output) for r in out.collect()} == {("j1", "done", True), ("j2", "error", False), ("j3", "done", True)}
    assert sinks.recover_jobs(spark, str(tmp_path / "none"), spark.createDataFrame([], "job_id string")).count() == 0
    corpus = spark.createDataFrame([("v", 2, "b"), ("w", 0, "x"), ("v", 1, "a")], "video_id string, item_index int, text string")
    assert [r.text for r in readers.of_video(corpus, "v").collect()] == ["a", "b"]
