"""Tables that change in one step: kills, retries, two writers, open readers; a crawl that is stopped and goes on."""

import pytest
from pyspark.sql import functions as F

from quillspan.sources import readers, versions


def rows(spark, n, v=1.0, start=0):
    return spark.range(start, n).select(F.col("id").alias("k"), F.lit(v).alias("v"))


def got(spark, path, version=None):
    return {r.k: r.v for r in versions.read(spark, path, version).collect()}


class Killed(BaseException):
    pass


def test_a_job_killed_before_its_step_changes_nothing(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    assert versions.read(spark, path) is None
    assert versions.append(rows(spark, 3), path, "b1")
    commit = versions._commit

    def killed(*a, **k):
        raise Killed

    monkeypatch.setattr(versions, "_commit", killed)
    for write in (lambda: versions.append(rows(spark, 5, start=3), path, "b2"), lambda: versions.merge(rows(spark, 2, 7.0), path, ["k"], "b3")):
        with pytest.raises(Killed):
            write()
    assert got(spark, path) == {0: 1.0, 1: 1.0, 2: 1.0}
    monkeypatch.setattr(versions, "_commit", commit)
    for _ in range(2):  # each batch is retried once more than needed
        versions.append(rows(spark, 5, start=3), path, "b2")
        versions.merge(rows(spark, 2, 7.0), path, ["k"], "b3")
    assert got(spark, path) == {0: 7.0, 1: 7.0, 2: 1.0, 3: 1.0, 4: 1.0}
    assert versions.read(spark, path).count() == 5 and versions.manifest(spark, path)["version"] == 3


def test_readers_keep_their_version_and_writers_meet(spark, tmp_path):
    path = str(tmp_path / "t")
    versions.replace(rows(spark, 4), path)
    open_ = versions.read(spark, path)
    old = versions.manifest(spark, path)
    versions.replace(rows(spark, 2, 5.0), path)
    assert open_.count() == 4 and got(spark, path) == {0: 5.0, 1: 5.0} and len(got(spark, path, 1)) == 4
    with pytest.raises(versions.Conflict):  # a writer that read the first version comes too late
        versions._commit(spark, path, old, old["folders"], None, "parquet")
    assert got(spark, path) == {0: 5.0, 1: 5.0}
    versions.replace(rows(spark, 1, 6.0), path)
    assert versions.vacuum(spark, path, keep=1) == 2 and got(spark, path) == {0: 6.0}


def test_answers_and_streams_count_once(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "answers")
    answer = lambda d: d.withColumn("pred", F.lit("A"))
    append, tries = versions.append, []

    def flaky(*a, **k):
        tries.append(1)
        if len(tries) == 1:
            raise Killed
        return append(*a, **k)

    monkeypatch.setattr(versions, "append", flaky)
    with pytest.raises(Killed):
        readers.append_answers(spark, rows(spark, 6), path, ["k"], answer)
    assert readers.append_answers(spark, rows(spark, 6), path, ["k"], answer) == 6
    assert readers.append_answers(spark, rows(spark, 8), path, ["k"], answer) == 2
    assert sorted(r.k for r in readers.answers(spark, path).collect()) == [*range(8)]
    rows(spark, 12).write.parquet(str(tmp_path / "in"))
    for run in range(2):  # the second run reads all again, from a checkpoint of its own
        q = readers.score_stream(spark.readStream.schema("k long, v double").parquet(str(tmp_path / "in")), str(tmp_path / "scores"), ["k"], answer, str(tmp_path / f"cp{run}"))
        q.awaitTermination()
    assert sorted(r.k for r in readers.answers(spark, str(tmp_path / "scores")).collect()) == [*range(12)]


def listing(offset, limit):
    return [(f"id{(offset + k) % 25}", f"row {offset + k}") for k in range(limit)]


def test_a_crawl_goes_on_where_it_was_stopped(spark, tmp_path):
    spark.dataSource.register(readers.PagedSource)

    def crawl(total):
        d = spark.readStream.format("paged").option("total", total).option("page", 7).option("module", "tests.test_versions").option("function", "listing").load()
        q = d.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).start()
        q.processAllAvailable()
        q.stop()

    for total in ("16", "16", "40"):
        crawl(total)
    d = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(int(r.text.split()[1]) for r in d.collect()) == [*range(40)]
    last = {r.id: r.text for r in readers.last_per_id(d).collect()}
    assert last == {f"id{i % 25}": f"row {i}" for i in range(40)}
