"""Sinks: stage artifacts by run, trace tables as text and JSON, motion as nested frames, and what a job's folder still holds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import readers


def write_stage(d: DataFrame, path: str, run: str, stage: str) -> None:
    """The artifact of one stage of one run; a repeated run replaces its own and leaves the others."""
    out = d.withColumn("run", F.lit(run)).withColumn("stage", F.lit(stage))
    out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run", "stage").json(path)


def read_stage(spark: SparkSession, path: str, run: str, stage: str, schema: str) -> DataFrame:
    return spark.read.schema(f"{schema}, run string, stage string").json(path).where((F.col("run") == run) & (F.col("stage") == stage)).drop("run", "stage")


def write_markdown(d: DataFrame, text: str, path: str) -> None:
    """One text column as text files, one value after the other."""
    d.select(F.col(text).alias("value")).write.mode("overwrite").text(path)


def write_trace(d: DataFrame, key: str, order: str, path: str) -> None:
    """One JSON object per key with its segments in order."""
    rest = [c for c in d.columns if c not in (key, order)]
    segments = F.transform(F.array_sort(F.collect_list(F.struct(order, F.struct(*rest).alias("s")))), lambda x: x["s"])
    d.groupBy(key).agg(segments.alias("segments")).write.mode("overwrite").json(path)


def motion_document(frames: DataFrame, key: str, fps: float, **columns: Column) -> DataFrame:
    """key, fps, n_frames, frames: the frames of a clip in order of i, each a struct of the named columns."""
    one = F.struct("i", F.struct(*[c.alias(n) for n, c in columns.items()]).alias("f"))
    return frames.groupBy(key).agg(F.array_sort(F.collect_list(one)).alias("x")).select(key, F.lit(fps).alias("fps"), F.size("x").alias("n_frames"), F.transform("x", lambda f: f["f"]).alias("frames"))


def write_motion(frames: DataFrame, key: str, fps: float, path: str, **columns: Column) -> None:
    motion_document(frames, key, fps, **columns).write.mode("overwrite").json(path)


def with_assets(rows: DataFrame, files: DataFrame, key: str) -> DataFrame:
    """rows with asset_available: whether a file of that name with any content is there. files: name, size."""
    there = files.where("size > 0").select(F.col("name").alias(key)).distinct().withColumn("_there", F.lit(True))
    return rows.join(there, key, "left").withColumn("asset_available", F.coalesce("_there", F.lit(False))).drop("_there")


def recover_jobs(spark: SparkSession, events: str, outputs: DataFrame, done: str = "DONE") -> DataFrame:
    """job_id, job_status, n_events, has_output of every job that left events or output; one with output and no events is done.

    events: the folder of the event log. outputs: job_id.
    """
    from ..streaming import event_log

    log = spark.read.schema(event_log.EVENTS).json(events) if readers.exists(spark, events) else spark.createDataFrame([], event_log.EVENTS)
    known = event_log.statuses(log, done)
    out = outputs.select("job_id").distinct().withColumn("has_output", F.lit(True))
    d = known.join(out, "job_id", "full")
    return d.select("job_id", F.coalesce("job_status", F.lit("done")).alias("job_status"), F.coalesce("n_events", F.lit(0)).cast("long").alias("n_events"), F.coalesce("has_output", F.lit(False)).alias("has_output"))
