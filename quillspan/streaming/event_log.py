"""The job event log as Structured Streaming: append-only files in, status, counts, sessions and causal smoothing out."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators.series import _alpha
from .ordered import Steps, walk_stream

EVENTS = "job_id string, seq long, stage string, status string, message string, ts timestamp, elapsed_s double"


def append(events: DataFrame, path: str) -> None:
    events.write.mode("append").json(path)


def read_stream(spark: SparkSession, path: str, schema: str = EVENTS) -> DataFrame:
    return spark.readStream.schema(schema).json(path)


def since(events: DataFrame, cursors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(new events, new cursors): what a reader that holds cursors (job_id, seq of the last event it has) has not seen yet.

    Events are taken up to the first that is missing, so that one which arrives late is not passed over.
    """
    known = cursors.select("job_id", F.col("seq").alias("_seen"))
    fresh = events.join(known, "job_id", "left").where(F.col("seq") > F.coalesce("_seen", F.lit(-1))).dropDuplicates(["job_id", "seq"])
    place = F.coalesce("_seen", F.lit(-1)) + F.row_number().over(W.partitionBy("job_id").orderBy("seq"))
    ready = fresh.withColumn("_place", place).where(F.col("seq") == F.col("_place")).drop("_place", "_seen")
    moved = ready.groupBy("job_id").agg(F.max("seq").alias("seq"))
    return ready, moved.unionByName(cursors.select("job_id", "seq").join(moved, "job_id", "left_anti"))


def statuses(stream: DataFrame, done: str = "DONE") -> DataFrame:
    """Current status of every job, for update or complete mode: blocked, error (last stage is not the final one) or done."""
    last = stream.groupBy("job_id").agg(F.max_by(F.struct("stage", "status"), "seq").alias("l"), F.count(F.lit(1)).alias("n_events"))
    return last.select("job_id", "n_events", F.when(F.col("l.status") == "blocked", "blocked").when(F.col("l.stage") != done, "error").otherwise("done").alias("job_status"))


def windowed(stream: DataFrame, size: str = "10 minutes", slide: str | None = None, late: str = "10 minutes", *keys: str) -> DataFrame:
    """Tumbling or sliding counts with a watermark. An extension: the job log itself has no event-time windows."""
    w = F.window("ts", size, slide) if slide else F.window("ts", size)
    return stream.withWatermark("ts", late).groupBy(w.alias("w"), *keys).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys, "n")


def sessions(stream: DataFrame, key: str, gap: str = "30 minutes", late: str = "30 minutes") -> DataFrame:
    """Session windows per key. An extension, like windowed()."""
    w = F.session_window("ts", gap)
    return stream.withWatermark("ts", late).groupBy(w.alias("w"), key).agg(F.count(F.lit(1)).alias("n")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


class Blocked(Exception):
    """A stage that ends its job: nothing after it runs."""


def run_stages(job_id: str, stages: list[tuple[str, Callable[[dict], object]]], clock: Callable[[], float] = time.time) -> Iterator[dict]:
    """Events of a job whose stages run one after the other, pulled by the consumer; stage(results so far) gives its result.

    Every stage gives a started and a done event; one that raises Blocked a blocked event, any other error an error event,
    and both end the job. After the last one comes DONE.
    """
    results: dict[str, object] = {}
    begin, seq = clock(), 0

    def event(stage: str, status: str, message: str = "") -> dict:
        nonlocal seq
        seq += 1
        now = clock()
        return {"job_id": job_id, "seq": seq - 1, "stage": stage, "status": status, "message": message, "ts": datetime.fromtimestamp(now, UTC), "elapsed_s": round(now - begin, 2)}

    for name, stage in stages:
        yield event(name, "started")
        try:
            results[name] = stage(results)
        except Blocked as e:
            yield event(name, "blocked", str(e))
            return
        except Exception as e:
            yield event(name, "error", str(e))
            return
        yield event(name, "done")
    yield event("DONE", "done")


def ema_step(state, x, alpha: float = 0.25):
    """(state, value): exponential average; a null starts it anew."""
    y = x if state is None or x is None else state * (1 - alpha) + x * alpha
    return y, y


def one_euro_step(state, x, fps: float = 25.0, min_cutoff: float = 1.0, beta: float = 0.3, d_cutoff: float = 1.0):
    """(state, value): speed-adaptive low-pass filter with the state (last raw value, filtered value, filtered speed)."""
    if x is None or state is None:
        return (None, None) if x is None else ((x, x, 0.0), x)
    dt = 1.0 / fps
    steady, (last, y, d) = _alpha(d_cutoff, dt), state
    d = steady * ((x - last) / dt) + (1 - steady) * d
    a = _alpha(min_cutoff + beta * abs(d), dt)
    y = a * x + (1 - a) * y
    return (x, y, d), y


def hold_step(state, x, hold: int = 8):
    """(state, value): the last value for up to hold frames without one. What lies after a gap is not known on a stream."""
    if x is not None:
        return (x, 0.0), x
    if state is None or state[1] + 1 > hold:
        return None, None
    return (state[0], state[1] + 1), state[0]


def step_stream(stream: DataFrame, step: Callable = ema_step) -> DataFrame:
    """key, i, y in append mode: a stream of (key, i, x) through ema_step, one_euro_step, hold_step or one like them; frames
    may come in any order."""
    return walk_stream(stream, Steps(step))
