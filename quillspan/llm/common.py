"""Shared pieces: tables in the cluster's shared folder, and vectorised tokenising of whole texts.

Word rules and hashes work on UTF-8 bytes, so a batch of texts is handled by a fixed number of numpy
passes over one byte array instead of a Python loop over words.
"""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SPACES = b"\t\n\x0b\x0c\r "
_own_dir: str | None = None
_written: dict[str, list[str]] = {}


def prepare(spark: SparkSession) -> None:
    """Batches between Spark and Python by bytes, not rows: texts may be long, and a worker holds a batch several times."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "8m")


#: Bytes of files that a task of the corpus operators should have at least.
TASK_BYTES = 8 << 20


def packed(df: DataFrame) -> DataFrame:
    """A table with tiny partitions read in fewer tasks: each has TASK_BYTES of files or more, or there are three a core.

    A task of these operators starts Python workers and writes a file; larger partitions stay as they are.
    """
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return df.coalesce(max(3 * df.sparkSession.sparkContext.defaultParallelism, -(-size // TASK_BYTES))) if size < TASK_BYTES << 20 else df


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    prepare(spark)
    return packed(spark.read.parquet(f"{sf_dir}/{table}.parquet"))


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir where the session names one; a temporary folder of our own only where it is unset and all runs on one machine."""
    global _own_dir
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("name a folder that all executors share in spark.checkpoint.dir")
    if _own_dir is None:
        _own_dir = tempfile.mkdtemp(prefix="quillspan-")
    return _own_dir


def delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def stored(df: DataFrame, tag: str, owner: str) -> DataFrame:
    """Write df to the shared folder and read it back: the result has no lineage, so a lost executor costs no recomputation."""
    spark = df.sparkSession
    prepare(spark)
    path = f"{shared_dir(spark)}/quillspan/{tag}-{uuid.uuid4().hex[:12]}"
    df.write.option("compression", "zstd").parquet(path)
    _written.setdefault(owner, []).append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = (owner, path)
    return out


def few(df: DataFrame) -> DataFrame:
    """A table of ids, labels or pairs in a sixteenth of the files of a shuffle. Only rows that are done are dealt to the
    tasks that write; what makes them runs in as many tasks as before."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(-(-n // 16))


def drop_stored(df: DataFrame) -> None:
    """Delete the table behind a result of stored(), once nothing needs it any more."""
    owner, path = df.stored_at
    if path in _written.get(owner, []):
        _written[owner].remove(path)
        delete(df.sparkSession, path)


def release(spark: SparkSession, owner: str) -> None:
    """Delete the stored tables of one owner, once what was built on them has been written."""
    prepare(spark)
    for path in _written.pop(owner, []):
        delete(spark, path)


@atexit.register
def _release_all() -> None:
    """What queries have left, at the end of the session."""
    spark = SparkSession.getActiveSession()
    if spark is not None and _written:
        with contextlib.suppress(Exception):  # the session may have ended already
            for owner in list(_written):
                release(spark, owner)


#: Ids that a broadcast may hold; beyond that a bit table of fixed size takes its place.
BROADCAST_IDS = 1 << 18


def without(docs: DataFrame, lost: DataFrame, owner: str, most: int = BROADCAST_IDS) -> DataFrame:
    """The rows of docs whose doc_id (null like any other) is not in the only column of lost.

    Texts stay where they are: up to `most` ids are broadcast; more fill a bit table of fixed size, rows that it clears
    pass, and only the others meet the ids in an exact join.
    """
    from .bits import bit_tables, met

    ids = stored(few(lost.toDF("__lost_id").distinct()), "lost-ids", owner)
    same = F.col("`doc_id`").eqNullSafe(F.col("__lost_id"))
    n = ids.count()
    if n <= most:
        return docs.join(F.broadcast(ids), same, "left_anti")
    (table,) = bit_tables(ids.select(F.xxhash64("__lost_id").alias("k")), lambda pdf: [pdf["k"].to_numpy(np.int64).view(np.uint64)], (1,), n)
    bits = docs.sparkSession.sparkContext.broadcast(table)

    @F.pandas_udf("boolean")
    def may_be_lost(k: pd.Series) -> pd.Series:
        return pd.Series(met(bits.value, k.to_numpy(np.int64).view(np.uint64)))

    marked = docs.withColumn("__may_be_lost", may_be_lost(F.xxhash64(F.col("`doc_id`"))))
    rest = marked.where("__may_be_lost").drop("__may_be_lost").join(ids, same, "left_anti")
    return marked.where("not __may_be_lost").drop("__may_be_lost").unionByName(rest)


def mix64(x: np.ndarray) -> np.ndarray:
    """A fixed bijection of 64-bit integers with well-spread bits (the splitmix64 finaliser)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


#: A random 64-bit value for each byte, and the odd base of the rolling hash.
BYTE_VALUE = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
BASE = np.uint64(0xD1342543DE82EF95)
BASE_INVERSE = np.uint64(pow(0xD1342543DE82EF95, -1, 1 << 64))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
IS_SPACE = np.zeros(256, bool)
IS_SPACE[list(SPACES)] = True
#: `[\x00-\x2F\x3A-\x60\x7B-\x7F]` after lower-casing: everything below 128 but digits and a-z.
IS_BREAK = np.ones(256, bool)
IS_BREAK[128:] = IS_BREAK[48:58] = IS_BREAK[97:123] = False
_power: dict[str, np.ndarray] = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def powers(n: int, which: str = "up") -> np.ndarray:
    """BASE ** i (or its inverse ** i) mod 2**64 for i < n."""
    if len(_power[which]) < n:
        p = np.full(max(n, 1 << 16), BASE if which == "up" else BASE_INVERSE, np.uint64)
        p[0] = 1
        _power[which] = np.cumprod(p, dtype=np.uint64)
    return _power[which][:n]


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """H with H[i] = sum of value(byte j) * BASE**j over j < i; substrings compare by (H[e]-H[s]) * BASE**-s."""
    h = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(BYTE_VALUE[data] * powers(len(data)), dtype=np.uint64, out=h[1:])
    return h


def span_hash(h: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return (h[end] - h[start]) * powers(len(h), "down")[start]


class Words:
    """Words of a batch of texts: hash of each word, and for each text the range [first[i], first[i+1]) of its words."""

    def __init__(self, texts: list[str | None], is_break: np.ndarray = IS_SPACE, lower: bool = True):
        parts = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
        raw = np.frombuffer(b"\n".join(parts) + b"\n", np.uint8)
        self.data = data = _LOWER[raw] if lower else raw
        lengths = np.fromiter((len(p) + 1 for p in parts), np.int64, len(parts))
        begins = np.zeros(len(parts) + 1, np.int64)
        np.cumsum(lengths, out=begins[1:])
        inside = np.zeros(len(data) + 1, np.int8)
        np.logical_not(is_break[data], out=inside[1:].view(bool))
        change = np.diff(inside)
        self.start = np.flatnonzero(change == 1)
        self.end = np.flatnonzero(change == -1)
        self.first = np.searchsorted(self.start, begins)
        h = prefix_hash(data)
        self._h = h
        self.hash = mix64(span_hash(h, self.start, self.end))

    def prefix(self, n: int) -> np.ndarray:
        """Hash of the first n bytes of each word, apart from the hashes of whole words."""
        return mix64(span_hash(self._h, self.start, np.minimum(self.end, self.start + n)) + np.uint64(n))

    def words(self) -> list[str]:
        b = self.data.tobytes()
        return [b[s:e].decode("utf-8", "replace") for s, e in zip(self.start.tolist(), self.end.tolist(), strict=True)]


def batches(frames, column: str = "text", most: int = 1 << 20):
    """Split pandas batches so that each holds about `most` characters at most, or one row."""
    for pdf in frames:
        if not len(pdf):
            continue
        size = pdf[column].str.len().fillna(0).to_numpy().cumsum()
        cut = np.flatnonzero(np.diff((size // most).astype(np.int64))) + 1
        for a, b in zip([0, *cut], [*cut, len(pdf)], strict=True):
            if b > a:
                yield pdf.iloc[a:b]


def table_of(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns; extra columns are never touched, however they are called."""
    return df.select(*[F.col(f"`{n}`") for n in names])
