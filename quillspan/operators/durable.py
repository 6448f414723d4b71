"""Tables between the rounds of an iteration, kept where every executor can read them."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of files that a task of a shuffle by spread() gets.
SPREAD_BYTES = 8 << 20


def shared(spark: SparkSession) -> str:
    """spark.checkpoint.dir where the session names one; a temporary folder only where it is unset and all runs on one machine."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("name a folder that all executors share in spark.checkpoint.dir")
    return tempfile.mkdtemp(prefix="quillspan-")


def cut(df: DataFrame) -> DataFrame:
    """df without its lineage, by checkpoint(); partitions and their order stay as they are."""
    spark = df.sparkSession
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(shared(spark))
    return df.checkpoint()


def spread_parts(*tables: DataFrame) -> int:
    """Partitions in which a task gets SPREAD_BYTES of the files behind the tables; 0 if the session's number has no more."""
    size = sum(int(d._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()) for d in tables)
    n = -(-size // SPREAD_BYTES)
    return n if int(tables[0].sparkSession.conf.get("spark.sql.shuffle.partitions")) < n <= 1 << 16 else 0


def spread(df: DataFrame, n: int, *by: str) -> DataFrame:
    """df dealt by columns to n partitions, so that what a task sorts or groups does not grow with the table; for 0 as it is."""
    return df.repartition(n, *[F.col(c) for c in by]) if n else df
