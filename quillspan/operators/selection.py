"""Exact medians of groups of any size.

Small groups are Spark's median. Of a large one a sketch of fixed size first gives two values around the middle; one pass
counts what lies below, and only the values between the two, some thousandths of the group, are ordered to find the middle
ranks. If the sketch has missed the middle, the bracket is widened, so the result never rests on it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .durable import cut

HOT_ROWS, ACCURACY = 1 << 20, 1000


def medians(d: DataFrame, key: str | None, values: dict[str, str], hot_rows: int | None = None) -> DataFrame:
    """key (if any) and for each name of values the median of that column; null without values. Values are numbers without NaN."""
    most = HOT_ROWS if hot_rows is None else hot_rows
    keyed = d if key is not None else d.withColumn("_all", F.lit(0))
    by = key or "_all"
    rows = keyed.select(by, *{c: None for c in values.values()})
    plain = lambda x: x.groupBy(by).agg(*[F.median(c).alias(n) for n, c in values.items()])
    hot = rows.groupBy(by).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= most).select(by)
    if hot.isEmpty():
        return plain(rows).drop("_all") if key is not None else d.agg(*[F.median(c).alias(n) for n, c in values.items()])
    hot = cut(hot)
    large = rows.join(hot, by, "left_semi")
    out = hot
    for name, column in values.items():
        out = out.join(_middle(large.select(by, F.col(column).cast("double").alias("_v")).where("_v is not null"), by, name), by, "left")
    return plain(rows.join(hot, by, "left_anti")).unionByName(out).drop("_all")


def _middle(d: DataFrame, by: str, name: str, accuracy: int = ACCURACY) -> DataFrame:
    """by, name: the median of _v for each key, in three passes."""
    room = 2.0 / accuracy  # the sketch is off by one in accuracy at most
    while True:
        low, high = max(0.0, 0.5 - room), min(1.0, 0.5 + room)
        sketch = d.groupBy(by).agg(F.count("_v").alias("_n"), F.percentile_approx("_v", [low, high], accuracy).alias("_p"))
        if low == 0.0:
            sketch = d.groupBy(by).agg(F.count("_v").alias("_n"), F.array(F.min("_v"), F.max("_v")).alias("_p"))
        sketch = cut(sketch)
        inside = d.join(sketch, by).withColumn("_below", (F.col("_v") < F.col("_p")[0]).cast("long"))
        counts = cut(inside.where(F.col("_v") <= F.col("_p")[1]).groupBy(by).agg(F.sum("_below").alias("_under"), F.count(F.lit(1)).alias("_upto"), F.first("_n").alias("_n")))
        missed = F.when(F.col("_n") > 0, (F.col("_under") > F.floor((F.col("_n") - 1) / 2)) | (F.col("_upto") <= F.floor(F.col("_n") / 2)))
        if counts.where(missed).isEmpty():
            break
        room *= 8
    between = inside.where((F.col("_v") >= F.col("_p")[0]) & (F.col("_v") <= F.col("_p")[1])).groupBy(by, "_v").agg(F.count(F.lit(1)).alias("_c"))
    upto = F.sum("_c").over(W.partitionBy(by).orderBy("_v")) + F.col("_under")
    ranked = between.join(counts.select(by, "_under", "_n"), by).withColumn("_to", upto).withColumn("_from", F.col("_to") - F.col("_c"))
    at = lambda r: F.max(F.when((F.col("_from") <= r) & (r < F.col("_to")), F.col("_v")))
    one, two = at(F.floor((F.col("_n") - 1) / 2)), at(F.floor(F.col("_n") / 2))
    return ranked.groupBy(by).agg((one * 0.5 + two * 0.5).alias(name))
