"""Lookups that gather evidence for an item, and statistics over detection series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .selection import medians


def first_value(d: DataFrame, key: Column, value: str, order: str) -> DataFrame:
    """key, value: the first value of each key wins."""
    return d.groupBy(key.alias("key")).agg(F.min_by(value, order).alias(value))


def rows_of_terms(terms: DataFrame, rows: DataFrame, term: str, label: str, ident: str) -> DataFrame:
    """Every term with the sorted ids of all rows of that label, whatever the case; terms without rows have an empty list."""
    r = rows.groupBy(F.lower(label).alias("_k")).agg(F.array_sort(F.collect_list(ident)).alias("ids"))
    d = terms.join(r, F.lower(F.col(term)) == F.col("_k"), "left")
    return d.select(term, F.coalesce("ids", F.array().cast(r.schema["ids"].dataType)).alias("ids"))


def merge_evidence(sources: list[tuple[str, DataFrame]]) -> DataFrame:
    """item, evidence_id, source over several candidate lists (item, rank, evidence_id); the first of repeated ids stays."""
    out = None
    for i, (name, d) in enumerate(sources):
        one = d.select("item", "evidence_id", F.lit(name).alias("source"), (F.lit(i) * 1000 + F.col("rank")).alias("_o"))
        out = one if out is None else out.unionByName(one)
    w = W.partitionBy("item", "evidence_id").orderBy("_o")
    return out.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r", "_o")


def caption_window(items: DataFrame, captions: DataFrame, buffer_s: float = 0.5) -> DataFrame:
    """item_id, start_s, end_s: the first caption of the same video with the same label in either language decides, even if
    it turns out invalid (then nulls); the window is widened and clamped at 0.

    items: item_id, video, en, ar; captions: video, pos, en, ar, start_s, end_s.
    """
    c = captions.select("video", "pos", F.lower("en").alias("_e"), F.col("ar").alias("_a"), "start_s", "end_s")
    one = items.select("item_id", "video", F.lower("en").alias("k")).join(c.withColumn("k", F.col("_e")), ["video", "k"]).select("item_id", "pos", "start_s", "end_s")
    two = items.select("item_id", "video", F.col("ar").alias("k")).join(c.withColumn("k", F.col("_a")), ["video", "k"]).select("item_id", "pos", "start_s", "end_s")
    best = one.unionByName(two).groupBy("item_id").agg(F.min_by(F.struct("start_s", "end_s"), "pos").alias("w"))
    ok = F.col("w.start_s").isNotNull() & F.col("w.end_s").isNotNull() & (F.col("w.end_s") > F.col("w.start_s"))
    return items.select("item_id").join(best, "item_id", "left").select("item_id", F.when(ok, F.greatest(F.lit(0.0), F.col("w.start_s") - buffer_s)).alias("start_s"), F.when(ok, F.col("w.end_s") + buffer_s).alias("end_s"))


def tfidf_cosine(pairs: DataFrame, key: list[str], a: str, b: str) -> DataFrame:
    """Cosine of two texts' tf-idf vectors where the two are the whole corpus: idf = ln(3 / (1 + df)) + 1, df 1 or 2."""
    side = lambda c, n: pairs.select(*key, F.explode(c).alias("w")).groupBy(*key, "w").agg(F.count(F.lit(1)).alias(n))
    d = side(a, "x").join(side(b, "y"), [*key, "w"], "full").na.fill(0, ["x", "y"])
    idf = F.when((F.col("x") > 0) & (F.col("y") > 0), 1.0).otherwise(F.lit(1.4054651081081644))
    d = d.withColumn("p", F.col("x") * idf).withColumn("q", F.col("y") * idf)
    s = d.groupBy(*key).agg(F.sum(F.col("p") * F.col("q")).alias("pq"), F.sum(F.col("p") * F.col("p")).alias("pp"), F.sum(F.col("q") * F.col("q")).alias("qq"))
    return s.select(*key, F.when((F.col("pp") > 0) & (F.col("qq") > 0), F.col("pq") / F.sqrt("pp") / F.sqrt("qq")).otherwise(0.0).alias("cosine"))


def detection(d: DataFrame, key: str) -> DataFrame:
    """key, frames, detected, gaps, longest_gap, jitter (median step between detected neighbours), spikes (> 5 jitters).

    d: key, i, x.
    """
    w = W.partitionBy(key).orderBy("i")
    d = d.withColumn("step", F.abs(F.col("x") - F.lag("x").over(w))).withColumn("run", F.sum(F.col("x").isNotNull().cast("int")).over(w.rowsBetween(W.unboundedPreceding, 0)))
    gaps = d.where("x is null").groupBy(key, "run").agg(F.count(F.lit(1)).alias("g")).groupBy(key).agg(F.count(F.lit(1)).alias("gaps"), F.max("g").alias("longest_gap"))
    j = d.groupBy(key).agg(F.count(F.lit(1)).alias("frames"), F.count("x").alias("detected")).join(medians(d, key, {"jitter": "step"}), key, "left")
    s = d.join(j.select(key, "jitter"), key).where(F.col("step") > 5 * F.col("jitter")).groupBy(key).agg(F.count(F.lit(1)).alias("spikes"))
    return j.join(gaps, key, "left").join(s, key, "left").na.fill(0, ["gaps", "longest_gap", "spikes"])


def reappearances(d: DataFrame, key: str, far: float = 0.15) -> DataFrame:
    """key, returns, far_returns: how often x comes back after a gap, and how often more than `far` from where it was lost."""
    w = W.partitionBy(key).orderBy("i")
    last = F.last("x", ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, -1))
    back = F.col("x").isNotNull() & F.col("_p").isNull() & F.col("_l").isNotNull()
    d = d.withColumn("_p", F.lag("x").over(w)).withColumn("_l", last)
    return d.groupBy(key).agg(F.count_if(back).alias("returns"), F.count_if(back & (F.abs(F.col("x") - F.col("_l")) > far)).alias("far_returns"))


def fingerprint(cells: DataFrame, key: str) -> DataFrame:
    """key, cell, value: mean over frames per cell divided by the key's largest mean. cells: key, v array."""
    m = cells.select(key, F.posexplode("v").alias("cell", "x")).groupBy(key, "cell").agg(F.avg("x").alias("m"))
    return m.select(key, "cell", (F.col("m") / F.max("m").over(W.partitionBy(key))).alias("value"))


def calibration(d: DataFrame, key: str, left: str, right: str) -> DataFrame:
    """key, low, high shared by both sides."""
    return d.groupBy(key).agg(F.least(F.min(left), F.min(right)).alias("low"), F.greatest(F.max(left), F.max(right)).alias("high"))


def handedness(d: DataFrame, key: str, left: str, right: str, most: float = 0.2) -> DataFrame:
    bad = F.avg((F.col(right) >= F.col(left)).cast("double"))
    return d.groupBy(key).agg(bad.alias("violations"), (bad > most).alias("failed"))


def best_frame(d: DataFrame, key: str, score: Column, order: str) -> DataFrame:
    """key, frame of the smallest score, the earlier on ties."""
    return d.groupBy(key).agg(F.min_by(order, F.struct(score.alias("s"), F.col(order).alias("o"))).alias("frame"))
