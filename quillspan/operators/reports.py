"""Reports: totals, duplicates, ambiguous and corrupt labels, merges, rollups, lineage, validation, jobs, coverage text."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def duplicates(d: DataFrame, key: Column, member: Column) -> DataFrame:
    """key, n, members (sorted) of every key that occurs more than once."""
    return d.groupBy(key.alias("key")).agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list(member)).alias("members")).where(F.col("key").isNotNull() & (F.col("n") > 1))


def ambiguous(d: DataFrame, key: Column, label: Column) -> DataFrame:
    """Keys that stand for more than one distinct label."""
    return d.groupBy(key.alias("key")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct(label).alias("n_labels")).where(F.col("key").isNotNull() & (F.col("n_labels") > 1))


def label_tokens(c: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.regexp_replace(F.lower(c), r"\b\d+\b", ""), F.lit("([a-z]+)"), F.lit(1)))


def integrity(d: DataFrame, shared: str, label: str, block: int = 2048, few: int = 64) -> DataFrame:
    """shared, status: MISSING, or SUSPECT if two labels under it have no token in common, else VALID.

    Only the distinct token sets of a shared key count. A key of which a token stands in all sets is sound at once, by
    counting. Up to `few` sets of a key are compared as one row; the sets of other keys are dealt in blocks, every two blocks of a key are a task: the sets of one with a token
    are the bits of a number, and a set is disjoint from one of them if the numbers of its tokens together miss a bit.
    """
    t = d.where(F.coalesce(F.col(shared), F.lit("")) != "").select(F.col(shared).alias("k"), F.array_sort(label_tokens(F.col(label))).alias("t")).distinct().where(F.size("t") > 0)
    many = t.groupBy("k").agg(F.count(F.lit(1)).alias("m"))
    sound = t.select("k", F.explode("t").alias("x")).groupBy("k", "x").agg(F.count(F.lit(1)).alias("c")).join(many, "k").where("c = m").select("k").distinct()
    open_ = t.join(many, "k").join(sound, "k", "left_anti").withColumn("n", F.ceil(F.col("m") / block).cast("int"))
    pair = F.exists("ts", lambda x: F.exists(F.col("ts"), lambda y: ~F.arrays_overlap(x, y)))
    small = open_.where(F.col("m") <= few).groupBy("k").agg(F.collect_list("t").alias("ts")).select("k", pair.alias("bad"))
    dealt = open_.where(F.col("m") > few).withColumn("b", F.pmod(F.xxhash64("t"), F.col("n")).cast("int")).withColumn("o", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    pairs = dealt.select("k", "t", "b", F.least("b", "o").alias("i"), F.greatest("b", "o").alias("j"))

    def clash(pdf):
        i, j = pdf["i"].iloc[0], pdf["j"].iloc[0]
        holds: dict[str, int] = {}
        right = pdf["t"][pdf["b"] == j].tolist()
        for n, tokens in enumerate(right):
            for x in tokens:
                holds[x] = holds.get(x, 0) | 1 << n
        full = (1 << len(right)) - 1
        bad = False
        for tokens in pdf["t"][pdf["b"] == i]:
            met = 0
            for x in tokens:
                met |= holds.get(x, 0)
            bad |= met != full
        return pd.DataFrame({"k": [pdf["k"].iloc[0]], "bad": [bad]})

    kind = d.schema[shared].dataType.simpleString()
    bad = pairs.groupBy("k", "i", "j").applyInPandas(clash, f"k {kind}, bad boolean").groupBy("k").agg(F.max("bad").alias("bad")).unionByName(small)
    out = d.select(F.col(shared).alias("k")).distinct().join(bad, "k", "left")
    return out.select(F.col("k").alias("shared"), F.when(F.coalesce("k", F.lit("")) == "", "MISSING").when(F.coalesce("bad", F.lit(False)), "SUSPECT").otherwise("VALID").alias("status"))


def merge_new(old: DataFrame, new: DataFrame, key: list[str], ident: str, order: str) -> DataFrame:
    """old plus those rows of new whose key is in neither old nor an earlier new row; ids go on from the largest."""
    first = new.withColumn("_r", F.row_number().over(W.partitionBy(*key).orderBy(order))).where("_r = 1").drop("_r")
    fresh = first.join(old.select(*key).distinct(), key, "left_anti")
    top = old.agg(F.coalesce(F.max(ident), F.lit(0)).alias("_top"))
    from .series import global_number

    numbered = global_number(fresh.drop(ident), order, name="_n").crossJoin(F.broadcast(top)).withColumn(ident, (F.col("_n") + F.col("_top") + 1).cast(old.schema[ident].dataType)).drop("_n", "_top")
    return old.unionByName(numbered.select(*old.columns))


def locale_join(left: DataFrame, right: DataFrame, key: str, title: str) -> DataFrame:
    """key, bucket: matched, empty_title or missing for left rows; right_only for the others."""
    r = right.select(key, F.col(title).alias("_t"), F.lit(True).alias("_in"))
    l = left.select(key).join(r, key, "left").select(key, F.when(F.col("_in").isNull(), "missing").when(F.coalesce("_t", F.lit("")) == "", "empty_title").otherwise("matched").alias("bucket"))
    only = right.select(key).join(left.select(key), key, "left_anti").select(key, F.lit("right_only").alias("bucket"))
    return l.unionByName(only)


def locale_counts(joined: DataFrame) -> DataFrame:
    """What locale_join() found, in one row: rows of either side and rows of each bucket."""
    of = lambda *names: F.count_if(F.col("bucket").isin(*names))
    return joined.agg(of("matched", "empty_title", "missing").alias("left_rows"), of("matched", "empty_title", "right_only").alias("right_rows"), *[of(n).alias(n) for n in ("matched", "missing", "empty_title", "right_only")])


def comparison(classes: DataFrame, bucket: str, kind: str) -> DataFrame:
    """n per bucket and class, per bucket (class null) and in all (both null): the headline figures of a comparison."""
    return classes.rollup(bucket, kind).agg(F.count(F.lit(1)).alias("n"))


def accuracy(d: DataFrame, model: str, category: str, right: Column, parsed: Column) -> DataFrame:
    """Accuracy and parse rate per model and category and per model (category null)."""
    g = d.rollup(model, category).agg(F.count(F.lit(1)).alias("n"), F.count_if(right).alias("correct"), F.count_if(parsed).alias("parsed"), F.grouping_id().alias("gid")).where("gid < 3")
    pct = lambda c: F.floor(F.col(c) * 100.0 / F.col("n") * 100.0 + 0.5) / 100.0
    return g.select(model, category, "n", "correct", pct("correct").alias("accuracy"), pct("parsed").alias("parse_rate"))


def job_status(events: DataFrame, key: str, seq: str, stage: Column, status: Column, done: str) -> DataFrame:
    last = events.groupBy(key).agg(F.max_by(F.struct(stage.alias("stage"), status.alias("status")), seq).alias("l"))
    return last.select(key, F.when(F.col("l.status") == "blocked", "blocked").when(F.col("l.stage") != done, "error").otherwise("done").alias("job_status"))


def validation(spans: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, n_units, n_failed, n_review, overall: BLOCKED before REVIEW_REQUIRED before PASS_WITH_FALLBACK before PASS.

    spans: doc_id, ok. items: doc_id, status.
    """
    s = spans.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_units"), F.count_if(~F.col("ok")).alias("n_failed"))
    i = items.groupBy("doc_id").agg(F.count_if(F.col("status").isin("UNSUPPORTED", "REVIEW_REQUIRED")).alias("n_review"), F.count_if(F.col("status") == "FINGERSPELL_CANDIDATE").alias("n_fallback"))
    d = s.join(i, "doc_id", "left").na.fill(0, ["n_review", "n_fallback"])
    return d.select("doc_id", "n_units", "n_failed", "n_review", F.when(F.col("n_failed") > 0, "BLOCKED").when(F.col("n_review") > 0, "REVIEW_REQUIRED").when(F.col("n_fallback") > 0, "PASS_WITH_FALLBACK").otherwise("PASS").alias("overall"))


def review_markdown(units: DataFrame, key: str, order: str, line: Column) -> DataFrame:
    """One Markdown text per key, its lines in order."""
    return units.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, line.alias("line")))), lambda x: x["line"]), "\n").alias("markdown"))
