"""Vectors: cosine, nearest neighbours of a stated query set, similarity pairs, clusters, recall, text likeness."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import metric
from .durable import cut


def cosine(a: Column, b: Column) -> Column:
    """0 when either has no length."""
    d = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    n = F.sqrt(d(a, a)) * F.sqrt(d(b, b))
    return F.when(n == 0, 0.0).otherwise(d(a, b) / n)


def nearest(queries: DataFrame | None, vectors: DataFrame, k: int = 5, least: float = -1.0, max_queries: int = 10_000) -> DataFrame:
    """query_id, rank, vec_id, similarity: the k most similar vectors of each query, itself left out, smaller id on ties.

    Queries (query_id, q) visit the cells of the vectors (vec_id, v) that can hold one of their neighbours, see metric; a
    task holds a block of at most about max_queries queries and one of as many vectors. Without queries all vectors ask.
    """
    return metric.nearest(queries, vectors, k, least, min(max_queries, metric.BLOCK))


def similar_pairs(vectors: DataFrame, least: float, block: int = metric.BLOCK) -> DataFrame:
    """a < b with cosine >= least, exactly: only vectors meet whose cells can be that near, see metric."""
    return metric.similar_pairs(vectors, least, block)


def similar_links(vectors: DataFrame, least: float, block: int = metric.BLOCK) -> DataFrame:
    """a < b: what connects the same vectors as similar_pairs() does, without all of its pairs."""
    return metric.similar_links(vectors, least, block)


def clusters(pairs: DataFrame, most: int = 60) -> DataFrame:
    """vec_id, cluster (smallest member) of everything in a pair (a, b): smallest labels spread and jump until none changes.

    Each round is cut off by checkpoint() in the shared folder the session names.
    """
    both = cut(pairs.select("a", "b").union(pairs.select("b", "a")).distinct())
    labels = cut(both.groupBy(F.col("a").alias("v")).agg(F.least(F.min("b"), F.col("v")).alias("l")))
    for _ in range(most):
        near = both.join(labels, both["b"] == labels["v"]).groupBy(F.col("a").alias("v")).agg(F.min("l").alias("m"))
        step = labels.join(near, "v").select("v", F.col("l").alias("old"), F.least("l", "m").alias("l"))
        far = labels.select(F.col("v").alias("l"), F.col("l").alias("f"))
        new = cut(step.join(far, "l", "left").select("v", "old", F.least("l", F.coalesce("f", "l")).alias("l")))
        if not new.where("old <> l").limit(1).count():
            return new.select(F.col("v").alias("vec_id"), F.col("l").alias("cluster"))
        labels = new.select("v", "l")
    raise RuntimeError("no clusters")


def cluster_summary(ids: DataFrame, clusters_: DataFrame) -> DataFrame:
    """cluster, size, members (sorted), name of every cluster: CLUSTER_1 is the largest (of equal ones that with the smallest
    member), an id in none is SINGLETON_id. ids: vec_id, all of them."""
    d = ids.join(clusters_, "vec_id", "left").select("vec_id", F.coalesce("cluster", "vec_id").alias("cluster"))
    g = d.groupBy("cluster").agg(F.count(F.lit(1)).alias("size"), F.array_sort(F.collect_list("vec_id")).alias("members"))
    from .series import global_number

    big = global_number(g.where("size > 1").withColumn("_s", -F.col("size")), "_s", "cluster", name="_n").drop("_s")
    named = big.withColumn("name", F.concat(F.lit("CLUSTER_"), (F.col("_n") + 1).cast("string"))).drop("_n")
    return named.unionByName(g.where("size = 1").withColumn("name", F.concat(F.lit("SINGLETON_"), F.col("cluster").cast("string"))))


def jaccard(a: Column, b: Column) -> Column:
    u = F.size(F.array_union(a, b))
    return F.when(u == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / u)


def rouge1(pairs: DataFrame, key: list[str], a: str, b: str) -> DataFrame:
    """key, rouge1: F1 of the multisets of words of array columns a and b."""
    side = lambda c, s: pairs.select(*key, F.explode(c).alias("w")).groupBy(*key, "w").agg(F.count(F.lit(1)).alias(s))
    both = side(a, "x").join(side(b, "y"), [*key, "w"]).groupBy(*key).agg(F.sum(F.least("x", "y")).alias("o"))
    d = pairs.select(*key, F.size(a).alias("n"), F.size(b).alias("m")).join(both, key, "left").withColumn("o", F.coalesce("o", F.lit(0)))
    return d.select(*key, F.when((F.col("n") + F.col("m") > 0), 2.0 * F.col("o") / (F.col("n") + F.col("m"))).otherwise(0.0).alias("rouge1"))


def lcs_length(x: list, y: list) -> int:
    """Length of the longest common subsequence, a whole row of the table at a time: its steps are the bits of one number."""
    at: dict = {}
    for j, b in enumerate(y):
        at[b] = at.get(b, 0) | 1 << j
    full = (1 << len(y)) - 1
    row = full  # a cleared bit is a step up
    for a in x:
        if m := at.get(a):
            met = row & m
            row = (row + met | row - met) & full
    return len(y) - row.bit_count()


def _positions(x: list, y: list) -> tuple[list[int], list[int]]:
    """Both sequences with their words as numbers."""
    code: dict = {}
    return tuple([code.setdefault(w, len(code)) for w in s] for s in (x, y))


def bleu4(reference: list, candidate: list) -> float:
    """Sentence BLEU-4 with a small count in place of zero matches that shrinks with each zero and grows with length."""
    if not candidate:
        return 0.0
    logs, k = 0.0, 1
    for n in range(1, 5):
        grams = lambda s: Counter(zip(*[s[i:] for i in range(n)]))  # noqa: B023, E731
        have, total = grams(reference), max(1, len(candidate) - n + 1)
        hit = sum(min(c, have[g]) for g, c in grams(candidate).items())
        if hit == 0:
            if len(candidate) <= 1:
                return 0.0
            hit = 1 / (2**k * 5 / np.log(len(candidate)))
            k += 1
        logs += 0.25 * np.log(hit / total)
    short = min(0.0, 1 - len(reference) / len(candidate))
    return float(np.exp(short + logs))


def sequence_scores(pairs: DataFrame, key: list[str], a: str, b: str) -> DataFrame:
    """key, rouge_l, bleu: order-aware scores of array columns a (reference) and b (candidate)."""
    schema = ", ".join(f"{c} {pairs.schema[c].dataType.simpleString()}" for c in key)

    def run(it):
        for pdf in it:
            rows = []
            for x, y in zip(pdf[a], pdf[b], strict=True):
                x, y = _positions(x, y)
                l = lcs_length(x, y)
                rows.append((2.0 * l / (len(x) + len(y)) if x or y else 0.0, bleu4(x, y)))
            yield pd.concat([pdf[key].reset_index(drop=True), pd.DataFrame(rows, columns=["rouge_l", "bleu"])], axis=1)

    return pairs.select(*key, a, b).mapInPandas(run, f"{schema}, rouge_l double, bleu double")
