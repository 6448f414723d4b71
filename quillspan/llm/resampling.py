"""Quality classifier by importance resampling over hashed n-grams.

Two bag-of-n-grams models share hashed buckets: the target model counts the texts labelled good, the raw model counts all
documents. A document's log weight is the sum over its n-grams of log(target/raw).

What is taken does not depend on length: a document's mean weight per n-gram is measured in standard deviations from the
mean of labelled good documents held out of the model, where the variance of a text of n n-grams is a + b/n, fitted to
them. This standing over TEMPERATURE, with Gumbel noise seeded by the document, is its key, and the k documents with the
largest keys are the sample without replacement. The temperature says how sharply the ratio counts: at 0.05 two documents
a tenth of a deviation apart can change places, two that are half a deviation apart hardly ever do. A caller who names no
k gets as many as there are documents that stand no lower than all but the share `lose` of the held-out good ones. The
k-th key is found from histograms of keys, so no sort of all documents and no list of them is ever gathered.

Defined results: null, empty and wordless texts have weight 0 (no n-gram speaks for or against them) and the tolerance of
one n-gram; without labels of held-out good documents all stand alike and, without k,
every document is taken; repeated rows have equal keys; all documents with the k-th key are kept; an
empty table gives an empty result; extra columns are ignored by select() and kept by keep().
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

BUCKETS = 1 << 13
TEMPERATURE = 0.05


def ngram_buckets(texts: list[str | None], buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all words and word pairs of the texts, and the text that each belongs to."""
    w = common.Words(texts)
    of = np.repeat(np.arange(len(texts)), np.diff(w.first))
    same = of[1:] == of[:-1]
    pairs = common.mix64(w.hash[:-1] * np.uint64(3) + w.hash[1:])[same]
    h = np.concatenate([w.hash, pairs])
    return (h >> np.uint64(64 - (buckets.bit_length() - 1))).astype(np.int64), np.concatenate([of, of[:-1][same]])


def for_calibration(doc_id: Column) -> Column:
    """Half of the labelled rows never enter the target model, and say how target-like good documents are."""
    return F.pmod(F.xxhash64(doc_id, F.lit(29)), F.lit(2)) == 1


def models(docs: DataFrame, labels: DataFrame, max_labelled: int = 20_000, buckets: int = BUCKETS) -> np.ndarray:
    """log(target/raw) per bucket.

    Raw counts cover all documents; target counts at most max_labelled rows labelled good. The driver sees one count per
    bucket and model (a fixed number), however many documents there are.
    """
    good = labels.where((F.col("`quality`") == 1) & F.col("`doc_id`").isNotNull() & ~for_calibration(F.col("`doc_id`"))).select(F.col("`doc_id`").alias("doc_id")).distinct().orderBy(F.xxhash64("doc_id", F.lit(17)), "doc_id").limit(max_labelled)
    marked = common.table_of(docs, "doc_id", "text").join(F.broadcast(good.withColumn("good", F.lit(True))), "doc_id", "left")

    def run(it):
        raw, target = np.zeros(buckets, np.int64), np.zeros(buckets, np.int64)
        for part in common.batches(it):
            b, of = ngram_buckets(part["text"].tolist(), buckets)
            raw += np.bincount(b, minlength=buckets)
            if (mark := part["good"].eq(True).to_numpy(bool)).any():
                target += np.bincount(b[mark[of]], minlength=buckets)
        for a in range(0, buckets, 4096):
            yield pd.DataFrame({"part": [a], "raw": [raw[a : a + 4096].tolist()], "target": [target[a : a + 4096].tolist()]})

    parts = marked.select("text", "good").mapInPandas(run, "part int, raw array<long>, target array<long>")
    sums = parts.select("part", F.posexplode(F.arrays_zip("raw", "target")).alias("i", "c")).groupBy("part", "i").agg(F.sum("c.raw").alias("raw"), F.sum("c.target").alias("target"))
    counts = np.zeros((2, buckets))
    for r in sums.groupBy("part").agg(F.sort_array(F.collect_list(F.struct("i", "raw", "target"))).alias("x")).collect():  # one row per table part, a fixed number
        for i, x in enumerate(r.x):
            counts[:, r.part + i] = x.raw, x.target
    if not counts[1].any():
        return np.zeros(buckets)
    raw, target = counts[0] + 1e-9 * counts[0].sum(), counts[1] + 1e-9 * counts[1].sum()
    # shrink both towards their mix, so that a bucket seen a few times says little
    mix = (raw + target) / (raw + target).sum() * buckets / 8
    return np.log((target + mix) / (target + mix).sum()) - np.log((raw + mix) / (raw + mix).sum())


def gumbel(seed: int, *cols: Column) -> Column:
    u = (F.pmod(F.xxhash64(F.lit(seed), *cols), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    return -F.log(-F.log(u))


def measure(texts: list[str | None], table: np.ndarray) -> dict[str, np.ndarray]:
    """Number of n-grams, log weight, and log weight per n-gram, of each text."""
    b, of = ngram_buckets(texts, len(table))
    n = np.bincount(of, minlength=len(texts))
    s = np.bincount(of, table[b], len(texts))
    return {"n": n, "sum": np.round(s, 6), "mean": np.round(s / np.maximum(n, 1), 9)}


def weigh(docs: DataFrame, ratio: np.ndarray) -> DataFrame:
    """doc_id, n_ngrams, log_weight and mean_weight (per n-gram) of every document."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    table = ratio.astype(np.float32)

    def run(it):
        for part in common.batches(it):
            m = measure(part["text"].tolist(), table)
            yield pd.DataFrame({"doc_id": part["doc_id"], "n_ngrams": m["n"], "log_weight": m["sum"], "mean_weight": m["mean"]})

    return common.table_of(docs, "doc_id", "text").mapInPandas(run, f"doc_id {kind}, n_ngrams long, log_weight double, mean_weight double")


def kth_largest(df: DataFrame, column: str, k: int) -> float:
    """The k-th largest value, exactly: histograms of 4096 ranges narrow it down, eight at most; -inf if there are fewer."""
    low, high = df.agg(F.min(column), F.max(column)).first()
    if low is None:
        return float("-inf")
    left = k
    inside = df.select(F.col(column).alias("v"))
    for _ in range(8):
        width = (high - low) / 4096
        if width <= 0 or low + width == low:
            break
        slot = F.least(F.floor((F.col("v") - low) / width), F.lit(4095)).cast("int")
        hist = sorted(((r.s, r.n, r.lo, r.hi) for r in inside.groupBy(slot.alias("s")).agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).collect()), reverse=True)
        for s, n, lo, hi in hist:
            if left <= n:
                low, high = lo, hi
                break
            left -= n
        else:
            return float("-inf")
        if low == high:
            return low
        inside = inside.where((F.col("v") >= low) & (F.col("v") <= high))
    return low


def spread(bands: list[tuple[int, float, float, float]]) -> tuple[float, float, float]:
    """(mean, a, b) of mean weights whose variance is a + b/n, from bands of (documents, mean, variance, mean of 1/n)."""
    count, mean, var, inverse = np.array(bands, np.float64).T
    mu = float((count * mean).sum() / count.sum())
    within = float((count * (var + (mean - mu) ** 2)).sum() / count.sum()) + 1e-18
    some = count > 1
    if some.sum() < 2:
        return mu, within, 0.0
    count, var, inverse = count[some], var[some], inverse[some]
    seen, x = var * count / (count - 1), np.stack([np.ones(len(count)), inverse], 1)
    fitted = np.full(len(seen), within)
    for _ in range(20):  # a sample variance is as uncertain as it is large, and the less so the more documents it has
        w = np.sqrt(count - 1) / fitted
        a, b = np.linalg.lstsq(x * w[:, None], seen * w, rcond=None)[0]
        a, b = max(float(a), 1e-3 * within), max(float(b), 0.0)
        fitted = a + b * inverse
    return mu, a, b


def standing(d: DataFrame, good: DataFrame, lose: float) -> tuple[Callable[[Column, Column], Column], float]:
    """(n_ngrams, mean_weight) -> how target-like a document is for its length, in deviations from held-out good ones; and
    the value that all but the share `lose` of those reach (by an approximate quantile of accuracy 1/10 000)."""
    own = d.join(good, "doc_id").where("n_ngrams > 0")
    by = own.groupBy(F.floor(F.log2("n_ngrams")).alias("band"))
    m = F.col("mean_weight")
    bands = by.agg(F.count(F.lit(1)).alias("c"), F.avg(m).alias("m"), F.var_pop(m).alias("v"), F.avg(1 / F.col("n_ngrams")).alias("i")).orderBy("band").collect()  # one row per doubling of the length
    if not bands:
        return lambda n, m: F.lit(0.0), 0.0
    mu, a, b = spread([(r.c, r.m, r.v, r.i) for r in bands])
    z = lambda n, m: (m - F.lit(mu)) / F.sqrt(F.lit(a) + F.lit(b) / F.greatest(n, F.lit(1)))
    return z, own.agg(F.percentile_approx(z(F.col("n_ngrams"), m), lose, 10_000)).first()[0]


def held_out(labels: DataFrame) -> DataFrame:
    return labels.where((F.col("`quality`") == 1) & for_calibration(F.col("`doc_id`"))).select(F.col("`doc_id`").alias("doc_id")).distinct()


class Sample:
    """The key of a document, and the least key that is taken, for a table of weights."""

    def __init__(self, weights: DataFrame, labels: DataFrame, k: int | None, lose: float, seed: int):
        self.z, floor = standing(weights, held_out(labels), lose)
        self.seed = seed
        if k is None:
            k = weights.where(self.z(F.col("n_ngrams"), F.col("mean_weight")) >= F.lit(floor)).count()
        keyed = weights.withColumn("key", self.key(*map(F.col, ("doc_id", "n_ngrams", "log_weight", "mean_weight"))))
        self.least = kth_largest(keyed, "key", k) if k > 0 else float("inf")

    def key(self, doc_id: Column, n: Column, log_weight: Column, mean: Column) -> Column:
        return self.z(n, mean) / TEMPERATURE + gumbel(self.seed, doc_id, log_weight)


def select(docs: DataFrame, labels: DataFrame, k: int | None = None, lose: float = 0.003, owner: str = "resampling", seed: int = 23, **how) -> DataFrame:
    """doc_id, n_ngrams, log_weight, mean_weight, key and selected (one of the k largest keys), for every document.

    Without k: as many as reach, for their length, the `lose` quantile of labelled good documents that the target model has
    not seen.
    """
    d = common.stored(weigh(docs, models(docs, labels, **how)), "weights", owner)
    sample = Sample(d, labels, k, lose, seed)
    d = d.withColumn("key", sample.key(*map(F.col, ("doc_id", "n_ngrams", "log_weight", "mean_weight"))))
    return d.withColumn("selected", F.col("key") >= F.lit(sample.least))


def keep(docs: DataFrame, labels: DataFrame, k: int | None = None, lose: float = 0.003, owner: str = "resampling", seed: int = 23, **how) -> DataFrame:
    """The documents that select() selects, with all their columns; texts stay where they are, each row is judged in place."""
    ratio = models(docs, labels, **how)
    sample = Sample(common.stored(weigh(docs, ratio), "weights", owner), labels, k, lose, seed)
    table = ratio.astype(np.float32)

    @F.pandas_udf("n long, sum double, mean double")
    def weight(text: pd.Series) -> pd.DataFrame:
        out = [pd.DataFrame(measure(part["text"].tolist(), table)) for part in common.batches([pd.DataFrame({"text": text})])]
        d = pd.concat(out) if out else pd.DataFrame({"n": [], "sum": [], "mean": []})
        return pd.DataFrame({"n": d["n"].to_numpy(np.int64), "sum": d["sum"].to_numpy(np.float64), "mean": d["mean"].to_numpy(np.float64)})

    w = F.col("__weight")
    return docs.withColumn("__weight", weight(F.col("`text`"))).where(sample.key(F.col("`doc_id`"), w["n"], w["sum"], w["mean"]) >= F.lit(sample.least)).drop("__weight")
