"""Exact removal of repeated word windows, found by anchors on a difference cover.

A window is LENGTH words in a row of one document; a word goes if a window over it has the same words as another window
anywhere, in the same document too. COVER is a difference cover modulo PERIOD: for any two places there is a shift below
PERIOD that brings both onto positions of the cover (counted in each document from its first word). So two equal windows
share an aligned anchor, ANCHOR = LENGTH - PERIOD + 1 words that begin at a cover position inside both, and only those
anchors, 5 of 21 places, are hashed and dealt out.

1. `anchors`: each anchor with the hash of its context, the words of all windows through it. Within a batch, anchors with
   equal contexts are settled at once (all windows through them are repeated), anchors with unlike contexts are asked for,
   and one row stands for the batch, so a passage that any number of documents share is one row a batch and not a group.
2. `settled`: of the anchors sorted by hash and context, neighbours with equal contexts are settled, neighbours with
   unlike ones are asked for: their windows are looked at one by one. A row needs its neighbours only, no group is held.
3. `halves`: settled ranges and asked places meet their texts once. Documents without asked places are finished; the
   others give the extensions: the windows through asked anchors, again one row a batch for equal ones, and neighbours of
   equal windows are lost.

Every step identifies a text by 128 bits of hashes and not by a row, so copies of a text are one text with several rows,
and rows without doc_id or with the same one need no care. Settled contexts rest on 128 bits (anchor and context), windows
on 128 bits; words by a 64-bit hash. With 10**13 windows the odds that any two unlike ones are taken as equal are below
10**-12; two of 10**9 unlike words share a hash with odds of 3 %, which matters only where all else of a window agrees.

Defined results: null text has no words; documents of fewer than LENGTH words are kept whole; equal rows remove each
other like any other copies; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import common

LENGTH = 35
PERIOD, COVER = 21, (3, 6, 7, 12, 14)
BATCH = 1 << 20
#: What a row of `anchors` is: an anchor, one whose equals in its batch are settled, one that stands for asked ones, a
#: settled range of words (place to context), an asked place.
PLAIN, SEVERAL, ASKED, LOST, ASK = range(5)
_GOLD = np.uint64(0x9E3779B97F4A7C15)


class Places:
    """Word hashes of a batch of texts, for hashing any stretch of words in two ways."""

    def __init__(self, texts: list[str | None]):
        w = common.Words(texts, lower=False)
        self.first, x = w.first.astype(np.int64), w.hash
        self.count = np.diff(self.first)
        self.doc = np.repeat(np.arange(len(self.count)), self.count)
        self.begin, self.end = self.first[:-1][self.doc], self.first[1:][self.doc]
        n = len(x)
        self.h, self.g = np.zeros(n + 1, np.uint64), np.zeros(n + 1, np.uint64)
        np.cumsum(x * common.powers(n + 1)[:n], dtype=np.uint64, out=self.h[1:])
        np.cumsum(common.mix64(x + _GOLD) * common.powers(n + 1)[:n], dtype=np.uint64, out=self.g[1:])

    def one(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return common.mix64(common.span_hash(self.h, a, b))

    def two(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return common.mix64(common.span_hash(self.g, a, b) + (b - a).astype(np.uint64) * _GOLD)


def with_key(docs: DataFrame) -> DataFrame:
    """doc_id, text, t1, t2: 128 bits that stand for the text."""
    d = common.table_of(docs, "doc_id", "text")
    return d.withColumns({f"t{i}": F.xxhash64(F.lit(i), F.col("text")) for i in (1, 2)})


def _uniques(pdf: pd.DataFrame) -> pd.DataFrame:
    """One row of each text of a batch; `copies` says whether there were more."""
    copies = pdf.duplicated(["t1", "t2"], keep=False).to_numpy()
    first = ~pdf.duplicated(["t1", "t2"]).to_numpy()
    return pdf.assign(copies=copies)[first]


def _ranges(a: np.ndarray, b: np.ndarray, doc: np.ndarray):
    """Union of ranges [a, b) of each document as (doc, from, to); a is sorted within doc."""
    if not len(a):
        return doc, a, b
    top = np.maximum.accumulate(b + doc * (1 << 40)) - doc * (1 << 40)
    new = np.ones(len(a), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (a[1:] > top[:-1])
    at = np.flatnonzero(new)
    return doc[at], a[at], top[np.append(at[1:], len(a)) - 1]


def anchors(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """kind, a, c, t1, t2, place: anchors and, of what a batch settles itself, lost ranges [place, c) and asked places."""
    size = length - PERIOD + 1
    on = np.zeros(PERIOD, bool)
    on[list(COVER)] = True

    def run(it):
        for pdf in common.batches(it, most=BATCH):
            pdf = _uniques(pdf)
            w = Places(pdf["text"].tolist())
            k = np.arange(len(w.doc))
            k = k[on[(k - w.begin) % PERIOD] & (k + size <= w.end) & (w.end - w.begin >= length)]
            if not len(k):
                continue
            doc, begin = w.doc[k], w.begin[k]
            low, high = np.maximum(k - PERIOD + 1, begin), np.minimum(k + length, w.end[k])
            a = w.one(k, k + size)
            c = w.two(low, high) ^ common.mix64((k - low).astype(np.uint64))
            copies = pdf["copies"].to_numpy()[doc]
            order = np.lexsort((c, a))
            new_a = np.ones(len(k), bool)
            new_a[1:] = a[order][1:] != a[order][:-1]
            new_c = new_a.copy()
            new_c[1:] |= c[order][1:] != c[order][:-1]
            group, kind = np.cumsum(new_a) - 1, np.cumsum(new_c) - 1
            same = (np.bincount(kind)[kind] > 1) | (np.bincount(kind, weights=copies[order])[kind] > 0)
            mixed = np.bincount(group, weights=new_c)[group] > 1
            sent = np.where(mixed, new_a, new_c)  # one row of a group with unlike contexts, of the others one row
            what = np.where(mixed, ASKED, np.where(same, SEVERAL, PLAIN))
            asks = mixed & new_c  # one of each context
            lost = np.sort(order[same])
            d, f, t = _ranges(low[lost], high[lost], doc[lost])
            s, q = order[sent], order[asks]
            key = [pdf["t1"].to_numpy(np.int64), pdf["t2"].to_numpy(np.int64)]
            of, first = np.concatenate([doc[s], d, doc[q]]), w.first
            yield pd.DataFrame({
                "kind": np.concatenate([what[sent], np.full(len(d), LOST), np.full(len(q), ASK)]).astype(np.int8),
                "a": np.concatenate([a[s].view(np.int64), key[0][d] ^ f, key[0][doc[q]] ^ k[q]]),
                "c": np.concatenate([c[s].view(np.int64), t - first[d], np.zeros(len(q), np.int64)]),
                "t1": key[0][of], "t2": key[1][of], "place": (np.concatenate([k[s], f, k[q]]) - first[of]).astype(np.int32),
            })

    return docs.where("text is not null").select("text", "t1", "t2").mapInPandas(run, "kind byte, a long, c long, t1 long, t2 long, place int")


def settled(rows: DataFrame, length: int = LENGTH) -> DataFrame:
    """t1, t2, lost (a range, see _range()) or ask (place): what neighbours in the order of anchor and context say."""
    order = W.partitionBy("a").orderBy("c")
    is_anchor = F.col("kind") <= ASKED
    beside = lambda f: f(F.when(is_anchor, F.struct("c"))).over(order)
    d = rows.select("*", beside(F.lag).alias("p"), beside(F.lead).alias("n"))
    same = F.col("p.c").eqNullSafe(F.col("c")) | F.col("n.c").eqNullSafe(F.col("c"))
    unlike = (F.col("p.c") != F.col("c")) | (F.col("n.c") != F.col("c"))
    around = _range(F.greatest(F.col("place") - PERIOD + 1, F.lit(0)), F.col("place") + length)  # beyond the end there are no words
    lost = F.when(F.col("kind") == LOST, _range(F.col("place"), F.col("c"))).when((F.col("kind") == PLAIN) & same, around)
    ask = F.when((F.col("kind") == ASK) | (F.col("kind").isin(PLAIN, SEVERAL) & F.coalesce(unlike, F.lit(False))), F.col("place"))
    return d.select("t1", "t2", lost.alias("lost"), ask.alias("ask")).where("lost is not null or ask is not null")


def _range(low, high):
    """Words from low to before high as one long, which sorts like the pair and costs no object."""
    return F.shiftleft(low.cast("long"), 32) + high.cast("long")


def _merged(*ranges) -> list[tuple[int, int]]:
    """The union of ranges."""
    x = np.sort(np.concatenate([np.zeros(0, np.int64), *[r for r in ranges if r is not None]]).astype(np.int64))
    if not len(x):
        return []
    low, top = x >> 32, np.maximum.accumulate(x & 0xFFFFFFFF)
    at = np.flatnonzero(np.concatenate([[True], low[1:] > top[:-1]]))
    return list(zip(low[at].tolist(), top[np.append(at[1:], len(x)) - 1].tolist(), strict=True))


def _kept(text: str | None, ranges: list[tuple[int, int]]) -> tuple[int, int, bytes]:
    """Words, removed words, and the others joined by blanks."""
    words = (text or "").encode("utf-8", "surrogatepass").split()
    at, parts = 0, []
    for low, high in ranges:
        parts += words[at:low]
        at = high
    parts += words[at:]
    return len(words), len(words) - len(parts), b" ".join(parts)


def halves(docs: DataFrame, found: DataFrame) -> DataFrame:
    """Finished documents (doc_id, n_words, n_removed, kept), and those with asked places with their text, lost and ask."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    per_text = found.groupBy("t1", "t2").agg(F.collect_list("lost").alias("lost"), F.array_sort(F.collect_set("ask")).alias("ask"))  # no more than a text has words

    def run(it):
        for pdf in common.batches(it):
            out = []
            for r in pdf.itertuples(index=False):
                lost = _merged(r.lost)
                if r.ask is not None and len(r.ask):
                    out.append((r.doc_id, None, None, None, r.t1, r.t2, r.text, [a << 32 | b for a, b in lost], r.ask))
                else:
                    out.append((r.doc_id, *_kept(r.text, lost), r.t1, r.t2, None, None, None))
            frame = pd.DataFrame(out, columns=["doc_id", "n_words", "n_removed", "kept", "t1", "t2", "text", "lost", "ask"])
            frame["doc_id"] = pdf["doc_id"].to_numpy()
            yield frame.astype({"n_words": "Int64", "n_removed": "Int64"})

    d = docs.join(per_text, ["t1", "t2"], "left").select("doc_id", "text", "t1", "t2", "lost", "ask")
    return d.mapInPandas(run, f"doc_id {kind}, n_words long, n_removed long, kept binary, t1 long, t2 long, text string, lost array<long>, ask array<int>")


def windows(asked: DataFrame, length: int = LENGTH) -> DataFrame:
    """w1, w2, t1, t2, place, again: the windows through asked anchors, one row a batch of equal ones (again: it had more)."""

    def run(it):
        for pdf in common.batches(it, most=BATCH):
            pdf = _uniques(pdf)
            w = Places(pdf["text"].tolist())
            n = np.array([len(x) for x in pdf["ask"]])
            doc = np.repeat(np.arange(len(pdf)), n)
            at = np.concatenate(pdf["ask"].tolist()).astype(np.int64)
            low, high = np.maximum(at - PERIOD + 1, 0), np.minimum(at, w.count[doc] - length) + 1
            doc, low, high = _ranges(low, high, doc)
            n = high - low
            of = np.repeat(np.arange(len(n)), n)
            k = low[of] + np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
            at = k + w.first[:-1][doc[of]]
            pair = pd.DataFrame({"w1": w.one(at, at + length).view(np.int64), "w2": w.two(at, at + length).view(np.int64)})
            again = pair.duplicated(keep=False).to_numpy() | pdf["copies"].to_numpy()[doc[of]]
            first = ~pair.duplicated().to_numpy()
            key = pdf[["t1", "t2"]].iloc[doc[of]].reset_index(drop=True)
            out = pd.concat([pair, key], axis=1).assign(place=k.astype(np.int32), again=again, alone=first)
            yield out[first | again]

    return asked.select("text", "t1", "t2", "ask").mapInPandas(run, "w1 long, w2 long, t1 long, t2 long, place int, again boolean, alone boolean")


def repeated(rows: DataFrame, length: int = LENGTH) -> DataFrame:
    """t1, t2, more: the ranges of the windows that occur again. Rows that stand for no other only pass through."""
    spread = F.when(F.col("alone"), F.col("w1")).otherwise(F.xxhash64("t1", "place"))
    order = W.partitionBy("s", "alone").orderBy("w1", "w2")
    beside = lambda f: F.coalesce((f("w1").over(order) == F.col("w1")) & (f("w2").over(order) == F.col("w2")), F.lit(False))
    d = rows.withColumn("s", spread).select("t1", "t2", "place", (F.col("again") | beside(F.lag) | beside(F.lead)).alias("hit")).where("hit")
    return d.groupBy("t1", "t2").agg(F.collect_list(_range(F.col("place"), F.col("place") + length)).alias("more"))


def dedup(docs: DataFrame, owner: str = "cover") -> DataFrame:
    """doc_id, n_words, n_removed, kept (the remaining words, joined by blanks, as bytes) of every document."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    d = with_key(docs)
    found = common.stored(settled(anchors(d)), "anchors", owner)
    half = common.stored(halves(d, found), "halves", owner)
    done, asked = half.where("ask is null"), half.where("ask is not null")
    more = repeated(windows(asked))

    def run(it):
        for pdf in common.batches(it):
            out = [_kept(t, _merged(a, b)) for t, a, b in zip(pdf["text"], pdf["lost"], pdf["more"], strict=True)]
            yield pd.concat([pdf[["doc_id"]].reset_index(drop=True), pd.DataFrame(out, columns=["n_words", "n_removed", "kept"])], axis=1)

    schema = f"doc_id {kind}, n_words long, n_removed long, kept binary"
    rest = asked.join(more, ["t1", "t2"], "left").select("doc_id", "text", "lost", "more").mapInPandas(run, schema)
    return done.select("doc_id", "n_words", "n_removed", "kept").unionByName(rest)


def digest(docs: DataFrame) -> DataFrame:
    return dedup(docs).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
