"""Is a span really in its source, does a sentence rest on its span, and how alike are two texts."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text
from .durable import cut


def grounded(sentence: Column, span: Column) -> Column:
    """The sentence shares at least one word with the span."""
    return F.arrays_overlap(text.unicode_words(sentence), text.unicode_words(span))


def span_in(source: Column, span: Column) -> Column:
    s = text.strip(span)
    return F.coalesce((s != "") & F.contains(source, s), F.lit(False))


#: Bytes of a gram, and distance of the indexed grams; spans shorter than SHORT contain no aligned gram for sure.
GRAM, STRIDE = 16, 16
SHORT = GRAM + STRIDE - 1
#: A fixed table of the first bytes of short spans.
_HEAD_BITS = 16


def _grams(raw: bytes, at: np.ndarray) -> np.ndarray:
    """The GRAM bytes from each place on as one number; unlike ones may meet, so a match is checked."""
    x = np.frombuffer(raw + bytes(GRAM), np.uint8)
    words = np.lib.stride_tricks.sliding_window_view(x, 8)
    a = np.ascontiguousarray(words[at]).view("<u8").reshape(-1)
    b = np.ascontiguousarray(words[at + 8]).view("<u8").reshape(-1)
    h = (a ^ (a >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + (b ^ (b >> np.uint64(32))) * np.uint64(0xC2B2AE3D27D4EB4F)
    return (h ^ (h >> np.uint64(31))).view(np.int64)


def gram_index(sources: DataFrame) -> DataFrame:
    """gram, t1, t2, pos: the positional index of the sources (t1, t2, text), every STRIDE bytes of each text."""

    def run(it):
        for pdf in it:
            raws = [t.encode() for t in pdf["text"]]
            places = [np.arange(0, len(raw) - GRAM + 1, STRIDE) for raw in raws]
            n = [len(at) for at in places]
            if sum(n):
                grams = np.concatenate([_grams(raw, at) for raw, at in zip(raws, places, strict=True) if len(at)])
                yield pd.DataFrame({"gram": grams, "t1": np.repeat(pdf["t1"].to_numpy(), n), "t2": np.repeat(pdf["t2"].to_numpy(), n), "pos": np.concatenate(places).astype(np.int32)})

    return sources.where("text is not null").select("t1", "t2", "text").mapInPandas(run, "gram long, t1 long, t2 long, pos int")


def span_grams(spans: DataFrame) -> DataFrame:
    """span, gram, off: every gram of every long span."""

    def run(it):
        for pdf in it:
            raws = [s.encode() for s in pdf["span"]]
            places = [np.arange(len(raw) - GRAM + 1) for raw in raws]
            if len(raws):
                yield pd.DataFrame({"span": np.repeat(pdf["span"].to_numpy(object), [len(at) for at in places]), "gram": np.concatenate([_grams(r, at) for r, at in zip(raws, places, strict=True)]), "off": np.concatenate(places).astype(np.int32)})

    return spans.mapInPandas(run, "span string, gram long, off int")


def long_hits(spans: DataFrame, sources: DataFrame) -> DataFrame:
    """span, n: in how many sources each long span stands.

    Wherever a span stands, one of its first STRIDE grams lies on an indexed place, and with it those a multiple of STRIDE
    further. So for each of the STRIDE shifts the rarest of these grams is looked up, none if one of them is in no source;
    what the postings propose is compared byte by byte with the text.
    """
    asked = span_grams(spans)
    postings = cut(gram_index(sources).join(asked.select("gram").distinct(), "gram", "left_semi"))
    known = asked.join(postings.groupBy("gram").agg(F.count(F.lit(1)).alias("df")), "gram", "left").withColumn("shift", F.col("off") % STRIDE)
    rare = known.groupBy("span", "shift").agg(F.min_by(F.struct("gram", "off"), F.struct(F.coalesce("df", F.lit(0)), "off")).alias("g"), F.min(F.coalesce("df", F.lit(0))).alias("df"))
    places = rare.where("df > 0").select("span", "g.gram", "g.off").join(postings, "gram").where("pos >= off").select("t1", "t2", "span", (F.col("pos") - F.col("off")).alias("at")).distinct()
    per_text = places.groupBy("t1", "t2").agg(F.collect_list(F.struct("span", "at")).alias("asked"))

    def run(it):
        for pdf in it:
            n: Counter = Counter()
            for text_, rows in zip(pdf["text"], pdf["asked"], strict=True):
                raw = text_.encode()
                n.update({r["span"] for r in rows if raw.startswith(r["span"].encode(), r["at"])})
            if n:
                yield pd.DataFrame({"span": list(n), "n": list(n.values())})

    return sources.where("text is not null").join(per_text, ["t1", "t2"]).select("text", "asked").mapInPandas(run, "span string, n long")


def short_hits(spans: DataFrame, sources: DataFrame) -> DataFrame:
    """span, n for spans of fewer than SHORT bytes: windows of their lengths that begin like one of them, each once a source."""
    spark = sources.sparkSession
    heads = spans.select(F.length(F.encode("span", "utf-8")).alias("n"), F.substring(F.encode("span", "utf-8"), 1, 2).alias("head")).distinct()
    table: dict[int, np.ndarray] = {}
    for r in heads.collect():  # at most SHORT lengths of 2 ** 16 heads
        bits = table.setdefault(r.n, np.zeros(1 << _HEAD_BITS, bool))
        head = bytes(r.head)
        bits[(head[0] << 8) + head[1] if len(head) > 1 else slice(head[0] << 8, (head[0] << 8) + 256)] = True
    if not table:
        return spark.createDataFrame([], "span string, n long")
    held = spark.sparkContext.broadcast(table)

    def run(it):
        for pdf in it:
            n: Counter = Counter()
            for text_ in pdf["text"]:
                raw = text_.encode()
                x = np.frombuffer(raw + b"\0", np.uint8).astype(np.int64)
                two = (x[:-1] << 8) + x[1:]
                for size, bits in held.value.items():
                    at = np.flatnonzero(bits[two[: max(0, len(raw) - size + 1)]])
                    n.update({raw[i : i + size] for i in at.tolist()})
            if n:
                yield pd.DataFrame({"k": list(n), "n": list(n.values())})

    found = sources.where("text is not null").select("text").mapInPandas(run, "k binary, n long")
    return found.groupBy("k").agg(F.sum("n").alias("n")).join(spans.select("span", F.encode("span", "utf-8").alias("k")), "k").select("span", "n")


def verify_spans(spans: DataFrame, sources: DataFrame, short: int = SHORT) -> DataFrame:
    """item_id, n_sources, verified, review_required: how many sources hold each span word for word.

    Long spans are found by a positional index of the sources, rarest gram first, short ones by their windows; texts meet
    only the spans that the index proposes, and every match is compared byte by byte. Nothing of the spans or the sources
    reaches the driver. Sources are told apart by 128 bits of their text's hashes, copies count each. `short`: bytes below
    which a span counts as short, SHORT at least.
    """
    s = spans.select("item_id", text.strip(F.col("text")).alias("span"))
    distinct = s.where("span <> ''").select("span").distinct().withColumn("_n", F.octet_length("span"))
    known = sources.select("text", F.xxhash64(F.lit(1), "text").alias("t1"), F.xxhash64(F.lit(2), "text").alias("t2"))
    least = max(SHORT, short)
    found = long_hits(distinct.where(F.col("_n") >= least).select("span"), known).unionByName(short_hits(distinct.where(F.col("_n") < least).select("span"), known))
    n = found.groupBy("span").agg(F.sum("n").alias("n"))
    out = s.join(n, "span", "left").select("item_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_sources"))
    return out.select("item_id", "n_sources", (F.col("n_sources") > 0).alias("verified"), (F.col("n_sources") == 0).alias("review_required"))
