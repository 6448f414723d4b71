"""Exact substring removal by minimiser buckets and hashes of whole strings, in place of bucket-pointer refinement.

A byte goes if a string of `length` bytes over it also starts earlier (in a document with a smaller id, or before in the
same one). Every such string is a suffix's first `length` bytes. Suffixes are first put into buckets by a q-gram, and not
by the one at their start but by the smallest-hashed q-gram of the string, so that neighbouring suffixes share one bucket
entry, a run. Equal strings have equal q-grams at the same offset, hence lie in the same bucket. Fixed-size bit tables,
filled from all documents, drop buckets with a single entry (of a fixed size, they let more through the larger the input
is; what they let through is told apart below). Within a bucket strings are told apart by 64-bit hashes: crowded buckets are
first split by the hashes of parts of the run; then the hash of the whole run settles identical runs, where they are read if
it can; only buckets left with several kinds of runs are taken apart into single strings, in order of place, where the
first of each stays. Two unlike strings of one bucket and place share a hash with odds of 2**-64.

Defined results: null text counts as empty; texts shorter than `length` are kept whole; rows with equal doc_id stand in
the order of their numbers (see numbered()), rows without one come first; an empty table gives an empty result; extra
columns are ignored. The documents are read four times, in any order.
"""

from __future__ import annotations


import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .bits import bit_tables, slot_of, test_bits

Q, LENGTH = 40, 100
#: Entries from which a bucket counts as crowded, and the number of strings in a part of a run there.
CROWDED, STEP = 1 << 14, 8
BATCH = 1 << 19


class Runs:
    """Runs of strings with the same smallest q-gram, over a batch of documents joined into one byte array."""

    def __init__(self, texts: list[str | None], q: int = Q, length: int = LENGTH):
        parts = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
        self.data = np.frombuffer(b"".join(parts), np.uint8)
        self.begin = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)
        self.h = common.prefix_hash(self.data)
        n, w = len(self.data), length - q + 1
        empty = np.zeros(0, np.int64)
        self.anchor = self.low = self.high = self.doc = empty
        self.gram = np.zeros(0, np.uint64)
        if n < length:
            return
        v = (self.h[q:] - self.h[: n - q + 1]) * common.powers(n + 1, "down")[: n - q + 1]
        v *= np.uint64(0x9E3779B97F4A7C15)
        blocks = -(-len(v) // w) + 1
        keys = np.full(blocks * w, np.uint64(0xFFFFFFFFFFFFFFFF))
        keys[: len(v)] = v
        keys = keys.reshape(blocks, w)
        keys &= np.uint64(0xFFFFFFFFFFFFFFC0)
        keys |= np.arange(w, dtype=np.uint64)
        count = n - length + 1
        right = np.minimum.accumulate(keys, axis=1).reshape(-1)[w - 1 : w - 1 + count]
        left = np.minimum.accumulate(keys[:, ::-1], axis=1)[:, ::-1].reshape(-1)[:count]
        six = np.uint64(63)
        take = (left | six) <= (right | six)  # on equal hashes the first place in the string
        owner = np.repeat(np.arange(blocks) * w, w)[:count]
        owner += np.where(take, left & six, (right & six) + np.uint64(w)).astype(np.int64)
        ok = np.ones(count, bool)
        for e in self.begin[1:].tolist():
            ok[max(0, e - length + 1) : e] = False
        new = owner[1:] != owner[:-1]
        first, last = ok.copy(), ok.copy()
        first[1:] &= new | ~ok[:-1]
        last[:-1] &= new | ~ok[1:]
        self.low, self.high = np.flatnonzero(first), np.flatnonzero(last)
        self.anchor = owner[self.low]
        self.doc = np.searchsorted(self.begin, self.low, "right") - 1
        self.gram = v[self.anchor]


def bucket_bits(docs: DataFrame) -> list[np.ndarray]:
    """(repeated, crowded): bit tables over q-grams with two entries or more, and with CROWDED or more."""

    grams = lambda pdf: (Runs(part["text"].tolist()).gram for part in common.batches([pdf], most=BATCH))
    return bit_tables(common.table_of(docs, "text"), grams, (2, CROWDED))


class Entries:
    """Bucket entries of a batch: the runs of repeated q-grams, those of crowded ones cut into parts."""

    def __init__(self, pdf: pd.DataFrame, repeated: np.ndarray, crowded: np.ndarray, length: int = LENGTH):
        self.runs = r = Runs(pdf["text"].tolist())
        slot = slot_of(r.gram)
        keep = np.flatnonzero(test_bits(repeated, slot))
        low, high, anchor, gram, doc = r.low[keep], r.high[keep], r.anchor[keep], r.gram[keep], r.doc[keep]
        many = test_bits(crowded, slot[keep])
        # parts are aligned to multiples of STEP of the distance to the anchor
        cut_low, cut_high = np.where(many, (anchor - low) // STEP, 0), np.where(many, (anchor - high) // STEP, 0)
        n_parts = cut_low - cut_high + 1
        of = np.repeat(np.arange(len(low)), n_parts)
        step = cut_low[of] - (np.arange(len(of)) - np.repeat(np.cumsum(n_parts) - n_parts, n_parts))
        anchor, many, self.doc = anchor[of], many[of], doc[of]
        self.low = np.where(many, np.maximum(low[of], anchor - step * STEP - (STEP - 1)), low[of])
        self.high = np.where(many, np.minimum(high[of], anchor - step * STEP), high[of])
        self.bucket = gram[of]
        c = np.flatnonzero(many)  # what all strings of such a part share, and which part it is
        core = anchor[c] - step[c] * STEP
        self.bucket[c] = common.mix64(common.span_hash(r.h, core, core - (STEP - 1) + length) + step[c].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        self.shift = self.low - anchor
        self.whole = common.mix64(common.span_hash(r.h, self.low, self.high + length) + self.shift.view(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F) + (self.high - self.low).astype(np.uint64) + self.bucket * np.uint64(3))
        self.many = many
        self.start = self.low - r.begin[self.doc]


def _in_order(pdf: pd.DataFrame) -> pd.DataFrame:
    return pdf.sort_values("doc_id", kind="stable", na_position="first", ignore_index=True)


def entries(docs: DataFrame, repeated, crowded, length: int = LENGTH) -> DataFrame:
    """bucket, whole, doc_id, rid, start, n for the bucket entries of repeated q-grams. A run identical to an earlier one of
    the same batch, or in a crowded bucket of the same task, has no whole: it is lost already."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(it):
        seen: dict[int, tuple] = {}
        for pdf in common.batches(it, most=BATCH):
            pdf = _in_order(pdf)
            e = Entries(pdf, repeated.value, crowded.value, length)
            if not len(e.low):
                continue
            lost = np.ones(len(e.whole), bool)
            lost[np.unique(e.whole, return_index=True)[1]] = False
            ids, rids = pdf["doc_id"], pdf["rid"]
            for x in np.flatnonzero(e.many & ~lost).tolist():
                d = ids[e.doc[x]]
                place = (0, 0, int(rids[e.doc[x]]), int(e.start[x])) if pd.isna(d) else (1, d, int(rids[e.doc[x]]), int(e.start[x]))
                old = seen.setdefault(int(e.whole[x]), place)
                if old < place:
                    lost[x] = True
                elif old != place:
                    seen[int(e.whole[x])] = place
            if len(seen) > 1 << 20:
                seen.clear()
            yield pd.DataFrame({"bucket": e.bucket.view(np.int64), "whole": pd.Series(e.whole.view(np.int64)).astype("Int64").mask(lost), "doc_id": ids.take(e.doc).to_numpy(), "rid": rids.take(e.doc).to_numpy(), "start": e.start.astype(np.int32), "n": (e.high - e.low + 1).astype(np.int32)})

    return docs.mapInPandas(run, f"bucket long, whole long, doc_id {kind}, rid long, start int, n int")


def settle(dealt: DataFrame, length: int = LENGTH) -> DataFrame:
    """Rows (rid, lost_from, lost_to) for runs identical to an earlier one, and rows (whole) for the first of each kind of
    run in buckets with several kinds. Input: one bucket after the other, in order of place."""

    def run(it):
        open_ = last = None  # the bucket that goes on in the next batch, and the kind of its only run so far
        held: set[int] = set()
        for pdf in it:
            if not len(pdf):
                continue
            bucket, whole = pdf["bucket"].to_numpy(np.int64), pdf["whole"].to_numpy(np.int64)
            pair = common.mix64(bucket.view(np.uint64)) + whole.view(np.uint64)
            first = np.zeros(len(pair), bool)
            first[np.unique(pair, return_index=True)[1]] = True
            begin = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
            goes_on = open_ is not None and bucket[0] == open_
            if goes_on:
                head = np.flatnonzero(bucket == open_)
                first[head] &= [int(x) not in held for x in whole[head]]
            kinds = np.add.reduceat(first.astype(np.int64), begin)
            if goes_on:
                kinds[0] += len(held)
            ask = whole[first & np.repeat(kinds >= 2, np.diff(np.append(begin, len(bucket))))]
            if goes_on and kinds[0] >= 2 and last is not None:
                ask = np.append(ask, last)
                last = None
            tail = bucket == bucket[-1]
            held = (held if open_ == bucket[-1] else set()) | set(whole[tail & first].tolist())
            if open_ != bucket[-1]:
                last = int(whole[tail][0]) if kinds[-1] == 1 else None
            open_ = bucket[-1]
            gone = pdf[~first]
            if len(gone):
                yield pd.DataFrame({"rid": gone["rid"], "lost_from": gone["start"].astype(np.int64), "lost_to": gone["start"].astype(np.int64) + gone["n"] - 1 + length, "whole": None})
            if len(ask):
                yield pd.DataFrame({"rid": None, "lost_from": None, "lost_to": None, "whole": ask})

    return dealt.mapInPandas(run, "rid long, lost_from long, lost_to long, whole long")


def strings_of(docs: DataFrame, repeated, crowded, mixed, length: int = LENGTH) -> DataFrame:
    """bucket, doc_id, rid, start, shift, n, bytes of the runs whose buckets hold several kinds (and of a few others)."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(it):
        for pdf in common.batches(it, most=BATCH):
            pdf = _in_order(pdf)
            e = Entries(pdf, repeated.value, crowded.value, length)
            wanted = np.zeros(len(e.whole), bool)
            wanted[np.unique(e.whole, return_index=True)[1]] = True
            x = np.flatnonzero(wanted & test_bits(mixed.value, slot_of(e.whole)))
            if not len(x):
                continue
            data = e.runs.data.tobytes()
            raw = [data[a:b] for a, b in zip(e.low[x].tolist(), (e.high[x] + length).tolist(), strict=True)]
            at = e.doc[x]
            yield pd.DataFrame({"bucket": e.bucket[x].view(np.int64), "doc_id": pdf["doc_id"].take(at).to_numpy(), "rid": pdf["rid"].take(at).to_numpy(), "start": e.start[x].astype(np.int32), "shift": e.shift[x].astype(np.int32), "n": (e.high[x] - e.low[x] + 1).astype(np.int32), "bytes": raw})

    return docs.mapInPandas(run, f"bucket long, doc_id {kind}, rid long, start int, shift int, n int, bytes binary")


def refine(found: DataFrame, length: int = LENGTH) -> DataFrame:
    """rid, lost_from, lost_to: every string that is not the first of its bucket, neighbours joined."""

    def run(it):
        held = np.zeros(0, np.uint64)  # identifiers already met in the bucket that is still open
        open_ = None
        for pdf in it:
            if not len(pdf):
                continue
            bucket = pdf["bucket"].to_numpy(np.int64)
            n = pdf["n"].to_numpy(np.int64)
            raw = pdf["bytes"].tolist()
            h = common.prefix_hash(np.frombuffer(b"".join(raw), np.uint8))
            begin = np.concatenate([[0], np.cumsum([len(x) for x in raw])])[:-1]
            row = np.repeat(np.arange(len(n)), n)
            k = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
            at = begin[row] + k
            ident = common.mix64(common.span_hash(h, at, at + length) + (pdf["shift"].to_numpy(np.int64)[row] + k).view(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F) + common.mix64(bucket.view(np.uint64))[row])
            _, first = np.unique(ident, return_index=True)
            again = np.ones(len(ident), bool)
            again[first] = False
            if open_ is not None and bucket[0] == open_:
                mine = bucket[row] == open_
                again[mine] |= np.isin(ident[mine], held)
            tail = ident[bucket[row] == bucket[-1]]
            held = np.unique(np.concatenate([held, tail])) if open_ == bucket[-1] else np.unique(tail)
            open_ = bucket[-1]
            if not again.any():
                continue
            start = again.copy()
            start[1:] &= ~(again[:-1] & (row[1:] == row[:-1]))
            end = again.copy()
            end[:-1] &= ~(again[1:] & (row[1:] == row[:-1]))
            a, b = np.flatnonzero(start), np.flatnonzero(end)
            place = pdf["start"].to_numpy(np.int64)
            yield pd.DataFrame({"rid": pdf["rid"].to_numpy(np.int64)[row[a]], "lost_from": place[row[a]] + k[a], "lost_to": place[row[b]] + k[b] + length})

    return found.mapInPandas(run, "rid long, lost_from long, lost_to long")


def by_bucket(d: DataFrame) -> DataFrame:
    return d.repartition("bucket").sortWithinPartitions("bucket", F.col("doc_id").asc_nulls_first(), "rid", "start")


def removed(docs: DataFrame, owner: str = "suffixes") -> DataFrame:
    """rid and its lost ranges [from, to), sorted, for documents that lose bytes. docs: rid, doc_id, text."""
    sc = docs.sparkSession.sparkContext
    repeated, crowded = map(sc.broadcast, bucket_bits(docs))  # fixed size: 2 ** SLOT_BITS bits each
    found = common.stored(entries(docs, repeated, crowded), "entries", owner)
    settled = common.stored(settle(by_bucket(found.where("whole is not null"))), "settled", owner)
    asked = settled.where("whole is not null").select("whole")
    (mixed,) = map(sc.broadcast, bit_tables(asked, lambda pdf: [pdf["whole"].to_numpy(np.int64).view(np.uint64)], (1,)))
    lost = refine(by_bucket(strings_of(docs, repeated, crowded, mixed)))
    early = found.where("whole is null").select("rid", F.col("start").cast("long").alias("lost_from"), (F.col("start") + F.col("n") - 1 + LENGTH).cast("long").alias("lost_to"))
    lost = lost.unionByName(settled.where("lost_from is not null").select("rid", "lost_from", "lost_to")).unionByName(early)
    return lost.groupBy("rid").agg(F.array_sort(F.collect_list(F.struct("lost_from", "lost_to"))).alias("lost"))


def numbered(docs: DataFrame, owner: str = "suffixes") -> DataFrame:
    """rid, doc_id, text: a number for every row that is the same at each reading. Rows of files are numbered by file and
    place; of other tables the numbers are stored with the texts."""
    columns = [F.col("`doc_id`").alias("doc_id"), F.col("`text`").alias("text")]
    try:
        m = docs.metadataColumn("_metadata")
        return docs.select(F.xxhash64(m["file_path"], m["row_index"]).alias("rid"), *columns)
    except AnalysisException:  # not read from files alone
        return common.stored(docs.select(F.monotonically_increasing_id().alias("rid"), *columns), "numbered", owner)


def merge(ranges) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for r in ranges if ranges is not None else ():
        a, b = r["lost_from"], r["lost_to"]
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def dedup(docs: DataFrame, owner: str = "suffixes") -> DataFrame:
    """doc_id, n_bytes, kept (the remaining bytes) and spans (the maximal removed ranges) of every document."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    d = numbered(docs, owner)
    joined = d.join(removed(d, owner), "rid", "left")

    def run(it):
        for pdf in common.batches(it):
            out = []
            for t, ranges in zip(pdf["text"], pdf["lost"], strict=True):
                raw = (t or "").encode("utf-8", "surrogatepass")
                spans = merge(ranges)
                at, parts = 0, []
                for a, b in spans:
                    parts.append(raw[at:a])
                    at = b
                out.append((len(raw), b"".join([*parts, raw[at:]]), [{"start": a, "end": b} for a, b in spans]))
            yield pd.concat([pdf[["doc_id"]].reset_index(drop=True), pd.DataFrame(out, columns=["n_bytes", "kept", "spans"])], axis=1)

    return joined.select("doc_id", "text", "lost").mapInPandas(run, f"doc_id {kind}, n_bytes long, kept binary, spans array<struct<start:long,end:long>>")


def digest(docs: DataFrame) -> DataFrame:
    return dedup(docs).select("doc_id", "n_bytes", (F.col("n_bytes") - F.length("kept")).cast("long").alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
