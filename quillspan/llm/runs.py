"""Periodic runs of words, by Lyndon arrays over the words in order of first appearance, and documents without repeats.

A run is a stretch of words with smallest period q (words q apart are the same) that no neighbour extends; counted are
those of at least max(LEAST, TIMES * q) words. Words are numbered in the order in which a document first uses them, and
only compared as numbers: no hashes, no suffix array. For this order and for its reverse the Lyndon array is built from
right to left: the longest Lyndon word at i ends where the next smaller suffix begins. Two suffixes are compared word by
word, and how far they agreed is remembered for their distance, so that a comparison at the same distance further left
stops where the former one began and takes over its extension. Every run contains a Lyndon word of its period that one of
the two orders finds; the leftmost one, extended to both sides, gives the run.

Before that, words that cannot lie in a run part the document: in a run of four periods every word occurs four times, so
words that are rarer in the stretch between two such words, and stretches of fewer than LEAST words, go, until none does.
It needs counts only and leaves every run, and what may extend it, whole.

Defined results: null and empty texts have no words and no runs; the rule that repeats the end of some documents needs a
doc_id, documents without one stay as they are; equal rows give equal results; documents of one word repeated are linear;
an empty table gives an empty result; extra columns are ignored. Each document is read by itself, in one narrow pass.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from . import common

LEAST, TIMES = 6, 4


def numbers(words: list) -> list[int]:
    """Each word's place in the order of first appearance."""
    seen: dict = {}
    return [seen.setdefault(w, len(seen)) for w in words]


def stretches(ids: np.ndarray, doc: np.ndarray, least: int = LEAST, times: int = TIMES) -> list[tuple[int, int]]:
    """Ranges [a, b) that hold every run of a batch of documents joined together; doc is the document of each word."""
    at = np.arange(len(ids))
    part = doc.astype(np.int64)
    while len(at):
        # counts of each word in its part; numbers are smaller than the number of words
        _, inverse, n = np.unique(part * (int(ids.max()) + 1) + ids[at], return_inverse=True, return_counts=True)
        keep = n[inverse] >= times
        if len(at) and keep.all():
            size = np.bincount(part)
            keep = size[part] >= least
            if keep.all():
                break
        at, part = at[keep], part[keep]
        cut = np.ones(len(at), bool)
        cut[1:] = (at[1:] != at[:-1] + 1) | (part[1:] != part[:-1])
        part = np.cumsum(cut) - 1
    if not len(at):
        return []
    begin = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
    end = np.append(begin[1:], len(at))
    return list(zip(at[begin].tolist(), (at[end - 1] + 1).tolist(), strict=True))


def runs(w: list[int], least: int = LEAST, times: int = TIMES) -> set[tuple[int, int, int]]:
    """(start, length, period) of the runs of w with at least max(least, times * period) words; times is 3 or more."""
    n, found = len(w), set()
    for sign in (1, -1):
        x = w if sign == 1 else [-v for v in w]
        smaller = [n] * (n + 1)  # where the next smaller suffix begins
        agreed: dict[int, tuple[int, int]] = {}  # distance -> (place, length) of the last extension found at it
        for i in range(n - 1, -1, -1):
            j, v, m = i + 1, x[i], 0
            while j < n:
                u = x[j]
                if u != v:
                    m = 0
                    if u < v:
                        break
                    j = smaller[j]
                    continue
                d = j - i
                stop, more = agreed.get(d, (n, 0))
                a, b = i + 1, j + 1
                while b < n and a < stop and x[a] == x[b]:
                    a += 1
                    b += 1
                if a == stop:  # from here on the former comparison at this distance goes on
                    b += more
                m = b - j
                agreed[d] = (i, m)
                if b == n or x[b] < x[b - d]:
                    break
                j = smaller[j]
            smaller[i] = j
            if j < n and m:
                q = j - i
                if m >= (times - 2) * q:  # the leftmost word of the period in a run has less than q words before it
                    left = 0
                    while left < q and i - left > 0 and x[i - left - 1] == x[j - left - 1]:
                        left += 1
                    if left < q and left + q + m >= max(least, times * q):
                        found.add((i - left, left + q + m, q))
    return found


def periodic(words: list, doc_id: int | None) -> list:
    """The words with the stated share of documents repeating a part to their end."""
    n = len(words)
    if doc_id is None or not n:
        return words
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + (i - a) % p] for i in range(a, n)]


def collapsed(words: list, found: list[tuple[int, int, int]]) -> list:
    """The words without those that a run contains after its first period."""
    out, at = [], 0
    for low, high in sorted((s + q, s + m) for s, m, q in found):
        if low > at:
            out += words[at:low]
        at = max(at, high)
    return out + words[at:]


def find(docs: DataFrame, change=None, least: int = LEAST, times: int = TIMES) -> DataFrame:
    """doc_id, words (array), runs (start, length, period; by start, then period) of every document.

    change(words, doc_id) may replace a document's words before they are looked at.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(it):
        for pdf in common.batches(it):
            ids = [None if pd.isna(i) else int(i) for i in pdf["doc_id"]]
            texts = [(t or "").encode("utf-8", "surrogatepass").split() for t in pdf["text"]]
            if change is not None:
                texts = [change(w, i) for w, i in zip(texts, ids, strict=True)]
            n = np.array([len(w) for w in texts])
            first = np.concatenate([[0], np.cumsum(n)])
            joined = [x for w in texts for x in numbers(w)]
            found: list[list] = [[] for _ in texts]
            if joined:
                doc = np.repeat(np.arange(len(texts)), n)
                for a, b in stretches(np.array(joined), doc, least, times):
                    d = doc[a]
                    found[d] += [(s + a - int(first[d]), m, q) for s, m, q in runs(joined[a:b], least, times)]
            yield pd.DataFrame({"doc_id": pdf["doc_id"].to_numpy(), "words": texts, "runs": [[dict(zip(("start", "length", "period"), r, strict=True)) for r in sorted(f, key=lambda r: (r[0], r[2]))] for f in found]})

    return common.table_of(docs, "doc_id", "text").mapInPandas(run, f"doc_id {kind}, words array<binary>, runs array<struct<start:long,length:long,period:long>>")


def digest(docs: DataFrame) -> DataFrame:
    """The stated columns of a document: number of runs, the one of the greatest exponent, digests of all and of the words kept."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(it):
        for pdf in it:
            out = []
            for words, found in zip(pdf["words"], pdf["runs"], strict=True):
                found = [(r["start"], r["length"], r["period"]) for r in found]
                best = (None,) * 3
                for r in found:  # by start, then period: a later one must be greater
                    if best[0] is None or r[1] * best[2] > best[1] * r[2]:
                        best = r
                lines = "".join(f"{s},{m},{q}\n" for s, m, q in found)
                milli = None if best[0] is None else 1000 * best[1] // best[2]
                out.append((len(found), *best, milli, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(b" ".join(collapsed(list(words), found))).hexdigest()))
            frame = pd.DataFrame(out, columns=["n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"])
            yield pd.concat([pdf[["doc_id"]].reset_index(drop=True), frame.astype(dict.fromkeys(frame.columns[:5], "Int64"))], axis=1)

    return find(docs, periodic).mapInPandas(run, f"doc_id {kind}, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string")
