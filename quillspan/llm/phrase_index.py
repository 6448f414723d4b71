"""Benchmark decontamination with a distributed positional inverted index.

The index is document-partitioned: a segment holds some documents (about segment_words words; a longer document has a
segment of its own) as the sorted terms that occur, and for each term the list of its positions. Positions skip one
number between documents, so no phrase runs across two. Segments are stored in the shared folder, one row each, and are
searched where they lie: nothing is shuffled. A phrase is found by intersecting the position lists of its terms, each
shifted back by the term's offset, from the rarest term on. Proximity search takes the positions of the rarest term and
asks for every other term within a number of words.

The benchmark is the stated query set. It is read in blocks of at most block_words words, and each block is searched
against all segments, so neither the driver nor a task ever holds more than one block.

Defined results: null or wordless texts have no words and no hits; a null item_id counts for the hit words but is not
listed; repeated items count once, repeated documents each for themselves; empty tables give an empty result or no hits;
extra columns are ignored. Terms are 64-bit hashes of words.
"""

from __future__ import annotations


from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

WINDOW = 13


def _segment(name: str, ids: list, hashes: list[np.ndarray]) -> dict:
    lengths = np.array([len(h) for h in hashes], np.int64)
    begin = np.concatenate([[0], np.cumsum(lengths + 1)[:-1]]).astype(np.int64)
    words = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
    at = np.arange(len(words)) + np.repeat(np.arange(len(hashes)), lengths)
    order = np.argsort(words, kind="stable")
    ordered = words[order]
    first = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]])) if len(words) else np.zeros(0, np.int64)
    return {
        "segment": name, "doc_id": ids, "n_words": lengths.tolist(), "begin": begin.tolist(), "terms": ordered[first].tobytes(),
        "starts": np.concatenate([first, [len(words)]]).astype(np.uint32).tobytes(), "postings": at[order].astype(np.uint32).tobytes(),
    }


def build_index(docs: DataFrame, segment_words: int = 1 << 18) -> DataFrame:
    """Segments of the whole texts: segment, doc_id[], n_words[], begin[], terms, starts, postings."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, n = TaskContext.get().partitionId(), 0
        ids: list = []
        hashes: list[np.ndarray] = []
        held = 0
        for pdf in common.batches(it):
            w = common.Words(pdf["text"].tolist(), common.IS_BREAK)
            for k, doc in enumerate(pdf["doc_id"].tolist()):
                h = w.hash[w.first[k] : w.first[k + 1]]
                if held and held + len(h) > segment_words:
                    yield pd.DataFrame([_segment(f"{part}-{n}", ids, hashes)])
                    ids, hashes, held, n = [], [], 0, n + 1
                ids.append(None if pd.isna(doc) else doc)
                hashes.append(h.copy())
                held += len(h) + 1
        if ids:
            yield pd.DataFrame([_segment(f"{part}-{n}", ids, hashes)])

    return common.table_of(docs, "doc_id", "text").mapInPandas(run, f"segment string, doc_id array<{kind}>, n_words array<long>, begin array<long>, terms binary, starts binary, postings binary")


class Segment:
    def __init__(self, row):
        self.name, self.doc_id = row.segment, list(row.doc_id)
        self.n_words, self.begin = np.asarray(row.n_words, np.int64), np.asarray(row.begin, np.int64)
        self.terms = np.frombuffer(row.terms, np.uint64)
        self.starts = np.frombuffer(row.starts, np.uint32).astype(np.int64)
        self.list = np.frombuffer(row.postings, np.uint32)

    def find(self, terms: np.ndarray) -> np.ndarray:
        """Place of each term in this segment, or -1."""
        if not len(self.terms):
            return np.full(len(terms), -1)
        i = np.minimum(np.searchsorted(self.terms, terms), len(self.terms) - 1)
        return np.where(self.terms[i] == terms, i, -1)

    def positions(self, place: int) -> np.ndarray:
        return self.list[self.starts[place] : self.starts[place + 1]].astype(np.int64)

    def phrase(self, places: np.ndarray) -> np.ndarray:
        """Start positions of the phrase whose i-th word is the term at places[i]; all must be present."""
        found = None
        for i in np.argsort(self.starts[places + 1] - self.starts[places], kind="stable"):
            at = self.positions(places[i]) - i
            if found is None:
                found = at
            else:
                j = np.searchsorted(at, found)
                found = found[(j < len(at)) & (at[np.minimum(j, len(at) - 1)] == found)]
            if not len(found):
                break
        return found

    def near(self, places: np.ndarray, within: int) -> np.ndarray:
        """Positions of the rarest term with every other term at most `within` words away in the same document."""
        order = np.argsort(self.starts[places + 1] - self.starts[places], kind="stable")
        found = self.positions(places[order[0]])
        doc = np.searchsorted(self.begin, found, "right") - 1
        low, high = np.maximum(found - within, self.begin[doc]), np.minimum(found + within, self.begin[doc] + self.n_words[doc] - 1)
        keep = np.ones(len(found), bool)
        for i in order[1:]:
            at = self.positions(places[i])
            keep &= np.searchsorted(at, high, "right") > np.searchsorted(at, low, "left")
        return found[keep]


def windows_of(n: int, width: int = WINDOW) -> list[tuple[int, int]]:
    return [(i, i + width) for i in range(n - width + 1)] if n >= width else [(0, n)] if n else []


class Items:
    """A block of the query set: its distinct terms, and every item as indices into them."""

    def __init__(self, rows: list[tuple[str | None, str | None]]):
        w = common.Words([t for _, t in rows], common.IS_BREAK)
        self.terms, inverse = np.unique(w.hash, return_inverse=True)
        self.ids = [i for i, _ in rows]
        self.words = [inverse[w.first[k] : w.first[k + 1]] for k in range(len(rows))]
        self.window_item: list[int] = []
        self.by_width: dict[int, list[tuple[int, int]]] = {}
        for k, words in enumerate(self.words):
            for a, b in windows_of(len(words)):
                self.by_width.setdefault(b - a, []).append((k, a))


def blocks_of(items: DataFrame, block_words: int) -> Iterator[Items]:
    """The distinct items, block by block."""
    rows, held = [], 0
    for r in common.table_of(items, "item_id", "text").distinct().coalesce(8).toLocalIterator():
        text = r.text or ""
        rows.append((None if r.item_id is None else str(r.item_id), text))
        held += len(text) // 4 + 1
        if held >= block_words:
            yield Items(rows)
            rows, held = [], 0
    if rows:
        yield Items(rows)


def _search(index: DataFrame, held) -> DataFrame:
    """For every document with a hit: segment, place in it, hit word ranges [start, end) and the ids of the items."""

    def run(it):
        block = held.value
        grids = {width: (np.array([k for k, _ in at]), np.stack([block.words[k][a : a + width] for k, a in at])) for width, at in block.by_width.items()}
        for pdf in it:
            out = []
            for row in pdf.itertuples():
                s = Segment(row)
                place = s.find(block.terms)
                hits: dict[int, list] = {}
                for width, (item, grid) in grids.items():
                    here = place[grid]
                    for g in np.flatnonzero((here >= 0).all(axis=1)).tolist():
                        found = s.phrase(here[g])
                        doc = np.searchsorted(s.begin, found, "right") - 1
                        for d, p in zip(doc.tolist(), (found - s.begin[doc]).tolist(), strict=True):
                            hits.setdefault(d, []).append((p, p + width, int(item[g])))
                for d, h in hits.items():
                    out.append((s.name, d, [{"s": a, "e": b} for a, b in sorted({(a, b) for a, b, _ in h})], sorted({block.ids[k] for _, _, k in h if block.ids[k] is not None}), len({k for _, _, k in h})))
            yield pd.DataFrame(out, columns=["segment", "place", "hits", "items", "n"])

    return index.mapInPandas(run, "segment string, place long, hits array<struct<s:long,e:long>>, items array<string>, n long")


def documents_of(index: DataFrame) -> DataFrame:
    """segment, place, doc_id, n_words: one row per indexed document."""
    d = index.select("segment", F.posexplode(F.arrays_zip("doc_id", "n_words")).alias("place", "d"))
    return d.select("segment", F.col("place").cast("long").alias("place"), F.col("d.doc_id").alias("doc_id"), F.col("d.n_words").alias("n_words"))


def phrase_matches(index: DataFrame, items: DataFrame, block_words: int = 1 << 20, owner: str = "decontamination") -> DataFrame:
    """segment, place, hits, items of every document in which a window of an item occurs, all blocks merged.

    A block is broadcast, searched and its matches stored before the next is read; of a single block nothing is stored.
    """
    sc = index.sparkSession.sparkContext
    found, held = None, None
    for block in blocks_of(items, block_words):
        if held is not None:
            found = _stored_matches(index, held, found, owner)
            held.unpersist()
        held = sc.broadcast(block)
    if held is None:
        return index.sparkSession.createDataFrame([], "segment string, place long, hits array<struct<s:long,e:long>>, items array<string>")
    found = _search(index, held) if found is None else _stored_matches(index, held, found, owner)
    return found.groupBy("segment", "place").agg(F.flatten(F.collect_list("hits")).alias("hits"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"))


def _stored_matches(index: DataFrame, block, found: DataFrame | None, owner: str) -> DataFrame:
    one = common.stored(_search(index, block), "matches", owner)
    return one if found is None else found.unionByName(one)


def proximity_matches(index: DataFrame, terms: list[str], within: int) -> DataFrame:
    """doc_id, position: places of the rarest of the terms with all others at most `within` words away."""
    kind = index.schema["doc_id"].dataType.elementType.simpleString()
    wanted = np.unique(common.Words([" ".join(terms)], common.IS_BREAK).hash)

    def run(it):
        for pdf in it:
            out = []
            for row in pdf.itertuples():
                s = Segment(row)
                place = s.find(wanted)
                if len(place) and (place >= 0).all():
                    found = s.near(place, within)
                    doc = np.searchsorted(s.begin, found, "right") - 1
                    out += [(s.doc_id[d], p) for d, p in zip(doc.tolist(), (found - s.begin[doc]).tolist(), strict=True)]
            yield pd.DataFrame(out, columns=["doc_id", "position"])

    return index.mapInPandas(run, f"doc_id {kind}, position long")



def contamination(docs: DataFrame, items: DataFrame, segment_words: int = 1 << 18, block_words: int = 1 << 20, owner: str = "decontamination") -> DataFrame:
    """doc_id, n_words, n_hit, items (sorted), hits (merged ranges), contaminated, for every document."""
    index = common.stored(build_index(docs, segment_words), "segments", owner)
    found = common.stored(common.few(phrase_matches(index, items, block_words, owner)), "found", owner)  # its size is known from here on
    d = documents_of(index).join(found, ["segment", "place"], "left")
    ranges = F.array_sort("hits")
    step = F.aggregate(
        ranges,
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("end")),
        lambda acc, h: F.struct((acc["n"] + F.greatest(F.lit(0), h["e"] - F.greatest(h["s"], acc["end"]))).cast("long").alias("n"), F.greatest(acc["end"], h["e"]).alias("end")),
    )["n"]
    n_hit = F.coalesce(step, F.lit(0)).cast("long")
    d = d.select("doc_id", "n_words", n_hit.alias("n_hit"), F.array_sort(F.coalesce("items", F.array().cast("array<string>"))).alias("items"), F.coalesce("hits", F.array().cast("array<struct<s:long,e:long>>")).alias("hits"))
    return d.withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))


def digest(found: DataFrame) -> DataFrame:
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), "contaminated")


def drop_contaminated(docs: DataFrame, items: DataFrame, owner: str = "decontamination", **how) -> DataFrame:
    """The documents that are not contaminated, with all their columns; rows are matched by doc_id, null included."""
    bad = contamination(docs, items, owner=owner, **how).where("contaminated").select("doc_id")
    return common.without(docs, bad, owner)
