"""Centroid clustering of integer vectors with Hamerly's bounds, exact in every assignment.

Each vector keeps one upper bound on the distance to its centroid and one lower bound on the distance to any other. After
the centroids have moved, the upper bound grows by its own centroid's drift and the lower one shrinks by the largest drift
of the others. While the upper bound is below the lower one the assignment cannot have changed and nothing is computed; else
the upper bound is made exact, and a vector that is still ambiguous, ties included, is compared with all centroids in whole
numbers. Bounds are rounded outwards, so they only save work and never decide. Vectors and bounds are a table in the shared
folder, written anew each round; the centroids, CLUSTERS times DIMS numbers, are all that the driver holds. Sums are carried
on from round to round by the vectors that have moved, added up within tasks before they are dealt.

Distances of vectors below 2**23 are matrix products of doubles, exact because every sum stays below 2**53; larger ones
are computed with Python's integers.

Defined results: a vector with another number of components, or with a null or non-finite one, gives no row; rows without
vec_id count as `seed:` when the first centroids are chosen, equal ids are ordered by their components; equal vectors may
give equal centroids, of which the smaller number takes all; fewer vectors than clusters give as many centroids as vectors;
distances and sums beyond a long are null; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from decimal import Decimal

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

CLUSTERS, ROUNDS, DIMS, SCALE, SEED = 40, 5, 64, 256, "2"
SMALL = 1 << 23
LIMB = 60
#: Relative room for the rounding of square roots, sums and differences of bounds.
ROOM = 1e-12


def kept(vectors: DataFrame, dims: int = DIMS) -> DataFrame:
    """vec_id, x: the vectors with dims components that are all finite numbers."""
    d = common.table_of(vectors, "vec_id", "embedding").select("vec_id", F.col("embedding").cast("array<double>").alias("x"))
    finite = F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return d.where((F.size("x") == dims) & F.coalesce(finite, F.lit(False)))


def whole(x: float, scale: int = SCALE) -> int:
    """floor(scale * x), without overflow."""
    a, b = float(x).as_integer_ratio()
    return scale * a // b


def integers(rows) -> list[bytes]:
    """Each vector of doubles in whole numbers: 32-bit ones if all are small, else decimal digits after a mark."""
    x = np.stack([np.asarray(r, np.float64) for r in rows])
    small = (np.abs(x) < SMALL // SCALE - 1).all(1)
    v = np.floor(np.where(small[:, None], x, 0) * SCALE).astype("<i4")
    return [b"\0" + v[i].tobytes() if small[i] else b"\1" + ",".join(str(whole(c)) for c in x[i]).encode() for i in range(len(x))]


def read(packed) -> tuple[np.ndarray, np.ndarray, list[list[int]]]:
    """Which rows are small, the small rows as an array, and the others as lists."""
    small = np.array([b[0] == 0 for b in packed], bool)
    v = np.frombuffer(b"".join(bytes(b[1:]) for b, s in zip(packed, small, strict=True) if s), "<i4").reshape(int(small.sum()), -1)
    return small, v, [[int(c) for c in bytes(b[1:]).split(b",")] for b, s in zip(packed, small, strict=True) if not s]


def _root(d) -> float:
    """Square root of a whole number as a double; infinite where there is none."""
    try:
        return math.sqrt(d)
    except OverflowError:
        return math.inf


def _roots(d: np.ndarray) -> np.ndarray:
    return np.array([_root(x) for x in d], np.float64) if d.dtype == object else np.sqrt(d.astype(np.float64))


class Centroids:
    def __init__(self, rows: list[list[int]]):
        self.rows = rows
        self.small = all(-SMALL < c < SMALL for r in rows for c in r)
        if self.small:
            self.c = np.array(rows, np.float64)
            self.norm = (self.c**2).sum(1)

    def all(self, v: np.ndarray) -> np.ndarray:
        """Squared distances of small vectors to all centroids."""
        if self.small:
            x = v.astype(np.float64)
            return ((x**2).sum(1)[:, None] + self.norm[None] - 2 * (x @ self.c.T)).astype(np.int64)
        return np.array([self.each(r) for r in v.tolist()], object).reshape(len(v), len(self.rows))

    def each(self, r: list[int]) -> list[int]:
        return [sum((a - b) ** 2 for a, b in zip(r, c, strict=True)) for c in self.rows]

    def own(self, v: np.ndarray, which: np.ndarray) -> np.ndarray:
        """Squared distances of small vectors to one centroid each."""
        if self.small:
            return ((v - self.c[which]) ** 2).sum(1).astype(np.int64)
        return np.array([sum((a - b) ** 2 for a, b in zip(r, self.rows[k], strict=True)) for r, k in zip(v.tolist(), which.tolist(), strict=True)], object)

    def drift(self, new: list[list[int]]) -> list[float]:
        return [_root(sum((a - b) ** 2 for a, b in zip(r, s, strict=True))) * (1 + ROOM) for r, s in zip(self.rows, new, strict=True)]


def _scan(d: np.ndarray):
    """(nearest, smaller number on ties; upper bound; lower bound) for rows of squared distances."""
    k = d.argmin(1)
    rows = np.arange(len(d))
    best = d[rows, k]
    rest = d.astype(object) if d.dtype == object else d.astype(np.float64)
    rest[rows, k] = np.inf
    return k, _roots(best) * (1 + ROOM), _roots(rest.min(1)) * (1 - ROOM)


def assign(state: DataFrame, centroids: list[list[int]], drift: list[float], last: bool) -> DataFrame:
    """The state after one round: was (the cluster before), cluster, upper, lower, and the distance in the last one."""
    kind = state.schema["vec_id"].dataType.simpleString()
    held = state.sparkSession.sparkContext.broadcast((centroids, np.array(drift)))

    def run(it):
        rows, drift = held.value
        c = Centroids(rows)
        others = np.array([max([*drift[:k], *drift[k + 1 :]], default=0.0) for k in range(len(rows))])
        for pdf in it:
            if not len(pdf):
                continue
            small, v, large = read(pdf["v"])
            was = pdf["cluster"].to_numpy(np.int64)
            cluster, dist = was.copy(), np.zeros(len(was), np.int64 if c.small and small.all() else object)
            known = was >= 0
            upper, lower = pdf["upper"].to_numpy(np.float64).copy(), pdf["lower"].to_numpy(np.float64).copy()
            upper[known] = (upper[known] + drift[was[known]]) * (1 + ROOM)
            lower[known] -= others[was[known]] + ROOM * (lower[known] + others[was[known]])
            ask = ~known | ~(upper < lower)
            for rows_of, numbers in ((np.flatnonzero(small), v), (np.flatnonzero(~small), None)):
                here = ask[rows_of]
                tighten = np.flatnonzero(here & known[rows_of])
                if len(tighten):
                    at = rows_of[tighten]
                    d = c.own(numbers[tighten], was[at]) if numbers is not None else np.array([c.each(large[i])[was[x]] for i, x in zip(tighten, at, strict=True)], object)
                    upper[at] = _roots(d) * (1 + ROOM)
                    here[tighten] = ~(upper[at] < lower[at])
                here = np.flatnonzero(here)
                if len(here):
                    at = rows_of[here]
                    d = c.all(numbers[here]) if numbers is not None else np.array([c.each(large[i]) for i in here], object)
                    cluster[at], upper[at], lower[at] = _scan(d)
                if last and len(rows_of):
                    dist[rows_of] = c.own(numbers, cluster[rows_of]) if numbers is not None else [c.each(large[i])[cluster[x]] for i, x in enumerate(rows_of)]
            out = pdf[["vec_id"]].assign(v=pdf["v"], was=was, cluster=cluster, upper=upper, lower=lower)
            if last:
                out["distance"] = pd.array(dist if dist.dtype != object else [int(d) if d < 1 << 63 else None for d in dist], "Int64")
            yield out

    return state.mapInPandas(run, f"vec_id {kind}, v binary, was int, cluster int, upper double, lower double" + ", distance long" * last)


def moved_sums(state: DataFrame, first: bool) -> dict[tuple[int, int], int]:
    """(cluster, component) -> change of the sum, with component -1 for the count; of all vectors in the first round."""

    def run(it):
        sums: dict[int, list[int]] = {}

        def add(which, v, large, sign):
            for k in np.unique(which).tolist():
                mine = which == k
                s = sums.setdefault(k, [0] * (v.shape[1] + 1 if len(v) else len(large[0]) + 1))
                for j, x in enumerate([*(v[mine].astype(np.int64).sum(0).tolist() if large is None else (sum(r[i] for r, m in zip(large, mine, strict=True) if m) for i in range(len(large[0])))), int(mine.sum())]):
                    s[j] += sign * x

        for pdf in it:
            small, v, large = read(pdf["v"])
            for sign, column in ((1, "cluster"), (-1, "was")) if not first else ((1, "cluster"),):
                which = pdf[column].to_numpy(np.int64)
                if len(v):
                    add(which[small], v, None, sign)
                if large:
                    add(which[~small], v[:0], large, sign)
        out = []
        for k, s in sums.items():
            for j, x in enumerate(s):
                y, limb = abs(x), 0
                while y:
                    out.append((k, j if j < len(s) - 1 else -1, limb, Decimal((1 if x > 0 else -1) * (y & (1 << LIMB) - 1))))
                    y, limb = y >> LIMB, limb + 1
        if out:
            yield pd.DataFrame(out, columns=["cluster", "j", "limb", "s"])

    rows = state if first else state.where("cluster <> was")
    d = rows.select("v", "was", "cluster").mapInPandas(run, "cluster int, j int, limb int, s decimal(38,0)").groupBy("cluster", "j", "limb").agg(F.sum("s").alias("s"))
    out: dict[tuple[int, int], int] = {}
    for r in d.collect():  # a row for each cluster, component and limb
        out[r.cluster, r.j] = out.get((r.cluster, r.j), 0) + (int(r.s) << LIMB * r.limb)
    return out


def cluster(vectors: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, dims: int = DIMS, seed: str = SEED, owner: str = "hamerly") -> tuple[DataFrame, list[list[int]]]:
    """(vec_id, cluster, distance, squared, after the last assignment; the centroids)."""
    spark = vectors.sparkSession
    found = kept(vectors, dims)
    kind = found.schema["vec_id"].dataType.simpleString()
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    centroids = [[whole(c) for c in r.x] for r in found.select("x", order.alias("_h")).orderBy("_h", "x").limit(clusters).collect()]
    if not centroids:
        return spark.createDataFrame([], f"vec_id {kind}, cluster int, distance long"), []

    def start(it):
        for pdf in it:
            if len(pdf):
                yield pd.DataFrame({"vec_id": pdf["vec_id"].to_numpy(), "v": integers(pdf["x"]), "cluster": -1, "upper": np.inf, "lower": -np.inf})

    state = found.mapInPandas(start, f"vec_id {kind}, v binary, cluster int, upper double, lower double")
    sums: dict[tuple[int, int], int] = {}
    drift = [0.0] * len(centroids)
    for r in range(rounds + 1):
        new = common.stored(assign(state, centroids, drift, r == rounds), "bounds", owner)
        if r:
            common.drop_stored(state)
        state = new
        if r < rounds:
            for k, x in moved_sums(state, r == 0).items():
                sums[k] = sums.get(k, 0) + x
            count = [sums.get((k, -1), 0) for k in range(len(centroids))]
            moved = [[sums.get((k, j), 0) // n for j in range(dims)] if n else c for k, (n, c) in enumerate(zip(count, centroids, strict=True))]
            drift = Centroids(centroids).drift(moved)
            centroids = moved
    return state.select("vec_id", "cluster", "distance"), centroids


def digest(vectors: DataFrame) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256."""
    found, centroids = cluster(vectors)
    total = F.when(F.count("distance") == F.count(F.lit(1)), F.sum(F.col("distance").cast("decimal(38,0)")))
    per = {r.cluster: r.s for r in found.groupBy("cluster").agg(total.alias("s")).collect()}  # one row per cluster
    fits = lambda x: None if x is None or x >= 1 << 63 else int(x)
    inertia = None if None in per.values() else sum(per.values())
    rows = [(k, fits(per.get(k)), fits(inertia), hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for k, c in enumerate(centroids)]
    named = vectors.sparkSession.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(named), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
