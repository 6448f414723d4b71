"""Exact similarity search by pivots: vectors are dealt to the nearest pivot, and the triangle inequality says which cells can meet.

The distance is the chord between unit vectors, d * d = 2 - 2 * cosine. A vector y of cell q is no nearer to anything in
cell p than (d(y, p)**2 - d(y, q)**2) / (2 * d(p, q)), so it visits only cells for which this is within the radius asked for.
Where vectors lie so that most cells must be visited, as in many dimensions, that moves more rows than it saves pairs: the
visits are counted first, and if blocks of all vectors cost less, every two blocks meet, as matrices (see in_blocks()).
Pivots are vectors of the table, at most PIVOTS of them, so what is broadcast has a fixed size. Large cells are cut into
blocks, and a task holds one block of each side. Bounds have room for rounding; similarities decide. Vectors without
length are alike to none: they have a cell of their own, NONE, and a similarity of 0 to everything.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .durable import cut

PIVOTS, CELL, BLOCK, NONE = 1024, 256, 2048, -1
#: Rows of a batch whose distances to all pivots are held at once, and rows that leave a task in one batch.
HELD = 1024
#: Bytes of the vectors of a block of matrices, and vectors of one row of it; the sides of what is multiplied at once.
BLOCK_BYTES, PACK = 16 << 20, 128
TILE = (512, 4096)
#: Pairs of vectors that take as long as moving one vector.
MOVE = 1000
#: Rows up to which all vectors meet: two blocks of them a side are less work than cells.
FEW = 2 * BLOCK
ROOM = 1e-7


def _array(column) -> np.ndarray:
    return np.array(column.tolist(), np.float64)


def _unit(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n = np.linalg.norm(v, axis=1)
    return v / np.where(n == 0, 1, n)[:, None], n


def pivots(vectors: DataFrame, n: int | None = None) -> np.ndarray:
    """Unit vectors of the rows (vec_id, v) with the smallest hashes, one for about CELL rows; none for a table of FEW rows."""
    if n is None:
        count = vectors.count()
        if count <= FEW:
            return np.zeros((0, 0))
        n = min(PIVOTS, count // CELL)
    some = F.exists("v", lambda x: x != 0)
    rows = vectors.where(some).select("v", F.xxhash64("vec_id").alias("h")).orderBy("h", "v").limit(n).collect()
    return _unit(_array(pd.Series([r.v for r in rows])))[0] if rows else np.zeros((0, 0))


class Cells:
    """Distances to the pivots, and what they say."""

    def __init__(self, pivots_: np.ndarray):
        self.p = pivots_
        self.between = np.sqrt(np.maximum(0, 2 - 2 * pivots_ @ pivots_.T)) if len(pivots_) else np.zeros((0, 0))

    def place(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(home, distances to all pivots, whether there is a length)."""
        u, n = _unit(v)
        if not len(self.p):
            return np.full(len(v), NONE), np.zeros((len(v), 0)), n > 0
        d = np.sqrt(np.maximum(0, 2 - 2 * u @ self.p.T))
        return np.where(n > 0, d.argmin(1), NONE), d, n > 0

    def reach(self, home: np.ndarray, d: np.ndarray) -> np.ndarray:
        """For each vector and cell the least distance that anything in the cell can have."""
        own = d[np.arange(len(d)), home][:, None]
        apart = self.between[home]
        with np.errstate(divide="ignore", invalid="ignore"):
            bound = (d**2 - own**2) / (2 * apart)
        return np.where(apart > 0, np.maximum(bound, 0), 0)


def pieces(frames, n: int = HELD):
    """Batches of at most n rows."""
    for pdf in frames:
        for at in range(0, len(pdf), n):
            yield pdf.iloc[at : at + n]


def placed(vectors: DataFrame, cells: Cells) -> DataFrame:
    """vec_id, v, cell, d (distance to the cell's pivot)."""
    held = vectors.sparkSession.sparkContext.broadcast(cells)

    def run(it):
        for pdf in pieces(it):
            home, d, some = held.value.place(_array(pdf["v"]))
            yield pdf.assign(cell=home, d=d[np.arange(len(d)), home] if d.shape[1] else 0.0)

    return vectors.select("vec_id", F.col("v").cast("array<double>").alias("v")).mapInPandas(run, "vec_id long, v array<double>, cell int, d double")


def _sent(frames, visited, n_cells: int, names: list[str], counted: bool):
    """Each row once for every cell that visited(piece) -> (mask of rows and cells, further columns) says, NONE after the last
    pivot; counted: only cell, n, the number of its visits."""
    total = np.zeros(n_cells + 1, np.int64)
    for pdf in pieces(frames):
        mask, more = visited(pdf)
        if counted:
            total[: mask.shape[1]] += mask.sum(0)
            continue
        i, cell = np.nonzero(mask)
        for at in range(0, len(i), HELD):
            r, c = i[at : at + HELD], cell[at : at + HELD]
            yield pd.DataFrame({"vec_id": pdf["vec_id"].to_numpy()[r], "v": pdf["v"].to_numpy()[r], "cell": np.where(c == n_cells, NONE, c)} | {k: x[r] for k, x in more.items()})[names]
    if counted:
        at = np.flatnonzero(total)
        yield pd.DataFrame({"cell": np.where(at == n_cells, NONE, at), "n": total[at]})


def visits(rows: DataFrame, cells: Cells, radius: float, counted: bool = False) -> DataFrame:
    """placed rows with home, once for each other cell that they can be within the radius of; those without length for all.
    counted: only how often each cell is visited (cell, n), in several rows."""
    held = rows.sparkSession.sparkContext.broadcast(cells)

    def run(it):
        c = held.value

        def visited(pdf):
            home, d, some = c.place(_array(pdf["v"]))
            near = np.where(some[:, None], c.reach(np.where(some, home, 0), d) <= radius + ROOM, True)
            near[np.flatnonzero(some), home[some]] = False
            return near, {"home": home}

        if len(c.p):
            yield from _sent(it, visited, len(c.p), ["vec_id", "v", "cell", "home"], counted)

    return rows.select("vec_id", "v").mapInPandas(run, "cell int, n long" if counted else "vec_id long, v array<double>, cell int, home int")


def _by_cell(counts: DataFrame) -> dict[int, int]:
    return {r.cell: r.n for r in counts.groupBy("cell").agg(F.sum("n").alias("n")).collect()}  # one row per cell


def packs(vectors: DataFrame) -> tuple[DataFrame, int, int]:
    """(c, n, width, ids, data: up to PACK vectors in one row, as bytes; the number of vectors; their components)."""

    def run(it):
        for pdf in pieces(it, PACK):
            v = _array(pdf["v"])
            with np.errstate(over="ignore"):
                short = v.astype(np.float32)
            v = short if np.array_equal(short, v) else v
            ids = np.ascontiguousarray(pdf["vec_id"].to_numpy(np.int64))
            yield pd.DataFrame({"n": [len(pdf)], "width": [v.itemsize], "ids": [ids.tobytes()], "data": [v.tobytes()]})

    d = vectors.select("vec_id", "v").mapInPandas(run, "n int, width int, ids binary, data binary")
    d = cut(d.withColumn("c", F.monotonically_increasing_id()))
    total = d.agg(F.sum("n").alias("n"), F.max(F.length("data") / F.col("n") / F.col("width")).alias("m")).first()
    return d, total.n or 0, int(total.m or 0)


def _blocks(n: int, m: int, least: int = 1) -> int:
    """Blocks of n vectors of m components: of BLOCK_BYTES at most, `least` of them unless they would hold less than BLOCK vectors."""
    return max(1, -(-n * m * 8 // BLOCK_BYTES), min(least, n // BLOCK))


def in_blocks(left: DataFrame, right: DataFrame | None, n: int, m: int, run, schema: str) -> DataFrame:
    """run(ids, vectors, ids, vectors, same) -> frames, for every two blocks of packs(): n of the left side and m of the right;
    without a right side each two blocks of the left one once, and each with itself (same).

    A block is dealt to the tasks of its row and column, as bytes, and a task holds two of them.
    """
    spark = left.sparkSession
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "8m")
    every = lambda k: F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    own = lambda k: F.pmod(F.xxhash64("c"), F.lit(k)).cast("int")
    if right is None:
        # (i, j) with i <= j is number j * (j + 1) / 2 + i
        rows = left.withColumn("own", own(n)).withColumn("other", every(n)).withColumn("i", F.least("own", "other")).withColumn("j", F.greatest("own", "other"))
        rows = rows.withColumn("task", F.expr("cast(j * (j + 1) div 2 + i as int)")).withColumn("side", (F.col("own") != F.col("i")).cast("int")).withColumn("same", F.col("i") == F.col("j"))
        tasks = n * (n + 1) // 2
    else:
        l = left.withColumn("i", own(n)).withColumn("j", every(m)).withColumn("side", F.lit(0))
        r = right.withColumn("j", own(m)).withColumn("i", every(n)).withColumn("side", F.lit(1))
        rows = l.unionByName(r).withColumn("task", F.col("i") * m + F.col("j")).withColumn("same", F.lit(False))
        tasks = n * m

    def block(packed: list) -> tuple[np.ndarray, np.ndarray]:
        ids = np.concatenate([np.frombuffer(ids, np.int64) for ids, _, _ in packed])
        v = np.concatenate([np.frombuffer(data, np.float32 if width == 4 else np.float64).reshape(len(ids) // 8, -1) for ids, data, width in packed])
        return ids, v

    def go(it):
        import pyarrow as pa

        sides: tuple[list, list] = ([], [])
        same, tasks = False, set()
        for batch in it:
            for task, side, ids, data, width, s in zip(*[batch.column(c).to_pylist() for c in ("task", "side", "ids", "data", "width", "same")], strict=True):
                sides[side].append((ids, data, width))
                same = s
                tasks.add(task)
        if len(tasks) > 1:
            raise RuntimeError("two tasks in one partition")
        if not sides[0] or not (same or sides[1]):
            return
        a = block(sides[0])
        b = a if same else block(sides[1])
        sides[0].clear()
        sides[1].clear()
        for pdf in run(*a, *b, same):
            if len(pdf):
                yield pa.RecordBatch.from_pandas(pdf, preserve_index=False)

    return rows.select("task", "side", "same", "ids", "data", "width").repartitionById(tasks, "task").mapInArrow(go, schema)


def _tiles(a: np.ndarray, b: np.ndarray, same: bool):
    """(first row, first row of the other, their products) of two blocks in pieces; of the same one those with a later row."""
    for x in range(0, len(a), TILE[0]):
        top = a[x : x + TILE[0]]
        for y in range(x if same else 0, len(b), TILE[1]):
            s = top @ b[y : y + TILE[1]].T
            if same and y < x + len(top):
                s[np.arange(s.shape[0])[:, None] + x >= np.arange(s.shape[1])[None] + y] = -np.inf
            yield x, y, s


def meet(left: DataFrame, right: DataFrame, run, schema: str, block: int = BLOCK) -> DataFrame:
    """run(left block, right block) -> rows, for every two blocks of a cell; both sides have vec_id, v and cell."""
    spark = left.sparkSession
    count = lambda d, n: d.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias(n))
    blocks = count(left, "_i").join(count(right, "_j"), "cell").collect()  # one row per cell
    sizes = F.broadcast(spark.createDataFrame([tuple(r) for r in blocks], "cell int, _i int, _j int"))
    mine = lambda n: F.pmod(F.xxhash64("vec_id"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    l = left.join(sizes, "cell").withColumns({"i": mine("_i")}).withColumn("j", every("_j")).drop("_i", "_j").withColumn("side", F.lit(0))
    r = right.join(sizes, "cell").withColumns({"j": mine("_j")}).withColumn("i", every("_i")).drop("_i", "_j").withColumn("side", F.lit(1))

    def both(pdf):
        a, b = pdf[pdf["side"] == 0], pdf[pdf["side"] == 1]
        return run(a, b) if len(a) and len(b) else pd.DataFrame({c.split()[0]: [] for c in schema.split(", ")})

    return l.unionByName(r, allowMissingColumns=True).groupBy("cell", "i", "j").applyInPandas(both, schema)


def _pairs(least: float):
    """The pairs of two blocks that are alike enough, each once: see similar_pairs()."""

    def run(x, y):
        a, b = _unit(_array(x["v"]))[0], _unit(_array(y["v"]))[0]
        p, q = np.nonzero((s := a @ b.T) >= least)
        i, j = x["vec_id"].to_numpy()[p], y["vec_id"].to_numpy()[q]
        mine, other = x["home"].to_numpy()[p], y["home"].to_numpy()[q]
        keep = np.where(mine == other, i < j, (other > mine) | (other == NONE))
        return pd.DataFrame({"a": np.minimum(i, j), "b": np.maximum(i, j), "similarity": s[p, q]})[keep & (i != j)]

    return run


def _block_pairs(least: float):
    def run(ids, v, others, w, same):
        a = _unit(v.astype(np.float64))[0]
        b = a if same else _unit(w.astype(np.float64))[0]
        for x, y, s in _tiles(a, b, same):
            p, q = np.nonzero(s >= least)
            i, j = ids[p + x], others[q + y]
            yield pd.DataFrame({"a": np.minimum(i, j), "b": np.maximum(i, j), "similarity": s[p, q]})[i != j]

    return run


def _block_links(least: float):
    """Of two blocks a pair (member, another of the same group) for all but one of each group that pairs connect."""

    def run(ids, v, others, w, same):
        a = _unit(v.astype(np.float64))[0]
        b = a if same else _unit(w.astype(np.float64))[0]
        label = np.arange(len(a) + (0 if same else len(b)))
        for x, y, s in _tiles(a, b, same):
            p, q = np.nonzero(s >= least)
            p, q = p + x, q + y + (0 if same else len(a))
            while len(p):
                far = label[p] != label[q]
                p, q = p[far], q[far]
                low, high = np.minimum(label[p], label[q]), np.maximum(label[p], label[q])
                np.minimum.at(label, high, low)
                while (label[label] != label).any():
                    label = label[label]
        names = ids if same else np.concatenate([ids, others])
        i, j = names[label], names
        for at in range(0, len(i), 1 << 16):
            x, y = i[at : at + (1 << 16)], j[at : at + (1 << 16)]
            yield pd.DataFrame({"a": np.minimum(x, y), "b": np.maximum(x, y)})[x != y]

    return run


def _two_sided(spark) -> int:
    """Blocks from which on their pairs are three tasks a core."""
    return int(np.ceil(np.sqrt(6 * spark.sparkContext.defaultParallelism)))


def _in_cells(vectors: DataFrame, least: float, n_pivots: int | None, work: list | None = None) -> tuple[DataFrame, DataFrame] | None:
    """(own, own and visiting rows) if cells are the cheaper way, or if a number of pivots is asked for; else None."""
    cells = Cells(pivots(vectors, n_pivots))
    if not len(cells.p):
        rows = placed(vectors, cells).drop("d")
        own = rows.withColumn("home", F.col("cell"))
        return own, own
    rows = cut(placed(vectors, cells).drop("d"))
    radius = float(np.sqrt(max(0.0, 2 - 2 * least)))
    own = rows.withColumn("home", F.col("cell"))
    some = rows if least <= 0 else rows.where(F.col("cell") != NONE)
    size, sent = _by_cell(rows.select("cell", F.lit(1).alias("n"))), _by_cell(visits(some, cells, radius, counted=True))
    n = sum(size.values())
    met = sum(k * (k - 1) // 2 + k * sent.get(c, 0) for c, k in size.items())
    if work is not None:
        work.extend([met, n * (n - 1) / 2])
    moved = n + sum(sent.values())
    if n_pivots is None and MOVE * moved + met > MOVE * n * _blocks(n, cells.p.shape[1], _two_sided(vectors.sparkSession)) + n * (n - 1) / 2:
        return None
    return own, own.unionByName(visits(some, cells, radius))


def similar_pairs(vectors: DataFrame, least: float, block: int = BLOCK, n_pivots: int | None = None, work: list | None = None) -> DataFrame:
    """a < b with cosine >= least, exactly. vectors: vec_id, v. `work` gets the number of pairs of vectors that meet in cells
    and of all pairs."""
    if (sides := _in_cells(vectors, least, n_pivots, work)) is not None:
        return meet(*sides, _pairs(least), "a long, b long, similarity double", block)
    rows, n, m = packs(vectors)
    return in_blocks(rows, None, _blocks(n, m, _two_sided(vectors.sparkSession)), 0, _block_pairs(least), "a long, b long, similarity double")


def similar_links(vectors: DataFrame, least: float, block: int = BLOCK, n_pivots: int | None = None) -> DataFrame:
    """a < b: pairs that connect what the pairs of similar_pairs() connect, and nothing else. Blocks give at most one for
    each of their vectors, so their number does not grow with that of the pairs."""
    if (sides := _in_cells(vectors, least, n_pivots)) is not None:
        return meet(*sides, _pairs(least), "a long, b long, similarity double", block).select("a", "b")
    rows, n, m = packs(vectors)
    return in_blocks(rows, None, _blocks(n, m, _two_sided(vectors.sparkSession)), 0, _block_links(least), "a long, b long")


def nearest(queries: DataFrame | None, vectors: DataFrame, k: int, least: float, block: int, n_pivots: int | None = None) -> DataFrame:
    """query_id, rank, vec_id, similarity: see vectors.nearest(). Without queries, when all vectors ask, two blocks of matrices
    meet once for the neighbours of both.

    Of each cell the k + 1 distances nearest to the pivot are known, so the distance of a query to the pivots bounds the one
    to its k-th neighbour, and it visits only cells within that bound.
    """
    spark = vectors.sparkSession
    least = least if least > -1 else -np.inf  # opposite vectors may be a rounding below -1
    cells = Cells(pivots(vectors, n_pivots))
    rows = placed(vectors, cells)

    def own(packed, n, m):
        return _best(in_blocks(packed, None, _blocks(n, m, _two_sided(spark)), 0, _own_near(k, least), "query_id long, vec_id long, similarity double"), k)

    if queries is None:
        if not len(cells.p):
            return own(*packs(vectors))
        named = vectors.select("vec_id", F.col("v").cast("array<double>").alias("v"))
    elif not len(cells.p):
        asked = queries.select(F.col("query_id").alias("vec_id"), F.col("q").cast("array<double>").alias("v"), F.lit(NONE).alias("cell"))
        return _best(meet(asked, rows.select("vec_id", "v", "cell"), _near(k, least), "query_id long, vec_id long, similarity double", block), k)
    rows = cut(rows)
    order = W.partitionBy("cell").orderBy("d", "vec_id")
    first = rows.where(F.col("cell") != NONE).select("cell", "d", F.row_number().over(order).alias("r")).where(F.col("r") <= k + 1)
    lists = np.full((len(cells.p), k + 1), np.inf)
    for r in first.collect():  # k + 1 numbers a cell
        lists[r.cell, r.r - 1] = r.d
    size = {r.cell: r.d for r in rows.groupBy("cell").agg(F.max("d").alias("d")).collect()}  # one row per cell
    held = spark.sparkContext.broadcast((cells, lists, np.array([size.get(c, -np.inf) for c in range(len(cells.p))]), NONE in size))

    def go(it, counted=False):
        c, lists, size, some_none = held.value
        most = np.sqrt(max(0.0, 2 - 2 * least))

        def visited(pdf):
            home, d, some = c.place(_array(pdf["v"]))
            out = np.zeros((len(pdf), len(c.p) + 1), bool)
            # d(query, pivot) + d(pivot, vector), the k + 1 smallest of all: one of them may be the query itself
            bound = np.stack([np.partition((x[:, None] + lists).ravel(), k)[k] for x in d])
            bound = np.where(some, np.minimum(bound, most), np.inf) + ROOM
            near = (c.reach(np.where(some, home, 0), d) <= bound[:, None]) & (d - size[None] <= bound[:, None])
            out[:, :-1] = np.where(some[:, None], near, True)
            out[:, -1] = (~some | (bound >= np.sqrt(2))) & some_none
            return out, {}

        yield from _sent(it, visited, len(c.p), ["vec_id", "v", "cell"], counted)

    if queries is not None:
        named = queries.select(F.col("query_id").alias("vec_id"), F.col("q").cast("array<double>").alias("v"))
    if n_pivots is None:
        sent = _by_cell(named.mapInPandas(lambda it: go(it, True), "cell int, n long"))
        held_by = _by_cell(rows.select("cell", F.lit(1).alias("n")))
        n, dims = sum(held_by.values()), cells.p.shape[1]
        visited = MOVE * (n + sum(sent.values())) + sum(held_by.get(c, 0) * x for c, x in sent.items())
        if queries is None:
            if visited > MOVE * n * _blocks(n, dims, _two_sided(spark)) + n * n / 2:
                return own(*packs(vectors))
        else:
            asking, nq, _ = packs(named)
            i, j = _blocks(nq, dims), _blocks(n, dims, 3 * spark.sparkContext.defaultParallelism)
            if visited > MOVE * (n * i + nq * j) + n * nq:
                return _best(in_blocks(asking, packs(vectors)[0], i, j, _block_near(k, least), "query_id long, vec_id long, similarity double"), k)
    asked = named.mapInPandas(go, "vec_id long, v array<double>, cell int")
    found = meet(asked, rows.select("vec_id", "v", "cell"), _near(k, least), "query_id long, vec_id long, similarity double", block)
    return _best(found, k)


def _block_near(k: int, least: float):
    """The k vectors of a block that are most similar to each query of another. Products say which can be among them, and the
    similarity of those is summed row by row, so that equal vectors are equally similar wherever they lie."""

    def run(ids, q, others, v, same):
        q, v = q.astype(np.float64), v.astype(np.float64)
        m, n = np.linalg.norm(q, axis=1), np.linalg.norm(v, axis=1)
        for x in range(0, len(q), TILE[0]):
            best = None
            for y in range(0, len(v), TILE[1]):
                lengths = m[x : x + TILE[0], None] * n[None, y : y + TILE[1]]
                s = np.where(lengths == 0, 0.0, q[x : x + TILE[0]] @ v[y : y + TILE[1]].T / np.where(lengths == 0, 1, lengths))
                s[ids[x : x + TILE[0], None] == others[None, y : y + TILE[1]]] = -np.inf
                floor = np.maximum(np.partition(s, -k, axis=1)[:, -k], least) if s.shape[1] > k else np.full(len(s), least)
                if best is not None:  # the k-th of what came before
                    floor = np.maximum(floor, best[1])
                p, r = np.nonzero(s >= floor[:, None] - ROOM)
                p, r = p + x, r + y
                some = m[p] * n[r]
                exact = np.where(some == 0, 0.0, np.einsum("ij,ij->i", q[p], v[r]) / np.where(some == 0, 1, some))
                ok = exact >= least
                rows = np.stack([p[ok], r[ok]])
                exact = exact[ok]
                if best is not None:
                    rows, exact = np.concatenate([best[0][0], rows], axis=1), np.concatenate([best[0][1], exact])
                order = np.lexsort((others[rows[1]], -exact, rows[0]))
                rows, exact = rows[:, order], exact[order]
                first = np.searchsorted(rows[0], rows[0], "left")
                rank = np.arange(len(first)) - first
                kth = np.full(len(s), -np.inf)
                kth[rows[0][rank == k - 1] - x] = exact[rank == k - 1]
                best = ((rows[:, rank < k], exact[rank < k]), kth)
            if best is not None:
                (rows, exact), _ = best
                yield pd.DataFrame({"query_id": ids[rows[0]], "vec_id": others[rows[1]], "similarity": exact})

    return run


class _Side:
    """A block of vectors that ask, and the k + 1 best that were found for each, itself among them. Of equal vectors those with
    the k + 1 smallest ids stand for all: they are the first of any order, and what is best for one is best for all."""

    def __init__(self, ids: np.ndarray, v: np.ndarray, k: int, least: float):
        order = np.argsort(ids, kind="stable")
        self.all, v = ids[order], v[order].astype(np.float64) + 0.0  # no -0.0
        if not v.shape[1]:
            v = np.zeros((len(v), 1))
        _, group = np.unique(np.ascontiguousarray(v).view(np.dtype((np.void, v.itemsize * v.shape[1]))).ravel(), return_inverse=True)
        by = np.argsort(group, kind="stable")
        first = np.searchsorted(group[by], group[by], "left")
        some = np.zeros(len(v), bool)
        some[by[np.arange(len(by)) - first <= k]] = True
        #: the row that stands for each vector
        self.of = np.empty(len(v), np.int64)
        self.of[by] = (np.cumsum(some) - 1)[by[first]]
        self.ids, self.v = self.all[some], np.ascontiguousarray(v[some])
        unit, self.n = _unit(self.v)
        self.unit = unit.astype(np.float32)
        self.k, self.least, self.room = k, least, (v.shape[1] + 2) * float(np.finfo(np.float32).eps)
        self.best, self.found = np.full((len(self.v), k + 1), -np.inf), np.zeros((len(self.v), k + 1), np.int64)

    def floor(self, at: int, s: np.ndarray) -> np.ndarray:
        """What a product must reach to be looked at, for the rows from `at` on with the products s."""
        low = self.best[at : at + len(s), -1]
        if s.shape[1] > self.k and np.isinf(low).any():
            low = np.maximum(low, np.partition(s, -self.k - 1, axis=1)[:, -self.k - 1])
        return (np.maximum(low, self.least) - self.room).astype(np.float32)

    def take(self, rows: np.ndarray, found: np.ndarray, exact: np.ndarray) -> None:
        last = self.best[rows, -1]
        ok = (exact >= self.least) & ((exact > last) | (exact == last) & (found < self.found[rows, -1]))
        if not ok.any():
            return
        at, row = np.unique(rows[ok], return_inverse=True)
        row = np.concatenate([row, np.repeat(np.arange(len(at)), self.k + 1)])
        best, found = np.concatenate([exact[ok], self.best[at].ravel()]), np.concatenate([found[ok], self.found[at].ravel()])
        order = np.lexsort((found, -best, row))
        row, best, found = row[order], best[order], found[order]
        rank = np.arange(len(row)) - np.searchsorted(row, row, "left")
        ok = rank <= self.k
        self.best[at[row[ok]], rank[ok]], self.found[at[row[ok]], rank[ok]] = best[ok], found[ok]

    def frames(self):
        for at in range(0, len(self.all), 1 << 14):
            ids, row = self.all[at : at + (1 << 14)], self.of[at : at + (1 << 14)]
            best, found = self.best[row], self.found[row]
            ok = (best > -np.inf) & (found != ids[:, None])
            i, j = np.nonzero(ok & (np.cumsum(ok, axis=1) <= self.k))
            yield pd.DataFrame({"query_id": ids[i], "vec_id": found[i, j], "similarity": best[i, j]})


def _own_near(k: int, least: float, most: int = 1 << 15):
    """The k vectors of two blocks that are most similar to each of the other block. Products in single precision say which can
    be among them, and the similarity of those, at most `most` of them at once, is summed row by row as in _block_near()."""

    def run(ids, v, others, w, same):
        a = _Side(ids, v, k, least)
        b = a if same else _Side(others, w, k, least)
        for x in range(0, len(a.v), TILE[0]):
            for y in range(0, len(b.v), TILE[1]):
                s = a.unit[x : x + TILE[0]] @ b.unit[y : y + TILE[1]].T
                near = s >= a.floor(x, s)[:, None]
                if not same:
                    near |= s >= b.floor(y, s.T)[None]
                p, q = np.divmod(np.flatnonzero(near), s.shape[1])
                for at in range(0, len(p), most):
                    i, j = p[at : at + most] + x, q[at : at + most] + y
                    some = a.n[i] * b.n[j]
                    exact = np.where(some == 0, 0.0, np.einsum("ij,ij->i", a.v[i], b.v[j]) / np.where(some == 0, 1, some))
                    a.take(i, b.ids[j], exact)
                    if not same:
                        b.take(j, a.ids[i], exact)
        yield from a.frames()
        if not same:
            yield from b.frames()

    return run


def _near(k: int, least: float):
    """The k vectors of a block that are most similar to each query of another, summed row by row as in _block_near()."""

    def run(x, y):
        q, v = _array(x["v"]), _array(y["v"])
        n = np.linalg.norm(q, axis=1)[:, None] * np.linalg.norm(v, axis=1)[None]
        s = np.where(n == 0, 0.0, q @ v.T / np.where(n == 0, 1, n))
        ids, other, out = x["vec_id"].to_numpy(), y["vec_id"].to_numpy(), []
        for j in range(len(ids)):
            ok = np.flatnonzero((other != ids[j]) & (s[j] >= least - ROOM))
            if len(ok) > 4 * k:
                ok = ok[s[j][ok] >= np.partition(s[j][ok], -k)[-k] - ROOM]
            some = n[j][ok]
            exact = np.where(some == 0, 0.0, np.einsum("ij,ij->i", np.broadcast_to(q[j], v[ok].shape), v[ok]) / np.where(some == 0, 1, some))
            ok, exact = ok[exact >= least], exact[exact >= least]
            top = np.lexsort((other[ok], -exact))[:k]
            out.append(pd.DataFrame({"query_id": ids[j], "vec_id": other[ok][top], "similarity": exact[top]}))
        return pd.concat(out)

    return run


def _best(found: DataFrame, k: int) -> DataFrame:
    best: Column = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("similarity"), "vec_id"))
    return found.withColumn("rank", best).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "similarity")
