"""Nearest neighbours, similar pairs and sequence scores against brute force."""

import random
import time

import duckdb
import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quillspan.operators import metric, vectors
from quillspan.plans import registry


def test_nearest_in_blocks_of_queries(spark):
    rng = random.Random(7)
    v = {i: [rng.randint(-3, 3) * 1.0 for _ in range(4)] for i in range(60)}
    d = spark.createDataFrame(list(v.items()), "vec_id long, v array<double>").repartition(3)
    queries = d.where("vec_id % 2 = 0").selectExpr("vec_id as query_id", "v as q")

    def cosine(a, b):
        n = np.linalg.norm(a) * np.linalg.norm(b)
        return float(np.dot(a, b) / n) if n else 0.0

    for most in (1, 7, 30, 10_000):
        got: dict = {}
        for r in vectors.nearest(queries, d, k=4, max_queries=most).collect():
            got.setdefault(r.query_id, []).append((r["rank"], round(r.similarity, 9)))
        want = {q: list(enumerate(sorted((round(cosine(v[q], v[i]), 9) for i in v if i != q), reverse=True)[:4], 1)) for q in v if q % 2 == 0}
        assert {q: sorted(x) for q, x in got.items()} == want
    assert vectors.nearest(queries.limit(0), d).count() == 0


def _cosines(v):
    x = np.array(v, float)
    n = np.linalg.norm(x, axis=1)
    x = x / np.where(n == 0, 1, n)[:, None]
    return x @ x.T


@pytest.mark.parametrize(("least", "block", "n"), [(0.9, 2048, 8), (0.5, 7, 5), (0.0, 40, 3), (-0.2, 2048, 1)])
def test_similar_pairs_match_all_pairs(spark, least, block, n):
    rng = np.random.default_rng(n)
    x = np.concatenate([c + rng.normal(size=(40, 6)) * 0.3 for c in rng.normal(size=(4, 6)) * 2] + [np.zeros((3, 6)), np.tile(rng.normal(size=6), (5, 1))])
    d = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, v array<double>").repartition(3)
    s = _cosines(x)
    want = {(i, j) for i in range(len(x)) for j in range(i + 1, len(x)) if s[i, j] >= least}
    close = {(i, j) for i in range(len(x)) for j in range(i + 1, len(x)) if abs(s[i, j] - least) < 1e-9}
    work = []
    got = metric.similar_pairs(d, least, block, n_pivots=n, work=work).collect()
    assert len(got) == len({(r.a, r.b) for r in got})
    assert {(r.a, r.b) for r in got} - close == want - close
    assert work[0] <= 2 * work[1] and (least < 0.9 or work[0] < 0.7 * work[1])  # cells that are too far apart do not meet
    assert metric.similar_pairs(d.limit(0), least).count() == 0


@pytest.mark.parametrize(("k", "least", "block", "n"), [(3, -1.0, 2048, 8), (5, 0.3, 9, 4), (200, -1.0, 50, 6), (2, -1.0, 2048, 1)])
def test_nearest_with_pivots_matches_brute_force(spark, k, least, block, n):
    rng = np.random.default_rng(k)
    x = np.concatenate([c + rng.normal(size=(30, 5)) * 0.3 for c in rng.normal(size=(4, 5)) * 2] + [np.zeros((2, 5)), np.tile(rng.normal(size=5), (6, 1))])
    d = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, v array<double>").repartition(3)
    q = d.where("vec_id % 5 = 0 or vec_id > 115").selectExpr("vec_id as query_id", "v as q")
    s = _cosines(x)
    got: dict = {}
    for r in metric.nearest(q, d, k, least, block, n_pivots=n).collect():
        got.setdefault(r.query_id, []).append((r["rank"], round(r.similarity, 9)))
    want = {}
    for i in [r.query_id for r in q.collect()]:
        near = sorted((-round(s[i, j], 9), j) for j in range(len(x)) if j != i and s[i, j] >= least)[:k]
        if near:
            want[i] = [(p, -c + 0.0) for p, (c, _) in enumerate(near, 1)]
    assert {i: sorted(v) for i, v in got.items()} == want


def test_blocks_of_matrices_where_cells_rule_nothing_out(spark, monkeypatch):
    """Vectors in many dimensions, copies and zeros among them: no vector is sent to the cells it may have neighbours in."""
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.normal(size=(300, 24)), np.tile(rng.normal(size=24), (30, 1)), np.zeros((3, 24))])
    d = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, v array<double>").repartition(3)
    s = _cosines(x)
    monkeypatch.setattr(metric, "FEW", 10)
    monkeypatch.setattr(metric, "CELL", 16)
    monkeypatch.setattr(metric, "BLOCK", 64)
    monkeypatch.setattr(metric, "meet", lambda *a: pytest.fail("cells are visited"))
    near = {(i, j) for i in range(len(x)) for j in range(i + 1, len(x)) if s[i, j] >= 0.4}
    got = vectors.similar_pairs(d, 0.4).collect()
    assert len(got) == len(near) and {(r.a, r.b) for r in got} == near
    assert all(abs(r.similarity - s[r.a, r.b]) < 1e-9 for r in got)
    links = vectors.similar_links(d, 0.4)
    assert links.count() < 5 * len(x)
    assert {r.vec_id: r.cluster for r in vectors.clusters(links).collect()} == {r.vec_id: r.cluster for r in vectors.clusters(spark.createDataFrame(sorted(near), "a long, b long")).collect()}
    for k, least in ((4, -1.0), (50, 0.2)):
        found: dict = {}
        for r in vectors.nearest(d.where("vec_id % 3 = 0").selectExpr("vec_id as query_id", "v as q"), d, k, least).collect():
            found.setdefault(r.query_id, []).append((r["rank"], r.vec_id))
        want = {i: [j for _, j in sorted((-round(s[i, j], 12) + 0.0, j) for j in range(len(x)) if j != i and s[i, j] >= least)[:k]] for i in range(0, len(x), 3)}
        assert {q: [v for _, v in sorted(f)] for q, f in found.items()} == {q: v for q, v in want.items() if v}


@pytest.mark.parametrize(("k", "least", "n_pivots", "block"), [(3, -1.0, None, 2048), (3, -1.0, None, 40), (7, 0.2, None, 40), (400, -1.0, None, 40), (4, -1.0, 5, 40)])
def test_all_vectors_ask(spark, monkeypatch, k, least, n_pivots, block):
    """Copies, opposite vectors and zeros among them: ids settle equal similarities, in blocks that meet once and in cells."""
    rng = np.random.default_rng(k)
    x = np.concatenate([rng.normal(size=(120, 7)), np.tile(rng.normal(size=7), (40, 1)), np.zeros((3, 7))])
    x = np.concatenate([x, -x[:9]])[rng.permutation(172)]
    d = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, v array<double>").repartition(5)
    monkeypatch.setattr(metric, "BLOCK", block)
    monkeypatch.setattr(metric, "PACK", 8)
    monkeypatch.setattr(metric, "TILE", (16, 32))
    s = _cosines(x)
    got: dict = {}
    for r in metric.nearest(None, d, k, least, block, n_pivots).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, round(r.similarity, 9)))
    want = {}
    for i in range(len(x)):
        near = sorted((-round(s[i, j], 9) + 0.0, j) for j in range(len(x)) if j != i and s[i, j] >= least - 1e-12)[:k]
        if near:
            want[i] = [(p, j, -c + 0.0) for p, (c, j) in enumerate(near, 1)]
    assert {i: sorted(v) for i, v in got.items()} == want
    assert metric.nearest(None, d.limit(0), k, least, block).count() == 0


def test_many_copies_of_a_vector_are_few_candidates():
    """A block of copies does not hold all pairs of them, and each copy finds the smallest ids but its own."""
    v = np.concatenate([np.tile(np.arange(1.0, 9.0), (20_000, 1)), np.eye(8)])
    side = metric._Side(np.arange(len(v))[::-1].copy(), v, 3, -1.0)
    assert len(side.v) == 4 + 8
    got = pd.concat(metric._own_near(3, -1.0)(np.arange(len(v)), v, None, None, True))
    found = got.groupby("query_id")["vec_id"].agg(list)
    assert len(found) == len(v) and found[0] == [1, 2, 3] and found[1] == [0, 2, 3] and found[19_999] == [0, 1, 2]


def test_copies_are_equally_similar_wherever_they_lie():
    """Products of matrices differ in the last bit from column to column."""
    rng = np.random.default_rng(0)
    for m in (16, 64, 65):
        for nq, nv in ((1, 3), (5, 13), (17, 257)):
            q, v = rng.normal(size=(nq, m)), np.tile(rng.normal(size=m), (nv, 1))
            x, y = pd.DataFrame({"vec_id": -1 - np.arange(nq), "v": q.tolist()}), pd.DataFrame({"vec_id": np.arange(nv), "v": v.tolist()})
            assert all(list(g) == [0, 1, 2] for _, g in metric._near(3, -1.0)(x, y).groupby("query_id")["vec_id"])


def test_recall_counts_every_vector(spark, tmp_path):
    """One vector in twenty has a neighbour of its label, as a reader of every twentieth would not see."""
    rows = []
    for i in range(0, 120, 2):
        a = [float(np.cos(i)), float(np.sin(i)), float(i)]
        rows += [(i, a, 1), (i + 1, [a[0], a[1], a[2] + 0.001], 1 if i % 20 == 0 else 2 + i)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = [tuple(r) for r in registry.QUERIES["recall_at_k"](spark, str(tmp_path)).collect()]
    with duckdb.connect() as c:
        c.execute(f"create view embeddings as select * from '{tmp_path}/embeddings.parquet/*.parquet'")
        assert got == c.execute(registry.ORACLE_SQL["recall_at_k"]).fetchall()
    assert got[0][0] == 120 and got[0][1] < 1


def _plain_lcs(x, y):
    row = [0] * (len(y) + 1)
    for a in x:
        diag = 0
        for j, b in enumerate(y):
            diag, row[j + 1] = row[j + 1], diag + 1 if a == b else max(row[j + 1], row[j])
    return row[-1]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=40), st.lists(st.integers(0, 3), max_size=40))
def test_bit_parallel_subsequences_match_the_table(x, y):
    assert vectors.lcs_length(x, y) == _plain_lcs(x, y)


def test_long_pairs_are_scored_in_time(spark):
    rng = random.Random(1)
    x, y = ([rng.choice("abcdefghijklmnopqrstuvwxyz") + str(rng.randrange(50)) for _ in range(20_000)] for _ in range(2))
    start = time.time()
    n = vectors.lcs_length(x, y)
    assert time.time() - start < 1 and 500 < n < 20_000
    assert vectors.lcs_length(x, x) == 20_000
    d = spark.createDataFrame([(1, x, x), (2, [], []), (3, [], y), (4, x[:3], x[1:4])], "k long, a array<string>, b array<string>")
    got = {r.k: (r.rouge_l, round(r.bleu, 6)) for r in vectors.sequence_scores(d, ["k"], "a", "b").collect()}
    assert got[1] == (1.0, 1.0) and got[2] == (0.0, 0.0) and got[3][0] == 0.0 and got[4][0] == 2 * 2 / 6
