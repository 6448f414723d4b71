"""Repeated windows, clusters and periodic runs against brute force, on small tables with nulls, ties, repeats and odd numbers."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quillspan.llm import cover_dedup, hamerly, queries, runs

from .conftest import DOCS, docs_of

SPACE = re.compile(r"[^\x20\x09-\x0D]+")


def sha(b: bytes) -> str:
    return hashlib.sha256(b).hexdigest()


# -- 11 windows ------------------------------------------------------------------------------------


def windows_gone(texts, length=35):
    ws = [SPACE.findall(t or "") for t in texts]
    n = Counter(tuple(w[i : i + length]) for w in ws for i in range(len(w) - length + 1))
    out = []
    for w in ws:
        gone = {j for i in range(len(w) - length + 1) if n[tuple(w[i : i + length])] > 1 for j in range(i, i + length)}
        out.append((len(w), len(gone), sha(" ".join(x for j, x in enumerate(w) if j not in gone).encode())))
    return out


def test_a_difference_cover_aligns_every_two_places():
    on = set(cover_dedup.COVER)
    for i in range(cover_dedup.PERIOD):
        for j in range(cover_dedup.PERIOD):
            assert any((i + k) % cover_dedup.PERIOD in on and (j + k) % cover_dedup.PERIOD in on for k in range(cover_dedup.PERIOD))


@pytest.mark.parametrize("batch", [1 << 21, 300])
def test_windows_match_brute_force(make, monkeypatch, batch):
    monkeypatch.setattr(cover_dedup, "BATCH", batch)
    rng = random.Random(batch)
    word = lambda: f"w{rng.randrange(400)}"
    base = [word() for _ in range(90)]
    texts = []
    for i in range(120):
        w = [word() for _ in range(rng.randrange(70))]
        kind = i % 6
        if kind == 0:  # a passage at any place, of lengths about the window's
            n = rng.choice([33, 34, 35, 36, 37, 55, 90])
            at = rng.randrange(0, 91 - n)
            p = rng.randrange(len(w) + 1)
            w[p:p] = base[at : at + n]
        if kind == 1:  # near copies
            w = list(base)
            w[rng.randrange(90)] = "other"
        if kind == 2 and texts:
            texts.append(rng.choice(texts))
            continue
        texts.append(rng.choice([" ", "\n", "\t "]).join(w))
    loop = " ".join(f"x{i % 9}" for i in range(300))
    texts += [None, "", " ", loop, "a " * 200, "Word " * 34, "Word " * 34, "word " * 35, "é ü " * 40, " ".join(base), " ".join(base)]
    got = sorted((r.n_words, r.n_removed, r.kept_sha256) for r in cover_dedup.digest(make(DOCS, docs_of(texts))).collect())
    assert got == sorted(windows_gone(texts))


def test_windows_keep_rows_apart(make):
    rows = [(1, "a b " * 30, "e", "s", 1), (1, "a b " * 30, "e", "s", 1), (None, "c " * 10, "e", "s", 1), (None, None, None, None, None)]
    got = sorted((r.doc_id is None, r.n_words, r.n_removed) for r in cover_dedup.digest(make(DOCS, rows)).collect())
    assert got == [(False, 60, 60), (False, 60, 60), (True, 0, 0), (True, 10, 0)]
    assert cover_dedup.digest(make(DOCS, [])).count() == 0


# -- 12 clusters -----------------------------------------------------------------------------------

VECTORS = "vec_id long, embedding array<float>, label int"


def lloyd(rows, clusters, rounds, scale=256):
    v = [(i, [hamerly.whole(float(c), scale) for c in e]) for i, e in rows]
    start = sorted(((sha(f"2:{'' if i is None else i}".encode()), x) for i, x in v))[:clusters]
    c = [x for _, x in start]
    nearest = lambda x: min((sum((a - b) ** 2 for a, b in zip(x, m)), k) for k, m in enumerate(c))
    for _ in range(rounds):
        of = [nearest(x)[1] for _, x in v]
        for k in range(len(c)):
            mine = [x for (_, x), o in zip(v, of) if o == k]
            if mine:
                c[k] = [sum(col) // len(mine) for col in zip(*mine)]
    return [(i, *reversed(nearest(x))) for i, x in v], c


@pytest.mark.parametrize("kind", ["blobs", "ties", "huge"])
def test_clusters_match_plain_rounds(make, kind):
    rng = np.random.default_rng(3)
    centers = rng.normal(size=(6, 64))
    x = centers[rng.integers(6, size=300)] + rng.normal(size=(300, 64)) * 0.2
    if kind == "ties":
        x = np.round(x)
        x[:150] = x[0]
    if kind == "huge":
        x[::7] *= 1e9
        x[5] *= 1e25
    rows = [(i if i % 50 else None, [float(np.float32(c)) for c in e], 0) for i, e in enumerate(x)]
    if kind == "ties":
        rows += rows[:20]
    bad = [(900, [1.0] * 63, 0), (901, None, 0), (902, [None] + [1.0] * 63, 0), (903, [float("nan")] + [1.0] * 63, 0), (904, [float("inf")] + [1.0] * 63, 0), (905, [], 0)]
    found, c = hamerly.cluster(make(VECTORS, rows + bad), clusters=12)
    want, centers = lloyd([r[:2] for r in rows], 12, 5)
    fits = [(i, k, d if d < 1 << 63 else None) for i, k, d in want]
    none = lambda r: tuple((x is None, x or 0) for x in r)
    assert sorted(map(none, (tuple(r) for r in found.collect()))) == sorted(map(none, fits))
    assert c == centers


def test_bounds_save_most_scans():
    rng = np.random.default_rng(1)
    c = hamerly.Centroids(rng.integers(-200, 200, size=(40, 64)).tolist())
    v = rng.integers(-200, 200, size=(500, 64)).astype("<i4")
    d = c.all(v)
    assert (d == ((v[:, None, :].astype(np.int64) - np.array(c.rows)[None]) ** 2).sum(2)).all()
    k, upper, lower = hamerly._scan(d)
    part = np.sort(d, axis=1)
    assert (upper**2 >= part[:, 0]).all() and (lower**2 <= part[:, 1]).all() and (k == d.argmin(1)).all()


def test_clusters_of_nothing(make):
    assert hamerly.digest(make(VECTORS, [])).count() == 0
    one = hamerly.digest(make(VECTORS, [(7, [0.5] * 64, 1)])).collect()
    assert [(r.vec_id, r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid_sha256) for r in one] == [(7, 0, 0, 0, 0, sha(",".join(["128"] * 64).encode()))]


# -- 13 runs ---------------------------------------------------------------------------------------


def all_runs(w, least=6, times=4):
    """Every maximal stretch of every period, without those that a smaller period explains."""
    out = set()
    for q in range(1, len(w) // times + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            m = j - i + q
            if m >= max(least, times * q) and not any(all(w[i + k] == w[i + k + p] for k in range(m - p)) for p in range(1, q)):
                out.add((i, m, q))
            i = max(j, i + 1)
    return out


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 2), max_size=60), st.integers(0, 59), st.integers(3, 9))
def test_runs_match_brute_force(w, a, k):
    if len(w) > a:
        p = 1 + (len(w) - a) // k
        w = w[:a] + [w[a + (i - a) % p] for i in range(a, len(w))]
    ids = runs.numbers(w)
    assert runs.runs(ids) == all_runs(w)
    parts = runs.stretches(np.array(ids, np.int64), np.zeros(len(ids), np.int64))
    assert {(s + x, m, q) for x, y in parts for s, m, q in runs.runs(ids[x:y])} == all_runs(w)


def test_runs_of_long_periodic_texts_are_found_in_time():
    fib = [[0], [0, 1]]
    while len(fib[-1]) < 100_000:
        fib.append(fib[-1] + fib[-2])
    assert runs.runs([0] * 100_000) == {(0, 100_000, 1)}
    assert runs.runs(list(range(500)) * 200) == {(0, 100_000, 500)}
    assert runs.runs(fib[-1]) == set()


def digest_of(doc_id, text):
    w = SPACE.findall(text or "")
    n = len(w)
    if doc_id is not None and n:
        h = zlib.crc32(str(doc_id).encode())
        g = h // 10
        if h % 10 == 0:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [x if i < a else w[a + (i - a) % p] for i, x in enumerate(w)]
    found = sorted(all_runs(w), key=lambda r: (r[0], r[2]))
    gone = {j for s, m, q in found for j in range(s + q, s + m)}
    best = min(found, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=(None,) * 3)
    lines = "".join(f"{s},{m},{q}\n" for s, m, q in found)
    return doc_id, len(found), *best, best[0] if best[0] is None else 1000 * best[1] // best[2], sha(lines.encode()), sha(" ".join(x for j, x in enumerate(w) if j not in gone).encode())


def test_run_digests_match_brute_force(make):
    rng = random.Random(4)
    texts = []
    for i in range(250):
        w = [f"w{rng.randrange(30)}" for _ in range(rng.randrange(90))]
        if i % 3 == 0:
            unit = [f"w{rng.randrange(5)}" for _ in range(rng.randint(1, 5))]
            p = rng.randrange(len(w) + 1)
            w[p:p] = (unit * 12)[: rng.randint(5, 40)]
        texts.append("\x0b".join(w))
    texts += ["Aa aa " * 20, " ", "one"]
    rows = docs_of(texts) + [(None, "x " * 9, "e", "s", 0), (5000, None, None, None, None), (5001, "", "e", "s", 0), (5001, "y " * 7, "e", "s", 0), (5001, "y " * 7, "e", "s", 0)]
    got = runs.digest(make(DOCS, rows)).collect()
    order = lambda r: tuple((x is None, x or 0) if not isinstance(x, str) else (False, x) for x in r)
    columns = "doc_id n_runs start length period exponent_milli runs_sha256 collapsed_sha256".split()
    assert sorted((order([r[c] for c in columns]) for r in got)) == sorted(order(digest_of(r[0], r[1])) for r in rows)
    assert runs.digest(make(DOCS, [])).count() == 0


def test_run_query_on_a_whole_table(spark, sf_dir):
    """The registered query, on a table small enough for brute force: the benchmark's texts stand for documents."""
    docs = spark.read.parquet(f"{sf_dir}/benchmark.parquet").selectExpr("item_id as doc_id", "concat_ws(' ', text, text, text, text, text) as text")
    got = {r.doc_id: tuple(r) for r in runs.digest(docs).collect()}
    for r in docs.collect():
        assert got[r.doc_id] == digest_of(r.doc_id, r.text)
    assert queries.op13_periodic_runs(spark, sf_dir).count() == spark.read.parquet(f"{sf_dir}/documents.parquet").count()
