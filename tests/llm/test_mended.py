"""Groups of any width in wrappers, canvases of any size, and the sample that Gumbel keys draw."""

import re
import struct

import numpy as np
from pyspark.sql import functions as F

from quillspan.llm import common, gif, resampling, toxicity, wrappers

from .conftest import DOCS, docs_of


def test_groups_of_any_width_are_folded(make):
    """Sections of 17 items, two or three a page: the constant line belongs to the host, not to the pages."""

    def section(k, j):
        say = lambda t, n: f"<{t}>{' '.join(f'{t}{k}x{j}w{i}' for i in range(n))}</{t}>"
        return "<div>" + say("h3", 4) + say("p", 25) + say("h4", 4) + say("pre", 12) + say("h5", 3) + "</div>"

    page = lambda k: f"<html><body><h1>Title number {k} of the pages</h1>{''.join(section(k, j) for j in range(2 + k % 2))}<p>All rights are ours</p></body></html>"
    rows = [(k, f"http://wide.example/{k}", page(k)) for k in range(8)]
    got = {r.page_id: r.text.split("\n") for r in wrappers.extract(make("page_id long, url string, html string", rows)).collect()}
    assert [len(got[k]) for k in range(8)] == [11 + 5 * (k % 2) for k in range(8)]
    assert not any("All rights are ours" in t for t in got.values())


def test_folding_matches_a_plain_search():
    rng = np.random.default_rng(1)
    for _ in range(300):
        unit = [f"={x}" for x in rng.integers(0, 4, rng.integers(1, 20))]
        items = [f"={x}" for x in rng.integers(4, 7, 3)] + unit * int(rng.integers(1, 4)) + [f"={x}" for x in rng.integers(4, 7, 2)]
        keys = [wrappers.shape(x) for x in items]
        want = [w for w in range(1, len(keys) // 2 + 1) if any(keys[i : i + w] == keys[i + w : i + 2 * w] for i in range(len(keys) - 2 * w + 1))]
        assert list(wrappers._widths(keys)) == want


def test_huge_canvases_give_an_error(make):
    head = b"GIF89a" + struct.pack("<HHBBB", 65535, 65535, 0x80, 0, 0) + bytes(6)
    frame = b"," + struct.pack("<HHHHB", 0, 0, 65535, 65535, 0) + b"\x02\x02\x4c\x01\x00;"
    small = b"GIF89a" + struct.pack("<HHBBB", 2, 2, 0x80, 0, 0) + bytes(6) + frame
    d = make("doc_id long, media binary", [(1, head + frame), (2, small), (3, None)], extra=False)
    got = {r.doc_id: (r.frames, r.error) for r in gif.decode_media(d).collect()}
    assert got[1][0] is None and "65535" in got[1][1]
    assert got[2][0] is None and "65535" in got[2][1] and got[3] == (None, None)


def test_the_kth_gumbel_key_decides(make):
    rng = np.random.default_rng(5)
    texts = [" ".join(rng.choice(["good", "fine", "well", "bad", "junk", "spam"], size=rng.integers(5, 60), p=p)) for p in ([0.3, 0.3, 0.25, 0.05, 0.05, 0.05], [0.05, 0.05, 0.1, 0.3, 0.25, 0.25]) for _ in range(150)]
    docs = make(DOCS, docs_of([*texts, None, ""]))
    labels = make("doc_id long, quality int, toxic int", [(i, int(i < 150), 0) for i in range(300)])
    for k in (1, 40, 299):
        p = resampling.select(docs, labels, k=k).toPandas()
        assert set(p.doc_id[p.selected]) == set(p.sort_values("key", ascending=False).doc_id[:k])
    p = resampling.select(docs, labels).toPandas()
    d = resampling.weigh(docs, resampling.models(docs, labels))
    z, floor = resampling.standing(d, resampling.held_out(labels), 0.003)
    at = d.select("doc_id", z(F.col("n_ngrams"), F.col("mean_weight")).alias("z")).toPandas().set_index("doc_id").z
    assert p.selected.sum() == (at >= floor).sum()  # as many as stand high enough, drawn by their keys
    noise = p.set_index("doc_id").key - at / resampling.TEMPERATURE
    assert abs(noise.mean() - 0.5772) < 0.25 and abs(noise.std() - np.pi / np.sqrt(6)) < 0.25  # a standard Gumbel sample
    other = resampling.select(docs, labels, seed=24).toPandas()
    assert other.selected.sum() == p.selected.sum() and (other.key != p.key).any()


def test_toxicity_scores_by_plain_loops():
    """The network's score, one place, one filter and one number at a time."""
    rng = np.random.default_rng(4)
    net = toxicity.Cnn(rows=1 << 9, dim=5, filters=4)
    net.p["bias"][0], net.shift = 0.3, -0.2
    texts = [None, "", "One", "the cat, the dog! and é ü 12", " ".join(rng.choice(["alpha", "beta", "gammas", "gammarays", "x"], 40)), "--- ..."]

    def row(word, n=None):
        w = common.Words([word], common.IS_BREAK)
        h = w.hash if n is None else w.prefix(n)
        return net.p["E"][int(h[0] % np.uint64(net.rows - 1)) + 1]

    want = []
    for t in texts:
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        seen = [[float(x) for x in row(w) + row(w, 4) + row(w, 6)] for w in words] + [[0.0] * 5] * 2
        z, q = float(net.p["bias"][0]) + net.shift, 0
        for k in toxicity.WIDTHS:
            for f in range(4):
                best = 0.0
                for p in range(len(words)):
                    r = float(net.p[f"b{k}"][f])
                    for j in range(k):
                        for d in range(5):
                            r += seen[p + j][d] * float(net.p[f"W{k}"][j, d, f])
                    best = max(best, r)
                z += best * float(net.p["out"][q])
                q += 1
        want.append(1 / (1 + np.exp(-z)))
    assert np.allclose(net.score(texts), want, atol=1e-5)
