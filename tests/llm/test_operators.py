"""The corpus operators against brute force, on small tables with nulls, empty and very long texts, ties and repeats."""

import hashlib
import itertools
import random
import time
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from hypothesis import given, settings
from hypothesis import strategies as st

from quillspan.llm import common, components, gif, jaccard_join, mixing, phrase_index, pii, queries, resampling, suffix_dedup, toxicity, url_rules, wrappers

from .conftest import DOCS, docs_of

UPPER = {ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}
LONG = "word " * 30_000


def words(t, pattern=r"[^\x20\x09-\x0D]+"):
    return re.findall(pattern, (t or "").translate(UPPER))


# -- shared pieces --------------------------------------------------------------------------------


def test_words_match_a_regular_expression():
    texts = [None, "", " a  B\tcé ", "x" * 500, "1\x0b2\x0c3 \U0001f600z"]
    w = common.Words(texts)
    assert [w.words()[a:b] for a, b in zip(w.first[:-1], w.first[1:])] == [words(t) for t in texts]
    by_hash = {}
    for h, x in zip(w.hash.tolist(), w.words()):
        assert by_hash.setdefault(x, h) == h
    assert len(set(by_hash.values())) == len(by_hash)


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7), (200, 3)]
    got = {r.v: r.label for r in components.components(spark.createDataFrame(edges, "a long, b long"), "t").collect()}
    assert got == {**{i: 0 for i in range(41)}, 200: 0, 100: 100, 101: 100}
    assert components.components(spark.createDataFrame([], "a long, b long"), "t").count() == 0


# -- 1 toxicity -----------------------------------------------------------------------------------


def test_toxicity_learns_and_keeps_held_out_rows_apart(make):
    rng = random.Random(1)
    vocabulary = [f"w{i}" for i in range(200)]
    texts, labels = [], []
    for i in range(700):
        w = [rng.choice(vocabulary) for _ in range(rng.randint(3, 40))]
        bad = rng.random() < 0.3
        if bad:
            w.insert(rng.randrange(len(w)), rng.choice(["trash", "idiot"]))
        texts.append(" ".join(w))
        labels.append((i, 1, int(bad)))
    texts += [None, "", LONG]
    docs, marks = make(DOCS, docs_of(texts)), make("doc_id long, quality int, toxic int", labels + [(1, 1, None)])
    net, thresholds = toxicity.train(docs, marks, rows=1 << 12)
    p = toxicity.score(docs, net, thresholds).toPandas().set_index("doc_id")
    assert len(p) == len(texts) and p.score.between(0, 1).all()
    assert (p.held_out == [zlib.crc32(str(i).encode()) % 4 == 2 for i in p.index]).all()
    y = np.array([labels[i][2] if i < 700 else 0 for i in p.index])
    assert ((p.score >= 0.3).astype(int) == p.predicted).all()
    held = p.held_out.to_numpy() & (p.index < 700)
    assert (p.predicted.to_numpy()[held] == y[held]).mean() > 0.95


def test_toxicity_without_labels(make):
    docs = make(DOCS, docs_of(["a", None]))
    net, t = toxicity.train(docs, make("doc_id long, quality int, toxic int", []))
    assert {r.score for r in toxicity.score(docs, net, t).collect()} == {0.0}


def test_gradient_of_pooling_reaches_the_largest_place():
    net = toxicity.Cnn(rows=64, dim=4, filters=3)
    ids, begin = toxicity.encode(["a b c d", "", "e"], 64)
    best, places = net.pooled(ids, begin, True)
    for t in (0, 2):
        for q, k in enumerate(toxicity.WIDTHS):
            rows = np.concatenate([net.p["E"][ids[begin[t] : begin[t + 1]]].sum(1), np.zeros((k, 4), np.float32)])
            r = np.stack([sum(rows[i + j] @ net.p[f"W{k}"][j] for j in range(k)) + net.p[f"b{k}"] for i in range(begin[t + 1] - begin[t] - 2)])
            assert np.allclose(best[t, q * 3 : q * 3 + 3], np.maximum(r.max(0), 0), atol=1e-5)
    assert (best[1] == 0).all() and (places[1] == -1).all()


# -- 2 resampling ---------------------------------------------------------------------------------


def test_resampling_prefers_the_target(make):
    rng = random.Random(2)
    good = [" ".join(rng.choice("alpha beta gamma delta epsilon".split()) for _ in range(30)) for _ in range(120)]
    bad = [" ".join(rng.choice("### $$$ buy now %%%".split()) for _ in range(30)) for _ in range(60)]
    docs = make(DOCS, docs_of([*good, *bad, None, "", LONG]))
    labels = make("doc_id long, quality int, toxic int", [(i, int(i < 120), 0) for i in range(0, 180, 2)])
    p = resampling.select(docs, labels).toPandas().set_index("doc_id").sort_index()
    assert p.selected[:120].mean() > 0.95 and p.selected[120:180].mean() < 0.1
    again = resampling.select(docs, labels).toPandas().set_index("doc_id").sort_index()
    assert (again.key == p.key).all()
    assert resampling.select(docs, labels, k=10).where("selected").count() == 10
    kept = resampling.keep(docs, labels)
    assert kept.columns == docs.columns and kept.count() == p.selected.sum()
    none = resampling.keep(docs, make("doc_id long, quality int, toxic int", []))
    assert none.count() == docs.count()


def test_resampling_rejects_junk_of_every_length(make):
    rng = random.Random(4)
    vocabulary, noise = [f"w{i}" for i in range(300)], [f"!!{i}" for i in range(300)]
    lengths = [20, 40, 80, 200, 600, 2000]
    good = [" ".join(rng.choice(vocabulary) for _ in range(n)) for n in lengths for _ in range(60)]
    junk = [" ".join(rng.choice(noise if rng.random() < 0.5 else vocabulary) for _ in range(n)) for n in lengths for _ in range(10)]
    docs = make(DOCS, docs_of([*good, *junk]))
    labels = make("doc_id long, quality int, toxic int", [(i, int(i < 360), 0) for i in range(420)])
    p = resampling.select(docs, labels).toPandas().set_index("doc_id").sort_index()
    assert p.selected[:360].mean() > 0.97
    for j, n in enumerate(lengths):
        assert not p.selected[360 + 10 * j : 370 + 10 * j].any(), n
    some = resampling.select(docs, labels, k=200).toPandas().set_index("doc_id").sort_index()
    assert some.selected.sum() == 200 and not some.selected[360:].any()
    assert resampling.select(docs, labels, k=400).where("selected").count() == 400


@settings(max_examples=5, deadline=None)
@given(st.lists(st.integers(-5, 5), min_size=1, max_size=40), st.integers(1, 40))
def test_kth_largest(spark, values, k):
    df = spark.createDataFrame([(float(v),) for v in values], "v double")
    want = sorted(values, reverse=True)[k - 1] if k <= len(values) else float("-inf")
    got = resampling.kth_largest(df, "v", k)
    assert got == want or (k > len(values) and got <= min(values))


# -- 3 personal data ------------------------------------------------------------------------------

BASE = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")]


def base_spans(t):
    out = []
    for order, (kind, pattern) in enumerate(BASE):
        for m in re.finditer(pattern, t or ""):
            d = re.sub("[^0-9]", "", m[0])
            luhn = sum(int(c) if i % 2 == 0 else int(c) * 2 - 9 * (int(c) > 4) for i, c in enumerate(reversed(d))) % 10 == 0
            if {"email": True, "ip": all(int(x) <= 255 for x in m[0].split(".")) if kind == "ip" else True, "card": 12 <= len(d) <= 19 and luhn, "phone": 9 <= len(d) <= 15}[kind]:
                out.append((m.start(), order, f"{kind}:{m.start()}:{m.end()}"))
    return [x for _, _, x in sorted(out)]


PII_TEXTS = [
    None, "", "a@b.c%d@e.f x@y", "300.1.2.3.4 1.2.3.4.5.6.7.8 001.02.0000255.4", "+1 (830) 555-5433 and 4111 1111 1111 1111-", "é\U0001f600 a.b@c-d.ee 10.0.0.1",
    "1" * 30_000, "a" * 30_000 + "@" + "b." * 20_000, "@@@ a@b a@b.c.", "mail joe [at] mail [dot] com or (830) 555-5433 token = \"1eb9c654e721b4f812088970e66a6345\"", "+49 30 123456 +1-1-1 +1234567890123456", LONG,
]


def test_pii_base_spans(make):
    p = pii.digest(pii.find(make(DOCS, docs_of(PII_TEXTS)))).toPandas().set_index("doc_id")
    assert len(p) == len(PII_TEXTS)
    for i, t in enumerate(PII_TEXTS):
        want = base_spans(t)
        assert p.base_sha256[i] == hashlib.sha256(",".join(want).encode()).hexdigest(), (i, want, p.spans[i])
        assert set(want) <= set(p.spans[i].split(","))
        assert [p[f"n_{k}"][i] for k, _ in BASE] == [sum(x.startswith(k) for x in want) for k, _ in BASE]
    assert {x.split(":")[0] for x in p.spans[9].split(",")} == {"email", "phone", "secret"}


def test_pii_redaction(make):
    docs = make(DOCS, docs_of(PII_TEXTS))
    p = pii.redact(docs)
    assert p.columns == docs.columns
    got = {r.doc_id: r.text for r in p.collect()}
    assert got[0] is None and got[11] == LONG and got[2] == "<EMAIL><EMAIL> x@y" and got[5] == "é\U0001f600 <EMAIL> <IP>"
    assert pii.find(docs.where("false")).count() == 0


def test_pii_em_finds_the_reliable_labeler():
    rng = random.Random(4)
    counts = Counter()
    for _ in range(4000):
        true = rng.random() < 0.4
        vote = lambda p: (1 if true else -1) * (1 if rng.random() < p else -1)  # noqa: B023, E731
        counts["card", (vote(0.95), vote(0.9), vote(0.85), vote(0.55), 0)] += 1
    post, reliable = pii.reliabilities([(k, v, n) for (k, v), n in counts.items()])
    assert reliable["card", "format"][0] > 0.9 and reliable["card", "boundary"][0] < 0.65
    assert post["card", (1, 1, 1, 1, 0)] > 0.95 > 0.05 > post["card", (-1, -1, -1, 1, 0)]


# -- 4 decontamination ----------------------------------------------------------------------------


def contaminated_by_hand(docs, items):
    pattern = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    windows = {}
    for i, t in items:
        w = words(t, pattern)
        for a, b in phrase_index.windows_of(len(w)):
            windows.setdefault(tuple(w[a:b]), set()).add(str(i))
    out = {}
    for d, t in docs:
        w, hit, ids = words(t, pattern), set(), set()
        for n in {len(k) for k in windows}:
            for a in range(len(w) - n + 1):
                if (k := tuple(w[a : a + n])) in windows:
                    hit.update(range(a, a + n))
                    ids |= windows[k]
        out[d] = (len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w))
    return out


@pytest.mark.parametrize("block_words", [4, 1 << 20])
def test_decontamination(make, block_words):
    rng = random.Random(5)
    draw = lambda n: " ".join(rng.choice("a b c d e".split()) for _ in range(n))
    items = [(1, draw(20)), (10, draw(13)), (2, "Short one"), (3, None), (4, "!?"), (10, draw(15)), (2, "Short one")]
    texts = [None, "", "...", LONG] + [draw(rng.randint(1, 60)) for _ in range(30)] + [f"{draw(5)} {items[k][1]}, {draw(5)}" for k in (0, 0, 1, 2, 5)] + ["SHORT-one"]
    rows = docs_of(texts) + docs_of(["SHORT-one"])
    rows[-1] = (len(texts) - 1, *rows[-1][1:])
    docs = make(DOCS, rows)
    found = phrase_index.contamination(docs, make("item_id long, text string", items), segment_words=100, block_words=block_words)
    want = contaminated_by_hand([(r[0], r[1]) for r in rows], items)
    got = phrase_index.digest(found).toPandas()
    assert len(got) == len(rows)
    assert all(want[r.doc_id] == (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in got.itertuples())
    none = phrase_index.digest(phrase_index.contamination(docs, make("item_id long, text string", []))).toPandas()
    assert (none.n_hit == 0).all() and len(none) == len(rows)


def test_proximity(make):
    index = phrase_index.build_index(make(DOCS, docs_of(["a x x b", "a x x x b", "b", "a", None])), segment_words=3)
    assert [(r.doc_id, r.position) for r in phrase_index.proximity_matches(index, ["a", "b"], 3).collect()] in ([(0, 0)], [(0, 3)])


# -- 5 html ---------------------------------------------------------------------------------------

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var t="</p>";</script></head><body>
<nav><ul><li><a href="/a">A</a></li><li><a>B</a></li></ul></nav><div class="ad">buy</div><div id="cookie-notice">we use cookies</div>
<article><h1>Title &amp; {0}</h1><p><b>one {0}</b>
 more<br>x<p>two &lt;b&gt; &eacute;</p><form><p>sign</p></form>{1}<section class="comments"><p>nice</p></section></article><aside>side</aside><footer>foot</footer>"""


def test_wrapper_extraction(make):
    pages = [(i, "http://H.example/x", PAGE.format(i, "<p>three</p>" * (i % 4))) for i in range(12)]
    pages += [(50, None, None), (51, "u", ""), (52, "http://lone.example", "<div>only <i>text</i></div><p>tail"), (53, "http://x.example", "<p>" + LONG)]
    p = wrappers.extract(make("page_id long, url string, html string", pages)).toPandas().set_index("page_id")
    for i in range(12):
        assert p.text[i] == "\n".join([f"Title & {i}", f"one {i} more x", "two <b> é", *["three"] * (i % 4)])
    assert (p.text[50], p.text[51], p.text[52], p.text[53]) == ("", "", "only text\ntail", LONG.strip())
    assert (p.n_chars == p.text.str.len()).all()
    assert "(<p>#</p>)" in p.wrapper[3].replace("+", "").replace("?", "")


def test_template_texts_with_empty_copied_and_long_pages(make):
    page = "<div><h2>Our site</h2><p>body {0} {0}</p><div>All rights</div></div>"
    pages = [(i, "http://a.example/x", page.format(i)) for i in range(8)] + [(8, "http://a.example/x", None), (9, "http://a.example/x", "<div></div>")]
    pages += [(20 + i, "http://b.example/x", "<div><h1>Short</h1><p>all there is</p></div>") for i in range(6)]
    rng = random.Random(5)
    mess = ["".join(f"<{t}>m{i} {j}</{t}>" for j, t in enumerate(rng.choices(["h2", "h3", "pre", "blockquote", "section", "address"], k=500))) for i in range(6)]
    pages += [(40 + i, "http://c.example/x", f"<div><h1>Our site</h1>{m}</div>") for i, m in enumerate(mess)]
    p = wrappers.extract(make("page_id long, url string, html string", pages)).toPandas().set_index("page_id")
    assert [p.text[i] for i in range(10)] == [f"body {i} {i}" for i in range(8)] + ["", ""]
    assert {p.text[20 + i] for i in range(6)} == {"Short\nall there is"}
    for i in range(6):
        got = p.text[40 + i].split("\n")
        assert got == [f"m{i} {j}" for j in range(500)] and len(p.wrapper[40 + i]) > 400


def test_alignment_in_pieces_loses_no_match(monkeypatch):
    rng = random.Random(6)
    for _ in range(20):
        a, b = ([rng.choice(["div", "p", "h1", "ul"]) for _ in range(rng.randint(1, 60))] for _ in "ab")
        want = len(wrappers.align(a, b))
        monkeypatch.setattr(wrappers, "CELLS", 50)
        assert len(wrappers.align(a, b)) == want
        monkeypatch.undo()


def test_alignment_makes_optional_and_repeated_groups():
    a = wrappers.stream("<div><ul><li>x</li></ul><p>one</p></div>")
    b = wrappers.stream("<div><ul><li>x</li><li>y</li><li>z</li></ul><h2>new</h2><p>two</p></div>")
    text = wrappers.pattern(wrappers.align(a, b))
    assert "(<li>#</li>)+" in text and "?" in text and "|" not in text
    assert wrappers.pattern(wrappers.align(b, b)) == wrappers.pattern(b)


BLOG = """<html><body><div class="top"><h1>Our blog</h1><p>Words about things</p></div><div class="meta-x"><p>{date}</p></div>
<div class="entry"><h2>Story {k}</h2>{body}</div><div class="box"><ul>{links}</ul></div><div class="legal"><p>All rights belong to us, says the law of the land</p></div></body></html>"""


def test_the_wrapper_and_not_the_tags_finds_the_article(make, monkeypatch):
    rng = random.Random(9)
    say = lambda n: " ".join(rng.choice(["ba", "du", "ki", "lo"]) + str(rng.randrange(99)) for _ in range(n))
    bodies = [[say(rng.randint(20, 60)) for _ in range(rng.randint(1, 6))] for _ in range(12)]
    links = lambda: "".join(f'<li><a href="/{x}">{say(3)}</a></li>' for x in range(rng.randint(3, 6)))
    pages = [(k, "http://blog.example/x", BLOG.format(k=k, date=f"day {k}", body="".join(f"<p>{x}</p>" for x in b), links=links())) for k, b in enumerate(bodies)]
    docs = make("page_id long, url string, html string", pages)
    p = wrappers.extract(docs).toPandas().set_index("page_id")
    for k, b in enumerate(bodies):
        assert p.text[k] == "\n".join([f"Story {k}", *b])
    alone = wrappers.main_text(pages[0][2])  # without the other pages of the host, the constant heading cannot be told from the article
    assert alone != p.text[0] and "Our blog" in alone


def test_all_of_an_article_element_stays(make):
    body = "<nav><a>m</a><a>n</a></nav><article><h1>Story {0}</h1><p>the same words on every page</p><ul><li><a>one</a></li><li><a>two</a></li><li><a>three</a></li></ul><p>own words of page {0}</p></article><div class='ad'>buy {0}</div>"
    pages = [(k, "http://s.example/", body.format(k)) for k in range(6)]
    p = wrappers.extract(make("page_id long, url string, html string", pages)).toPandas().set_index("page_id")
    for k in range(6):
        assert p.text[k] == f"Story {k}\nthe same words on every page\none\ntwo\nthree\nown words of page {k}"


def test_inline_hidden_and_broken_markup():
    text = lambda inner: wrappers.main_text(f"<article><p>long enough to be an article {inner}</p></article>")
    assert text('a <span class="ad">buy <b>now</b></span> b') == "long enough to be an article a b"
    assert wrappers.main_text('<article><p>yes it is</p><p hidden>no</p><p style="color:red; display:none">no</p><p title="a hidden b">yes</p></article>') == "yes it is\nyes"
    assert text('x <a href="a>b">y</a> z') == "long enough to be an article x y z"
    began = time.time()
    for broken in ("<a " * 300_000, '<a "' * 200_001, "<a '\"" * 100_000 + ">", "<p>x</p>" * 40_000, "<div>" * 30_000, "<!--" * 100_000):
        wrappers.main_text(f"<p>{broken}")
    assert time.time() - began < 60


def test_a_long_page_leaves_the_others_alone(make):
    rng = random.Random(4)
    page = "<div><h2>Welcome</h2><p>content number {0}</p></div>"
    pages = [(k, "http://l.example/", page.format(k)) for k in range(10)]
    few = wrappers.extract(make("page_id long, url string, html string", pages)).toPandas().set_index("page_id")
    mess = "".join(f"<{t}>m{j}</{t}>" for j, t in enumerate(rng.choices(["h2", "pre", "section", "address", "p"], k=700)))
    more = wrappers.extract(make("page_id long, url string, html string", [*pages, (99, "http://l.example/", f"<div>{mess}</div>")])).toPandas().set_index("page_id")
    for k in range(10):
        assert few.text[k] == f"content number {k}" and f"content number {k}" in more.text[k]
    assert more.text[99].count("\n") > 600


# -- 6 jaccard join -------------------------------------------------------------------------------


def near_by_hand(rows, width, percent):
    sets = {}
    for d, t in rows:
        w = words(t)
        s = frozenset(tuple(w[a : a + width]) for a in range(len(w) - width + 1)) if len(w) >= width else frozenset([tuple(w)] if w else [])
        sets.setdefault(d, s)
    ids = sorted(sets)
    low = {d: d for d in ids}
    changed = True
    while changed:
        changed = False
        for x in ids:
            for y in ids:
                if sets[x] and sets[y] and 100 * len(sets[x] & sets[y]) >= percent * len(sets[x] | sets[y]) and low[x] != low[y]:
                    low[x] = low[y] = min(low[x], low[y])
                    changed = True
    return {d: (len(sets[d]), low[d]) for d in ids}


@pytest.mark.parametrize(("wide", "hot"), [(2, 0), (16, 0), (16, -1)])
def test_near_duplicates(make, monkeypatch, wide, hot):
    rng = random.Random(6)
    draw = lambda n: [f"w{rng.randrange(300)}" for _ in range(n)]
    texts = [None, "", "  ", "one", "ONE", "one two three", LONG]
    for _ in range(6):
        base = draw(rng.choice([12, 60, 120]))
        for _ in range(12):
            w = base[:]
            for _ in range(rng.randint(0, 3)):
                w[rng.randrange(len(w))] = rng.choice(["", "zz", "w1"])
            texts.append(" ".join(w))
    rows = docs_of(texts)
    docs = make(DOCS, [*rows, rows[20], (None, "one", "en", "s", 3)])
    inner = jaccard_join.similar_links
    monkeypatch.setattr(jaccard_join, "similar_links", lambda *a: inner(*a, wide=wide, chunk=300, hot=hot))
    got = jaccard_join.near_duplicates(docs, 4, 85).toPandas()
    want = near_by_hand([(r[0], r[1]) for r in rows], 4, 85)
    assert len(got) == len(rows) + 2
    for r in got.dropna(subset=["doc_id"]).itertuples():
        assert (r.n_shingles, r.component_id) == want[r.doc_id], r
    kept = {r.doc_id for r in jaccard_join.drop_near_duplicates(docs, 4, 85).select("doc_id").collect()} - {None}
    assert kept == {d for d, (n, low) in want.items() if low == d or not n}


def test_prefix_never_loses_a_pair():
    rng = np.random.default_rng(7)
    tables = [rng.integers(0, 256, 1 << 17).astype(np.uint8) & rng.integers(0, 256, 1 << 17).astype(np.uint8) for _ in range(3)]
    order = jaccard_join.Order(tables, (8, 64, 512), rng.integers(0, 50, jaccard_join.WORDS))
    share = lambda s: -(common.mix64(s) % np.uint64(80)).astype(np.float32)
    for _ in range(300):
        base = common.mix64(rng.integers(0, 1 << 60, rng.integers(5, 80)).astype(np.uint64))
        a = np.unique(base)
        b = np.unique(np.concatenate([base[rng.random(len(base)) > 0.08], common.mix64(rng.integers(0, 1 << 60, 3).astype(np.uint64))]))
        k = int(jaccard_join.overlaps(a, [b])[0])
        assert k == len(np.intersect1d(a, b))
        if 100 * k >= 85 * (len(a) + len(b) - k):
            (p, l), (q, m) = jaccard_join.prefix(a, share(a), order, 85), jaccard_join.prefix(b, share(b), order, 85)
            need = int(jaccard_join.least_shared(np.int64(len(a)), np.int64(l), np.int64(len(b)), np.int64(m), 85))
            assert len(np.intersect1d(p, q)) >= need >= min(l, m)


def test_drop_near_duplicates_with_repeated_and_missing_ids(make):
    text = lambda seed: " ".join(f"w{x}" for x in np.random.default_rng(seed).integers(0, 500, 60))
    a, b, c, d = map(text, range(4))
    rows = [(1, a, "en", "s", 1), (2, a, "en", "s", 1), (3, b, "en", "s", 1), (3, b, "en", "s", 1), (3, a, "en", "s", 1), (None, b, "en", "s", 1), (None, c, "en", "s", 1), (None, c, "en", "s", 1), (4, d, "en", "s", 1), (4, c, "en", "s", 1), (5, "", "en", "s", 1), (5, "", "en", "s", 1), (None, None, "en", "s", 1)]
    docs = make(DOCS, rows)
    got = sorted(((r.doc_id, r.text) for r in jaccard_join.drop_near_duplicates(docs).collect()), key=str)
    assert got == sorted([(1, a), (3, b), (4, d), (4, c), (5, ""), (5, ""), (None, None)], key=str)
    assert jaccard_join.drop_near_duplicates(docs).columns == docs.columns


@pytest.mark.parametrize("most", [0, 100])
def test_without(make, most):
    docs = make(DOCS, docs_of([f"t{k}" for k in range(40)]) + [(None, "x", "en", "s", 1)])
    for lost in ([1, 5, 39], [1, None]):
        ids = docs.sparkSession.createDataFrame([(x,) for x in lost], "i long")
        got = common.without(docs, ids, "test-without", most)
        assert got.columns == docs.columns
        assert sorted((r.doc_id for r in got.collect()), key=str) == sorted(set([*range(40), None]) - set(lost), key=str)


# -- 7 urls ---------------------------------------------------------------------------------------


def test_fixed_rules(make):
    urls = {
        0: ("http://a.NET/x", "a.net", "/x", "net/", "block"), 1: ("https://www.example.net/en/1?q#f", "www.example.net", "/en/1", "example.net/en/", "allow"), 2: ("https://example.net", "example.net", "", None, "allow"),
        3: ("http://x.org/fr/", "x.org", "/fr/", "org/fr/", "allow"), 4: ("http://notexample.com/de/", "notexample.com", "/de/", None, "allow"), 5: (None, "", "", None, "allow"), 6: ("no scheme/", "", "", None, "allow"), 7: ("http://example.com/de/a", "example.com", "/de/a", "example.com/de/", "block"),
    }
    pages = make("page_id long, url string, html string", [(i, u[0], "") for i, u in urls.items()] + [(7, urls[7][0], "")])
    got = url_rules.judge(pages, []).collect()
    assert len(got) == 9
    assert all((r.host, r.path, r.rule, r.verdict) == urls[r.page_id][1:] for r in got)


def test_mined_rules(make):
    rng = random.Random(8)
    pages, labels = [], []
    for i in range(300):
        spam = rng.random() < 0.3
        pages.append((i, f"https://{'win' if spam else rng.choice(['a', 'b'])}.{rng.choice(['x', 'y'])}.com/{'promo' if spam else 'en'}/{i}", ""))
        labels.append((i, int(not spam), 0))
    pages, labels = make("page_id long, url string, html string", pages), make("doc_id long, quality int, toxic int", labels)
    mined = url_rules.mine(url_rules.labelled_pages(pages, labels), min_support=0.02)
    assert ("path=promo",) in [r[0] for r in mined if r[1] == "block"]
    got = url_rules.judge(pages, mined).toPandas()
    assert ((got.verdict == "block") == got.path.str.startswith("/promo")).all()
    assert url_rules.mine(url_rules.labelled_pages(pages, labels.where("false"))) == []


# -- 8 suffixes -----------------------------------------------------------------------------------


def repeats_by_hand(rows):
    seen, out = set(), {}
    for d, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for s in range(len(b) - 99):
            if b[s : s + 100] in seen:
                gone[s : s + 100] = True
            seen.add(b[s : s + 100])
        out[d] = (len(b), int(gone.sum()), int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum()), hashlib.sha256(bytes(np.frombuffer(b, np.uint8)[~gone])).hexdigest())
    return out


@pytest.mark.parametrize("crowded", [3, 1 << 30])
def test_suffix_dedup(make, monkeypatch, crowded):
    monkeypatch.setattr(suffix_dedup, "CROWDED", crowded)
    rng = random.Random(9)
    base = "".join(rng.choice("abcé ") for _ in range(400))
    texts = [None, "", "a" * 99, "a" * 100, "a" * 350, "ab" * 200, base, base[:200] + "X" + base[200:], base, "x" * 5000]
    texts += [f"{k:03d}{base[50:300]}{k * 7 % 1000:03d}" for k in range(60)]
    rows = docs_of(texts)
    got = suffix_dedup.digest(make(DOCS, rows)).toPandas()
    want = repeats_by_hand([(r[0], r[1]) for r in rows])
    assert len(got) == len(rows)
    assert all(want[r.doc_id] == (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got.itertuples())


# -- 9 gif ----------------------------------------------------------------------------------------


@settings(max_examples=40, deadline=None)
@given(st.binary(max_size=3000), st.integers(1, 40))
def test_lzw_round_trip(data, repeat):
    data *= repeat
    assert gif.lzw_decode(gif.lzw_encode(data), 8, len(data)) == data


def test_gif_digest(make):
    texts = [None, "", "a" * 576, "a" * 577, "é" * 1000, LONG, "a" * 576]
    got = gif.media_digest(make(DOCS, docs_of(texts))).toPandas().set_index("doc_id")
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        payload = raw + b"\xff" * (-len(raw) % 576 if raw else 576)
        r = got.loc[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
    assert tuple(got.loc[2]) == tuple(got.loc[6])


def test_gif_digest_reads_the_stored_palette(monkeypatch):
    inverted = bytes(255 - i for i in range(256) for _ in range(3))
    plain, payload = gif.digest_row("abc" * 20_000), gif.to_payload("abc" * 20_000)[1]
    monkeypatch.setattr(gif, "store", lambda text: (len(text), gif.encode([payload[i : i + gif.TILES * gif.TILE] for i in range(0, len(payload), gif.TILES * gif.TILE)], palette=inverted)))
    got = gif.digest_row("abc" * 20_000)
    assert plain[2] == hashlib.sha256(payload).hexdigest()
    assert got[2] == hashlib.sha256(bytes(255 - x for x in payload)).hexdigest()
    hist = [x.split("hist=")[1].split(",") for x in (plain[6], got[6])]
    assert hist[0] == hist[1][::-1] and hist[0] != hist[1]


def test_gif_disposal_transparency_and_interlace():
    import struct

    palette = bytes([0, 0, 0, 255, 0, 0, 0, 255, 0, 0, 0, 255])

    def codes(values):  # two-bit samples, a clear code before each, so that codes stay three bits wide
        bits = "".join("".join(reversed(format(c, "03b"))) for v in values for c in (4, v)) + "101"
        return bytes(int(bits[i : i + 8][::-1], 2) for i in range(0, len(bits), 8))

    def frame(values, x, y, w, h, disposal, transparent=None, interlaced=False):
        control = b"\x21\xf9\x04" + struct.pack("<BHBB", disposal << 2 | (transparent is not None), 10, transparent or 0, 0)
        data = codes(values)
        return control + b"\x2c" + struct.pack("<HHHHB", x, y, w, h, 0x40 * interlaced) + b"\x02" + bytes([len(data)]) + data + b"\0"

    head = b"GIF89a" + struct.pack("<HHBBB", 2, 2, 0x81, 0, 0) + palette
    media = head + frame([1, 1, 1, 1], 0, 0, 2, 2, 1) + frame([2, 0], 0, 0, 2, 1, 2, transparent=0) + frame([3], 1, 1, 1, 1, 3) + frame([1, 2, 3, 1], 0, 0, 1, 4, 1)[:0] + frame([2, 2], 0, 0, 1, 2, 1, interlaced=True) + b"\x3b"
    c = [f["canvas"].tolist() for f in gif.decode(media)]
    red, green, blue, none = [255, 0, 0, 255], [0, 255, 0, 255], [0, 0, 255, 255], [0, 0, 0, 0]
    assert c[0] == [[red, red], [red, red]]
    assert c[1] == [[green, red], [red, red]]
    assert c[2] == [[none, none], [red, blue]]
    assert c[3] == [[green, none], [green, red]]
    timed = gif.frames_of(media)
    assert [f["seconds"] for f in timed] == [0.1] * 4 and sum(timed[0]["red"]) == 4
    for broken in (b"", b"GIF89a", media[: len(head) + 20]):
        with pytest.raises((ValueError, struct.error)):
            list(gif.decode(broken))


def test_gif_frames_column(make):
    media = gif.text_to_media(make(DOCS, docs_of(["abc", None])))
    frames = {r.doc_id: r.frames for r in gif.decode_media(media).collect()}
    assert [len(f) for f in frames.values()] == [1, 1] and sum(frames[0][0]["red"]) == 576


def test_broken_gifs_give_an_error(make):
    whole = gif.store("hello")[1]
    rows = [(0, whole), (1, whole[:30]), (2, b"no gif"), (3, None), (4, b""), (5, whole[:-60]), (6, whole[:13] + b"\x99" + whole[14:])]
    got = {r.doc_id: r for r in gif.decode_media(make("doc_id long, media binary", rows)).collect()}
    assert got[0].error is None and len(got[0].frames) == 1
    assert got[3].error is None and got[3].frames is None
    assert all(got[k].frames is None and got[k].error for k in (1, 2, 4, 5))


def test_a_long_stream_without_clears():
    samples = bytes(random.Random(3).randrange(256) for _ in range(1 << 16))
    codes, table, width, n, bits = [256], {}, 9, 258, []
    out, at = 256, 9
    prev = None
    for c in samples:  # one code for each sample: the table fills once and stays as it is
        out |= c << at
        at += width
        if prev is not None and n < 4096:
            n += 1
        prev = c
        width = min(12, max(9, n.bit_length() if n < 4096 else 12))
    out |= 257 << at
    stream = out.to_bytes(at // 8 + 3, "little")
    assert gif.lzw_decode(stream, 8, len(samples)) == samples
    assert len(gif._schedule(8, 1 << 21)[1]) >= 1 << 21



# -- 10 mixing ------------------------------------------------------------------------------------


def fill_by_steps(sizes, weights, share=1.5, most=2.0):
    """Pour the words in small steps: every open source gets its weight's part, a full one is closed."""
    given, todo, step = [0.0] * len(sizes), share * sum(sizes), share * sum(sizes) / 20_000 or 1
    while todo > 1e-9:
        open_ = [i for i in range(len(sizes)) if given[i] < most * sizes[i] - 1e-9]
        if not open_:
            break
        now = min(step, todo)
        for i in open_:
            part = min(now * weights[i] / sum(weights[j] for j in open_), most * sizes[i] - given[i])
            given[i] += part
            todo -= part
    return given


def test_mix_against_poured_targets(make):
    rng = random.Random(12)
    sources = [rng.choice(["a", "b", "c", "d", None, "é"]) for _ in range(300)]
    texts = [" ".join("w" for _ in range(rng.choice([0, 1, 7, 60, 400]))) for _ in sources]
    got = mixing.mix(make(DOCS, docs_of(texts, sources))).toPandas().set_index("doc_id").sort_index()
    names = [*sorted({x for x in sources if x is not None}), None]
    sizes = [sum(len(t.split()) for t, x in zip(texts, sources, strict=True) if x == n) for n in names]
    want = fill_by_steps(sizes, [(5, 2, 1)[i % 3] for i in range(len(names))])
    for n, size, target in zip(names, sizes, want, strict=True):
        own = got[[x == n for x in sources]]
        assert (own["source_size"] == size).all() and np.allclose(own["target"], target, rtol=2e-3)
        assert abs(own["taken"].sum() - target) <= max(70, 0.02 * target)
    assert (got["taken"] <= 2 * got["size"]).all() and (got["size"] == [len(t.split()) for t in texts]).all()


def ngrams_by_hand(text):
    w = words(text or "")
    return [(x,) for x in w] + list(zip(w, w[1:]))


def test_weights_against_counts_by_hand(make):
    rng = random.Random(8)
    say = lambda vocabulary, n: " ".join(rng.choice(vocabulary) for _ in range(n))
    good, bad = [f"g{k}" for k in range(30)], [f"b{k}" for k in range(30)]
    texts = [say(good if k % 2 else bad + good[:3], rng.randint(0, 40)) for k in range(80)] + [None, ""]
    docs = make(DOCS, docs_of(texts))
    marks = [(k, k % 2, 0) for k in range(80)]
    labels = make("doc_id long, quality int, toxic int", marks, extra=False)
    held = {r.doc_id for r in labels.where(resampling.for_calibration(F.col("doc_id"))).collect()}
    ratio = resampling.models(docs, labels)
    bucket = lambda text: resampling.ngram_buckets([text])[0].tolist()
    raw, target = np.zeros(len(ratio)), np.zeros(len(ratio))
    for k, t in enumerate(texts):
        assert len(bucket(t)) == len(ngrams_by_hand(t))
        for b in bucket(t):
            raw[b] += 1
            target[b] += k < 80 and k % 2 == 1 and k not in held
    raw, target = raw + 1e-9 * raw.sum(), target + 1e-9 * target.sum()
    mix = (raw + target) / (raw + target).sum() * len(ratio) / 8
    want = np.log((target + mix) / sum(target + mix)) - np.log((raw + mix) / sum(raw + mix))
    assert np.allclose(ratio, want)
    for r in resampling.weigh(docs, ratio).collect():
        s = sum(want[b] for b in bucket(texts[r.doc_id]))
        assert abs(r.log_weight - s) < 1e-3 and r.n_ngrams == len(bucket(texts[r.doc_id]))
    kept = {r.doc_id for r in resampling.select(docs, labels).where("selected").collect()}
    assert kept == {r.doc_id for r in resampling.keep(docs, labels).collect()}


def test_mined_rules_against_enumerated_sets(spark):
    rng = random.Random(2)
    urls = [f"http://{rng.choice(['a', 'b'])}.x.com/{rng.choice(['ads', 'news', 'img'])}/{rng.choice(['p', 'q'])}.html" for _ in range(60)]
    blocked = [("ads" in u) ^ (rng.random() < 0.1) for u in urls]
    rows = spark.createDataFrame(list(zip(urls, blocked, strict=True)), "url string, blocked boolean")
    got = {(t, v): (c, s) for t, v, c, s in url_rules.mine(rows, 0.1, 0.6)}
    baskets = [(frozenset(url_rules.url_tokens(u)), "block" if b else "allow") for u, b in zip(urls, blocked, strict=True)]
    tokens = sorted(set().union(*(t for t, _ in baskets)))
    sure: dict = {}
    for n in range(1, len(tokens) + 1):
        found = False
        for part in itertools.combinations(tokens, n):
            have = [v for t, v in baskets if t >= set(part)]
            for verdict in ("block", "allow"):
                hits = have.count(verdict)
                if hits >= 0.1 * len(urls):
                    found = True
                    if hits / len(have) >= 0.6:
                        sure[part, verdict] = (hits / len(have), hits / len(urls))
        if not found:
            break
    want = {}
    for (part, verdict), (c, s) in sure.items():
        if not any(v == verdict and set(q) < set(part) and x[0] >= c for (q, v), x in want.items()):
            want[part, verdict] = (c, s)
    assert got.keys() == want.keys() and all(np.allclose(got[k], want[k]) for k in want)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.floats(0, 1000), min_size=1, max_size=12), st.integers(0, 80))
def test_sainte_lague_is_highest_quotients(votes, seats):
    won = [0] * len(votes)
    for _ in range(seats if sum(votes) > 0 else 0):
        i = max(range(len(votes)), key=lambda i: (votes[i] / (2 * won[i] + 1), -i))
        won[i] += 1
    got = mixing.sainte_lague(votes, seats)
    assert sum(got) == sum(won) and sorted(v / (2 * g + 1) for v, g in zip(votes, got)) == pytest.approx(sorted(v / (2 * w + 1) for v, w in zip(votes, won)))


def test_shard_quotas_match(spark):
    rng = random.Random(10)
    rows, want = [], {}
    for key in "abc":
        sizes = [rng.choice([0, 5, 100, 1000]) + rng.random() for _ in range(9)]
        seats = rng.randint(1, 60)
        want[key] = mixing.sainte_lague(sizes, seats)
        rows += [(key, i, s, seats) for i, s in enumerate(sizes)]
    got = mixing.shard_quotas(spark.createDataFrame(rows, "source_key string, shard int, shard_size double, seats long")).collect()
    assert {(r.source_key, r.shard): r.quota for r in got} == {(k, i): n for k, v in want.items() for i, n in enumerate(v)}


def test_mixing(make):
    rng = random.Random(11)
    texts = [" ".join(["w"] * rng.randint(0, 60)) for _ in range(200)] + [None, "", LONG]
    sources = [rng.choice(["b", "a", "c", None, "\U0001f600", "￮"]) for _ in texts]
    docs = make(DOCS, docs_of(texts, sources))
    p = mixing.mix(docs, shard_words=500).toPandas().sort_values("doc_id").reset_index(drop=True)
    assert list(p["size"]) == [len((t or "").split()) for t in texts]
    order = sorted({s for s in sources}, key=lambda s: (s is None, (s or "").encode()))
    size = {s: sum(len((t or "").split()) for t, x in zip(texts, sources) if x == s) for s in order}
    target = dict(zip(order, mixing.water_fill([size[s] for s in order], [(5, 2, 1)[i % 3] for i in range(len(order))])))
    assert sum(target.values()) == pytest.approx(1.5 * sum(size.values())) and all(target[s] <= 2 * size[s] + 1e-9 for s in order)
    for s in order:
        rows = p[[x == s for x in sources]]
        assert (rows.source_size == size[s]).all() and np.allclose(rows.target, target[s])
        assert abs(rows.taken.sum() - target[s]) <= max(64, 0.02 * target[s])
    assert (p.taken <= 2 * p["size"]).all() and (p.taken >= 0).all()
    again = mixing.mix(docs.repartition(7), shard_words=500).toPandas().sort_values("doc_id").reset_index(drop=True)
    assert again.equals(p)
    assert mixing.mix(docs.where("false")).count() == 0


# -- all ------------------------------------------------------------------------------------------


def test_empty_tables(make):
    docs, pages = make(DOCS, []), make("page_id long, url string, html string", [])
    labels, items = make("doc_id long, quality int, toxic int", []), make("item_id long, text string", [])
    for df in (
        toxicity.score(docs, *toxicity.train(docs, labels)), resampling.select(docs, labels), pii.digest(pii.find(docs)), phrase_index.digest(phrase_index.contamination(docs, items)), wrappers.extract(pages),
        jaccard_join.near_duplicates(docs), url_rules.judge(pages, []), suffix_dedup.digest(docs), gif.media_digest(docs), mixing.mix(docs),
    ):
        assert df.count() == 0 and "n" not in df.columns[:1]


def test_registered_names():
    assert {int(n[2:].split("_")[0]) for n in queries.QUERIES} == set(range(1, 14))
