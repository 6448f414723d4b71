"""Blocks of candidates where the tables of the order are full, and blocks that no task can hold."""

import random

import numpy as np

from quillspan.llm import bits, common, components, jaccard_join

from .conftest import DOCS, docs_of


def test_full_tables_do_not_run_blocks_together(make, monkeypatch):
    """Ten shingles on a slot, as on 6 GB: phrases of some twenty texts are told from rare ones, so that texts without a link share no large block."""
    monkeypatch.setattr(bits, "SLOT_BITS", 16)
    monkeypatch.setattr(jaccard_join, "SLOT_BITS", 16)
    rng, texts = random.Random(3), []
    phrases = [" ".join(f"p{k}{c}" for c in "abcd") for k in range(1500)]
    for _ in range(3000):
        texts.append(" ".join(rng.choice(phrases) if i % 22 == 0 else f"v{rng.randrange(500)}" for i in range(220)))
    rows = docs_of([*texts, texts[0] + " end"])
    largest, plain = [], common.stored

    def stored(df, tag, owner):
        out = plain(df, tag, owner)
        if tag == "blocks":
            largest.append(max((r["count"] for r in out.groupBy("label").count().collect()), default=0))
        return out

    monkeypatch.setattr(common, "stored", stored)
    got = {r.doc_id: r.component_id for r in jaccard_join.near_duplicates(make(DOCS, rows)).collect()}
    first, last = rows[0][0], rows[-1][0]
    assert got == {r[0]: first if r[0] == last else r[0] for r in rows}
    assert largest[-1] < 300, largest


def test_large_block_gives_few_links(make):
    """A group of near copies in about twenty chunks, with some that have candidates but no link: the components of one
    task, from at most three times the links of one task, not as many for each pair of chunks."""
    rng = np.random.default_rng(5)
    base, texts = rng.integers(0, 3000, 60), []
    for i in range(400):
        w = base.copy()
        e = 6 if i % 40 == 0 else int(rng.integers(0, 2))
        w[rng.integers(0, 60, e)] = rng.integers(3000, 6000, e)
        texts.append(" ".join(f"w{x}" for x in w))
    docs = make(DOCS, docs_of(texts))
    many, one = (jaccard_join.similar_links(docs, 4, 85, "large", chunk=c)[1] for c in (1000, 1 << 20))
    assert many.count() < 3 * one.count()
    of = lambda links: {r.v: r.label for r in components.components(links, "large").collect()}
    assert of(many) == of(one)
