"""Toxicity: a convolutional text classifier with hashed word embeddings, trained in numpy.

Words are hashed into embedding rows; filters of several widths slide over the whole text; each filter keeps its largest
response (max pooling, so only one place per filter carries a gradient); a logistic layer gives the score. Training uses
at most max_rows labelled rows, half of each class if there are enough, and the bias is corrected to the class shares of
all labelled rows. Thresholds per language are calibrated on a fifth of those rows that training does not see. A batch
multiplies each distinct word by every filter column once, and then only gathers and adds.

Defined results: null and empty texts get the score of a text without any response; null toxic labels are left out;
repeated rows score alike; without labelled rows of both classes every score is the share of toxic rows (0 without any);
an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

WIDTHS = (1, 2, 3)
#: A word's embedding is the sum of the rows of the word and of its first so many bytes, for words that inflect.
PREFIXES = (4, 6)
PAD = 0


def remainder(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 4; 2 marks held-out rows (a null id counts as the text '')."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4


def encode(texts: list[str | None], rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Embedding rows of all words (three each) with as many pads after each text as the widest filter needs, and where texts begin."""
    w = common.Words(texts, common.IS_BREAK)
    n = np.diff(w.first)
    pads = max(WIDTHS) - 1
    begin = np.concatenate([[0], np.cumsum(n + pads)])
    ids = np.full((begin[-1], 1 + len(PREFIXES)), PAD, np.uint16)
    at = np.arange(len(w.hash)) + np.repeat(np.arange(len(n)) * pads, n)
    for c, h in enumerate([w.hash, *[w.prefix(k) for k in PREFIXES]]):
        ids[at, c] = h % np.uint64(rows - 1) + np.uint64(1)
    return ids, begin


def add_rows(to: np.ndarray, at: np.ndarray, rows: np.ndarray) -> None:
    """to[at] += rows where places repeat, by sorted runs."""
    if len(at):
        order = np.argsort(at, kind="stable")
        at = at[order]
        first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
        to[at[first]] += np.add.reduceat(rows[order], first, axis=0)


class Cnn:
    def __init__(self, rows: int = 1 << 15, dim: int = 16, filters: int = 24, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.rows, self.dim, self.filters = rows, dim, filters
        self.p = {"E": rng.normal(0, 0.3, (rows, dim)).astype(np.float32), "out": rng.normal(0, 0.2, len(WIDTHS) * filters).astype(np.float32), "bias": np.zeros(1, np.float32)}
        for k in WIDTHS:
            self.p[f"W{k}"] = rng.normal(0, 0.3, (k, dim, filters)).astype(np.float32)
            self.p[f"b{k}"] = np.full(filters, -0.2, np.float32)
        self.p["E"][PAD] = 0
        self.shift = 0.0
        self.constant: float | None = None

    def pooled(self, ids: np.ndarray, begin: np.ndarray, need_places: bool = False):
        """max(0, largest response) per text and filter, and the places of those responses."""
        n_text = len(begin) - 1
        best = np.zeros((n_text, len(WIDTHS) * self.filters), np.float32)
        places = np.full(best.shape, -1, np.int64) if need_places else None
        pads = max(WIDTHS) - 1
        used, ids = np.unique((ids.astype(np.uint64) << np.arange(0, 16 * ids.shape[1], 16).astype(np.uint64)).sum(1, dtype=np.uint64), return_inverse=True)
        embedded = sum(self.p["E"][(used >> np.uint64(16 * c)).astype(np.uint16)] for c in range(1 + len(PREFIXES)))
        projected = {k: [embedded @ self.p[f"W{k}"][j] for j in range(k)] for k in WIDTHS}
        full = np.flatnonzero(np.diff(begin) > pads)
        if not len(full):
            return best, places
        for q, k in enumerate(WIDTHS):
            n = len(ids) - k + 1
            r = projected[k][0][ids[:n]]
            for j in range(1, k):
                r += projected[k][j][ids[j : n + j]]
            r += self.p[f"b{k}"]
            cols = slice(q * self.filters, (q + 1) * self.filters)
            # responses on pads between texts belong to no text: the bounds below leave them out
            edges = np.stack([begin[full], begin[full + 1] - pads], 1).reshape(-1)
            edges = np.minimum(edges, n)
            if edges[-1] == n:
                edges = edges[:-1]
            top = np.maximum.reduceat(r, edges, axis=0)[::2]
            best[full, cols] = np.maximum(top, 0)
            if need_places:
                for t in full:
                    part = r[begin[t] : begin[t + 1] - pads]
                    at = part.argmax(0)
                    places[t, cols] = np.where(part[at, np.arange(self.filters)] > 0, at + begin[t], -1)
        return best, places

    def logits(self, best: np.ndarray) -> np.ndarray:
        return best @ self.p["out"] + self.p["bias"][0]

    def fit(self, texts: list[np.ndarray], y: np.ndarray, steps: int = 800, batch: int = 64, rate: float = 0.004, decay: float = 1e-5, seed: int = 9) -> None:
        """Adam on the log loss for about `steps` steps, eight rounds at least; texts are padded rows of ids."""
        rng = np.random.default_rng(seed)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v2 = {k: np.zeros_like(v) for k, v in self.p.items()}
        step = 0
        for _ in range(max(8, steps * batch // max(1, len(texts)))):
            order = rng.permutation(len(texts))
            for a in range(0, len(order), batch):
                pick = order[a : a + batch]
                ids = np.concatenate([texts[i] for i in pick])
                begin = np.concatenate([[0], np.cumsum([len(texts[i]) for i in pick])])
                best, places = self.pooled(ids, begin, True)
                keep = (rng.random(best.shape[1]) > 0.2).astype(np.float32) / 0.8
                h = best * keep
                err = ((1 / (1 + np.exp(-np.clip(self.logits(h), -30, 30)))) - y[pick]).astype(np.float32) / len(pick)
                g = {"out": h.T @ err, "bias": np.array([err.sum()], np.float32), "E": np.zeros_like(self.p["E"])}
                dh = err[:, None] * self.p["out"] * keep
                words, backs = [], []
                for q, k in enumerate(WIDTHS):
                    cols = slice(q * self.filters, (q + 1) * self.filters)
                    t, f = np.nonzero(places[:, cols] >= 0)
                    at, d = places[:, cols][t, f], dh[:, cols][t, f]
                    gw = np.zeros_like(self.p[f"W{k}"])
                    for j in range(k):
                        word = ids[at + j]
                        add_rows(gw[j].T, f, d[:, None] * self.p["E"][word].sum(1))
                        words.append(word)
                        backs.append(d[:, None] * self.p[f"W{k}"][j].T[f])
                    g[f"W{k}"], g[f"b{k}"] = gw, np.bincount(f, d, self.filters).astype(np.float32)
                if sum(map(len, words)):
                    word, back = np.concatenate(words), np.concatenate(backs)
                    add_rows(g["E"], word.T.reshape(-1), np.tile(back, (word.shape[1], 1)))
                g["E"][PAD] = 0
                step += 1
                for name, grad in g.items():
                    m[name] += 0.1 * (grad - m[name])
                    v2[name] += 0.01 * (grad * grad - v2[name])
                    self.p[name] -= rate * (m[name] / (1 - 0.9**step) / (np.sqrt(v2[name] / (1 - 0.99**step)) + 1e-7) + decay * self.p[name])

    def score(self, texts: list[str | None]) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(texts), self.constant)
        ids, begin = encode(texts, self.rows)
        return self.score_ids(ids, begin)

    def score_ids(self, ids: np.ndarray, begin: np.ndarray) -> np.ndarray:
        best, _ = self.pooled(ids, begin)
        z = self.logits(best).astype(np.float64) + self.shift
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def best_threshold(score: np.ndarray, y: np.ndarray) -> float:
    """The score threshold with the best F1; halfway to the next lower score, 0.5 if there is nothing to choose."""
    if not len(y) or not y.any():
        return 0.5
    order = np.argsort(-score, kind="stable")
    s, hit = score[order], np.cumsum(y[order])
    f1 = 2 * hit / (np.arange(1, len(s) + 1) + y.sum())
    f1[:-1][s[:-1] == s[1:]] = -1
    i = int(f1.argmax())
    return float((s[i] + (s[i + 1] if i + 1 < len(s) else 0)) / 2)


def train(docs: DataFrame, labels: DataFrame, max_rows: int = 6000, rows: int = 1 << 15, max_words: int = 8192) -> tuple[Cnn, dict[str, float]]:
    """(model, {language: threshold}); '' holds the threshold for languages with under 20 toxic calibration rows.

    Bound: at most max_rows labelled rows of up to max_words words leave the cluster, as hashed words; more rows (repeated
    ids) are cut in a fixed order. Held-out rows are never among them.
    """
    marks = labels.where(F.col("`toxic`").isNotNull() & F.col("`doc_id`").isNotNull() & (remainder(F.col("`doc_id`")) != 2)).groupBy(F.col("`doc_id`").alias("doc_id")).agg(F.max(F.col("`toxic`")).alias("y"))
    counts = {r.y: r.n for r in marks.groupBy((F.col("y") > 0).cast("int").alias("y")).agg(F.count(F.lit(1)).alias("n")).collect()}
    net = Cnn(rows)
    share = counts.get(1, 0) / max(1, sum(counts.values()))
    if not counts.get(0) or not counts.get(1):
        net.constant = share
        return net, {"": 0.5}
    pick = [marks.where(side).orderBy(F.xxhash64("doc_id", F.lit(3)), "doc_id").limit(max_rows // 2) for side in (F.col("y") > 0, F.col("y") <= 0)]
    sample = F.broadcast(pick[0].unionByName(pick[1]))  # bounded by max_rows

    def run(it):
        for pdf in it:
            for part in common.batches([pdf], most=1 << 20):
                ids, begin = encode(part["text"].tolist(), rows)
                out = pd.DataFrame({"doc_id": part["doc_id"], "lang": part["lang"], "y": part["y"], "ids": [ids[a:b].tobytes() for a, b in zip(begin[:-1], begin[1:], strict=True)]})
                yield out[np.diff(begin) <= max_words]

    kind = docs.schema["doc_id"].dataType.simpleString()
    got = common.table_of(docs, "doc_id", "text", "lang").join(sample, "doc_id").mapInPandas(run, f"doc_id {kind}, lang string, y int, ids binary").orderBy(F.xxhash64("doc_id", F.lit(3)), "doc_id", "lang", F.xxhash64("ids"), "ids").limit(max_rows).collect()
    got.sort(key=lambda r: (str(r.doc_id), r.ids))
    texts = [np.frombuffer(r.ids, np.uint16).reshape(-1, 1 + len(PREFIXES)) for r in got]
    y = np.array([r.y > 0 for r in got], np.float32)
    if not y.any() or y.all():
        net.constant = share
        return net, {"": 0.5}
    calibrate = np.arange(len(got)) % 5 == 0
    chosen = np.flatnonzero(~calibrate) if len(got) >= 50 else np.arange(len(got))
    net.fit([texts[i] for i in chosen], y[chosen])
    drawn = y[chosen].mean()
    if 0 < drawn < 1:
        net.shift = float(np.log(share / (1 - share)) - np.log(drawn / (1 - drawn)))
    at = np.flatnonzero(calibrate)
    score = np.array([net.score_ids(texts[i], np.array([0, len(texts[i])]))[0] for i in at])
    thresholds = {"": best_threshold(score, y[at])}
    for lang in {got[i].lang for i in at} - {None}:
        own = np.array([got[i].lang == lang for i in at])
        if y[at][own].sum() >= 20:
            thresholds[lang] = best_threshold(score[own], y[at][own])
    return net, thresholds


def score(docs: DataFrame, net: Cnn, thresholds: dict[str, float], at: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted (score >= at), and toxic_by_lang: score reaches its language's threshold."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(it):
        for part in common.batches(it, most=1 << 20):
            s = net.score(part["text"].tolist())
            limit = np.array([thresholds.get(x or "", thresholds[""]) for x in part["lang"]])
            yield pd.DataFrame({"doc_id": part["doc_id"], "score": s, "predicted": (s >= at).astype(np.int32), "toxic_by_lang": s >= limit})

    d = common.table_of(docs, "doc_id", "text", "lang").mapInPandas(run, f"doc_id {kind}, score double, predicted int, toxic_by_lang boolean")
    return d.select("doc_id", (remainder(F.col("doc_id")) == 2).alias("held_out"), "score", "predicted", "toxic_by_lang")
