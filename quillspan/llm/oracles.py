"""The results of five operators in DuckDB SQL, over whole tables.

Words and shingles are made with windows over one row per word, byte strings with windows of overlapping chunks of
hexadecimal text, so that no row carries a whole document.
"""

from __future__ import annotations

_UP, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WINDOW, WIDTH, LENGTH, CHUNK = 13, 4, 100, 1000


def _words(pattern: str) -> str:
    return f"regexp_extract_all(translate(coalesce(text, ''), '{_UP}', '{_LOW}'), '{pattern}')"


def _gram(k: int) -> str:
    return " || ' ' || ".join(["w", *(f"lead(w, {j}) OVER o" for j in range(1, k))])


_TERMS = _words(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")

#: A window of an item is a text of its words; every document has its windows of each width that items have.
OP4 = f"""WITH d AS (SELECT doc_id, row_number() OVER () rid, {_TERMS} ws FROM documents), b AS (SELECT DISTINCT item_id, {_TERMS} ws FROM benchmark),
bw AS (SELECT row_number() OVER () bid, * FROM b), bt AS (SELECT bid, item_id, unnest(ws) w, unnest(range(0, len(ws))) p, len(ws) n FROM bw),
q AS (SELECT DISTINCT item_id, {WINDOW} k, g FROM (SELECT item_id, {_gram(WINDOW)} g FROM bt WINDOW o AS (PARTITION BY bid ORDER BY p)) WHERE g IS NOT NULL UNION SELECT item_id, len(ws), array_to_string(ws, ' ') FROM b WHERE len(ws) BETWEEN 1 AND {WINDOW - 1}),
t AS (SELECT rid, unnest(ws) w, unnest(range(0, len(ws))) p FROM d), g AS (SELECT rid, p, {", ".join(f"{_gram(k)} g{k}" for k in range(1, WINDOW + 1))} FROM t WINDOW o AS (PARTITION BY rid ORDER BY p)),
h AS ({" UNION ALL ".join(f"SELECT rid, p, k, item_id FROM g JOIN q ON k = {k} AND g{k} = q.g" for k in range(1, WINDOW + 1))}),
n AS (SELECT rid, count(DISTINCT p) n_hit FROM (SELECT rid, unnest(range(p, p + k)) p FROM (SELECT DISTINCT rid, p, k FROM h)) GROUP BY 1), i AS (SELECT rid, count(*) n_items, string_agg(item_id, ',' ORDER BY item_id) ids FROM (SELECT DISTINCT rid, CAST(item_id AS VARCHAR) item_id FROM h WHERE item_id IS NOT NULL) GROUP BY 1)
SELECT doc_id, len(ws) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated FROM d LEFT JOIN n USING (rid) LEFT JOIN i USING (rid)"""

OP6 = rf"""WITH RECURSIVE d AS (SELECT doc_id, {_words(r"[^\x20\x09-\x0D]+")} ws FROM documents), t AS (SELECT doc_id, unnest(ws) w, unnest(range(0, len(ws))) p FROM d WHERE len(ws) >= {WIDTH}),
s AS (SELECT DISTINCT doc_id, hash(g) g, hash(g || 'x') h FROM (SELECT doc_id, {_gram(WIDTH)} g FROM t WINDOW o AS (PARTITION BY doc_id ORDER BY p)) WHERE g IS NOT NULL UNION SELECT doc_id, hash('short ' || array_to_string(ws, ' ')), hash(array_to_string(ws, ' ')) FROM d WHERE len(ws) BETWEEN 1 AND {WIDTH - 1}),
n AS (SELECT doc_id, count(*) n FROM s GROUP BY 1), x AS (SELECT a.doc_id a, b.doc_id b, count(*) k FROM s a JOIN s b ON a.g = b.g AND a.h = b.h AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM x JOIN n i ON i.doc_id = a JOIN n j ON j.doc_id = b WHERE 100 * k >= 85 * (i.n + j.n - k)), e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r AS (SELECT DISTINCT a v, a c FROM e UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.v WHERE r.c < e.b), m AS (SELECT v, min(c) c FROM r GROUP BY 1)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(m.c, d.doc_id) AS component_id FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN m ON m.v = d.doc_id"""

OP8 = f"""WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) h FROM documents), c AS (SELECT doc_id, k, substr(h, {2 * CHUNK} * k + 1, {2 * CHUNK + 2 * LENGTH - 2}) s FROM (SELECT doc_id, h, unnest(range(0, len(h) // {2 * CHUNK} + 1)) k FROM d)),
p AS (SELECT doc_id, {CHUNK} * k + j AS p, substr(s, 2 * j + 1, {2 * LENGTH}) g FROM (SELECT doc_id, k, s, unnest(range(0, least({CHUNK}, len(s) // 2 - {LENGTH - 1}))) j FROM c WHERE len(s) >= {2 * LENGTH})),
a AS (SELECT doc_id, p, row_number() OVER (PARTITION BY g, g2 ORDER BY doc_id, p) r FROM (SELECT doc_id, p, hash(g) g, hash(g || 'x') g2 FROM p)),
i AS (SELECT doc_id, p, sum(CASE WHEN p > b + {LENGTH} THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY p) run FROM (SELECT doc_id, p, lag(p) OVER (PARTITION BY doc_id ORDER BY p) b FROM a WHERE r > 1)),
z AS (SELECT doc_id, min(p) f, max(p) + {LENGTH} t FROM i GROUP BY doc_id, run), y AS (SELECT doc_id, f, t, lag(t, 1, 0) OVER (PARTITION BY doc_id ORDER BY f) b FROM z),
g AS (SELECT doc_id, sum(t - f) removed, count(*) spans, string_agg(substr(h, 2 * b + 1, 2 * (f - b)), '' ORDER BY f) || substr(any_value(h), 2 * max(t) + 1) kept FROM y JOIN d USING (doc_id) GROUP BY 1)
SELECT doc_id, len(h) // 2 AS n_bytes, coalesce(removed, 0)::BIGINT AS n_removed, coalesce(spans, 0) AS n_spans, sha256(unhex(coalesce(kept, h))) AS kept_sha256 FROM d LEFT JOIN g USING (doc_id)"""

#: A word is lost if a repeated window of 35 begins at it or at one of the 34 before it.
OP11 = rf"""WITH d AS (SELECT doc_id, row_number() OVER () rid, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') ws FROM documents), t AS (SELECT rid, unnest(ws) w, unnest(range(0, len(ws))) p FROM d),
g AS (SELECT rid, p, w, {_gram(35)} g FROM t WINDOW o AS (PARTITION BY rid ORDER BY p)), r AS (SELECT rid, p, w, g IS NOT NULL AND count(*) OVER (PARTITION BY hash(g), hash(g || 'x')) > 1 l FROM g),
k AS (SELECT rid, p, w, max(CASE WHEN l THEN 1 ELSE 0 END) OVER (PARTITION BY rid ORDER BY p ROWS 34 PRECEDING) x FROM r), n AS (SELECT rid, sum(x) removed, string_agg(w, ' ' ORDER BY p) FILTER (WHERE x = 0) kept FROM k GROUP BY 1)
SELECT doc_id, len(ws) AS n_words, coalesce(removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN n USING (rid)"""

_ROUND = """, m{r} AS MATERIALIZED (SELECT rid, min((list_inner_product(x, x) - 2 * list_inner_product(x, c) + list_inner_product(c, c))::BIGINT * 64 + k) m FROM v, c{r} GROUP BY 1)"""
_MOVE = """, c{n} AS MATERIALIZED (SELECT k, coalesce(z, c) c FROM c{r} LEFT JOIN (SELECT k, list(y ORDER BY j) z FROM (SELECT m % 64 k, j, floor(sum(y) / count(*)) y FROM (SELECT m, unnest(x) y, unnest(range(0, 64)) j FROM v JOIN m{r} USING (rid)) GROUP BY ALL) GROUP BY k) USING (k))"""
#: Distances and numbers of centroids are packed into one number, of which the smallest counts; doubles hold whole numbers here.
OP12 = (
    """WITH v AS MATERIALIZED (SELECT row_number() OVER () rid, vec_id, list_transform(embedding, lambda e: floor(256 * e::DOUBLE)) x FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda e: e IS NOT NULL AND isfinite(e))) = 64),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h, x) - 1 k, x c FROM (SELECT sha256('2:' || vec_id) h, x FROM v ORDER BY ALL LIMIT 40))"""
    + "".join(_ROUND.format(r=r) + _MOVE.format(r=r, n=r + 1) for r in range(5))
    + _ROUND.format(r=5)
    + """ SELECT vec_id, (m % 64)::INT AS cluster, m // 64 AS distance, (sum(m // 64) OVER (PARTITION BY m % 64))::BIGINT AS cluster_inertia, (sum(m // 64) OVER ())::BIGINT AS inertia, sha256(array_to_string(list_transform(c, lambda e: e::BIGINT), ',')) AS centroid_sha256 FROM m5 JOIN v USING (rid) JOIN c5 ON k = m % 64"""
)
