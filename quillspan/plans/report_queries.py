"""Quality reports, joins of record, evaluation and vector queries."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import rounded
from ..operators import reports as r
from ..operators import vectors as v
from .base import query, table


@query("""SELECT count(*) AS total, count(DISTINCT p_name) AS distinct_names, count(*) FILTER (WHERE p_size > 25) AS large, count(*) FILTER (WHERE p_type LIKE 'PROMO%') AS promo, count(*) FILTER (WHERE p_name IS NULL OR p_name = '') AS missing_name,
count(*) FILTER (WHERE p_retailprice > 1000) AS dear, count(DISTINCT p_brand) AS brands, min(p_size) AS smallest, max(p_size) AS largest FROM part""")
def catalog_totals(spark, sf_dir):
    return table(spark, sf_dir, "part").agg(
        F.count(F.lit(1)).alias("total"), F.count_distinct("p_name").alias("distinct_names"), F.count_if(F.col("p_size") > 25).alias("large"), F.count_if(F.col("p_type").startswith("PROMO")).alias("promo"),
        F.count_if(F.coalesce("p_name", F.lit("")) == "").alias("missing_name"), F.count_if(F.col("p_retailprice") > 1000).alias("dear"), F.count_distinct("p_brand").alias("brands"), F.min("p_size").alias("smallest"), F.max("p_size").alias("largest"),
    )


@query("SELECT lower(p_name) AS key, count(*) AS n, array_to_string(list_sort(list(p_partkey)), ',') AS members FROM part GROUP BY 1 HAVING count(*) > 1")
def dup_labels(spark, sf_dir):
    d = r.duplicates(table(spark, sf_dir, "part"), F.lower("p_name"), F.col("p_partkey"))
    return d.select("key", "n", F.array_join(F.transform("members", lambda x: x.cast("string")), ",").alias("members"))


@query("SELECT p_type AS key, count(*) AS n, count(DISTINCT p_name) AS n_labels FROM part GROUP BY 1 HAVING count(DISTINCT p_name) > 1")
def ambiguous_labels(spark, sf_dir):
    return r.ambiguous(table(spark, sf_dir, "part"), F.col("p_type"), F.col("p_name"))


@query("""WITH t AS (SELECT DISTINCT p_brand || p_size k, list_sort(list_distinct(regexp_extract_all(lower(p_name), '[a-z]+'))) t FROM part), c AS (SELECT DISTINCT a.k FROM t a JOIN t b ON a.k = b.k WHERE NOT list_has_any(a.t, b.t))
SELECT DISTINCT p_brand || p_size AS shared, CASE WHEN c.k IS NOT NULL THEN 'SUSPECT' ELSE 'VALID' END AS status FROM part LEFT JOIN c ON c.k = p_brand || p_size""")
def label_integrity(spark, sf_dir):
    d = table(spark, sf_dir, "part").withColumn("shared", F.concat("p_brand", F.col("p_size").cast("string")))
    return r.integrity(d, "shared", "p_name")


@query("""WITH l AS (SELECT DISTINCT o_custkey k FROM orders), x AS (SELECT CASE WHEN c_custkey % 5 = 0 THEN -c_custkey ELSE c_custkey END k, CASE WHEN c_custkey % 7 = 0 THEN '' ELSE c_name END t FROM customer)
SELECT l.k, CASE WHEN x.k IS NULL THEN 'missing' WHEN coalesce(t, '') = '' THEN 'empty_title' ELSE 'matched' END AS bucket FROM l LEFT JOIN x USING (k) UNION ALL SELECT k, 'right_only' FROM x WHERE k NOT IN (SELECT k FROM l)""")
def locale_join(spark, sf_dir):
    l = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k")).distinct()
    return r.locale_join(l, _titles(spark, sf_dir), "k", "t")


def _titles(spark, sf_dir):
    k = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(F.when(k % 5 == 0, -k).otherwise(k).alias("k"), F.when(k % 7 == 0, "").otherwise(F.col("c_name")).alias("t"))


@query("""WITH l AS (SELECT DISTINCT o_custkey k FROM orders), x AS (SELECT CASE WHEN c_custkey % 5 = 0 THEN -c_custkey ELSE c_custkey END k, CASE WHEN c_custkey % 7 = 0 THEN '' ELSE c_name END t FROM customer)
SELECT count(l.k) AS left_rows, count(x.k) AS right_rows, count(*) FILTER (WHERE l.k IS NOT NULL AND coalesce(t, '') <> '') AS matched, count(*) FILTER (WHERE l.k IS NOT NULL AND x.k IS NULL) AS missing, count(*) FILTER (WHERE l.k IS NOT NULL AND t = '') AS empty_title, count(*) FILTER (WHERE l.k IS NULL) AS right_only FROM l FULL JOIN x USING (k)""")
def locale_counts(spark, sf_dir):
    l = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k")).distinct()
    return r.locale_counts(r.locale_join(l, _titles(spark, sf_dir), "k", "t"))


@query("""SELECT l_orderkey, l_linenumber, o_orderstatus AS status, p_name AS asset, s_name AS source, n_name AS origin, CASE o_orderstatus WHEN 'F' THEN 'VERIFIED' WHEN 'O' THEN 'REVIEW_REQUIRED' ELSE 'UNRESOLVED' END AS verification
FROM lineitem LEFT JOIN orders ON o_orderkey = l_orderkey LEFT JOIN part ON p_partkey = l_partkey LEFT JOIN supplier ON s_suppkey = l_suppkey LEFT JOIN nation ON n_nationkey = s_nationkey""")
def lineage(spark, sf_dir):
    t = lambda n: table(spark, sf_dir, n)
    d = t("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").join(t("orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderstatus"), "l_orderkey", "left")
    d = d.join(t("part").select(F.col("p_partkey").alias("l_partkey"), "p_name"), "l_partkey", "left")
    s = t("supplier").join(t("nation"), F.col("n_nationkey") == F.col("s_nationkey"), "left").select(F.col("s_suppkey").alias("l_suppkey"), "s_name", "n_name")
    d = d.join(s, "l_suppkey", "left")
    o = F.col("o_orderstatus")
    return d.select("l_orderkey", "l_linenumber", o.alias("status"), F.col("p_name").alias("asset"), F.col("s_name").alias("source"), F.col("n_name").alias("origin"), F.when(o == "F", "VERIFIED").when(o == "O", "REVIEW_REQUIRED").otherwise("UNRESOLVED").alias("verification"))


@query("""WITH o AS (SELECT p_partkey id, p_brand, p_name FROM part WHERE p_partkey % 2 = 0), n AS (SELECT p_brand, p_name, min(p_partkey) k FROM part WHERE p_partkey % 2 = 1 GROUP BY ALL), f AS (SELECT * FROM n ANTI JOIN o USING (p_brand, p_name))
SELECT * FROM o UNION ALL SELECT row_number() OVER (ORDER BY k) + (SELECT max(id) FROM o), p_brand, p_name FROM f""")
def merge_dedupe(spark, sf_dir):
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), "p_brand", "p_name")
    old, new = p.where("id % 2 = 0"), p.where("id % 2 = 1").withColumn("k", F.col("id"))
    return r.merge_new(old, new, ["p_brand", "p_name"], "id", "k")


@query("SELECT conv_id, turn, role FROM conversations WHERE conv_id NOT IN (SELECT doc_id FROM labels)")
def resume_antijoin(spark, sf_dir):
    done = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("conv_id"))
    return table(spark, sf_dir, "conversations").join(done, "conv_id", "left_anti").select("conv_id", "turn", "role")


@query("""WITH a AS (SELECT 'm' || doc_id % 2 AS model, lang AS category, CASE WHEN n_chars % 11 = 0 THEN NULL WHEN n_chars > 800 THEN 1 ELSE 0 END pred, quality FROM documents JOIN labels USING (doc_id)),
g AS (SELECT model, category, count(*) n, count(*) FILTER (WHERE pred = quality) correct, count(*) FILTER (WHERE pred IS NOT NULL) parsed FROM a GROUP BY GROUPING SETS ((model, category), (model)))
SELECT model, category, n, correct, floor(correct * 100.0::DOUBLE / n * 100.0::DOUBLE + 0.5::DOUBLE) / 100.0::DOUBLE AS accuracy, floor(parsed * 100.0::DOUBLE / n * 100.0::DOUBLE + 0.5::DOUBLE) / 100.0::DOUBLE AS parse_rate FROM g""")
def accuracy_rollup(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars").join(table(spark, sf_dir, "labels"), "doc_id")
    d = d.select(F.concat(F.lit("m"), (F.col("doc_id") % 2).cast("string")).alias("model"), F.col("lang").alias("category"), F.when(F.col("n_chars") % 11 == 0, None).when(F.col("n_chars") > 800, 1).otherwise(0).alias("pred"), "quality")
    return r.accuracy(d, "model", "category", F.col("pred") == F.col("quality"), F.col("pred").isNotNull())


_PAIRS = "p AS (SELECT conv_id, turn, regexp_extract_all(lower(text), '[a-z]+') a, regexp_extract_all(lower(lag(text) OVER (PARTITION BY conv_id ORDER BY turn)), '[a-z]+') b FROM conversations)"


def _pairs(spark, sf_dir):
    words = lambda c: F.regexp_extract_all(F.lower(c), F.lit("([a-z]+)"), F.lit(1))
    c = table(spark, sf_dir, "conversations").withColumn("prev", F.lag("text").over(W.partitionBy("conv_id").orderBy("turn"))).where("prev is not null")
    return c.select("conv_id", "turn", words(F.col("text")).alias("a"), words(F.col("prev")).alias("b"))


@query(f"WITH {_PAIRS}, u AS (SELECT conv_id, turn, len(list_intersect(list_distinct(a), list_distinct(b))) i, len(list_distinct(list_concat(a, b))) u FROM p WHERE b IS NOT NULL) SELECT conv_id, turn, CASE WHEN u = 0 THEN 0.0::DOUBLE ELSE i / u::DOUBLE END AS jaccard FROM u")
def jaccard(spark, sf_dir):
    return _pairs(spark, sf_dir).select("conv_id", "turn", v.jaccard(F.col("a"), F.col("b")).alias("jaccard"))


@query(f"""WITH {_PAIRS}, x AS (SELECT conv_id, turn, w, count(*) n FROM (SELECT conv_id, turn, unnest(a) w FROM p WHERE b IS NOT NULL) GROUP BY ALL), y AS (SELECT conv_id, turn, w, count(*) m FROM (SELECT conv_id, turn, unnest(b) w FROM p WHERE b IS NOT NULL) GROUP BY ALL),
o AS (SELECT conv_id, turn, sum(least(n, m))::BIGINT o FROM x JOIN y USING (conv_id, turn, w) GROUP BY ALL) SELECT conv_id, turn, CASE WHEN len(a) + len(b) > 0 THEN 2.0::DOUBLE * coalesce(o, 0) / (len(a) + len(b)) ELSE 0.0::DOUBLE END AS rouge1 FROM p LEFT JOIN o USING (conv_id, turn) WHERE b IS NOT NULL""")
def rouge1(spark, sf_dir):
    return v.rouge1(_pairs(spark, sf_dir), ["conv_id", "turn"], "a", "b")


_GRAMS = lambda c, n: f"list_transform(range(1, greatest(1, len({c}) - {n - 2})), lambda i: array_to_string(list_slice({c}, i, i + {n - 1}), ' '))"
_BLEU = "".join(
    f", g{n} AS (SELECT *, coalesce(list_sum(list_transform(list_distinct(c{n}), lambda g: least(len(list_filter(c{n}, lambda z: z = g)), len(list_filter(r{n}, lambda z: z = g))))), 0)::DOUBLE h{n}, greatest(1, len(b) - {n - 1})::DOUBLE t{n} FROM (SELECT *, {_GRAMS('a', n)} r{n}, {_GRAMS('b', n)} c{n} FROM {f'g{n - 1}' if n > 1 else 'q'}))"
    for n in range(1, 5)
)


def _hit(n: int) -> str:
    zeros = " + ".join([*(f"CAST(h{k} = 0 AS INT)" for k in range(1, n)), "1"])
    return f"ln(CASE WHEN h{n} = 0 THEN 1 / (2 ** ({zeros}) * 5 / ln(len(b))) ELSE h{n} END / t{n})"


# the longest common subsequence row by row (one recursion step for each word of a), and BLEU-4 over lists of n-grams
@query(f"""WITH RECURSIVE {_PAIRS}, q AS (SELECT conv_id, turn, a, b FROM p WHERE b IS NOT NULL){_BLEU},
l AS (SELECT conv_id, turn, 0 k, list_transform(range(0, len(b) + 1), lambda j: 0::BIGINT) w FROM q UNION ALL
SELECT q.conv_id, q.turn, l.k + 1, list_reduce(list_prepend([0::BIGINT], list_transform(range(1, len(b) + 1), lambda j: [j])), lambda x, j: list_append(x, CASE WHEN a[l.k + 1] = b[j[1]] THEN l.w[j[1]] + 1 ELSE greatest(l.w[j[1] + 1], x[j[1]]) END)) FROM l JOIN q ON q.conv_id = l.conv_id AND q.turn = l.turn WHERE l.k < len(a)),
f AS (SELECT l.conv_id, l.turn, l.w[len(b) + 1] n FROM l JOIN q ON q.conv_id = l.conv_id AND q.turn = l.turn AND l.k = len(a))
SELECT g4.conv_id, g4.turn, CASE WHEN len(a) + len(b) > 0 THEN floor(2.0::DOUBLE * n / (len(a) + len(b)) * 1e6 + 0.5::DOUBLE) / 1e6 ELSE 0.0::DOUBLE END AS rouge_l,
CASE WHEN len(b) < 2 THEN 0.0::DOUBLE ELSE floor(exp(least(0.0::DOUBLE, 1 - len(a)::DOUBLE / len(b)) + 0.25::DOUBLE * {" + 0.25::DOUBLE * ".join(map(_hit, range(1, 5)))}) * 1e6 + 0.5::DOUBLE) / 1e6 END AS bleu FROM g4 JOIN f ON f.conv_id = g4.conv_id AND f.turn = g4.turn""")
def sequence_scores(spark, sf_dir):
    d = v.sequence_scores(_pairs(spark, sf_dir), ["conv_id", "turn"], "a", "b")
    return d.select("conv_id", "turn", rounded(F.col("rouge_l")).alias("rouge_l"), rounded(F.col("bleu")).alias("bleu"))


_COS = "list_cosine_similarity(q.embedding::DOUBLE[], e.embedding::DOUBLE[])"


def _vectors(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("v"))


@query(f"WITH s AS (SELECT q.vec_id query_id, e.vec_id, {_COS} c FROM embeddings q, embeddings e WHERE q.vec_id % 20 = 0 AND q.vec_id <> e.vec_id), k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY c DESC, vec_id) rank FROM s) SELECT query_id, CAST(rank AS INT) AS rank, vec_id, floor(c * 1e4 + 0.5::DOUBLE) / 1e4 AS similarity FROM k WHERE rank <= 5")
def knn(spark, sf_dir):
    x = _vectors(spark, sf_dir)
    d = v.nearest(x.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("v").alias("q")), x)
    return d.select("query_id", "rank", "vec_id", rounded(F.col("similarity"), 4).alias("similarity"))


@query(f"SELECT q.vec_id AS a, e.vec_id AS b, floor({_COS} * 1e4 + 0.5::DOUBLE) / 1e4 AS similarity FROM embeddings q JOIN embeddings e ON q.vec_id < e.vec_id WHERE {_COS} >= 0.35")
def sim_pairs(spark, sf_dir):
    d = v.similar_pairs(_vectors(spark, sf_dir), 0.35)
    return d.select("a", "b", rounded(F.col("similarity"), 4).alias("similarity"))


@query(f"""WITH RECURSIVE p AS (SELECT q.vec_id a, e.vec_id b FROM embeddings q JOIN embeddings e ON q.vec_id <> e.vec_id WHERE {_COS} >= 0.35), r AS (SELECT DISTINCT a v, a l FROM p UNION SELECT p.b, r.l FROM r JOIN p ON p.a = r.v WHERE r.l < p.b)
SELECT v AS vec_id, min(l) AS cluster FROM r GROUP BY v""")
def clusters(spark, sf_dir):
    return v.clusters(v.similar_links(_vectors(spark, sf_dir), 0.35))


@query(f"""WITH RECURSIVE p AS (SELECT q.vec_id a, e.vec_id b FROM embeddings q JOIN embeddings e ON q.vec_id <> e.vec_id WHERE {_COS} >= 0.35), r AS (SELECT DISTINCT a v, a l FROM p UNION SELECT p.b, r.l FROM r JOIN p ON p.a = r.v WHERE r.l < p.b), c AS (SELECT v, min(l) l FROM r GROUP BY v),
g AS (SELECT coalesce(l, vec_id) AS cluster, count(*) AS size, string_agg(CAST(vec_id AS VARCHAR), ',' ORDER BY vec_id) AS members FROM embeddings LEFT JOIN c ON v = vec_id GROUP BY 1)
SELECT cluster, size, members, CASE WHEN size > 1 THEN 'CLUSTER_' || CAST(1 + (SELECT count(*) FROM g h WHERE h.size > 1 AND (h.size > g.size OR h.size = g.size AND h.cluster < g.cluster)) AS VARCHAR) ELSE 'SINGLETON_' || CAST(cluster AS VARCHAR) END AS name FROM g""")
def cluster_summary(spark, sf_dir):
    x = _vectors(spark, sf_dir)
    d = v.cluster_summary(x.select("vec_id"), v.clusters(v.similar_links(x, 0.35)))
    return d.select("cluster", "size", F.array_join(F.transform("members", lambda m: m.cast("string")), ",").alias("members"), "name")


@query(f"""WITH s AS (SELECT q.vec_id query_id, q.label ql, e.label el, e.vec_id, {_COS} c FROM embeddings q, embeddings e WHERE q.vec_id <> e.vec_id), k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY c DESC, vec_id) rank FROM s),
h AS (SELECT query_id, max(CASE WHEN rank = 1 AND ql = el THEN 1 ELSE 0 END) h1, max(CASE WHEN rank <= 5 AND ql = el THEN 1 ELSE 0 END) h5 FROM k GROUP BY 1)
SELECT count(*) AS n, floor(sum(h1) * 1000.0::DOUBLE / count(*) + 0.5::DOUBLE) / 1000.0::DOUBLE AS recall_1, floor(sum(h5) * 1000.0::DOUBLE / count(*) + 0.5::DOUBLE) / 1000.0::DOUBLE AS recall_5 FROM h""")
def recall_at_k(spark, sf_dir):
    x = _vectors(spark, sf_dir)
    lab = table(spark, sf_dir, "embeddings").select("vec_id", "label")
    d = v.nearest(None, x)
    d = d.join(lab.withColumnRenamed("label", "el"), "vec_id").join(lab.select(F.col("vec_id").alias("query_id"), F.col("label").alias("ql")), "query_id")
    hit = lambda c: F.when(c & (F.col("ql") == F.col("el")), 1).otherwise(0)
    h = d.groupBy("query_id").agg(F.max(hit(F.col("rank") == 1)).alias("h1"), F.max(hit(F.col("rank") <= 5)).alias("h5"))
    frac = lambda c: F.floor(F.sum(c) * 1000.0 / F.count(F.lit(1)) + 0.5) / 1000.0
    return h.agg(F.count(F.lit(1)).alias("n"), frac("h1").alias("recall_1"), frac("h5").alias("recall_5"))


@query("""WITH s AS (SELECT d.doc_id, b.item_id, contains(d.text, trim(b.text)) ok FROM documents d JOIN benchmark b ON d.doc_id % 40 = b.item_id), i AS (SELECT doc_id, CASE toxic WHEN 1 THEN 'REVIEW_REQUIRED' ELSE CASE quality WHEN 0 THEN 'FINGERSPELL_CANDIDATE' ELSE 'VERIFIED' END END status FROM labels),
a AS (SELECT doc_id, count(*) n_units, count(*) FILTER (WHERE NOT ok) n_failed FROM s GROUP BY 1), c AS (SELECT doc_id, count(*) FILTER (WHERE status = 'REVIEW_REQUIRED') n_review, count(*) FILTER (WHERE status = 'FINGERSPELL_CANDIDATE') f FROM i GROUP BY 1)
SELECT doc_id, n_units, n_failed, coalesce(n_review, 0) AS n_review, CASE WHEN n_failed > 0 THEN 'BLOCKED' WHEN coalesce(n_review, 0) > 0 THEN 'REVIEW_REQUIRED' WHEN coalesce(f, 0) > 0 THEN 'PASS_WITH_FALLBACK' ELSE 'PASS' END AS overall FROM a LEFT JOIN c USING (doc_id)""")
def validation_rollup(spark, sf_dir):
    from ..operators.grounding import span_in

    d = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("source"), (F.col("doc_id") % 40).alias("item_id"))
    s = d.join(table(spark, sf_dir, "benchmark"), "item_id").select("doc_id", span_in(F.col("source"), F.col("text")).alias("ok"))
    i = table(spark, sf_dir, "labels").select("doc_id", F.when(F.col("toxic") == 1, "REVIEW_REQUIRED").when(F.col("quality") == 0, "FINGERSPELL_CANDIDATE").otherwise("VERIFIED").alias("status"))
    return r.validation(s, i)


@query("SELECT conv_id, CASE WHEN arg_max(role, turn) = 'system' THEN 'blocked' WHEN arg_max(role, turn) <> 'assistant' THEN 'error' ELSE 'done' END AS job_status FROM conversations GROUP BY 1")
def job_status(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    return r.job_status(c, "conv_id", "turn", F.col("role"), F.when(F.col("role") == "system", "blocked").otherwise("ok"), "assistant")


@query("SELECT conv_id, max(turn) AS last_turn, count(*) AS n_turns FROM conversations GROUP BY 1 ORDER BY 1 DESC LIMIT 50")
def job_history(spark, sf_dir):
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.max("turn").alias("last_turn"), F.count(F.lit(1)).alias("n_turns")).orderBy(F.desc("conv_id")).limit(50)


@query("WITH c AS (SELECT s_nationkey k, count(*) n FROM supplier GROUP BY 1), t AS (SELECT sum(n) t FROM c) SELECT n_name, coalesce(n, 0) AS n, floor(coalesce(n, 0) * 100.0::DOUBLE / t * 10.0::DOUBLE + 0.5::DOUBLE) / 10.0::DOUBLE AS share FROM nation LEFT JOIN c ON k = n_nationkey, t")
def signer_share(spark, sf_dir):
    c = table(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.count(F.lit(1)).alias("n"))
    t = c.agg(F.sum("n").alias("t"))
    return table(spark, sf_dir, "nation").join(c, "n_nationkey", "left").crossJoin(F.broadcast(t)).select("n_name", F.coalesce("n", F.lit(0)).alias("n"), (F.floor(F.coalesce("n", F.lit(0)) * 100.0 / F.col("t") * 10.0 + 0.5) / 10.0).alias("share"))


@query("""WITH w AS (SELECT user_id, min(value) a, max(value) b FROM events GROUP BY 1) SELECT event_id, greatest(value - 5, a) AS start_s, least(value + 5, b) AS end_s FROM events JOIN w USING (user_id) WHERE least(value + 5, b) > greatest(value - 5, a)""")
def interval_cap(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "value")
    w = e.groupBy("user_id").agg(F.min("value").alias("a"), F.max("value").alias("b"))
    return e.join(w, "user_id").select("event_id", F.greatest(F.col("value") - 5, "a").alias("start_s"), F.least(F.col("value") + 5, "b").alias("end_s")).where("end_s > start_s")


@query("SELECT conv_id, string_agg('- ' || turn || ': ' || role, chr(10) ORDER BY turn) AS markdown FROM conversations GROUP BY 1")
def review_markdown(spark, sf_dir):
    return r.review_markdown(table(spark, sf_dir, "conversations"), "conv_id", "turn", F.concat(F.lit("- "), F.col("turn").cast("string"), F.lit(": "), F.col("role")))
