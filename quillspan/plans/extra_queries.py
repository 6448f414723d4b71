"""Queries for the smaller operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import rounded
from ..operators import extras as x
from ..operators import motion as m
from ..operators.selection import medians
from .base import query, table
from .motion_queries import _V, hands
from .series_queries import _S, KEY, events


@query("""WITH c AS (SELECT conv_id d, turn o, role c, text s, turn % 3 <> 0 v FROM conversations), k AS (SELECT *, row_number() OVER (PARTITION BY d ORDER BY o) - 1 p FROM c WHERE v), z AS (SELECT conv_id d, turn p, text t FROM conversations),
g AS (SELECT k.d, k.p, k.c, t, coalesce(list_has_any(regexp_extract_all(lower(t), '[\\p{L}\\p{N}_]+'), regexp_extract_all(lower(s), '[\\p{L}\\p{N}_]+')), false) ok FROM k LEFT JOIN z ON z.d = k.d AND z.p = k.p)
SELECT d AS doc_id, printf('u%02d', p + 1) AS unit_id, c AS concept, CASE WHEN ok THEN t ELSE '' END AS sentence, ok AS grounded, NOT ok AS review_required FROM g""")
def structured_units(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    concepts = c.select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("ord"), F.col("role").alias("concept"), F.col("text").alias("span"), (F.col("turn") % 3 != 0).alias("verified"))
    return x.structured_units(concepts, c.select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("pos"), F.col("text").alias("sentence")))


@query("""WITH r AS (SELECT l_orderkey u, bool_or(l_returnflag = 'R') r FROM lineitem GROUP BY 1) SELECT o_orderkey AS unit_id, o_totalprice > 300000 OR o_orderstatus = 'P' OR o_orderpriority = '1-URGENT' OR coalesce(r, false) AS review FROM orders LEFT JOIN r ON u = o_orderkey""")
def unit_flags(spark, sf_dir):
    u = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("unit_id"), (F.col("o_totalprice") > 300000).alias("review_required"), (F.col("o_orderstatus") == "P").alias("loss"), F.when(F.col("o_orderpriority") == "1-URGENT", "REVIEW_REQUIRED").otherwise("OK").alias("plan_status"))
    r = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("unit_id"), (F.col("l_returnflag") == "R").alias("review_required"))
    return x.unit_flags(u, r)


@query("SELECT o_orderkey, o_orderstatus AS status, CASE WHEN o_orderkey % 5 = 0 THEN false ELSE true END AS included FROM orders WHERE o_orderstatus = 'O'")
def trace_filter(spark, sf_dir):
    i = F.when(F.col("o_orderkey") % 5 == 0, False).when(F.col("o_orderkey") % 5 == 1, True)
    return x.status_filter(table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderstatus").alias("status"), i.alias("included")), "O")


@query(f"""WITH {_V} SELECT vec_id, list_bool_or(list_transform(range(0, 21), lambda i: sqrt((e[3 * i + 1] - e[1]) * (e[3 * i + 1] - e[1]) + (e[3 * i + 2] - e[2]) * (e[3 * i + 2] - e[2])) < 0.75::DOUBLE * 2 * sqrt((e[1] - e[4]) * (e[1] - e[4]) + (e[2] - e[5]) * (e[2] - e[5])) AND i > 1)) AS covered,
e[1] > 0.5 AND e[2] BETWEEN 0 AND 1 AND e[3] BETWEEN 0 AND 1 AS expected FROM v""")
def face_covered(spark, sf_dir):
    h = F.col("hand")
    rest = F.slice(h, 3, 19)
    p0 = m.point(h, 0)
    return hands(spark, sf_dir).select("vec_id", x.face_covered(rest, p0, m.point(h, 1)).alias("covered"), x.hand_expected(p0["x"], p0["y"], p0["z"]).alias("expected"))


@query("SELECT p_partkey, contains(lower(p_name), 'ring') OR contains(lower(p_name), 'bolt') AS relevant FROM part")
def mentions(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", x.mentions(F.col("p_name"), F.array(F.lit("ring"), F.lit("bolt"))).alias("relevant"))


@query("""WITH s AS (SELECT lower(trim(p_name)) k, arg_min(p_type, p_partkey) o FROM part WHERE p_partkey % 3 = 0 GROUP BY 1), r AS (SELECT *, CASE WHEN p_partkey % 2 = 0 AND p_brand <> '' THEN p_brand END own FROM part)
SELECT p_partkey AS key, coalesce(own, o) AS caption, CASE WHEN own IS NOT NULL THEN 'PRIMARY' WHEN o IS NOT NULL THEN 'SUPPLEMENTARY' ELSE 'NONE' END AS caption_source FROM r LEFT JOIN s ON k = lower(trim(p_name))""")
def caption_fallback(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    rows = p.select(F.col("p_partkey").alias("key"), F.col("p_name").alias("en"), F.col("p_brand").alias("ar"), F.when(F.col("p_partkey") % 2 == 0, "VALID").otherwise("SUSPECT").alias("integrity"))
    return x.caption_with_fallback(rows, p.where("p_partkey % 3 = 0").select(F.col("p_name").alias("en"), F.col("p_type").alias("ar"), F.col("p_partkey").alias("ord")))


@query("""SELECT o_custkey, count(*) AS n_items, count(*) FILTER (WHERE o_orderkey % 3 = 0) AS n_primary, count(*) FILTER (WHERE o_orderkey % 3 = 1) AS n_supplementary, count(*) FILTER (WHERE o_orderkey % 3 = 2) AS n_fingerspell, count(*) FILTER (WHERE o_orderstatus = 'F') AS n_verified, count(*) FILTER (WHERE o_orderstatus = 'O') AS n_review_required, count(*) FILTER (WHERE o_orderstatus = 'P') AS n_unsupported FROM orders GROUP BY 1""")
def plan_metrics(spark, sf_dir):
    k, s = F.col("o_orderkey") % 3, F.col("o_orderstatus")
    d = table(spark, sf_dir, "orders").select("o_custkey", F.when(k == 0, "PRIMARY").when(k == 1, "SUPPLEMENTARY").otherwise("FINGERSPELL").alias("render_source"), F.when(s == "F", "VERIFIED").when(s == "O", "REVIEW_REQUIRED").otherwise("UNSUPPORTED").alias("status"))
    return x.plan_metrics(d, "o_custkey")


@query(f"WITH {_V}, s AS (SELECT label, list_max(list_transform(range(0, 21), lambda i: e[3 * i + 1])) - list_min(list_transform(range(0, 21), lambda i: e[3 * i + 1])) a, list_max(list_transform(range(0, 21), lambda i: e[3 * i + 2])) - list_min(list_transform(range(0, 21), lambda i: e[3 * i + 2])) b FROM v) SELECT label, median(greatest(a, b)) AS span FROM s GROUP BY 1")
def hand_span(spark, sf_dir):
    return medians(hands(spark, sf_dir).select("label", x.hand_span(F.col("hand")).alias("_span")), "label", {"span": "_span"})


@query(f"WITH {_V}, p AS (SELECT label, unnest(range(0, 21)) i, e FROM v) SELECT label, CAST(i AS INT) AS i, floor(avg(e[3 * i + 1]) * 1e6 + 0.5::DOUBLE) / 1e6 AS x, floor(avg(e[3 * i + 2]) * 1e6 + 0.5::DOUBLE) / 1e6 AS y FROM p GROUP BY label, p.i")
def mean_contour(spark, sf_dir):
    return x.mean_contour(hands(spark, sf_dir), "label", "hand").select("label", "i", rounded(F.col("x")).alias("x"), rounded(F.col("y")).alias("y"))


@query("WITH g AS (SELECT c_nationkey k, stddev_pop(c_acctbal) t, stddev_pop(c_custkey::DOUBLE) b FROM customer GROUP BY 1) SELECT k, CASE WHEN b >= t THEN 'bottom' ELSE 'top' END AS band FROM g")
def band_energy(spark, sf_dir):
    d = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k"), F.col("c_acctbal").alias("t"), F.col("c_custkey").cast("double").alias("b"))
    return x.band_energy(d, "k", "t", "b").select("k", "band")


@query(f"WITH {_V}, l AS (SELECT label, vec_id, e, lag(e) OVER (PARTITION BY label ORDER BY vec_id) p FROM v) SELECT label, vec_id, CASE WHEN p IS NOT NULL THEN floor(list_sum(list_transform(range(1, 65), lambda i: abs(e[i] - p[i]))) * 1e6 + 0.5::DOUBLE) / 1e6 END AS step FROM l")
def signature_steps(spark, sf_dir):
    d = table(spark, sf_dir, "embeddings").select("label", "vec_id", F.transform("embedding", lambda v: v.cast("double")).alias("v"))
    return x.signature_steps(d, "label", "vec_id", "v").select("label", "vec_id", rounded(F.col("step")).alias("step"))


@query(f"WITH {_V}, w AS (SELECT *, sqrt((e[13] - e[16]) * (e[13] - e[16]) + (e[14] - e[17]) * (e[14] - e[17])) w FROM v) SELECT vec_id, floor((e[1] - e[4]) / w * 1e6 + 0.5::DOUBLE) / 1e6 AS x, floor((e[2] - e[5]) / w * 1e6 + 0.5::DOUBLE) / 1e6 AS y, floor(sqrt((e[7] - e[10]) * (e[7] - e[10]) + (e[8] - e[11]) * (e[8] - e[11])) / w * 1e6 + 0.5::DOUBLE) / 1e6 AS eye FROM w")
def relative_position(spark, sf_dir):
    p = lambda i: m.point(F.col("hand"), i)
    a, b = x.relative_position(p(0), p(1), p(4), p(5))
    face = F.hypot(p(4)["x"] - p(5)["x"], p(4)["y"] - p(5)["y"])
    eye, _ = x.face_ratios(p(2), p(3), p(2), p(3), face)
    return hands(spark, sf_dir).select("vec_id", rounded(a).alias("x"), rounded(b).alias("y"), rounded(eye).alias("eye"))


@query("SELECT p_partkey, CAST(trunc(p_size * 37 * 0.1::DOUBLE) AS INT) AS x0, CAST(trunc(p_size * 20 * 0.75::DOUBLE) AS INT) AS y0, CAST(trunc(p_size * 37 * 0.9::DOUBLE) AS INT) AS x1, CAST(trunc(p_size * 20 * 1.0::DOUBLE) AS INT) AS y1 FROM part")
def crop_box(spark, sf_dir):
    d = table(spark, sf_dir, "part").select("p_partkey", x.crop_box(F.col("p_size") * 37, F.col("p_size") * 20, (0.1, 0.75, 0.9, 1.0)).alias("b"))
    return d.select("p_partkey", "b.*")


@query(f"WITH {_S}, t AS (SELECT user_id, event_id, ts, row_number() OVER w done, (epoch_us(ts) - epoch_us(min(ts) OVER w)) / 1e6 el FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)) SELECT user_id, event_id, done, floor(el * 1e3 + 0.5::DOUBLE) / 1e3 AS elapsed, CASE WHEN el > 0 THEN floor((100 - done) / (done / el) * 1e3 + 0.5::DOUBLE) / 1e3 END AS eta FROM t")
def throughput(spark, sf_dir):
    d = x.throughput(table(spark, sf_dir, "events").select(KEY, "event_id", "ts"), KEY, "ts", F.lit(100))
    return d.select(KEY, "event_id", F.col("done").cast("long").alias("done"), rounded(F.col("elapsed"), 3).alias("elapsed"), rounded(F.col("eta"), 3).alias("eta"))


@query("SELECT p_partkey AS number, p_type AS category, p_name AS word FROM part")
def legend(spark, sf_dir):
    lines = table(spark, sf_dir, "part").select(F.concat(F.lpad(F.col("p_partkey").cast("string"), 7, "0"), F.lit(".jpg: "), "p_type", F.lit(" / "), "p_name").alias("value"))
    return x.legend(lines).select(F.col("number").cast("long").alias("number"), "category", "word")


@query(f"WITH {_S} SELECT count(*) AS n, floor(avg(CASE WHEN x > 50 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) * 1e3 + 0.5::DOUBLE) / 1e3 AS recall_1, floor(avg(CASE WHEN x > 20 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) * 1e3 + 0.5::DOUBLE) / 1e3 AS recall_k, CASE WHEN avg(CASE WHEN x > 50 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) >= 0.6 THEN 'USEFUL' ELSE 'NOT_USEFUL' END AS verdict FROM s WHERE x IS NOT NULL")
def recall_verdict(spark, sf_dir):
    d = x.recall_verdict(events(spark, sf_dir), F.col("x") > 50, F.col("x") > 20, F.col("x").isNotNull())
    return d.select("n", rounded(F.col("recall_1"), 3).alias("recall_1"), rounded(F.col("recall_k"), 3).alias("recall_k"), "verdict")
