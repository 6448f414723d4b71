"""Landmark geometry on hands made of embedding slices, and planning checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import rounded
from ..operators import motion as m
from ..operators import planning as p
from .base import query, sql_list, table

_P = lambda i: f"{{'x': e[{3 * i + 1}], 'y': e[{3 * i + 2}], 'z': e[{3 * i + 3}]}}"
_V = "v AS (SELECT vec_id, label, embedding::DOUBLE[] e FROM embeddings)"


def _angle(a: int, b: int, c: int) -> str:
    d = lambda i, k: f"(e[{3 * i + k}] - e[{3 * b + k}])"
    dot = " + ".join(f"{d(a, k)} * {d(c, k)}" for k in (1, 2, 3))
    n = "sqrt(" + " + ".join(f"{d(a, k)} * {d(a, k)}" for k in (1, 2, 3)) + ") * sqrt(" + " + ".join(f"{d(c, k)} * {d(c, k)}" for k in (1, 2, 3)) + ")"
    return f"floor((CASE WHEN {n} < 1e-9 THEN 180.0::DOUBLE ELSE degrees(acos(greatest(-1.0::DOUBLE, least(1.0::DOUBLE, ({dot}) / ({n}))))) END) * 1e6 + 0.5::DOUBLE) / 1e6"


def hands(spark, sf_dir):
    e = F.transform("embedding", lambda x: x.cast("double"))
    pts = F.transform(F.sequence(F.lit(0), F.lit(20)), lambda i: F.struct(*[F.get(F.col("e"), i * 3 + k).alias(n) for k, n in enumerate("xyz")]))
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", e.alias("e")).select("vec_id", "label", pts.alias("hand"))


@query(f"WITH {_V} SELECT vec_id, " + ", ".join(f"{_angle(*at)} AS {name}" for name, at in m.FINGERS.items()) + " FROM v")
def finger_angles(spark, sf_dir):
    return hands(spark, sf_dir).select("vec_id", *[rounded(c).alias(n) for n, c in m.finger_angles(F.col("hand")).items()])


_N = "n AS (SELECT vec_id, label, (uy * wz - uz * wy) nx, (uz * wx - ux * wz) ny, (ux * wy - uy * wx) nz FROM (SELECT vec_id, label, e[16] - e[1] ux, e[17] - e[2] uy, e[18] - e[3] uz, e[52] - e[1] wx, e[53] - e[2] wy, e[54] - e[3] wz FROM v)), l AS (SELECT *, sqrt(nx * nx + ny * ny + nz * nz) l FROM n)"


@query(f"WITH {_V}, {_N}, z AS (SELECT vec_id, CASE WHEN l >= 1e-6 THEN (CASE WHEN label % 2 = 1 THEN -1.0::DOUBLE ELSE 1.0::DOUBLE END) * nz / l END z FROM l) SELECT vec_id, CASE WHEN z IS NULL THEN 'undetermined' WHEN z < -0.15 THEN 'toward_camera' WHEN z > 0.15 THEN 'away_from_camera' ELSE 'edge_on' END AS facing FROM z")
def facing(spark, sf_dir):
    return hands(spark, sf_dir).select("vec_id", m.facing(m.palm_normal(F.col("hand"), F.col("label") % 2 == 1)).alias("facing"))


@query(f"WITH {_V} SELECT vec_id, floor(degrees(atan2(e[1] - e[4], e[5] - e[2])) * 1e6 + 0.5::DOUBLE) / 1e6 AS lean, CASE WHEN abs(e[3]) < 0.02 THEN 'blink' WHEN abs(e[3]) <= 0.035 THEN 'squint' ELSE 'open' END AS eye FROM v")
def torso_lean(spark, sf_dir):
    h = hands(spark, sf_dir)
    return h.select("vec_id", rounded(m.torso_lean(m.point(F.col("hand"), 0), m.point(F.col("hand"), 1))).alias("lean"), m.eye_state(F.abs(m.point(F.col("hand"), 0)["z"])).alias("eye"))


def _dist(a: int, b: int) -> str:
    return "sqrt(" + " + ".join(f"(e[{3 * a + k}] - e[{3 * b + k}]) * (e[{3 * a + k}] - e[{3 * b + k}])" for k in (1, 2, 3)) + ")"


@query(f"WITH {_V} SELECT vec_id, floor((CASE WHEN {_dist(9, 0)} > 1e-9 THEN ({_dist(8, 0)} + {_dist(12, 0)} + {_dist(16, 0)} + {_dist(20, 0)}) / 4.0::DOUBLE / {_dist(9, 0)} END) * 1e6 + 0.5::DOUBLE) / 1e6 AS openness, floor((CASE WHEN {_dist(9, 0)} > 1e-9 THEN {_dist(4, 8)} / {_dist(9, 0)} END) * 1e6 + 0.5::DOUBLE) / 1e6 AS thumb FROM v")
def hand_openness(spark, sf_dir):
    return hands(spark, sf_dir).select("vec_id", rounded(m.openness(F.col("hand"))).alias("openness"), rounded(m.thumb_opposition(F.col("hand"))[0]).alias("thumb"))


@query("""WITH p AS (SELECT label, unnest(range(0, 21)) i, embedding::DOUBLE[] e FROM embeddings), b AS (SELECT label, min(e[3 * i + 1]) x0, max(e[3 * i + 1]) x1, min(e[3 * i + 2]) y0, max(e[3 * i + 2]) y1 FROM p GROUP BY 1)
SELECT label, greatest(0.0::DOUBLE, least(1.0::DOUBLE, x0 - 0.25::DOUBLE * (x1 - x0))) AS x0, greatest(0.0::DOUBLE, least(1.0::DOUBLE, y0 - 0.25::DOUBLE * (y1 - y0))) AS y0, greatest(0.0::DOUBLE, least(1.0::DOUBLE, x1 + 0.25::DOUBLE * (x1 - x0))) AS x1, greatest(0.0::DOUBLE, least(1.0::DOUBLE, y1 + 0.25::DOUBLE * (y1 - y0))) AS y1 FROM b""")
def bounding_box(spark, sf_dir):
    return m.bounding_box(hands(spark, sf_dir), "label", "hand")


_STOP = sql_list(p.VARIANT_STOP)


@query(f"""WITH t AS (SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'My ' || p_name WHEN 1 THEN 'the' ELSE p_name END e, p_type c FROM part),
k AS (SELECT *, list_filter(regexp_extract_all(lower(e), '[a-z'']+'), lambda x: x NOT IN ({_STOP})) te, list_filter(regexp_extract_all(lower(c || ' steel ring'), '[a-z'']+'), lambda x: x NOT IN ({_STOP})) tc FROM t)
SELECT p_partkey, CASE WHEN regexp_matches(e, '(?i)^(my|your|his|her|our|their)\\s+\\w+') THEN 'MULTI_CONCEPT' WHEN len(te) = 0 OR len(tc) = 0 THEN 'SUPPLEMENTARY_ONLY' WHEN list_has_any(te, tc) THEN 'PLAUSIBLE_VARIANT' ELSE 'SUPPLEMENTARY_ONLY' END AS variant FROM k""")
def classify_variant(spark, sf_dir):
    return _variants(spark, sf_dir).select("p_partkey", "variant")


def _variants(spark, sf_dir):
    k, n = F.col("p_partkey") % 3, F.col("p_name")
    e = F.when(k == 0, F.concat(F.lit("My "), n)).when(k == 1, "the").otherwise(n)
    return table(spark, sf_dir, "part").select("p_partkey", "p_brand", p.variant(e, F.concat("p_type", F.lit(" steel ring"))).alias("variant"))


@query(f"""WITH t AS (SELECT p_brand, CASE p_partkey % 3 WHEN 0 THEN 'My ' || p_name WHEN 1 THEN 'the' ELSE p_name END e, p_type c FROM part),
k AS (SELECT *, list_filter(regexp_extract_all(lower(e), '[a-z'']+'), lambda x: x NOT IN ({_STOP})) te, list_filter(regexp_extract_all(lower(c || ' steel ring'), '[a-z'']+'), lambda x: x NOT IN ({_STOP})) tc FROM t)
SELECT p_brand, CASE WHEN regexp_matches(e, '(?i)^(my|your|his|her|our|their)\\s+\\w+') THEN 'MULTI_CONCEPT' WHEN len(te) = 0 OR len(tc) = 0 THEN 'SUPPLEMENTARY_ONLY' WHEN list_has_any(te, tc) THEN 'PLAUSIBLE_VARIANT' ELSE 'SUPPLEMENTARY_ONLY' END AS variant, count(*) AS n FROM k GROUP BY ROLLUP (1, 2)""")
def comparison_counts(spark, sf_dir):
    from ..operators.reports import comparison

    return comparison(_variants(spark, sf_dir), "p_brand", "variant")


@query("""SELECT page_id, CASE WHEN lang NOT IN ('auto', 'en', 'ar') THEN 'bad language' WHEN dur NOT BETWEEN 10 AND 180 THEN 'bad duration' WHEN NOT regexp_matches(lower(f), '\\.(md|txt)$') THEN 'bad extension' WHEN sz > 2097152 THEN 'too large' END AS error_code
FROM (SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'fr' ELSE 'en' END lang, page_id % 200 dur, CASE page_id % 3 WHEN 0 THEN 'a.html' ELSE 'b.MD' END f, length(html) * 600 sz FROM pages)""")
def request_check(spark, sf_dir):
    i = F.col("page_id")
    return table(spark, sf_dir, "pages").select("page_id", p.request_error(F.when(i % 4 == 0, "fr").otherwise("en"), i % 200, F.when(i % 3 == 0, "a.html").otherwise("b.MD"), F.length("html") * 600).alias("error_code"))


@query("""WITH w AS (SELECT p_partkey, string_split(p_name, ' ') k, CASE p_partkey % 3 WHEN 0 THEN [upper(string_split(p_name, ' ')[1])] WHEN 1 THEN string_split(p_name, ' ') ELSE ['ring x', 'bolt'] END pl FROM part)
SELECT p_partkey, array_to_string(list_filter(k, lambda t: NOT list_bool_or(list_transform(pl, lambda x: list_contains(string_split(lower(x), ' '), lower(t))))), ',') AS missing, CASE WHEN len(pl) = 1 THEN 'REVIEW_REQUIRED' ELSE 'OK' END AS status FROM w""")
def plan_preservation(spark, sf_dir):
    k = F.split("p_name", " ")
    i = F.col("p_partkey") % 3
    pl = F.when(i == 0, F.array(F.upper(F.get(k, F.lit(0))))).when(i == 1, k).otherwise(F.array(F.lit("ring x"), F.lit("bolt")))
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(p.missing_terms(k, pl), ",").alias("missing"), p.plan_status(F.col("p_name"), pl).alias("status"))
