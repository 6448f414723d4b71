"""Rigid bridging, nested smoothing and measures on events per user and on hands made of embedding slices."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import rounded
from ..operators import landmarks as l
from ..operators import motion as m
from .base import query, table
from .motion_queries import _V, hands
from .series_queries import _S, KEY, events

_R = lambda e: f"floor(({e}) * 1e6 + 0.5::DOUBLE) / 1e6"


def _hand(spark, sf_dir):
    x = F.col("x")
    h = F.when(x.isNotNull(), F.transform(F.sequence(F.lit(0), F.lit(9)), lambda k: F.struct((x + k * F.cos(x / 7)).alias("x"), (x / 2 + k * F.sin(x / 7)).alias("y"))))
    return events(spark, sf_dir).select(KEY, "i", h.alias("hand"))


@query(f"""WITH {_S}, b AS (SELECT user_id, i, x, max(CASE WHEN x IS NOT NULL THEN i END) OVER (PARTITION BY user_id ORDER BY i) li, min(CASE WHEN x IS NOT NULL THEN i END) OVER (PARTITION BY user_id ORDER BY i ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) ni FROM s),
g AS (SELECT b.user_id, b.i, b.x, b.li, b.ni, p.x lx, n.x nx, (b.i - li)::DOUBLE / (ni - li) t FROM b LEFT JOIN s p ON p.user_id = b.user_id AND p.i = li LEFT JOIN s n ON n.user_id = b.user_id AND n.i = ni),
a AS (SELECT *, atan2(lx / 2 + 9 * sin(lx / 7) - lx / 2, lx + 9 * cos(lx / 7) - lx) a0, atan2(nx / 2 + 9 * sin(nx / 7) - nx / 2, nx + 9 * cos(nx / 7) - nx) a1 FROM g),
d AS (SELECT *, ((a1 - a0 + pi()) - 2 * pi() * floor((a1 - a0 + pi()) / (2 * pi())) - pi()) * t rot FROM a),
o AS (SELECT *, CASE WHEN x IS NOT NULL THEN 'real' WHEN li IS NOT NULL AND i - li <= 16 AND ni IS NOT NULL THEN 'moved' WHEN li IS NOT NULL AND i - li <= 16 THEN 'held' ELSE 'none' END k FROM d)
SELECT user_id, i, {_R("CASE k WHEN 'real' THEN x WHEN 'held' THEN lx WHEN 'moved' THEN lx + (nx - lx) * t END")} AS wrist_x, {_R("CASE k WHEN 'real' THEN x / 2 + 9 * sin(x / 7) WHEN 'held' THEN lx / 2 + 9 * sin(lx / 7) WHEN 'moved' THEN lx / 2 + (nx / 2 - lx / 2) * t + (lx + 9 * cos(lx / 7) - lx) * sin(rot) + (lx / 2 + 9 * sin(lx / 7) - lx / 2) * cos(rot) END")} AS base_y,
CASE k WHEN 'held' THEN greatest(0.0::DOUBLE, 1.0::DOUBLE - (i - li) / 16.0::DOUBLE) WHEN 'none' THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS alpha FROM o""")
def rigid_bridge(spark, sf_dir):
    d = l.rigid_bridge(_hand(spark, sf_dir), key=KEY)
    return d.select(KEY, "i", rounded(F.get("hand", F.lit(0))["x"]).alias("wrist_x"), rounded(F.get("hand", F.lit(9))["y"]).alias("base_y"), "alpha")


@query(f"""WITH RECURSIVE {_S}, v AS (SELECT user_id, i, x, x / 3 z, event_type, event_id % 3 n FROM s), r AS (SELECT user_id, i, x, x a, z b, n, event_type FROM v WHERE i = 0
UNION ALL SELECT v.user_id, v.i, v.x, CASE WHEN v.x IS NULL THEN NULL WHEN r.x IS NULL THEN v.x ELSE r.a * 0.6::DOUBLE + v.x * 0.4::DOUBLE END, CASE WHEN v.x IS NULL THEN NULL WHEN r.x IS NULL OR r.n <> v.n THEN v.z ELSE r.b * 0.6::DOUBLE + v.z * 0.4::DOUBLE END, v.n, v.event_type FROM r JOIN v ON v.user_id = r.user_id AND v.i = r.i + 1)
SELECT user_id, i, a, CASE WHEN x IS NOT NULL THEN event_type END AS label, CASE WHEN n > 0 THEN b END AS first_z FROM r""")
def nested_ema(spark, sf_dir):
    e = events(spark, sf_dir)
    v = F.struct(F.col("x").alias("a"), F.col("event_type").alias("label"), F.array_repeat(F.struct((F.col("x") / 3).alias("z")), (F.col("event_id") % 3).cast("int")).alias("zs"))
    d = l.nested_ema(e.select(KEY, "i", F.when(F.col("x").isNotNull(), v).alias("v")), "v", 0.4, key=KEY)
    return d.select(KEY, "i", F.col("y.a").alias("a"), F.col("y.label").alias("label"), F.get(F.col("y.zs"), F.lit(0))["z"].alias("first_z"))


@query(f"""WITH {_S}, p AS (SELECT user_id, i, event_id, value x, value / 2 + user_id % 5 y, abs(value) + 1 w FROM s JOIN events USING (user_id, event_id)), g AS (SELECT user_id, median(w) w, median(x) x, median(y) y FROM p GROUP BY 1), a AS (SELECT median(w) w, median(x) x, median(y) y FROM g)
SELECT p.user_id, i, {_R("(p.x - g.x) * (a.w / g.w) + a.x")} AS gx, {_R("(p.y - g.y) * (a.w / g.w) + a.y")} AS gy, round_even(i * 0.4::DOUBLE, 1) AS t FROM p JOIN g USING (user_id), a""")
def rescale_to_anchor(spark, sf_dir):
    e = events(spark, sf_dir).join(table(spark, sf_dir, "events").select("event_id", "value"), "event_id")
    d = e.select(KEY, "i", F.col("value").alias("px"), (F.col("value") / 2 + F.col(KEY) % 5).alias("py"), (F.abs("value") + 1).alias("w"))
    d = l.to_anchor(d, KEY, "px", "py", "w")
    return d.select(KEY, "i", rounded(F.col("gx")).alias("gx"), rounded(F.col("gy")).alias("gy"), l.time_axis(F.col("i"), 0.4).alias("t"))


_X, _Y = (lambda k: f"e[{3 * k + 1}]"), (lambda k: f"e[{3 * k + 2}]")
_D = lambda a, b: f"sqrt(({_X(a)} - {_X(b)}) * ({_X(a)} - {_X(b)}) + ({_Y(a)} - {_Y(b)}) * ({_Y(a)} - {_Y(b)}))"


@query(f"""WITH {_V} SELECT vec_id, {_R(f"degrees(atan2(({_X(0)} + {_X(1)}) / 2 - ({_X(2)} + {_X(3)}) / 2, -(({_Y(0)} + {_Y(1)}) / 2 - ({_Y(2)} + {_Y(3)}) / 2)))")} AS lean, {_R(f"({_Y(1)} - {_Y(0)}) / CASE WHEN {_D(0, 1)} = 0 THEN 1.0::DOUBLE ELSE {_D(0, 1)} END")} AS asymmetry,
{_R(f"10.0::DOUBLE + ({_X(4)} - {_X(0)}) * (5.0::DOUBLE / {_D(0, 1)})")} AS rig_x, {_R(f"20.0::DOUBLE + ({_Y(4)} - {_Y(0)}) * (5.0::DOUBLE / {_D(0, 1)})")} AS rig_y FROM v""")
def body_features(spark, sf_dir):
    h = hands(spark, sf_dir)
    p = lambda k: m.point(F.col("hand"), k)
    rig = l.to_rig(p(4), p(0), (10.0, 20.0), 5.0, l._far(p(0), p(1)))
    return h.select("vec_id", rounded(l.lean_degrees(p(0), p(1), p(2), p(3))).alias("lean"), rounded(l.shoulder_asymmetry(p(0), p(1))).alias("asymmetry"), rounded(rig["x"]).alias("rig_x"), rounded(rig["y"]).alias("rig_y"))


_AT = {"top": 0, "chin": 1, "left": 2, "right": 3, "mouth_l": 4, "mouth_r": 5, "mouth_top": 6, "mouth_bottom": 7, "eye_top_l": 8, "eye_top_r": 9, "eye_bottom_l": 10, "eye_bottom_r": 11, "eye_in_l": 12, "eye_in_r": 13, "eye_out_l": 14, "eye_out_r": 15, "brow_l": 16, "brow_r": 17, "brow_inner_l": 16, "brow_inner_r": 17, "brow_outer_l": 18, "brow_outer_r": 19, "lip_top": 20, "lip_bottom": 7}


def _points():
    return {n: m.point(F.col("hand"), k) for n, k in _AT.items()}


_H, _W = _D(0, 1), _D(2, 3)


@query(f"""WITH {_V} SELECT vec_id, {_R(f"{_D(6, 7)} / {_H}")} AS mouth_open, {_R(f"{_D(4, 5)} / {_W}")} AS mouth_width, {_R(f"({_D(8, 10)} / {_H} + {_D(9, 11)} / {_H}) / 2")} AS eye_open, {_R(f"({_D(12, 14)} / {_W} + {_D(13, 15)} / {_W}) / 2")} AS eye_width,
{_R(f"({_D(16, 8)} / {_H} + {_D(17, 9)} / {_H}) / 2")} AS brow_raise, {_R(f"(({_Y(6)} + {_Y(7)}) / 2 - ({_Y(4)} + {_Y(5)}) / 2) / {_H}")} AS smile FROM v""")
def face_metrics(spark, sf_dir):
    return hands(spark, sf_dir).select("vec_id", *[rounded(c).alias(n) for n, c in l.face_metrics(_points()).items()])


def _mean(axis, ks) -> str:
    return "((" + " + ".join(["0.0::DOUBLE", *map(axis, ks)]) + f") / {len(ks)})"


@query(f"""WITH {_V}, f AS (SELECT vec_id, e, {_D(16, 8)} / {_H} li, {_D(18, 8)} / {_H} lo, {_D(17, 9)} / {_H} ri, {_D(19, 9)} / {_H} ro, {_D(8, 10)} / {_H} el, {_D(9, 11)} / {_H} er, (({_Y(6)} + {_Y(7)}) / 2 - {_Y(4)}) / {_H} cl, (({_Y(6)} + {_Y(7)}) / 2 - {_Y(5)}) / {_H} cr, {_H} h FROM v)
SELECT vec_id, {_R("li")} AS brow_l_inner_raise, {_R("lo")} AS brow_l_outer_raise, {_R("ri")} AS brow_r_inner_raise, {_R("ro")} AS brow_r_outer_raise, {_R("abs((li + lo) - (ri + ro))")} AS brow_asymmetry, {_R("el")} AS eye_l, {_R("er")} AS eye_r, """ + ", ".join(f"CASE WHEN {c} < 0.02 THEN 'blink' WHEN {c} <= 0.035 THEN 'squint' ELSE 'open' END AS eye_{s}_state" for s, c in (("l", "el"), ("r", "er"))) + f""",
{_R("abs(el - er)")} AS eye_asymmetry, NULL::DOUBLE AS gaze, {_R(f"({_X(8)} - {_mean(_X, [8, 10, 12])}) / h")} AS eye_l_contour, {_R(f"({_Y(9)} - {_mean(_Y, [9, 11, 13])}) / h")} AS eye_r_contour, {_R(f"{_D(6, 7)} / h")} AS mouth_open, {_R(f"{_D(4, 5)} / {_W}")} AS mouth_width, {_R("cl")} AS corner_l, {_R("cr")} AS corner_r,
{_R("abs(cl - cr)")} AS corner_asymmetry, {_R(f"{_D(20, 7)} / h")} AS lip_closure, NULL::DOUBLE AS lip_protrusion, {_R(f"({_X(5)} - {_mean(_X, [4, 5, 6, 7])}) / h")} AS lip_contour FROM f""")
def face_features(spark, sf_dir):
    at = lambda *ks: F.array(*[m.point(F.col("hand"), k) for k in ks])
    f = l.face_features(_points(), at(4, 5, 6, 7), at(8, 10, 12), at(9, 11, 13))
    f |= {"eye_l_contour": F.get(f["eye_l_contour"], F.lit(0))["x"], "eye_r_contour": F.get(f["eye_r_contour"], F.lit(0))["y"], "lip_contour": F.get(f["lip_contour"], F.lit(1))["x"]}
    return hands(spark, sf_dir).select("vec_id", *[(c if n.endswith("_state") else rounded(c)).alias(n) for n, c in f.items()])


def _signed(a: int, b: int, c: int) -> str:
    u, v = ([f"(e[{3 * q + k}] - e[{3 * p + k}])" for k in (1, 2, 3)] for p, q in ((a, b), (b, c)))
    n = lambda w: "sqrt(" + " + ".join(f"{x} * {x}" for x in w) + ")"
    w = [f"(e[{15 + k}] - e[{51 + k}])" for k in (1, 2, 3)]
    cross = [f"({u[1]} * {v[2]} - {u[2]} * {v[1]})", f"({u[2]} * {v[0]} - {u[0]} * {v[2]})", f"({u[0]} * {v[1]} - {u[1]} * {v[0]})"]
    return f"atan2(({' + '.join(f'{x} * {y}' for x, y in zip(cross, w, strict=True))}) / ({n(u)} * {n(v)} * {n(w)}), ({' + '.join(f'{x} * {y}' for x, y in zip(u, v, strict=True))}) / ({n(u)} * {n(v)}))"


@query(f"WITH {_V} SELECT vec_id, " + ", ".join(f"floor(({_signed(*at)}) * 1e4 + 0.5::DOUBLE) / 1e4 AS {n}" for n, at in (("thumb_0", (0, 1, 2)), ("index_1", (5, 6, 7)), ("little_2", (18, 19, 20)))) + " FROM v")
def signed_finger_angles(spark, sf_dir):
    a = l.raw_finger_angles(F.col("hand"))
    return hands(spark, sf_dir).select("vec_id", *[rounded(a[n], 4).alias(n) for n in ("thumb_0", "index_1", "little_2")])
