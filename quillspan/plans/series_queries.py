"""Sequence queries over events per user, orders per customer and turns per conversation."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import series as s
from .base import query, table

KEY = "user_id"
_S = "s AS (SELECT user_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS INT) i, event_id, event_type, CASE WHEN event_type IN ('error', 'signup') THEN NULL ELSE value END x FROM events)"
_ALPHA_D = 1.0 / (1.0 + (1.0 / (s.TWO_PI * 1.0)) / (1.0 / 25.0))


def events(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    i = F.row_number().over(W.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    return e.select("user_id", i.alias("i"), "event_id", "event_type", F.when(~F.col("event_type").isin("error", "signup"), F.col("value")).alias("x"))


@query(f"""WITH RECURSIVE {_S}, r AS (SELECT user_id, i, x y FROM s WHERE i = 0 UNION ALL SELECT s.user_id, s.i, CASE WHEN s.x IS NULL THEN NULL WHEN r.y IS NULL THEN s.x ELSE r.y * 0.75::DOUBLE + s.x * 0.25::DOUBLE END FROM r JOIN s ON s.user_id = r.user_id AND s.i = r.i + 1)
SELECT user_id, i, y FROM r""")
def ema(spark, sf_dir):
    return s.ema(events(spark, sf_dir), key=KEY)


@query(f"""WITH RECURSIVE {_S}, r AS (SELECT user_id, i, x, x y, CASE WHEN x IS NOT NULL THEN 0.0::DOUBLE END d FROM s WHERE i = 0 UNION ALL
SELECT user_id, i, x, CASE WHEN x IS NULL THEN NULL WHEN px IS NULL THEN x ELSE al * x + (1.0::DOUBLE - al) * py END, d FROM (SELECT *, 1.0::DOUBLE / (1.0::DOUBLE + (1.0::DOUBLE / ({s.TWO_PI!r}::DOUBLE * (1.0::DOUBLE + 0.3::DOUBLE * abs(d)))) / 0.04::DOUBLE) al FROM
(SELECT s.user_id, s.i, s.x, r.x px, r.y py, CASE WHEN s.x IS NULL THEN NULL WHEN r.x IS NULL THEN 0.0::DOUBLE ELSE {_ALPHA_D!r}::DOUBLE * ((s.x - r.x) / 0.04::DOUBLE) + (1.0::DOUBLE - {_ALPHA_D!r}::DOUBLE) * r.d END d FROM r JOIN s ON s.user_id = r.user_id AND s.i = r.i + 1)))
SELECT user_id, i, y FROM r""")
def one_euro(spark, sf_dir):
    return s.one_euro(events(spark, sf_dir), key=KEY)


@query(f"""WITH {_S}, g AS (SELECT *, sum(CASE WHEN x IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY i) run FROM s), p AS (SELECT user_id, run, min(i) a, max(i) + 1 b FROM g WHERE x IS NOT NULL GROUP BY ALL),
q AS (SELECT *, coalesce(a - lag(b) OVER w, 8) gb, coalesce(lead(a) OVER w - b, 8) ga FROM p WINDOW w AS (PARTITION BY user_id ORDER BY a))
SELECT g.user_id, i, CASE WHEN b - a < 4 AND gb >= 8 AND ga >= 8 THEN NULL ELSE x END AS y FROM g LEFT JOIN q USING (user_id, run)""")
def denoise_runs(spark, sf_dir):
    return s.denoise(events(spark, sf_dir), key=KEY)


_B = f"{_S}, b AS (SELECT *, last_value(CASE WHEN x IS NOT NULL THEN i END IGNORE NULLS) OVER p li, last_value(x IGNORE NULLS) OVER p lx, first_value(CASE WHEN x IS NOT NULL THEN i END IGNORE NULLS) OVER n ni, first_value(x IGNORE NULLS) OVER n nx FROM s WINDOW p AS (PARTITION BY user_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), n AS (PARTITION BY user_id ORDER BY i ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)), t AS (SELECT *, (i - li) / (ni - li)::DOUBLE t FROM b)"


@query(f"""WITH {_B} SELECT user_id, i, CASE WHEN x IS NOT NULL THEN x WHEN li IS NULL AND ni - i <= 8 THEN nx WHEN i - li <= 8 AND ni IS NOT NULL THEN lx + ((lx * (1 - t) + nx * t) - lx) WHEN i - li <= 8 THEN lx END AS y,
CASE WHEN x IS NOT NULL THEN 1.0::DOUBLE WHEN li IS NULL AND ni - i <= 8 THEN 1.0::DOUBLE - (ni - i) / 8.0::DOUBLE WHEN i - li <= 8 AND ni IS NOT NULL THEN 1.0::DOUBLE WHEN i - li <= 8 THEN 1.0::DOUBLE - (i - li) / 8.0::DOUBLE ELSE 0.0::DOUBLE END AS alpha FROM t""")
def gap_bridge(spark, sf_dir):
    return s.gap_bridge(events(spark, sf_dir), key=KEY)


@query(f"WITH {_B} SELECT user_id, i, coalesce(x, lx + (nx - lx) * t, nx, lx) AS y FROM t")
def gap_fill(spark, sf_dir):
    return s.gap_fill(events(spark, sf_dir), key=KEY)


@query(f"WITH {_B} SELECT user_id, i, ni AS next_i, nx AS next_x FROM t")
def next_nonnull(spark, sf_dir):
    return s.next_nonnull(events(spark, sf_dir), key=KEY)


@query(f"WITH {_S}, n AS (SELECT user_id, i, x, lead(x) OVER w nx, lead(i) OVER w ni FROM s WINDOW w AS (PARTITION BY user_id ORDER BY i)) SELECT user_id, i, 0 AS k, x AS y FROM n UNION ALL SELECT user_id, i, 1, CASE WHEN x IS NULL OR nx IS NULL THEN x ELSE x * 0.5::DOUBLE + nx * 0.5::DOUBLE END FROM n WHERE ni IS NOT NULL")
def upsample(spark, sf_dir):
    return s.upsample(events(spark, sf_dir), key=KEY)


@query(f"WITH {_S} SELECT user_id, i, CASE WHEN x IS NOT NULL THEN max(CASE WHEN x > 80 THEN 1 WHEN x IS NOT NULL THEN 0 END) OVER (PARTITION BY user_id ORDER BY i ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) = 1 END AS flag FROM s")
def dilate(spark, sf_dir):
    return s.dilate(events(spark, sf_dir), F.col("x") > 80, key=KEY)


@query(f"WITH {_S}, h AS (SELECT *, last_value(CASE WHEN x <= 80 THEN x END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) g FROM s) SELECT user_id, i, CASE WHEN x IS NULL THEN NULL WHEN x > 80 THEN g ELSE x END AS y FROM h")
def hold_last(spark, sf_dir):
    return s.hold_last(events(spark, sf_dir), F.col("x") > 80, key=KEY)


@query(f"""WITH {_S}, d AS (SELECT user_id, i, x - lag(x) OVER w dx, (event_id % 100 - lag(event_id % 100) OVER w)::DOUBLE dy FROM s WHERE x IS NOT NULL WINDOW w AS (PARTITION BY user_id ORDER BY i)), n AS (SELECT *, sqrt(dx * dx + dy * dy) l FROM d WHERE dx IS NOT NULL)
SELECT user_id, i, floor(l / 0.04::DOUBLE * 1e6 + 0.5::DOUBLE) / 1e6 AS speed, CASE WHEN l > 1e-6 THEN floor(degrees(atan2(dy, dx)) * 1e6 + 0.5::DOUBLE) / 1e6 END AS direction, l / 0.04::DOUBLE < 15 AS is_hold FROM n""")
def trajectory(spark, sf_dir):
    from ..functions.text import rounded

    d = s.trajectory(events(spark, sf_dir).withColumn("y", (F.col("event_id") % 100).cast("double")), key=KEY)
    return d.select(KEY, "i", rounded(F.col("speed")).alias("speed"), rounded(F.col("direction")).alias("direction"), "is_hold")


@query(f"WITH {_S}, w AS (SELECT user_id, min(CASE WHEN x > 50 THEN i END) a, max(CASE WHEN x > 50 THEN i END) b, max(i) n FROM s GROUP BY 1) SELECT user_id, greatest(0, a - 6) / 25.0::DOUBLE AS start_s, least(n, b + 6) / 25.0::DOUBLE AS end_s FROM w WHERE a IS NOT NULL")
def active_window(spark, sf_dir):
    return s.active_window(events(spark, sf_dir), F.col("x") > 50, key=KEY)


@query(f"""WITH RECURSIVE {_S}, j AS (SELECT user_id, i, i * 0.1::DOUBLE t, abs(x - lag(x) OVER (PARTITION BY user_id ORDER BY i)) jump FROM s), n AS (SELECT user_id, max(i) + 1 n FROM s GROUP BY 1),
c AS (SELECT user_id, t, row_number() OVER (PARTITION BY user_id ORDER BY i) k FROM j WHERE i > 0 AND jump > 12),
r AS (SELECT user_id, 0::BIGINT k, 0.0::DOUBLE last, true hit FROM n UNION ALL SELECT c.user_id, c.k, CASE WHEN c.t - r.last >= 0.6::DOUBLE THEN c.t ELSE r.last END, c.t - r.last >= 0.6::DOUBLE FROM r JOIN c ON c.user_id = r.user_id AND c.k = r.k + 1),
b AS (SELECT user_id, last t FROM r WHERE hit UNION ALL SELECT user_id, n * 0.1::DOUBLE FROM n), e AS (SELECT user_id, t s, lead(t) OVER (PARTITION BY user_id ORDER BY t) e FROM b)
SELECT user_id, s, e FROM e WHERE e - s >= 0.35::DOUBLE""")
def state_change(spark, sf_dir):
    return s.state_changes(events(spark, sf_dir), key=KEY)


@query("WITH m AS (SELECT user_id, median(value) m FROM events GROUP BY 1), g AS (SELECT median(m) g FROM m) SELECT user_id, m AS median_value, floor(g / m * 1e6 + 0.5::DOUBLE) / 1e6 AS scale FROM m, g")
def median_scale(spark, sf_dir):
    from ..functions.text import rounded
    from ..operators.motion import scales

    d = scales(table(spark, sf_dir, "events").select(KEY, "value"), KEY, "value")
    return d.select(KEY, "median_value", rounded(F.col("scale")).alias("scale"))


@query("WITH m AS (SELECT user_id, median(value) m FROM events GROUP BY 1), g AS (SELECT median(m) g FROM m) SELECT event_id, floor(((value - m) * (g / m) + g) * 1e6 + 0.5::DOUBLE) / 1e6 AS y FROM events JOIN m USING (user_id), g")
def anchor_normalize(spark, sf_dir):
    from ..functions.text import rounded
    from ..operators.motion import normalize

    e = table(spark, sf_dir, "events").select("event_id", KEY, "value")
    return normalize(e, KEY, "value").select("event_id", rounded(F.col("y")).alias("y"))


_U = "l AS (SELECT l_orderkey k, count(*) n FROM lineitem GROUP BY 1), u AS (SELECT o_custkey, o_orderkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1 AS INT) i, CASE WHEN n IS NULL THEN 0 ELSE n * 2.27 - greatest(0, n - 1) * 0.16 END::DECIMAL(18, 2) dur FROM orders LEFT JOIN l ON k = o_orderkey)"


def units(spark, sf_dir):
    n = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count(F.lit(1)).alias("n"))
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", (F.row_number().over(W.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")) - 1).alias("i"))
    return o.join(n, "o_orderkey", "left").select("o_custkey", "o_orderkey", "i", s.unit_seconds(F.coalesce("n", F.lit(0))).alias("dur"))


@query(f"""WITH RECURSIVE {_U}, r AS (SELECT o_custkey, i, dur, dur run, true inc FROM u WHERE i = 0 UNION ALL SELECT u.o_custkey, u.i, u.dur, CASE WHEN r.run + u.dur <= 60 THEN r.run + u.dur ELSE r.run END::DECIMAL(18, 2), r.run + u.dur <= 60 FROM r JOIN u ON u.o_custkey = r.o_custkey AND u.i = r.i + 1)
SELECT o_custkey, i, dur::DOUBLE AS dur, inc AS included FROM r""")
def duration_plan(spark, sf_dir):
    d = s.duration_plan(units(spark, sf_dir), "60.00", key="o_custkey")
    return d.select("o_custkey", "i", F.col("dur").cast("double").alias("dur"), "included")


@query(f"WITH {_U} SELECT o_custkey, i, (coalesce(sum(dur) OVER (PARTITION BY o_custkey ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) - 0.16 * i)::DOUBLE AS offset_s FROM u")
def xfade_offsets(spark, sf_dir):
    return s.crossfade_offsets(units(spark, sf_dir), key="o_custkey")


@query("SELECT l_orderkey, l_linenumber, row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey) - 1 AS number FROM lineitem")
def segment_numbering(spark, sf_dir):
    d = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    return s.global_number(d, "l_orderkey", "l_linenumber", "l_partkey").select("l_orderkey", "l_linenumber", "number")


@query(f"WITH {_U} SELECT o_custkey, i, greatest(0, dur - lag(dur, 1, 0) OVER (PARTITION BY o_custkey ORDER BY i))::DOUBLE AS delta FROM u WHERE dur > 0")
def stage_deltas(spark, sf_dir):
    d = units(spark, sf_dir).where("dur > 0")
    return d.select("o_custkey", "i", F.greatest(F.lit(0), F.col("dur") - F.coalesce(F.lag("dur").over(W.partitionBy("o_custkey").orderBy("i")), F.lit(0))).cast("double").alias("delta"))


@query(f"WITH {_U} SELECT o_custkey, i, coalesce(sum(dur) OVER (PARTITION BY o_custkey ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE AS start_s FROM u")
def start_offsets(spark, sf_dir):
    w = W.partitionBy("o_custkey").orderBy("i").rowsBetween(W.unboundedPreceding, -1)
    return units(spark, sf_dir).select("o_custkey", "i", F.coalesce(F.sum("dur").over(w), F.lit(0)).cast("double").alias("start_s"))


@query("""WITH t AS (SELECT o_custkey, CAST(row_number() OVER w - 1 AS INT) i, o_orderstatus v, lag(o_orderstatus) OVER w p FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)), g AS (SELECT *, sum(CASE WHEN v IS DISTINCT FROM p OR i = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY o_custkey ORDER BY i) r FROM t)
SELECT o_custkey, count(*) AS n, min(i) AS first_i, min(v) AS v FROM g GROUP BY o_custkey, r""")
def run_length(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_custkey", (F.row_number().over(W.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")) - 1).alias("i"), F.col("o_orderstatus").alias("v"))
    return s.run_length(o, "v", key="o_custkey")


_L = "l AS (SELECT * FROM (VALUES (0, 'view'), (1, 'click'), (2, 'purchase'), (3, 'error')) l(pos, label))"


@query(f"""WITH RECURSIVE {_S}, {_L}, r AS (SELECT user_id, -1 i, 0 cur, NULL::INT pos FROM s WHERE i = 0 UNION ALL SELECT user_id, i, coalesce(p, cur), p FROM (SELECT s.user_id, s.i, r.cur, (SELECT min(l.pos) FROM l WHERE l.pos >= r.cur AND contains(s.event_type, l.label)) p FROM r JOIN s ON s.user_id = r.user_id AND s.i = r.i + 1))
SELECT user_id, i, pos FROM r WHERE i >= 0""")
def align_labels(spark, sf_dir):
    e = events(spark, sf_dir).select(KEY, "i", F.col("event_type").alias("text"))
    l = spark.createDataFrame([(0, "view"), (1, "click"), (2, "purchase"), (3, "error")], "pos int, label string")
    return s.align_labels(e, e.select(KEY).distinct().crossJoin(F.broadcast(l)), key=KEY)


# a clip is twelve events of a user in a row
_G = f"""{_S}, w AS (SELECT user_id * 1000 + i // 12 AS clip, event_type, min(i) a, max(i) b FROM s GROUP BY ALL), it AS (SELECT clip, CAST(row_number() OVER (PARTITION BY clip ORDER BY event_type) - 1 AS INT) pos, CASE WHEN b > a OR clip % 3 = 0 THEN a::DOUBLE END start_s, CASE WHEN b > a THEN b::DOUBLE WHEN clip % 3 = 0 THEN a + 0.5::DOUBLE END end_s FROM w)"""


_GATE = f"""WITH {_G}, m AS (SELECT *, lead(start_s) OVER (PARTITION BY clip ORDER BY pos) nx FROM it WHERE start_s IS NOT NULL), p AS (SELECT clip, count(*) n_matched, bool_and(nx IS NULL OR start_s <= nx) mono, bool_and(coalesce(end_s >= start_s, false) AND (nx IS NULL OR coalesce(end_s <= nx + 0.01::DOUBLE, false))) sane, count(DISTINCT start_s) st FROM m GROUP BY 1), n AS (SELECT clip, count(*) n_expected FROM it GROUP BY 1)
SELECT clip, n_expected, coalesce(n_matched, 0) AS n_matched, CASE WHEN coalesce(n_matched, 0) = 0 THEN 'REJECT' WHEN mono AND sane AND st = n_matched AND n_matched = n_expected THEN 'AUTO_ACCEPT' WHEN NOT (mono AND sane AND st = n_matched) THEN 'REJECT' ELSE 'REVIEW_REQUIRED' END AS verdict FROM n LEFT JOIN p USING (clip)"""


@query(_GATE)
def interval_gate(spark, sf_dir):
    return s.interval_gate(_clips(spark, sf_dir), key="clip")


def _clips(spark, sf_dir):
    clip = (F.col(KEY) * 1000 + F.floor(F.col("i") / 12)).alias("clip")
    e = events(spark, sf_dir).groupBy(clip, "event_type").agg(F.min("i").alias("a"), F.max("i").alias("b"))
    some, third = F.col("b") > F.col("a"), F.col("clip") % 3 == 0
    return e.select("clip", (F.row_number().over(W.partitionBy("clip").orderBy("event_type")) - 1).alias("pos"), F.when(some | third, F.col("a").cast("double")).alias("start_s"), F.when(some, F.col("b").cast("double")).when(third, F.col("a") + 0.5).alias("end_s"))


@query(f"SELECT verdict, count(*) AS n, string_agg(clip || ':' || n_matched || '/' || n_expected, ',' ORDER BY clip) AS members FROM ({_GATE}) GROUP BY 1")
def gate_summary(spark, sf_dir):
    d = s.gate_summary(s.interval_gate(_clips(spark, sf_dir), key="clip"), key="clip")
    line = F.transform("members", lambda m: F.concat(m["clip"].cast("string"), F.lit(":"), m["n_matched"].cast("string"), F.lit("/"), m["n_expected"].cast("string")))
    return d.select("verdict", "n", F.array_join(line, ",").alias("members"))


@query(f"""WITH RECURSIVE {_S}, {_L}, r AS (SELECT user_id, -1 i, 0 cur, NULL::INT pos FROM s WHERE i = 0 UNION ALL SELECT user_id, i, coalesce(p, cur), p FROM (SELECT s.user_id, s.i, r.cur, (SELECT min(l.pos) FROM l WHERE l.pos >= r.cur AND contains(s.event_type, l.label)) p FROM r JOIN s ON s.user_id = r.user_id AND s.i = r.i + 1))
SELECT user_id, pos, min(round_even(i * 0.4::DOUBLE, 1)) AS start_s, max(round_even(i * 0.4::DOUBLE, 1)) AS end_s FROM r WHERE pos IS NOT NULL GROUP BY ALL""")
def label_intervals(spark, sf_dir):
    return s.label_intervals(align_labels(spark, sf_dir), 0.4, key=KEY)


@query(f"""WITH RECURSIVE {_U}, r AS (SELECT o_custkey, i, dur, dur run, true inc FROM u WHERE i = 0 UNION ALL SELECT u.o_custkey, u.i, u.dur, CASE WHEN r.run + u.dur <= 60 THEN r.run + u.dur ELSE r.run END::DECIMAL(18, 2), r.run + u.dur <= 60 FROM r JOIN u ON u.o_custkey = r.o_custkey AND u.i = r.i + 1)
SELECT o_custkey, i, inc AS included, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY inc DESC, i) - 1 AS INT) AS place FROM r""")
def selected_then_dropped(spark, sf_dir):
    d = s.selected_then_dropped(s.duration_plan(units(spark, sf_dir), "60.00", key="o_custkey"), key="o_custkey")
    return d.select("o_custkey", "i", "included", "place")
