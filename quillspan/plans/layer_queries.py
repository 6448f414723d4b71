"""Single layers of the resolver, decisions, scripts, replies, rendering and small geometry, each with its own SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import parsing, text
from ..functions.text import rounded
from ..operators import landmarks, motion, planning, series
from ..operators import resolve as r
from ..operators.durable import spread, spread_parts
from .base import query, rows, sql_list, sql_values, table
from .episode_queries import _STOPS
from .motion_queries import _V, _angle, hands
from .resolve_queries import _TOK, _loss
from .series_queries import _S, KEY, events
from .text_queries import ARABIC, LETTERS, NORM_SQL

#: ord, id, word_en, word_ar, category, has_video
SIGNS = [(0, "c0", "Sun", "شمس", "T", True), (1, "c1", "Moon", "قمر", "T", True), (2, "c2", "big house", "بيت كبير", "T", True), (3, "c3", "Mother", "أمي", "T", False), (4, "c4", "sun", "الشمس", "T", True), (5, "c5", "book", "كتاب", "T", False), (6, "c6", "left", "يسار", "T", True)]
ALIASES = [(0, "c2", "home"), (1, "c1", "HOME"), (2, "c5", "دفتر"), (3, "zz", "lost"), (4, "c6", "Port side"), (5, "c0", "")]
WORDS = ["sun ", "SUN", "قمر", "الشمس", "والقمر", "وقمر", "بالبيت", "home", "Home", "دَفتر", "lost", "port side", "nothing", "", "كبيت كبير", "لكتاب", "xq", "بب", "تثت", "moonx"]
_CAT = f"cat AS (SELECT * FROM ({sql_values([(*s[:5], 1 if s[5] else 0) for s in SIGNS])}) c(ord, id, word_en, word_ar, category, has_video))"
_NORM = lambda c: NORM_SQL.replace("regexp_replace(t,", f"regexp_replace({c},")
# every word for every nation, so that the items grow with a table
_ITEMS = f"it AS (SELECT n_nationkey, w, w || CASE WHEN n_nationkey % 5 = 4 THEN 's' ELSE '' END AS item FROM nation, ({sql_values([(w,) for w in WORDS])}) v(w))"


def _signs(spark):
    return rows(spark, "ord int, id string, word_en string, word_ar string, category string, has_video boolean", SIGNS)


def _words(spark, sf_dir):
    w = table(spark, sf_dir, "nation").select("n_nationkey").crossJoin(F.broadcast(rows(spark, "w string", [(w,) for w in WORDS])))
    return w.select("n_nationkey", "w", F.concat("w", F.when(F.col("n_nationkey") % 5 == 4, "s").otherwise("")).alias("item"))


@query(f"""WITH {_CAT}, {_ITEMS}, a AS (SELECT al.ord, c.id, al.alias FROM ({sql_values(ALIASES)}) al(ord, catalog_id, alias) JOIN cat c ON c.id = al.catalog_id), k AS (SELECT arg_min(id, ord) id, key FROM (SELECT ord, id, lower(trim(alias)) AS key FROM a UNION SELECT ord, id, {_NORM("alias")} FROM a) WHERE key <> '' GROUP BY key),
h AS (SELECT DISTINCT item, lower(trim(item)) e, {_NORM("item")} n FROM it) SELECT item, coalesce(x.id, y.id) AS id FROM h LEFT JOIN k x ON x.key = e LEFT JOIN k y ON y.key = n WHERE coalesce(x.id, y.id) IS NOT NULL""")
def alias_match(spark, sf_dir):
    d = r.alias(_words(spark, sf_dir).select("item").distinct(), _signs(spark), rows(spark, "ord int, catalog_id string, alias string", ALIASES))
    return d.select("item", F.col("alias.id").alias("id"))


@query(f"""WITH {_CAT}, {_ITEMS}, k AS (SELECT {_NORM("word_ar")} AS key, arg_min(id, ord) id FROM cat GROUP BY 1), h AS (SELECT DISTINCT item, {_NORM("item")} n FROM it), p AS (SELECT * FROM ({sql_values(list(enumerate(text.CLITICS)))}) p(o, c)),
f AS (SELECT item, o, substr(n, length(c) + 1) form FROM h, p WHERE starts_with(n, c) AND length(n) - length(c) >= 2) SELECT item, arg_min(form, o) AS form, arg_min(id, o) AS id FROM f JOIN k ON key = form GROUP BY item""")
def clitic_match(spark, sf_dir):
    d = r.clitic(_words(spark, sf_dir).select("item").distinct(), _signs(spark))
    return d.select("item", F.col("clitic.form").alias("form"), F.col("clitic.row.id").alias("id"))


_NOUNS = [(i, f"k{i}", w, None, "T", i % 4 != 3) for i, w in enumerate(["red ring", "very big bolt", "steel gear", "ring gear", "bolt", "blue ring steel"])]
_PICK = "'k' || CAST((p_partkey * 7 + p_size) % 8 AS VARCHAR)"
_PHRASE = "CASE p_partkey % 6 WHEN 0 THEN 'my ring ' || p_size WHEN 1 THEN 'very big thing ' || p_size WHEN 2 THEN 'gear steel thing' WHEN 3 THEN 'not bolt ' || p_size WHEN 4 THEN 'two blue ' || p_size ELSE 'lamp ' || p_size END"


@query(f"""WITH cat AS (SELECT ord, id, word_en, has_video FROM ({sql_values([(*s[:3], 1 if s[5] else 0) for s in _NOUNS])}) c(ord, id, word_en, has_video)), s AS (SELECT {_PHRASE} AS item, min({_PICK}) AS sel FROM part GROUP BY 1), it AS (SELECT item, unnest(list_distinct({_TOK})) t FROM s),
ct AS (SELECT ord, id, unnest(list_distinct(list_filter(regexp_extract_all(lower(word_en), '[a-z'']+'), lambda x: x NOT IN ({_STOPS})))) t FROM cat), sc AS (SELECT item, ord, id, count(*) score FROM it JOIN ct USING (t) GROUP BY ALL), cd AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY item ORDER BY score DESC, ord) rank FROM sc) WHERE rank <= 5), n AS (SELECT item, count(*) n FROM cd GROUP BY 1),
z AS (SELECT s.item, cd.id, c.word_en, has_video, coalesce(n, 0) n, {_loss("c.word_en").replace("lower(item)", "lower(s.item)")} loss FROM s LEFT JOIN cd ON cd.item = s.item AND cd.id = sel LEFT JOIN cat c ON c.id = cd.id LEFT JOIN n ON n.item = s.item),
g AS (SELECT *, coalesce(id IS NOT NULL AND has_video = 1 AND loss NOT IN ('ESSENTIAL_INFORMATION_LOSS', 'AMBIGUOUS'), false) ok FROM z)
SELECT item, CASE WHEN ok THEN 'VERIFIED' ELSE 'REVIEW_REQUIRED' END AS status, CASE WHEN ok THEN 'CANDIDATE_SELECTED' END AS match_method, CASE WHEN ok THEN id END AS catalog_id, CASE WHEN ok THEN loss END AS information_loss, n AS n_candidates FROM g""")
def selection_check(spark, sf_dir):
    p = table(spark, sf_dir, "part").select(F.expr(_PHRASE).alias("item"), F.expr(_PICK.replace("VARCHAR", "STRING")).alias("sel"))
    s = p.groupBy("item").agg(F.min("sel").alias("selected_id"))
    d = r.resolve(s.select("item"), rows(spark, "ord int, id string, word_en string, word_ar string, category string, has_video boolean", _NOUNS), selector=s)
    return d.select("item", "status", "match_method", "catalog_id", "information_loss", "n_candidates")


_GIVEN = [("nothing", "شمس"), ("xq", "أمي"), ("moonx", "بب"), ("lost", "ثث"), ("home", "قمر")]


@query(f"""WITH {_CAT}, {_ITEMS}, s AS (SELECT DISTINCT w AS item, n_nationkey % 2 = 1 AS ar FROM it), en AS (SELECT lower(trim(word_en)) AS key, arg_min(id, ord) id FROM cat GROUP BY 1), an AS (SELECT {_NORM("word_ar")} AS key, arg_min(id, ord) id, arg_min(has_video, ord) v FROM cat GROUP BY 1),
x AS (SELECT item, ar, regexp_matches(item, '{ARABIC}') script, en.id eid, an.id aid FROM s LEFT JOIN en ON en.key = lower(trim(item)) LEFT JOIN an ON an.key = {_NORM("item")} AND an.key <> ''),
kc AS (SELECT item, arg_min(id, o) id FROM (SELECT item, o, substr(n, length(c) + 1) form FROM (SELECT DISTINCT item, {_NORM("item")} n FROM s), ({sql_values(list(enumerate(text.CLITICS)))}) p(o, c) WHERE starts_with(n, c) AND length(n) - length(c) >= 2) JOIN an ON an.key = form GROUP BY item),
y AS (SELECT x.*, kc.id cid, CASE WHEN eid IS NOT NULL THEN 'EXACT_EN' WHEN aid IS NOT NULL THEN 'EXACT_AR' WHEN kc.id IS NOT NULL THEN 'CLITIC_AR' END m, ar AND trim(item) <> '' AND NOT script AS drift, CASE WHEN script OR ar THEN x.item ELSE g.t END term FROM x LEFT JOIN kc USING (item) LEFT JOIN ({sql_values(_GIVEN)}) g(item, t) ON g.item = x.item),
w AS (SELECT y.*, t.id tid FROM y LEFT JOIN an t ON t.v = 1 AND t.key = {_NORM("term")} AND m IS NULL AND NOT drift), l AS (SELECT DISTINCT term, translate(regexp_replace(term, '[\\x{{064B}}-\\x{{0652}}\\x{{0670}} ]', '', 'g'), 'أإآ', 'ااا') b FROM w WHERE term IS NOT NULL),
f AS (SELECT term, bool_and(ch IN ({sql_list([a for a, _ in LETTERS])})) ok FROM (SELECT term, b, unnest(CASE WHEN b = '' THEN ['#'] ELSE string_split(b, '') END) ch FROM l) GROUP BY ALL)
SELECT item, ar AS source_arabic, CASE WHEN m IS NOT NULL OR tid IS NOT NULL THEN 'VERIFIED' WHEN drift OR w.term IS NULL THEN 'REVIEW_REQUIRED' WHEN f.ok THEN 'FINGERSPELL_CANDIDATE' ELSE 'UNSUPPORTED' END AS status, coalesce(m, CASE WHEN tid IS NOT NULL THEN 'EXACT_AR_VIA_TERMINOLOGY' END) AS match_method, coalesce(eid, aid, cid, tid) AS catalog_id FROM w LEFT JOIN f ON f.term = w.term""")
def terminology_layers(spark, sf_dir):
    items = _words(spark, sf_dir).select(F.col("w").alias("item"), (F.col("n_nationkey") % 2 == 1).alias("source_arabic")).distinct()
    parts = [r.resolve(items.where(F.col("source_arabic") == a), _signs(spark), terminology=rows(spark, "item string, arabic_term string", _GIVEN), alphabet=rows(spark, "letter string, letter_name string", LETTERS)).withColumn("source_arabic", F.lit(a)) for a in (True, False)]
    return parts[0].unionByName(parts[1]).select("item", "source_arabic", "status", "match_method", "catalog_id")


@query(f"""WITH {_ITEMS} SELECT DISTINCT item, regexp_matches(item, '{ARABIC}') AS narrow, regexp_matches(item, '[\\x{{0600}}-\\x{{06FF}}\\x{{0750}}-\\x{{077F}}]') AS wide, regexp_replace(lower(item), '[^a-z\\x{{0600}}-\\x{{06FF}}]', '', 'g') AS key,
CASE WHEN item <> '' AND NOT regexp_matches(item, '{ARABIC}') THEN item ELSE 'FALLBACK' END AS caption_en, CASE WHEN regexp_matches(item, '{ARABIC}') THEN item ELSE '[AR UNAVAILABLE]' END AS caption_ar, CASE WHEN regexp_matches(item, '{ARABIC}') THEN 'NOT_NEEDED' ELSE 'ASK' END AS terminology FROM it""")
def scripts(spark, sf_dir):
    i = F.col("item")
    return _words(spark, sf_dir).select("item").distinct().select(
        "item", text.is_arabic(i).alias("narrow"), text.is_arabic(i, text.AR_WIDE).alias("wide"), text.alignment_key(i).alias("key"), text.caption_en(i, F.lit("fallback")).alias("caption_en"), text.caption_ar(i).alias("caption_ar"), text.terminology_need(i, F.lit(False)).alias("terminology"),
    )


_REPLY = """CASE event_id % 6 WHEN 0 THEN 'I say {"id": "' || event_type || '", "confidence": "high"} ok' WHEN 1 THEN '{"id": "None"}' WHEN 2 THEN '<think>{x}</think>{"id": "a", "confidence": "low"}' WHEN 3 THEN 'no object' WHEN 4 THEN '{"id": null}' ELSE '{"id": ""}' END"""


@query(f"""WITH r AS (SELECT event_id, regexp_extract(regexp_replace({_REPLY}, '(?s)<think>.*?</think>', '', 'g'), '(?s)\\{{.*\\}}') j FROM events)
SELECT event_id, CASE WHEN json_valid(j) AND lower(j ->> '$.id') NOT IN ('none', '') THEN j ->> '$.id' END AS id, coalesce(CASE WHEN json_valid(j) THEN j ->> '$.confidence' END, 'low') AS confidence FROM r""")
def selector_reply(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", parsing.selector_choice(F.expr(_REPLY)).alias("c"))
    return e.select("event_id", F.col("c.id").alias("id"), F.col("c.confidence").alias("confidence"))


_BROKEN = """CASE event_id % 4 WHEN 0 THEN '[{"a": "x"}]' WHEN 1 THEN '[{"a": "' || event_type || '"},\\n {"a": 1}]' WHEN 2 THEN '[{"a": (' || event_type || ' two)}]' ELSE 'none [' END"""
_ESCAPED = r"""CASE event_id % 3 WHEN 0 THEN 'a\"bA' WHEN 1 THEN 'line\n' || event_type ELSE 'bad\q' END"""


@query(f"""WITH r AS (SELECT event_id, {_BROKEN} t FROM events), x AS (SELECT event_id, t, replace(t, chr(92) || 'n', ' ') a FROM r), y AS (SELECT *, regexp_replace(a, ': \\(([^)]*)\\)', ': "\\1"', 'g') b FROM x)
SELECT event_id, CASE WHEN json_valid(t) AND starts_with(t, '[') THEN t WHEN json_valid(a) AND starts_with(a, '[') THEN a WHEN json_valid(b) AND starts_with(b, '[') THEN b END AS repaired,
CASE event_id % 3 WHEN 0 THEN 'a"bA' WHEN 1 THEN 'line' || chr(10) || event_type ELSE 'bad' || chr(92) || 'q' END AS unescaped FROM y JOIN events USING (event_id)""")
def repairs(spark, sf_dir):
    k, e = F.col("event_id"), F.col("event_type")
    broken = F.when(k % 4 == 0, '[{"a": "x"}]').when(k % 4 == 1, F.concat(F.lit('[{"a": "'), e, F.lit('"},\\n {"a": 1}]'))).when(k % 4 == 2, F.concat(F.lit('[{"a": ('), e, F.lit(" two)}]"))).otherwise("none [")
    escaped = F.when(k % 3 == 0, r"a\"bA").when(k % 3 == 1, F.concat(F.lit(r"line\n"), e)).otherwise(r"bad\q")
    return table(spark, sf_dir, "events").select("event_id", parsing.repaired(broken).alias("repaired"), parsing.unescape(escaped).alias("unescaped"))


_CLIPS = "CASE WHEN l_linestatus = 'F' THEN [l_returnflag || l_linenumber] ELSE [l_returnflag, 'X', l_linestatus] END"
_ST = "CASE WHEN l_quantity < 10 THEN 'UNSUPPORTED' WHEN l_linestatus = 'F' THEN 'VERIFIED' ELSE 'FINGERSPELL_CANDIDATE' END"


@query(f"""WITH u AS (SELECT l_orderkey * 100000 + l_partkey AS unit_id, l_linenumber AS idx, l_shipdate AS d, {_CLIPS} c FROM lineitem WHERE {_ST} <> 'UNSUPPORTED'), e AS (SELECT unit_id, idx, d, unnest(c) clip_key, unnest(range(0, len(c))) pos FROM (SELECT DISTINCT * FROM u)),
a AS (SELECT DISTINCT l_returnflag || l_linenumber AS clip_key FROM lineitem WHERE l_linenumber % 4 <> 0 UNION SELECT unnest(['N', 'X', 'O'])), f AS (SELECT unit_id, idx, bool_and(a.clip_key IS NOT NULL) ok FROM e LEFT JOIN a USING (clip_key) GROUP BY ALL)
SELECT ok AS rendered, count(*) AS n, count(DISTINCT unit_id) AS units FROM (SELECT DISTINCT e.unit_id, e.idx, CASE WHEN ok THEN pos END pos, CASE WHEN ok THEN clip_key END clip_key, ok FROM e JOIN f USING (unit_id, idx)) GROUP BY 1""")
def render_segments(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    f, k = F.col("l_returnflag"), F.col("l_linenumber").cast("string")
    clips = F.when(F.col("l_linestatus") == "F", F.array(F.concat(f, k))).otherwise(F.array(f, F.lit("X"), F.col("l_linestatus")))
    status = F.when(F.col("l_quantity") < 10, "UNSUPPORTED").when(F.col("l_linestatus") == "F", "VERIFIED").otherwise("FINGERSPELL_CANDIDATE")
    u = li.select((F.col("l_orderkey") * 100000 + F.col("l_partkey")).alias("unit_id"), F.col("l_linenumber").alias("idx"), F.lit("t").alias("term"), status.alias("status"), clips.alias("clip_keys"))
    u = spread(u, spread_parts(li), "unit_id").distinct()
    have = li.where("l_linenumber % 4 <> 0").select(F.concat(f, k).alias("clip_key")).distinct().union(rows(spark, "clip_key string", [("N",), ("X",), ("O",)])).distinct()
    good, bad = planning.segments(u, have)
    both = good.distinct().select(F.lit(True).alias("rendered"), "unit_id").unionByName(bad.select(F.lit(False).alias("rendered"), "unit_id"))
    return both.groupBy("rendered").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("unit_id").alias("units"))


@query("""WITH s AS (SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'BLOCKED' WHEN 1 THEN 'REVIEW_REQUIRED' WHEN 2 THEN 'PASS' ELSE 'PASS_WITH_FALLBACK' END s, o_orderstatus = 'O' a FROM orders) SELECT o_orderkey, CASE s WHEN 'BLOCKED' THEN false WHEN 'REVIEW_REQUIRED' THEN a ELSE true END AS renders FROM s""")
def render_gate(spark, sf_dir):
    k = F.col("o_orderkey") % 4
    s = F.when(k == 0, "BLOCKED").when(k == 1, "REVIEW_REQUIRED").when(k == 2, "PASS").otherwise("PASS_WITH_FALLBACK")
    both = F.when(F.col("o_orderstatus") == "O", planning.can_render(s, True)).otherwise(planning.can_render(s, False))
    return table(spark, sf_dir, "orders").select("o_orderkey", both.alias("renders"))


_TURN = "(e[7] * 90.0::DOUBLE)"


@query(f"WITH {_V} SELECT vec_id, {_angle(5, 0, 9)} AS spread_0, {_angle(9, 0, 13)} AS spread_1, {_angle(13, 0, 17)} AS spread_2, greatest(-0.1::DOUBLE, least(0.1::DOUBLE, e[4])) AS clamped, floor((e[1] + 2.0::DOUBLE * (e[4] * cos(radians({_TURN})) - e[5] * sin(radians({_TURN})))) * 1e6 + 0.5::DOUBLE) / 1e6 AS x, floor((e[2] + 2.0::DOUBLE * (e[4] * sin(radians({_TURN})) + e[5] * cos(radians({_TURN})))) * 1e6 + 0.5::DOUBLE) / 1e6 AS y FROM v")
def hand_spread(spark, sf_dir):
    p = lambda k: motion.point(F.col("hand"), k)
    a = motion.affine(p(1), p(0)["x"], p(0)["y"], p(2)["x"] * 90.0, F.lit(2.0))
    s = motion.spread(F.col("hand"))
    return hands(spark, sf_dir).select("vec_id", *[rounded(c).alias(f"spread_{i}") for i, c in enumerate(s)], motion.clamp(p(1)["x"], -0.1, 0.1).alias("clamped"), rounded(a["x"]).alias("x"), rounded(a["y"]).alias("y"))


@query(f"""WITH RECURSIVE {_S}, p AS (SELECT user_id, i, x, abs(value) + 1 w FROM s JOIN events USING (user_id, event_id)), g AS (SELECT user_id, median(w) w, median(x) x FROM p GROUP BY 1), a AS (SELECT median(w) w, median(x) x FROM g), z AS (SELECT p.user_id, i, (p.x - g.x) * (a.w / g.w) + a.x gx FROM p JOIN g USING (user_id), a),
r AS (SELECT user_id, i, gx y FROM z WHERE i = 0 UNION ALL SELECT z.user_id, z.i, CASE WHEN z.gx IS NULL THEN NULL WHEN r.y IS NULL THEN z.gx ELSE r.y * 0.75::DOUBLE + z.gx * 0.25::DOUBLE END FROM r JOIN z ON z.user_id = r.user_id AND z.i = r.i + 1) SELECT user_id, i, floor(y * 1e6 + 0.5::DOUBLE) / 1e6 AS y FROM r""")
def anchored_ema(spark, sf_dir):
    e = events(spark, sf_dir).join(table(spark, sf_dir, "events").select("event_id", (F.abs("value") + 1).alias("w")), "event_id")
    d = landmarks.to_anchor(e.withColumn("px", F.col("x")), KEY, "px", "px", "w")
    return series.ema(d.select(KEY, "i", F.col("gx").alias("x")), key=KEY).select(KEY, "i", rounded(F.col("y")).alias("y"))


@query(f"""WITH {_S}, b AS (SELECT *, lag(x) OVER w p, max(CASE WHEN x IS NOT NULL THEN i END) OVER (PARTITION BY user_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) li FROM s WINDOW w AS (PARTITION BY user_id ORDER BY i))
SELECT b.user_id, count(*) FILTER (WHERE b.x IS NOT NULL AND b.p IS NULL AND li IS NOT NULL) AS returns, count(*) FILTER (WHERE b.x IS NOT NULL AND b.p IS NULL AND abs(b.x - l.x) > 20) AS far_returns FROM b LEFT JOIN s l ON l.user_id = b.user_id AND l.i = li GROUP BY 1""")
def reappearance(spark, sf_dir):
    from ..operators.evidence import reappearances

    return reappearances(events(spark, sf_dir), KEY, 20.0)
