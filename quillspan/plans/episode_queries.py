"""The episode operators bound to orders as units, line items as their items, and part names as dictionaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text
from ..operators import episode as e
from ..operators import planning
from .base import query, sql_list, table
from .resolve_queries import _TOK, _loss

_SUP = """sup AS (SELECT CAST(n_nationkey AS INT) AS ord, 's' || n_nationkey AS supplementary_id, CASE n_nationkey % 5 WHEN 0 THEN 'ring' WHEN 1 THEN 'red ' || lower(n_name) WHEN 2 THEN lower(n_name) || ' bolt' WHEN 3 THEN 'gear' ELSE lower(n_name) END AS english_meaning,
CASE WHEN n_nationkey % 7 = 3 THEN 'xx' ELSE chr(1576 + n_nationkey % 7) || chr(1575) END AS arabic_text, CASE WHEN n_nationkey % 4 = 3 THEN 'PHRASE' ELSE 'WORD' END AS content_type, CASE WHEN n_nationkey % 6 = 5 THEN '' ELSE 'v' || n_nationkey END AS youtube_video_id, 1.0 AS segment_start_s, CASE WHEN n_nationkey = 10 THEN NULL ELSE 2.0 END AS segment_end_s FROM nation)"""
_SUP_ITEMS = """items AS (SELECT DISTINCT CASE p_partkey % 8 WHEN 0 THEN 'ring' WHEN 1 THEN 'Gear ' WHEN 2 THEN 'bolt ' || p_size WHEN 3 THEN 'red' WHEN 4 THEN 'very red japan' WHEN 5 THEN 'nothing ' || p_size WHEN 6 THEN 'china' ELSE 'iran bolt' END AS item FROM part)"""
_RENDER = "content_type = 'WORD' AND youtube_video_id <> '' AND segment_start_s IS NOT NULL AND segment_end_s IS NOT NULL AND english_meaning <> '' AND arabic_text <> ''"
_SEL = "sel AS (SELECT item, CASE length(item) % 4 WHEN 0 THEN 's1' WHEN 1 THEN 's2' WHEN 2 THEN 's' || (length(item) * 7 % 25) END AS selected_id FROM items)"


def _sup(spark, sf_dir):
    return table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("int").alias("ord"), *[
        F.expr(x).alias(n) for n, x in (
            ("supplementary_id", "concat('s', n_nationkey)"), ("english_meaning", "CASE n_nationkey % 5 WHEN 0 THEN 'ring' WHEN 1 THEN 'red ' || lower(n_name) WHEN 2 THEN lower(n_name) || ' bolt' WHEN 3 THEN 'gear' ELSE lower(n_name) END"),
            ("arabic_text", "CASE WHEN n_nationkey % 7 = 3 THEN 'xx' ELSE concat(substr('بةتثجحخ', CAST(n_nationkey % 7 AS INT) + 1, 1), 'ا') END"), ("content_type", "CASE WHEN n_nationkey % 4 = 3 THEN 'PHRASE' ELSE 'WORD' END"),
            ("youtube_video_id", "CASE WHEN n_nationkey % 6 = 5 THEN '' ELSE concat('v', n_nationkey) END"), ("segment_start_s", "1.0D"), ("segment_end_s", "CASE WHEN n_nationkey = 10 THEN NULL ELSE 2.0D END"),
        )
    ])


def _sup_items(spark, sf_dir):
    return table(spark, sf_dir, "part").select(F.expr("CASE p_partkey % 8 WHEN 0 THEN 'ring' WHEN 1 THEN 'Gear ' WHEN 2 THEN concat('bolt ', p_size) WHEN 3 THEN 'red' WHEN 4 THEN 'very red japan' WHEN 5 THEN concat('nothing ', p_size) WHEN 6 THEN 'china' ELSE 'iran bolt' END").alias("item")).distinct()


_STOPS = sql_list(text.STOP_WORDS)
_SUP_FOUND = f"""{_SUP}, {_SUP_ITEMS}, {_SEL}, rb AS (SELECT *, ({_RENDER}) ok FROM sup), fx AS (SELECT lower(trim(english_meaning)) k, arg_min(supplementary_id, ord) id, arg_min(ok, ord) ok FROM rb GROUP BY 1),
ex AS (SELECT item, fx.id FROM items JOIN fx ON k = lower(trim(item)) WHERE fx.ok), it AS (SELECT item, unnest(list_distinct({_TOK})) t FROM items), ct AS (SELECT ord, supplementary_id id, unnest(list_distinct(list_filter(regexp_extract_all(lower(english_meaning), '[a-z'']+'), lambda x: x NOT IN ({_STOPS})))) t FROM sup),
sc AS (SELECT item, ord, id, count(*) score FROM it JOIN ct USING (t) GROUP BY ALL), cd AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY item ORDER BY score DESC, ord) rank FROM sc) WHERE rank <= 5), nc AS (SELECT item, count(*) n FROM cd GROUP BY 1),
ch AS (SELECT sel.item, sel.selected_id, cd.id, rb.ok, rb.english_meaning en, rb.arabic_text ar FROM sel LEFT JOIN cd ON cd.item = sel.item AND cd.id = sel.selected_id LEFT JOIN rb ON rb.supplementary_id = cd.id),
oc AS (SELECT ch.item, ex.id xid, ch.id sid, coalesce(n, 0) n, {_loss("en").replace("lower(item)", "lower(ch.item)")} loss, CASE WHEN ex.id IS NOT NULL THEN 'EXACT' WHEN coalesce(n, 0) < 1 THEN 'NO_CANDIDATES' WHEN selected_id IS NULL THEN 'NOT_SELECTED' WHEN ch.id IS NULL THEN 'NOT_A_CANDIDATE' WHEN NOT ok THEN 'NOT_RENDERABLE' END o, regexp_matches(ar, '[\u0600-\u06FF]') sound FROM ch LEFT JOIN ex USING (item) LEFT JOIN nc USING (item)),
fin AS (SELECT *, coalesce(o, CASE WHEN loss IN ('ESSENTIAL_INFORMATION_LOSS', 'AMBIGUOUS') THEN loss WHEN NOT sound THEN 'WRONG_SCRIPT' ELSE 'SELECTED' END) outcome FROM oc)"""


def _selector(items):
    k = F.length("item") % 4
    return items.select("item", F.when(k == 0, "s1").when(k == 1, "s2").when(k == 2, F.concat(F.lit("s"), (F.length("item") * 7 % 25).cast("string"))).alias("selected_id"))


@query(f"WITH {_SUP_FOUND} SELECT item, CASE outcome WHEN 'EXACT' THEN xid WHEN 'SELECTED' THEN sid END AS supplementary_id, CASE outcome WHEN 'EXACT' THEN 'SUPPLEMENTARY_EXACT' WHEN 'SELECTED' THEN 'SUPPLEMENTARY_CANDIDATE_SELECTED' END AS method, CASE outcome WHEN 'EXACT' THEN 'FULL' WHEN 'SELECTED' THEN loss END AS information_loss, CASE outcome WHEN 'EXACT' THEN 0 ELSE n END AS n_candidates, outcome FROM fin")
def supplementary_layer(spark, sf_dir):
    items = _sup_items(spark, sf_dir)
    return e.supplementary(items, _sup(spark, sf_dir), _selector(items))


@query(f"WITH {_SUP}, {_SUP_ITEMS}, fx AS (SELECT lower(trim(english_meaning)) k, arg_min(supplementary_id, ord) id FROM sup GROUP BY 1) SELECT item, array_to_string(CASE WHEN id IS NOT NULL AND length(item) % 3 <> 0 THEN [id] ELSE []::VARCHAR[] END, ',') AS supporting FROM items LEFT JOIN fx ON k = lower(trim(item))")
def supporting_evidence(spark, sf_dir):
    r = _sup_items(spark, sf_dir).withColumn("status", F.lit("VERIFIED")).withColumn("render_source", F.when(F.length("item") % 3 != 0, "PRIMARY").otherwise("FINGERSPELL"))
    return e.supporting(r, _sup(spark, sf_dir)).select("item", F.array_join("supporting", ",").alias("supporting"))


@query(f"""WITH {_SUP}, g AS (SELECT DISTINCT chr(1587) || chr(1587) || CAST(p_size AS VARCHAR) AS item, CASE p_size % 4 WHEN 0 THEN ' ring ' WHEN 1 THEN 'red japan' WHEN 2 THEN 'bad/gloss' ELSE 'unknown' END AS gloss FROM part),
ok AS (SELECT item, trim(gloss) gloss FROM g WHERE regexp_matches(trim(gloss), '^[A-Za-z\\s\\-]+$')), ct AS (SELECT ord, supplementary_id id, unnest(list_distinct(list_filter(regexp_extract_all(lower(english_meaning), '[a-z'']+'), lambda x: x NOT IN ({_STOPS})))) t FROM sup),
sc AS (SELECT item, gloss, ord, id, count(*) score FROM (SELECT item, gloss, unnest(regexp_extract_all(lower(gloss), '[a-z'']+')) t FROM ok) JOIN ct USING (t) GROUP BY ALL)
SELECT item, gloss, CAST(rank AS INT) AS rank, id, score FROM (SELECT *, row_number() OVER (PARTITION BY item ORDER BY score DESC, ord) rank FROM sc) WHERE rank <= 5""")
def gloss_bridge(spark, sf_dir):
    g = table(spark, sf_dir, "part").select(F.concat(F.lit("سس"), F.col("p_size").cast("string")).alias("item"), F.expr("CASE p_size % 4 WHEN 0 THEN ' ring ' WHEN 1 THEN 'red japan' WHEN 2 THEN 'bad/gloss' ELSE 'unknown' END").alias("gloss")).distinct()
    return e.gloss_bridge(g.select("item"), e.as_catalog(_sup(spark, sf_dir)), g)


_RES = """r AS (SELECT l_orderkey AS doc_id, l_linenumber AS pos, CASE WHEN l_quantity < 20 THEN 'VERIFIED' WHEN l_quantity < 30 THEN 'FINGERSPELL_CANDIDATE' WHEN l_quantity < 31 THEN 'UNSUPPORTED' WHEN l_quantity < 32 THEN 'REVIEW_REQUIRED' ELSE 'VERIFIED' END AS status,
CASE WHEN l_quantity % 3 = 0 THEN 'PRIMARY' WHEN l_quantity % 3 = 1 THEN 'SUPPLEMENTARY' END AS render_source, CASE WHEN l_quantity % 5 = 0 THEN 'CORE_WITH_MODIFIER_LOSS' WHEN l_quantity % 5 = 1 THEN 'FULL' END AS information_loss, l_linestatus AS term, l_returnflag FROM lineitem)"""


def _res(spark, sf_dir):
    q = F.col("l_quantity")
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("pos"), F.when(q < 20, "VERIFIED").when(q < 30, "FINGERSPELL_CANDIDATE").when(q < 31, "UNSUPPORTED").when(q < 32, "REVIEW_REQUIRED").otherwise("VERIFIED").alias("status"),
        F.when(q % 3 == 0, "PRIMARY").when(q % 3 == 1, "SUPPLEMENTARY").alias("render_source"), F.when(q % 5 == 0, "CORE_WITH_MODIFIER_LOSS").when(q % 5 == 1, "FULL").alias("information_loss"), F.col("l_linestatus").alias("term"), "l_returnflag",
    )


_V = "status = 'VERIFIED'"
_PCT = {"full": "full_match", "verified": "verified", "partial": "partial_match", "renderable": "(verified + fingerspelled)", "primary": "verified_primary", "supplementary": "verified_supplementary", "combined": "(verified_primary + verified_supplementary)"}


@query(f"""WITH {_RES}, n AS (SELECT count(*) total, count(*) FILTER (WHERE {_V}) verified, count(*) FILTER (WHERE {_V} AND coalesce(information_loss, 'FULL') = 'FULL') full_match, count(*) FILTER (WHERE {_V} AND information_loss = 'CORE_WITH_MODIFIER_LOSS') partial_match, count(*) FILTER (WHERE status = 'FINGERSPELL_CANDIDATE') fingerspelled, count(*) FILTER (WHERE status = 'UNSUPPORTED') unsupported,
count(*) FILTER (WHERE status = 'REVIEW_REQUIRED') review, count(*) FILTER (WHERE {_V} AND render_source = 'PRIMARY') verified_primary, count(*) FILTER (WHERE {_V} AND render_source = 'SUPPLEMENTARY') verified_supplementary FROM r)
SELECT *, """ + ", ".join(f"floor({c} * 100.0::DOUBLE / total * 10.0::DOUBLE + 0.5::DOUBLE) / 10.0::DOUBLE AS pct_{k}" for k, c in _PCT.items()) + " FROM n")
def coverage_by_source(spark, sf_dir):
    return e.coverage(_res(spark, sf_dir))


_UNITS = """u AS (SELECT o_orderkey AS doc_id, 0 AS ord, 'u' || o_orderkey AS unit_id, CASE WHEN o_orderkey % 11 = 0 THEN '' ELSE o_orderstatus END AS concept, CASE WHEN o_orderkey % 13 = 0 THEN 'zz' WHEN o_orderkey % 17 = 0 THEN NULL ELSE substr(o_orderpriority, 3) END AS source_span, o_orderkey % 7 = 0 AS review_required, o_orderpriority AS source_text FROM orders)"""


def _units(spark, sf_dir):
    k = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(
        k.alias("doc_id"), F.lit(0).alias("ord"), F.concat(F.lit("u"), k.cast("string")).alias("unit_id"), F.when(k % 11 == 0, "").otherwise(F.col("o_orderstatus")).alias("concept"),
        F.when(k % 13 == 0, "zz").when(k % 17 != 0, F.substr("o_orderpriority", F.lit(3))).alias("source_span"), (k % 7 == 0).alias("review_required"), F.col("o_orderpriority").alias("source_text"),
    )


@query(f"""WITH {_RES}, {_UNITS}, x AS (SELECT r.*, unit_id FROM r JOIN u USING (doc_id)), ok AS (SELECT *, coalesce(source_span, '') <> '' AND contains(source_text, source_span) sp FROM u),
b AS (SELECT doc_id, 0 sub, 0 pos, unit_id || ': source_span not found verbatim in source text' w FROM ok WHERE NOT coalesce(sp, false) UNION ALL SELECT doc_id, 1, 0, unit_id || ': missing concept or source_span (no provenance)' FROM u WHERE coalesce(concept, '') = '' OR coalesce(source_span, '') = ''
UNION ALL SELECT doc_id, 2, pos, unit_id || ': VERIFIED ''' || term || ''' has no row in either dictionary' FROM x WHERE {_V} AND l_returnflag = 'R' UNION ALL SELECT doc_id, 2, pos, unit_id || ': FINGERSPELL_CANDIDATE ''' || term || ''' is not fully resolved to letters' FROM x WHERE status = 'FINGERSPELL_CANDIDATE' AND l_returnflag <> 'N'),
v AS (SELECT doc_id, 2 sub, pos, unit_id || ': ''' || term || ''' ' || status || ': no sign' w FROM x WHERE status IN ('UNSUPPORTED', 'REVIEW_REQUIRED') UNION ALL SELECT doc_id, 3, 0, unit_id || ': unit-level review_required flag set' FROM u WHERE review_required),
bb AS (SELECT doc_id, string_agg(w, '; ' ORDER BY sub, pos, w) w FROM b GROUP BY 1), vv AS (SELECT doc_id, string_agg(w, '; ' ORDER BY sub, pos, w) w FROM v GROUP BY 1), c AS (SELECT doc_id, count(*) FILTER (WHERE {_V}) vs, count(*) FILTER (WHERE status = 'FINGERSPELL_CANDIDATE') fs, count(*) FILTER (WHERE status = 'UNSUPPORTED') us, count(*) FILTER (WHERE status = 'REVIEW_REQUIRED') rr FROM x GROUP BY 1)
SELECT doc_id, 1::BIGINT AS total_units, CASE WHEN sp THEN 1 ELSE 0 END::BIGINT AS verified_spans, coalesce(vs, 0) AS verified_signs, coalesce(fs, 0) AS fingerspelled, coalesce(us, 0) AS unsupported, coalesce(rr, 0) AS review_required, coalesce(bb.w, '') AS blocking, coalesce(vv.w, '') AS review,
CASE WHEN bb.w IS NOT NULL THEN 'BLOCKED' WHEN vv.w IS NOT NULL THEN 'REVIEW_REQUIRED' WHEN coalesce(fs, 0) > 0 THEN 'PASS_WITH_FALLBACK' ELSE 'PASS' END AS overall FROM ok LEFT JOIN c USING (doc_id) LEFT JOIN bb USING (doc_id) LEFT JOIN vv USING (doc_id)""")
def validation_reasons(spark, sf_dir):
    u = _units(spark, sf_dir)
    r = _res(spark, sf_dir).withColumn("ord", F.lit(0)).withColumn("ref_id", F.when(F.col("l_returnflag") != "R", "c")).withColumn("spelled", F.col("l_returnflag") == "N").withColumn("reason", F.lit("no sign"))
    d = e.validate(u.drop("source_text"), u.select("doc_id", "source_text"), r)
    return d.withColumn("blocking", F.array_join("blocking", "; ")).withColumn("review", F.array_join("review", "; "))


@query(f"""WITH {_RES} SELECT doc_id, array_to_string(['| Segment | Decision | Source | Method | Term | Label | Concept | Sentence | Span |', '|---|---|---|---|---|---|---|---|---|'], chr(10)) || chr(10) ||
string_agg(w, chr(10) ORDER BY pos, w) || chr(10) AS markdown FROM (SELECT doc_id, pos, printf('| `%03d_%s` | %s%s | %s | %s | %s | %s | c | s | "x" |', CAST(pos AS INT), term, status, CASE WHEN status = 'FINGERSPELL_CANDIDATE' THEN ' (FINGERSPELL)' ELSE '' END, coalesce(render_source, ''), coalesce(information_loss, ''), term, l_returnflag) w FROM r) GROUP BY 1""")
def trace_markdown(spark, sf_dir):
    line = e.trace_line(F.col("status"), F.when(F.col("status") == "FINGERSPELL_CANDIDATE", "FINGERSPELL"), F.col("render_source"), F.col("information_loss"), F.col("term"), F.col("l_returnflag"), F.lit("c"), F.lit("s"), F.lit("x"), text.segment_stem(F.col("pos").cast("int"), F.col("term")))
    return e.trace_markdown(_res(spark, sf_dir), "doc_id", "pos", line)


@query("""SELECT (SELECT count(*) FROM benchmark) AS concepts, (SELECT count(*) FILTER (WHERE length(text) % 3 <> 0) FROM benchmark) AS verified_concepts, (SELECT sum(len(regexp_extract_all(text, '[^ ]+')))::BIGINT FROM conversations) AS plan_items, (SELECT count(*) FILTER (WHERE o_orderstatus <> 'P') FROM orders) AS units_ok""")
def stage_counts(spark, sf_dir):
    concepts = table(spark, sf_dir, "benchmark").select((F.length("text") % 3 != 0).alias("verified"))
    plans = table(spark, sf_dir, "conversations").select(F.regexp_extract_all("text", F.lit("([^ ]+)"), F.lit(1)).alias("plan"))
    units = table(spark, sf_dir, "orders").select(F.when(F.col("o_orderstatus") != "P", "OK").otherwise("REVIEW_REQUIRED").alias("plan_status"))
    return e.stage_counts(concepts, plans, units)
