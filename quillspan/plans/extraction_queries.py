"""Model replies, listing cards, labels and stamps."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import parsing, text
from .base import query, table
from .text_queries import lenient_sql

# Replies of every kind: sound, with thoughts and chatter around, punctuation lost, wrong types, no JSON at all.
_REPLY = """CASE event_id % 7 WHEN 0 THEN '[{"concept": "' || event_type || '", "key_terms": ["a", "b"], "source_span": "u' || user_id || '"}]'
WHEN 1 THEN '<think>a [b]</think> Here: [{"concept": "' || event_type || '", "key_terms": [], "source_span": "s"}] done'
WHEN 2 THEN '[{"concept": "' || event_type || '", "key_terms": ["t"]},"source_span": "u' || user_id || '"]'
WHEN 3 THEN '[{"concept": "' || event_type || '", "key_terms": "t", "source_span": "s"}]' WHEN 4 THEN 'not json at all'
WHEN 5 THEN '[{"concept": "", "key_terms": ["x"], "source_span": "s"}]' ELSE '[]' END"""
_RETRY = """CASE WHEN event_id % 5 = 0 THEN NULL WHEN event_id % 5 = 1 THEN '[]' WHEN event_id % 5 = 2 THEN 'still not json' WHEN event_id % 5 = 3 THEN '[{"concept": "r", "key_terms": ["k"]},"source_span": "z"]'
ELSE '[{"concept": "r", "key_terms": ["k"], "source_span": "z"}, {"concept": "q", "key_terms": [], "source_span": "y"}]' END"""


def _read(c: str, n: str) -> str:
    bare = f"trim(regexp_replace({c}, '(?s)<think>.*?</think>', '', 'g'))"
    arr = f"CASE WHEN json_valid({bare}) THEN {bare} ELSE regexp_extract({bare}, '(?s)\\[.*\\]') END"
    sound = "coalesce(json_type(x, '$.concept') = 'VARCHAR' AND x ->> '$.concept' <> '' AND json_type(x, '$.key_terms') = 'ARRAY' AND json_type(x, '$.source_span') = 'VARCHAR' AND x ->> '$.source_span' <> '', false)"
    return f"""{n}a AS (SELECT event_id, {arr} j, {lenient_sql(c)} l FROM r),
{n} AS (SELECT event_id, CASE WHEN json_valid(j) AND starts_with(j, '[') THEN coalesce(list_bool_and(list_transform(CAST(j AS JSON[]), lambda x: {sound})), true) ELSE false END ok, CASE WHEN json_valid(j) AND starts_with(j, '[') THEN json_array_length(j) END n,
len(l) > 0 AND list_bool_and(list_transform(l, lambda x: x.c <> '' AND x.s <> '')) lenient, len(l) m FROM {n}a)"""


@query(f"""WITH r AS (SELECT event_id, {_REPLY} raw, coalesce({_RETRY}, '') retry FROM events), {_read("raw", "a")}, {_read("retry", "b")}
SELECT event_id, CASE WHEN a.ok THEN 'OK' WHEN a.lenient THEN 'OK_AFTER_LENIENT_EXTRACT' WHEN b.ok OR b.lenient THEN 'OK_AFTER_REPAIR' ELSE 'FAILED_AFTER_REPAIR' END AS status,
CAST(CASE WHEN a.ok THEN a.n WHEN a.lenient THEN a.m WHEN b.ok THEN b.n WHEN b.lenient THEN b.m ELSE 0 END AS INT) AS n_concepts FROM a JOIN b USING (event_id)""")
def extraction_status(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", F.expr(_REPLY).alias("raw"), F.expr(_RETRY).alias("retry"))
    d = e.select("event_id", parsing.extraction(F.col("raw"), F.col("retry")).alias("x"))
    return d.select("event_id", F.col("x.status").alias("status"), F.size("x.concepts").alias("n_concepts"))


_CARD = """CASE page_id % 4 WHEN 0 THEN '<h5 class="field-title">  <b>' || split_part(url, '/', 3) || '</b> &amp; co </h5><a href="https://player.vimeo.com/external/' || page_id || '.hd.mp4?s=1&amp;p=2">v</a><div data-thumb=''/t/' || page_id || '.jpg''></div>'
WHEN 1 THEN '<h5 class=''field-title''>' || split_part(url, '/', 3) || '</h5><a href="https://player.vimeo.com/video/' || page_id || '">v</a>' WHEN 2 THEN '<h5 class="field-title">x' END"""


@query(f"""WITH c AS (SELECT page_id, {_CARD} h FROM pages), t AS (SELECT page_id, h, CASE WHEN regexp_matches(h, '(?s)field-title["'']?>(.*?)</h5>') THEN trim(regexp_replace(regexp_extract(h, '(?s)field-title["'']?>(.*?)</h5>', 1), '<[^>]+>', '', 'g')) END w,
CASE WHEN regexp_matches(h, 'href="(https://player\\.vimeo\\.com[^"]+)"') THEN replace(regexp_extract(h, 'href="(https://player\\.vimeo\\.com[^"]+)"', 1), '&amp;', '&') END v FROM c)
SELECT page_id, w AS word_en, v AS video_url, nullif(regexp_extract(v, '/external/(\\d+)\\.', 1), '') AS vimeo_id, nullif(regexp_extract(h, 'data-thumb=''([^'']*)''', 1), '') AS thumb_path, v IS NOT NULL AS has_video FROM t""")
def card_parse(spark, sf_dir):
    d = table(spark, sf_dir, "pages").select("page_id", parsing.card(F.expr(_CARD)).alias("c"))
    return d.select("page_id", "c.*")


@query("""SELECT o_orderkey, printf('%03d_%s', CAST(o_orderkey % 1200 AS INT), o_orderstatus) AS stem, strftime(o_orderdate::TIMESTAMP, '%Y-%m-%dT%H:%M:%SZ') AS stamp, 'query: ' || concat_ws(' | ', nullif(o_orderpriority, ''), nullif(CASE WHEN o_orderkey % 2 = 0 THEN '' ELSE o_clerk END, '')) AS embedded,
coalesce(nullif(CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE o_orderpriority END, ''), nullif(CASE WHEN o_orderkey % 2 = 0 THEN o_clerk END, ''), CAST(o_orderkey AS VARCHAR)) AS shown FROM (SELECT *, 'c' || CAST(o_custkey AS VARCHAR) o_clerk FROM orders)""")
def stamps_and_labels(spark, sf_dir):
    o = table(spark, sf_dir, "orders").withColumn("o_clerk", F.concat(F.lit("c"), F.col("o_custkey").cast("string")))
    return o.select(
        "o_orderkey", text.segment_stem((F.col("o_orderkey") % 1200).cast("int"), F.col("o_orderstatus")).alias("stem"), text.utc_stamp(F.col("o_orderdate").cast("timestamp")).alias("stamp"),
        text.catalog_text(F.col("o_orderpriority"), F.when(F.col("o_orderkey") % 2 == 0, "").otherwise(F.col("o_clerk")), prefix="query: ").alias("embedded"),
        text.display_label(F.when(F.col("o_orderkey") % 3 == 0, "").otherwise(F.col("o_orderpriority")), F.when(F.col("o_orderkey") % 2 == 0, F.col("o_clerk")), F.col("o_orderkey").cast("string")).alias("shown"),
    )


@query("""SELECT user_id, row_number() OVER w - 1 AS i, floor(round_even(date_diff('microsecond', lag(ts) OVER w, ts) / 1e6, 2) + 0.5) AS seconds FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)""")
def elapsed(spark, sf_dir):
    from pyspark.sql import Window as W

    w = W.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, sf_dir, "events").select("user_id", (F.row_number().over(w) - 1).cast("long").alias("i"), "ts", F.lag("ts").over(w).alias("b"))
    return e.select("user_id", "i", F.floor(text.elapsed_seconds(F.col("b"), F.col("ts")) + 0.5).cast("double").alias("seconds"))


_PLAN = """CASE o_orderkey % 7 WHEN 0 THEN '["' || o_orderstatus || '", " b ", ""]' WHEN 1 THEN 'plan: ["x", 2, "y"] done' WHEN 2 THEN '{"a": 1}' WHEN 3 THEN 'none' WHEN 4 THEN '["", " "]' WHEN 5 THEN NULL ELSE '[]' END"""
_SENTENCE = "CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE o_orderpriority END"


@query(f"""WITH r AS (SELECT o_orderkey, {_PLAN} raw, {_SENTENCE} s FROM orders), a AS (SELECT *, CASE WHEN json_valid(raw) THEN raw ELSE regexp_extract(raw, '(?s)\\[.*\\]') END j FROM r),
i AS (SELECT *, CASE WHEN json_valid(j) AND starts_with(j, '[') THEN list_filter(list_transform(CAST(j AS JSON[]), lambda x: trim(x ->> '$')), lambda x: x <> '') END t FROM a), w AS (SELECT *, CASE WHEN s = '' THEN 'no sentence' WHEN raw IS NULL THEN 'no reply' WHEN t IS NULL THEN 'no JSON array' WHEN len(t) = 0 THEN 'empty' END y FROM i)
SELECT o_orderkey, CASE WHEN y IS NULL THEN array_to_string(t, ',') ELSE '' END AS items, CASE WHEN y IS NULL THEN 'OK' ELSE 'REVIEW_REQUIRED' END AS status, y AS reason FROM w""")
def plan_reply(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", parsing.plan(F.expr(_PLAN), F.expr(_SENTENCE)).alias("p"))
    return o.select("o_orderkey", F.array_join("p.items", ",").alias("items"), F.col("p.status").alias("status"), F.col("p.reason").alias("reason"))


_SAID = """CASE conv_id % 3 WHEN 0 THEN '[{"educational_sentence": "s' || turn || '"}, {"educational_sentence": null}, {"other": 1}]' WHEN 1 THEN 'so: [{"educational_sentence": "a"}]' ELSE 'no' END"""


@query(f"""WITH r AS (SELECT conv_id, turn, {_SAID} raw FROM conversations), a AS (SELECT *, CASE WHEN json_valid(raw) THEN raw ELSE regexp_extract(raw, '(?s)\\[.*\\]') END j FROM r)
SELECT conv_id, turn, coalesce(CASE WHEN json_valid(j) THEN json_extract_string(j, '$[' || CAST(turn % 4 AS VARCHAR) || '].educational_sentence') END, '') AS sentence FROM a""")
def sentence_reply(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    return c.select("conv_id", "turn", parsing.sentence_at(F.expr(_SAID), (F.col("turn") % 4).cast("int")).alias("sentence"))
