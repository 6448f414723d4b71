"""Evidence lookups and detection statistics on the supplied tables."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import catalog_text, clip_key, label, rounded
from ..operators import evidence as e
from .base import query, table
from .report_queries import _PAIRS, _pairs
from .series_queries import _S, KEY, events


@query("SELECT lower(p_name) AS key, arg_min(p_type, p_partkey) AS p_type FROM part GROUP BY 1")
def content_type_recovery(spark, sf_dir):
    return e.first_value(table(spark, sf_dir, "part"), F.lower("p_name"), "p_type", "p_partkey")


@query("""WITH t AS (SELECT DISTINCT upper(p_name) term FROM part UNION SELECT 'NO SUCH') SELECT term, coalesce((SELECT array_to_string(list_sort(list(p_partkey)), ',') FROM part WHERE lower(p_name) = lower(term)), '') AS ids FROM t""")
def term_rows(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    t = p.select(F.upper("p_name").alias("term")).distinct().union(spark.createDataFrame([("NO SUCH",)], "term string"))
    return e.rows_of_terms(t, p, "term", "p_name", "p_partkey").select("term", F.array_join(F.transform("ids", lambda x: x.cast("string")), ",").alias("ids"))


@query("""WITH a AS (SELECT l_orderkey item, l_linenumber rank, l_partkey id, 'first' source, l_linenumber o FROM lineitem WHERE l_linenumber <= 3 UNION ALL SELECT l_orderkey, l_linenumber, l_partkey, 'second', 1000 + l_linenumber FROM lineitem WHERE l_linenumber > 2)
SELECT item, id AS evidence_id, arg_min(source, o) AS source FROM a GROUP BY ALL""")
def evidence_set(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("item"), F.col("l_linenumber").alias("rank"), F.col("l_partkey").alias("evidence_id"))
    return e.merge_evidence([("first", l.where("rank <= 3")), ("second", l.where("rank > 2"))])


@query(f"""WITH {_S}, c AS (SELECT user_id video, i pos, event_type en, 'k' || event_id % 50 ar, i::DOUBLE start_s, CASE WHEN event_id % 9 = 0 THEN NULL ELSE i + 2.0::DOUBLE END end_s FROM s), it AS (SELECT DISTINCT user_id * 10 + event_id % 3 item_id, user_id video, CASE event_id % 3 WHEN 0 THEN 'CLICK' WHEN 1 THEN 'none' ELSE 'VIEW' END en, CASE event_id % 3 WHEN 1 THEN 'k7' ELSE 'zz' END ar FROM events),
h AS (SELECT item_id, arg_min({{'s': start_s, 'e': end_s}}, pos) w FROM it JOIN c ON c.video = it.video AND (lower(c.en) = lower(it.en) OR c.ar = it.ar) GROUP BY 1)
SELECT it.item_id, CASE WHEN w.e > w.s THEN greatest(0.0::DOUBLE, w.s - 0.5::DOUBLE) END AS start_s, CASE WHEN w.e > w.s THEN w.e + 0.5::DOUBLE END AS end_s FROM it LEFT JOIN h USING (item_id)""")
def caption_window(spark, sf_dir):
    s = events(spark, sf_dir)
    i, k = F.col("event_id"), F.col("event_id") % 3
    c = s.select(F.col(KEY).alias("video"), F.col("i").alias("pos"), F.col("event_type").alias("en"), F.concat(F.lit("k"), (i % 50).cast("string")).alias("ar"), F.col("i").cast("double").alias("start_s"), F.when(i % 9 != 0, F.col("i") + 2.0).alias("end_s"))
    it = s.select((F.col(KEY) * 10 + k).alias("item_id"), F.col(KEY).alias("video"), F.when(k == 0, "CLICK").when(k == 1, "none").otherwise("VIEW").alias("en"), F.when(k == 1, "k7").otherwise("zz").alias("ar")).distinct()
    return e.caption_window(it, c)


@query(f"""WITH {_PAIRS}, x AS (SELECT conv_id, turn, w, count(*) n FROM (SELECT conv_id, turn, unnest(a) w FROM p WHERE b IS NOT NULL) GROUP BY ALL), y AS (SELECT conv_id, turn, w, count(*) m FROM (SELECT conv_id, turn, unnest(b) w FROM p WHERE b IS NOT NULL) GROUP BY ALL),
f AS (SELECT conv_id, turn, coalesce(n, 0) x, coalesce(m, 0) y, CASE WHEN n > 0 AND m > 0 THEN 1.0::DOUBLE ELSE 1.4054651081081644::DOUBLE END i FROM x FULL JOIN y USING (conv_id, turn, w)), s AS (SELECT conv_id, turn, sum(x * i * (y * i)) pq, sum(x * i * (x * i)) pp, sum(y * i * (y * i)) qq FROM f GROUP BY ALL)
SELECT conv_id, turn, floor((CASE WHEN pp > 0 AND qq > 0 THEN pq / sqrt(pp) / sqrt(qq) ELSE 0.0::DOUBLE END) * 1e6 + 0.5::DOUBLE) / 1e6 AS cosine FROM s""")
def tfidf_cosine(spark, sf_dir):
    d = e.tfidf_cosine(_pairs(spark, sf_dir), ["conv_id", "turn"], "a", "b")
    return d.select("conv_id", "turn", rounded(F.col("cosine")).alias("cosine"))


@query(f"""WITH {_S}, d AS (SELECT *, abs(x - lag(x) OVER w) step, sum(CASE WHEN x IS NOT NULL THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY i) run FROM s WINDOW w AS (PARTITION BY user_id ORDER BY i)), g AS (SELECT user_id, count(*) gaps, max(g) longest_gap FROM (SELECT user_id, run, count(*) g FROM d WHERE x IS NULL GROUP BY ALL) GROUP BY 1),
j AS (SELECT user_id, count(*) frames, count(x) detected, median(step) jitter FROM d GROUP BY 1), k AS (SELECT user_id, count(*) spikes FROM d JOIN j USING (user_id) WHERE step > 5 * jitter GROUP BY 1)
SELECT user_id, frames, detected, jitter, coalesce(gaps, 0) AS gaps, coalesce(longest_gap, 0) AS longest_gap, coalesce(spikes, 0) AS spikes FROM j LEFT JOIN g USING (user_id) LEFT JOIN k USING (user_id)""")
def detection_rates(spark, sf_dir):
    return e.detection(events(spark, sf_dir), KEY)


@query("""WITH m AS (SELECT label, i - 1 AS cell, avg(abs(embedding[i]::DOUBLE)) m FROM (SELECT label, embedding, unnest(range(1, 65)) i FROM embeddings) GROUP BY ALL) SELECT label, CAST(cell AS INT) AS cell, floor(m / max(m) OVER (PARTITION BY label) * 1e4 + 0.5::DOUBLE) / 1e4 AS value FROM m""")
def fingerprint(spark, sf_dir):
    d = table(spark, sf_dir, "embeddings").select("label", F.transform("embedding", lambda x: F.abs(x.cast("double"))).alias("v"))
    return e.fingerprint(d, "label").select("label", "cell", rounded(F.col("value"), 4).alias("value"))


@query("SELECT c_nationkey AS k, least(min(c_acctbal), min(c_custkey::DOUBLE)) AS low, greatest(max(c_acctbal), max(c_custkey::DOUBLE)) AS high FROM customer GROUP BY 1")
def shared_calibration(spark, sf_dir):
    d = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k"), F.col("c_acctbal").alias("l"), F.col("c_custkey").cast("double").alias("r"))
    return e.calibration(d, "k", "l", "r")


@query("WITH h AS (SELECT label, avg(CASE WHEN embedding[1] >= embedding[2] THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) v FROM embeddings GROUP BY 1) SELECT label, floor(v * 1e6 + 0.5::DOUBLE) / 1e6 AS violations, v > 0.2 AS failed FROM h")
def handedness_check(spark, sf_dir):
    d = table(spark, sf_dir, "embeddings").select("label", F.get("embedding", F.lit(1)).alias("l"), F.get("embedding", F.lit(0)).alias("r"))
    return e.handedness(d, "label", "l", "r").select("label", rounded(F.col("violations")).alias("violations"), "failed")


@query(f"WITH {_S} SELECT user_id, arg_min(i, {{'s': abs(value - 50), 'i': i}}) AS frame FROM s JOIN events USING (event_id, user_id) GROUP BY 1")
def best_frame(spark, sf_dir):
    s = events(spark, sf_dir).join(table(spark, sf_dir, "events").select("event_id", "value"), "event_id")
    return e.best_frame(s, KEY, F.abs(F.col("value") - 50), "i")


@query("""SELECT p_partkey, concat_ws(' | ', p_name, nullif(CASE WHEN p_partkey % 2 = 0 THEN '' ELSE p_brand END, ''), p_type) AS catalog_text, CASE WHEN p_partkey % 2 = 0 THEN p_name ELSE p_name || ' (' || p_brand || ')' END AS label,
coalesce(nullif(lower(trim(regexp_replace(p_type, '[^A-Za-z0-9]+', '-', 'g'), '-')), ''), 'unnamed') || '/' || coalesce(nullif(lower(trim(regexp_replace(p_name, '[^A-Za-z0-9]+', '-', 'g'), '-')), ''), 'unnamed') || '_' || left(md5(p_name), 8) || '.mp4' AS clip_key FROM part""")
def catalog_labels(spark, sf_dir):
    b = F.when(F.col("p_partkey") % 2 == 0, "").otherwise(F.col("p_brand"))
    return table(spark, sf_dir, "part").select("p_partkey", catalog_text(F.col("p_name"), b, F.col("p_type")).alias("catalog_text"), label(F.col("p_name"), b).alias("label"), clip_key(F.col("p_name"), F.md5("p_name"), F.col("p_type")).alias("clip_key"))


@query("WITH m AS (SELECT DISTINCT lang FROM documents), q AS (SELECT DISTINCT item_id FROM benchmark) SELECT lang AS model, item_id, row_number() OVER (PARTITION BY lang ORDER BY item_id) AS seq FROM m CROSS JOIN q")
def model_questions(spark, sf_dir):
    """A stated set of models against every question: one side has a handful of rows, fixed by its meaning."""
    m = table(spark, sf_dir, "documents").select(F.col("lang").alias("model")).distinct()
    d = table(spark, sf_dir, "benchmark").select("item_id").distinct().crossJoin(m)
    return d.select("model", "item_id", F.row_number().over(W.partitionBy("model").orderBy("item_id")).cast("long").alias("seq"))
