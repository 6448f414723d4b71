"""Sources and sinks on whole tables: written to the shared scratch folder, read back, and compared with SQL on the tables."""

from __future__ import annotations

import atexit
import contextlib
import shutil
import tempfile
import uuid

from pyspark.sql import SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text
from ..operators import series
from ..sources import readers, sinks
from ..streaming import event_log, ordered
from .base import query, table
from .series_queries import _B, _S, KEY, events


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder under spark.checkpoint.dir; a temporary one only where that is unset and all runs on one machine."""
    shared = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if shared:
        path = f"{shared}/quillspan-queries/{name}-{uuid.uuid4().hex[:12]}"
        atexit.register(_delete, spark, path)  # results are read from it until the session ends
        return path
    if not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("name a folder that all executors share in spark.checkpoint.dir")
    path = tempfile.mkdtemp(prefix=f"quillspan-{name}-")
    atexit.register(shutil.rmtree, path, True)
    return f"{path}/d"


def _delete(spark: SparkSession, path: str) -> None:
    with contextlib.suppress(Exception):  # the session may have ended already
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path).getParent()
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path), True)


def _lines(spark, rows, name):
    """Rows of one text column as one JSON array in a file of its own."""
    path = scratch(spark, name)
    one = rows.agg(F.concat(F.lit("["), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "j"))), lambda x: x["j"]), ","), F.lit("]")).alias("value"))
    one.coalesce(1).write.text(path)
    return path


@query("""SELECT 'sha256:' || sha256(text || chr(10)) AS source_id, 'en' AS source_language, 'user-declared' AS source_language_mode, length(text) + 1 AS n_chars FROM benchmark WHERE text IS NOT NULL""")
def texts_on_disk(spark, sf_dir):
    path = scratch(spark, "texts")
    table(spark, sf_dir, "benchmark").where("text is not null").select("item_id", F.col("text").alias("value")).repartition("item_id").write.partitionBy("item_id").text(path)
    d = readers.read_texts(spark, f"{path}/item_id=*/*.txt", "en")
    return d.select("source_id", "source_language", "source_language_mode", F.length("source_text").alias("n_chars"))


_KEYS = "n_nationkey % 3 = 0"


@query(f"""WITH c AS (SELECT CAST(row_number() OVER (ORDER BY n_nationkey) - 1 AS INT) AS ord, 'n' || n_nationkey AS id, n_name AS word_en, n_nationkey FROM nation)
SELECT ord, id, word_en, 'a' || n_nationkey || ',b' || n_nationkey AS aliases FROM c WHERE {_KEYS} UNION ALL SELECT ord, id, word_en, '' FROM c WHERE NOT ({_KEYS}) UNION ALL SELECT -1, 'missing', NULL, '0'""")
def catalog_on_disk(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    k = F.col("n_nationkey").cast("string")
    ident = F.concat(F.lit("n"), k)
    catalog = _lines(spark, n.select(F.col("n_nationkey").alias("ord"), F.to_json(F.struct(ident.alias("id"), F.col("n_name").alias("word_en"))).alias("j")), "catalog")
    lists = F.struct(F.when(F.expr(_KEYS), ident).otherwise(F.concat(F.lit("zz"), k)).alias("catalog_id"), F.array(F.concat(F.lit("a"), k)).alias("aliases_en"), F.array(F.concat(F.lit("b"), k)).alias("aliases_ar"))
    aliases = _lines(spark, n.select(F.col("n_nationkey").alias("ord"), F.to_json(lists).alias("j")), "aliases")
    c = readers.read_catalog(spark, catalog)
    a = readers.read_aliases(spark, aliases, c).groupBy("catalog_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "alias"))), lambda x: x["alias"]), ",").alias("aliases"))
    none = readers.read_catalog(spark, f"{catalog}/none.json", readers.SUPPLEMENTARY).agg(F.lit(-1).alias("ord"), F.lit("missing").alias("id"), F.lit(None).cast("string").alias("word_en"), F.count(F.lit(1)).cast("string").alias("aliases"))
    return c.join(a, F.col("id") == F.col("catalog_id"), "left").select("ord", "id", "word_en", F.coalesce("aliases", F.lit("")).alias("aliases")).unionByName(none)


@query("SELECT p_brand AS letter, arg_max(p_name, p_partkey) AS word_en, CAST(max(p_partkey) AS VARCHAR) AS catalog_id FROM part GROUP BY 1")
def alphabet(spark, sf_dir):
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("ord"), F.col("p_brand").alias("letter"), F.lit("n").alias("name_ar"), F.col("p_name").alias("word_en"), F.col("p_partkey").cast("string").alias("catalog_id"))
    return readers.read_alphabet(p).select("letter", "word_en", "catalog_id")


@query("SELECT n_nationkey, CASE n_nationkey % 3 WHEN 0 THEN n_nationkey / 4::DOUBLE END AS acc FROM nation")
def log_blocks(spark, sf_dir):
    path = scratch(spark, "logs")
    k = F.col("n_nationkey")
    body = F.when(k % 3 == 0, F.concat(F.lit("start === old {} === {\"acc\": "), (k / 4).cast("string"), F.lit("} end"))).when(k % 3 == 1, "no marker here").otherwise("=== not json")
    table(spark, sf_dir, "nation").select("n_nationkey", body.alias("value")).repartition("n_nationkey").write.partitionBy("n_nationkey").text(path)
    d = readers.read_log_json(spark, f"{path}/n_nationkey=*/*.txt", "===", "acc double")
    return d.select(F.regexp_extract("file", "n_nationkey=([0-9]+)", 1).cast("int").alias("n_nationkey"), F.col("result.acc").alias("acc"))


@query("""SELECT c_custkey AS k, CASE WHEN c_custkey % 3 = 0 THEN -c_acctbal ELSE c_acctbal END AS v FROM customer""")
def cache_upsert(spark, sf_dir):
    path, calls = scratch(spark, "cache"), []
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("v"))
    make = lambda d: calls.append(1) or d
    readers.cached_if_same(spark, c, "k", path, make)
    cached = readers.cached_if_same(spark, c, "k", path, make)
    if len(calls) != 1:  # the second time the stored table serves
        raise RuntimeError("the cache was made twice")
    return readers.upsert(cached, c.where("k % 3 = 0").select("k", (-F.col("v")).alias("v")), ["k"])


@query("SELECT 'events' AS artifact, true AS available, count(*) AS n FROM events UNION ALL SELECT 'pages', true, count(*) FROM pages UNION ALL SELECT 'lost', false, NULL")
def artifact_summary(spark, sf_dir):
    n = lambda t: table(spark, sf_dir, t).agg(F.count(F.lit(1)).alias("n"))
    return readers.summary({"events": n("events"), "pages": n("pages"), "lost": None}).select("artifact", "available", "n")


@query("SELECT r_regionkey, 'r' || r_regionkey || '.txt' AS name, length(r_name) + 1 AS size FROM region WHERE r_regionkey % 2 = 0")
def listed_files(spark, sf_dir):
    path = scratch(spark, "files")
    table(spark, sf_dir, "region").select("r_regionkey", F.col("r_name").alias("value")).repartition("r_regionkey").write.partitionBy("r_regionkey").text(path)
    # Spark names its part files; the folder's key stands for the name
    d = spark.read.format("binaryFile").load(f"{path}/r_regionkey=*/*.txt").select(F.concat(F.lit("r"), F.regexp_extract("path", "r_regionkey=([0-9]+)", 1), F.lit(".txt")).alias("name"), F.col("length").alias("size"))
    allowed = [f"r{k}.txt" for k in range(0, 100, 2)]
    return d.where(F.col("name").isin(allowed)).select(F.regexp_extract("name", "r([0-9]+)", 1).cast("int").alias("r_regionkey"), "name", F.col("size").cast("long").alias("size"))


@query("SELECT 'u' || user_id AS job_id, count(*) AS n_events, CASE WHEN arg_max(value > 90, event_id) THEN 'blocked' WHEN arg_max(event_type, event_id) <> 'purchase' THEN 'error' ELSE 'done' END AS job_status FROM events GROUP BY 1")
def streamed_jobs(spark, sf_dir):
    path = scratch(spark, "log")
    stage = F.when(F.col("event_type") == "purchase", "DONE").otherwise(F.upper("event_type"))
    e = table(spark, sf_dir, "events").select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("job_id"), F.col("event_id").alias("seq"), stage.alias("stage"), F.when(F.col("value") > 90, "blocked").otherwise("done").alias("status"), F.lit("").alias("message"), F.col("ts").cast("timestamp").alias("ts"), F.lit(0.0).alias("elapsed_s"))
    event_log.append(e, path)
    put = lambda d, _: d.write.mode("overwrite").parquet(f"{path}-out")
    q = event_log.statuses(event_log.read_stream(spark, path)).writeStream.outputMode("complete").foreachBatch(put).option("checkpointLocation", f"{path}-checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.parquet(f"{path}-out").select("job_id", "n_events", "job_status")


ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@query(f"""WITH RECURSIVE {_S}, r AS (SELECT user_id, i, x y FROM s WHERE i = 0 UNION ALL SELECT s.user_id, s.i, CASE WHEN s.x IS NULL THEN NULL WHEN r.y IS NULL THEN s.x ELSE r.y * 0.75::DOUBLE + s.x * 0.25::DOUBLE END FROM r JOIN s ON s.user_id = r.user_id AND s.i = r.i + 1)
SELECT CAST(user_id AS VARCHAR) AS key, i::BIGINT AS i, y FROM r""")
def streamed_ema(spark, sf_dir):
    path = scratch(spark, "series")
    frames = events(spark, sf_dir).select(F.col(KEY).cast("string").alias("key"), F.col("i").cast("long").alias("i"), "x")
    frames.repartition(3, F.xxhash64("key", "i")).write.parquet(f"{path}/in")  # in no order
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    stream = spark.readStream.schema("key string, i long, x double").parquet(f"{path}/in")
    q = event_log.step_stream(stream).writeStream.outputMode("append").format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    return spark.read.parquet(f"{path}/out")


@query("""SELECT o_orderstatus AS run, count(*) AS n, sum(o_custkey)::BIGINT AS keys FROM orders GROUP BY 1""")
def stage_artifacts(spark, sf_dir):
    path = scratch(spark, "stages")
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    for run in ("F", "O", "P", "F"):  # a repeated run replaces its own rows only
        sinks.write_stage(o.where(F.col("o_orderstatus") == run), path, run, "plan")
    parts = [sinks.read_stage(spark, path, run, "plan", "o_orderkey long, o_custkey long").withColumn("run", F.lit(run)) for run in ("F", "O", "P")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy("run").agg(F.count(F.lit(1)).alias("n"), F.sum("o_custkey").alias("keys"))


@query("SELECT user_id, count(*) AS n_frames, arg_min(value, event_id) AS first_value, CAST(count(*) AS DOUBLE) * 0.04::DOUBLE AS seconds FROM events GROUP BY 1")
def motion_document(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(KEY, F.col("event_id").alias("i"), "value")
    d = sinks.motion_document(e, KEY, 25.0, x=F.col("value"))
    return d.select(KEY, F.col("n_frames").cast("long").alias("n_frames"), F.get("frames", F.lit(0))["x"].alias("first_value"), (F.col("n_frames") * 0.04).alias("seconds"))


@query("SELECT o_orderkey, o_orderstatus <> 'P' AND l_orderkey IS NOT NULL AS asset_available FROM orders LEFT JOIN (SELECT DISTINCT l_orderkey FROM lineitem WHERE l_linenumber = 1) ON l_orderkey = o_orderkey")
def assets(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    first = table(spark, sf_dir, "lineitem").where("l_linenumber = 1").select(F.col("l_orderkey").alias("o_orderkey")).distinct()
    files = first.join(o, "o_orderkey").select(F.col("o_orderkey").cast("string").alias("name"), F.when(F.col("o_orderstatus") == "P", 0).otherwise(7).alias("size"))
    return sinks.with_assets(o.select(F.col("o_orderkey").cast("string").alias("k")), files, "k").select(F.col("k").cast("long").alias("o_orderkey"), "asset_available")


@query(f"""WITH {_S}, g AS (SELECT user_id, i, x, i - row_number() OVER (PARTITION BY user_id, x IS NULL ORDER BY i) g FROM s), b AS (SELECT user_id, i, x, row_number() OVER (PARTITION BY user_id, x IS NULL, g ORDER BY i) k FROM g),
l AS (SELECT user_id, i, k, x, max(CASE WHEN x IS NOT NULL THEN i END) OVER (PARTITION BY user_id ORDER BY i) li FROM b) SELECT l.user_id, l.i, CASE WHEN l.x IS NOT NULL THEN l.x WHEN l.k <= 2 THEN s.x END AS y FROM l LEFT JOIN s ON s.user_id = l.user_id AND s.i = l.li""")
def hold_steps(spark, sf_dir):
    """The causal hold, step by step over each key, as the stream does it."""

    def step(state, row):
        state, y = event_log.hold_step(state, row["x"], 2)
        return state, (row["i"], y)

    return series.scan(events(spark, sf_dir).select(KEY, "i", "x"), [KEY], ["i"], "i int, y double", lambda: None, step)


@query("SELECT doc_id, CASE WHEN lang = 'en' THEN 'en' ELSE 'auto' END AS requested, length(text) AS n FROM documents WHERE text IS NOT NULL")
def manifest_on_disk(spark, sf_dir):
    path = scratch(spark, "manifest")
    d = table(spark, sf_dir, "documents").where("text is not null")
    m = d.select("doc_id", F.when(F.col("lang") == "en", "en").otherwise("auto").alias("requested"), F.length("text").alias("n"), F.col("text").alias("source_text"), text.content_id(F.col("text")).alias("source_id"))
    readers.write_manifest(m, path)
    back = spark.read.json(path)
    if "source_text" in back.columns:
        raise RuntimeError("the manifest holds texts")
    return back.select("doc_id", "requested", "n")


@query(f"""WITH {_B} SELECT CAST(user_id AS VARCHAR) AS key, i::BIGINT AS i, CASE WHEN x IS NOT NULL THEN x WHEN li IS NULL AND ni - i <= 8 THEN nx WHEN i - li <= 8 AND ni IS NOT NULL THEN lx + ((lx * (1 - t) + nx * t) - lx) WHEN i - li <= 8 THEN lx END AS y,
CASE WHEN x IS NOT NULL THEN 1.0::DOUBLE WHEN li IS NULL AND ni - i <= 8 THEN 1.0::DOUBLE - (ni - i) / 8.0::DOUBLE WHEN i - li <= 8 AND ni IS NOT NULL THEN 1.0::DOUBLE WHEN i - li <= 8 THEN 1.0::DOUBLE - (i - li) / 8.0::DOUBLE ELSE 0.0::DOUBLE END AS alpha FROM t""")
def streamed_gap_bridge(spark, sf_dir):
    """Every key's frames lie shuffled in several files, which come in three runs of the stream, each from its checkpoint."""
    path = scratch(spark, "bridge")
    e = events(spark, sf_dir)
    last = F.col("i") == F.max("i").over(W.partitionBy(KEY))
    d = e.select(F.col(KEY).cast("string").alias("key"), F.col("i").cast("long").alias("i"), "x", last.alias("last"), F.pmod(F.xxhash64("event_id"), F.lit(3)).alias("part"))
    d.repartition("part").write.partitionBy("part").parquet(f"{path}/all")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    for part in range(3):
        spark.read.schema(_FRAMES).parquet(f"{path}/all/part={part}").write.mode("append").parquet(f"{path}/in")
        stream = spark.readStream.schema(_FRAMES).parquet(f"{path}/in")
        q = ordered.gap_bridge_stream(stream).writeStream.outputMode("append").format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()
        q.awaitTermination()
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    return spark.read.parquet(f"{path}/out")


_FRAMES = "key string, i long, x double, last boolean"
