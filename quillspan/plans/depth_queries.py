"""Sources, streams and layers on whole tables: crawls, versions, jobs, file listings, head pose, expected hands, names in Arabic letters."""

from __future__ import annotations



import pandas as pd
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text
from ..functions.text import rounded
from ..operators import head_pose as hp
from ..operators import landmarks
from ..operators import resolve as r
from ..operators.series import global_number
from ..sources import readers, sinks, versions
from ..streaming import event_log, ordered
from .base import query, sql_values, table
from .landmark_queries import _hand
from .series_queries import _B, KEY
from .store_queries import ROCKS, scratch

# -- a listing crawled page by page -----------------------------------------------------------------


def fetch_pages(offset: int, limit: int, path: str) -> list[tuple[str, str]]:
    """One page of the listing: (host, url) of the rows from offset on."""
    import pyarrow.parquet as pq

    t = pq.read_table(path, columns=["page_id", "url"], filters=[("page_id", ">=", offset), ("page_id", "<", offset + limit)]).sort_by("page_id")
    return [(u.split("/")[2], u) for u in t.column("url").to_pylist()]


def _crawl(how, sf_dir, total):
    return how.format("paged").option("total", str(total)).option("page", "20").option("module", __name__).option("function", "fetch_pages").option("argument", f"{sf_dir}/pages.parquet").load()


_LAST = "SELECT split_part(url, '/', 3) AS id, arg_max(url, page_id) AS text, min(page_id) AS first_row FROM pages GROUP BY 1"


def _per_host(d):
    return readers.last_per_id(d).select("id", "text", (F.col("ord.offset") + F.col("ord.pos")).alias("first_row"))


@query(_LAST)
def crawled_hosts(spark, sf_dir):
    spark.dataSource.register(readers.PagedSource)
    return _per_host(_crawl(spark.read, sf_dir, table(spark, sf_dir, "pages").count()))


@query(_LAST)
def crawled_hosts_resumed(spark, sf_dir):
    """The crawl as a stream that is stopped half-way and goes on from its checkpoint."""
    spark.dataSource.register(readers.PagedSource)
    path, n = scratch(spark, "crawl"), table(spark, sf_dir, "pages").count()
    for total in (n // 2, n):
        q = _crawl(spark.readStream, sf_dir, total).writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/checkpoint").start()
        q.processAllAvailable()
        q.stop()
    return _per_host(spark.read.parquet(f"{path}/out"))


# -- versions ---------------------------------------------------------------------------------------


@query("SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN -o_totalprice ELSE o_totalprice END AS v FROM orders")
def merged_versions(spark, sf_dir):
    """Orders appended in two batches, one of them retried, and those of one status replaced by a merge that is retried, too."""
    path = scratch(spark, "versions")
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_totalprice").alias("v"), "o_orderstatus")
    half = F.col("o_orderkey") % 2 == 0
    for batch, d in (("even", o.where(half)), ("odd", o.where(~half)), ("odd", o.where(~half))):
        versions.append(d, path, batch)
    for _ in range(2):
        versions.merge(o.where("o_orderstatus = 'F'").withColumn("v", -F.col("v")), path, ["o_orderkey"], "paid")
    return versions.read(spark, path).select("o_orderkey", "v")


@query("SELECT conv_id, turn, length(text) AS answer FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY role, text) n FROM conversations) WHERE n = 1")
def scored_stream(spark, sf_dir):
    """Turns that come as files are scored once each, though the stream reads them twice."""
    path = scratch(spark, "scores")
    c = table(spark, sf_dir, "conversations").withColumn("n", F.row_number().over(W.partitionBy("conv_id", "turn").orderBy("role", "text"))).where("n = 1").drop("n")
    c.repartition(3).write.parquet(f"{path}/in")
    for run in range(2):
        stream = spark.readStream.schema(c.schema).parquet(f"{path}/in")
        readers.score_stream(stream, f"{path}/answers", ["conv_id", "turn"], lambda d: d.select("conv_id", "turn", F.length("text").alias("answer")), f"{path}/checkpoint{run}").awaitTermination()
    return readers.answers(spark, f"{path}/answers").select("conv_id", "turn", F.col("answer").cast("long").alias("answer"))


# -- jobs -------------------------------------------------------------------------------------------

_STAGES = "SELECT s_suppkey job, CASE WHEN s_suppkey % 7 = 0 THEN [('LOAD', 'started'), ('LOAD', 'done'), ('CHECK', 'started'), ('CHECK', 'blocked')] WHEN s_suppkey % 5 = 0 THEN [('LOAD', 'started'), ('LOAD', 'done'), ('CHECK', 'started'), ('CHECK', 'done'), ('RENDER', 'started'), ('RENDER', 'error')] ELSE [('LOAD', 'started'), ('LOAD', 'done'), ('CHECK', 'started'), ('CHECK', 'done'), ('RENDER', 'started'), ('RENDER', 'done'), ('DONE', 'done')] END e FROM supplier"


def _job(k: int) -> list[dict]:
    def check(results):
        if results["LOAD"] % 7 == 0:
            raise event_log.Blocked("every seventh")

    def render(results):
        return 1 // (results["LOAD"] % 5 > 0)

    return list(event_log.run_stages(f"j{k}", [("LOAD", lambda _: k), ("CHECK", check), ("RENDER", render)], lambda: 0.0))


def _jobs(spark, sf_dir):
    def run(it):
        for pdf in it:
            rows = [e for k in pdf["s_suppkey"] for e in _job(int(k))]
            yield pd.DataFrame(rows, columns=["job_id", "seq", "stage", "status", "message", "ts", "elapsed_s"])

    return table(spark, sf_dir, "supplier").select("s_suppkey").mapInPandas(run, event_log.EVENTS)


@query(f"SELECT 'j' || job AS job_id, unnest(range(0, len(e))) AS seq, unnest(e)[1] AS stage, unnest(e)[2] AS status FROM ({_STAGES})")
def job_events(spark, sf_dir):
    return _jobs(spark, sf_dir).select("job_id", "seq", "stage", "status")


@query(f"SELECT 'j' || job AS job_id, CASE WHEN job % 7 = 0 THEN 'blocked' WHEN job % 5 = 0 THEN 'error' ELSE 'done' END AS job_status, len(e) AS n_events, job % 3 = 0 AS has_output FROM ({_STAGES}) UNION ALL SELECT 'n' || n_nationkey, 'done', 0, true FROM nation")
def recovered_jobs(spark, sf_dir):
    """Jobs as they are found again from their event files and their outputs, some of which left no events."""
    path = scratch(spark, "events")
    event_log.append(_jobs(spark, sf_dir), path)
    out = table(spark, sf_dir, "supplier").where("s_suppkey % 3 = 0").select(F.concat(F.lit("j"), F.col("s_suppkey").cast("string")).alias("job_id"))
    lone = table(spark, sf_dir, "nation").select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("job_id"))
    return sinks.recover_jobs(spark, path, out.unionByName(lone))


# -- files and order --------------------------------------------------------------------------------


def _named(spark, d, path: str, name: str, value: str) -> None:
    """Each row as a text file of its own name: Spark writes a folder a name, its one part is moved up."""
    d.select(name, value).repartition(name).write.partitionBy(name).text(f"{path}/parts")
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(f"{path}/parts")
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(jvm.org.apache.hadoop.fs.Path(f"{path}/files"))
    for folder in fs.globStatus(jvm.org.apache.hadoop.fs.Path(f"{path}/parts/{name}=*/part-*")):
        at = folder.getPath()
        fs.rename(at, jvm.org.apache.hadoop.fs.Path(f"{path}/files/{at.getParent().getName().split('=', 1)[1]}"))


@query("SELECT 'n' || n_nationkey || '.txt' AS name, length(n_name) + 1 AS size FROM nation")
def listed_names(spark, sf_dir):
    """All nations' files through the listing, which leaves out what it does not allow."""
    path = scratch(spark, "listing")
    n = table(spark, sf_dir, "nation").select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string"), F.lit(".txt")).alias("file"), F.col("n_name").alias("value"))
    other = table(spark, sf_dir, "region").select(F.concat(F.lit("r"), F.col("r_regionkey").cast("string"), F.lit(".tmp")).alias("file"), F.col("r_name").alias("value"))
    _named(spark, n.unionByName(other), path, "file", "value")
    allowed = [x.file for x in n.select("file").collect()]  # a list of names, as its callers have it
    return readers.listing(spark, f"{path}/files", allowed).select("name", F.col("size").cast("long").alias("size"))


@query("SELECT 'doc_' || lpad(CAST(n_nationkey AS VARCHAR), 3, '0') || '.json' AS file, row_number() OVER (ORDER BY n_nationkey) - 1 AS place, n_name AS name, n_regionkey AS region FROM nation")
def documents_in_files(spark, sf_dir):
    path = scratch(spark, "documents")
    name = F.concat(F.lit("doc_"), F.lpad(F.col("n_nationkey").cast("string"), 3, "0"), F.lit(".json"))
    d = table(spark, sf_dir, "nation").select(name.alias("file"), F.to_json(F.struct(F.col("n_name").alias("name"), F.col("n_regionkey").alias("region"))).alias("value"))
    _named(spark, d, path, "file", "value")
    found = readers.read_documents(spark, f"{path}/files/doc_*.json", "name string, region int")
    return global_number(found, "file", name="place").select("file", "place", "name", "region")


@query("WITH m AS (SELECT conv_id FROM conversations GROUP BY 1 ORDER BY count(*) DESC, conv_id LIMIT 1) SELECT conv_id, turn, role, row_number() OVER (ORDER BY turn) - 1 AS place FROM conversations JOIN m USING (conv_id)")
def items_of_video(spark, sf_dir):
    """The turns of the longest conversation in order, as the items of one video."""
    c = table(spark, sf_dir, "conversations")
    longest = c.groupBy("conv_id").count().orderBy(F.desc("count"), "conv_id").first()["conv_id"]
    d = readers.of_video(c, longest, "conv_id", "turn")
    return d.select("conv_id", "turn", "role", (F.row_number().over(W.partitionBy("conv_id").orderBy("turn")) - 1).cast("long").alias("place"))


# -- faces and hands --------------------------------------------------------------------------------

_TURN = {"pitch": (1, 100.0), "yaw": (2, 100.0), "roll": (3, 150.0)}


@query("SELECT vec_id, " + ", ".join(f"floor(embedding[{i}]::DOUBLE * {f} * 100 + 0.5::DOUBLE) / 100 AS {n}" for n, (i, f) in _TURN.items()) + ", true AS ok FROM embeddings")
def head_pose(spark, sf_dir):
    """Faces turned by angles from the embeddings, projected, and solved for their angles again."""
    e = lambda i: F.get("embedding", F.lit(i - 1)).cast("double")
    p, y, z = (F.radians(e(i) * f) for i, f in _TURN.values())
    shift = (e(4) * 80, e(5) * 80, 600 + 300 * e(6))
    w, h = F.lit(1280), F.lit(720)

    def seen(x0, y0, z0):
        y1, z1 = y0 * F.cos(p) - z0 * F.sin(p), y0 * F.sin(p) + z0 * F.cos(p)
        x2, z2 = x0 * F.cos(y) + z1 * F.sin(y), z1 * F.cos(y) - x0 * F.sin(y)
        x3, y3, z3 = x2 * F.cos(z) - y1 * F.sin(z) + shift[0], x2 * F.sin(z) + y1 * F.cos(z) + shift[1], z2 + shift[2]
        return F.struct((x3 / z3 + 0.5).alias("x"), ((y3 / z3 * w + h / 2) / h).alias("y"))

    d = table(spark, sf_dir, "embeddings").select("vec_id", F.array(*[seen(*map(F.lit, m)) for m in hp.MODEL.tolist()]).alias("face"), w.alias("w"), h.alias("h"))
    found = hp.head_pose(d, "vec_id", "face", "w", "h")
    return found.select("vec_id", *[rounded(F.col(f"{n}_deg"), 2).alias(n) for n in _TURN], F.col("solve_ok").alias("ok"))


@query("""WITH f AS (SELECT label, vec_id % 3 = 0 lost, CASE WHEN vec_id % 7 = 0 THEN 1.0 ELSE embedding[4]::DOUBLE * 2 + 0.6::DOUBLE END v, embedding[1]::DOUBLE * 3 + 0.5::DOUBLE x, embedding[2]::DOUBLE + 0.5::DOUBLE y FROM embeddings),
g AS (SELECT *, v > 0.5 AND x BETWEEN 0 AND 1 AND y BETWEEN 0 AND 1 should FROM f) SELECT label, count(*) AS frames, count(*) FILTER (WHERE NOT lost) AS detected, count(*) FILTER (WHERE should) AS expected, count(*) FILTER (WHERE should AND NOT lost) AS detected_expected,
CASE WHEN count(*) FILTER (WHERE should) > 0 THEN floor(100.0::DOUBLE * count(*) FILTER (WHERE should AND NOT lost) / count(*) FILTER (WHERE should) * 1e6 + 0.5::DOUBLE) / 1e6 END AS pct_expected FROM g GROUP BY 1""")
def expected_hands(spark, sf_dir):
    """Landmark frames with a visibility for each point; how often a hand is there when its wrist says it should be."""
    e = lambda i: F.get("embedding", F.lit(i - 1)).cast("double")
    point = F.struct((e(1) * 3 + 0.5).alias("x"), (e(2) + 0.5).alias("y"), e(3).alias("z"), F.when(F.col("vec_id") % 7 != 0, e(4) * 2 + 0.6).alias("visibility"))
    d = table(spark, sf_dir, "embeddings").select("label", (F.row_number().over(W.partitionBy("label").orderBy("vec_id")) - 1).alias("i"), F.array(point).alias("pose"), F.when(F.col("vec_id") % 3 != 0, F.array(point)).alias("hand"))
    f = landmarks.landmark_frames(d, "label", 25.0, "pose", "hand")
    g = landmarks.detection_when_expected(f, "label", F.get("pose", F.lit(0)), F.col("hand"))
    return g.withColumn("pct_expected", rounded(F.col("pct_expected")))


# -- names in Arabic letters ------------------------------------------------------------------------

_LATIN, _ARABIC = "abcdefghijklmnopqrstuvwxyz", "ابتثجحخدذرزسشصضطظعغفقكلمنه"
_AR = f"translate(lower(p_name), '{_LATIN}', '{_ARABIC}')"


def _arabic():
    return F.translate(F.lower("p_name"), _LATIN, _ARABIC)


def _catalog(spark, sf_dir):
    """Every distinct name, in English and Arabic letters."""
    w = table(spark, sf_dir, "part").select("p_name").distinct()
    d = global_number(w, "p_name", name="ord").withColumn("ord", F.col("ord").cast("int"))
    return d.select("ord", F.concat(F.lit("c"), F.col("ord").cast("string")).alias("id"), F.col("p_name").alias("word_en"), _arabic().alias("word_ar"), F.lit("x").alias("category"), F.lit(True).alias("has_video"))


_NAMES = f"cat AS (SELECT CAST(row_number() OVER (ORDER BY p_name) - 1 AS INT) ord, 'c' || (row_number() OVER (ORDER BY p_name) - 1) id, p_name, {_AR} ar FROM (SELECT DISTINCT p_name FROM part))"


@query(f"WITH w AS (SELECT p_partkey, replace({_AR}, ' ', '') w FROM part), l AS (SELECT p_partkey, unnest(range(0, length(w))) pos, w FROM w) SELECT p_partkey, CAST(pos AS INT) AS pos, substr(w, pos + 1, 1) AS letter, position(substr(w, pos + 1, 1) IN '{_ARABIC[:20]}') > 0 AS resolved FROM l")
def spelled_names(spark, sf_dir):
    known = spark.createDataFrame([(c,) for c in _ARABIC[:20]], "letter string").withColumn("known", F.lit(True))
    d = table(spark, sf_dir, "part").select("p_partkey", F.posexplode(text.letters(_arabic())).alias("pos", "letter"))
    return d.join(F.broadcast(known), "letter", "left").select("p_partkey", "pos", "letter", F.coalesce("known", F.lit(False)).alias("resolved"))


@query(f"WITH {_NAMES}, it AS (SELECT DISTINCT CASE p_partkey % 3 WHEN 0 THEN 'AKA ' || p_name WHEN 1 THEN 'dit ' || {_AR} ELSE p_name || '?' END item, p_name, p_partkey % 3 k FROM part) SELECT item, id FROM it JOIN cat USING (p_name) WHERE k < 2")
def aliased_names(spark, sf_dir):
    """Every name has an English and an Arabic alias; items by either find it, others do not."""
    c = _catalog(spark, sf_dir)
    alias = lambda w, by, n: c.select((F.col("ord") * 2 + n).alias("ord"), F.col("id").alias("catalog_id"), F.concat(F.lit(by), w).alias("alias"))
    k = F.col("p_partkey") % 3
    items = table(spark, sf_dir, "part").select(F.when(k == 0, F.concat(F.lit("AKA "), "p_name")).when(k == 1, F.concat(F.lit("dit "), _arabic())).otherwise(F.concat("p_name", F.lit("?"))).alias("item")).distinct()
    d = r.alias(items, c, alias(F.col("word_en"), "aka ", 0).unionByName(alias(F.col("word_ar"), "dit ", 1)))
    return d.select("item", F.col("alias.id").alias("id"))


@query(f"""WITH {_NAMES}, h AS (SELECT DISTINCT CASE p_partkey % 3 WHEN 0 THEN 'و' || {_AR} WHEN 1 THEN 'ال' || {_AR} ELSE {_AR} END item FROM part), p AS (SELECT * FROM ({sql_values(list(enumerate(text.CLITICS)))}) p(o, c)),
f AS (SELECT item, o, substr(item, length(c) + 1) form FROM h, p WHERE starts_with(item, c) AND length(item) - length(c) >= 2) SELECT item, arg_min(form, o) AS form, arg_min(id, o) AS id FROM f JOIN cat ON ar = form GROUP BY item""")
def clitic_names(spark, sf_dir):
    k = F.col("p_partkey") % 3
    items = table(spark, sf_dir, "part").select(F.concat(F.when(k == 0, "و").when(k == 1, "ال").otherwise(""), _arabic()).alias("item")).distinct()
    return r.clitic(items, _catalog(spark, sf_dir)).select("item", F.col("clitic.form").alias("form"), F.col("clitic.row.id").alias("id"))




# -- hands on a stream, readers of the log ----------------------------------------------------------

_HAND = f"""WITH {_B}, k AS (SELECT *, CASE WHEN x IS NOT NULL THEN 'real' WHEN li IS NULL AND ni - i <= 8 THEN 'first' WHEN i - li <= 8 AND ni IS NOT NULL THEN 'moved' WHEN i - li <= 8 THEN 'held' ELSE 'none' END k FROM t),
q AS (SELECT *, CASE k WHEN 'real' THEN x WHEN 'first' THEN nx WHEN 'none' THEN NULL ELSE lx END s, CASE WHEN k = 'moved' THEN (lx * (1 - t) + nx * t) - lx ELSE 0 END dx, CASE WHEN k = 'moved' THEN (lx / 2 * (1 - t) + nx / 2 * t) - lx / 2 ELSE 0 END dy FROM k)
SELECT CAST(user_id AS VARCHAR) AS key, i::BIGINT AS i, floor((s + dx) * 1e6 + 0.5::DOUBLE) / 1e6 AS wrist_x, floor((s / 2 + 9 * sin(s / 7) + dy) * 1e6 + 0.5::DOUBLE) / 1e6 AS base_y,
CASE k WHEN 'first' THEN 1.0::DOUBLE - (ni - i) / 8.0::DOUBLE WHEN 'held' THEN 1.0::DOUBLE - (i - li) / 8.0::DOUBLE WHEN 'none' THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS alpha FROM q"""


@query(_HAND)
def hand_bridge(spark, sf_dir):
    d = landmarks.hand_bridge(_hand(spark, sf_dir), key=KEY)
    at = lambda k, c: rounded(F.get("hand", F.lit(k))[c])
    return d.select(F.col(KEY).cast("string").alias("key"), F.col("i").cast("long").alias("i"), at(0, "x").alias("wrist_x"), at(9, "y").alias("base_y"), "alpha")


@query(_HAND)
def streamed_hand_bridge(spark, sf_dir):
    """The hands come in no order, in two runs of a stream that holds what it needs of each key."""
    path = scratch(spark, "hands")
    last = F.col("i") == F.max("i").over(W.partitionBy(KEY))
    flat = F.flatten(F.transform("hand", lambda p: F.array(p["x"], p["y"])))
    d = _hand(spark, sf_dir).select(F.col(KEY).cast("string").alias("key"), F.col("i").cast("long").alias("i"), flat.alias("x"), last.alias("last"), F.pmod(F.xxhash64(KEY, "i"), F.lit(2)).alias("part"))
    d.repartition(4, "part", "i").write.partitionBy("part").parquet(f"{path}/all")
    schema = "key string, i long, x array<double>, last boolean"
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    for part in range(2):
        spark.read.schema(schema).parquet(f"{path}/all/part={part}").write.mode("append").parquet(f"{path}/in")
        stream = spark.readStream.schema(schema).parquet(f"{path}/in")
        ordered.hand_bridge_stream(stream).writeStream.outputMode("append").format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    out = spark.read.parquet(f"{path}/out")
    return out.select("key", "i", rounded(F.get("hand", F.lit(0))).alias("wrist_x"), rounded(F.get("hand", F.lit(19))).alias("base_y"), "alpha")


@query(f"SELECT 'j' || job AS job_id, unnest(range(0, len(e))) AS seq, CASE WHEN unnest(range(0, len(e))) < job % 4 THEN 1 ELSE 2 END AS poll FROM ({_STAGES})")
def polled_events(spark, sf_dir):
    """A reader of the log who comes twice: first when each job has written some events, then when all are there."""
    e = _jobs(spark, sf_dir).select("job_id", "seq", "stage", "status")
    some = e.where(F.col("seq") < F.pmod(F.substring("job_id", 2, 20).cast("long"), F.lit(4)))
    one, cursors = event_log.since(some, e.select("job_id", "seq").limit(0))
    two, _ = event_log.since(e, cursors)
    return one.withColumn("poll", F.lit(1)).unionByName(two.withColumn("poll", F.lit(2))).select("job_id", "seq", "poll")
