"""Sources and sinks: whole texts, ordered catalogs, logs, keyed caches, listings. Missing optional inputs read as empty."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from ..functions import text

CATALOG = "id string, word_en string, word_ar string, category string, item_path string, item_url string, video_url string, vimeo_id string, thumb_path string, has_video boolean"
SUPPLEMENTARY = "supplementary_id string, english_meaning string, arabic_text string, youtube_video_id string, source_url string, segment_start_s double, segment_end_s double, content_type string, verification_status string"


def exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return bool(p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p))


def read_texts(spark: SparkSession, path: str, language: str = "auto") -> DataFrame:
    """One manifest row per .md or .txt file: id, path, language, mode, text and load time."""
    if language not in ("auto", "en", "ar"):
        raise ValueError(f"language must be auto, en or ar, not {language!r}")
    d = spark.read.text(path, wholetext=True).select(F.col("value").alias("source_text"), F.input_file_name().alias("source_path"))
    d = d.where(F.lower("source_path").rlike(r"\.(md|txt)$"))
    lang = text.detect_language(F.col("source_text")) if language == "auto" else F.lit(language)
    return d.select(text.content_id(F.col("source_text")).alias("source_id"), "source_path", lang.alias("source_language"), text.language_mode(F.lit(language)).alias("source_language_mode"), "source_text", F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("loaded_at"))


def write_manifest(manifest: DataFrame, path: str) -> None:
    manifest.drop("source_text").write.mode("overwrite").json(path)


def read_catalog(spark: SparkSession, path: str, schema: str = CATALOG) -> DataFrame:
    """A JSON array of rows with their position as ord; an absent file reads as no rows."""
    fields = T.StructType.fromDDL(schema)
    if not exists(spark, path):
        return spark.createDataFrame([], fields).withColumn("ord", F.lit(0))
    whole = spark.read.text(path, wholetext=True).select(F.from_json("value", T.ArrayType(fields)).alias("rows"))
    return whole.select(F.posexplode("rows").alias("ord", "r")).select("ord", "r.*")


def read_aliases(spark: SparkSession, path: str, catalog: DataFrame) -> DataFrame:
    """ord, catalog_id, alias in file order; aliases of unknown rows are left out."""
    d = read_catalog(spark, path, "catalog_id string, aliases_en array<string>, aliases_ar array<string>")
    d = d.select("ord", "catalog_id", F.posexplode(F.concat(F.coalesce("aliases_en", F.array()), F.coalesce("aliases_ar", F.array()))).alias("p", "alias"))
    return d.join(catalog.select(F.col("id").alias("catalog_id")), "catalog_id", "left_semi").select((F.col("ord") * 1000 + F.col("p")).alias("ord"), "catalog_id", "alias")


def read_alphabet(entries: DataFrame) -> DataFrame:
    """One row per letter; of repeated letters the later one counts."""
    return entries.groupBy("letter").agg(F.max_by(F.struct("name_ar", "word_en", "catalog_id"), "ord").alias("e")).select("letter", "e.*")


def read_documents(spark: SparkSession, pattern: str, schema: str) -> DataFrame:
    """Many JSON files, one object each, with their names; order by name."""
    return spark.read.schema(schema).json(pattern, multiLine=True).withColumn("file", F.substring_index(F.input_file_name(), "/", -1))


def read_log_json(spark: SparkSession, path: str, marker: str, schema: str) -> DataFrame:
    """The JSON object after the last marker of each log; null where there is none."""
    from ..functions.parsing import after_marker

    d = spark.read.text(path, wholetext=True).withColumn("file", F.input_file_name())
    return d.select("file", after_marker(F.col("value"), marker, schema).alias("result"))


def resume(todo: DataFrame, done: DataFrame, key: list[str]) -> DataFrame:
    return todo.join(done.select(*key).distinct(), key, "left_anti")


def append_answers(spark: SparkSession, todo: DataFrame, path: str, key: list[str], answer) -> int:
    """Answer what the table of answers does not hold yet, and append it in one step; how many rows were new.

    A job that ends before that step leaves nothing behind, so when it is retried every key is answered once.
    """
    from . import versions

    done = versions.read(spark, path)
    rest = todo if done is None else resume(todo, done, key)
    seen = Observation()
    versions.append(answer(rest.observe(seen, F.count(F.lit(1)).alias("n"))), path, form="json")
    return seen.get["n"]


def answers(spark: SparkSession, path: str) -> DataFrame | None:
    from . import versions

    return versions.read(spark, path)


def score_stream(stream: DataFrame, path: str, key: list[str], answer, checkpoint: str):
    """A running query that answers each key of a stream once: a batch that is run again, or a key that comes again, changes nothing."""
    from . import versions

    def put(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        done = versions.read(spark, path)
        fresh = batch.dropDuplicates(key)
        versions.append(answer(fresh if done is None else resume(fresh, done, key)), path, batch=f"stream-{number}", form="json")

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def upsert(cache: DataFrame, fresh: DataFrame, key: list[str]) -> DataFrame:
    """fresh rows replace cached ones of the same key."""
    return cache.join(fresh.select(*key), key, "left_anti").select(*cache.columns).unionByName(fresh, allowMissingColumns=True)


def cached_if_same(spark: SparkSession, source: DataFrame, key: str, path: str, compute) -> DataFrame:
    """The stored table if it was made for the same set of keys, else a new version of it, which replaces the old one in one
    step and leaves its files to those who read them. Only a fingerprint of the keys is compared."""
    from . import versions

    r = source.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.expr(f"bit_xor(xxhash64(`{key}`))"), F.lit(0)).alias("x")).first()
    mark = f"{r.n}:{r.x}"
    if versions.marked(spark, path) != mark:
        versions.replace(compute(source), path, mark=mark)
    return versions.read(spark, path)


def of_video(corpus: DataFrame, video: str, ident: str = "video_id", order: str = "item_index") -> DataFrame:
    """The items of one video in their order."""
    return corpus.where(F.col(ident) == video).orderBy(order)


def listing(spark: SparkSession, path: str, allowed: list[str]) -> DataFrame:
    """name, size of the allowed files of a folder, by name."""
    d = spark.read.format("binaryFile").load(path).select(F.substring_index("path", "/", -1).alias("name"), F.col("length").alias("size"))
    return d.where(F.col("name").isin(allowed)).orderBy("name")


def summary(parts: dict[str, DataFrame | None]) -> DataFrame:
    """Unlike artifacts in one table with an available flag; an absent one gives a row of nulls."""
    spark = next(d for d in parts.values() if d is not None).sparkSession
    out = None
    for name, d in parts.items():
        one = spark.createDataFrame([(name, False)], "artifact string, available boolean") if d is None else d.select(F.lit(name).alias("artifact"), F.lit(True).alias("available"), "*")
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    return out


class PagedSource(DataSource):
    """spark.read.format("paged") and spark.readStream.format("paged"): rows of a paged listing, one partition per page of
    options total and page.

    fetch(offset, limit) is a module-level function named by the options module and function; it returns tuples
    (id, text), and gets the option argument as a third value where there is one. The last row of an id wins, see
    last_per_id(). As a stream, the place after the last row read is what a checkpoint keeps; a stream that is stopped goes
    on from there, up to the total stated then, and reads a batch again that it had planned but not finished.
    """

    @classmethod
    def name(cls) -> str:
        return "paged"

    def schema(self) -> str:
        return "offset long, pos int, id string, text string"

    def reader(self, schema) -> DataSourceReader:
        return _PagedReader(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _PagedStream(self.options)


class _Pages:
    def __init__(self, options):
        self.total, self.page = int(options["total"]), int(options.get("page", "20"))
        self.module, self.function, self.argument = options["module"], options["function"], options.get("argument")

    def read(self, partition):
        import importlib

        fetch = getattr(importlib.import_module(self.module), self.function)
        more = () if self.argument is None else (self.argument,)
        limit = min(self.page, self.total - partition.value)
        for k, (i, t) in enumerate(fetch(partition.value, limit, *more)):
            yield partition.value, k, i, t


class _PagedReader(_Pages, DataSourceReader):
    def partitions(self):
        return [InputPartition(o) for o in range(0, self.total, self.page)]


class _PagedStream(_Pages, DataSourceStreamReader):
    def initialOffset(self) -> dict:
        return {"offset": 0}

    def latestOffset(self) -> dict:
        return {"offset": self.total}

    def partitions(self, start: dict, end: dict):
        return [InputPartition(o) for o in range(start["offset"], end["offset"], self.page)]

    def commit(self, end: dict) -> None:
        """Nothing to give back: a page can be asked for again."""


def last_per_id(rows: DataFrame) -> DataFrame:
    """id, text of the last row, and ord, the place (offset, pos) at which the id was first seen."""
    at = F.struct("offset", "pos")
    return rows.groupBy("id").agg(F.max_by("text", at).alias("text"), F.min(at).alias("ord"))
