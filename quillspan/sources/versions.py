"""Tables whose contents change in one step: data folders that are written aside, and numbered manifests that name them.

A manifest is put in place by a rename that fails if its number is taken, so a reader sees a version whole or not at all, a
job that is killed while it writes leaves nothing that counts, and of two writers one has to begin again. Folders of
earlier versions stay until vacuum(), so whoever reads one is not disturbed. A batch that has an id counts once, however
often it is retried.
"""

from __future__ import annotations

import json
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession

from .readers import exists, upsert


class Conflict(RuntimeError):
    """Another writer was first; nothing has been changed."""


def _at(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _numbers(spark: SparkSession, path: str) -> list[int]:
    p, fs = _at(spark, f"{path}/_versions")
    if not fs.exists(p):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(p)]
    return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and n[0] != ".")


def manifest(spark: SparkSession, path: str, version: int | None = None) -> dict:
    """version (0 for none yet), folders, batches of the newest or of a stated version."""
    known = _numbers(spark, path)
    if not known and version is None:
        return {"version": 0, "folders": [], "batches": []}
    n = known[-1] if version is None else version
    return json.loads(spark.read.text(f"{path}/_versions/{n:012d}.json", wholetext=True).first().value)


def _commit(spark: SparkSession, path: str, old: dict, folders: list[str], batch: str | None, form: str, mark: str | None = None) -> int:
    jvm = spark.sparkContext._jvm
    n = old["version"] + 1
    new = {"version": n, "folders": folders, "batches": old["batches"] + ([batch] if batch is not None else []), "format": form, "mark": mark}
    aside, fs = _at(spark, f"{path}/_versions/.{uuid.uuid4().hex}")
    target, _ = _at(spark, f"{path}/_versions/{n:012d}.json")
    out = fs.create(aside, False)
    out.write(bytearray(json.dumps(new).encode()))
    out.close()
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark.sparkContext._jsc.hadoopConfiguration())
    none = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
    try:
        context.rename(fs.makeQualified(aside), fs.makeQualified(target), none)
    except Py4JJavaError as e:
        fs.delete(aside, False)
        if "AlreadyExists" in e.java_exception.getClass().getName():
            raise Conflict(f"version {n} of {path} exists") from None
        raise
    return n


def _written(d: DataFrame, path: str, form: str) -> str:
    name = f"data={uuid.uuid4().hex[:16]}"
    d.write.mode("errorifexists").format(form).save(f"{path}/{name}")
    return name


def append(d: DataFrame, path: str, batch: str | None = None, form: str = "parquet") -> bool:
    """The rows of d after those of the newest version; False and no change if the batch is in already."""
    spark = d.sparkSession
    old = manifest(spark, path)
    if batch is not None and batch in old["batches"]:
        return False
    _commit(spark, path, old, [*old["folders"], _written(d, path, form)], batch, form)
    return True


def replace(d: DataFrame, path: str, batch: str | None = None, mark: str | None = None) -> bool:
    """d in place of the newest version; mark says what it was made from, see marked()."""
    spark = d.sparkSession
    old = manifest(spark, path)
    if batch is not None and batch in old["batches"]:
        return False
    _commit(spark, path, old, [_written(d, path, "parquet")], batch, "parquet", mark)
    return True


def marked(spark: SparkSession, path: str) -> str | None:
    return manifest(spark, path).get("mark")


def merge(d: DataFrame, path: str, key: list[str], batch: str | None = None) -> bool:
    """d's rows in place of those of the same key; False and no change if the batch is in already."""
    spark = d.sparkSession
    if batch is not None and batch in manifest(spark, path)["batches"]:
        return False
    return replace(upsert(read(spark, path), d, key) if manifest(spark, path)["folders"] else d, path, batch)


def read(spark: SparkSession, path: str, version: int | None = None) -> DataFrame | None:
    """The newest or a stated version; None before the first one."""
    m = manifest(spark, path, version)
    return spark.read.format(m["format"]).load([f"{path}/{f}" for f in m["folders"]]) if m["folders"] else None


def vacuum(spark: SparkSession, path: str, keep: int = 2) -> int:
    """Delete the folders that none of the newest `keep` versions name, and the older manifests; how many folders went."""
    known = _numbers(spark, path)
    held = {f for n in known[-keep:] for f in manifest(spark, path, n)["folders"]}
    root, fs = _at(spark, path)
    gone = [s.getPath() for s in fs.listStatus(root) if s.getPath().getName().startswith("data=") and s.getPath().getName() not in held] if exists(spark, path) else []
    for p in gone:
        fs.delete(p, True)
    for n in known[:-keep]:
        fs.delete(_at(spark, f"{path}/_versions/{n:012d}.json")[0], False)
    return len(gone)
