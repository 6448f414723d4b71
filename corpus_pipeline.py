"""Corpus pipeline: five of the corpus operators in sequence over the documents table.

Every stage gets what its predecessor kept, written as Parquet and read again, and its decisions take effect: rejected,
near-duplicate and contaminated documents go, personal data is replaced, and the last stage says how many words of each
remaining document the mix takes. All but the last return the columns of documents.
"""

from __future__ import annotations

import contextvars
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspan.llm import common, jaccard_join, mixing, phrase_index, pii, resampling

#: Weighing, sampling and redaction have no SQL form; tests compare the stages with brute force instead.
ORACLE_SQL = None

#: Whose stored tables a stage deletes when it begins: those of the stage before it, whose result has been written by then.
#: Each run has an owner of its own, so that runs in one session leave each other's tables alone.
OWNER = contextvars.ContextVar("owner", default="pipeline")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    common.release(spark, OWNER.get())
    return resampling.keep(common.packed(docs), common.load(spark, sf_dir, "labels"), owner=OWNER.get())


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    common.release(spark, OWNER.get())
    return jaccard_join.drop_near_duplicates(common.packed(docs), owner=OWNER.get())


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    common.release(spark, OWNER.get())
    return phrase_index.drop_contaminated(common.packed(docs), common.load(spark, sf_dir, "benchmark"), owner=OWNER.get())


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    common.release(spark, OWNER.get())
    return pii.redact(common.packed(docs), owner=OWNER.get()).withColumn("n_chars", F.length("text").cast("long"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    common.release(spark, OWNER.get())
    return mixing.mix(common.packed(docs), owner=OWNER.get())


STAGES = [("quality", quality), ("near duplicates", near_duplicates), ("decontamination", decontamination), ("personal data", personal_data), ("mixing", mix)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.load(spark, sf_dir, "documents")
    name = uuid.uuid4().hex[:12]
    base = f"{common.shared_dir(spark)}/quillspan-pipeline/{name}"
    mine = OWNER.set(f"pipeline-{name}")
    try:
        for k, (_, stage) in enumerate(STAGES):
            stage(spark, docs, sf_dir).write.parquet(f"{base}/{k}")
            docs = spark.read.parquet(f"{base}/{k}")
            if k:
                common.delete(spark, f"{base}/{k - 1}")
        return docs
    finally:
        common.release(spark, OWNER.get())
        OWNER.reset(mine)
