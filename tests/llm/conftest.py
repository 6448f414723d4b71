import pandas as pd
import pytest


@pytest.fixture(scope="session")
def make(spark, tmp_path_factory):
    """rows -> a DataFrame read from Parquet files, with an extra column whose name clashes with names used inside."""

    def build(schema: str, rows: list[tuple], extra: bool = True, parts: int = 3):
        df = spark.createDataFrame(rows, schema)
        if extra:
            from pyspark.sql import functions as F

            df = df.withColumn("spans", F.lit("clash")).withColumn("start", F.lit(7)).withColumn("n", F.lit(None).cast("string"))
        path = str(tmp_path_factory.mktemp("t"))
        df.repartition(parts).write.mode("overwrite").parquet(path)
        return spark.read.parquet(path)

    return build


DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs_of(texts: list, sources=None, langs=None) -> list[tuple]:
    return [(i, t, (langs or ["en"] * len(texts))[i], (sources or ["s"] * len(texts))[i], len(t or "")) for i, t in enumerate(texts)]


def frame(df) -> pd.DataFrame:
    return df.toPandas()
