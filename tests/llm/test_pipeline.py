"""The pipeline's stages, each against what its operator says of its own input."""

from pyspark.sql import functions as F

import corpus_pipeline
from quillspan.llm import common, jaccard_join, phrase_index, pii


def test_stages(spark, sf_dir, tmp_path):
    docs = common.load(spark, sf_dir, "documents")
    kept = [docs]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, kept[-1], sf_dir).write.parquet(f"{tmp_path}/{k}")
        kept.append(spark.read.parquet(f"{tmp_path}/{k}"))
        if k < 4:
            assert kept[-1].columns == docs.columns, name
    ids = [{r.doc_id for r in d.select("doc_id").collect()} for d in kept]
    assert all(b <= a for a, b in zip(ids, ids[1:])) and ids[3] == ids[4] == ids[5]
    good = {r.doc_id for r in common.load(spark, sf_dir, "labels").where("quality = 1").select("doc_id").collect()}
    assert len(good & ids[1]) >= 0.97 * len(good & ids[0])
    near = jaccard_join.near_duplicates(kept[1], 5, 80).collect()
    assert ids[2] == {r.doc_id for r in near if r.component_id == r.doc_id or not r.n_shingles}
    dirty = phrase_index.contamination(kept[2], common.load(spark, sf_dir, "benchmark")).where("contaminated")
    assert ids[3] == ids[2] - {r.doc_id for r in dirty.collect()}
    assert pii.digest(pii.find(kept[4])).agg(F.sum("n_email") + F.sum("n_ip") + F.sum("n_card") + F.sum("n_phone")).first()[0] == 0
    assert kept[5].where("taken > 2 * size").count() == 0


def test_run_on_nulls_repeats_and_clashing_columns(spark, sf_dir, tmp_path):
    """run() equals the stages one after the other, each judged by its operator, on awkward rows."""
    text = lambda k: " ".join(f"word{(k * 7 + j * (k % 5 + 1)) % 97}" for j in range(60))
    rows = [(k, text(k), "en", "s" if k % 3 else None, 1) for k in range(12)]
    rows += [(3, text(3), "en", "s", 1), (20, text(4), None, None, None), (None, text(30), "en", "s", 1), (None, None, None, None, None), (21, "", "en", "s", 0), (22, None, "en", "s", 0), (23, "mail bob@example.com now " + text(40), "en", "t", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for c in ("start", "rid", "spans", "__row", "cls", "k"):
        docs = docs.withColumn(c, F.lit("x"))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    for t in ("labels", "benchmark"):
        spark.read.parquet(f"{sf_dir}/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    out = {(r.doc_id, r.size): r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert {i for i, _ in out} == {*range(12), None, 21, 22, 23}  # 20 copies 4; without labels nothing is rejected
    assert len([r for r in out.values() if r.doc_id == 3]) == 1
    assert all(r.taken <= 2 * r.size for r in out.values())
    spark.createDataFrame([], docs.schema).write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_stages_replace_and_keep_columns(spark, sf_dir):
    docs = spark.createDataFrame([(1, "write to bob@example.com or 10.20.30.40", "en", "s", 3, "mine"), (2, None, "en", "s", 0, "mine")], "doc_id long, text string, lang string, source string, n_chars long, spans string")
    got = {r.doc_id: r for r in corpus_pipeline.personal_data(spark, docs, sf_dir).collect()}
    assert got[1].text == "write to <EMAIL> or <IP>" and got[1].n_chars == len(got[1].text) and got[1].spans == "mine" and got[2].text is None
