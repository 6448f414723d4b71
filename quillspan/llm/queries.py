"""The registered queries: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import common, cover_dedup, gif, hamerly, jaccard_join, mixing, oracles, phrase_index, pii, resampling, runs, suffix_dedup, toxicity, url_rules, wrappers


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.load(spark, sf_dir, "documents")
    return toxicity.score(docs, *toxicity.train(docs, common.load(spark, sf_dir, "labels")))


def op2_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.select(common.load(spark, sf_dir, "documents"), common.load(spark, sf_dir, "labels"))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.find(common.load(spark, sf_dir, "documents")))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = common.load(spark, sf_dir, "documents"), common.load(spark, sf_dir, "benchmark")
    return phrase_index.digest(phrase_index.contamination(docs, items))


def op5_html_wrappers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wrappers.extract(common.load(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.near_duplicates(common.load(spark, sf_dir, "documents"))


def op7_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages, labels = common.load(spark, sf_dir, "pages"), common.load(spark, sf_dir, "labels")
    return url_rules.judge(pages, url_rules.mine(url_rules.labelled_pages(pages, labels)))


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.digest(common.load(spark, sf_dir, "documents"))


def op9_gif_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gif.media_digest(common.load(spark, sf_dir, "documents"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(common.load(spark, sf_dir, "documents"))


def op11_cover_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cover_dedup.digest(common.load(spark, sf_dir, "documents"))


def op12_hamerly_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hamerly.digest(common.load(spark, sf_dir, "embeddings"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.digest(common.load(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_toxicity, op2_importance_resampling, op3_pii, op4_decontamination, op5_html_wrappers, op6_jaccard_join, op7_url_rules, op8_suffix_dedup, op9_gif_media, op10_mixing, op11_cover_dedup, op12_hamerly_clusters, op13_periodic_runs)
}
ORACLE_SQL: dict[str, str] = {"op4_decontamination": oracles.OP4, "op6_jaccard_join": oracles.OP6, "op8_suffix_dedup": oracles.OP8, "op11_cover_dedup": oracles.OP11, "op12_hamerly_clusters": oracles.OP12}
