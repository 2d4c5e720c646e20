"""The registered queries of the ten operators: each applies one to its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import read_table
from . import ann, chat, hmm, mixing, neardup, packing, quality, suffix, toxicity, urls


def op1_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.components(read_table(spark, sf_dir, "documents"), width=2, percent=80)


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = chat.with_probe(read_table(spark, sf_dir, "conversations"), spark)
    return chat.digest(chat.format_conversations(turns))


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.measure(read_table(spark, sf_dir, "documents"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return toxicity.score_documents(docs, toxicity.train(docs, read_table(spark, sf_dir, "labels")))


def op5_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(read_table(spark, sf_dir, "documents"), mixing.TARGETS)
    return mixed.select("doc_id", "source", "lang", F.col("mix_topic").alias("topic"), F.col("mix_tokens").alias("n_tokens"), F.col("mix_probability").alias("probability"), F.col("mix_weight").alias("weight"), F.col("mix_kept").alias("kept"))


def op6_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hmm.score_documents(read_table(spark, sf_dir, "documents"))


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.filter_urls(read_table(spark, sf_dir, "pages"))


def op8_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read_table(spark, sf_dir, "embeddings")
    return ann.nearest(vectors, vectors.where(F.col("vec_id") % 100 == 0))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.measure(read_table(spark, sf_dir, "documents"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read_table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_near_duplicates, op2_chat_format, op3_suffix_dedup, op4_toxicity, op5_mix_sources, op6_lm_score, op7_url_filter, op8_nearest_neighbours, op9_quality_rules, op10_packing)}


def oracle_sql() -> dict[str, str]:
    return {"op1_near_duplicates": neardup.ORACLE, "op2_chat_format": chat.ORACLE, "op3_suffix_dedup": suffix.ORACLE, "op7_url_filter": urls.oracle(), "op9_quality_rules": quality.ORACLE}
