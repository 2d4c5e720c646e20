"""Training-data pipeline: quality rules, near-dedup, suffix dedup, mixing, packing; every stage rereads its predecessor's table.

Edge cases: an empty table gives no rows; extra columns, whatever their names, are carried through all stages but the last;
texts of any length are read whole; of equal texts the one with the smallest id stays.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import mixing, neardup, packing, quality, suffix
from tessera.llm.common import cut
from tessera.session import read_table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no quality rule rejects; null and empty texts are too short and go, repeated rows are judged one by one."""
    return quality.filter_quality(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one with the smallest id, of every group linked by five-word shingles; null ids and texts without words stay."""
    return neardup.deduplicate(docs, width=5, percent=80)


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that start earlier elsewhere; what loses its whole text goes, null texts stay."""
    return suffix.deduplicate(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents drawn by their calibrated probabilities; null source and language are values of their own."""
    return mixing.sample_mix(docs, mixing.TARGETS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the remaining documents, dealt out to sequences; a null text is its end id alone."""
    return packing.pack(docs)


STAGES = [("quality_rules", quality_rules), ("near_dedup", near_dedup), ("suffix_dedup", suffix_dedup), ("mix_sources", mix_sources), ("pack_sequences", pack_sequences)]

#: Tokenisation and sum-of-squares packing aren't SQL; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = cut(docs)
    return docs
