"""Counts over stored chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def by_language(chunks: DataFrame) -> DataFrame:
    """language, chunks, files: most chunks first."""
    files = F.count_distinct("root_path", "file_path")
    return chunks.groupBy(F.coalesce("language", F.lit("Unknown")).alias("language")).agg(F.count("*").alias("chunks"), files.alias("files")).orderBy(F.desc("chunks"), "language")


def totals(chunks: DataFrame) -> DataFrame:
    return chunks.agg(F.count("*").alias("total_chunks"), F.count_distinct("root_path", "file_path").alias("total_files"), F.count_distinct("root_path").alias("total_roots"))


def by_root(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy("root_path").agg(F.count("*").alias("chunks"))


def files_of(chunks: DataFrame, root: str) -> DataFrame:
    return chunks.where(F.col("root_path") == root).select("file_path").distinct()


def rollup(chunks: DataFrame) -> DataFrame:
    """Chunks by root and language with subtotals; null stands for all."""
    return chunks.rollup("root_path", "language").agg(F.count("*").alias("chunks"))
