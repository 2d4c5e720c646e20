"""Snapshots of file hashes: differences, removals, and what to make of a run that did not end."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEY = ["root_path", "file_path"]
# Age at which a dirty mark is stale, share of files that counts as complete (in tenths).
STALE_SECONDS, COMPLETE_TENTHS = 7200, 8


def diff(before: DataFrame, now: DataFrame) -> DataFrame:
    """root_path, file_path, status (added, updated, removed, unchanged). Frames: root_path, file_path, file_hash."""
    a = before.select(*KEY, F.col("file_hash").alias("old_hash"))
    b = now.select(*KEY, F.col("file_hash").alias("new_hash"))
    status = F.when(F.col("old_hash").isNull(), "added").when(F.col("new_hash").isNull(), "removed").when(F.col("old_hash") != F.col("new_hash"), "updated").otherwise("unchanged")
    return a.join(b, KEY, "full_outer").select(*KEY, status.alias("status"))


def removed(before: DataFrame, now: DataFrame) -> DataFrame:
    return before.select(*KEY).join(now.select(*KEY), KEY, "left_anti")


def counters(changes: DataFrame) -> DataFrame:
    """One row: files_added, files_updated, files_removed, files_unchanged."""
    return changes.agg(*(F.count_if(F.col("status") == s).alias(f"files_{s}") for s in ("added", "updated", "removed", "unchanged")))


def without_files(chunks: DataFrame, gone: DataFrame) -> DataFrame:
    """Chunks of files other than those in gone (root_path, file_path): a delete as an anti join."""
    return chunks.join(gone.select(*KEY).distinct(), KEY, "left_anti")


def is_stale(stamp: Column, now: Column, most: int = STALE_SECONDS) -> Column:
    return F.greatest(now - stamp, F.lit(0)) >= most


def dirty_verdict(age: Column, cached_files: Column, indexed_files: Column, chunks: Column, most: int = STALE_SECONDS) -> Column:
    """stale_flag, truly_corrupted or index_appears_complete for a root whose last run did not end."""
    return (
        F.when(age >= most, "stale_flag")
        .when((cached_files > 0) & (chunks == 0), "truly_corrupted")
        .when((cached_files == 0) & (chunks == 0), "stale_flag")
        .when((indexed_files > 0) & (indexed_files >= F.floor(cached_files * COMPLETE_TENTHS / 10)), "index_appears_complete")
        .otherwise("truly_corrupted")
    )
