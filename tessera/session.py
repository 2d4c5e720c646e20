"""Session construction and the shared-folder rule for cut lineage."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def build_session(app: str = "tessera", master: str | None = None, shuffle_partitions: int | None = None) -> SparkSession:
    """A session with the settings every plan here relies on (UTC, AQE, Arrow)."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    if master:
        builder = builder.master(master)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    if memory := os.environ.get("TESSERA_DRIVER_MEMORY"):
        builder = builder.config("spark.driver.memory", memory)
    return builder.getOrCreate()


def read_table(spark: SparkSession, sf_dir: str, name: str):
    """One Parquet table of a data folder; only Spark touches the path, so any Hadoop file system works."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
