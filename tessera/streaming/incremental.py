"""Continuous counterparts of the incremental index: changed files and new commits from a stream."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import snapshot
from ..operators.chunking import chunk_fixed


def new_commits(commits: DataFrame, keep: str = "30 days") -> DataFrame:
    """A stream of commits without those seen already; commit times bound the state."""
    timed = commits.withColumn("commit_time", F.timestamp_seconds("commit_date")).withWatermark("commit_time", keep)
    return timed.dropDuplicatesWithinWatermark(["hash"])


def chunk_stream(files: DataFrame, size: int = 50) -> DataFrame:
    """Chunks of a stream of files: the batch operator is a narrow stage, so it runs unchanged."""
    return chunk_fixed(files, size)


def index_stream(files: DataFrame, store, root: str, chunks: Callable[[DataFrame], DataFrame], checkpoint: str) -> StreamingQuery:
    """Keep a root of the store up to date with a stream of its files; the latest version of a file in a batch counts.

    A batch is compared with what is stored, so a batch that runs twice after a failure changes nothing the second time.
    """

    def run(batch: DataFrame, number: int) -> None:
        latest = batch.groupBy("root_path", "file_path").agg(F.max_by(F.struct(*[F.col(c) for c in batch.columns if c not in ("root_path", "file_path")]), "arrived").alias("x")).select("root_path", "file_path", "x.*")
        stored = store.chunks(root).select("root_path", "file_path", "file_hash").distinct()
        now = latest.select("root_path", "file_path", "file_hash")
        changed = snapshot.diff(stored.join(now.select("root_path", "file_path"), ["root_path", "file_path"], "left_semi"), now).where("status IN ('added', 'updated')")
        new = latest.join(changed.select("file_path"), "file_path", "left_semi")
        if not changed.isEmpty():
            store.update(root, changed.where("status = 'updated'"), chunks(new.drop("arrived")))

    return files.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def activity(events: DataFrame, late: str = "10 minutes", width: str = "5 minutes") -> DataFrame:
    """Counts and sums of an event stream by time window and type; what comes later than `late` is dropped."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return timed.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select("w.start", "w.end", "event_type", "n", "total")
