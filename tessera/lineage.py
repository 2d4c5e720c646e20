"""Cutting lineage by tables in the cluster's shared folder."""

from __future__ import annotations

import atexit
import tempfile
import uuid
import weakref

from pyspark.sql import DataFrame, SparkSession

from .errors import ConfigError

_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; a folder of our own only where that is unset and all run on one machine (local masters)."""
    if found := spark.conf.get("spark.checkpoint.dir", None):
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ConfigError("spark.checkpoint.dir is unset: executors and driver need a shared folder")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        _OWN[app] = "file://" + tempfile.mkdtemp(prefix="tessera-checkpoint-")
    return _OWN[app]


def cut(df: DataFrame) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back.

    The written table replaces the lineage: later stages read columns of it instead of recomputing, and they survive
    lost executors because the files live in the cluster's shared store. The folder goes when the session ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tessera-{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    _forget_at_exit(spark, path.rsplit("/", 1)[0])
    return spark.read.schema(df.schema).parquet(path)


_SEEN: set[str] = set()


def _forget_at_exit(spark: SparkSession, folder: str) -> None:
    if folder in _SEEN:
        return
    _SEEN.add(folder)
    ref = weakref.ref(spark)

    def forget() -> None:
        session = ref()
        try:
            jvm = session.sparkContext._jvm
            where = jvm.org.apache.hadoop.fs.Path(folder)
            where.getFileSystem(session.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
        except Exception:  # the session is gone already; nothing is left to talk to
            pass

    atexit.register(forget)
