import datetime

from pyspark.sql import functions as F

from helpers import files_of
from tessera.embedding import HashingEmbedder, embed
from tessera.operators.chunking import chunk_fixed
from tessera.store import Store
from tessera.streaming import incremental


def run(stream, name, mode="append"):
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).start()
    q.processAllAvailable()
    q.stop()


def test_new_commits(spark, tmp_path):
    rows = spark.createDataFrame([("a", 100), ("a", 100), ("b", 200)], "hash string, commit_date long")
    rows.write.parquet(str(tmp_path / "c"))
    run(incremental.new_commits(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "c"))), "commits_once")
    assert sorted(r["hash"] for r in spark.table("commits_once").collect()) == ["a", "b"]


def test_index_stream(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    store.initialize(16)
    e = HashingEmbedder(16)
    make = lambda f: embed(chunk_fixed(f, 2).withColumn("indexed_at", F.lit(0)), e)
    schema = files_of(spark, ("a.txt", "x")).withColumn("arrived", F.lit(1)).schema

    def feed(n, *files):
        files_of(spark, *files).withColumn("arrived", F.lit(n)).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        incremental.index_stream(stream, store, "/r", make, str(tmp_path / "cp")).awaitTermination()
        return {(r["file_path"], r["content"]) for r in store.chunks("/r").collect()}

    assert feed(1, ("a.txt", "1\n2\n3"), ("b.txt", "x")) == {("a.txt", "1\n2"), ("a.txt", "3"), ("b.txt", "x")}
    assert feed(2, ("a.txt", "9")) == {("a.txt", "9"), ("b.txt", "x")}


def test_activity(spark, tmp_path):
    t = datetime.datetime(2024, 1, 1)
    rows = spark.createDataFrame([(t + datetime.timedelta(minutes=m), "a", 1.0) for m in (0, 1, 6, 60)], "ts timestamp, event_type string, value double")
    rows.coalesce(1).write.parquet(str(tmp_path / "e"))
    run(incremental.activity(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "e"))), "activity", "complete")
    assert [(r["n"], r["total"]) for r in spark.table("activity").orderBy("start").collect()] == [(2, 2.0), (1, 1.0), (1, 1.0)]
