import numpy as np
from pyspark.sql import functions as F

from tessera import lineage
from tessera.llm import common


def test_cut_survives_and_reads_the_same(spark):
    df = common.cut(spark.range(100).withColumn("t", F.lit(None).cast("string")))
    assert df.count() == 100 and df.columns == ["id", "t"] and "Range" not in df._jdf.queryExecution().executedPlan().toString()
    assert common.cut(spark.createDataFrame([], "a array<long>")).dtypes == [("a", "array<bigint>")]


def test_shared_folder(spark):
    """The cluster's folder where one is set, else one of our own."""
    given = spark.conf.get("spark.checkpoint.dir", None)
    assert common.shared_dir(spark) == (given.rstrip("/") if given else lineage._OWN[spark.sparkContext.applicationId])


def test_hashed_sample(spark):
    df = spark.range(20_000)
    one = [r["id"] for r in common.hashed_sample(df, 300, 20_000, "id").collect()]
    two = [r["id"] for r in common.hashed_sample(df.repartition(7), 300, 20_000, "id").collect()]
    assert one == two and len(set(one)) == 300
    low = common.hashed_sample(df, 300, 20_000, "id")
    assert sorted(r["id"] for r in common.hashed_sample(spark.range(50), 300, 50, "id").collect()) == list(range(50))
    assert common.hashed_sample(spark.range(0), 300, 0, "id").count() == 0
    assert 7000 < np.mean(one) < 13_000 and low.count() == 300


def test_words():
    assert common.words_of("A b É\x0bC\n") == ["a b".encode(), "É".encode(), b"c"]
    assert common.words_of(None) == [] == common.words_of(" \t")


def test_mix_is_one_to_one():
    x = np.arange(100_000, dtype=np.uint64)
    y = common.mix(x)
    assert len(np.unique(y)) == len(x) and (x == np.arange(100_000)).all()
