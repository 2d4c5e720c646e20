import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import ann


def frame(spark, x, ids=None, parts=3):
    ids = range(len(x)) if ids is None else ids
    return spark.createDataFrame([(int(i), None if v is None else [float(a) for a in v]) for i, v in zip(ids, x)], "vec_id long, embedding array<double>").repartition(parts)


def exact(x, q, k):
    d = np.sqrt(((x - x[q]) ** 2).sum(1))
    d[q] = np.inf
    return [(int(i), d[i]) for i in np.lexsort((np.arange(len(x)), d))[:k]]


def test_recall(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    x = np.array([r["embedding"] for r in rows.orderBy("vec_id").collect()])
    asked = rows.where(F.col("vec_id") % 10 == 0)
    got = {}
    for r in ann.nearest(rows, asked).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = (r["vec_id"], r["score"])
    hit = 0
    for q, found in got.items():
        want = exact(x, q, 10)
        assert sorted(found) == list(range(1, 11))
        for v, s in found.values():
            assert s == pytest.approx(np.sqrt(((x[v] - x[q]) ** 2).sum()), rel=1e-12)
        hit += len({v for v, _ in found.values()} & {v for v, _ in want})
    assert len(got) == 50 and hit >= 0.9 * 500


def distance(a, b):
    return np.bitwise_count(a ^ b).sum(-1)


def test_every_code_within_the_radius_is_found():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(3000, 32)) + rng.integers(0, 4, 3000)[:, None]
    codes = ann.Codes(x, 10, parts=8, rounds=3)
    code = codes.encode(x)
    for errors in (0, 1, 3):
        codes.errors = errors
        index = ann.Index(code, codes.masks())
        for q in code[:25]:
            got = set(index.probe(q).tolist())
            assert set(np.flatnonzero(distance(code, q) <= codes.radius).tolist()) <= got
            assert got == set(np.flatnonzero((np.bitwise_count(code ^ q) <= errors).any(1)).tolist())


def measured(path):
    """Recall of ten over all queries, and the share of rows retrieved, in one index over all rows."""
    x = np.array([list(v) for (v,) in duckdb.sql(f"SELECT embedding FROM '{path}/embeddings.parquet' ORDER BY vec_id").fetchall()], float)
    codes = ann.Codes(x, 10)
    code = codes.encode(x)
    index, hit, rows = ann.Index(code, codes.masks()), 0, 0
    asked = range(0, len(x), 20)
    for q in asked:
        found = index.probe(code[q])
        hit += len({i for i, _ in exact(x, q, 10)} & set(found.tolist()))
        rows += len(found)
    return hit / 10 / len(asked), rows / len(x) / len(asked), codes


def test_the_index_prunes():
    recall, share, _ = measured("/root/testdata/sf0.1")
    assert recall >= 0.9 and share < 0.25
    rng = np.random.default_rng(3)  # where vectors lie in groups, few rows are retrieved
    x = np.repeat(rng.normal(size=(200, 64)), 20, 0) + 0.1 * rng.normal(size=(4000, 64))
    codes = ann.Codes(x, 10)
    code = codes.encode(x)
    index = ann.Index(code, codes.masks())
    found = [index.probe(code[q]) for q in range(0, 4000, 40)]
    hits = sum(len({i for i, _ in exact(x, q, 10)} & set(f.tolist())) for q, f in zip(range(0, 4000, 40), found))
    assert hits >= 0.9 * 1000 and sum(map(len, found)) / len(found) < 0.03 * 4000


def test_blocks_of_queries_agree(spark):
    rng = np.random.default_rng(2)
    df = frame(spark, rng.normal(size=(200, 8)))
    asked = df.where("vec_id % 10 = 0")
    rows = lambda **k: sorted(map(tuple, ann.nearest(df, asked, k=4, **k).collect()))
    assert rows() == rows(block=7)
    assert len(rows(room=9)) == 80


def test_ties_and_copies(spark):
    x = [[1.0, 0.0]] * 30 + [[0.0, 1.0]]
    got = [(r["rank"], r["vec_id"], r["score"]) for r in ann.nearest(frame(spark, x), frame(spark, x[:1]), k=5).orderBy("rank").collect()]
    assert got == [(i, i, 0.0) for i in range(1, 6)]


def test_edge_cases(spark):
    x = [[1.0, 2.0], None, [0.0, 0.0], [float("nan"), 1.0], [float("inf"), 1.0], [1.0], [1.0, 3.0], [2.0, 2.0]]
    df = frame(spark, x).withColumns({"v": F.lit(1), "rank": F.lit("x"), "score": F.lit(None)})
    withnull = df.unionByName(spark.createDataFrame([(9, [1.0, None]), (None, [1.0, 1.0])], "vec_id long, embedding array<double>").withColumns({"v": F.lit(1), "rank": F.lit("x"), "score": F.lit(None)}))
    got = sorted((r["query_id"], r["rank"], r["vec_id"]) for r in ann.nearest(withnull, withnull).collect())
    assert got == [(0, 1, 6), (0, 2, 7), (6, 1, 0), (6, 2, 7), (7, 1, 0), (7, 2, 6)]
    empty = spark.createDataFrame([], "vec_id long, embedding array<double>")
    assert ann.nearest(empty, empty).count() == 0 == ann.nearest(frame(spark, [[1.0]]), frame(spark, [[1.0]])).count()
    twice = frame(spark, [[1.0, 1.0], [1.0, 1.0], [3.0, 1.0]], [4, 4, 5])
    assert [(r["query_id"], r["vec_id"]) for r in ann.nearest(twice, twice.where("vec_id = 4")).collect()] == [(4, 5)]
