"""Exact nearest neighbours: filters run below the distance, the distance in the scan's stage, and k rows leave a task."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vector as V

if TYPE_CHECKING:
    import numpy as np
    import pyarrow as pa

#: Rows that a task of knn_batch() compares with its queries at once, and pairs whose exact distances it takes at once.
PART, PAIRS = 1024, 16_384


def knn(rows: DataFrame, query: Sequence[float], k: int, where: Column | None = None, key: str = "chunk_id", vector: str = "vector") -> DataFrame:
    """rows with distance (squared L2) and vector_score = 1 / (1 + distance): the k nearest, ties by key."""
    if where is not None:
        rows = rows.where(where)
    d = rows.withColumn("distance", V.squared_l2(F.col(vector), V.literal(query)))
    return d.orderBy("distance", key).limit(k).withColumn("vector_score", V.similarity(F.col("distance")))


def knn_cosine(rows: DataFrame, query: Sequence[float], k: int, where: Column | None = None, key: str = "chunk_id", vector: str = "vector") -> DataFrame:
    """rows with vector_score = cosine: the k nearest, ties by key."""
    if where is not None:
        rows = rows.where(where)
    return rows.withColumn("vector_score", V.cosine(F.col(vector), V.literal(query))).orderBy(F.desc("vector_score"), key).limit(k)


def nearest(batches: Iterator[pa.RecordBatch], ids: np.ndarray, q: np.ndarray, k: int) -> Iterator[pa.RecordBatch]:
    """query_id, key, distance: the k rows of the batches (key, vector) that are nearest to each query, equal distances by key.

    Rows are taken PART at a time and pairs that may be near PAIRS at a time, so memory hangs on the number of queries
    alone, however many rows a batch has and however many of them are as far as the k-th.
    """
    import numpy as np
    import pyarrow as pa

    norms = (q**2).sum(1)
    best, keys, kind = np.full((len(ids), k), np.inf), np.full((len(ids), k), None, object), None
    for batch in batches:
        kind = batch.column(0).type
        for start in range(0, batch.num_rows, PART):
            part = batch.slice(start, PART)
            x = np.asarray(part.column(1).flatten(), float).reshape(part.num_rows, -1)
            own = np.array(part.column(0).to_pylist(), object)
            by_key = np.array(sorted(range(len(own)), key=own.__getitem__))
            x, own = x[by_key], own[by_key]
            squares = (x**2).sum(1)
            far = q @ x.T
            far *= -2
            far += norms[:, None]
            far += squares
            edge = np.minimum(np.partition(far, k - 1, axis=1)[:, k - 1] if len(x) > k else np.inf, best[:, -1])
            # all within rounding of the k-th, so that equal distances are told apart by key below
            edge = edge + 1e-9 * (1 + np.abs(edge)) + 1e-12 * (norms + squares.max())
            of, at = np.nonzero(far <= edge[:, None])
            exact = np.concatenate([((x[at[i : i + PAIRS]] - q[of[i : i + PAIRS]]) ** 2).sum(1) for i in range(0, len(of), PAIRS)] or [np.empty(0)])
            order = np.lexsort((at, exact, of))
            of, at, exact = of[order], at[order], exact[order]
            nth = np.arange(len(of)) - np.searchsorted(of, of)
            of, at, exact = of[nth < k], at[nth < k], exact[nth < k]
            ends = np.searchsorted(of, np.arange(len(ids) + 1))
            for i in np.flatnonzero(np.diff(ends)):
                new = slice(ends[i], ends[i + 1])
                near = sorted([*((d, w) for d, w in zip(best[i], keys[i]) if d < np.inf), *zip(exact[new], own[at[new]])])[:k]
                best[i, : len(near)], keys[i, : len(near)] = [d for d, _ in near], [w for _, w in near]
    of, at = np.nonzero(best < np.inf)
    if len(of):
        yield pa.RecordBatch.from_pydict({"query_id": pa.array(ids[of]), "key": pa.array(keys[of, at].tolist(), kind), "distance": pa.array(best[of, at])})


def knn_batch(rows: DataFrame, queries: DataFrame, k: int, block: int = 1024, key: str = "chunk_id", vector: str = "vector") -> DataFrame:
    """query_id, key, rank, distance for many queries (query_id, vector), in blocks of `block` queries against all rows.

    A block is the largest thing broadcast; a task multiplies it with parts of rows and keeps k rows a query.
    """
    import numpy as np
    from pyspark.sql import Window as W

    spark = rows.sparkSession
    total = queries.count()
    out = None
    for b in range(-(-total // block)):
        own = queries.where(F.pmod(F.xxhash64("query_id"), F.lit(-(-total // block))) == b).toPandas()
        if not len(own):
            continue
        held = spark.sparkContext.broadcast((own["query_id"].to_numpy(), np.stack(own["vector"].to_numpy()).astype(float)))

        def task(batches, held=held):
            yield from nearest(batches, *held.value, k)

        kind = dict(rows.dtypes)[key]
        found = rows.select(key, vector).mapInArrow(task, f"query_id {dict(queries.dtypes)['query_id']}, key {kind}, distance double")
        out = found if out is None else out.unionByName(found)
    if out is None:
        return spark.createDataFrame([], f"query_id long, {key} string, rank long, distance double")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy("distance", "key")).cast("long")
    return out.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("key").alias(key), "rank", "distance")
