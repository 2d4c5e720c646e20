"""Approximate nearest neighbours by multi-index hashing of learned rotated binary codes.

A rotation that fits the signs of the centred, rotated vectors best (iterative quantisation) is learned on a bounded
sample, several times from different starts, and gives a code of SUBSTRING * PARTS bits at most, split into substrings of
SUBSTRING bits. A task gathers its rows up to ROOM and keeps an index of each substring: the rows by its value. A query
probes the buckets of all values within `errors` bits of its own substring, in the first `parts` substrings. By the
pigeonhole principle this retrieves every code within a Hamming radius of parts * (errors + 1) - 1; further rows meet the
query in some substring by chance, and the more likely the nearer they are. What is retrieved is ranked by exact Euclidean
distance of the vectors. `errors` and `parts` are learned: of the pairs that reach RECALL on the sample's true neighbours,
the one that would retrieve the fewest rows. A task in which a query retrieves fewer than k rows ranks all its rows.

All rows are indexed, in whatever partitions they are read; queries go around in blocks of QUERY_BLOCK rows (the largest
broadcast), each block being one pass. A task returns k rows a query at most, and a window ranks those.

Edge cases: vectors that are null, zero, of another length than most, or that hold null or non-finite components take no
part, nor do rows without id; rows that share the query's id count as its own; equal distances go to the smaller id;
without usable queries or rows the result is empty; extra columns are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut, hashed_sample

SUBSTRING, PARTS, MAX_ERRORS, RECALL = 18, 64, 4, 0.93
SAMPLE_ROWS, SAMPLE_QUERIES, ROUNDS = 12_000, 300, 8
#: Rows that a task indexes at once, and queries that go around together.
ROOM, QUERY_BLOCK = 1 << 16, 4096
SCHEMA = "query_id long, vec_id long, score double"


class Codes:
    """Learned rotations; encode() gives a code as PARTS numbers of SUBSTRING bits."""

    def __init__(self, sample: np.ndarray, k: int, parts: int = PARTS, recall: float = RECALL, rounds: int = ROUNDS, seed: int = 1) -> None:
        n, d = sample.shape
        self.mean = sample.mean(0)
        x = sample - self.mean
        axes = np.linalg.svd(x.T @ x)[0]
        y = x @ axes
        rng = np.random.default_rng(seed)
        each = []
        for _ in range(-(-parts * SUBSTRING // d)):
            r = np.linalg.qr(rng.normal(size=(d, d)))[0]
            for _ in range(rounds):
                u, _, v = np.linalg.svd(y.T @ np.where(y @ r > 0, 1.0, -1.0))
                r = u @ v
            each.append(axes @ r)
        # a substring takes its bits from different rotations, so that no two say the same
        self.rotation = np.concatenate(each, 1)[:, : parts * SUBSTRING].reshape(d, SUBSTRING, parts).transpose(0, 2, 1).reshape(d, -1)
        self.parts, self.errors = parts, MAX_ERRORS
        self._learn(sample, k, recall)

    def _learn(self, sample: np.ndarray, k: int, recall: float) -> None:
        """Set errors and parts: the fewest rows retrieved at the wanted recall, or the highest recall if none has it."""
        n = len(sample)
        if n < 2:
            return
        code = self.encode(sample)
        near = []
        for a in np.arange(0, n, max(1, n // SAMPLE_QUERIES)):
            d2 = ((sample - sample[a]) ** 2).sum(1)
            d2[a] = np.inf
            near.append(np.bitwise_count(code[np.argpartition(d2, min(k, n - 1) - 1)[: min(k, n - 1)]] ^ code[a]))
        rng = np.random.default_rng(2)
        a = rng.integers(0, n, 20_000)
        far = np.bitwise_count(code[a] ^ code[(a + rng.integers(1, n, len(a))) % n])
        best = None
        for errors in range(MAX_ERRORS + 1):
            # in which substring, counted from the first, a pair meets at the latest
            hits = [np.minimum.accumulate(np.where(x <= errors, 0, 1), 1).mean(0) for x in (np.concatenate(near), far)]
            for parts in range(4, self.parts + 1, 4):
                reached, share = 1 - hits[0][parts - 1], 1 - hits[1][parts - 1]
                mark = (reached >= recall, -share if reached >= recall else reached)
                if best is None or mark > best[0]:
                    best = (mark, errors, parts)
        self.errors, self.parts = best[1:]

    @property
    def radius(self) -> int:
        """Every code within this distance is retrieved."""
        return self.parts * (self.errors + 1) - 1

    def encode(self, x: np.ndarray) -> np.ndarray:
        bits = ((x - self.mean) @ self.rotation > 0).reshape(len(x), -1, SUBSTRING)
        return (bits @ (1 << np.arange(SUBSTRING, dtype=np.int32)))[:, : self.parts].astype(np.int32)

    def masks(self) -> np.ndarray:
        """All values with at most `errors` bits, to be combined with a substring."""
        return np.array([sum(1 << b for b in c) for e in range(self.errors + 1) for c in combinations(range(SUBSTRING), e)], np.int32)


class Index:
    """Rows by value, for each substring."""

    def __init__(self, code: np.ndarray, masks: np.ndarray) -> None:
        self.n, self.masks, self.tables = len(code), masks, []
        for j in range(code.shape[1]):
            order = np.argsort(code[:, j], kind="stable").astype(np.int32)
            first = np.zeros((1 << SUBSTRING) + 1, np.int32)
            np.cumsum(np.bincount(code[:, j], minlength=1 << SUBSTRING), out=first[1:])
            self.tables.append((order, first))

    def probe(self, q: np.ndarray) -> np.ndarray:
        """Rows with a substring within the errors of q's."""
        found = np.zeros(self.n, bool)
        for (order, first), value in zip(self.tables, q.tolist()):
            at = self.masks ^ value
            low = first[at]
            size = first[at + 1] - low
            there = size > 0
            low, size = low[there], size[there]
            if len(size):
                found[order[np.repeat(low - np.cumsum(size) + size, size) + np.arange(size.sum())]] = True
        return np.flatnonzero(found)


def usable(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """vec_id, v (array of double) of the rows that can be compared."""
    v = F.col(vector).cast("array<double>")
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return vectors.select(F.col(vec_id).cast("long").alias("vec_id"), v.alias("v")).where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & finite & F.exists("v", lambda x: x != 0))


def _matrix(column) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(column.flatten()).reshape(len(column), -1)


def _gathered(batches: Iterator[pa.RecordBatch], room: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Ids and vectors of at most about `room` rows at a time."""
    held, n = [], 0
    for batch in batches:
        for a in range(0, batch.num_rows, room):
            part = batch.slice(a, room)
            held.append((np.asarray(part.column(0)), _matrix(part.column(1))))
            n += part.num_rows
            if n >= room:
                yield tuple(np.concatenate(x) for x in zip(*held))
                held, n = [], 0
    if held:
        yield tuple(np.concatenate(x) for x in zip(*held))


def _search(held, k: int, room: int):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, query_ids, queries = held.value
        wanted, masks = codes.encode(queries), codes.masks()
        best_id = np.full((len(query_ids), k), np.iinfo(np.int64).max)
        best = np.full((len(query_ids), k), np.inf)
        for ids, x in _gathered(batches, room):
            index = Index(codes.encode(x), masks)
            for i, q in enumerate(queries):
                rows = index.probe(wanted[i])
                if len(rows) <= min(k, len(ids) - 1):
                    rows = np.arange(len(ids))
                rows = rows[ids[rows] != query_ids[i]]
                far = np.sqrt(((x[rows] - q) ** 2).sum(1))
                if len(far) > k:
                    near = far <= np.partition(far, k - 1)[k - 1]
                    rows, far = rows[near], far[near]
                far, own = np.append(best[i], far), np.append(best_id[i], ids[rows])
                order = np.lexsort((own, far))[:k]
                best[i], best_id[i] = far[order], own[order]
        there = np.isfinite(best)
        if there.any():
            yield pa.RecordBatch.from_pydict({"query_id": pa.array(np.repeat(query_ids, k)[there.ravel()]), "vec_id": pa.array(best_id[there]), "score": pa.array(best[there])})

    return task


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 10, vec_id: str = "vec_id", vector: str = "embedding", sample_rows: int = SAMPLE_ROWS, block: int = QUERY_BLOCK, room: int = ROOM) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest rows of vectors for each row of queries, itself left out by id."""
    rows, asked = usable(vectors, vec_id, vector), usable(queries, vec_id, vector)
    spark = vectors.sparkSession
    sizes = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    empty = spark.createDataFrame([], SCHEMA)
    parts: list[DataFrame] = []
    if sizes:
        same = F.size("v") == sizes[0]["n"]
        rows, asked = rows.where(same), asked.where(same)
        # a bounded sample, the same whichever way the rows are dealt out
        sample = hashed_sample(rows, sample_rows, sizes[0]["count"], "vec_id").toArrow()
        codes = Codes(_matrix(sample.column("v")), k)
        total = asked.count()
        blocks = -(-total // block)
        asked = asked.dropDuplicates(["vec_id"])
        if blocks > 1:
            asked = cut(asked.withColumn("b", F.pmod(F.xxhash64("vec_id"), F.lit(blocks))))
        for b in range(blocks):
            own = (asked.where(F.col("b") == b).drop("b") if blocks > 1 else asked).toArrow()
            if own.num_rows:
                held = spark.sparkContext.broadcast((codes, np.asarray(own.column("vec_id")), _matrix(own.column("v"))))
                found = rows.mapInArrow(_search(held, k, room), SCHEMA)
                parts.append(found if blocks == 1 else cut(_ranked(found, k)).drop("rank"))
    out = parts[0] if parts else empty
    for p in parts[1:]:
        out = out.unionByName(p)
    return _ranked(out, k)


def _ranked(found: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(W.partitionBy("query_id").orderBy("score", "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
