"""Fusion of ranked lists: reciprocal ranks, weighted sums, and the adaptive threshold in one pass."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# The rank constant, the depth of each list, the fallback levels and the weights.
RRF_K = 60
DEPTH = 3
LEVELS = (0.6, 0.5, 0.4, 0.3)
VECTOR_WEIGHT, KEYWORD_WEIGHT = 0.7, 0.3


def ranked(rows: DataFrame, score: str, key: str = "chunk_id", ascending: bool = False) -> DataFrame:
    """rows with rank from 1. For lists already cut to a bounded depth: the window has one partition."""
    by = F.asc(score) if ascending else F.desc(score)
    return rows.withColumn("rank", F.row_number().over(W.orderBy(by, F.asc(key))).cast("long"))


def rrf(*lists: DataFrame, key: str = "chunk_id", k: int = RRF_K) -> DataFrame:
    """key, score = sum of 1 / (k + rank) over the lists (key, rank). A union and one aggregation, for any number of lists."""
    parts = [x.select(key, (1.0 / (F.lit(float(k)) + F.col("rank"))).alias("term")) for x in lists]
    return reduce(DataFrame.unionByName, parts).groupBy(key).agg(F.sum("term").alias("score"))


def hybrid(vectors: DataFrame, keywords: DataFrame, limit: int, key: str = "chunk_id") -> DataFrame:
    """key, score, vector_score, keyword_score of the `limit` best after fusing two lists of DEPTH * limit rows each.

    vectors: key, vector_score; keywords: key, keyword_score; both already cut to their depth, so the joins are of lists
    of bounded size. A row that only one list holds has vector_score 0 or keyword_score null.
    """
    v = ranked(vectors.select(key, "vector_score"), "vector_score", key)
    w = ranked(keywords.select(key, "keyword_score"), "keyword_score", key)
    term = 1.0 / (F.lit(float(RRF_K)) + F.col("rank"))
    none = F.lit(None).cast("double")
    both = v.select(key, term.alias("term"), "vector_score", none.alias("keyword_score")).unionByName(w.select(key, term.alias("term"), none.alias("vector_score"), "keyword_score"))
    fused = both.groupBy(key).agg(F.sum("term").alias("score"), F.coalesce(F.max("vector_score"), F.lit(0.0)).alias("vector_score"), F.max("keyword_score").alias("keyword_score"))
    return fused.orderBy(F.desc("score"), F.asc(key)).limit(limit)


def passing(fused: DataFrame, threshold: float) -> DataFrame:
    """Rows whose vector score or keyword score reaches the threshold."""
    return fused.where((F.col("vector_score") >= threshold) | (F.coalesce(F.col("keyword_score"), F.lit(0.0)) >= threshold))


def adaptive(fused: DataFrame, threshold: float, levels: Sequence[float] = LEVELS) -> DataFrame:
    """Rows that pass the highest level with any row, with threshold_used and threshold_lowered.

    The candidates don't depend on the threshold, so the best of them decides: the threshold itself, or else, for one
    over the last level, the first level below it that the best row reaches. One pass instead of a search for each level.
    """
    best = F.greatest(F.col("vector_score"), F.coalesce(F.col("keyword_score"), F.lit(0.0)))
    scored = fused.withColumn("__best", best)
    top = scored.agg(F.max("__best")).scalar()
    level = F.when(top >= threshold, F.lit(threshold))
    if threshold > levels[-1]:
        for x in levels:
            if x < threshold:
                level = level.when(top >= x, F.lit(x))
    level = level.otherwise(F.lit(threshold))
    held = scored.withColumn("threshold_used", level)
    return held.where(F.col("__best") >= F.col("threshold_used")).withColumn("threshold_lowered", F.col("threshold_used") < threshold).drop("__best")


def weighted(vectors: DataFrame, keywords: DataFrame, limit: int, key: str = "chunk_id") -> DataFrame:
    """key, score = 0.7 * vector + 0.3 * keyword over the rows of the vector list."""
    both = vectors.join(keywords.select(key, "keyword_score"), key, "left").withColumn("keyword_score", F.coalesce("keyword_score", F.lit(0.0)))
    return both.withColumn("score", VECTOR_WEIGHT * F.col("vector_score") + KEYWORD_WEIGHT * F.col("keyword_score")).orderBy(F.desc("score"), F.asc(key)).limit(limit)
