"""BM25 keyword ranking, from raw texts in two narrow passes or from stored postings.

From texts: one aggregation gives the corpus size, the mean length and the query terms' document frequencies (one row,
used as a scalar subquery), then every row is scored where it is read; only a top-k leaves the tasks. From postings: the
rows of the query's terms are read (term is the sort column of the files), joined to their lengths, and summed up.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import LONGEST, space_tokens, tokens
from .rows import by_row, counted_words

# Parameters of the two formulas.
K1, B = 1.2, 0.75
FLAT_K1, FLAT_B, FLAT_LENGTH = 1.5, 0.75, 100.0


def query_terms(query: str) -> list[str]:
    """The query's own tokens as tokens() would cut them, in order, repeats kept."""
    import regex

    return [t for t in regex.findall(r"[\p{L}\p{N}]+", query.lower()) if len(t) < LONGEST]


def postings(chunks: DataFrame, key: str = "chunk_id", text: str = "content") -> DataFrame:
    """key, term, tf, length: the inverted index, one row for each term of a document.

    Terms are counted in the document's row; only documents whose key repeats are put together by a shuffle.
    """
    made = lambda rows: counted_words(rows, r"[^\W_]+", "term", LONGEST).select(key, "term", F.col("n").alias("tf"), "length")
    merged = lambda out: out.groupBy(key, "term").agg(F.sum("tf").alias("tf"), F.max("length").alias("length"))
    return by_row(chunks.select(key, F.lower(text).alias("lower")), key, made, merged)


def document_frequency(index: DataFrame) -> DataFrame:
    return index.groupBy("term").agg(F.count("*").alias("df"))


def _count_of(words: Column, term: str) -> Column:
    return F.size(F.filter(words, lambda w: w == term)).cast("double")


def idf(n: Column, df: Column) -> Column:
    return F.log(1 + (n - df + 0.5) / (df + 0.5))


def term_score(tf: Column, length: Column, mean: Column) -> Column:
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / mean))


def bm25(chunks: DataFrame, query: str, key: str = "chunk_id", text: str = "content") -> DataFrame:
    """key, keyword_score for every row that holds a term of the query."""
    terms = list(dict.fromkeys(query_terms(query)))
    cut = chunks.select(key, tokens(F.col(text)).alias("t"))
    if not terms:
        return cut.select(key, F.lit(0.0).alias("keyword_score")).where(F.lit(False))
    stats = cut.agg(F.struct(F.count("*").cast("double").alias("n"), F.avg(F.size("t")).alias("mean"), *(F.sum(F.array_contains("t", t).cast("double")).alias(f"df{i}") for i, t in enumerate(terms))).alias("s")).scalar()
    held = cut.where(F.arrays_overlap("t", F.lit(terms))).select(key, F.size("t").cast("double").alias("length"), *(_count_of(F.col("t"), t).alias(f"tf{i}") for i, t in enumerate(terms))).withColumn("s", stats)
    s = F.col("s")
    total: Column = F.lit(0.0)
    for i in range(len(terms)):
        total = total + idf(s["n"], s[f"df{i}"]) * term_score(F.col(f"tf{i}"), F.col("length"), s["mean"])
    return held.select(key, total.alias("keyword_score"))


def bm25_postings(index: DataFrame, query: str, key: str = "chunk_id", stats: tuple[int, float] | None = None) -> DataFrame:
    """The same from stored postings: only the query's terms are read. stats: documents and mean length, if they are known."""
    terms = list(dict.fromkeys(query_terms(query)))
    own, term = index.where(F.col("term").isin(terms)), F.col("term")
    if stats is None:
        # one pass over the index gives all that is known of it, the terms' document frequencies too
        held = (F.count_if(term == t).cast("double").alias(f"df{i}") for i, t in enumerate(terms))
        documents = index.groupBy(key).agg(F.first("length").cast("double").alias("length"), *held)
        known = F.struct(F.count("*").cast("double").alias("n"), F.avg("length").alias("mean"), *(F.sum(f"df{i}").alias(f"df{i}") for i in range(len(terms))))
        scored = own.withColumn("s", documents.agg(known.alias("s")).scalar())
        scored = scored.withColumn("df", F.coalesce(*(F.when(term == t, F.col("s")[f"df{i}"]) for i, t in enumerate(terms)), F.lit(None).cast("double")))
    else:
        df = own.groupBy("term").agg(F.count("*").cast("double").alias("df"))  # one row a query term
        scored = own.join(F.broadcast(df), "term").withColumn("s", F.struct(F.lit(float(stats[0])).alias("n"), F.lit(float(stats[1])).alias("mean")))
    s = F.col("s")
    return scored.groupBy(key).agg(F.sum(idf(s["n"], F.col("df")) * term_score(F.col("tf").cast("double"), F.col("length").cast("double"), s["mean"])).alias("keyword_score"))


def bm25_flat(chunks: DataFrame, query: str, key: str = "chunk_id", text: str = "content") -> DataFrame:
    """key, keyword_score in [0, 1]: fixed mean length, white-space tokens, the mean over the query's terms, repeats counted."""
    terms = query.lower().split()
    cut = chunks.select(key, space_tokens(F.col(text)).alias("t"))
    if not terms:
        return cut.select(key, F.lit(0.0).alias("keyword_score"))
    own = list(dict.fromkeys(terms))
    stats = cut.agg(F.struct(F.count("*").cast("double").alias("n"), *(F.sum(F.array_contains("t", t).cast("double")).alias(f"df{i}") for i, t in enumerate(own))).alias("s")).scalar()
    held = cut.select(key, F.size("t").cast("double").alias("length"), *(_count_of(F.col("t"), t).alias(f"tf{i}") for i, t in enumerate(own))).withColumn("s", stats)
    s, total = F.col("s"), F.lit(0.0)
    for i, t in enumerate(own):
        tf, df = F.col(f"tf{i}"), s[f"df{i}"]
        df = F.when(df > 0, df).otherwise(1.0)
        part = idf(s["n"], df) * tf * (FLAT_K1 + 1) / (tf + FLAT_K1 * (1 - FLAT_B + FLAT_B * F.col("length") / FLAT_LENGTH))
        total = total + terms.count(t) * F.when(tf > 0, part).otherwise(0.0)
    return held.select(key, F.greatest(F.lit(0.0), F.least(F.lit(1.0), total / len(terms))).alias("keyword_score"))


def top(scored: DataFrame, score: str, k: int, key: str = "chunk_id") -> DataFrame:
    """The k best rows; equal scores by key. Spark keeps k rows a task and merges them, nothing is sorted whole."""
    return scored.orderBy(F.desc(score), F.asc(key)).limit(k)


def top_per_root(scored: DataFrame, score: str, k: int, key: str = "chunk_id", root: str = "root_path") -> DataFrame:
    """The k best rows of every root, together."""
    from pyspark.sql import Window as W

    rank = F.row_number().over(W.partitionBy(root).orderBy(F.desc(score), F.asc(key)))
    return scored.withColumn("root_rank", rank.cast("long")).where(F.col("root_rank") <= k)


