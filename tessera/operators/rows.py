"""What is grouped by a key that most tables have once a row: done where the row is read, without a shuffle."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words that a task gathers before it hands them on.
WORDS = 100_000


def by_row(rows: DataFrame, key: str, made: Callable[[DataFrame], DataFrame], merged: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """made(rows) if no key repeats, else merged(made(rows)). Which it is, the plan finds when it runs, from the keys alone.

    The branch that is not wanted reads the rows and makes nothing of them.
    """
    repeats = F.coalesce(rows.groupBy(key).agg(F.count("*").alias("n")).agg((F.max("n") > 1).alias("more")).scalar(), F.lit(False))
    return made(rows.where(~repeats)).unionByName(merged(made(rows.where(repeats))))


def counted_words(rows: DataFrame, pattern: str, word: str, longest: int | None = None) -> DataFrame:
    """key, word, n, length from rows of a key and a text: every match of the pattern once a row, with its number there, and that of all.

    longest: words of so many characters, or more, don't count.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = re.compile(pattern).findall
        for batch in batches:
            at, words, n, lengths = [], [], [], []
            for i, text in enumerate(batch.column(1)):
                every = find(text.as_py() or "")
                if longest:
                    every = [w for w in every if len(w) < longest]
                times = Counter(every)
                at += [i] * len(times)
                words += times
                n += times.values()
                lengths += [len(every)] * len(times)
                if words and (len(words) >= WORDS or i + 1 == batch.num_rows):
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(words, pa.string()), pa.array(n, pa.int64()), pa.array(lengths, pa.int64())], [key, word, "n", "length"])
                    at, words, n, lengths = [], [], [], []

    key = rows.columns[0]
    return rows.mapInArrow(task, f"`{key}` {rows.dtypes[0][1]}, {word} string, n bigint, length bigint")
