"""The engine's table and vector functions under SQL names, for sessions that work in SQL."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql.functions import pandas_udf, udtf

from ..embedding import Embedder, HashingEmbedder
from ..sources.parsing import chunk_units, definitions, kind_of


@udtf(returnType="kind string, start_line int, end_line int")
class CodeUnits:
    """code_units(extension, content): the structural units of a source text."""

    def eval(self, extension: str, content: str):
        yield from chunk_units(extension, content or "")


@udtf(returnType="pre int, parent_pre int, name string, kind string, start_line int, end_line int, start_col int, end_col int, doc_comment string")
class CodeDefinitions:
    """code_definitions(extension, content): the named definitions of a source text, outer before inner."""

    def eval(self, extension: str, content: str):
        for i, parent, u in definitions(extension, content or ""):
            yield i, parent, u.name, kind_of(u), u.start_line, u.end_line, u.start_col, u.end_col, u.doc


def register(spark: SparkSession, embedder: Embedder | None = None) -> None:
    """code_units and code_definitions as table functions, embed(text) as a vector function."""
    own = embedder or HashingEmbedder()

    @pandas_udf("array<float>")
    def vectors(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(list(own.embed([t or "" for t in texts])))

    spark.udtf.register("code_units", CodeUnits)
    spark.udtf.register("code_definitions", CodeDefinitions)
    spark.udf.register("embed", vectors)
