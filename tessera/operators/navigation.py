"""Code navigation: identifiers, references to definitions, the definition at a position, callers, callees, call graphs.

definitions: file_path, name, kind, start_line, end_line, start_col, pre (order in the file), def_id. files: file_path, content.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.language import reference_kind
from ..functions.text import lines
from ..lineage import cut
from . import rows as R
from .rows import by_row, counted_words

#: Identifiers that stand alone; letters beyond ASCII are parts of words. A run is taken whole, so none is tried twice.
WORD = r"(?<![\p{L}\p{N}_])([a-zA-Z_][a-zA-Z0-9_]*+)(?![\p{L}\p{N}_])"
#: The same in Python.
IDENTIFIER = re.compile(r"\b[a-zA-Z_][a-zA-Z0-9_]*+\b")


def symbol_id(path: Column, name: Column, line: Column, column: Column) -> Column:
    return F.concat_ws(":", path, name, line, column)


def parse_symbol_id(text: Column) -> Column:
    """struct(file_path, name, line, col), read from the right so that a path may hold colons."""
    part = lambda i: F.regexp_extract(text, r"(?s)^(.*):([^:]*):([0-9]+):([0-9]+)$", i)
    return F.struct(part(1).alias("file_path"), part(2).alias("name"), part(3).try_cast("int").alias("line"), part(4).try_cast("int").alias("col"))


def definition_id(path: Column, name: Column, line: Column) -> Column:
    return F.concat_ws(":", F.lit("def"), path, name, line)


def reference_id(path: Column, line: Column, column: Column) -> Column:
    return F.concat_ws(":", F.lit("ref"), path, line, column)


def occurrences(files: DataFrame) -> DataFrame:
    """file_path, line_no, line, name, nth: every identifier of every line, with its number among the line's identifiers."""
    rows = files.select("file_path", F.posexplode(lines(F.col("content"))).alias("at", "line"))
    return rows.select("file_path", (F.col("at") + 1).alias("line_no"), "line", F.posexplode(F.regexp_extract_all("line", F.lit(WORD), 1)).alias("nth", "name"))


def names(files: DataFrame) -> DataFrame:
    """file_path, name, n: every identifier of a file once, with its number there, counted where the file is read."""
    made = lambda rows: counted_words(rows, IDENTIFIER.pattern, "name").drop("length")
    merged = lambda out: out.groupBy("file_path", "name").agg(F.sum("n").alias("n"))
    return by_row(files.select("file_path", "content"), "file_path", made, merged)


def name_lines(files: DataFrame) -> DataFrame:
    """file_path, name, uses: every identifier of a file once, with the lines that have it, in order: (line_no, n).

    All of it is gathered where the file is read; only files whose path repeats are put together by a shuffle.
    """
    out = "file_path string, name string, uses array<struct<line_no:int,n:bigint>>"

    def merged(found: DataFrame) -> DataFrame:
        one = found.select("file_path", "name", F.inline("uses")).groupBy("file_path", "name", "line_no").agg(F.sum("n").alias("n"))
        return one.groupBy("file_path", "name").agg(F.sort_array(F.collect_list(F.struct("line_no", "n"))).alias("uses"))

    return by_row(files.select("file_path", "content"), "file_path", lambda rows: rows.mapInArrow(_gather, out), merged)


def _gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """name_lines() of batches of (file_path, content), in batches of some WORDS uses, so that no task holds more than a file's beyond these."""

    def made() -> pa.RecordBatch:
        uses = pa.StructArray.from_arrays([pa.array(line_no, pa.int32()), pa.array(n, pa.int64())], ["line_no", "n"])
        return pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(names, pa.string()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), uses)], ["file_path", "name", "uses"])

    paths, names, ends, line_no, n = [], [], [0], [], []
    for batch in batches:
        for path, text in zip(batch.column(0), batch.column(1)):
            found: dict[str, list[int]] = {}
            for at, line in enumerate((text.as_py() or "").split("\n"), 1):
                for name in IDENTIFIER.findall(line):
                    if (lines_of := found.get(name)) is None:
                        found[name] = [at]
                    else:
                        lines_of.append(at)
            for lines_of in found.values():
                if len(lines_of) == 1:
                    line_no.append(lines_of[0])
                    n.append(1)
                else:
                    times = Counter(lines_of)  # in the order of lines, as they came
                    line_no += times
                    n += times.values()
                ends.append(len(n))
            names += found
            paths += [path.as_py()] * len(found)
            if len(n) >= R.WORDS:
                yield made()
                paths, names, ends, line_no, n = [], [], [0], [], []
    if names:
        yield made()


def within(line: Column, spans: Column) -> Column:
    """Whether any of the spans (start_line, end_line) has the line."""
    return F.exists(spans, lambda s: line.between(s["start_line"], s["end_line"]))


def with_context(found: DataFrame) -> DataFrame:
    """start_col, end_col (from 0, in characters), and the line before and after each occurrence."""
    length = lambda xs: F.aggregate(xs, F.lit(0), lambda n, x: n + F.char_length(x))
    words, gaps, nth = F.regexp_extract_all("line", F.lit(WORD), 1), F.split("line", WORD), F.col("nth")
    out = found.withColumn("start_col", length(F.slice(gaps, F.lit(1), nth + 1)) + length(F.slice(words, F.lit(1), nth)))
    out = out.withColumn("end_col", F.col("start_col") + F.char_length("name"))
    return out.withColumn("before", F.substr("line", F.lit(1), F.col("start_col"))).withColumn("after", F.substr("line", F.col("end_col") + 1))


def first_definitions(definitions: DataFrame) -> DataFrame:
    """name, target_id: the first definition of every name. An aggregation, so a frequent name is one row a task."""
    return definitions.groupBy("name").agg(F.min_by("def_id", F.struct("file_path", "pre")).alias("target_id"))


def references(files: DataFrame, definitions: DataFrame) -> DataFrame:
    """file_path, line_no, start_col, end_col, name, target_id, reference_kind, for every use of a defined name.

    What lies inside any definition of the same name in the same file counts as a definition site. Spans of a name in a
    file are gathered first and tested as an array, so no occurrence is multiplied by its definitions.
    """
    spans = definitions.groupBy("file_path", "name").agg(F.collect_list(F.struct("start_line", "end_line")).alias("spans"))
    used = occurrences(files).join(first_definitions(definitions), "name")
    used = used.join(spans, ["file_path", "name"], "left")
    line = F.col("line_no")
    used = used.where(F.col("spans").isNull() | ~within(line, F.col("spans"))).drop("spans")
    return with_context(used).withColumn("reference_kind", reference_kind(F.col("line"), F.col("before"), F.col("after"))).drop("before", "after", "nth")


def referenced(used: DataFrame, definitions: DataFrame) -> DataFrame:
    """file_path, line_no, name, target_id, uses: what references() finds, counted by line, from name_lines() with `spans`.

    Lines within the spans go before the join, which gets a row for each name of a file, not for each of its uses.
    """
    left = F.filter("uses", lambda u: F.col("spans").isNull() | ~within(u["line_no"], F.col("spans")))
    out = used.select("file_path", "name", left.alias("uses")).where(F.size("uses") > 0).join(first_definitions(definitions), "name")
    return out.select("file_path", "name", "target_id", F.inline("uses")).withColumnRenamed("n", "uses")


def definition_at(definitions: DataFrame, path: str, line: int, column: int = 0) -> DataFrame:
    """The first definition in the file, outer before inner, that holds the position; no row if none does."""
    held = definitions.where((F.col("file_path") == path) & (F.col("start_line") <= line) & (F.col("end_line") >= line))
    if column:
        held = held.where(F.col("start_col") <= column)
    return held.orderBy("pre").limit(1)


def call_edges(refs: DataFrame, definitions: DataFrame) -> DataFrame:
    """caller, callee, file_path, line_no: calls with the first definition of a function that encloses the call.

    Spans are gathered by file: a call searches its own file's functions and is never multiplied by them.
    """
    functions = definitions.where(F.col("kind").isin("function", "method"))
    by_file = functions.groupBy("file_path").agg(F.sort_array(F.collect_list(F.struct("pre", "start_line", "end_line", "def_id"))).alias("spans"))
    calls = refs.where("reference_kind = 'call'").select("file_path", "line_no", F.col("target_id").alias("callee"))
    line = F.col("line_no")
    around = F.get(F.filter("spans", lambda s: line.between(s["start_line"], s["end_line"])), F.lit(0))
    return calls.join(by_file, "file_path").select(around["def_id"].alias("caller"), "callee", "file_path", "line_no").where("caller IS NOT NULL")


def reach(edges: DataFrame, start: DataFrame, depth: int, src: str = "src", dst: str = "dst") -> DataFrame:
    """node, depth, parent: what can be reached from start (node) in at most `depth` steps, each node once, at its least depth.

    Edges and the nodes of each round are written to the shared folder, so a round reads tables and the plan doesn't grow.
    """
    none = F.lit(None).cast(start.schema["node"].dataType)
    rounds = [cut(start.select("node", F.lit(0).alias("depth"), none.alias("parent")).dropDuplicates(["node"]))]
    pairs = cut(edges.select(F.col(src).alias("parent"), F.col(dst).alias("node")).distinct())
    for d in range(1, depth + 1):
        step = pairs.join(rounds[-1].select(F.col("node").alias("parent")), "parent").groupBy("node").agg(F.min("parent").alias("parent"))
        seen = reduce(DataFrame.unionByName, rounds).select("node")
        rounds.append(cut(step.join(seen, "node", "left_anti").select("node", F.lit(d).alias("depth"), "parent")))
        if rounds[-1].isEmpty():
            break
    return reduce(DataFrame.unionByName, rounds)


def first_per(rows: DataFrame, key: str, *order: str) -> DataFrame:
    """The first row of each key in the given order."""
    return rows.withColumn("__n", F.row_number().over(W.partitionBy(key).orderBy(*order))).where("__n = 1").drop("__n")
