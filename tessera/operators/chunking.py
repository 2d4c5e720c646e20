"""Chunks of files by lines: fixed, sliding, and by structure with a fixed fallback. One narrow stage each, no shuffle.

Frames of files have the columns of FILE_COLUMNS at least; chunks add start_line and end_line (from 1), content and
chunk_id. Blank chunks are left out; their line numbers are not given to others.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import chunk_id, is_blank, let, lines

FILE_COLUMNS = ("file_path", "root_path", "project", "extension", "language", "file_hash", "content")
FALLBACK_LINES = 50
UNITS = "array<struct<kind:string,start_line:int,end_line:int,nth:int>>"


def _span(rows: Column, start: Column, size: Column | int, nth: Column | None = None) -> Column:
    """nth: how many spans before this one have its lines; without it there are none."""
    end = F.least(start + size - 1, F.size(rows))
    return F.struct(start.cast("int").alias("start_line"), end.cast("int").alias("end_line"), F.array_join(F.slice(rows, start, size), "\n").alias("content"), (F.lit(0) if nth is None else nth).alias("nth"))


def fixed_spans(text: Column, size: int) -> Column:
    if size < 1:
        raise ValueError("a chunk has one line at least")
    last = lambda rows: F.ceil(F.size(rows) / size).cast("int") - 1
    return let(lines(text), lambda rows: F.when(F.size(rows) > 0, F.transform(F.sequence(F.lit(0), last(rows)), lambda i: _span(rows, i * size + 1, size))))


def sliding_spans(text: Column, size: int, overlap: int) -> Column:
    """Windows of `size` lines, each size - overlap after the one before (one line if overlap >= size), up to the last line."""
    if size < 1:
        raise ValueError("a chunk has one line at least")
    step = size - overlap if overlap < size else 1
    last = lambda rows: F.greatest(F.ceil((F.size(rows) - size) / step).cast("int"), F.lit(0))
    return let(lines(text), lambda rows: F.when(F.size(rows) > 0, F.transform(F.sequence(F.lit(0), last(rows)), lambda i: _span(rows, i * step + 1, size))))


def chunk_by(files: DataFrame, spans: Column) -> DataFrame:
    """One row for each span that is not blank. Spans of the same lines, as of units that share a line, get ids of their own."""
    kept = F.filter(spans, lambda s: ~is_blank(s["content"]))
    rest = [c for c in files.columns if c != "content"]
    cut = files.select(*rest, F.inline(kept))
    plain = chunk_id(F.col("root_path"), F.col("file_path"), F.col("start_line"), F.col("end_line"), F.col("file_hash"))
    return cut.withColumn("chunk_id", F.when(F.col("nth") > 0, F.concat_ws("-", plain, F.col("nth").cast("string"))).otherwise(plain)).drop("nth")


def chunk_fixed(files: DataFrame, size: int = FALLBACK_LINES) -> DataFrame:
    return chunk_by(files, fixed_spans(F.col("content"), size))


def chunk_sliding(files: DataFrame, size: int, overlap: int) -> DataFrame:
    return chunk_by(files, sliding_spans(F.col("content"), size, overlap))


def with_units(files: DataFrame, parse: Callable[[str | None, str], list[tuple[str, int, int]]] | None = None) -> DataFrame:
    """files and `units`, the structural units of each: (kind, start_line, end_line, nth), outer ones before inner ones.

    nth counts the units before that have the same lines of the file, in one walk, as a file may have any number of units.
    """
    from ..sources.parsing import chunk_units

    parse = parse or chunk_units

    def numbered(ext: str | None, text: str) -> list[dict[str, str | int]]:
        last = text.count("\n") + (bool(text) and not text.endswith("\n"))  # lines() ends there
        seen: Counter[tuple[int, int]] = Counter()
        out = []
        for k, a, b in parse(ext, text):
            at = (a, min(b, last))
            out.append({"kind": k, "start_line": a, "end_line": b, "nth": seen[at]})
            seen[at] += 1
        return out

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start_line", pa.int32()), ("end_line", pa.int32()), ("nth", pa.int32())]))
        for batch in batches:
            exts, texts = batch.column("extension").to_pylist(), batch.column("content").to_pylist()
            found = [numbered(e, t or "") for e, t in zip(exts, texts)]
            yield batch.append_column("units", pa.array(found, kind))

    return files.mapInArrow(task, ", ".join(f"`{n}` {t}" for n, t in files.dtypes) + f", units {UNITS}")


def unit_spans(text: Column, units: Column) -> Column:
    return let(lines(text), lambda rows: F.transform(units, lambda u: _span(rows, u["start_line"], u["end_line"] - u["start_line"] + 1, u["nth"])))


def chunk_units(files: DataFrame) -> DataFrame:
    """One chunk for each structural unit; nested units overlap, text between units is in none."""
    return chunk_by(with_units(files), unit_spans(F.col("content"), F.col("units"))).drop("units")


def chunk_hybrid(files: DataFrame, size: int = FALLBACK_LINES) -> DataFrame:
    """Structural units, or fixed chunks for a file that has none."""
    text, units = F.col("content"), F.col("units")
    by_unit = F.filter(unit_spans(text, units), lambda s: ~is_blank(s["content"]))
    return chunk_by(with_units(files), let(by_unit, lambda own: F.when(F.size(own) > 0, own).otherwise(fixed_spans(text, size)))).drop("units")
