"""Directory trees and single files as frames of text files.

A tree on a mounted file system is listed on the driver, where ignore rules prune whole folders (a listing is what Spark
does itself before a read); the listing is spread by size and the contents are read by tasks. A tree behind any other
scheme is read by Spark's binary source, to which the size filter is pushed down; ignore files are not seen there.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import ValidationError
from ..functions import glob as globs
from ..functions.language import language_of
from ..functions.pdf import markdown
from ..functions.text import extension, looks_like_text
from . import ignore

#: Bytes of files that one task reads, about.
TASK_BYTES = 32_000_000


def normalise(path: str) -> str:
    return path if "://" in path else os.path.realpath(path)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        held: list[list] = [[], [], []]
        size = 0
        for full, path in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            try:
                with open(full, "rb") as f:
                    body = f.read()
            except OSError:  # one unreadable file does not end the scan
                body = None
            for column, value in zip(held, (full, path, body)):
                column.append(value)
            size += len(body or b"")
            if size > TASK_BYTES:
                yield pa.RecordBatch.from_arrays([pa.array(held[0], pa.string()), pa.array(held[1], pa.string()), pa.array(held[2], pa.binary())], ["full", "file_path", "body"])
                held, size = [[], [], []], 0
        if held[0]:
            yield pa.RecordBatch.from_arrays([pa.array(held[0], pa.string()), pa.array(held[1], pa.string()), pa.array(held[2], pa.binary())], ["full", "file_path", "body"])


def _raw(spark: SparkSession, root: str, include: Sequence[str], exclude: Sequence[str], max_size: int) -> DataFrame:
    """full, file_path (relative), body of the files to read."""
    if "://" in root:
        top = root.rstrip("/") + "/"
        found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).where(F.col("length") <= max_size)
        rel = F.when(F.instr("path", F.lit(top.split("://", 1)[1])) > 0, F.substring_index("path", top.split("://", 1)[1], -1)).otherwise(F.col("path"))
        return found.where(globs.included(F.col("path"), include, exclude) & ~F.col("path").contains("/.git/")).select(F.col("path").alias("full"), rel.alias("file_path"), F.col("content").alias("body"))
    if not os.path.exists(root):
        raise ValidationError(f"Path does not exist: {root}")
    if not os.path.isdir(root):
        raise ValidationError(f"Path is not a directory: {root}")
    listed = [(os.path.join(root, p), p, size) for p, size in ignore.walk(root) if size <= max_size]
    frame = spark.createDataFrame(listed, "full string, file_path string, size long")
    frame = frame.where(globs.included(F.col("full"), include, exclude))
    parts = max(1, min(len(listed), sum(s for _, _, s in listed) // TASK_BYTES + 1))
    return frame.select("full", "file_path").repartition(parts).mapInArrow(_read, "full string, file_path string, body binary")


def _as_files(raw: DataFrame, root: str, project: str | None, pdf_text: Callable[[bytes], str] | None) -> DataFrame:
    """Text files of raw; empty ones, binary ones and those that are not UTF-8 are left out. pdf_text: bytes of a PDF to its text."""
    ext = extension(F.col("full"))
    is_pdf = F.lower(F.coalesce(ext, F.lit(""))) == "pdf"
    text = F.when(F.is_valid_utf8("body") & ~is_pdf, F.decode("body", "UTF-8"))
    if pdf_text is not None:
        raw = _with_pdf_text(raw, pdf_text)
        text = F.when(is_pdf, markdown(F.col("pdf"))).otherwise(text)
    made = raw.select("full", "file_path", ext.alias("extension"), text.alias("content")).where(F.col("content").isNotNull() & looks_like_text(F.col("content")))
    return made.select("file_path", F.lit(root).alias("root_path"), F.lit(project).cast("string").alias("project"), "extension", language_of(F.col("extension")).alias("language"), F.sha2("content", 256).alias("file_hash"), "content")


def _with_pdf_text(raw: DataFrame, pdf_text: Callable[[bytes], str]) -> DataFrame:
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for full, body in zip(batch.column("full").to_pylist(), batch.column("body")):
                try:
                    out.append(pdf_text(body.as_py()) if full.lower().endswith(".pdf") and body.is_valid else None)
                except Exception:  # whatever an extractor raises, it skips its file alone
                    out.append(None)
            yield batch.append_column("pdf", pa.array(out, pa.string()))

    return raw.mapInArrow(task, "full string, file_path string, body binary, pdf string")


def scan(spark: SparkSession, root: str, project: str | None = None, include: Sequence[str] = (), exclude: Sequence[str] = (), max_size: int = 1_048_576, pdf_text: Callable[[bytes], str] | None = None) -> DataFrame:
    """Frame of the text files under root (columns of operators.chunking.FILE_COLUMNS)."""
    root = normalise(root)
    return _as_files(_raw(spark, root, include, exclude, max_size), root, project, pdf_text)


def single(spark: SparkSession, path: str, project: str | None = None) -> DataFrame:
    """Frame of one file; its root is its folder, its path its name."""
    path = normalise(path)
    if not os.path.isfile(path):
        raise ValidationError(f"File does not exist: {path}")
    root, name = os.path.split(path)
    raw = spark.createDataFrame([(path, name)], "full string, file_path string").mapInArrow(_read, "full string, file_path string, body binary")
    return _as_files(raw, root, project, None)
