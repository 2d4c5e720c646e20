"""Definitions of source files as a frame."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.language import visibility
from ..functions.text import signature
from ..operators.navigation import definition_id
from .parsing import definitions, kind_of

SCHEMA = "file_path string, root_path string, project string, pre int, parent_pre int, name string, kind string, start_line int, end_line int, start_col int, end_col int, doc_comment string, node_text string"


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    for batch in batches:
        out: dict[str, list] = {n: [] for n in names}
        for path, root, project, ext, text in zip(*(batch.column(c).to_pylist() for c in ("file_path", "root_path", "project", "extension", "content"))):
            lines = (text or "").split("\n")
            for i, parent, u in definitions(ext, text or ""):
                body = "\n".join(lines[u.start_line - 1 : u.end_line])
                for n, v in zip(names, (path, root, project, i, parent, u.name, kind_of(u), u.start_line, u.end_line, u.start_col, u.end_col, u.doc, body)):
                    out[n].append(v)
        kinds = {"int": pa.int32(), "string": pa.string()}
        yield pa.RecordBatch.from_arrays([pa.array(out[c.split()[0]], kinds[c.split()[1]]) for c in SCHEMA.split(", ")], names)


def definitions_of(files: DataFrame) -> DataFrame:
    """Definitions of all files: SCHEMA without node_text, with def_id, parent_id, signature and visibility."""
    found = files.select("file_path", "root_path", "project", "extension", "content").mapInArrow(_rows, SCHEMA)
    text = F.col("node_text")
    made = found.withColumns({"def_id": definition_id(F.col("file_path"), F.col("name"), F.col("start_line")), "signature": signature(text), "visibility": visibility(text)}).drop("node_text")
    parent = F.when(F.col("parent_pre") >= 0, F.concat_ws(":", "file_path", F.col("parent_pre").cast("string")))
    return made.withColumn("parent_id", parent)
