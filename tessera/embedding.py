"""Embedders behind one protocol, applied to Arrow batches; a failing batch gives rows with an error, not a failed job.

No model files are at hand, so the default is signed feature hashing of words and character trigrams: deterministic,
lexical and normalised. Any object with `dimension` and `embed` takes its place; it is made once a task.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

# Model names and their dimensions; an unknown name means the first.
MODELS = {"all-MiniLM-L6-v2": 384, "all-MiniLM-L12-v2": 384, "BAAI/bge-base-en-v1.5": 768, "BAAI/bge-small-en-v1.5": 384}
BATCH = 256


class Embedder(Protocol):
    dimension: int
    name: str

    def embed(self, texts: Sequence[str]) -> np.ndarray: ...


@dataclass(frozen=True)
class HashingEmbedder:
    dimension: int = 384
    name: str = "hashing"

    def embed(self, texts: Sequence[str]) -> np.ndarray:
        import regex

        out = np.zeros((len(texts), self.dimension), np.float32)
        for i, text in enumerate(texts):
            words = regex.findall(r"[\p{L}\p{N}_]+", text.lower())
            keys = [w.encode() for w in words]
            keys += [b"#" + w[k : k + 3].encode() for w in words for k in range(max(1, len(w) - 2))]
            if not keys:
                continue
            h = np.fromiter(map(zlib.crc32, keys), np.uint32, len(keys)).astype(np.int64)
            out[i] = np.bincount(h % self.dimension, weights=np.where(h >> 31 & 1, 1.0, -1.0), minlength=self.dimension)
        norm = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(norm > 0, norm, 1)


def named(name: str) -> HashingEmbedder:
    """A hashing embedder with a known model's dimension; it reports its own name."""
    return HashingEmbedder(MODELS.get(name, next(iter(MODELS.values()))))


def embed(rows: DataFrame, embedder: Embedder, text: str = "content", batch: int = BATCH) -> DataFrame:
    """rows with `vector` and `error`; of a batch that fails, vector is null and error says why."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for a in range(0, max(1, whole.num_rows), batch):
                own = whole.slice(a, batch)
                if not own.num_rows:
                    continue
                try:
                    made = embedder.embed([t or "" for t in own.column(text).to_pylist()])
                    vectors, errors = list(made), [None] * own.num_rows
                except Exception as e:  # whatever a model raises concerns its batch alone
                    vectors, errors = [None] * own.num_rows, [f"{type(e).__name__}: {e}"] * own.num_rows
                yield own.append_column("vector", pa.array(vectors, pa.list_(pa.float32()))).append_column("error", pa.array(errors, pa.string()))

    return rows.mapInArrow(task, ", ".join(f"`{n}` {t}" for n, t in rows.dtypes) + ", vector array<float>, error string")
