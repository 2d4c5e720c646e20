"""Helpers shared by the training-data operators."""

from __future__ import annotations

from collections import defaultdict
from itertools import count

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..lineage import cut, shared_dir  # noqa: F401

#: Java regex for one run of the white space that separates words: [\x20\x09-\x0D].
SPACE = r"[\x20\x09-\x0D]+"


def numbered(*first: bytes) -> defaultdict[bytes, int]:
    """A dictionary that gives every new key the next number; first: keys that get 0, 1, ..."""
    index: defaultdict[bytes, int] = defaultdict(count().__next__)
    for key in first:
        index[key]
    return index


def utf8(text: str | None) -> bytes:
    return b"" if text is None else text.encode("utf-8", "surrogatepass")


def words_of(text: str | None) -> list[bytes]:
    """Lower-cased (A-Z only) words [^\\x20\\x09-\\x0D]+ of a text, as UTF-8 bytes.

    bytes.lower() changes ASCII letters alone and bytes.split() splits on exactly the six ASCII white-space bytes.
    """
    return utf8(text).lower().split()


def mix(x: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of MurmurHash3, in place of a table of random hash functions."""
    x = x ^ (x >> np.uint64(33))
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def is_held_out(doc_id: str, modulus: int):
    """Column: crc32 of the id as text falls on 0."""
    return (F.crc32(F.col(doc_id).cast("string").cast("binary")) % F.lit(modulus)) == 0


def hashed_sample(df: DataFrame, rows: int, total: int, *key: str) -> DataFrame:
    """The given number of rows by a hash of their key, of about `total` in df; the same ones however df is dealt out.

    A threshold on the hash lets hardly more rows than wanted into the sort, so the tasks together send few to the driver.
    """
    h = F.xxhash64(*key)
    share = (rows + 6 * rows**0.5 + 20) / max(total, 1)
    if share < 1:
        df = df.where(F.pmod(h, F.lit(1 << 40)) < int(share * (1 << 40)))
    return df.orderBy(h, *key).limit(rows)
