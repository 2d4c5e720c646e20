"""Sum-of-squares online packing of tokenised documents into sequences of fixed capacity.

Each task tokenises its rows and packs them as they come. A document longer than a sequence fills whole sequences first;
what is left of it, at most the capacity, goes where the sum over levels h of N(h)^2 becomes least, N(h) being the number
of open sequences filled up to h. The level array N and at most OPEN open sequences are all the state: while that many are
open, a document's first ids fill the fullest one (cuts are free), and only its rest is placed. When the rows end, the
emptiest open sequences are poured into the gaps of the fullest, so that one partly filled sequence a task is all the
padding, and the other pieces stay where they were placed.

A task packs its own partition and derives sequence ids from the partition's number, so no shuffle is needed and a task
that runs again gives the same rows: its input is a scan's split, read in the same order.

Edge cases: a null text is empty and becomes the end id alone; equal texts are packed one by one; a text of any length
is cut into as many pieces as it needs; an empty table gives no rows; extra columns are not read.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CAPACITY = 2048
END_ID = 1
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
#: Sequences that a task holds open; 8 kB of ids each.
OPEN = 1024
#: Sequence ids of a task start at its partition's number times this.
STRIDE = 1 << 36


def vocabulary_path(name: str) -> str:
    """Place of a public vocabulary file on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


#: Code points that both libraries cut texts by in the same way; a test reads every one of them. Texts with others are
#: encoded by the tokenizers library.
AGREED = "\0-\u0557\u05d0-\u05ea\u0621-\u064a\u0e01-\u0e30\u1e00-\u1f15\u2000-\u2060\u2070-\u2071\u20a0-\u20b5\u2100-\u214f\u2190-\u23ff\u2500-\u27bf\u3000-\u303f\u3041-\u3096\u30a1-\u30fa\u4e00-\u9fa5\uac00-\ud7a3\U0001f300-\U0001f64f"
#: The pattern of byte-level BPE, a fixed value.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class Encoder:
    """Token ids of a vocabulary file, as the tokenizers library gives them without added special tokens.

    Byte-level BPE runs in tiktoken on the file's own ranks, which takes a third of the time. Tests hold both against each
    other over every token of the vocabulary, every code point of AGREED and whole tables. Texts with other code points or
    with one of the file's special strings, and any other kind of file, are encoded by the tokenizers library.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        before, model = spec.get("pre_tokenizer") or {}, spec["model"]
        plain = model["type"] == "BPE" and before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space") and not spec.get("normalizer") and not model.get("dropout")
        added = {t["content"] for t in spec.get("added_tokens", [])}
        self.odd = re.compile("|".join([f"[^{AGREED}]", *map(re.escape, sorted(added))]))
        self.fast = self._fast(model["vocab"], added) if plain else None

    @staticmethod
    def _fast(vocabulary: dict[str, int], added: set[str]):
        import tiktoken

        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in set(shown)]
        byte = {chr(c): b for c, b in [*((b, b) for b in shown), *((256 + k, b) for k, b in enumerate(rest))]}
        ranks = {bytes(byte[c] for c in token): i for token, i in vocabulary.items() if token not in added}
        return tiktoken.Encoding("held", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def __call__(self, text: str) -> np.ndarray:
        if self.fast is None or self.odd.search(text):
            return np.asarray(self.library.encode(text, add_special_tokens=False).ids, "<u4")
        return np.asarray(self.fast.encode_ordinary(text), "<u4")


class SumOfSquares:
    """Open sequences by level; place() says where a piece of some length goes."""

    def __init__(self, capacity: int, first_id: int) -> None:
        self.capacity, self.next_id = capacity, first_id
        self.count = np.zeros(capacity + 1, np.int64)
        self.open: list[list[int]] = [[] for _ in range(capacity)]

    def new(self) -> int:
        self.next_id += 1
        return self.next_id - 1

    def put(self, seq: int, level: int) -> None:
        self.count[level] += 1
        self.open[level].append(seq)

    def _take(self, levels: np.ndarray, which: int) -> tuple[int, int]:
        level = int(np.flatnonzero(levels)[which])
        self.count[level] -= 1
        return level, self.open[level].pop()

    def take_fullest(self) -> tuple[int, int]:
        """Level and id of a fullest open sequence, which leaves the array; there is one."""
        return self._take(self.count, -1)

    def take_emptiest(self) -> tuple[int, int]:
        return self._take(self.count, 0)

    def place(self, size: int) -> tuple[int, int, bool]:
        """Sequence, offset in it, and whether it is full now. Ties go to the fullest level, then the latest sequence."""
        top = self.capacity - size
        n = self.count
        gain = np.full(top + 1, 1, np.int64)  # change of the sum of squares by level
        gain[0] = 0
        after = n[size : self.capacity + 1]
        gain += 2 * after + 1
        gain[1:] -= 2 * n[1 : top + 1]
        gain[top] -= 2 * after[top] + 1  # a full sequence leaves the array
        used = n[: top + 1] > 0
        used[0] = True
        gain[~used] = np.iinfo(np.int64).max
        level = top - int(np.argmin(gain[::-1]))
        if level and n[level]:
            seq = self.open[level].pop()
            n[level] -= 1
        else:
            level, seq = 0, self.new()
        full = level + size == self.capacity
        if not full:
            self.put(seq, level + size)
        return seq, level, full


class Packer:
    """Places documents and holds the ids of open sequences, of which there are at most `room`."""

    def __init__(self, capacity: int, end_id: int, first_id: int, room: int = OPEN) -> None:
        self.state, self.capacity, self.end, self.room = SumOfSquares(capacity, first_id), capacity, np.uint32(end_id), room
        self.held: dict[int, list[tuple]] = {}  # pieces of sequences that are open
        self.out: dict[str, list] = {}

    def _emit(self, doc, start, ids, total, seq, offset) -> None:
        for k, v in (("doc_id", doc), ("start", start), ("length", len(ids)), ("ids_crc32", zlib.crc32(ids.tobytes())), ("doc_tokens", total), ("sequence_id", seq), ("offset", offset)):
            self.out.setdefault(k, []).append(v)

    def _close(self, seq: int) -> None:
        for d, start, part, n, offset in self.held.pop(seq):
            self._emit(d, start, part, n, seq, offset)

    def _fill_fullest(self, doc, start: int, ids: np.ndarray, total: int) -> int:
        """Fill the fullest open sequence with the first of the ids, as far as they go; how many went."""
        level, seq = self.state.take_fullest()
        n = min(len(ids), self.capacity - level)
        self.held[seq].append((doc, start, ids[:n], total, level))
        if level + n == self.capacity:
            self._close(seq)
        else:
            self.state.put(seq, level + n)
        return n

    def add(self, doc, ids: np.ndarray) -> None:
        ids = np.append(ids, self.end).astype("<u4")
        total, at = len(ids), 0
        while total - at >= self.capacity:
            self._emit(doc, at, ids[at : at + self.capacity], total, self.state.new(), 0)
            at += self.capacity
        while at < total and len(self.held) >= self.room:
            at += self._fill_fullest(doc, at, ids[at:], total)
        if at < total:
            seq, offset, full = self.state.place(total - at)
            self.held.setdefault(seq, []).append((doc, at, ids[at:], total, offset))
            if full:
                self._close(seq)

    def finish(self) -> None:
        """The emptiest open sequences are poured into the gaps of the fullest, until all but one are full."""
        while len(self.held) > 1:
            level, seq = self.state.take_emptiest()
            rest = self.held.pop(seq)
            while rest:
                doc, start, ids, total, _ = rest.pop()
                at = 0
                while at < len(ids) and self.held:
                    at += self._fill_fullest(doc, start + at, ids[at:], total)
                if at < len(ids):  # every gap is full: what is left is the one partly filled sequence
                    last, fill = self.state.new(), 0
                    for d, s, part, n, _ in [(doc, start + at, ids[at:], total, 0), *rest]:
                        self._emit(d, s, part, n, last, fill)
                        fill += len(part)
                    return
        for seq in list(self.held):
            self._close(seq)

    def take(self) -> dict[str, list]:
        out, self.out = self.out, {}
        return out


def pack(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", path: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID, vocabulary: str = "byte_bpe_50k.json", room: int = OPEN) -> DataFrame:
    """Pieces of the documents' token ids, each in one sequence (SCHEMA). path: a vocabulary file; default: the public one named; room: open sequences a task holds."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = Encoder(path or vocabulary_path(vocabulary))
        packer = Packer(capacity, end_id, TaskContext.get().partitionId() * STRIDE, room)

        def rows() -> Iterator[pa.RecordBatch]:
            if packer.out:
                yield pa.RecordBatch.from_pydict({k: pa.array(v, pa.int64()) for k, v in packer.take().items()})

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                packer.add(doc, encode(text.as_py() or ""))
            yield from rows()
        packer.finish()
        yield from rows()

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(task, SCHEMA)
