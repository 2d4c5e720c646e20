"""Removal of repeated passages: every byte covered by a string of LENGTH bytes that also starts earlier in the corpus.

Where two equal strings could be is found first. Every start of a LENGTH-byte string belongs to the leftmost smallest
hash of an ANCHOR-byte string inside it, so equal strings have equal anchors. Consecutive starts with one anchor form a
segment of at most 2 * LENGTH - ANCHOR bytes. A row for each segment and document goes through aggregations and joins by
anchor; what has an anchor of its own in the whole corpus ends there. Of segments with equal bytes all but the earliest
are repeats as a whole.

Different segments with one anchor may still share strings. Their earliest copies, in blocks of bounded size, are joined
to one text each, without the strings whose SIDE bytes beside the anchor no other segment of the block has; its
Burrows-Wheeler transform is expanded breadth-first: from the interval of all suffixes, each
round extends the intervals to the left by every byte that occurs in them, which gives the places between suffixes whose
longest common prefix is 0, 1, 2, ... bytes, and stops at LENGTH. Places not reached by then join suffixes that share
LENGTH bytes. An anchor with more than CHUNK different segments is made finer until its blocks are small: the strings that
have STEP more bytes to the right of it go by those, the others by STEP bytes to the left, and so on; equal strings stay
together, as they have the anchor in the same place.

That two segments are equal is known by 128 bits of hash (anchor and content), not by comparing them; strings in the
transform and finer segments are compared byte by byte.

Edge cases: a null text is empty; texts under LENGTH bytes lose nothing; rows that repeat an id and a text are one
document; rows with equal ids and different texts are told apart by a hash of the text, and their order is by start,
then hash; a null id counts as smaller than any other; an empty table gives no rows; extra columns are not read by
repeated_spans() and are carried by deduplicate().
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, mix, utf8

LENGTH, ANCHOR, STEP = 100, 32, 16
#: Bytes beside the anchor that a string of a block has to share with another; with it they fill the longer window hashed.
SIDE = 32
#: Different segments of one anchor that may meet in a block, and the segments aimed at in a block.
CHUNK, BLOCK = 4096, 6000
#: Starts of strings that are looked at together: their arrays fit a core's cache.
STRIDE = 1 << 16
NO_ID = -(1 << 63)
_ODD = np.uint64(0x9E3779B97F4A7C15)
_BYTE = mix(np.arange(256, dtype=np.uint64) + _ODD)


def _window_hashes(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the 32- and the 64-byte windows at every position where they fit, by doubling."""
    h = _BYTE[x]
    size = 1
    short = h
    while size < 64:
        if len(h) <= size:
            return short, h[:0]
        with np.errstate(over="ignore"):
            h = h[:-size] * np.uint64(0xD6E8FEB86659FD93 + 2 * size) + h[size:]
        h ^= h >> np.uint64(29)
        if size >= 16:
            h = mix(h)
        size *= 2
        if size == ANCHOR:
            short = h
    return short, h


def _least(x: np.ndarray, width: int) -> np.ndarray:
    """Smallest of every width consecutive values."""
    size = 1
    while 2 * size <= width:
        x = np.minimum(x[:-size], x[size:])
        size *= 2
    return np.minimum(x[: len(x) - (width - size)], x[width - size :]) if width > size else x


def segments(buf: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Anchor hash, content hash, first start and number of starts of every segment of the given ascending starts in buf."""
    none = np.zeros(0, np.uint64)
    if not len(starts):
        return none, none, np.zeros(0, np.int64), np.zeros(0, np.int64)
    short, long = _window_hashes(buf)
    place = np.arange(len(short), dtype=np.uint64)
    # the place in the low bits: of equal hashes the leftmost is the least
    owner = (_least((short & ~np.uint64((1 << 24) - 1)) | place, LENGTH - ANCHOR + 1)[starts] & np.uint64((1 << 24) - 1)).astype(np.int64)
    cuts = np.flatnonzero((owner[1:] != owner[:-1]) | (starts[1:] != starts[:-1] + 1)) + 1
    first = np.concatenate([[0], cuts])
    n = np.diff(np.append(first, len(starts)))
    s = starts[first]
    last = s + n - 1 + LENGTH - 64
    middle = np.minimum(s + 52, last)
    with np.errstate(over="ignore"):
        content = mix(mix(mix(long[s] + n.astype(np.uint64)) ^ long[middle]) * _ODD ^ long[last])
    return short[owner[first]], content, s, n


class Segments:
    """Segments of some documents: document's number, anchor, content, place, number of starts, and whether it is the document's first of its kind."""

    def __init__(self, datas: list[bytes]) -> None:
        lengths = np.array([len(d) for d in datas], np.int64)
        if lengths.max(initial=0) > STRIDE:  # one document, in strides that overlap by what a string needs
            (data,) = datas
            found = []
            for a in range(0, len(data) - LENGTH + 1, STRIDE):
                buf = np.frombuffer(data, np.uint8, min(STRIDE + LENGTH - 1, len(data) - a), a)
                h, c, s, n = segments(buf, np.arange(len(buf) - LENGTH + 1))
                found.append((h, c, s + a, n))
            h, c, s, n = (np.concatenate(p) for p in zip(*found))
            own = np.zeros(len(h), np.int64)
        else:
            base = np.cumsum(lengths) - lengths
            count = np.maximum(0, lengths - LENGTH + 1)
            starts = np.arange(count.sum()) + np.repeat(base - (np.cumsum(count) - count), count)
            h, c, s, n = segments(np.frombuffer(b"".join(datas), np.uint8), starts)
            own = np.searchsorted(base, s, side="right") - 1  # starts of neighbours are LENGTH apart, so no run crosses
            s = s - base[own]
        order = np.lexsort((s, c, h, own))
        first = np.ones(len(h), bool)
        a, b = order[1:], order[:-1]
        first[a] = (own[a] != own[b]) | (h[a] != h[b]) | (c[a] != c[b])
        self.own, self.anchor, self.content, self.pos, self.n, self.first = own, h, c, s, n, first


def _batched(datas: list[bytes]) -> Iterator[list[int]]:
    """Numbers of consecutive documents with about STRIDE bytes together; longer ones and those without a string alone or left out."""
    held, size = [], 0
    for i, d in enumerate(datas):
        if len(d) < LENGTH:
            continue
        if len(d) > STRIDE:
            yield [i]
            continue
        if size + len(d) > STRIDE:
            yield held
            held, size = [], 0
        held.append(i)
        size += len(d)
    if held:
        yield held


def _repeats_inside(datas: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Spans of every document that repeat an earlier string of the same document, known by whole segments."""
    none = np.zeros(0, np.int64)
    out = [(none, none)] * len(datas)
    for numbers in _batched(datas):
        g = Segments([datas[i] for i in numbers])
        late = np.flatnonzero(~g.first)
        own = g.own[late]
        for k in np.unique(own).tolist():
            at = late[own == k]
            out[numbers[k]] = (g.pos[at], g.pos[at] + g.n[at] + LENGTH - 1)
    return out


def _segment_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc, tie, text -> anchor, content, doc, tie, pos, n: one row for each different segment of a document."""
    for whole in batches:
        for a in range(0, whole.num_rows, 2000):
            batch = whole.slice(a, 2000)
            datas = [utf8(t.as_py()) for t in batch.column(2)]
            doc, tie = np.asarray(batch.column(0)), np.asarray(batch.column(1))
            for numbers in _batched(datas):
                g = Segments([datas[i] for i in numbers])
                own = np.array(numbers)[g.own]
                rows = np.flatnonzero(g.first)
                for k in range(0, len(rows), 50_000):
                    at = rows[k : k + 50_000]
                    yield pa.RecordBatch.from_pydict({"anchor": pa.array(g.anchor[at].view(np.int64)), "content": pa.array(g.content[at].view(np.int64)), "doc": pa.array(doc[own[at]]), "tie": pa.array(tie[own[at]], pa.int32()), "pos": pa.array(g.pos[at]), "n": pa.array(g.n[at].astype(np.int16))})


SEGMENT = "anchor long, content long, doc long, tie int, pos long, n short"


# ---- Burrows-Wheeler transform and interval expansion ----


def suffix_array(symbol: np.ndarray) -> np.ndarray:
    """Order of all suffixes of a sequence of small numbers that ends with 0; the zeros are terminators, all different, the first the least."""
    n = len(symbol)
    bits = int(symbol.max()).bit_length() or 1
    size = 63 // bits
    ends = np.flatnonzero(symbol == 0)
    left = np.repeat(ends, np.diff(ends, prepend=-1)) - np.arange(n)  # symbols before the terminator
    key, held = symbol.astype(np.uint64), 1
    while held < size:  # as many symbols as fit, by doubling; nothing beyond a terminator counts
        more = min(held, size - held)
        further = np.zeros(n, np.uint64)
        further[: max(0, n - held)] = key[held:] >> np.uint64(bits * (held - more))
        further[left < held] = 0
        key = key << np.uint64(bits * more) | further
        held += more
    alive = left >= size
    order = np.argsort(key)
    over = ~alive[order]  # equal keys with a terminator stand in the terminators' order
    ended = order[over]
    order[over] = ended[np.lexsort((ended, key[ended]))]
    fresh = np.ones(n + 1, bool)
    sorted_key = key[order]
    fresh[1:n] = (sorted_key[1:] != sorted_key[:-1]) | over[1:]
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(fresh[:n], np.arange(n), 0))
    again = order[~(fresh[:-1] & fresh[1:])]
    while len(again):
        # what isn't single yet has no terminator within reach, so size further on is the same part
        both = rank[again] * n + rank[again + size]
        by = np.argsort(both)
        at, both = again[by], both[by]
        head, i = rank[at], np.arange(len(at))
        group, fresh = np.ones(len(at), bool), np.ones(len(at) + 1, bool)
        group[1:], fresh[1:-1] = head[1:] != head[:-1], both[1:] != both[:-1]
        rank[at] = head + np.maximum.accumulate(np.where(fresh[:-1], i, 0)) - np.maximum.accumulate(np.where(group, i, 0))
        again = at[~(fresh[:-1] & fresh[1:])]
        size *= 2
    out = np.empty(n, np.int64)
    out[rank] = np.arange(n)
    return out


class Wavelet:
    """Wavelet matrix: a level for each bit of the symbols, the sequence dealt out stably by that bit."""

    def __init__(self, seq: np.ndarray, symbols: int) -> None:
        self.levels = []
        for b in range(max(1, (symbols - 1).bit_length()) - 1, -1, -1):
            bit = (seq >> b) & 1 == 1
            ones = np.zeros(len(seq) + 1, np.int32)
            np.cumsum(bit, out=ones[1:])
            self.levels.append((ones, len(seq) - int(ones[-1])))
            seq = np.concatenate([seq[~bit], seq[bit]])
        self.start = np.zeros(symbols, np.int64)
        found, at = np.unique(seq, return_index=True)
        self.start[found] = at

    def extend(self, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Every symbol in each interval [lo, hi), with how often it stands before lo and before hi."""
        symbol = np.zeros(len(lo), np.int64)
        for ones, zeros in self.levels:
            a, b = ones[lo], ones[hi]
            none, one = hi - lo > b - a, b > a
            symbol = np.concatenate([symbol[none] * 2, symbol[one] * 2 + 1])
            lo, hi = np.concatenate([(lo - a)[none], zeros + a[one]]), np.concatenate([(hi - b)[none], zeros + b[one]])
        return symbol, lo - self.start[symbol], hi - self.start[symbol]


def shared_prefix_groups(parts: list[bytes], length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Groups of starts with equal strings of `length` bytes: group, part and start in the part, for every repeated one."""
    sizes = np.array([len(p) + 1 for p in parts])
    text = np.frombuffer(b"".join(p + b"\0" for p in parts), np.uint8)
    ends = np.cumsum(sizes) - 1
    n, terms = len(text), len(parts)
    is_end = np.zeros(n, bool)
    is_end[ends] = True
    alphabet, count = np.unique(text[~is_end], return_counts=True)
    code = np.zeros(256, np.int64)
    code[alphabet] = np.arange(1, len(alphabet) + 1)
    symbol_of = np.where(is_end, 0, code[text])
    order = suffix_array(symbol_of)
    last = symbol_of[order - 1].astype(np.int16)  # in 16 bits numpy sorts by digits
    tree = Wavelet(last, len(alphabet) + 1)
    first = np.concatenate([[0, terms], terms + np.cumsum(count)])  # of the suffixes that start with a symbol
    before = np.empty(n, np.int64)  # rank of the suffix that starts one symbol earlier; for terminators of no meaning
    before[np.argsort(last, kind="stable")] = np.arange(n)
    reached = np.zeros(n + 1, bool)
    # round 0: a prefix of one symbol each; terminators differ, so each has an interval of its own
    lo = np.concatenate([np.arange(terms), first[1:-1]])
    hi = np.concatenate([np.arange(terms) + 1, first[2:]])
    reached[0] = reached[n] = True
    reached[hi] = True
    for _ in range(1, length):
        lone = hi - lo == 1  # one suffix has one symbol before it
        symbol, a, b = tree.extend(lo[~lone], hi[~lone])
        real = symbol > 0
        base = first[symbol[real]]
        one = before[lo[lone][last[lo[lone]] > 0]]
        lo, hi = np.concatenate([base + a[real], one]), np.concatenate([base + b[real], one + 1])
        new = ~reached[hi]
        lo, hi = lo[new], hi[new]
        if not len(lo):
            break
        reached[hi] = True
    joined = np.flatnonzero(~reached)  # the places between suffixes that share `length` bytes at least
    opens = np.append(True, np.diff(joined) > 1)[: len(joined)]
    rows = np.concatenate([joined, joined[opens] - 1])
    run = np.cumsum(opens) - 1
    place = order[rows]
    part = np.searchsorted(ends, place, side="left")
    return np.concatenate([run, run[opens]]), part, place - (ends[part] - sizes[part] + 1)


def narrowed(keys: np.ndarray, parts: list[bytes], core: np.ndarray) -> tuple[np.ndarray, list[bytes], np.ndarray]:
    """Part's number, bytes and place in the part of what can share a string with another part; the parts differ, and all those of a key are given.

    Every string of a segment holds SIDE bytes more to the right of its anchor, or else to the left. Equal strings hold
    the same ones, so those whose bytes on that side no other part has are not looked for. Finer pieces stay whole, if
    their key has several.
    """
    sizes = np.array([len(p) for p in parts], np.int64)
    base = np.cumsum(sizes) - sizes
    short, long = _window_hashes(np.frombuffer(b"".join(parts), np.uint8))
    own = np.repeat(np.arange(len(parts)), sizes)[: len(short)]
    hits = np.flatnonzero((short.view(np.int64) == keys[own]) & (core[own] < 0))
    numbers, first = np.unique(own[hits], return_index=True)
    place = hits[first] - base[numbers]
    split = np.clip(place + ANCHOR + SIDE - LENGTH, 0, sizes[numbers] - LENGTH + 1)
    at = base[numbers] + place
    left, right = split > 0, split < sizes[numbers] - LENGTH + 1
    for side, window in ((left, at - SIDE), (right, at)):
        _, which, times = np.unique(long[window[side]], return_inverse=True, return_counts=True)
        side[side] = times[which] > 1
    a = np.where(left, 0, split)
    b = np.where(right, sizes[numbers], split - 1 + LENGTH)
    some = left | right
    rest = np.setdiff1d(np.arange(len(parts)), numbers)
    _, which, times = np.unique(keys[rest], return_inverse=True, return_counts=True)
    rest = rest[times[which] > 1]
    number = np.concatenate([numbers[some], rest])
    a, b = np.concatenate([a[some], np.zeros(len(rest), np.int64)]), np.concatenate([b[some], sizes[rest]])
    return number, [parts[k][x:y] for k, x, y in zip(number.tolist(), a.tolist(), b.tolist())], a


def _earlier(table: pa.Table) -> pa.Table:
    """The spans of one block's segments that repeat an earlier string."""
    doc, tie, pos = (np.asarray(table.column(c)) for c in ("doc", "tie", "pos"))
    number, parts, cut_off = narrowed(np.asarray(table.column("key")), table.column("part").to_pylist(), np.asarray(table.column("core")))
    if not parts:
        return table.select(["doc", "tie", "pos"]).slice(0, 0).rename_columns(["doc", "tie", "start"]).append_column("stop", pa.array([], pa.int64()))
    group, part, start = shared_prefix_groups(parts)
    start, part = start + cut_off[part], number[part]
    doc, tie, pos = doc[part], tie[part], pos[part] + start
    order = np.lexsort((tie, pos, doc, group))
    group, doc, tie, pos = group[order], doc[order], tie[order], pos[order]
    i = np.maximum.accumulate(np.where(np.append(True, np.diff(group) > 0)[: len(group)], np.arange(len(group)), 0))
    late = (doc != doc[i]) | (pos != pos[i]) | (tie != tie[i])
    doc, tie, pos = doc[late], tie[late], pos[late]
    order = np.lexsort((pos, tie, doc))
    doc, tie, pos = doc[order], tie[order], pos[order]
    opens = np.ones(len(doc), bool)
    opens[1:] = (doc[1:] != doc[:-1]) | (tie[1:] != tie[:-1]) | (pos[1:] > pos[:-1] + LENGTH)
    last = np.append(np.flatnonzero(opens)[1:] - 1, len(doc) - 1)[: int(opens.sum())]
    return pa.table({"doc": doc[opens], "tie": pa.array(tie[opens], pa.int32()), "start": pos[opens], "stop": pos[last] + LENGTH})


# ---- in Spark ----


def _keyed(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    return docs.select(F.coalesce(F.col(f"`{doc_id}`").cast("long"), F.lit(NO_ID)).alias("doc"), F.hash(F.col(f"`{text}`")).alias("tie"), F.col(f"`{text}`").alias("text"))


def _squeeze(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import zstandard

    z = zstandard.ZstdCompressor(1)
    for whole in batches:
        for a in range(0, whole.num_rows, 1000):
            batch = whole.slice(a, 1000)
            yield pa.RecordBatch.from_pydict({"doc": batch.column(0), "tie": batch.column(1), "z": pa.array([z.compress(utf8(t.as_py())) for t in batch.column(2)], pa.binary())})


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import zstandard

    z = zstandard.ZstdDecompressor()
    for batch in batches:
        for doc, tie, body, at in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3).to_pylist()):
            data = z.decompress(body.as_py())
            for k in range(0, len(at), 10_000):
                own = at[k : k + 10_000]
                yield pa.RecordBatch.from_pydict({"key": pa.array([x["key"] for x in own], pa.int64()), "doc": pa.array([doc] * len(own), pa.int64()), "tie": pa.array([tie] * len(own), pa.int32()), "pos": pa.array([x["pos"] for x in own], pa.int64()), "part": pa.array([data[x["pos"] : x["pos"] + x["n"] + LENGTH - 1] for x in own], pa.binary()), "core": pa.array([-1] * len(own), pa.int32()), "width": pa.array([ANCHOR] * len(own), pa.int32())})


#: Segments with their bytes; core and width: where the bytes that all their strings hold are, or -1 for the anchor.
PART = "key long, doc long, tie int, pos long, part binary, core int, width int"


def finer(key: int, part: bytes, core: int, width: int) -> Iterator[tuple[int, int, int, int, int]]:
    """key, from, to, core, width of the pieces of a segment whose strings share more bytes: core and the next STEP bytes, or whole strings."""
    import xxhash

    if core < 0:
        core = int(np.flatnonzero(_window_hashes(np.frombuffer(part, np.uint8))[0].view(np.int64) == key)[0])
    low, end, count = key.to_bytes(8, "little", signed=True), core + width, len(part) - LENGTH + 1
    number = lambda side, more: xxhash.xxh3_64_intdigest(low + side + more) - (1 << 63)
    if width + 2 * STEP > LENGTH:
        for k in range(count):
            yield number(b"=", part[k : k + LENGTH]), k, k + LENGTH, 0, LENGTH
        return
    split = min(count, max(0, end + STEP - LENGTH))  # strings from here on have STEP bytes right of the core
    if split < count:
        yield number(b">", part[end : end + STEP]), split, len(part), core - split, width + STEP
    if split:
        yield number(b"<", part[core - STEP : core]), 0, split - 1 + LENGTH, core - STEP, width + STEP


def _finer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for a in range(0, whole.num_rows, 2000):
            rows = [(k, d, t, p + x, body[x:y], c, w) for key, d, t, p, body, core, width in zip(*(c.to_pylist() for c in whole.slice(a, 2000).columns)) for k, x, y, c, w in finer(key, body, core, width)]
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.int32(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows), kinds)], names=["key", "doc", "tie", "pos", "part", "core", "width"])


def _late() -> Column:
    return (F.col("doc") != F.col("f.doc")) | (F.col("pos") != F.col("f.pos")) | (F.col("tie") != F.col("f.tie"))


def repeated_spans(base: DataFrame, chunk: int = CHUNK, block: int = BLOCK) -> DataFrame:
    """doc, tie, start, stop: spans to remove, other than repeats inside a document. base: doc, tie, text."""
    rows = base.mapInArrow(_segment_rows, SEGMENT)
    anchors = rows.groupBy("anchor").agg(F.count("*").alias("c"), F.min("content").alias("a"), F.max("content").alias("b")).where("c > 1")
    anchors = cut(anchors.select("anchor", (F.col("a") != F.col("b")).alias("several")))
    found = cut(rows.join(anchors, "anchor"))
    firsts = cut(found.groupBy("anchor", "content").agg(F.min(F.struct("doc", "pos", "tie", "n")).alias("f"), F.max("several").alias("several")))
    whole = found.drop("several").join(firsts.select("anchor", "content", "f"), ["anchor", "content"]).where(_late())
    spans = whole.select("doc", "tie", F.col("pos").alias("start"), (F.col("pos") + F.col("n") + (LENGTH - 1)).alias("stop"))
    wanted = firsts.where("several").select(F.col("anchor").alias("key"), "f.doc", "f.tie", "f.pos", F.col("f.n").cast("long").alias("n"))
    total = wanted.count()
    if not total:
        return spans
    by_doc = wanted.groupBy("doc", "tie").agg(F.collect_list(F.struct("key", "pos", "n")).alias("at"))
    squeezed = base.mapInArrow(_squeeze, "doc long, tie int, z binary")
    parts = squeezed.join(by_doc, ["doc", "tie"]).select("doc", "tie", "z", "at").mapInArrow(_slices, PART)
    small: DataFrame | None = None
    while True:
        hot = cut(wanted.groupBy("key").count().where(F.col("count") > chunk).select("key"))
        if hot.isEmpty():
            small = parts if small is None else small.unionByName(parts)
            break
        if small is None:
            parts = cut(parts)
        rest = parts.join(hot, "key", "left_anti")
        small = rest if small is None else small.unionByName(rest)
        rows = cut(parts.join(hot, "key", "left_semi").select("key", "doc", "tie", "pos", "part", "core", "width").mapInArrow(_finer, PART))
        kinds = cut(rows.groupBy("key", "part").agg(F.min(F.struct("doc", "pos", "tie")).alias("f"), F.first("core").alias("core"), F.first("width").alias("width")))
        late = rows.join(kinds.select("key", "part", "f"), ["key", "part"]).where(_late())
        spans = spans.unionByName(late.select("doc", "tie", F.col("pos").alias("start"), (F.col("pos") + F.octet_length("part")).alias("stop")))
        wanted = parts = kinds.select("key", "f.doc", "f.tie", "f.pos", "part", "core", "width")
        total += parts.count()
    number = F.pmod(F.xxhash64("key"), F.lit(-(-total // block))).alias("block")
    # a piece that is one string has a key of its own
    blocks = small.where(F.col("width") < LENGTH).select("key", "doc", "tie", "pos", "part", "core").groupBy(number)
    return spans.unionByName(blocks.applyInArrow(lambda key, t: _earlier(t), "doc long, tie int, start long, stop long"))


def _merged(start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union of spans as maximal ones, ascending."""
    order = np.argsort(start, kind="stable")
    start, stop = start[order], np.maximum.accumulate(stop[order])
    opens = np.ones(len(start), bool)
    opens[1:] = start[1:] > stop[:-1]
    return start[opens], stop[np.append(np.flatnonzero(opens)[1:] - 1, len(start) - 1)[: int(opens.sum())]]


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[tuple[bytes, list[bytes], int]]]]:
    """Batches (doc, tie, z, starts, stops, ...) with each document's bytes, its pieces that stay and its removed runs."""
    import zstandard

    z = zstandard.ZstdDecompressor()
    for whole in batches:
        for a in range(0, whole.num_rows, 500):
            batch = whole.slice(a, 500)
            datas = [z.decompress(b.as_py()) for b in batch.column("z")]
            own = _repeats_inside(datas)
            out = []
            for data, (s, e), starts, stops in zip(datas, own, batch.column("starts"), batch.column("stops")):
                if starts.is_valid:
                    s, e = np.append(s, np.asarray(starts.values)), np.append(e, np.asarray(stops.values))
                s, e = _merged(s, e)
                cuts = [0, *np.stack([s, e], 1).ravel().tolist(), len(data)]
                out.append((data, [data[x:y] for x, y in zip(cuts[::2], cuts[1::2])], len(s)))
            yield batch, out


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, rows in _kept(batches):
        size = [sum(map(len, pieces)) for _, pieces, _ in rows]
        yield pa.RecordBatch.from_pydict({
            "doc_id": pa.array([None if d == NO_ID else d for d in batch.column("doc").to_pylist()], pa.int64()),
            "n_bytes": pa.array([len(data) for data, _, _ in rows], pa.int64()),
            "n_removed": pa.array([len(data) - n for (data, _, _), n in zip(rows, size)], pa.int64()),
            "n_spans": pa.array([n for _, _, n in rows], pa.int64()),
            "kept_sha256": pa.array([hashlib.sha256(b"".join(pieces)).hexdigest() for _, pieces, _ in rows]),
        })


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, rows in _kept(batches):
        changed = [n > 0 for _, _, n in rows]
        texts = [b"".join(pieces).decode("utf-8", "ignore") if c else None for (_, pieces, _), c in zip(rows, changed)]
        keep = [k for k, c in enumerate(changed) if c]
        if keep:
            yield pa.RecordBatch.from_pydict({"doc": batch.column("doc").take(pa.array(keep)), "tie": batch.column("tie").take(pa.array(keep)), "left": pa.array([texts[k] for k in keep], pa.string())})


def _with_spans(base: DataFrame, chunk: int, block: int) -> DataFrame:
    spans = cut(repeated_spans(base, chunk, block))
    by_doc = spans.groupBy("doc", "tie").agg(F.collect_list(F.struct("start", "stop")).alias("at"))
    by_doc = by_doc.select("doc", "tie", F.col("at.start").alias("starts"), F.col("at.stop").alias("stops"))
    return base.mapInArrow(_squeeze, "doc long, tie int, z binary").join(by_doc, ["doc", "tie"], "left").select("doc", "tie", "z", "starts", "stops")


def measure(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", chunk: int = CHUNK, block: int = BLOCK) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for every row of docs."""
    return _with_spans(_keyed(docs, doc_id, text), chunk, block).mapInArrow(_digests, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def deduplicate(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", chunk: int = CHUNK, block: int = BLOCK) -> DataFrame:
    """The rows of docs with what is left of their texts; characters cut apart go, and so do rows that lose everything."""
    base = _keyed(docs, doc_id, text)
    changed = cut(_with_spans(base, chunk, block).mapInArrow(_texts, "doc long, tie int, left string")).dropDuplicates(["doc", "tie"])
    # the caller's columns travel in one struct, so none can clash with ours
    held = docs.select(F.struct("*").alias("row"), F.coalesce(F.col(f"`{doc_id}`").cast("long"), F.lit(NO_ID)).alias("doc"), F.hash(F.col(f"`{text}`")).alias("tie"))
    out = held.join(changed, ["doc", "tie"], "left").where("left IS NULL OR left <> ''")
    left = F.coalesce("left", F.col("row").getField(text))
    columns = [left.alias(c) if c == text else F.char_length(left).cast(t).alias(c) if c == "n_chars" else F.col("row").getField(c).alias(c) for c, t in docs.dtypes]
    return out.select(*columns)


#: measure() in SQL, by the hash of every string of 100 bytes.
ORACLE = r"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, CAST(strlen(coalesce(text, '')) AS BIGINT) AS n FROM documents),
w AS (SELECT doc_id, i, md5_number(substr(h, 2 * i + 1, 200)) AS s FROM (SELECT doc_id, h, unnest(range(0, n - 99)) AS i FROM d WHERE n >= 100)),
late AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY s ORDER BY doc_id, i) AS k FROM w) WHERE k > 1),
o AS (SELECT doc_id, i, CASE WHEN i > lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 100 THEN 1 ELSE 0 END AS jump FROM late),
r AS (SELECT doc_id, min(i) AS a, max(i) + 100 AS b FROM (SELECT doc_id, i, sum(jump) OVER (PARTITION BY doc_id ORDER BY i) AS g FROM o) GROUP BY doc_id, g),
k AS (SELECT doc_id, count(*) AS n_spans, sum(b - a) AS n_removed, list(a ORDER BY a) AS starts, list(b ORDER BY a) AS stops FROM r GROUP BY doc_id)
SELECT d.doc_id, n AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
  sha256(unhex(CASE WHEN n_spans IS NULL THEN h ELSE array_to_string(list_transform(range(0, n_spans + 1), lambda j: substr(h, CASE WHEN j = 0 THEN 1 ELSE 2 * stops[j] + 1 END, CASE WHEN j = n_spans THEN 2 * n ELSE 2 * starts[j + 1] END - CASE WHEN j = 0 THEN 0 ELSE 2 * stops[j] END)), '') END)) AS kept_sha256
FROM d LEFT JOIN k USING (doc_id)
"""
