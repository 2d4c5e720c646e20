"""Near-duplicate documents by MinHash over word shingles, with exact verification.

Sketch: fast similarity sketching. Round i < t throws every shingle into one of t bins by its own hash function, an
earlier round beating a later one; rounds t to 2t - 1 give every shingle to bin i - t, so that every coordinate is filled
at the latest then. The share of equal coordinates estimates the Jaccard similarity as closely as t independent
permutations would. Bands of ROWS coordinates make buckets; BANDS = 32 of 4 miss a pair at similarity 0.8 with
probability (1 - 0.8^4)^32 < 5e-8.

Documents with the same shingle set are one class from the start. Links between classes are confirmed on the full sets:
first every member of a bucket against the bucket's smallest id (a star: linear in the bucket), then, in buckets that
still hold several components, the members outside its largest component against all others, in blocks of bounded size
inside which only links that join two components are returned. Pairs are never listed; components are found by repeated
contraction of the links in Spark.

Edge cases: texts without words, empty or null, have an empty set and link with nothing; texts of fewer words than a
shingle have their whole sequence as the one shingle; a null id stays alone; repeated ids are one document; an empty
table gives no rows; texts of any length are shingled whole; of equal sizes or counts the smaller id goes first; extra
columns, whatever their names, are not read by components() and are carried by deduplicate().
"""

from __future__ import annotations

import math
from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, mix, utf8, words_of

BANDS, ROWS = 32, 4
T = BANDS * ROWS
#: Rows of a bucket that meet in one block are at most about twice this.
CHUNK = 1024
_SEED = np.uint64(0x9E3779B97F4A7C15)


def shingle_hashes(words: list[bytes], width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the width-word shingles of a document."""
    import xxhash

    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    k = min(width, len(h))
    n = len(h) - k + 1
    x = np.full(n, k, np.uint64)  # a short sequence differs from every shingle
    for j in range(k):
        x = mix(x ^ h[j : j + n]) + _SEED
    return np.unique(x)


def sketches(sets: list[np.ndarray], t: int = T) -> np.ndarray:
    """Fast similarity sketches, one row for each non-empty set."""
    size = np.array([len(s) for s in sets], np.int64)
    out = np.full(len(sets) * t, np.iinfo(np.uint64).max, np.uint64)
    x = np.concatenate(sets) if len(sets) else np.zeros(0, np.uint64)
    row = np.repeat(np.arange(len(sets)), size)
    for i in range(2 * t):
        if not len(x):
            break
        h = mix(x ^ mix(np.full(1, i + 1, np.uint64) * _SEED))
        at = (h % np.uint64(t)).astype(np.int64) if i < t else i - t
        np.minimum.at(out, row * t + at, (np.uint64(i) << np.uint64(55)) | (h >> np.uint64(9)))
        open_rows = (out.reshape(-1, t) == np.iinfo(np.uint64).max).any(1)
        keep = open_rows[row]
        if not keep.all():
            x, row = x[keep], row[keep]
    return out.reshape(-1, t)


def _sketch(width: int):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for whole in batches:
            for a in range(0, whole.num_rows, 1000):
                batch = whole.slice(a, 1000)
                sets = [shingle_hashes(words_of(t.as_py()), width) for t in batch.column(1)]
                full = [i for i, s in enumerate(sets) if len(s)]
                s = sketches([sets[i] for i in full])
                band = np.zeros((len(full), BANDS), np.uint64) + np.arange(1, BANDS + 1, dtype=np.uint64)
                for r in range(ROWS):
                    band = mix(band ^ s[:, r::ROWS]) + _SEED
                short = mix(s).astype(np.uint8)
                bands: list = [None] * len(sets)
                brief: list = [None] * len(sets)
                for k, i in enumerate(full):
                    bands[i], brief[i] = band[k].view(np.int64), short[k].tobytes()
                prints = [xxhash.xxh3_128_digest(x.tobytes()) if len(x) else None for x in sets]
                yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0), "n": pa.array([len(x) for x in sets], pa.int64()), "print": pa.array(prints, pa.binary()), "bands": pa.array(bands, pa.list_(pa.int64())), "sketch": pa.array(brief, pa.binary())})

    return task


def _squeeze(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import zstandard

    z = zstandard.ZstdCompressor(1)
    for batch in batches:
        for a in range(0, batch.num_rows, 2000):
            own = batch.slice(a, 2000)
            yield pa.RecordBatch.from_pydict({"doc_id": own.column(0), "z": pa.array([z.compress(utf8(t.as_py())) for t in own.column(1)], pa.binary())})


class _Sets:
    """Shingle sets of compressed texts, the latest kept."""

    def __init__(self, width: int, room: int = 256) -> None:
        import zstandard

        self.z, self.width, self.room, self.kept = zstandard.ZstdDecompressor(), width, room, OrderedDict()

    def __call__(self, doc_id: int, body) -> np.ndarray:
        if doc_id not in self.kept:
            self.kept[doc_id] = shingle_hashes(self.z.decompress(body.as_py()).lower().split(), self.width)
            if len(self.kept) > self.room:
                self.kept.popitem(last=False)
        self.kept.move_to_end(doc_id)
        return self.kept[doc_id]


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """100 * intersection >= percent * union of two sorted sets."""
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    both = np.concatenate([a, b])
    both.sort()
    same = int((both[1:] == both[:-1]).sum())
    return 100 * same >= percent * (len(both) - same)


def _verify(width: int, percent: int):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets = _Sets(width)
        for batch in batches:
            a, b = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            good = [linked(sets(x, zx), sets(y, zy), percent) for x, y, zx, zy in zip(a, b, batch.column(2), batch.column(3))]
            yield pa.RecordBatch.from_pydict({"a": pa.array([x for x, g in zip(a, good) if g], pa.int64()), "b": pa.array([x for x, g in zip(b, good) if g], pa.int64())})

    return task


def _runs(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """Consecutive rows with equal first columns; the rows come sorted by these."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        key = np.stack([np.asarray(batch.column(k)) for k in range(keys)], 1)
        cuts = [0, *(np.flatnonzero((key[1:] != key[:-1]).any(1)) + 1).tolist(), len(key)]
        for s, e in zip(cuts, cuts[1:]):
            now = tuple(key[s].tolist())
            if last is not None and now != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(s, e - s))
            last = now
    if held:
        yield pa.Table.from_batches(held)


def _across(width: int, percent: int):
    """Links between different components inside one block, as few as join what can be joined."""
    least = percent / 100 - 5.5 * math.sqrt(percent / 100 * (1 - percent / 100) / T)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets = _Sets(width, 3 * CHUNK)
        for t in _runs(batches, 3):
            side, doc, comp, n = (np.asarray(t.column(k)) for k in range(3, 7))
            sketch = np.frombuffer(b"".join(t.column(7).to_pylist()), np.uint8).reshape(len(doc), T)
            body = t.column(8)
            parent: dict[int, int] = {}

            def root(c: int) -> int:
                while (p := parent.get(c, c)) != c:
                    c = p
                return c

            xs, found = np.flatnonzero(side == 0), []
            for y in np.flatnonzero(side == 1).tolist():
                near = (sketch[xs] == sketch[y]).mean(1)
                fits = (near >= least) & (comp[xs] != comp[y]) & (100 * np.minimum(n[xs], n[y]) >= percent * np.maximum(n[xs], n[y]))
                own = np.flatnonzero(fits)
                for x in xs[own[np.argsort(-near[own], kind="stable")]].tolist():
                    a, b = root(int(comp[x])), root(int(comp[y]))
                    if a != b and linked(sets(int(doc[x]), body[x]), sets(int(doc[y]), body[y]), percent):
                        parent[max(a, b)] = min(a, b)
                        found.append((int(doc[x]), int(doc[y])))
            if found:
                yield pa.RecordBatch.from_pydict({"a": pa.array([f[0] for f in found], pa.int64()), "b": pa.array([f[1] for f in found], pa.int64())})

    return task


def connected(edges: DataFrame) -> DataFrame:
    """node, comp (smallest node of its component) of every node that has an edge (a, b).

    Every round hooks each node to its smallest neighbour, halves the paths, and contracts; a few rounds suffice.
    """
    now = cut(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct())
    comps: DataFrame | None = None
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hook = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("p")).select("node", F.least("node", "p").alias("p"))
        far = hook.select(F.col("node").alias("p"), F.col("p").alias("pp"))
        hook = cut(hook.join(far, "p", "left").select("node", F.coalesce("pp", "p").alias("p")))
        if comps is None:
            comps = hook.select("node", F.col("p").alias("comp"))
        else:
            comps = comps.join(hook.select(F.col("node").alias("comp"), "p"), "comp", "left").select("node", F.coalesce("p", "comp").alias("comp"))
        to = hook.select(F.col("node").alias("b"), F.col("p").alias("pb"))
        now = now.join(hook.select(F.col("node").alias("a"), F.col("p").alias("pa")), "a").join(to, "b")
        now = cut(now.select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).where("a <> b").distinct())
        comps = cut(comps)
        if now.isEmpty():
            return comps


def components(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row."""
    base = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    marked = cut(base.mapInArrow(_sketch(width), "doc_id long, n long, print binary, bands array<long>, sketch binary"))
    there = marked.where("n > 0 AND doc_id IS NOT NULL")
    classes = cut(there.groupBy("print", "n").agg(F.min("doc_id").alias("rep")))
    # one row of each class goes on, with what its sketch says
    reps = there.join(classes.select("rep", F.col("print").alias("rp")), (F.col("doc_id") == F.col("rep")) & (F.col("print") == F.col("rp"))).select("doc_id", "n", "bands", "sketch").dropDuplicates(["doc_id"])
    reps = cut(reps)
    banded = reps.select("doc_id", F.explode("bands").alias("key"))
    many = banded.groupBy("key").agg(F.count("*").alias("size"), F.min("doc_id").alias("pivot")).where("size > 1")
    # both sides of the join are written tables, so that a key with very many rows can be split
    many = cut(many)
    members = cut(banded.join(many, "key").select("key", "size", "pivot", "doc_id"))
    wanted = members.select("doc_id").distinct()
    texts = cut(base.mapInArrow(_squeeze, "doc_id long, z binary").join(wanted, "doc_id", "left_semi").dropDuplicates(["doc_id"]))
    star = members.where("doc_id <> pivot").select(F.col("pivot").alias("a"), F.col("doc_id").alias("b")).distinct()
    left, right = (texts.select(F.col("doc_id").alias(x), F.col("z").alias("z" + x)) for x in "ab")
    links = cut(star.join(right, "b").join(left, "a").select("a", "b", "za", "zb").mapInArrow(_verify(width, percent), "a long, b long"))
    comps = connected(links)
    # buckets that still hold several components, other than pairs, which are settled
    placed = members.where("size > 2").join(comps, members["doc_id"] == comps["node"], "left").select("key", "size", "doc_id", F.coalesce("comp", "doc_id").alias("comp"))
    by_comp = placed.groupBy("key", "comp").agg(F.count("*").alias("c"))
    mixed = by_comp.groupBy("key").agg(F.max_by("comp", F.struct("c", "comp")).alias("largest"), F.sum("c").alias("size"), F.max("c").alias("most")).where("most < size")
    mixed = mixed.select("key", "largest", F.ceil(F.col("size") / CHUNK).cast("int").alias("nx"), F.ceil((F.col("size") - F.col("most")) / CHUNK).cast("int").alias("ny"))
    rows = cut(placed.drop("size").join(cut(mixed), "key"))
    whole = rows.join(reps.select("doc_id", "n", "sketch"), "doc_id").join(texts, "doc_id")
    part = lambda n, salt: F.pmod(F.xxhash64("doc_id", F.lit(salt)), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    cols = ["key", "xc", "yc", "side", "doc_id", "comp", "n", "sketch", "z"]
    x = whole.select("*", part("nx", 1).alias("xc"), every("ny").alias("yc"), F.lit(0).alias("side")).select(*cols)
    y = whole.where("comp <> largest").select("*", part("ny", 2).alias("yc"), every("nx").alias("xc"), F.lit(1).alias("side")).select(*cols)
    blocks = x.unionByName(y).repartition("key", "xc", "yc").sortWithinPartitions("key", "xc", "yc")
    more = cut(blocks.mapInArrow(_across(width, percent), "a long, b long"))
    if not more.isEmpty():
        comps = connected(links.unionByName(more))
    # rows without words have their id as key, else all of them would meet as null in one task
    own = F.when(F.col("doc_id").isNotNull(), F.coalesce("print", F.col("doc_id").cast("string").cast("binary"))).alias("print")
    known = marked.select("doc_id", "n", own).join(classes, ["print", "n"], "left").join(comps, F.coalesce("rep", "doc_id") == F.col("node"), "left")
    component = F.coalesce("comp", "rep", "doc_id")
    return known.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), (F.col("doc_id").eqNullSafe(component)).alias("kept"))


def deduplicate(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs whose id is the smallest of its component, with all their columns; of repeated ids all rows stay."""
    gone = components(docs, doc_id, text, width, percent).where(~F.col("kept")).select("doc_id").distinct()
    # the caller's columns travel in one struct, so none can clash with ours
    held = docs.select(F.struct("*").alias("row"), F.col(f"`{doc_id}`").cast("long").alias("doc_id"))
    return held.join(gone, "doc_id", "left_anti").select(*(F.col("row").getField(c).alias(c) for c in docs.columns))


#: components() with two-word shingles in SQL; pairs come from prefix filtering, which loses no link of 80 percent or more.
ORACLE = r"""
WITH RECURSIVE d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS MATERIALIZED (SELECT DISTINCT doc_id, g FROM (SELECT doc_id, unnest(CASE WHEN len(w) = 1 THEN [w[1]] ELSE list_transform(range(1, len(w)), lambda i: w[i] || chr(32) || w[i + 1]) END) AS g FROM d WHERE len(w) > 0)),
c AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
f AS MATERIALIZED (SELECT g, count(*) AS df FROM s GROUP BY g),
p AS MATERIALIZED (SELECT doc_id, g FROM (SELECT doc_id, g, row_number() OVER (PARTITION BY doc_id ORDER BY df, g) AS k FROM s JOIN f USING (g)) JOIN c USING (doc_id) WHERE k <= n - CAST(ceil(0.8 * n) AS BIGINT) + 1),
cand AS MATERIALIZED (SELECT DISTINCT x.doc_id AS a, y.doc_id AS b FROM p x JOIN p y USING (g) JOIN c cx ON cx.doc_id = x.doc_id JOIN c cy ON cy.doc_id = y.doc_id WHERE x.doc_id < y.doc_id AND 100 * least(cx.n, cy.n) >= 80 * greatest(cx.n, cy.n)),
e AS MATERIALIZED (SELECT a, b FROM (SELECT a, b, count(*) AS n_both FROM cand JOIN s x ON x.doc_id = a JOIN s y ON y.doc_id = b AND y.g = x.g GROUP BY a, b) JOIN c ca ON ca.doc_id = a JOIN c cb ON cb.doc_id = b WHERE 100 * n_both >= 80 * (ca.n + cb.n - n_both)),
u AS MATERIALIZED (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r AS (SELECT doc_id AS a, doc_id AS root FROM d UNION SELECT u.b, r.root FROM r JOIN u ON u.a = r.a WHERE r.root < u.b)
SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, root AS component_id, root = d.doc_id AS kept FROM d LEFT JOIN c USING (doc_id) JOIN (SELECT a, min(root) AS root FROM r GROUP BY a) q ON q.a = d.doc_id
"""
