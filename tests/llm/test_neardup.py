import random
import re

import numpy as np
import pytest

from tessera.llm import neardup

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, width):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOW))
    return frozenset([tuple(w)] if 0 < len(w) < width else (tuple(w[i : i + width]) for i in range(len(w) - width + 1)))


def brute(docs, width, percent=80):
    """doc_id -> (size, component), by all pairs. docs: {doc_id: text}."""
    sets = {d: shingles(t, width) for d, t in docs.items()}
    parent = {d: d for d in docs}

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    ids = sorted(docs)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                p, q = find(a), find(b)
                parent[max(p, q)] = min(p, q)
    return {d: (len(sets[d]), find(d)) for d in docs}


def corpus(seed, n=120):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    docs = {}
    for d in range(n):
        kind = rng.random()
        if docs and kind < 0.6:
            text = docs[rng.choice(list(docs))].split(" ")
            for _ in range(rng.choice([0, 1, 2, 6, 12])):
                if text:
                    text[rng.randrange(len(text))] = rng.choice(words)
            docs[d] = " ".join(text)
        elif kind < 0.7:
            docs[d] = " ".join(rng.choices(words, k=rng.randint(0, 4)))
        else:
            docs[d] = " ".join(rng.choices(words, k=rng.randint(20, 90)))
    return docs


def frame(spark, docs, parts=3):
    return spark.createDataFrame(list(docs.items()), "doc_id long, text string").repartition(parts)


@pytest.mark.parametrize("width", [2, 5])
def test_against_all_pairs(spark, width):
    docs = corpus(width)
    docs[500], docs[501], docs[502] = "", None, " \t\n"
    docs[503] = docs[0].upper()
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in neardup.components(frame(spark, docs), width=width).collect()}
    want = {d: (n, c, c == d) for d, (n, c) in brute(docs, width).items()}
    assert got == want


def test_chains_of_near_copies(spark):
    """Each copy differs from the next by one word: the ends are no near copies, yet one component; copies of several bases share shingles."""
    base = [f"w{i}" for i in range(60)]
    docs = {}
    for d in range(40):
        own = base[:]
        own[: d // 2] = [f"x{i}" for i in range(d // 2)]
        docs[100 + d] = " ".join(own)
    got = {r["doc_id"]: r["component_id"] for r in neardup.components(frame(spark, docs), width=2).collect()}
    assert got == {d: c for d, (_, c) in brute(docs, 2).items()}


def test_blocks_of_a_large_bucket(spark):
    """Links inside a bucket beyond those to its smallest id are found across blocks."""
    import pyarrow as pa

    docs = corpus(9, 60)
    sets = {d: neardup.shingle_hashes((t or "").encode().split(), 2) for d, t in docs.items()}
    full = [d for d in docs if len(sets[d])]
    sketch = neardup.sketches([sets[d] for d in full])
    import zstandard

    z = zstandard.ZstdCompressor(1)
    n = len(full)
    rows = [(side, k) for side in (0, 1) for k in range(n)]
    batch = pa.RecordBatch.from_pydict({
        "key": pa.array([1] * len(rows), pa.int64()), "xc": pa.array([0] * len(rows), pa.int32()), "yc": pa.array([0] * len(rows), pa.int32()), "side": pa.array([r[0] for r in rows], pa.int32()),
        "doc_id": pa.array([full[r[1]] for r in rows], pa.int64()), "comp": pa.array([full[r[1]] for r in rows], pa.int64()), "n": pa.array([len(sets[full[r[1]]]) for r in rows], pa.int64()),
        "sketch": pa.array([neardup.mix(sketch[r[1]]).astype(np.uint8).tobytes() for r in rows], pa.binary()), "z": pa.array([z.compress(docs[full[r[1]]].encode()) for r in rows], pa.binary()),
    })
    links = [(a, b) for out in neardup._across(2, 80)(iter([batch])) for a, b in zip(out.column("a").to_pylist(), out.column("b").to_pylist())]
    parent = {d: d for d in full}

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for a, b in links:
        p, q = find(a), find(b)
        parent[max(p, q)] = min(p, q)
    assert {d: find(d) for d in full} == {d: c for d, (_, c) in brute({d: docs[d] for d in full}, 2).items()}


def test_sketch_estimates_and_fills():
    rng = np.random.default_rng(1)
    for size in (1, 3, 40, 3000):
        a = np.unique(rng.integers(0, 1 << 63, size).astype(np.uint64))
        s = neardup.sketches([a])
        assert (s != np.iinfo(np.uint64).max).all()
    shared, own = rng.integers(0, 1 << 63, 800).astype(np.uint64), rng.integers(0, 1 << 63, 200).astype(np.uint64)
    x, y = neardup.sketches([np.unique(np.concatenate([shared, own[:100]])), np.unique(np.concatenate([shared, own[100:]]))])
    assert abs((x == y).mean() - 0.8) < 0.12


def test_edge_cases(spark):
    schema = "doc_id long, text string, n int, print string, bands int, key int, rep int, node int, comp int, z int"
    extra = (1, "p", 2, 3, 4, 5, 6, 7)
    rows = [(7, "a b c d e f", *extra), (7, "a b c d e f", *extra), (3, "a b c d e f", *extra), (None, "a b c d e f", *extra), (9, None, *extra), (1, "solo", *extra), (2, "solo", *extra)]
    df = spark.createDataFrame(rows, schema)
    got = sorted((r["doc_id"] or -1, r["component_id"], r["kept"]) for r in neardup.components(df).collect())
    assert got == [(-1, None, True), (1, 1, True), (2, 1, False), (3, 3, True), (7, 3, False), (7, 3, False), (9, 9, True)]
    kept = neardup.deduplicate(df)
    assert kept.columns == df.columns and sorted(r["doc_id"] or -1 for r in kept.collect()) == [-1, 1, 3, 9]
    empty = spark.createDataFrame([], schema)
    assert neardup.components(empty).count() == 0 and neardup.deduplicate(empty).count() == 0


def test_very_long_text(spark):
    rng = random.Random(4)
    long = " ".join(rng.choices([f"w{i}" for i in range(5000)], k=200_000))
    docs = {1: long, 2: long + " tail", 3: " ".join(reversed(long.split(" ")))}
    got = {r["doc_id"]: r["component_id"] for r in neardup.components(frame(spark, docs)).collect()}
    assert got == {1: 1, 2: 1, 3: 3}
