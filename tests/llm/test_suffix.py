import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest

from tessera.llm import suffix

N = suffix.LENGTH


def brute(docs):
    """doc_id -> (bytes, removed, spans, hash), by a dictionary of all strings. docs: (doc_id, bytes) with unique ids."""
    seen, out = set(), {}
    for d, x in sorted(docs):
        gone = np.zeros(len(x), bool)
        for k in range(len(x) - N + 1):
            if (s := x[k : k + N]) in seen:
                gone[k : k + N] = True
            seen.add(s)
        runs = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out[d] = (len(x), int(gone.sum()), runs, hashlib.sha256(np.frombuffer(x, np.uint8)[~gone].tobytes()).hexdigest())
    return out


def measured(spark, docs, parts=3, **how):
    df = spark.createDataFrame([(d, None if t is None else t) for d, t in docs], "doc_id long, text string").repartition(parts)
    return {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in suffix.measure(df, **how).collect()}


def corpus(seed, n=60):
    rng = random.Random(seed)
    text = lambda k: "".join(rng.choices("abcdeé \n", k=k))
    passages = [text(rng.choice([99, 100, 101, 150, 400])) for _ in range(8)]
    docs = []
    for d in range(n):
        parts = [text(rng.randint(0, 250))]
        for _ in range(rng.randint(0, 3)):
            p = rng.choice(passages)
            a = rng.randint(0, 30)
            parts += [p[a : len(p) - rng.randint(0, 30)], text(rng.choice([0, 1, 60]))]
        if rng.random() < 0.1:
            parts.append("ab" * rng.randint(40, 300))
        docs.append((d * 3 + 1, "".join(parts)))
    return docs


@pytest.mark.parametrize("how", [{}, {"chunk": 1, "block": 5}, {"chunk": 1 << 60}])
def test_against_all_strings(spark, how):
    docs = [*corpus(3), (1000, ""), (1001, None), (1002, "x" * 99), (1003, "x" * 100), (1004, "x" * 5000)]
    assert measured(spark, docs, **how) == brute([(d, (t or "").encode()) for d, t in docs])


def test_finer_pieces_cover_every_string_once():
    rng = random.Random(4)
    data = "".join(rng.choices("ab", k=3000)).encode()
    g = suffix.Segments([data])
    todo = [(int(a), data[p : p + n + N - 1], -1, suffix.ANCHOR) for a, p, n in zip(g.anchor.view(np.int64).tolist(), g.pos.tolist(), g.n.tolist())]
    while todo:
        key, part, core, width = todo.pop()
        pieces = list(suffix.finer(key, part, core, width))
        assert sorted(k for _, x, y, _, _ in pieces for k in range(x, y - N + 1)) == list(range(len(part) - N + 1))
        for k, x, y, c, w in pieces:
            assert 0 <= c and c >= y - x - N and c + w <= N and w > width  # every string of the piece holds the core
            if w < N:
                todo.append((k, part[x:y], c, w))


def test_only_what_can_repeat_is_transformed(monkeypatch):
    """Segments that share no more than their anchor's bytes stay out of the transform, and no repeat is lost by that."""
    rng = random.Random(8)
    text = lambda k: "".join(rng.choices("abcdefgh", k=k)).encode()
    anchor = text(suffix.ANCHOR)
    datas = [text(150) + anchor + text(150) for _ in range(40)]
    repeat = text(15) + anchor + text(90)
    datas += [text(20) + repeat + text(60), text(70) + repeat]
    rows = []
    for d, data in enumerate(datas):
        h = suffix._window_hashes(np.frombuffer(data, np.uint8))[0].view(np.int64)
        p = data.index(anchor)
        a, b = max(0, p - 68), min(len(data), p + 100)
        rows.append((int(h[p]), d, 0, a, data[a:b], -1))
    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.int32())
    table = pa.table([pa.array(list(c), k) for c, k in zip(zip(*rows), kinds)], names=["key", "doc", "tie", "pos", "part", "core"])
    seen, whole = [], suffix.shared_prefix_groups
    monkeypatch.setattr(suffix, "shared_prefix_groups", lambda parts, *a: seen.extend(parts) or whole(parts, *a))
    got = suffix._earlier(table).to_pylist()
    p = datas[41].index(repeat)
    assert len(got) == 1 and got[0]["doc"] == 41 and (got[0]["start"], got[0]["stop"]) == (p, p + 15 + N)
    assert 2 <= len(seen) <= 4
    lone = table.slice(0, 40)
    seen.clear()
    assert suffix._earlier(lone).num_rows == 0 and not seen


def test_order_of_ids_decides(spark):
    p = "".join(random.Random(1).choices("abcdefgh", k=300))
    got = measured(spark, [(5, "A" + p), (2, p + "B"), (9, p)])
    assert [got[d][1] for d in (2, 5, 9)] == [0, 300, 300]


@pytest.mark.parametrize("trial", range(6))
def test_groups_by_transform(trial):
    rng = random.Random(trial)
    for _ in range(30):
        length = rng.choice([1, 2, 4, 9])
        parts = [bytes(rng.choice(b"ab" if trial % 2 else b"abcdxyz\x00\xff") for _ in range(rng.randint(length, 40))) for _ in range(rng.randint(1, 10))]
        g, p, s = suffix.shared_prefix_groups(parts, length)
        got: dict = {}
        for a, b, c in zip(g.tolist(), p.tolist(), s.tolist()):
            got.setdefault(a, set()).add((b, c))
        want: dict = {}
        for i, x in enumerate(parts):
            for k in range(len(x) - length + 1):
                want.setdefault(x[k : k + length], set()).add((i, k))
        assert sorted(map(sorted, got.values())) == sorted(sorted(v) for v in want.values() if len(v) > 1)


def test_suffix_array_and_wavelet():
    rng = random.Random(2)
    for _ in range(50):
        parts = [bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 30))) for _ in range(rng.randint(1, 6))]
        text = b"".join(p + b"\0" for p in parts)
        ends = np.cumsum([len(p) + 1 for p in parts]) - 1
        # terminators as symbols of their own below all bytes
        symbols = [int(np.searchsorted(ends, i)) if i in ends else 100 + c for i, c in enumerate(text)]
        want = sorted(range(len(text)), key=lambda i: symbols[i:])
        assert suffix.suffix_array(np.array([0 if i in ends else c - 96 for i, c in enumerate(text)])).tolist() == want
    seq = np.array([rng.randrange(5) for _ in range(200)])
    tree = suffix.Wavelet(seq, 5)
    for _ in range(50):
        lo, hi = sorted((rng.randint(0, 200), rng.randint(0, 200)))
        if lo == hi:
            continue
        symbol, a, b = tree.extend(np.array([lo]), np.array([hi]))
        assert {(int(c), int(x), int(y)) for c, x, y in zip(symbol, a, b)} == {(c, int((seq[:lo] == c).sum()), int((seq[:hi] == c).sum())) for c in set(seq[lo:hi].tolist())}


def test_long_documents_in_strides(monkeypatch):
    """Segments of a document longer than a stride cover the same starts."""
    data = "".join(random.Random(5).choices("abc", k=5000)).encode()
    whole = suffix.Segments([data])
    monkeypatch.setattr(suffix, "STRIDE", 700)
    cut = suffix.Segments([data])
    cover = lambda g: sorted(i for s, n in zip(g.pos.tolist(), g.n.tolist()) for i in range(s, s + n))
    assert cover(whole) == cover(cut) == list(range(len(data) - N + 1))


def test_very_long_text(spark):
    rng = random.Random(6)
    long = "".join(rng.choices("abcdefghij ", k=suffix.STRIDE + 70_000))
    docs = [(1, long), (2, "zz" + long[suffix.STRIDE - 500 : suffix.STRIDE + 500]), (3, long)]
    got = measured(spark, docs)
    assert [got[d][1] for d in (1, 2, 3)] == [0, 1000, len(long)]


def test_repeated_ids_and_null_ids(spark):
    p = "".join(random.Random(1).choices("abcdefgh", k=300))
    df = spark.createDataFrame([(4, p), (4, p), (None, p)], "doc_id long, text string")
    rows = sorted((r["doc_id"] or -1, r["n_removed"]) for r in suffix.measure(df).collect())
    assert rows == [(-1, 0), (4, 300), (4, 300)]
    twice = spark.createDataFrame([(4, p), (4, p)], "doc_id long, text string")
    assert [r["n_removed"] for r in suffix.measure(twice).collect()] == [0, 0]


def test_deduplicate(spark):
    p = "".join(random.Random(1).choices("abcdefgh", k=300))
    schema = "doc_id long, text string, lang string, source string, n_chars long, doc int, tie int, left int"
    rows = [(1, p, "en", "s", 300, 1, 2, 3), (2, "own é " + p + " end", None, None, 310, 1, 2, 3), (3, p, "en", "s", 300, 1, 2, 3), (4, None, "en", "s", None, 1, 2, 3), (5, "short", "en", "s", 5, 1, 2, 3)]
    df = spark.createDataFrame(rows, schema)
    out = suffix.deduplicate(df)
    assert out.columns == df.columns and out.dtypes == df.dtypes
    got = {r["doc_id"]: (r["text"], r["n_chars"]) for r in out.collect()}
    assert got == {1: (p, 300), 2: ("own é  end", 10), 4: (None, None), 5: ("short", 5)}
    empty = spark.createDataFrame([], schema)
    assert suffix.deduplicate(empty).count() == 0 and suffix.measure(empty).count() == 0
