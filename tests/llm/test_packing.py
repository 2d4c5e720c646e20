import random
import re
import zlib

import duckdb
import numpy as np
import pytest
from tokenizers import Tokenizer

from tessera.llm import packing


def check(rows, docs, capacity, end_id=1):
    """Every id in one piece, pieces gapless in sequences, checksums right. docs: list of (doc_id, text)."""
    tok = Tokenizer.from_file(packing.vocabulary_path("byte_bpe_50k.json"))
    ids = {d: np.array([*tok.encode(t or "", add_special_tokens=False).ids, end_id], "<u4") for d, t in docs}
    by_doc, by_seq = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_seq.setdefault(r["sequence_id"], []).append(r)
    assert set(by_doc) == set(ids)
    for d, own in by_doc.items():
        at = 0
        for r in sorted(own, key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids[d]) and r["length"] > 0
            assert r["ids_crc32"] == zlib.crc32(ids[d][at : at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(ids[d])
    fill = []
    for own in by_seq.values():
        at = 0
        for r in sorted(own, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= capacity
        fill.append(at)
    return fill


def test_round_trip(spark):
    rng = random.Random(1)
    docs = [(i, " ".join(rng.choices(["word", "été", "<|endoftext|>", "x1", "\n", "的"], k=rng.choice([0, 1, 5, 80, 700])))) for i in range(60)] + [(100, None), (101, ""), (102, "long " * 20_000)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    rows = packing.pack(df, capacity=256).collect()
    fill = check(rows, docs, 256)
    assert sum(f < 256 for f in fill) <= 3  # one partly filled sequence a task at most
    rows = packing.pack(df).collect()
    assert sum(f < 2048 for f in check(rows, docs, 2048)) <= 3


def test_places_by_sum_of_squares():
    rng = random.Random(2)
    for capacity in (5, 12, 30):
        state = packing.SumOfSquares(capacity, 0)
        levels = {}
        for _ in range(400):
            size = rng.randint(1, capacity)
            count = np.zeros(capacity + 1, int)
            for f in levels.values():
                count[f] += 1

            def cost(level):
                n = count.copy()
                if level:
                    n[level] -= 1
                if level + size < capacity:
                    n[level + size] += 1
                return int((n[1:capacity] ** 2).sum())

            options = {0, *(f for f in levels.values() if f + size <= capacity)}
            best = min(cost(o) for o in options)
            seq, offset, full = state.place(size)
            assert cost(offset) == best and levels.get(seq, 0) == offset and full == (offset + size == capacity)
            if full:
                levels.pop(seq, None)
            else:
                levels[seq] = offset + size


def test_encoder_is_the_library(sf_dir):
    e = packing.Encoder(packing.vocabulary_path("byte_bpe_50k.json"))
    rng = random.Random(3)
    texts = ["".join(rng.choices("aB é'st\n\t 12的😀ก߀\u0558<|endoftext|>", k=rng.randint(0, 60))) for _ in range(400)]
    texts += ["a<|endoftext|>b", "\ud7a3\ufeff x\u00a0\u2028 y", "  lead", "trail \n "]
    texts += [r for (r,) in duckdb.sql("SELECT coalesce(text, '') FROM '/root/testdata/sf0.01/documents.parquet'").fetchall()]
    for text in texts:
        assert e(text).tolist() == e.library.encode(text, add_special_tokens=False).ids


def test_both_libraries_agree_on_the_vocabulary_and_its_code_points():
    """Every token by itself and beside another, and every code point of the fast way after a letter, a number and another sign."""
    e = packing.Encoder(packing.vocabulary_path("byte_bpe_50k.json"))
    inside = re.compile(f"[{packing.AGREED}]")
    agreed = [c for c in map(chr, range(0x110000)) if inside.match(c)]
    assert len(agreed) > 35_000
    texts = ["".join(f"a{c}1{c}!{c}" for c in agreed[a : a + 50]) for a in range(0, len(agreed), 50)]
    tokens = [e.library.decode([i]) for i in range(e.library.get_vocab_size())]
    tokens = [t for t in tokens if not e.odd.search(t)]
    assert len(tokens) > 45_000
    rng = random.Random(5)
    texts += tokens + [a + b for a, b in zip(tokens, rng.sample(tokens, len(tokens)))]
    for got, want in zip(map(e.fast.encode_ordinary, texts), e.library.encode_batch(texts, add_special_tokens=False)):
        assert got == want.ids


@pytest.mark.parametrize("room", [1, 3, 1024])
def test_open_sequences_are_bounded(room):
    rng = np.random.default_rng(2)
    p = packing.Packer(64, 1, 0, room)
    docs = {d: rng.integers(0, 50_000, rng.integers(0, 90)).astype("<u4") for d in range(300)}
    rows = []
    for d, ids in docs.items():
        p.add(d, ids)
        assert len(p.held) == p.state.count.sum() <= room
        out = p.take()
        rows += zip(*out.values()) if out else []
    p.finish()
    rows += list(zip(*p.take().values()))
    fill, got = {}, {}
    for d, start, n, crc, total, seq, offset in sorted(rows, key=lambda r: (r[5], r[6])):
        assert fill.get(seq, 0) == offset
        fill[seq] = offset + n
        got.setdefault(d, []).append((start, n, crc, total))
    assert sum(f < 64 for f in fill.values()) <= 1 and max(fill.values()) == 64
    for d, ids in docs.items():
        whole, at = np.append(ids, np.uint32(1)).astype("<u4"), 0
        for start, n, crc, total in sorted(got[d]):
            assert start == at and total == len(whole) and crc == zlib.crc32(whole[at : at + n].tobytes())
            at += n
        assert at == len(whole)


@pytest.mark.parametrize("rows", [[], [(None, "a", 1, "x"), (1, "same", 1, "x"), (1, "same", 1, "x")]])
def test_edge_cases(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string, start int, offset string")
    got = packing.pack(df).collect()
    assert len(got) == len(rows)
