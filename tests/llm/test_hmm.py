import math
import random
import re
import zlib
from collections import Counter
from itertools import product

import numpy as np
import pyarrow as pa
import pytest

from tessera.llm import hmm
from tessera.llm.common import words_of

SCHEMA = "doc_id long, text string"


def corpus(n=300, seed=1):
    """Runs of words of one topic each, so that the words before say something."""
    rng = random.Random(seed)
    topics = [[f"t{k}w{i}" for i in range(40)] for k in range(3)]
    out = []
    for d in range(n):
        words = []
        for _ in range(rng.randint(1, 3)):
            words += rng.choices(rng.choice(topics), k=rng.randint(5, 25))
        if rng.random() < 0.3:
            words.append(f"rare{rng.randrange(500)}")
        out.append((d, " ".join(words).replace("t1w1 ", "T1W1\n")))
    return out


def brute_base(docs):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    tokens = {d: [*re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(low)), "\n"] for d, t in docs}
    held = lambda d: zlib.crc32(str(d).encode()) % 10 == 0
    count = Counter(x for d, ts in tokens.items() if not held(d) for x in ts)
    n, v = sum(count.values()), len(count)
    return {d: (held(d), len(ts), sum(count[x] > 0 for x in ts), n, sum(math.log10((count[x] + 0.1) / (n + 0.1 * (v + 1))) for x in ts)) for d, ts in tokens.items()}


def test_base_and_gain(spark):
    docs = [*corpus(), (900, None), (901, ""), (902, "unseen words only here")]
    df = spark.createDataFrame(docs, SCHEMA).repartition(4)
    got = {r["doc_id"]: r for r in hmm.score_documents(df).collect()}
    want = brute_base(docs)
    for d, w in want.items():
        r = got[d]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == w[:4]
        assert r["base_score"] == pytest.approx(w[4], rel=1e-9)
        assert r["score"] < 0
    held = [r for r in got.values() if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held) + 50


def small_words(count=None, top=None):
    count = count or Counter({b"%d" % i: 10 - i for i in range(6)})
    total, distinct = np.zeros(hmm.HASHED, np.int64), np.zeros(hmm.HASHED, np.int64)
    for w, c in count.items():
        total[zlib.crc32(w) % hmm.HASHED] += c
        distinct[zlib.crc32(w) % hmm.HASHED] += 1
    return hmm.Words(count.most_common(top), total, distinct)


def small_model():
    rng = np.random.default_rng(1)
    m = hmm.Model(small_words().prior)
    m.start, m.move = rng.dirichlet(np.ones(hmm.STATES)), rng.dirichlet(np.ones(hmm.STATES), hmm.STATES)
    return m


def test_forward_against_all_paths():
    m = small_model()
    seqs = [np.array([0, 3, 1], np.int32), np.array([2], np.int32), np.array([5, 5, 0, 1], np.int32)]
    for s, got in zip(seqs, m.forward(seqs)):
        p = sum(m.start[q[0]] * m.emit[q[0], s[0]] * math.prod(m.move[a, b] * m.emit[b, o] for a, b, o in zip(q, q[1:], s[1:])) for q in product(range(hmm.STATES), repeat=len(s)))
        assert got == pytest.approx(math.log10(p))
    long = np.tile(np.arange(6, dtype=np.int32), 3000)
    a = m.start * m.emit[:, long[0]]
    log = 0.0
    for t in range(1, len(long)):
        log += math.log10(a.sum())
        a = (a / a.sum()) @ m.move * m.emit[:, long[t]]
    assert m.forward([long])[0] == pytest.approx(log + math.log10(a.sum()))


def test_counts_against_all_paths():
    m = small_model()
    seq = np.array([0, 3, 1], np.int32)
    paths = {q: m.start[q[0]] * m.emit[q[0], seq[0]] * math.prod(m.move[a, b] * m.emit[b, o] for a, b, o in zip(q, q[1:], seq[1:])) for q in product(range(hmm.STATES), repeat=3)}
    z = sum(paths.values())
    start, move, emit = np.zeros(hmm.STATES), np.zeros((hmm.STATES,) * 2), np.zeros((hmm.STATES, m.size))
    for q, p in paths.items():
        start[q[0]] += p / z
        for a, b in zip(q, q[1:]):
            move[a, b] += p / z
        for s, o in zip(q, seq):
            emit[s, o] += p / z
    for got, want in zip(m.counts([seq]), (start, move, emit)):
        assert got == pytest.approx(want, rel=1e-4, abs=1e-6)


def test_documents_are_not_cut(monkeypatch):
    """A long document has one start and a transition between any two neighbours, however few tokens are held at once."""
    m = small_model()
    docs = [np.tile(np.arange(6, dtype=np.int32), 100), np.array([2, 4], np.int32), np.tile(np.array([1, 5], np.int32), 90)]
    start, move, emit, log = m.counts(docs)
    assert (start.sum(), move.sum(), emit.sum()) == pytest.approx((3, 599 + 1 + 179, 600 + 2 + 180), rel=1e-4)
    assert log == pytest.approx(m.forward(docs).sum(), rel=1e-5)
    monkeypatch.setattr(hmm, "CELLS", 200)
    for got, want in zip(m.counts(docs), (start, move, emit, log)):
        assert got == pytest.approx(want, rel=1e-4, abs=1e-5)


def brute_scores(docs, gain):
    """Every document's score by plain loops: counts, classes, Baum-Welch over all training documents, forward recursion."""
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    tokens = {d: [x.encode() for x in (*re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(low)), "\n")] for d, t in docs}
    train = [ts for d, ts in tokens.items() if zlib.crc32(str(d).encode()) % 10]
    count = Counter(x for ts in train for x in ts)
    top = sorted(count, key=lambda w: (-count[w], w))[: hmm.TOP]
    own = {w: i for i, w in enumerate(top)}
    of = lambda w: own.get(w, len(top) + zlib.crc32(w) % hmm.HASHED)
    members = {}
    for w in count:
        members.setdefault(of(w), []).append(w)
    share = lambda w: 1.0 if w in own else (count[w] + 0.1) / (sum(count[x] for x in members.get(of(w), [])) + 0.1 * (len(members.get(of(w), [])) + 1))
    prior = np.array([sum(count[w] for w in members.get(c, [])) + 0.1 for c in range(len(top) + hmm.HASHED)])
    prior /= prior.sum()
    first = hmm.Model(prior)
    start, move, emit = first.start, first.move, first.emit
    last, safe, rounds = -math.inf, None, 0
    while True:
        s, v, e, log = np.ones(hmm.STATES), np.ones((hmm.STATES,) * 2), 200 * np.tile(prior, (hmm.STATES, 1)), 0.0
        for ts in train:
            o = [of(w) for w in ts]
            a = [start * emit[:, o[0]]]
            for x in o[1:]:
                a.append((a[-1] / a[-1].sum()) @ move * emit[:, x])
            log += sum(math.log10(x.sum()) for x in a)
            b = np.ones(hmm.STATES)
            for t in range(len(o) - 1, -1, -1):
                g = a[t] * b / (a[t] * b).sum()
                e[:, o[t]] += g
                if t:
                    x = emit[:, o[t]] * b
                    both = np.outer(a[t - 1], x) * move
                    v += both / both.sum()
                    b = move @ x
                    b /= b.sum()
                else:
                    s += g
        now = log / sum(count.values())
        if now < last and safe is not None:
            (start, move, emit), safe = safe, None
            continue
        old, (start, move, emit) = (start, move, emit), (s / s.sum(), v / v.sum(1, keepdims=True), e / e.sum(1, keepdims=True))
        rounds += 1
        if now - last < gain:
            break
        last, safe = now, None
        if rounds > 2:
            safe = start, move, emit
            start, move, emit = (n**hmm.STRETCH / o ** (hmm.STRETCH - 1) for o, n in zip(old, safe))
            start, move, emit = start / start.sum(), move / move.sum(1, keepdims=True), emit / emit.sum(1, keepdims=True)
    out = {}
    for d, ts in tokens.items():
        a, log = start * emit[:, of(ts[0])], 0.0
        for w in ts[1:]:
            log += math.log10(a.sum())
            a = (a / a.sum()) @ move * emit[:, of(w)]
        out[d] = log + math.log10(a.sum()) + sum(math.log10(share(w)) for w in ts)
    return out


@pytest.mark.parametrize("top, known", [(8192, 1 << 17), (20, 40)])
def test_scores_against_brute_force(spark, monkeypatch, top, known):
    """Whether a word is a class of its own, known to the tasks, or comes by the join, its share is the same."""
    monkeypatch.setattr(hmm, "TOP", top)
    monkeypatch.setattr(hmm, "KNOWN", known)
    docs = corpus(80, 4)
    got = {r["doc_id"]: r["score"] for r in hmm.score_documents(spark.createDataFrame(docs, SCHEMA).repartition(3)).collect()}
    want = brute_scores(docs, hmm.GAIN)
    assert got == pytest.approx(want, rel=2e-3)


def test_rounds_run_until_the_likelihood_stands(spark, monkeypatch):
    seen = []
    whole = hmm.train
    monkeypatch.setattr(hmm, "train", lambda *a: seen.append(whole(*a)) or seen[-1])
    hmm.score_documents(spark.createDataFrame(corpus(), SCHEMA).repartition(4)).count()
    log = seen[0].likelihood
    gains = [b - a for a, b in zip(log, log[1:])]
    assert len(log) > 2 and all(g >= hmm.GAIN for g in gains[:-1]) and gains[-1] < hmm.GAIN


def test_training_raises_the_likelihood():
    docs = [[*words_of(t), hmm.END] for _, t in corpus(120) if t]
    words = small_words(Counter(w for d in docs for w in d), 60)
    own = [np.array([words.of[words.index[w]] if w in words.index else words.n_top + zlib.crc32(w) % hmm.HASHED for w in d]) for d in docs]
    m = hmm.Model(words.prior)
    likelihood = [m.forward(own).sum()]
    for _ in range(6):
        m.update(*m.counts(own)[:3])
        likelihood.append(m.forward(own).sum())
    assert all(b > a - 1 for a, b in zip(likelihood, likelihood[1:])) and likelihood[-1] > likelihood[0] + 50
    assert m.emit.sum(1) == pytest.approx(1) and m.move.sum(1) == pytest.approx(1) and m.start.sum() == pytest.approx(1)


def test_probabilities_of_words_sum_to_one(monkeypatch):
    """Over the words of every class, and one place for unknown words in each hashed class, shares add up to one."""
    monkeypatch.setattr(hmm, "TOP", 2)
    count = Counter({b"a": 50, b"b": 20, b"c": 3, b"d": 1})
    words = small_words(count)
    m = hmm.Model(words.prior)
    first = m.start @ m.emit
    mass = first[0] + first[1]
    for k in range(hmm.HASHED):
        inside = [math.log10(count[w] + hmm.ALPHA) for w in (b"c", b"d") if zlib.crc32(w) % hmm.HASHED == k] + [math.log10(hmm.ALPHA)]
        mass += first[2 + k] * sum(10 ** (x - words.inside[2 + k]) for x in inside)
    assert mass == pytest.approx(1)


def test_edge_cases(spark):
    schema = SCHEMA + ", path double, block int, held_out int"
    assert hmm.score_documents(spark.createDataFrame([], schema)).count() == 0
    rows = [(1, "a b", 1.0, 1, 1), (1, "a b", 1.0, 1, 1), (1, "other text", 1.0, 1, 1), (None, "x", 1.0, 1, 1), (2, None, 1.0, 1, 1), (5, "w " * 200_000, 1.0, 1, 1)]
    got = hmm.score_documents(spark.createDataFrame(rows, schema)).collect()
    assert sorted((r["doc_id"] or -1, r["n_tokens"]) for r in got) == [(-1, 2), (1, 3), (1, 3), (1, 3), (2, 1), (5, 200_001)]
    assert all(math.isfinite(r["score"]) for r in got)
    held = next(d for d in range(100) if zlib.crc32(str(d).encode()) % 10 == 0)
    lone = hmm.score_documents(spark.createDataFrame([(held, "no training at all")], SCHEMA)).head()
    assert (lone["train_tokens"], lone["n_known"], lone["held_out"]) == (0, 0, True) and math.isfinite(lone["score"])


def test_steps_are_wide():
    """Documents of any lengths fill the cells of wide steps whole and end to end; one long document does not narrow the others' steps."""
    m = small_model()
    rng = np.random.default_rng(2)
    docs = [rng.integers(0, 6, n) for n in [4000, *rng.integers(1, 300, 1500).tolist(), 2500]]
    tokens = sum(map(len, docs)) + len(docs)
    steps = met = 0
    for own, lane, start, classes in m._lanes(docs):
        steps += classes.shape[1]
        for i, j, a in zip(own, lane, start):
            assert (classes[j, a : a + len(docs[i])] == docs[i]).all() and classes[j, a - 1] == classes[j, a + len(docs[i])] == m.size
            met += 1
        assert classes.size < 1.1 * tokens
    assert met == len(docs) and steps < 1.1 * 4001
    apart = [m.counts([d]) for d in docs]
    for got, want in zip(m.counts(docs), (sum(x) for x in zip(*apart))):
        assert got == pytest.approx(want, rel=1e-4, abs=1e-3)
    assert m.forward(docs) == pytest.approx([m.forward([d])[0] for d in docs], rel=1e-12)


def test_words_are_split_as_stated(monkeypatch):
    """Counts and encoded rows of odd texts are those of words_of, however little text is split at once."""
    texts = [None, "", " \n", "  a  B ", "a\x1cb \x0bc\x85d\xa0e f\x00g É ÀB", "b b zz", "a " * 50]
    want = [[*words_of(t), hmm.END] for t in texts]
    count = Counter(w for t in want for w in t)
    words = small_words(count, 3)
    monkeypatch.setattr(hmm.TaskContext, "get", lambda: type("Task", (), {"partitionId": lambda self: 0})())
    for size in (1, 12, 1 << 20):
        monkeypatch.setattr(hmm, "SLICE", size)
        got = Counter()
        for b in hmm._count(iter([pa.RecordBatch.from_pydict({"text": pa.array(texts, pa.string())})])):
            for r in b.to_pylist():
                got[r["word"]] += r["n"]
        assert got == count
        batch = pa.RecordBatch.from_pydict({"doc_id": pa.array(range(len(texts))), "held_out": pa.array([False] * len(texts)), "text": pa.array(texts, pa.string())})
        rows = [r for b in hmm._encode(type("Held", (), {"value": words}))(iter([batch])) for r in b.to_pylist()]
        assert [r["row"] for r in rows] == [r["doc_id"] for r in rows] == list(range(len(texts)))
        for r, ts in zip(rows, want):
            known = [w for w in ts if w in words.index]
            assert (r["n_tokens"], r["n_known"]) == (len(ts), len(known))
            assert r["known_sum"] == pytest.approx(sum(math.log10(count[w] + 0.1) for w in known))
            assert {x["word"]: x["times"] for x in r["rare"]} == Counter(w for w in ts if w not in words.index)
            assert np.frombuffer(r["classes"], np.uint16).tolist() == [words.of[words.index[w]] if w in words.index else words.n_top + zlib.crc32(w) % hmm.HASHED for w in ts]
