import random
import zlib

import numpy as np
import pytest

from tessera.llm import toxicity
from tessera.llm.common import words_of


def planted(n=600, seed=1):
    """Documents of which every third holds one of a few rare words, some in forms that were never seen."""
    rng = random.Random(seed)
    clean = [f"word{i}" for i in range(300)]
    rows = []
    for d in range(n):
        text = rng.choices(clean, k=rng.randint(5, 120))
        bad = d % 3 == 0
        if bad:
            text[rng.randrange(len(text))] = rng.choice(["grumbler", "vilething", "spitehead", "Grumblers", "vilethings"])
        rows.append((d, " ".join(text), int(bad)))
    return rows


def auc(score, label):
    order = np.argsort(score, kind="stable")
    rank = np.empty(len(score))
    rank[order] = np.arange(len(score))
    for s in np.unique(score):
        rank[score == s] = rank[score == s].mean()
    n1 = label.sum()
    return (rank[label == 1].sum() - n1 * (n1 - 1) / 2) / (n1 * (len(label) - n1))


def test_held_out_accuracy(spark):
    rows = planted()
    docs = spark.createDataFrame([(d, t) for d, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(d, y) for d, _, y in rows], "doc_id long, toxic int")
    got = {r["doc_id"]: r for r in toxicity.score_documents(docs, toxicity.train(docs, labels)).collect()}
    held = [d for d, _, _ in rows if zlib.crc32(str(d).encode()) % 5 == 0]
    assert all(got[d]["held_out"] == (zlib.crc32(str(d).encode()) % 5 == 0) for d, _, _ in rows)
    score, label = np.array([got[d]["score"] for d in held]), np.array([int(d % 3 == 0) for d in held])
    assert auc(score, label) > 0.97 and ((score >= 0.5) == label).mean() > 0.95
    assert all(r["predicted"] == int(r["score"] >= 0.5) and 0 <= r["score"] <= 1 for r in got.values())


def test_labels_of_the_held_out_fold_are_not_used(spark):
    rows = planted(200)
    docs = spark.createDataFrame([(d, t) for d, t, _ in rows], "doc_id long, text string")
    held = lambda d: zlib.crc32(str(d).encode()) % 5 == 0
    one = spark.createDataFrame([(d, y) for d, _, y in rows], "doc_id long, toxic int")
    two = spark.createDataFrame([(d, 1 - y if held(d) else y) for d, _, y in rows], "doc_id long, toxic int")
    a, b = (toxicity.train(docs, x, epochs=1) for x in (one, two))
    assert all((a.p[k] == b.p[k]).all() for k in a.p)


def brute_score(net, text):
    """One text's score, a word, a step and a window at a time."""
    p = {k: v.astype(float) for k, v in net.p.items()}
    h = toxicity.HIDDEN
    sigmoid = lambda x: 1 / (1 + np.exp(-x))

    def vector(word):
        padded = b"<" + word + b">"
        grams = [int.from_bytes(padded[i : i + 3], "big") for i in range(len(padded) - 2)]
        grams += [int.from_bytes(padded[i : i + 4], "big") | 1 << 40 for i in range(len(padded) - 3)]
        at = [(g * 0x9E3779B97F4A7C15 & (1 << 64) - 1) >> 49 for g in grams]
        known, odds = net.vocabulary.get(word, 0), net.gram_odds[at]
        return np.concatenate([p["word"][known], sum(p["char"][a] for a in at) / np.sqrt(len(at)), [net.word_odds[known], odds.sum() / np.sqrt(len(at)), odds.max()]])

    def read(words, which):
        state, out = np.zeros(h), []
        for w in words:
            x, g = vector(w) @ p["w" + which] + p["b" + which], state @ p["u" + which]
            z, r = sigmoid(x[:h] + g[:h]), sigmoid(x[h : 2 * h] + g[h : 2 * h])
            state = z * state + (1 - z) * np.tanh(x[2 * h :] + r * g[2 * h :])
            out.append(state)
        return out

    words, logits, a = words_of(text), [], 0
    while True:
        own = words[a : a + toxicity.WINDOW]
        states = [np.concatenate(x) for x in zip(read(own, "f"), read(own[::-1], "b")[::-1])]
        weight = np.exp([np.tanh(s @ p["at"]) @ p["av"] for s in states])
        logits.append(sum(w * s for w, s in zip(weight, states)) @ p["out"] / weight.sum() + p["bias"][0])
        a += toxicity.STRIDE
        if a + toxicity.WINDOW - toxicity.STRIDE >= len(words):
            return sigmoid(max(logits))


def test_scores_against_plain_loops():
    rows = planted(150, 3)
    net = toxicity.Network().fit([words_of(t) for _, t, _ in rows], [y for *_, y in rows], epochs=2)
    texts = [t for _, t, _ in planted(40, 9)] + ["one", "Grumblers unseenword", "w " * 25, "w " * 24, "x" * 400]
    assert net.score([words_of(t) for t in texts]) == pytest.approx([brute_score(net, t) for t in texts], abs=1e-4)


def test_contradicting_labels(spark):
    """The larger label of an id counts, in whatever order the rows come."""
    rows = planted(60)
    docs = spark.createDataFrame([(d, t) for d, t, _ in rows], "doc_id long, text string")
    labels = [(d, y) for d, _, y in rows]
    twice = spark.createDataFrame(labels + [(d, 0) for d, _ in labels], "doc_id long, toxic int")
    a, b = (toxicity.train(docs, x, epochs=1) for x in (spark.createDataFrame(labels, "doc_id long, toxic int"), twice.repartition(5)))
    assert all((a.p[k] == b.p[k]).all() for k in a.p)


def test_gradients():
    """Backpropagation against differences, in double precision."""
    net = toxicity.Network(3)
    texts = [words_of(t) for _, t, _ in planted(12)]
    net.fit(texts, [int(i % 3 == 0) for i in range(12)], epochs=1)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    held = toxicity.Words(texts)
    idx, mask = held.windows(slice(0, 6))
    target, weight = np.array([1, 0, 1, 0, 0, 1.0]), np.full(6, 1 / 6)

    def loss():
        x, _ = net.inputs(held.names)
        p = toxicity._sigmoid(net.logits(x, idx, mask))
        return float(-(weight * np.log(np.where(target > 0, p, 1 - p))).sum())

    x, memo = net.inputs(held.names)
    grads, _ = net.gradients(held, x, memo, idx, mask, target, weight)
    rng = np.random.default_rng(1)
    for name in ("wf", "wb", "uf", "ub", "bf", "bb", "at", "av", "out", "bias", "word", "char"):
        flat, g = net.p[name].reshape(-1), np.asarray(grads[name]).reshape(-1)
        for at in rng.choice(np.flatnonzero(g) if name in ("word", "char") else len(flat), 4):
            old, e = flat[at], 1e-2
            flat[at] = old + e
            up = loss()
            flat[at] = old - e
            down = loss()
            flat[at] = old
            assert g[at] == pytest.approx((up - down) / (2 * e), abs=2e-3, rel=0.05), name


def test_whole_text_counts():
    """What is at the end of a very long text is found as well as at its start."""
    rows = planted(400)
    net = toxicity.Network().fit([words_of(t) for _, t, _ in rows], [y for *_, y in rows])
    filler = [b"word%d" % (i % 300) for i in range(30_000)]
    clean, late, early = net.score([filler, [*filler, b"vilething"], [b"vilething", *filler]])
    assert late > 0.5 and early > 0.5 and clean < 0.5
    assert net.score([filler])[0] == pytest.approx(clean, abs=1e-6)


def test_edge_cases(spark):
    docs = spark.createDataFrame([(1, None, 5), (2, "", 5), (3, " \n", 5), (None, "a b", 5), (3, " \n", 5)], "doc_id long, text string, held_out int")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    got = toxicity.score_documents(docs, toxicity.train(docs, none)).collect()
    assert len(got) == 5 and all(r["score"] == 0 and r["predicted"] == 0 for r in got)
    only = spark.createDataFrame([(2, 1), (2, 1), (None, 1), (3, None)], "doc_id long, toxic int")
    assert {r["score"] for r in toxicity.score_documents(docs, toxicity.train(docs, only)).collect()} <= {0.0, 1.0}
    rows = planted(60)
    net = toxicity.Network().fit([words_of(t) for _, t, _ in rows], [y for *_, y in rows], 1)
    scores = [r["score"] for r in toxicity.score_documents(docs, net).collect()]
    assert all(0 <= s <= 1 for s in scores) and len(set(scores[:3])) == 1
    assert toxicity.score_documents(spark.createDataFrame([], docs.schema), net).count() == 0
