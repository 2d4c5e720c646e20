"""Toxicity by a bidirectional gated recurrent network with attention pooling, trained in numpy.

A text is cut into overlapping windows of WINDOW words; every window is read in both directions, its states are pooled
by attention into one logit, and the text's score is the logistic of its largest logit. A word's input joins a learned
vector of the word, if the sample knows it, learned vectors of its character 3- and 4-grams (hashed, so unseen words have
them too), and the log-odds that the training sample gives to the word and to its grams.

Training uses at most SAMPLE labelled documents of each class (see SAMPLE), whole, and alternates between finding every
document's strongest windows and descending (Adam) on those. Labels, language, source and id are no inputs.

Edge cases: a null or empty text is one empty window and gets that window's score; a text shorter than a window is one
padded window; a text of any length has all its windows scored; without labels of both classes every score is the share
of toxic labels (0 without labels); of labels that contradict each other the larger counts; a score of exactly 0.5 predicts
1; repeated rows are scored one by one; an empty table gives no rows; extra columns are not read, whatever their names.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hashed_sample, is_held_out, numbered, words_of

#: At most so many labelled rows of class 1 and of class 0 train the model, chosen by a hash of their ids.
SAMPLE = {1: 900, 0: 1800}
WINDOW, STRIDE, HIDDEN = 24, 12, 8
WORD_DIM, CHAR_DIM, GRAMS, VOCABULARY = 4, 8, 1 << 15, 20_000
EPOCHS = 5
SCHEMA = "doc_id long, held_out boolean, score double, predicted int"


def _grams(names: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed 3- and 4-grams of `<word>` for all words, with the number of them by word, in one pass over the bytes."""
    size = np.fromiter(map(len, names), np.int64, len(names)) + 2
    buf = np.frombuffer(b"".join(b"<%b>" % w for w in names) + b"\0\0\0", np.uint8).astype(np.uint64)
    first = np.cumsum(size) - size
    n = int(size.sum())
    left = np.repeat(first + size, size) - np.arange(n)
    tri = (buf[:n] << np.uint64(16)) | (buf[1 : n + 1] << np.uint64(8)) | buf[2 : n + 2]
    four = (tri << np.uint64(8)) | buf[3 : n + 3] | np.uint64(1 << 40)
    both = np.stack([tri, four], 1)
    both = (both * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - 15)
    fits = np.stack([left >= 3, left >= 4], 1)
    owner = np.repeat(np.arange(len(names)), size)
    return both[fits].astype(np.int64), np.bincount(np.repeat(owner, fits.sum(1)), minlength=len(names))


def _sum_by(values: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Sums of consecutive runs; every run has at least one row."""
    return np.add.reduceat(values, np.cumsum(count) - count, axis=0) if len(count) else values[:0]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Words:
    """Distinct words of some texts, and every text's windows over them; index 0 pads."""

    def __init__(self, texts: list[list[bytes]]) -> None:
        index = numbered(b"")
        flat = np.fromiter(map(index.__getitem__, chain.from_iterable(texts)), np.int64)
        self.names = list(index)
        size = np.fromiter(map(len, texts), np.int64, len(texts))
        count = 1 + np.maximum(0, -(-(size - WINDOW) // STRIDE))
        self.doc = np.repeat(np.arange(len(texts)), count)
        step = np.arange(len(self.doc)) - np.repeat(np.cumsum(count) - count, count)
        self.first = np.repeat(np.cumsum(size) - size, count) + step * STRIDE
        self.size = np.clip(size[self.doc] - step * STRIDE, 0, WINDOW)
        self.flat = np.append(flat, np.zeros(WINDOW, np.int64))
        self.count = count

    def windows(self, which: slice | np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        first, size = self.first[which], self.size[which]
        mask = np.arange(WINDOW) < size[:, None]
        return np.where(mask, self.flat[np.minimum(first[:, None] + np.arange(WINDOW), len(self.flat) - 1)], 0), mask


class Network:
    def __init__(self, seed: int = 5) -> None:
        rng = np.random.default_rng(seed)
        d, h = WORD_DIM + CHAR_DIM + 3, HIDDEN
        f = lambda *s, k=0.3: rng.normal(0, k, s).astype(np.float32)
        self.vocabulary: dict[bytes, int] = {}
        self.word_odds = np.zeros(1, np.float32)
        self.gram_odds = np.zeros(GRAMS, np.float32)
        self.p = {"word": f(1, WORD_DIM, k=0.1), "char": f(GRAMS, CHAR_DIM, k=0.1), "wf": f(d, 3 * h), "wb": f(d, 3 * h), "uf": f(h, 3 * h), "ub": f(h, 3 * h), "bf": f(3 * h, k=0.01), "bb": f(3 * h, k=0.01), "at": f(2 * h, h), "av": f(h), "out": f(2 * h), "bias": np.zeros(1, np.float32)}
        self.prior = 0.0
        self.trained = False

    # inputs
    def inputs(self, names: list[bytes]) -> tuple[np.ndarray, tuple]:
        at = np.fromiter((self.vocabulary.get(w, 0) for w in names), np.int64, len(names))
        grams, count = _grams(names)
        count[0] = max(count[0], 1)
        if count.sum() > len(grams):  # the pad has no gram of its own
            grams = np.insert(grams, 0, 0)
        root = np.sqrt(count)[:, None].astype(np.float32)
        odds = self.gram_odds[grams]
        tops = np.maximum.reduceat(odds, np.cumsum(count) - count) if len(grams) else np.zeros(len(names), np.float32)
        x = np.concatenate([self.p["word"][at], _sum_by(self.p["char"][grams], count) / root, self.word_odds[at][:, None], _sum_by(odds, count)[:, None] / root, tops[:, None]], 1).astype(np.float32)
        x[0] = 0
        return x, (at, grams, count, root)

    # one direction; steps run over time, padded steps keep the state
    def _run(self, proj, idx, mask, u, keep: bool):
        h = np.zeros((len(idx), HIDDEN), np.float32)
        states, memo = np.empty((WINDOW, len(idx), HIDDEN), np.float32), []
        for t in range(WINDOW):
            x, g = proj[idx[:, t]], h @ u
            zr = 1 / (1 + np.exp(-(x[:, : 2 * HIDDEN] + g[:, : 2 * HIDDEN])))
            z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
            c = np.tanh(x[:, 2 * HIDDEN :] + r * g[:, 2 * HIDDEN :])
            m = mask[:, t : t + 1]
            new = np.where(m, (1 - z) * c + z * h, h)
            if keep:
                memo.append((h, z, r, c, g[:, 2 * HIDDEN :], m))
            h = new
            states[t] = h
        return states, memo

    def logits(self, x: np.ndarray, idx: np.ndarray, mask: np.ndarray, keep: bool = False):
        p = self.p
        pf, pb = x @ p["wf"] + p["bf"], x @ p["wb"] + p["bb"]
        f, mf = self._run(pf, idx, mask, p["uf"], keep)
        b, mb = self._run(pb, idx[:, ::-1], mask[:, ::-1], p["ub"], keep)
        hs = np.concatenate([f, b[::-1]], 2)
        a = np.tanh(hs @ p["at"])
        s = np.where(mask.T, a @ p["av"], -1e9)
        s = np.where(mask.any(1), s, 0)
        w = np.exp(s - s.max(0))
        w /= w.sum(0)
        pooled = np.einsum("tn,tnd->nd", w, hs)
        out = pooled @ p["out"] + p["bias"][0]
        return (out, (hs, a, w, pooled, mf, mb)) if keep else out

    def _back(self, d_states, memo, proj_rows, u, idx, grads, which):
        """Gradients of one direction: into u, and by word into the projected inputs."""
        d_proj = np.zeros((proj_rows, 3 * HIDDEN), np.float32)
        dh = np.zeros_like(memo[0][0])
        for t in range(WINDOW - 1, -1, -1):
            h, z, r, c, g, m = memo[t]
            dh = dh + d_states[t]
            dn = np.where(m, dh, 0)
            dc, dz = dn * (1 - z) * (1 - c * c), dn * (h - c) * z * (1 - z)
            dr = dc * g * r * (1 - r)
            dx = np.concatenate([dz, dr, dc], 1)
            dg = np.concatenate([dz, dr, dc * r], 1)
            np.add.at(d_proj, idx[:, t], dx)
            grads["u" + which] += h.T @ dg
            dh = np.where(m, dn * z, dh) + dg @ u.T
        return d_proj

    def gradients(self, words: Words, x, memo_in, idx, mask, target, weight):
        p = self.p
        out, (hs, a, w, pooled, mf, mb) = self.logits(x, idx, mask, keep=True)
        grads = {k: np.zeros_like(v) for k, v in p.items()}
        prob = _sigmoid(out)
        d_out = ((prob - target) * weight).astype(np.float32)
        grads["out"], grads["bias"] = pooled.T @ d_out, d_out.sum(keepdims=True)
        d_pool = d_out[:, None] * p["out"]
        d_hs = w[:, :, None] * d_pool
        d_w = np.einsum("tnd,nd->tn", hs, d_pool)
        d_s = np.where(mask.T, w * (d_w - (w * d_w).sum(0)), 0)
        grads["av"] = np.einsum("tn,tnh->h", d_s, a)
        d_a = d_s[:, :, None] * p["av"] * (1 - a * a)
        grads["at"] = np.einsum("tnd,tnh->dh", hs, d_a)
        d_hs = (d_hs + d_a @ p["at"].T).astype(np.float32)
        df = self._back(d_hs[:, :, :HIDDEN], mf, len(x), p["uf"], idx, grads, "f")
        db = self._back(d_hs[::-1, :, HIDDEN:], mb, len(x), p["ub"], idx[:, ::-1], grads, "b")
        grads["wf"], grads["wb"], grads["bf"], grads["bb"] = x.T @ df, x.T @ db, df.sum(0), db.sum(0)
        dx = df @ p["wf"].T + db @ p["wb"].T
        at, grams, count, root = memo_in
        np.add.at(grads["word"], at, dx[:, :WORD_DIM])
        grads["word"][0] = 0
        used = np.flatnonzero(np.abs(dx).sum(1))
        ends = np.cumsum(count)
        pick = np.concatenate([np.arange(ends[i] - count[i], ends[i]) for i in used]) if len(used) else np.zeros(0, int)
        np.add.at(grads["char"], grams[pick], np.repeat(dx[used, WORD_DIM : WORD_DIM + CHAR_DIM] / root[used], count[used], axis=0))
        return grads, float(-np.mean(np.log(np.where(target > 0, prob, 1 - prob) + 1e-9)))

    def fit(self, texts: list[list[bytes]], labels: list[int], epochs: int = EPOCHS) -> Network:
        y = np.array(labels, np.float32)
        self.prior = float(y.mean()) if len(y) else 0.0
        if len(set(labels)) < 2:
            return self
        self.trained = True
        n1, n0 = y.sum(), len(y) - y.sum()
        words, grams = (Counter(), Counter()), (Counter(), Counter())
        for t, label in zip(texts, labels):
            own = list(set(t))
            words[label].update(own)
            grams[label].update(np.unique(_grams(own)[0]).tolist() if own else [])

        def odds(k, of) -> float:
            a, b = of[1][k], of[0][k]
            return float(np.log((a + 0.5) / (n1 + 1)) - np.log((b + 0.5) / (n0 + 1))) * (a + b) / (a + b + 5)

        common = [w for w, c in (words[0] + words[1]).most_common(VOCABULARY) if c >= 5]
        self.vocabulary = {w: i + 1 for i, w in enumerate(common)}
        self.word_odds = np.array([0.0, *(odds(w, words) for w in common)], np.float32)
        for g in set(grams[0]) | set(grams[1]):
            if grams[0][g] + grams[1][g] >= 3:
                self.gram_odds[g] = odds(g, grams)
        rng = np.random.default_rng(7)
        self.p["word"] = rng.normal(0, 0.1, (len(common) + 1, WORD_DIM)).astype(np.float32)
        held = Words(texts)
        first = np.cumsum(held.count) - held.count
        moment = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in self.p.items()}
        step = 0
        for epoch in range(epochs):
            x, memo = self.inputs(held.names)
            if epoch == 0:  # before anything is learned: the windows of the largest log-odds
                score = np.concatenate([np.where(m, x[i][:, :, -3] + x[i][:, :, -1], -9).max(1) for i, m in (held.windows(slice(a, a + 8192)) for a in range(0, len(held.doc), 8192))])
            else:
                score = np.concatenate([self.logits(x, *held.windows(slice(a, a + 8192))) for a in range(0, len(held.doc), 8192)])
            best = np.lexsort((-score, held.doc))
            best = best[np.arange(len(best)) - first[held.doc[best]] < np.where(y[held.doc[best]] > 0, 1, 2)]
            rng.shuffle(best)
            for a in range(0, len(best), 256):
                own = best[a : a + 256]
                idx, mask = held.windows(own)
                target = y[held.doc[own]]
                x, memo = self._rows(held, idx)
                near, at = memo[-1]
                grads, _ = self.gradients(held, x, memo[:-1], at, mask, target, np.full(len(own), 1 / len(own), np.float32))
                step += 1
                rate = 0.02 * (1 - epoch / epochs) + 0.002
                for k, g in grads.items():
                    g = np.asarray(g, np.float32).reshape(self.p[k].shape)
                    m, v = moment[k]
                    m += 0.1 * (g - m)
                    v += 0.01 * (g * g - v)
                    self.p[k] -= (rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
        return self

    def _rows(self, held: Words, idx: np.ndarray):
        """Inputs of the words that some windows hold, and the windows over those."""
        near, at = np.unique(np.append(idx.ravel(), 0), return_inverse=True)
        x, memo = self.inputs([held.names[i] for i in near])
        return x, (*memo, (near, at[:-1].reshape(idx.shape)))

    def score(self, texts: list[list[bytes]]) -> np.ndarray:
        """0 to 1 for every text; all windows of all texts are read."""
        if not texts:
            return np.zeros(0)
        if not self.trained:
            return np.full(len(texts), self.prior)
        held = Words(texts)
        x, _ = self.inputs(held.names)
        out = np.concatenate([self.logits(x, *held.windows(slice(a, a + 4096))) for a in range(0, len(held.doc), 4096)])
        top = np.maximum.reduceat(out, np.cumsum(held.count) - held.count)
        return _sigmoid(top.astype(np.float64))


def train(docs: DataFrame, labels: DataFrame, modulus: int = 5, sample: dict[int, int] = SAMPLE, epochs: int = EPOCHS) -> Network:
    """A network fitted to at most sample[c] labelled documents of class c outside the held-out fold."""
    free = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~is_held_out("doc_id", modulus)).groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    picked, total = None, {r["toxic"]: r["count"] for r in free.groupBy("toxic").count().collect() if r["toxic"] in sample}
    for c, n in sample.items():
        own = hashed_sample(free.where(F.col("toxic") == c), n, total.get(c, 0), "doc_id")
        picked = own if picked is None else picked.unionByName(own)
    # picked has at most sum(sample.values()) rows of two numbers
    rows = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").collect()
    rows.sort(key=lambda r: r["doc_id"])
    return Network().fit([words_of(r["text"]) for r in rows], [r["toxic"] for r in rows], epochs)


def score_documents(docs: DataFrame, model: Network, modulus: int = 5) -> DataFrame:
    held = docs.sparkSession.sparkContext.broadcast(model)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = held.value
        for batch in batches:
            rows, size = [], 0
            for k, text in enumerate(batch.column(2)):
                rows.append(words_of(text.as_py()))
                size += len(rows[-1])
                if size >= 250_000 or k + 1 == batch.num_rows:
                    at = slice(k + 1 - len(rows), k + 1)
                    s = net.score(rows)
                    yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0).slice(at.start, len(rows)), "held_out": batch.column(1).slice(at.start, len(rows)), "score": pa.array(s), "predicted": pa.array((s >= 0.5).astype(np.int32))})
                    rows, size = [], 0

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(is_held_out("doc_id", modulus), F.lit(False)).alias("held_out"), "text").mapInArrow(task, SCHEMA)
