"""Hidden Markov language model over word classes, and the smoothed unigram base it is compared with.

Word counts come from every training document, added up in the scan's tasks and then by word in Spark; the table of counts
stays there. The KNOWN most frequent words, a bounded list, go to every task with their counts. A second pass over the
texts writes one row a document: its classes, what its known words say, and its other words as (word, times) pairs. Only
these pairs meet the table of counts, in a join of two written tables that adaptive execution can split.

The model: a hidden state emits a class, the class emits the word. The TOP most frequent words are classes of their own,
the rest share hashed classes; inside a class a word has its smoothed share of the class's count, with one place for
unknown words, so the probabilities of all words sum to one. The model's size is STATES x (TOP + HASHED) at any corpus
size. Baum-Welch starts from states drawn at random around the classes' shares; every round runs over all training
documents, uncut, each task giving its expected counts, which Spark adds up, until a round adds less than GAIN; steps are
stretched (over-relaxed), which needs fewer rounds. Scoring runs the scaled forward recursion through every whole document.
Both recursions step through lanes of whole documents laid end to end, joined by a state that stands between documents.

Edge cases: a null text is empty, that is one end token; a text of white space likewise; repeated rows count and are
scored as often as they occur; words of equal count are ordered by their bytes; without training documents every token is
unknown and V = N = 0; an empty table gives no rows; a null id is never held out; extra columns are not read, whatever
their names. A text of any length is one sequence; a task holds some 200 bytes a token of the longest it reads.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import cached_property
from heapq import heapreplace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, is_held_out

STATES, TOP, HASHED, KNOWN = 8, 8192, 2048, 1 << 17
#: Rounds end where one adds less than this to the training likelihood, in log10 a token.
GAIN = 1e-4
#: From the third round on, steps go so many times as far as Baum-Welch's own; one that lowers the likelihood is taken back.
STRETCH = 1.5
#: Tokens whose forward states are held at once, if no document is longer; lanes they are laid in, at most.
CELLS, LANES = 1 << 21, 512
#: Tokens in a span of steps, as many as stay in a core's cache; steps between two scalings.
SPAN, SCALED = 1 << 14, 8
#: Bytes of text that are split into words at once, if no document is longer.
SLICE = 1 << 23
ALPHA = 0.1
#: The end of a document as a token; no word holds white space.
END = b"\n"
ENCODED = "row long, doc_id long, held_out boolean, n_tokens long, n_known long, known_sum double, classes binary, rare array<struct<word: binary, times: int>>"


# ---- counts ----
def _tokens(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray, pa.Array]]:
    """Of some documents after others: the first one's number, how many words each has, and their words as numbers in an array of different words.

    Arrow lower-cases ASCII letters alone and splits on exactly the six ASCII white-space bytes, as `words_of` does.
    """
    k = 0
    bytes_before = np.concatenate([[0], np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False), dtype=np.int64)])
    while k < len(texts):
        to = max(k + 1, int(np.searchsorted(bytes_before, bytes_before[k] + SLICE, "right")) - 1)
        text = pc.ascii_trim_whitespace(pc.ascii_lower(pc.fill_null(texts.slice(k, to - k), "")))
        # a text without words is split into one empty string
        full = pc.not_equal(text, "")
        split = pc.ascii_split_whitespace(pc.filter(text, full))
        size = np.zeros(to - k, np.int64)
        size[full.to_numpy(zero_copy_only=False)] = pc.list_value_length(split).to_numpy(zero_copy_only=False)
        words = split.flatten().dictionary_encode()
        yield k, size, words.indices.to_numpy(), words.dictionary.cast(pa.binary())
        k = to


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """text -> word, n; a word may come again."""
    for batch in batches:
        for _, size, at, words in _tokens(batch.column(0)):
            yield pa.RecordBatch.from_pydict({"word": words, "n": pa.array(np.bincount(at, minlength=len(words)).astype(np.int64))})
        yield pa.RecordBatch.from_pydict({"word": pa.array([END], pa.binary()), "n": pa.array([batch.num_rows], pa.int64())})


def _class(word: Column) -> Column:
    return (F.crc32(word) % F.lit(HASHED)).cast("int")


class Words:
    """The known words in falling order of their counts, and the totals of the hashed classes; of bounded size."""

    def __init__(self, known: list[tuple[bytes, int]], total: np.ndarray, distinct: np.ndarray) -> None:
        self.known = pa.array([w for w, _ in known], pa.binary())
        self.n, self.v = int(total.sum()), int(distinct.sum())
        self.n_top = min(TOP, len(known))
        self.size = self.n_top + HASHED
        count = np.array([c for _, c in known], float)
        self.log = np.log10(count + ALPHA)
        hashed = np.fromiter((zlib.crc32(w) % HASHED for w, _ in known), np.int32, len(known))
        total, distinct = total.astype(float), distinct.astype(float)
        np.subtract.at(total, hashed[: self.n_top], count[: self.n_top])
        np.subtract.at(distinct, hashed[: self.n_top], 1)
        #: Class of a known word.
        self.of = np.where(np.arange(len(known)) < self.n_top, np.arange(len(known)), self.n_top + hashed).astype(np.uint16)
        #: log10 of what divides a word's smoothed count: in a hashed class its total, in a word's own class the count itself.
        self.inside = np.concatenate([self.log[: self.n_top], np.log10(total + ALPHA * (distinct + 1))])
        prior = np.concatenate([count[: self.n_top], total]) + ALPHA
        self.prior = prior / prior.sum()

    @cached_property
    def index(self) -> dict[bytes, int]:
        return {w: i for i, w in enumerate(self.known.to_pylist())}


def count_words(training: DataFrame) -> tuple[Words, DataFrame]:
    """Words, and the written table (word, n) of all training words. training: text."""
    counts = cut(training.select("text").mapInArrow(_count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")))
    # a histogram by size says from which count on there are KNOWN words; it has a few hundred rows
    size = F.floor(8 * F.log2("n"))
    least, found = None, 0
    for row in sorted(counts.groupBy(size.alias("size")).count().collect(), reverse=True):
        least, found = row["size"], found + row["count"]
        if found >= KNOWN:
            break
    frequent = counts.where(size >= least) if least is not None else counts
    known = [(bytes(r["word"]), r["n"]) for r in frequent.orderBy(F.desc("n"), "word").limit(KNOWN).collect()]
    total, distinct = np.zeros(HASHED, np.int64), np.zeros(HASHED, np.int64)
    for r in counts.groupBy(_class(F.col("word")).alias("class")).agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect():  # at most HASHED rows
        total[r["class"]], distinct[r["class"]] = r["n"], r["v"]
    return Words(known, total, distinct), counts


def _encode(held):
    """doc_id, held_out, text -> ENCODED."""

    def task(batches):
        words: Words = held.value
        row = TaskContext.get().partitionId() << 33
        for batch in batches:
            for k, size, at, different in _tokens(batch.column(2)):
                # of each different word, the end being the last: its place among the known ones and its class
                different = pa.concat_arrays([different, pa.array([END], pa.binary())])
                place = pc.fill_null(pc.index_in(different, value_set=words.known), -1).to_numpy()
                known = place >= 0
                of, log = np.empty(len(place), np.uint16), np.zeros(len(place))
                of[known], log[known] = words.of[place[known]], words.log[place[known]]
                other = np.flatnonzero(~known)
                of[other] = np.fromiter(map(zlib.crc32, different.take(pa.array(other)).to_pylist()), np.int64, len(other)) % HASHED + words.n_top
                # every document's words and its end
                docs = len(size)
                size = size + 1
                ends = np.cumsum(size)
                is_word = np.ones(ends[-1], bool)
                is_word[ends - 1] = False
                token = np.full(ends[-1], len(place) - 1, np.int32)
                token[is_word] = at
                doc = np.repeat(np.arange(docs), size)
                classes = of[token]
                rest = np.flatnonzero(~known[token])
                pair, times = np.unique(doc[rest] * len(place) + token[rest], return_counts=True)
                cuts = np.searchsorted(pair, np.arange(docs + 1) * len(place)).astype(np.int32)
                flat = pa.StructArray.from_arrays([different.take(pa.array(pair % len(place))), pa.array(times.astype(np.int32))], ["word", "times"])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(row + np.arange(docs)),
                        batch.column(0).slice(k, docs),
                        batch.column(1).slice(k, docs),
                        pa.array(size),
                        pa.array(size - np.bincount(doc[rest], minlength=docs)),
                        pa.array(np.bincount(doc, weights=log[token], minlength=docs), pa.float64()),
                        pa.Array.from_buffers(pa.binary(), docs, [None, pa.py_buffer(np.concatenate([[0], 2 * ends]).astype(np.int32)), pa.py_buffer(classes)]),
                        pa.ListArray.from_arrays(pa.array(cuts), flat),
                    ],
                    names=["row", "doc_id", "held_out", "n_tokens", "n_known", "known_sum", "classes", "rare"],
                )
                row += docs

    return task


def _sequences(column) -> list[np.ndarray]:
    return [np.frombuffer(c.as_buffer(), np.uint16) for c in column]


def _sums(value: np.ndarray, docs: list[np.ndarray]) -> np.ndarray:
    """The sum of the classes' values in each document; none is empty, each has its end."""
    if not docs:
        return np.zeros(0)
    return np.add.reduceat(value[np.concatenate(docs)], np.cumsum([0, *map(len, docs[:-1])]))


# ---- the model ----
class Model:
    """Start, transition and emission probabilities of the states over the classes."""

    def __init__(self, prior: np.ndarray, seed: int = 3) -> None:
        self.prior, self.size = prior, len(prior)
        rng = np.random.default_rng(seed)
        self.start = np.full(STATES, 1 / STATES)
        self.move = np.full((STATES, STATES), 0.2 / STATES) + 0.8 * np.eye(STATES)
        self.emit = prior * rng.uniform(0.5, 1.5, (STATES, self.size))
        self.emit /= self.emit.sum(1, keepdims=True)
        #: Training likelihood of the classes, log10 a token, before each round.
        self.likelihood: list[float] = []

    def update(self, start: np.ndarray, move: np.ndarray, emit: np.ndarray) -> None:
        """Maximisation; the prior holds what a state has not seen."""
        self.start = (start + 1) / (start + 1).sum()
        move = move + 1
        self.move = move / move.sum(1, keepdims=True)
        emit = emit + 200 * self.prior
        self.emit = emit / emit.sum(1, keepdims=True)

    def stretch(self, start: np.ndarray, move: np.ndarray, emit: np.ndarray) -> None:
        """Go on from the given probabilities through the present ones, geometrically."""
        further = (new * (new / old) ** (STRETCH - 1) for old, new in zip((start, move, emit), (self.start, self.move, self.emit)))
        self.start, self.move, self.emit = (x / x.sum(-1, keepdims=True) for x in further)

    def _lanes(self, docs: list[np.ndarray]) -> Iterator[tuple[list[int], np.ndarray, np.ndarray, np.ndarray]]:
        """Numbers of documents, the lane and the first cell of each, and the lanes' classes.

        A lane holds whole documents; a cell of the class `size` stands before, between and after them and fills lanes up.
        The longest go first, each to the shortest lane, so lanes end alike and no step but a long document's own is narrow.
        """
        order = sorted(range(len(docs)), key=lambda i: -len(docs[i]))
        k = 0
        while k < len(order):
            first, total = k, 0
            while k < len(order) and (k == first or total + len(docs[order[k]]) < CELLS):
                total += len(docs[order[k]]) + 1
                k += 1
            own = order[first:k]
            shortest = [(1, j) for j in range(max(1, min(LANES, total // (len(docs[own[0]]) + 1))))]
            lane, start = np.empty(len(own), int), np.empty(len(own), int)
            for d, i in enumerate(own):
                start[d], lane[d] = cell, j = shortest[0]
                heapreplace(shortest, (cell + len(docs[i]) + 1, j))
            classes = np.full((len(shortest), max(shortest)[0]), self.size, np.uint16)
            for i, j, cell in zip(own, lane.tolist(), start.tolist()):
                classes[j, cell : cell + len(docs[i])] = docs[i]
            yield own, lane, start, classes

    def _joined(self, kind) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Emissions by state and class, moves, and the first state of lanes, for the states and one more that stands between documents.

        That one alone emits the class `size`, moves on as documents start, and is reached from any state with one, so a
        lane's probability is the product of its documents'. Emissions are over the prior: near one, so that products of
        a few stay in range; what the prior says is added at the end.
        """
        ratio, move, between = np.zeros((STATES + 1, self.size + 1), kind), np.ones((STATES + 1, STATES + 1), kind), np.zeros(STATES + 1, kind)
        ratio[:-1, :-1], ratio[-1, -1] = self.emit / self.prior, 1
        move[:-1, :-1], move[-1, :-1] = self.move, self.start
        between[-1] = 1
        return ratio, move, between

    @staticmethod
    def _spans(classes: np.ndarray) -> list[slice]:
        """Spans of the lanes' steps; each begins at a step that is scaled."""
        lanes, steps = classes.shape
        width = max(1, SPAN // lanes // SCALED) * SCALED
        return [slice(a, min(a + width, steps)) for a in range(0, steps, width)]

    @staticmethod
    def _emitted(ratio: np.ndarray, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Classes of a span by step and lane, and their emissions by step, state and lane."""
        obs = classes.T.astype(np.intp, order="C")
        return obs, np.ascontiguousarray(np.take(ratio, obs, axis=1, mode="clip").swapaxes(0, 1))

    @staticmethod
    def _ahead(move: np.ndarray, last: np.ndarray, e: np.ndarray, w: np.ndarray, scale: np.ndarray) -> np.ndarray:
        """The forward recursion through a span, from the states before it; e may be w."""
        onward = np.ascontiguousarray(move.T)
        room = np.empty_like(last)
        for t, (emitted, now) in enumerate(zip(e, w)):
            np.dot(onward, last, room)
            np.multiply(room, emitted, now)
            if t % SCALED == 0:
                s = now.sum(0)
                scale[t // SCALED] = s
                now /= s
            last = now
        return last

    def forward(self, docs: list[np.ndarray]) -> np.ndarray:
        """log10 probability of each class sequence, by the scaled recursion."""
        out = _sums(np.log10(self.prior), docs)
        ratio, move, between = self._joined(float)
        for own, lane, start, classes in self._lanes(docs):
            lanes, steps = classes.shape
            passed, scale = np.empty((steps, lanes)), np.empty((-(-steps // SCALED), lanes))
            last = np.repeat(between[:, None], lanes, axis=1)
            for span in self._spans(classes):
                e = self._emitted(ratio, classes[:, span])[1]
                last = self._ahead(move, last, e, e, scale[span.start // SCALED :])
                passed[span] = e[:, -1]
            # what the lane has come to before a document and after it
            scale = np.log10(scale).cumsum(0)
            before, after = start - 1, start + [len(docs[i]) for i in own]
            out[own] += np.log10(passed[after, lane] / passed[before, lane]) + scale[after // SCALED, lane] - scale[before // SCALED, lane]
        return out

    def counts(self, docs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
        """Baum-Welch counts of whole documents (start, transitions, emissions), and their log10 likelihood before the update.

        The forward states of all steps are held; the backward recursion goes span by span, and each span's posteriors are
        added up while they are in the cache. Scales cancel out in the posteriors.
        """
        kind = np.float32
        ratio, move, between = self._joined(kind)
        moved, seen, log = np.zeros(move.shape), np.zeros((STATES, self.size + 1)), 0.0
        one, room = np.ones(STATES + 1, kind), np.empty(0, kind)
        for _, _, _, classes in self._lanes(docs):
            lanes, steps = classes.shape
            cells = classes.size * (STATES + 1)
            if len(room) < cells:
                room = np.empty(cells, kind)
            w, scale = room[:cells].reshape(steps, STATES + 1, lanes), np.empty((-(-steps // SCALED), lanes), kind)
            edge = np.repeat(between[:, None], lanes, axis=1)
            last, spans = edge, self._spans(classes)
            for span in spans:
                e = self._emitted(ratio, classes[:, span])[1]
                last = self._ahead(move, last, e, w[span], scale[span.start // SCALED :])
            log += np.log10(scale).sum(dtype=float) + np.log10(last.sum(0)).sum(dtype=float)
            after = edge
            for span in reversed(spans):
                obs, x = self._emitted(ratio, classes[:, span])
                b = np.empty_like(x)
                for t in range(len(x) - 1, -1, -1):
                    rest, now = b[t], x[t]
                    np.dot(move, after, rest)
                    if t % SCALED == 0:
                        rest /= rest.sum(0)
                    np.multiply(rest, now, now)
                    after = now
                gamma = np.multiply(w[span], b, out=b)
                inverse = 1 / (one @ gamma)
                gamma *= inverse[:, None]
                at = obs.ravel()
                for s in range(STATES):
                    seen[s] += np.bincount(at, weights=gamma[:, s].ravel(), minlength=self.size + 1)
                inverse[::SCALED] /= scale[span.start // SCALED :][: -(-len(x) // SCALED)]
                x *= inverse[:, None]
                into = max(span.start, 1)
                moved += np.matmul(w[into - 1 : span.stop - 1], x[into - span.start :].swapaxes(1, 2)).sum(0, dtype=float)
        moved *= move
        seen = seen[:, :-1]
        return moved[-1, :-1], moved[:-1, :-1], seen, log + float(seen.sum(0) @ np.log10(self.prior))


def _counts(held):
    """A task's expected counts: one row for each of the states' start and transition rows, one for the likelihood, and one for each class seen."""

    def task(batches):
        m: Model = held.value
        start, move, seen, log = np.zeros(STATES), np.zeros((STATES, STATES)), np.zeros((STATES, m.size)), 0.0
        for batch in batches:
            s, v, e, x = m.counts(_sequences(batch.column(0)))
            start, move, seen, log = start + s, move + v, seen + e, log + x
        used = np.flatnonzero(seen.sum(0))
        at = np.concatenate([[-2 - STATES, -1 - STATES], -1 - np.arange(STATES), used])
        value = np.concatenate([np.full((1, STATES), log), start[None], move, seen[:, used].T])
        if start.sum():
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), *(pa.array(np.ascontiguousarray(value[:, k])) for k in range(STATES))], names=["at", *(f"s{k}" for k in range(STATES))])

    return task


def train(sequences: DataFrame, words: Words, gain: float = GAIN) -> Model:
    """Baum-Welch over all rows of sequences (classes) until a round adds less than gain."""
    model = Model(words.prior)
    context = sequences.sparkSession.sparkContext
    columns = [f"s{k}" for k in range(STATES)]
    last, safe = -np.inf, None
    while words.n:
        held = context.broadcast(model)
        # a row for each class and state: bounded by the model's size
        got = sequences.mapInArrow(_counts(held), "at long, " + ", ".join(f"{c} double" for c in columns)).groupBy("at").agg(*(F.sum(c).alias(c) for c in columns)).toPandas()
        held.unpersist()
        at, value = got["at"].to_numpy(), got[columns].to_numpy()
        move, emit = np.zeros((STATES, STATES)), np.zeros((STATES, model.size))
        for k in range(STATES):
            move[k] += value[at == -1 - k].sum(0)
        emit[:, at[at >= 0]] = value[at >= 0].T
        now = float(value[at == -2 - STATES][0, 0]) / words.n
        if now < last and safe is not None:  # the stretched step went too far
            (model.start, model.move, model.emit), safe = safe, None
            continue
        old = model.start, model.move, model.emit
        model.update(value[at == -1 - STATES].sum(0), move, emit)
        model.likelihood.append(now)
        if now - last < gain:
            break
        last, safe = now, None
        if len(model.likelihood) > 2:
            safe = model.start, model.move, model.emit
            model.stretch(*old)
    return model


def _scores(held):
    """row, ..., classes -> row, ..., path: the classes' log10 probability less what divides the words' counts in them."""

    def task(batches):
        model, inside = held.value
        for batch in batches:
            docs = _sequences(batch.column("classes"))
            path = model.forward(docs) - _sums(inside, docs)
            names = [c for c in batch.schema.names if c != "classes"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(path)], names=[*names, "path"])

    return task


def score_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", modulus: int = 10) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every row of docs."""
    base = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(is_held_out(doc_id, modulus), F.lit(False)).alias("held_out"), F.col(text).alias("text"))
    context = docs.sparkSession.sparkContext
    words, counts = count_words(base.where(~F.col("held_out")))
    held = context.broadcast(words)
    encoded = cut(base.mapInArrow(_encode(held), ENCODED))
    held.unpersist()
    model = train(encoded.where(~F.col("held_out")).select("classes"), words)
    rare = encoded.select("row", F.explode("rare").alias("r")).select("row", "r.word", "r.times").join(counts, "word", "left")
    log = F.col("times") * F.log10(F.coalesce("n", F.lit(0)) + F.lit(ALPHA))
    rare = rare.groupBy("row").agg(F.sum(log).alias("rare_sum"), F.sum(F.when(F.col("n") > 0, F.col("times")).otherwise(0)).alias("rare_known"))
    own = encoded.select("row", "doc_id", "held_out", "n_tokens", "n_known", "known_sum", "classes")
    path = own.mapInArrow(_scores(context.broadcast((model, words.inside))), "row long, doc_id long, held_out boolean, n_tokens long, n_known long, known_sum double, path double")
    log_counts = F.col("known_sum") + F.coalesce("rare_sum", F.lit(0.0))
    norm = float(np.log10(words.n + ALPHA * (words.v + 1)))
    return path.join(rare, "row", "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_known") + F.coalesce("rare_known", F.lit(0))).alias("n_known"),
        F.lit(words.n).cast("long").alias("train_tokens"),
        (log_counts - F.col("n_tokens") * norm).alias("base_score"),
        (F.col("path") + log_counts).alias("score"),
    )
