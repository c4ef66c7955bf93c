"""Operator 2, quality: random-indexing word vectors pooled for each document, then a
network of two layers with temperature-calibrated probabilities.

Learning, on at most ``FIT_ROWS`` labelled rows outside the held-out fold:
1. A word gives two items, its letters in lower case and its shape (capitals, digits,
   signs); a pair of words gives one of two marks, new or seen before in the text.
2. Every item has a sparse random index vector, which follows from a hash of the item.
   The ``VOCABULARY`` items that most texts of the sample hold also get a context
   vector, the sum of the index vectors of the items within two words to either side,
   over the sample, made one unit long; it is added to their index vector.  An item
   beyond them is its index vector alone.
3. A document's vector is the mean of the vectors of all its items.  The network (one hidden
   layer) is fitted on two folds by gradient steps; its temperature on the third.

Rows: null and empty texts have the vector of zeros; without labels, or with one class
only, every score is the sample's share of good texts, smoothed; repeated rows get
equal results; an empty table gives no rows; columns other than ``doc_id`` and
``text`` are ignored, and labels, language, source and ids are no input of a score.
"""

from __future__ import annotations

import re
from collections import Counter
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from hindcast.llm.common import WordNumbers, held_out, labelled, map_texts, ship_code, slices, stored, texts
from hindcast.sources.tables import read_table

FIT_ROWS = 8000
VOCABULARY = 6000
DIMENSIONS, NONZERO = 96, 8
REACH = 2
#: Tasks that sum word vectors; each hands one matrix of the vocabulary to the driver.
VECTOR_TASKS = 8
HIDDEN, EPOCHS, BATCH, RATE, DECAY = 32, 40, 128, 3e-3, 1e-4
CALIBRATION_FOLD = 3
#: Words that a task keeps in its table; characters of text that it takes together.
WORDS_KEPT, CHARS_AT_A_TIME = 200_000, 1_000_000
THRESHOLD = 0.7

_EDGE = re.compile(r"^[\W_]+|[\W_]+$")
NEW, SEEN = "<new>", "<seen>"


class _Classes(dict):
    """Letters of a shape by code point, filled as they are met."""

    def __missing__(self, point: int) -> str:
        c = chr(point)
        self[point] = kind = "9" if c.isdigit() else "A" if c.isupper() else "a" if c.isalpha() else c
        return kind


_CLASSES = _Classes()


def shape(word: str) -> str:
    """Its classes of characters, runs as one."""
    if word.isalpha() and word.islower():
        return "s:a"
    if word[:-1].isalpha() and word[:-1].islower() and word[-1] in ",.":
        return "s:a" + word[-1]
    return "s:" + "".join(k for k, _ in groupby(word.translate(_CLASSES)))


def items(word: str) -> tuple[str, str]:
    bare = word.lower()
    if not (bare[:1].isalnum() and bare[-1:].isalnum()):
        bare = _EDGE.sub("", bare)
    return "w:" + bare, shape(word)


_ITEM_NUMBERS = WordNumbers()


def index_places(told: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Places and values of items' sparse index vectors, from 64-bit numbers of the items
    (which hold no white space): a byte for each place, a bit of their mix for each sign."""
    h = _ITEM_NUMBERS.of("\n".join(told).encode("utf-8", "surrogatepass"))
    signs = (h * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - NONZERO)
    signs = (signs[:, None] >> np.arange(NONZERO, dtype=np.uint64)) & np.uint64(1)
    return h.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :NONZERO] % DIMENSIONS, (signs * 2.0 - 1) / NONZERO**0.5


def index_vectors(told: list[str]) -> np.ndarray:
    out = np.zeros((len(told), DIMENSIONS))
    places, values = index_places(told)
    np.add.at(out, (np.arange(len(told))[:, None], places), values)
    return out


class Reader:
    """Items of texts by number; those beyond the vocabulary have number -1 and their
    index vectors' places.  A word is looked at once; the table of words is begun anew
    when it is full."""

    def __init__(self, vocabulary: dict[str, int]):
        self.vocabulary = vocabulary
        self._begin()

    def _begin(self) -> None:
        self.words: dict[str, int] = {}
        self.numbers = np.zeros((0, 2), np.int64)
        self.places = np.zeros((0, 2, NONZERO), np.uint8)
        self.values = np.zeros((0, 2, NONZERO), np.float32)

    def _meet(self, fresh: list[str]) -> None:
        """Put words into the table, whose arrays double as they fill."""
        at, get = len(self.words), self.vocabulary.get
        both = [i for w in fresh for i in items(w)]
        numbers = np.array([get(i, -1) for i in both], np.int64)
        places, values = np.zeros((len(both), NONZERO), np.uint8), np.zeros((len(both), NONZERO))
        beyond = np.flatnonzero(numbers < 0)
        places[beyond], values[beyond] = index_places([both[k] for k in beyond.tolist()])
        end = at + len(fresh)
        if end > len(self.numbers):
            size = max(end, 2 * len(self.numbers))
            for name in ("numbers", "places", "values"):
                old = getattr(self, name)
                new = np.zeros((size, *old.shape[1:]), old.dtype)
                new[:at] = old[:at]
                setattr(self, name, new)
        self.numbers[at:end] = numbers.reshape(-1, 2)
        self.places[at:end] = places.reshape(-1, 2, NONZERO)
        self.values[at:end] = values.reshape(-1, 2, NONZERO)
        self.words.update(zip(fresh, range(at, end)))

    def ids(self, words: list[str]) -> np.ndarray:
        """Rows of the table of words."""
        distinct = set(words)
        fresh = distinct.difference(self.words)
        if fresh:
            if len(self.words) >= WORDS_KEPT:
                self._begin()
                fresh = distinct
            self._meet(list(fresh))
        return np.fromiter(map(self.words.__getitem__, words), np.int64, len(words))

    def pairs(self, words: list[str]) -> np.ndarray:
        """word x item numbers of a text."""
        ids = self.ids(words)
        return self.numbers[ids].reshape(-1, 2)

    def pooled(self, told: list[str], vectors: np.ndarray) -> np.ndarray:
        """The texts' vectors, a row each: means over all items.  Texts are taken
        together up to ``CHARS_AT_A_TIME``."""
        out, at = np.zeros((len(told), DIMENSIONS)), 0
        while at < len(told):
            end, chars = at + 1, len(told[at])
            while end < len(told) and chars + len(told[end]) <= CHARS_AT_A_TIME:
                chars += len(told[end])
                end += 1
            out[at:end] = self._pooled([t.split() for t in told[at:end]], vectors)
            at = end
        return out

    def _pooled(self, words: list[list[str]], vectors: np.ndarray) -> np.ndarray:
        rows, lengths = len(words), np.array([len(w) for w in words])
        ids = self.ids([x for w in words for x in w])
        if not len(ids):
            return np.zeros((rows, DIMENSIONS))
        row = np.repeat(np.arange(rows), lengths)
        both = self.numbers[ids]
        flat, of = both.ravel(), np.repeat(row, 2)
        known, size = flat >= 0, len(vectors)
        counts = np.bincount(of[known] * size + flat[known], minlength=rows * size).reshape(rows, size).astype(float)
        # a pair of words of one text is new or has been seen there before
        inside = row[1:] == row[:-1]
        width = len(self.words)
        pairs = np.sort(((row[1:] * width + ids[:-1]) * width + ids[1:])[inside])
        first = pairs[np.r_[True, pairs[1:] != pairs[:-1]]] if len(pairs) else pairs
        new = np.bincount(first // width**2, minlength=rows)
        for mark, n in ((NEW, new), (SEEN, np.maximum(lengths - 1, 0) - new)):
            if mark in self.vocabulary:
                counts[:, self.vocabulary[mark]] += n
        out = counts @ vectors
        rare = (both < 0).any(axis=1)
        if rare.any():  # items of words beyond the vocabulary: their index vectors
            cell = row[rare, None, None] * DIMENSIONS + self.places[ids[rare]]
            out += np.bincount(cell.ravel(), self.values[ids[rare]].ravel(), rows * DIMENSIONS).reshape(rows, DIMENSIONS)
        return out / np.maximum(3 * lengths, 1)[:, None]


class Network:
    """sigmoid(logit / temperature) of one hidden layer over standardized vectors."""

    def __init__(self, centre, spread, w1, b1, w2, b2, temperature=1.0):
        self.centre, self.spread, self.w1, self.b1, self.w2, self.b2 = centre, spread, w1, b1, w2, b2
        self.temperature = temperature

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.centre) / self.spread @ self.w1 + self.b1) @ self.w2 + self.b2

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -50, 50)))


def train(x: np.ndarray, y: np.ndarray) -> Network:
    """Adam on the mean log loss."""
    rng = np.random.default_rng(2)
    net = Network(x.mean(axis=0), x.std(axis=0) + 1e-3, rng.normal(0, x.shape[1] ** -0.5, (x.shape[1], HIDDEN)),
                  np.zeros(HIDDEN), rng.normal(0, HIDDEN**-0.5, HIDDEN), np.zeros(1))
    z = (x - net.centre) / net.spread
    weights = [net.w1, net.b1, net.w2, net.b2]
    first, second, step = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights], 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(y))
        for at in range(0, len(y), BATCH):
            k = order[at:at + BATCH]
            hidden = np.tanh(z[k] @ net.w1 + net.b1)
            error = (1 / (1 + np.exp(-np.clip(hidden @ net.w2 + net.b2, -50, 50))) - y[k]) / len(k)
            back = error[:, None] * net.w2 * (1 - hidden**2)
            slopes = [z[k].T @ back + DECAY * net.w1, back.sum(axis=0), hidden.T @ error + DECAY * net.w2, error.sum(keepdims=True)]
            step += 1
            for w, g, m, v in zip(weights, slopes, first, second):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                w -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return net


def temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """The temperature of least log loss, by a search on its logarithm."""
    grid = np.exp(np.linspace(-2, 3, 101))
    sign = np.where(y > 0, 1.0, -1.0) * logits
    return float(grid[int(np.argmin([np.logaddexp(0, -sign / t).mean() for t in grid]))])


class Model:
    def __init__(self, vocabulary: dict[str, int], vectors: np.ndarray, net: Network | None, share: float):
        self.vocabulary, self.vectors, self.net, self.share = vocabulary, vectors, net, share


def _vocabulary(sample: DataFrame) -> dict[str, int]:
    def run(batches):
        seen: Counter = Counter()
        for batch in slices(batches):
            for text in batch.column("text").to_pylist():
                seen.update({i for w in set(text.split()) for i in items(w)})
        told = list(seen.items())
        yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in told], pa.string()), pa.array([n for _, n in told], pa.int64())],
                                         names=["item", "n"])

    ship_code(sample.sparkSession)
    made = sample.select("text").mapInArrow(run, "item string, n long").groupBy("item").agg(F.sum("n").alias("n"))
    rows = made.orderBy(F.desc("n"), "item").limit(VOCABULARY).collect()
    return {i: k for k, i in enumerate([NEW, SEEN, *(r.item for r in rows)])}


def _vectors(sample: DataFrame, vocabulary: dict[str, int]) -> np.ndarray:
    size = len(vocabulary)

    def run(batches):
        reader, index = Reader(vocabulary), index_vectors(list(vocabulary))
        out = np.zeros((size, DIMENSIONS))
        for batch in slices(batches):
            codes = []
            for text in batch.column("text").to_pylist():
                pairs = reader.pairs(text.split())
                for back in range(1, REACH + 1):
                    for a in pairs.T:
                        for b in pairs.T:
                            one, two = a[back:], b[:-back]
                            good = (one >= 0) & (two >= 0)
                            codes += [one[good] * size + two[good], two[good] * size + one[good]]
            if not codes:
                continue
            code, times = np.unique(np.concatenate(codes), return_counts=True)
            for at in range(0, len(code), 100_000):
                row, column = np.divmod(code[at:at + 100_000], size)
                starts = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
                out[row[starts]] += np.add.reduceat(index[column] * times[at:at + 100_000, None], starts)
        yield pa.RecordBatch.from_arrays([pa.array([out.astype("<f8").tobytes()], pa.binary())], names=["matrix"])

    rows = sample.select("text").repartition(VECTOR_TASKS).mapInArrow(run, "matrix binary").toLocalIterator()
    total = np.zeros((size, DIMENSIONS))
    for r in rows:
        total += np.frombuffer(bytes(r.matrix), "<f8").reshape(size, DIMENSIONS)
    index = index_vectors(list(vocabulary))
    return total / np.maximum(np.linalg.norm(total, axis=1, keepdims=True), 1e-9) + index


def fitted(spark: SparkSession, docs: DataFrame, labels: DataFrame, limit: int = FIT_ROWS) -> Model:
    """The model; everything that reaches the driver is bounded by ``limit`` rows, the
    vocabulary and ``VECTOR_TASKS``."""
    sample = stored(spark, labelled(spark, docs, labels, "quality", limit), "quality-sample")
    counts = {r.label: r.n for r in sample.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    share = (counts.get(1, 0) + 0.5) / (sum(counts.values()) + 1)
    if not (counts.get(0) and counts.get(1)):
        return Model({}, np.zeros((0, DIMENSIONS)), None, share)
    vocabulary = _vocabulary(sample)
    vectors = _vectors(sample, vocabulary)

    def make():
        reader = Reader(vocabulary)

        def work(batch):
            return {"label": batch.column("label"), "fold": batch.column("fold"),
                    "x": list(reader.pooled(batch.column("text").to_pylist(), vectors))}
        return work

    rows = map_texts(sample.select("label", "fold", "text"), make, "label int, fold long, x array<double>").collect()
    x, y, fold = np.array([r.x for r in rows]), np.array([r.label for r in rows], float), np.array([r.fold for r in rows])
    fit = fold != CALIBRATION_FOLD
    if len(set(y[fit])) < 2:
        fit = np.ones(len(y), bool)
    net = train(x[fit], y[fit])
    rest = ~fit if (~fit).any() else fit
    net.temperature = temperature(net.logits(x[rest]), y[rest])
    return Model(vocabulary, vectors, net, share)


def scores(model: Model, reader: Reader, told: list[str]) -> list[float]:
    if model.net is None or not told:
        return [model.share] * len(told)
    return model.net.scores(reader.pooled(told, model.vectors)).tolist()


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) for each row."""

    def make():
        reader = Reader(model.vocabulary)

        def work(batch):
            return {"doc_id": batch.column("doc_id"), "score": scores(model, reader, batch.column("text").to_pylist())}
        return work

    return map_texts(texts(docs), make, "doc_id long, score double")


def good(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, all columns, that score ``threshold`` or more; all rows
    where no model could be learned."""
    if model.net is None:
        return docs
    at = docs.columns.index("text")

    def run(batches):
        reader = Reader(model.vocabulary)
        for batch in slices(batches):
            told = [x or "" for x in batch.column(at).to_pylist()]
            yield batch.filter(pa.array([s >= threshold for s in scores(model, reader, told)], pa.bool_()))

    ship_code(docs.sparkSession)
    return docs.mapInArrow(run, docs.schema)


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document."""
    docs = read_table(spark, sf_dir, "documents")
    made = scored(docs, fitted(spark, docs, read_table(spark, sf_dir, "labels")))
    return made.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
                       (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
