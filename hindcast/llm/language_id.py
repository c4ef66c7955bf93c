"""Operator 13, language by hyperdimensional profiles.

Every symbol (a letter in lower case, a combining mark, or the gap between words) has
a random vector of ``DIMENSIONS`` signs that follows from a hash of the symbol.  An
n-gram of ``NGRAM`` symbols binds them: each vector is permuted (rotated) by its
place and they are multiplied sign by sign.  A text bundles the vectors of all its
n-grams by summing them.  A language's prototype sums the bundles of its texts, each
made one unit long, and a text's language is the prototype of greatest cosine.

Bundles are exact sums of whole numbers.  The bundles of training texts are rounded to
``UNIT`` parts before they are summed, first within a task and then in Spark, so that
prototypes do not depend on how rows are dealt out.  They cover all training texts;
only one vector for each language comes to the driver and goes to the tasks, so their
bytes follow the number of languages, not of texts.

Rows: null texts and texts without a letter are ``und`` with score 0, and so is every
text where no language was learned; ties go to the language that sorts first (by code
points); null languages teach nothing, and a null id is in fold 0 of the empty text's
hash; repeated rows get equal results and teach as often as they come; an empty table
gives no rows; texts are read whole, in pieces of ``SYMBOLS_AT_A_TIME``; columns other
than ``doc_id``, ``text`` and, when learning, ``lang`` are ignored.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from hindcast.llm.common import ship_code, slices
from hindcast.sources.tables import read_table

DIMENSIONS, NGRAM = 1024, 3
FOLDS = 5
UNIT = 1_000_000
UNKNOWN = "und"
#: Bounds of one step of a task: symbols read, rows bundled, n-grams expanded to vectors.
SYMBOLS_AT_A_TIME, ROWS_AT_A_TIME, GRAMS_AT_A_TIME = 1_000_000, 256, 4096
#: Languages that a task sums before it hands on what it has.
LANGUAGES_AT_A_TIME = 1000


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % F.lit(FOLDS) == F.lit(0)


def symbol_vector(symbol: int, dimensions: int = DIMENSIONS) -> np.ndarray:
    """The signs of a code point (0: the gap between words)."""
    told = b"".join(blake2b(f"{symbol}:{k}".encode(), digest_size=64).digest() for k in range(-(-dimensions // 512)))
    return np.unpackbits(np.frombuffer(told, np.uint8))[:dimensions].astype(np.int8) * 2 - 1


class Profiler:
    """Bundles of texts.  Symbols get small numbers as they are met; the table of their
    vectors grows with the letters of the scripts in use."""

    def __init__(self, dimensions: int = DIMENSIONS):
        self.dimensions = dimensions
        self.number = np.full(0x110000, -1, np.int32)  # of a code point's symbol
        self.symbols = {0: 0}
        self.vectors = symbol_vector(0, dimensions)[None, :]

    def _meet(self, points: np.ndarray) -> None:
        fresh = []
        for p in points.tolist():
            c = chr(p)
            kept = c.isalpha() or unicodedata.category(c)[0] == "M"
            symbol = ord(c.lower()[0]) if kept else 0
            if symbol not in self.symbols:
                self.symbols[symbol] = len(self.symbols)
                fresh.append(symbol_vector(symbol, self.dimensions))
            self.number[p] = self.symbols[symbol]
        if fresh:
            self.vectors = np.vstack([self.vectors, fresh])

    def numbers(self, text: str) -> np.ndarray:
        """The text's symbols, one gap before, between and after its words; empty where
        the text has no letter."""
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        found = self.number[points]
        if (found < 0).any():
            self._meet(np.unique(points[found < 0]))
            found = self.number[points]
        if not found.any() or not any(map(str.isalpha, text)):
            return found[:0]
        found = np.concatenate([[0], found, [0]]).astype(np.int32)
        return found[(found > 0) | (np.concatenate([[1], found[:-1]]) > 0)]

    def _grams(self, parts: list[tuple[int, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, n-gram, count) of pieces of rows; an n-gram is a number in base ``size``."""
        size = len(self.vectors)
        codes = []
        for row, found in parts:
            code = np.full(len(found) - NGRAM + 1, row, np.int64)
            for k in range(NGRAM):
                code = code * size + found[k:k + len(code)]
            codes.append(code)
        code, times = np.unique(np.concatenate(codes), return_counts=True)
        return *np.divmod(code, size**NGRAM), times

    def gram_vectors(self, grams: np.ndarray) -> np.ndarray:
        """The bound vectors of n-grams: symbol k from the end is rotated k places."""
        size, out, rest = len(self.vectors), None, grams
        for k in range(NGRAM):
            rest, symbol = np.divmod(rest, size)
            turned = np.roll(self.vectors, k, axis=1)[symbol]
            out = turned if out is None else out * turned
        return out

    def bundles(self, told: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(row x dimension sums, rows that have a letter)."""
        out, letters = np.zeros((len(told), self.dimensions)), np.zeros(len(told), bool)
        waiting, size = [], 0

        def settle():
            row, gram, times = self._grams(waiting)
            each, at = np.unique(gram, return_inverse=True)
            for low in range(0, len(each), GRAMS_AT_A_TIME):
                vectors = self.gram_vectors(each[low:low + GRAMS_AT_A_TIME]).astype(np.float32)
                here = (at >= low) & (at < low + GRAMS_AT_A_TIME)
                kept, place = np.unique(row[here], return_inverse=True)
                counts = np.zeros((len(kept), len(vectors)), np.float32)
                counts[place, at[here] - low] = times[here]
                out[kept] += counts @ vectors
            waiting.clear()

        for row, text in enumerate(told):
            found = self.numbers(text or "")
            letters[row] = len(found) > 0
            for low in range(0, len(found) - NGRAM + 1, SYMBOLS_AT_A_TIME):
                part = found[low:low + SYMBOLS_AT_A_TIME + NGRAM - 1]
                waiting.append((row, part))
                size += len(part)
                if size >= SYMBOLS_AT_A_TIME:
                    settle()
                    size = 0
        if waiting:
            settle()
        return out, letters


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=-1, keepdims=True), 1e-12)


class Model:
    """Languages in order and their prototypes, one unit long."""

    def __init__(self, languages: list[str], prototypes: np.ndarray):
        self.languages, self.prototypes = languages, prototypes

    def predicted(self, profiler: Profiler, told: list[str | None]) -> tuple[list[str], list[float]]:
        if not self.languages or not told:
            return [UNKNOWN] * len(told), [0.0] * len(told)
        bundles, letters = profiler.bundles(told)
        cosines = np.round(_unit(bundles) @ self.prototypes.T, 9)
        best = cosines.argmax(axis=1)
        score = np.clip(cosines[np.arange(len(told)), best], 0, 1)
        return ([self.languages[b] if has else UNKNOWN for b, has in zip(best, letters)],
                np.where(letters, score, 0.0).tolist())


def fitted(docs: DataFrame, dimensions: int = DIMENSIONS) -> Model:
    """The prototypes of ``docs`` (doc_id, text, lang), from all rows outside the
    held-out fold that name a language."""
    taught = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id")))
    ship_code(docs.sparkSession)

    def handed(sums: dict[str, np.ndarray]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), pa.array(list(sums.values()), pa.list_(pa.int64()))],
                                          names=["language", "sums"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        profiler, sums = Profiler(dimensions), {}
        for batch in slices(batches, ROWS_AT_A_TIME):
            bundles, _ = profiler.bundles(batch.column("text").to_pylist())
            units = np.rint(_unit(bundles) * UNIT).astype(np.int64)
            languages, at = np.unique(np.array(batch.column("language").to_pylist(), object), return_inverse=True)
            for k, language in enumerate(languages.tolist()):
                sums[language] = sums.get(language, 0) + units[at == k].sum(axis=0)
            if len(sums) >= LANGUAGES_AT_A_TIME:
                yield handed(sums)
                sums = {}
        if sums:
            yield handed(sums)

    made = taught.select(F.col("lang").alias("language"), "text").mapInArrow(run, "language string, sums array<long>")
    total = made.select("language", F.posexplode("sums").alias("place", "value")).groupBy("language", "place").agg(
        F.sum("value").alias("value")).groupBy("language").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("place", "value"))), lambda x: x["value"]).alias("sums"))
    rows = sorted(total.collect(), key=lambda r: r.language)
    rows = [r for r in rows if any(r.sums)]
    return Model([r.language for r in rows], _unit(np.array([r.sums for r in rows], float).reshape(len(rows), dimensions)))


def scored(docs: DataFrame, model: Model, dimensions: int = DIMENSIONS) -> DataFrame:
    """(doc_id, lang_pred, score) for each row of ``docs``."""
    ship_code(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        profiler = Profiler(dimensions)
        for batch in slices(batches, ROWS_AT_A_TIME):
            languages, scores = model.predicted(profiler, batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(languages, pa.string()), pa.array(scores, pa.float64())],
                                             names=["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, lang_pred string, score double")


def op13_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document."""
    docs = read_table(spark, sf_dir, "documents")
    return scored(docs, fitted(docs)).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
