"""Helpers shared by the operators: narrow inputs, tables in the shared folder."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from hindcast.session import ensure_checkpoint_dir

TRAIN_FOLDS = 4
HELD_OUT_FOLD = 2
#: Texts handed to Python at a time, so that one batch of very long texts stays small.
ROWS_AT_A_TIME = 256


def stored(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once into the folder that ``spark.checkpoint.dir`` names and read
    it back: later jobs start from the files, also after executors are lost."""
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/tables/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def ship_code(spark: SparkSession) -> None:
    """Give the executors this package, once in an application: Spark serves the
    archive from the driver, so nothing need be installed or shared for it."""
    context = spark.sparkContext
    name = f"hindcast-code-{context.applicationId}.zip"
    if any(name in x for x in context._python_includes):
        return
    top = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    path = os.path.join(tempfile.mkdtemp(), name)
    with zipfile.ZipFile(path, "w") as archive:
        for folder, _, files in os.walk(top):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(folder, f)
                    archive.write(full, os.path.relpath(full, os.path.dirname(top)))
    context.addPyFile(path)


def texts(docs: DataFrame, *columns: str) -> DataFrame:
    """Only ``doc_id``, the named columns and ``text`` (null becomes empty): columns
    of other names, whatever they are, never meet an operator's own."""
    return docs.select("doc_id", *columns, F.coalesce(F.col("text"), F.lit("")).alias("text"))


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, mod 4; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % F.lit(TRAIN_FOLDS)


def held_out(doc_id: Column) -> Column:
    return fold(doc_id) == F.lit(HELD_OUT_FOLD)


def slices(batches: Iterator[pa.RecordBatch], rows: int = ROWS_AT_A_TIME) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def map_texts(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], dict]], schema: str) -> DataFrame:
    """Run ``make()`` once in each task, then its result on slices of the input;
    it returns a list for each column of ``schema``."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    ship_code(df.sparkSession)
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for part in slices(batches):
            made = work(part)
            yield pa.RecordBatch.from_arrays([pa.array(made[f.name], f.type) for f in arrow], schema=arrow)

    return df.mapInArrow(run, schema)


def labelled(spark: SparkSession, docs: DataFrame, labels: DataFrame, label: str, limit: int) -> DataFrame:
    """At most ``limit`` labelled rows outside the held-out fold, those of lowest
    hashed id: (doc_id, label, fold, text).

    The ids are at most ``limit`` rows of 12 bytes, so they may be broadcast.  Where
    one document has several labels the largest counts; labels without a document,
    and null labels, are left out.
    """
    known = labels.select(F.col("doc_id"), F.col(label).cast("int").alias("label")).where(
        F.col("label").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max("label").alias("label"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
    return texts(docs).join(F.broadcast(chosen), "doc_id").select(
        "doc_id", "label", fold(F.col("doc_id")).alias("fold"), "text")


class WordNumbers:
    """64-bit numbers of a text's words, which \\x20 and \\x09-\\x0D part.

    A word's number is a polynomial of its bytes, made for all words at once from running
    sums: the sum of byte code x base^place over the word, brought back to place 0 by the
    inverse power, and then mixed.  Long texts are read in pieces that end at white space."""

    PIECE = 1 << 18
    WHITE = b" \t\n\x0b\f\r"

    def __init__(self, salt: int = 0):
        rng = np.random.default_rng(61 + salt)
        self.codes = rng.integers(0, 2**64, 256, np.uint64)
        self.base = int(rng.integers(0, 2**64, dtype=np.uint64)) | 1
        self.mix = rng.integers(0, 2**64, dtype=np.uint64) | np.uint64(1)
        self.powers = self.inverses = np.ones(0, np.uint64)

    def _reach(self, n: int) -> None:
        if len(self.powers) < n:
            size = max(n, self.PIECE)
            for name, base in (("powers", self.base), ("inverses", pow(self.base, -1, 2**64))):
                setattr(self, name, np.multiply.accumulate(np.r_[np.uint64(1), np.full(size - 1, base, np.uint64)]))

    def _piece(self, raw: np.ndarray) -> np.ndarray:
        inside = np.zeros(len(raw) + 2, np.int8)
        inside[1:-1] = (raw != 0x20) & ((raw < 0x09) | (raw > 0x0D))
        edges = np.flatnonzero(np.diff(inside))
        starts, ends = edges[::2], edges[1::2]
        self._reach(len(raw))
        sums = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum(self.codes[raw] * self.powers[:len(raw)], out=sums[1:])
        h = (sums[ends] - sums[starts]) * self.inverses[starts]
        h = (h ^ (h >> np.uint64(32))) * self.mix
        return h ^ (h >> np.uint64(29))

    def of(self, told: bytes) -> np.ndarray:
        if len(told) <= self.PIECE:
            return self._piece(np.frombuffer(told, np.uint8))
        out, at = [], 0
        while at < len(told):
            end = min(at + self.PIECE, len(told))
            while end < len(told) and told[end] not in self.WHITE:
                end += 1
            out.append(self._piece(np.frombuffer(told, np.uint8, end - at, at)))
            at = end
        return np.concatenate(out)
