"""Operator 9, best-fit packing planned on a histogram of lengths.

1. Every document becomes ids and an end id; longer ones than a sequence are cut
   into full pieces, of which the first may be shorter.  The pieces are written once,
   each with the task that made it and its rank among that task's pieces of one
   length, so that ranks stay as they are if executors are lost later.
2. The histogram, at most one row for each length up to the capacity, goes to the
   driver.  Best fit with lengths in falling order runs over counts: sequences with
   the same content so far are one group, and a length's whole count fills groups at
   a time.
3. The plan gives each length runs of ranks with their sequences and offsets.  A
   piece's rank over all tasks is the count of earlier tasks plus its own rank; it
   takes its slot by joining on length and rank.

No row moves for a hot length: ranks come from counts by (length, task).

Rows: null text counts as empty, which is the end id alone; repeated rows are packed
as often as they come; a null ``doc_id`` stays null; an empty table gives no rows;
columns other than ``doc_id`` and ``text`` are ignored.
"""

from __future__ import annotations

from bisect import insort
from collections import Counter

from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from hindcast.llm.common import map_texts, stored, texts
from hindcast.llm.encoder import default_path, encoder, packed
from hindcast.sources.tables import read_table

CAPACITY, END_ID = 2048, 0
#: A plan beyond this many runs (3 MB) is joined by shuffle instead of broadcast.
RUNS_BROADCAST = 50_000

Run = tuple[int, int, int, int, int, int]  # length, first rank, end rank, first sequence, pieces in each, offset


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[Run]:
    """Best fit, longest first: a piece goes to the fullest sequence that has room.

    A group is sequences of like content: [room, pieces, ids, first sequence].  The
    fullest fitting group takes as many of the length as it has room for in each
    sequence; where the count ends inside a group, the rest of the group stays open.
    """
    runs: list[Run] = []
    open_: list[tuple[int, int, int]] = []  # (room, first sequence, sequences), by room
    new = 0
    for length in sorted(histogram, reverse=True):
        if not 0 < length <= capacity:
            raise ValueError(f"length {length} does not fit {capacity}")
        rank, left = 0, histogram[length]
        at = next((n for n, g in enumerate(open_) if g[0] >= length), len(open_))
        fits, open_ = open_[at:], open_[:at]
        fits.reverse()  # the fullest last
        while left:
            if fits:
                room, first, count = fits.pop()
            else:
                room, first = capacity, new
                count = -(-left // (capacity // length))
                new += count
            each = room // length
            whole = min(count, left // each)
            if whole:
                runs.append((length, rank, rank + whole * each, first, each, capacity - room))
                rank, left = rank + whole * each, left - whole * each
                if room - each * length:
                    insort(open_, (room - each * length, first, whole))
            if whole < count and left < each:  # the count ends here
                if left:
                    runs.append((length, rank, rank + left, first + whole, left, capacity - room))
                    insort(fits, (room - left * length, first + whole, 1))
                    whole += 1
                    left = 0
                if whole < count:
                    insort(fits, (room, first + whole, count - whole))
        open_ = sorted([*open_, *fits])
    return runs


def pieces(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """(doc_id, piece, start, length, ids, task, task_rank): the pieces to be packed,
    ids as 4-byte little-endian numbers.  Write it before ranks are used twice."""
    path, end = path or default_path(), packed([end_id])

    def make():
        words, task, seen = encoder(path), TaskContext.get().partitionId(), Counter()

        def work(batch):
            out = {k: [] for k in ("doc_id", "piece", "start", "length", "ids", "task", "task_rank")}
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                ids = words.encode(text) + end
                n, start, piece = len(ids) // 4, 0, 0
                while start < n:
                    length = (n - start) % capacity or capacity
                    for k, v in zip(out, (doc, piece, start, length, ids[4 * start:4 * (start + length)], task, seen[length])):
                        out[k].append(v)
                    seen[length] += 1
                    start, piece = start + length, piece + 1
            return out
        return work

    return map_texts(texts(docs), make, "doc_id long, piece int, start long, length long, ids binary, task int, task_rank long")


def place(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``cut`` (written pieces) with sequence_id and offset, without ids."""
    spark = cut.sparkSession
    counts = cut.groupBy("length", "task").agg(F.count(F.lit(1)).alias("n"))
    counts = stored(spark, counts, "packing-counts")
    histogram = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    earlier = counts.select("length", "task", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("earlier"))
    runs = plan(histogram, capacity)
    table = spark.createDataFrame(runs, "run_length long, first_rank long, end_rank long, first_sequence long, each long, filled long")
    if len(runs) <= RUNS_BROADCAST:
        table = F.broadcast(table)
    ranked = cut.drop("ids").join(earlier, ["length", "task"]).withColumn("rank", F.col("earlier") + F.col("task_rank"))
    placed = ranked.join(table, (F.col("length") == F.col("run_length")) & (F.col("rank") >= F.col("first_rank"))
                         & (F.col("rank") < F.col("end_rank")))
    nth = F.col("rank") - F.col("first_rank")
    return placed.withColumn("sequence_id", F.col("first_sequence") + F.floor(nth / F.col("each"))).withColumn(
        "offset", F.col("filled") + (nth % F.col("each")) * F.col("length")).drop(*table.columns, "earlier", "rank")


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of at most 2048 ids."""
    return packed_documents(spark, read_table(spark, sf_dir, "documents"))


def packed_documents(spark: SparkSession, docs: DataFrame) -> DataFrame:
    cut = stored(spark, pieces(docs), "packing-pieces")
    placed = place(cut.withColumn("ids_crc32", F.crc32("ids")))
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
