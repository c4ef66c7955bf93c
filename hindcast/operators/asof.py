"""Nearest match of two tables on time, in both directions (J8 as a table join).

Each left row gets the right row of the same key whose instant is nearest in whole
seconds, the earlier one where two are as near.  Rows are never paired: both tables are
put into one sequence, in which the last right row before a left row and the first one
after it are carried along by two windows, and the nearer of the two is taken.  Right
rows of one second are told apart by the windows' order, so they aren't shuffled to be
combined first.

A key may hold any share of the rows, so the sequence is cut into chunks of time and a
window covers one chunk of one key.  What a chunk needs from its neighbours, the last
right row before it and the first after it, comes from one row for each chunk, made by a
combining aggregate, and enters the chunk as a row of its own at either end.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CHUNK_SECONDS = 86_400


def _carried(column: str, window) -> Column:
    """The last non-NULL value of the sequence so far."""
    return F.last(column, ignorenulls=True).over(window)


def nearest_join(left: DataFrame, right: DataFrame, by: Sequence[str], left_at: str, right_at: str,
                 carry: Sequence[str], prefix: str = "nearest_", chunk_seconds: int = CHUNK_SECONDS) -> DataFrame:
    """``left`` with ``right_at`` and the columns ``carry`` of the nearest right row, named
    with ``prefix``; NULL where the key has no right row.

    Right rows of one key and second: the earliest instant counts, then the least values
    of ``carry``.  NULL keys and NULL instants match nothing; every left row comes out
    once, also repeated ones."""
    keys = [F.col(k).alias(f"k{n}") for n, k in enumerate(by)]
    names = [f"k{n}" for n in range(len(by))]
    second = F.floor(F.unix_micros("at") / 1_000_000)
    found = right.select(*keys, F.struct(F.col(right_at).alias("at"), *(F.col(c) for c in carry)).alias("r"))
    found = found.where(F.col("r.at").isNotNull() & ~F.greatest(*(F.col(k).isNull() for k in names), F.lit(False)))
    found = found.withColumn("at", F.col("r.at")).withColumn("second", second).drop("at")
    asked = left.select(*keys, F.struct(*left.columns).alias("l"), F.col(left_at).alias("at")).withColumn("second", second).drop("at")
    rows = asked.select(*names, "second", "l", F.lit(None).cast(found.schema["r"].dataType).alias("r")).unionByName(
        found.select(*names, "second", F.lit(None).cast(asked.schema["l"].dataType).alias("l"), "r"))
    rows = rows.withColumn("chunk", F.floor(F.col("second") / chunk_seconds))

    # of one second the least right row counts
    least = lambda by: F.min_by("r", F.when(F.col("r").isNotNull(), F.struct(by, "r")))
    ends = rows.groupBy(*names, "chunk").agg(least(F.col("second")).alias("first"), least(-F.col("second")).alias("last"))
    one_key = Window.partitionBy(*names)
    before = one_key.orderBy(F.col("chunk").asc()).rowsBetween(Window.unboundedPreceding, -1)
    after = one_key.orderBy(F.col("chunk").desc()).rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select(*names, "chunk", _carried("last", before).alias("before"), _carried("first", after).alias("after"))
    # one generated row for each end of a chunk that has a neighbour
    edges = ends.select(*names, "chunk", F.explode(F.array(
        F.struct(F.lit(-1).alias("edge"), F.col("before").alias("r")), F.struct(F.lit(1).alias("edge"), F.col("after").alias("r")))).alias("e"))
    edges = edges.select(*names, "chunk", F.lit(None).cast("bigint").alias("second"), "e.edge", "e.r").where(F.col("r").isNotNull())

    line = rows.withColumn("edge", F.lit(0)).unionByName(edges, allowMissingColumns=True)
    # at one second the right rows come first, in both directions, the least of them last
    told_apart = [F.col("r").isNull().cast("int"), F.col("r").desc()]
    one_chunk = Window.partitionBy(*names, "chunk")
    so_far = (Window.unboundedPreceding, Window.currentRow)
    line = line.withColumns({
        "earlier": _carried("r", one_chunk.orderBy("edge", "second", *told_apart).rowsBetween(*so_far)),
        "later": _carried("r", one_chunk.orderBy(F.col("edge").desc(), F.col("second").desc(), *told_apart).rowsBetween(*so_far))})
    gap = lambda c: F.abs(F.floor(F.unix_micros(f"{c}.at") / 1_000_000) - F.col("second"))
    best = F.when(F.col("later").isNull() | (gap("earlier") <= gap("later")), F.col("earlier")).otherwise(F.col("later"))
    told = line.where(F.col("l").isNotNull()).withColumn("best", F.when(F.col("second").isNotNull(), best))
    return told.select("l.*", F.col("best.at").alias(f"{prefix}{right_at}"), *(F.col(f"best.{c}").alias(f"{prefix}{c}") for c in carry))
