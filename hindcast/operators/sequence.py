"""Previous-row lookups in an ordered sequence (W6) and dense numbering (ST6)."""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hindcast.session import ensure_checkpoint_dir


def previous_in_sequence(df: DataFrame, partition_by: Sequence[str], order_by: Sequence[str],
                         carry: Mapping[str, str]) -> DataFrame:
    """Add ``carry[src]`` = value of ``src`` in the previous row of the same
    ``partition_by`` group ordered by ``order_by`` (ascending, NULLs first).

    For groups of bounded size: W6 groups hold the runs that forecast one hour
    of one location and model, at most the runs of the forecast horizon."""
    w = Window.partitionBy(*partition_by).orderBy(*order_by)
    return df.withColumns({dst: F.lag(src).over(w) for src, dst in carry.items()})


def dense_index(df: DataFrame, order_by: Sequence[str], as_col: str = "idx",
                num_partitions: int | None = None) -> DataFrame:
    """1-based dense positions of rows in ``order_by`` order, without a
    single-partition window.

    The rows are range-partitioned and written once with their slice, into the
    shared checkpoint folder; every later step reads those files, so slices
    can't differ between the numbering inside a slice and the counts of earlier
    slices (a table of at most ``num_partitions`` rows, broadcast)."""
    spark = df.sparkSession
    n = num_partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/tables/dense-{uuid.uuid4().hex}"
    df.repartitionByRange(n, *order_by).withColumn("__slice", F.spark_partition_id()).write.parquet(path)
    rows = spark.read.parquet(path)
    before = Window.orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)  # over <= n rows
    offsets = rows.groupBy("__slice").agg(F.count(F.lit(1)).alias("__n")).select(
        "__slice", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    inside = F.row_number().over(Window.partitionBy("__slice").orderBy(*order_by))
    numbered = rows.withColumn("__nth", inside).join(F.broadcast(offsets), "__slice")
    return numbered.withColumn(as_col, (F.col("__before") + F.col("__nth")).cast("bigint")).drop(
        "__slice", "__nth", "__before")
