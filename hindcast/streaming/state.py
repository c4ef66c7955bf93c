"""ST3 + ST4 streaming: the latest snapshot of each location, kept by Spark's state store.

The state is a streaming aggregate: one row for each location, the newest valid record
by the strictly-newer rule.  Its store writes what a micro-batch changes, and so does
the sink: only the locations of the batch are decoded and written, into the batch's own
partition of a change table, which a replay of the batch overwrites.  Nothing rewrites
the state, so bytes written follow the batch.  The current table is the newest change of
each location; hourly and daily children are exploded from its own arrays, so they can't
disagree with it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hindcast.operators import latest as L
from hindcast.operators.dedup import newest_only
from hindcast.sources.sinks import replay_safe_load
from hindcast.streaming.io import run_available_now, where_not_empty

RECORD = ["topic", "partition", "offset", "key", "timestamp", "value"]


def _newest_first_arrival() -> Column:
    """The order of ST3: greatest retrieval, then the earliest arrival."""
    return F.struct(F.col("retrieved_at"), (-F.unix_micros("timestamp")).alias("a"),
                    (-F.col("partition")).alias("p"), (-F.col("offset")).alias("o"))


def stateful_latest(events: DataFrame, valid: str | None = None) -> DataFrame:
    """ST3 as a stateful aggregation (update mode): (location_id, latest), the row of the
    newest event.  ``valid`` names a boolean column; only those events are applied, and
    ``latest`` is NULL where a location has none."""
    order = _newest_first_arrival()
    if valid:
        order = F.when(F.col(valid), order)
    kept = [c for c in events.columns if c != valid]
    return events.groupBy("location_id").agg(F.max_by(F.struct(*kept), order).alias("latest"))


def latest_changes(log: DataFrame) -> DataFrame:
    """ST5 + P21 + ST3: log records -> the newest valid record of each location."""
    screened = L.hot_state_violations(L.decode_latest_events(log, full=False))
    valid = (F.size("violations") == 0).alias("__valid")
    return stateful_latest(screened.select("location_id", "retrieved_at", *RECORD, valid), "__valid")


def change_writer(path: str):
    """Writes a micro-batch of ``latest_changes``, decoded, into its own partition; one
    that changes nothing writes nothing.  The changes are kept while both are done, or the
    micro-batch would be read and aggregated twice."""
    def write(batch: DataFrame, batch_id: int) -> None:
        winners = batch.where(F.col("latest").isNotNull()).select(*(f"latest.{c}" for c in RECORD)).persist()
        try:
            where_not_empty(lambda rows, n: replay_safe_load(L.decode_latest_events(rows), path, n))(winners, batch_id)
        finally:
            winners.unpersist()
    return write


def run_latest_state(spark: SparkSession, log: DataFrame, path: str, checkpoint: str) -> None:
    """Fold all records that the log has into the change table at ``path``."""
    run_available_now(latest_changes(log).writeStream.outputMode("update").foreachBatch(change_writer(path))
                      .option("checkpointLocation", checkpoint).queryName("latest_state"))


def current_state(spark: SparkSession, path: str) -> DataFrame:
    """The newest change of each location.  A batch changes a location once, so its
    number orders the changes."""
    return newest_only(spark.read.parquet(path), ["location_id"], ["batch_id"]).drop("batch_id")


def fold_changes(spark: SparkSession, path: str, into: str) -> None:
    """Write the current state as a change table of its own at ``into`` (a new path),
    where the changes so far have become one batch."""
    replay_safe_load(current_state(spark, path), into, -1)
