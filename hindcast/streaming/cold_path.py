"""ST1 + ST2 + S4 + S5 + S6: the cold path as Structured Streaming.

One streaming query per topic, each with its own checkpoint, so a failing
topic never holds back the others' offsets (the reference commits per topic).
Each micro-batch is mapped and validated strictly (P6): a bad record fails the
batch before anything is written, and the checkpoint does not advance - the
at-least-once contract.  Writes are replay-safe: a batch lands in its own
``batch_id=<n>`` partition with dynamic partition overwrite, so re-running a
batch after a failure replaces its own output instead of duplicating it, and
W1 removes any duplicates that arrive through the log itself.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hindcast.sources import raw
from hindcast.sources.sinks import replay_safe_load
from hindcast.streaming.io import ended, where_not_empty


def minute_after_record() -> Column:
    """A clock for checks: one minute after the record's own time, so that a replay
    of the same records loads the same rows."""
    return F.col("timestamp") + F.expr("INTERVAL 1 MINUTE")


def batch_writer(table: str, out_path: str, date_col: str, instant: str, ingested_at=F.current_timestamp):
    table_mapper = {t: fn for _, (t, fn) in raw.MAPPERS.items()}[table]

    def write(batch: DataFrame, batch_id: int) -> None:
        mapped = raw.strict(table_mapper(batch, ingested_at()))
        replay_safe_load(mapped.withColumn(date_col, F.to_date(instant)), out_path, batch_id, [date_col])
    return where_not_empty(write)


LAYOUT = {
    "model_run_events": ("run_date", "forecast_run_at"),
    "verification_weather_events": ("period_date", "period_start"),
    "operational_forecast_events": ("retrieved_date", "retrieved_at"),
}


def _refuse_unknown(batch: DataFrame, batch_id: int) -> None:
    found = batch.limit(1).collect()
    if found:
        raise ValueError(f"record on a topic that no table owns: {found[0]['topic']}")


def start_cold_path(spark: SparkSession, log_of: Callable[[str | None], DataFrame], out_root: str, checkpoint_root: str,
                    available_now: bool = True, interval: str = "1 hour", ingested_at=F.current_timestamp) -> dict:
    """One query per topic, and one that fails on records of unknown topics.
    ``log_of`` gives the stream of a topic's records, and that of all for None.
    ``ingested_at`` makes the load time of a batch.  With ``available_now`` all run beside each other to the end of the
    available input and the result maps table -> ``"ok"`` or the error that
    stopped it (a failing topic does not stop the others, and its checkpoint
    stays at the last committed batch).  Otherwise the started queries are
    returned, triggered every ``interval``."""
    results: dict = {}
    parts = {table: (log_of(topic).filter(F.col("topic") == topic),
                     batch_writer(table, f"{out_root}/{table}", *LAYOUT[table], ingested_at))
             for topic, (table, _) in raw.MAPPERS.items()}
    known = F.coalesce(F.col("topic").isin(list(raw.MAPPERS)), F.lit(False))
    parts["unknown_topics"] = (log_of(None).filter(~known), _refuse_unknown)
    for table, (mine, write) in parts.items():
        w = (mine.writeStream.foreachBatch(write)
             .option("checkpointLocation", f"{checkpoint_root}/{table}")
             .queryName(f"cold_path_{table}"))
        w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime=interval)
        try:
            results[table] = w.start()
        except Exception as exc:
            if not available_now:
                raise
            results[table] = _failed(exc)
    if available_now:
        for table, q in results.items():
            if isinstance(q, str):
                continue
            try:
                ended(q)
                results[table] = "ok"
            except Exception as exc:  # isolate the topic; the caller sees the error
                results[table] = _failed(exc)
    return results


def _failed(exc: Exception) -> str:
    return f"failed: {str(exc).splitlines()[0][:200]}"
