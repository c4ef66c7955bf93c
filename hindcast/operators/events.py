"""Event assembly and publishing records.

Typed rows are folded back into one event each, for all three streams: a run's hours, a
reanalysis retrieval's hours, and a location's snapshot of current, hourly and daily
rows.  The group key is the event's identity, so a group is bounded by the provider's
forecast horizon and ``collect_list`` never gathers an unbounded group.  ``array_sort``
on structs whose first field is the time fixes the order (X12).  Every assembly returns
its identity columns with ``topic``, ``key``, ``event_id``, ``event_type`` and
``payload``, which ``kafka_records`` turns into records.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hindcast.functions import identity
from hindcast.schemas import (
    DAILY_FIELDS,
    METRICS,
    SCHEMA_VERSION,
    TOPIC_MODEL_RUN,
    TOPIC_OPERATIONAL,
    TOPIC_VERIFICATION,
    TYPE_MODEL_RUN,
    TYPE_OPERATIONAL,
    TYPE_VERIFICATION,
)

JSON_OPTIONS = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "ignoreNullFields": "false"}
RUN_KEYS = ["location_id", "model_id", "model_name", "provider", "resolution_km", "forecast_run_at", "retrieved_at"]
# one moment can retrieve several periods
RETRIEVAL_KEYS = ["location_id", "source", "reference_kind", "retrieved_at", "verification_timezone", "period_start", "period_end"]
SNAPSHOT_KEYS = ["location_id", "source", "retrieved_at"]


def _gathered(rows: DataFrame, keys: Sequence[str], fields: Sequence[str], name: str) -> DataFrame:
    """One row for each event with its records in the order of their first field."""
    return rows.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(*fields))).alias(name))


def _enveloped(events: DataFrame, topic: str, kind: str, key: Column, data: list) -> DataFrame:
    """Adds topic, key, type and the payload text: the envelope around ``data``."""
    envelope = F.struct("event_id", F.lit(kind).alias("event_type"), F.lit(SCHEMA_VERSION).alias("schema_version"),
                        F.col("retrieved_at").alias("occurred_at"), F.struct(*data).alias("data"))
    return events.withColumns({"topic": F.lit(topic), "key": key, "event_type": F.lit(kind),
                               "payload": F.to_json(envelope, JSON_OPTIONS)})


def assemble_model_run_events(hours: DataFrame) -> DataFrame:
    """A16 + F13: hourly rows (with run attributes and ``lead_time_hours``) ->
    one event per run with its ordered hourly array and deterministic id."""
    runs = _gathered(hours, RUN_KEYS, ["valid_at", "lead_time_hours", *METRICS], "hourly")
    runs = runs.withColumn("event_id", identity.model_run_event_id("provider", "model_id", "location_id",
                                                                   "forecast_run_at"))
    model = F.struct("model_id", "model_name", "provider", "resolution_km").alias("model")
    return _enveloped(runs, TOPIC_MODEL_RUN, TYPE_MODEL_RUN, identity.location_model_key("location_id", "model_id"),
                      ["location_id", model, "forecast_run_at", "retrieved_at", "hourly"])


def assemble_verification_events(hours: DataFrame) -> DataFrame:
    """A16 + A15 + F13: reanalysis hours (with their retrieval's attributes) -> one event
    per retrieved period, which runs from its first hour to its last."""
    days = _gathered(hours, RETRIEVAL_KEYS, ["valid_at", *METRICS], "hourly").drop("period_start", "period_end")
    first, last = identity.period_bounds("hourly")
    days = days.withColumns({"source": F.trim("source"), "timezone": F.trim("verification_timezone"),
                             "period_start": first, "period_end": last})
    days = days.withColumn("event_id", identity.verification_event_id(
        "source", "reference_kind", "location_id", "retrieved_at", "period_start", "period_end"))
    return _enveloped(days, TOPIC_VERIFICATION, TYPE_VERIFICATION, identity.location_key("location_id"),
                      ["location_id", "source", "reference_kind", "retrieved_at", "timezone", "period_start", "period_end", "hourly"])


def assemble_operational_events(current: DataFrame, hours: DataFrame, days: DataFrame) -> DataFrame:
    """A16 + F13: a snapshot's zone and current conditions (``timezone``, struct
    ``current``), hourly rows and daily rows, all with ``SNAPSHOT_KEYS`` -> one event per snapshot.  A snapshot
    without hours or without days makes no event (P7)."""
    rows = current.join(_gathered(hours, SNAPSHOT_KEYS, ["valid_at", *METRICS], "hourly"), SNAPSHOT_KEYS)
    rows = rows.join(_gathered(days, SNAPSHOT_KEYS, ["date", *DAILY_FIELDS], "daily"), SNAPSHOT_KEYS)
    rows = rows.withColumn("event_id", identity.operational_event_id("source", "location_id", "retrieved_at"))
    return _enveloped(rows, TOPIC_OPERATIONAL, TYPE_OPERATIONAL, identity.location_key("location_id"),
                      [*SNAPSHOT_KEYS, "timezone", "current", "hourly", "daily"])


def kafka_records(events: DataFrame) -> DataFrame:
    """S9 + F14: the Kafka sink schema - key, JSON value, three headers, topic.
    (Spark's Kafka sink has no record-timestamp column; ``occurred_at`` stays in
    the payload.)"""
    told = {"event_id": F.col("event_id"), "event_type": F.col("event_type"), "schema_version": F.lit(str(SCHEMA_VERSION))}
    headers = F.array(*(F.struct(F.lit(k).alias("key"), v.cast("binary").alias("value")) for k, v in told.items()))
    return events.select("topic", "key", F.col("payload").alias("value"), headers.alias("headers"))


def publish(records: DataFrame, servers: str) -> None:
    """S9 on a cluster with the Kafka connector (not on this classpath)."""
    (records.selectExpr("topic", "CAST(key AS BINARY) AS key", "CAST(value AS BINARY) AS value", "headers")
     .write.format("kafka").option("kafka.bootstrap.servers", servers).save())
