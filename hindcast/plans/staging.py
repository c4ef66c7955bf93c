"""Staging models: de-duplicated raw events with envelope fields lifted out of
the JSON payload (W1, W2, P11, F1-F3, F5)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hindcast.functions.json import parse_text_fields, safe_cast, scalar_only
from hindcast.operators.dedup import latest_per_key, without_older

LOG = ["kafka_topic", "kafka_partition", "kafka_offset", "kafka_key", "kafka_timestamp",
       "ingested_at", "payload"]

# The newest delivery of an event wins; partition/offset make the order total.
EVENT_ORDER = ["ingested_at", "kafka_partition", "kafka_offset"]


def dedupe_events(raw: DataFrame, in_files: bool = False) -> DataFrame:
    """One row per ``event_id`` (latest ingested, then partition, offset).  A raw
    table read from its files (``in_files``) is read minus its older deliveries; rows of
    any other origin are aggregated."""
    return (without_older if in_files else latest_per_key)(raw, ["event_id"], EVENT_ORDER)


def stg_model_run_events(raw: DataFrame, in_files: bool = False) -> DataFrame:
    ev = dedupe_events(raw, in_files)
    p = parse_text_fields("payload", ["occurred_at", "data.model.model_name",
                                      "data.model.resolution_km", "data.hourly"])
    ev = ev.withColumn("__p", p)
    return ev.select(
        "event_id", "event_type", "schema_version", "location_id", "model_id",
        scalar_only(F.col("__p.data.model.model_name")).alias("model_name"),
        "provider",
        safe_cast(scalar_only(F.col("__p.data.model.resolution_km")), "double").alias("resolution_km"),
        "forecast_run_at", "retrieved_at",
        safe_cast(scalar_only(F.col("__p.occurred_at")), "timestamp").alias("event_occurred_at"),
        F.col("__p.data.hourly").alias("hourly_forecasts_json"),
        *LOG,
    )


def stg_operational_forecast_events(raw: DataFrame, in_files: bool = False) -> DataFrame:
    ev = dedupe_events(raw, in_files)
    p = parse_text_fields("payload", ["occurred_at", "data.timezone", "data.current",
                                      "data.hourly", "data.daily"])
    ev = ev.withColumn("__p", p)
    return ev.select(
        "event_id", "event_type", "schema_version", "location_id", "source", "retrieved_at",
        safe_cast(scalar_only(F.col("__p.occurred_at")), "timestamp").alias("event_occurred_at"),
        scalar_only(F.col("__p.data.timezone")).alias("forecast_timezone"),
        F.col("__p.data.current").alias("current_conditions_json"),
        F.col("__p.data.hourly").alias("hourly_forecasts_json"),
        F.col("__p.data.daily").alias("daily_forecasts_json"),
        *LOG,
    )


def stg_verification_weather_events(raw: DataFrame, in_files: bool = False) -> DataFrame:
    ev = dedupe_events(raw, in_files)
    p = parse_text_fields("payload", ["occurred_at", "data.timezone", "data.hourly"])
    ev = ev.withColumn("__p", p)
    return ev.select(
        "event_id", "event_type", "schema_version", "location_id", "source", "reference_kind",
        "period_start", "period_end", "retrieved_at",
        safe_cast(scalar_only(F.col("__p.occurred_at")), "timestamp").alias("event_occurred_at"),
        scalar_only(F.col("__p.data.timezone")).alias("verification_timezone"),
        F.col("__p.data.hourly").alias("hourly_weather_json"),
        *LOG,
    )


def normalize_locations(raw: DataFrame) -> DataFrame:
    """Trim text, upper-case the country code, blank area -> NULL."""
    return raw.select(
        "location_id", "open_meteo_location_id",
        F.trim("city").alias("city"),
        F.trim("country").alias("country"),
        F.upper(F.trim("country_code")).alias("country_code"),
        "latitude", "longitude",
        F.trim("timezone").alias("timezone"),
        "elevation", "population",
        F.nullif(F.trim("administrative_area"), F.lit("")).alias("administrative_area"),
        "source_created_at", "source_updated_at", "synced_at",
    )


def stg_locations(raw: DataFrame) -> DataFrame:
    """Newest version per location (source update, sync, provider id)."""
    return latest_per_key(normalize_locations(raw), ["location_id"],
                          ["source_updated_at", "synced_at", "open_meteo_location_id"])
