"""Mart models: dimensions, facts, revisions and the canonical verification
(P16, P17, F6, F7, W3-W7, J3, A11, A12)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hindcast.functions.time import lead_time_bucket, local_date, utc_date
from hindcast.operators.dedup import latest_per_key, latest_version
from hindcast.operators.sequence import previous_in_sequence
from hindcast.schemas import METRICS


def dim_locations(stg_locations: DataFrame) -> DataFrame:
    """The staging columns with ``administrative_area`` after ``city``."""
    return stg_locations.select(
        "location_id", "open_meteo_location_id", "city", "administrative_area", "country",
        "country_code", "latitude", "longitude", "timezone", "elevation", "population",
        "source_created_at", "source_updated_at", "synced_at",
    )


def model_runs(int_model_run: DataFrame) -> DataFrame:
    """Distinct runs from the unnested hours (a run with no hours counts nowhere, X15)."""
    return int_model_run.select("event_id", "model_id", "model_name", "provider", "resolution_km",
                                "forecast_run_at", "retrieved_at").distinct()


def dim_forecast_models(int_model_run: DataFrame) -> DataFrame:
    """W3 + A12 + J3: newest attributes per model joined to its run summary."""
    runs = model_runs(int_model_run)
    latest = latest_per_key(runs, ["model_id"], ["forecast_run_at", "retrieved_at", "event_id"]).select(
        "model_id", "model_name", "provider", "resolution_km")
    summary = runs.groupBy("model_id").agg(
        F.min("forecast_run_at").alias("first_forecast_run_at"),
        F.max("forecast_run_at").alias("latest_forecast_run_at"),
        F.count(F.lit(1)).alias("forecast_run_count"),
    )
    # Both sides are one row per model after their aggregates: Spark keeps the
    # shared hash partitioning on model_id, so the join adds no extra exchange.
    return latest.join(summary, "model_id").select(
        "model_id", "model_name", "provider", "resolution_km",
        "first_forecast_run_at", "latest_forecast_run_at", "forecast_run_count")


def fct_model_forecasts(int_model_run: DataFrame) -> DataFrame:
    return int_model_run.select(
        "event_id", "location_id", "model_id", "model_name", "provider", "resolution_km",
        "forecast_run_at", "retrieved_at", "valid_at",
        utc_date("valid_at").alias("forecast_date_utc"),
        "lead_time_hours",
        lead_time_bucket("lead_time_hours").alias("lead_time_bucket"),
        *METRICS, "ingested_at",
    )


def fct_operational_hourly_forecasts(int_operational: DataFrame) -> DataFrame:
    """local forecast date in the snapshot's own zone.  Zones come from the
    provider and are valid by the P21 rules; see ``functions.time.with_valid_zone``
    for data that may carry unknown zones."""
    return int_operational.select(
        "event_id", "location_id", "source",
        F.col("retrieved_at").alias("snapshot_at"),
        "forecast_timezone", "valid_at",
        local_date("valid_at", "forecast_timezone").alias("local_forecast_date"),
        "forecast_horizon_hours", *METRICS, "ingested_at",
    )


def fct_forecast_revisions(int_model_run: DataFrame) -> DataFrame:
    """W6 + W7: each forecast against the previous run's forecast of the same
    (location, model, valid hour), ordered by run, retrieval, event."""
    base = int_model_run.select(
        "event_id", "location_id", "model_id", "model_name", "provider", "forecast_run_at",
        "retrieved_at", "valid_at", "lead_time_hours", "temperature_2m", "precipitation_probability")
    seq = previous_in_sequence(
        base,
        partition_by=["location_id", "model_id", "valid_at"],
        order_by=["forecast_run_at", "retrieved_at", "event_id"],
        carry={"forecast_run_at": "previous_forecast_run_at",
               "temperature_2m": "previous_temperature_2m",
               "precipitation_probability": "previous_precipitation_probability"},
    )
    return seq.select(
        "event_id", "location_id", "model_id", "model_name", "provider", "forecast_run_at",
        "valid_at", "lead_time_hours", "temperature_2m", "precipitation_probability",
        "previous_forecast_run_at", "previous_temperature_2m",
        (F.col("temperature_2m") - F.col("previous_temperature_2m")).alias("temperature_revision"),
        "previous_precipitation_probability",
        (F.col("precipitation_probability") - F.col("previous_precipitation_probability"))
        .alias("precipitation_probability_revision"),
    )


def fct_verification_weather(int_verification: DataFrame) -> DataFrame:
    """W4 + W5: latest version per (location, valid hour) plus the number of
    versions; a group holds the re-issues of one hour."""
    cols = ["event_id", "location_id", "valid_at", "source", "reference_kind", "retrieved_at",
            "verification_timezone", "period_start", "period_end", *METRICS, "ingested_at"]
    latest = latest_version(int_verification.select(*cols), ["location_id", "valid_at"],
                            ["retrieved_at", "ingested_at", "event_id"], "verification_version_count")
    return latest.select(
        "event_id", "location_id", "valid_at",
        utc_date("valid_at").alias("verification_date_utc"),
        "source", "reference_kind", "retrieved_at", "verification_timezone",
        "period_start", "period_end", *METRICS, "ingested_at", "verification_version_count",
    )
