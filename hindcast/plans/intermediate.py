"""Intermediate models: one typed row per event x hourly element.

They read de-duplicated raw events, as the staging models do, and lift the envelope's
fields and the hours from one parse of the payload."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hindcast.functions.json import safe_cast
from hindcast.functions.time import hours_between
from hindcast.operators.unnest import document_hours
from hindcast.plans.staging import dedupe_events

_ENVELOPE = {"event_occurred_at": "occurred_at"}
_TYPES = {"event_occurred_at": "timestamp", "resolution_km": "double"}


def _hours(raw: DataFrame, in_files: bool, columns: list[str], lifted: dict[str, str], with_lead: bool = False) -> DataFrame:
    """Typed hours with ``columns``, of which ``lifted`` and the envelope's come from the payload."""
    lifted = _ENVELOPE | lifted
    keep = [c for c in columns if c not in lifted]
    rows = document_hours(dedupe_events(raw, in_files), keep, "payload", lifted, "data.hourly", with_lead)
    told = [safe_cast(F.col(c), _TYPES[c]).alias(c) if c in _TYPES else F.col(c) for c in columns]
    return rows.select(*told, *(c for c in rows.columns if c not in columns))


def int_model_run_hourly_forecasts(raw: DataFrame, in_files: bool = False) -> DataFrame:
    return _hours(raw, in_files, ["event_id", "location_id", "model_id", "model_name", "provider", "resolution_km",
                                  "forecast_run_at", "retrieved_at", "event_occurred_at", "ingested_at"],
                  {"model_name": "data.model.model_name", "resolution_km": "data.model.resolution_km"}, with_lead=True)


def int_operational_hourly_forecasts(raw: DataFrame, in_files: bool = False) -> DataFrame:
    typed = _hours(raw, in_files, ["event_id", "location_id", "source", "retrieved_at", "forecast_timezone",
                                   "event_occurred_at", "ingested_at"], {"forecast_timezone": "data.timezone"})
    cols = typed.columns
    i = cols.index("valid_at") + 1
    return typed.select(*cols[:i], hours_between("valid_at", "retrieved_at").alias("forecast_horizon_hours"),
                        *cols[i:])


def int_verification_hourly_weather(raw: DataFrame, in_files: bool = False) -> DataFrame:
    return _hours(raw, in_files, ["event_id", "location_id", "source", "reference_kind", "retrieved_at",
                                  "verification_timezone", "period_start", "period_end", "event_occurred_at", "ingested_at"],
                  {"verification_timezone": "data.timezone"})
