"""Schemas of the data model: one source of truth for column lists and types."""

from __future__ import annotations

from pyspark.sql import types as T

# The 17 hourly weather metrics, in the order every hourly table
# carries them (15 floating point, weather_code integer, is_day boolean).
METRICS = [
    "temperature_2m",
    "apparent_temperature",
    "relative_humidity_2m",
    "precipitation",
    "precipitation_probability",
    "rain",
    "showers",
    "snowfall",
    "weather_code",
    "cloud_cover",
    "pressure_msl",
    "visibility",
    "wind_speed_10m",
    "wind_direction_10m",
    "wind_gusts_10m",
    "uv_index",
    "is_day",
]

INT_METRICS = {"weather_code"}
BOOL_METRICS = {"is_day"}


def metric_type(name: str) -> T.DataType:
    if name in INT_METRICS:
        return T.LongType()
    if name in BOOL_METRICS:
        return T.BooleanType()
    return T.DoubleType()


def metric_sql_type(name: str) -> str:
    return {"weather_code": "bigint", "is_day": "boolean"}.get(name, "double")


# The daily record fields after ``date`` (sunrise/sunset are instants).
DAILY_FIELDS = [
    "weather_code",
    "temperature_2m_max",
    "temperature_2m_min",
    "apparent_temperature_max",
    "apparent_temperature_min",
    "precipitation_sum",
    "precipitation_probability_max",
    "precipitation_hours",
    "wind_speed_10m_max",
    "wind_gusts_10m_max",
    "wind_direction_10m_dominant",
    "sunrise",
    "sunset",
    "daylight_duration_seconds",
    "uv_index_max",
]
DAILY_TIME_FIELDS = {"sunrise", "sunset"}


def daily_type(name: str) -> T.DataType:
    if name == "weather_code":
        return T.LongType()
    if name in DAILY_TIME_FIELDS:
        return T.TimestampType()
    return T.DoubleType()


# Metrics the provider does not send for "current" conditions.
CURRENT_ABSENT = ["precipitation_probability", "visibility", "uv_index"]
CURRENT_METRICS = [m for m in METRICS if m not in CURRENT_ABSENT]

# Series of a verification (reanalysis) response.
VERIFICATION_SERIES = [
    "temperature_2m",
    "apparent_temperature",
    "relative_humidity_2m",
    "precipitation",
    "rain",
    "snowfall",
    "weather_code",
    "cloud_cover",
    "pressure_msl",
    "wind_speed_10m",
    "wind_direction_10m",
    "wind_gusts_10m",
    "is_day",
]

# Topics and event types of the three streams.
TOPIC_OPERATIONAL = "forecast.latest"
TOPIC_MODEL_RUN = "forecast.runs"
TOPIC_VERIFICATION = "weather.verification"
TYPE_OPERATIONAL = "forecast.latest.snapshot"
TYPE_MODEL_RUN = "forecast.model_run.snapshot"
TYPE_VERIFICATION = "weather.verification.snapshot"
SCHEMA_VERSION = 1
REFERENCE_KIND = "reanalysis"

# Kafka source schema (what readStream.format("kafka") yields, value as string).
LOG_RECORD_SCHEMA = T.StructType([
    T.StructField("topic", T.StringType()),
    T.StructField("partition", T.IntegerType()),
    T.StructField("offset", T.LongType()),
    T.StructField("key", T.StringType()),
    T.StructField("timestamp", T.TimestampType()),
    T.StructField("value", T.StringType()),
])
