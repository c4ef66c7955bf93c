"""Latest-state tables of the hot path (ST3-ST5, P21, J5, J10, K3), in bulk.

The reference keeps one "latest" operational snapshot per location in a
database: an event replaces the stored one only when its ``retrieved_at`` is
strictly newer, and the hourly/daily child rows are replaced with it.  Here the
same state is a function of the event log:

* :func:`decode_latest_events` parses the log records (ST5) into typed rows,
* :func:`latest_snapshots` keeps, per location, the newest ``retrieved_at``
  with the *earliest arrival* winning a tie - exactly the outcome of applying
  the events one by one with the strictly-newer rule (ST3); it is a partial
  ``max_by`` aggregate, so a location with a third of all events is combined
  map-side,
* :func:`latest_hourly` / :func:`latest_daily` explode the winner's own arrays,
  so the children can never disagree with the parent (ST4),
* :func:`merge_latest` folds a new batch into an existing state table (the
  streaming form, used by ``foreachBatch``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hindcast.functions.json import safe_cast
from hindcast.functions.time import is_iso_date
from hindcast.operators.dedup import latest_per_key, newest_only
from hindcast.operators.events import JSON_OPTIONS
from hindcast.operators.unnest import inline_rows
from hindcast.schemas import DAILY_FIELDS, METRICS, TOPIC_OPERATIONAL, TYPE_OPERATIONAL, metric_sql_type

# Units of a document's metrics.
UNITS = {"temperature": "celsius", "precipitation": "mm", "wind_speed": "km/h", "pressure": "hPa", "visibility": "m"}

_TEXT_METRICS = ", ".join(f"`{m}` string" for m in METRICS)
_TEXT_DAILY = ", ".join(f"`{d}` string" for d in DAILY_FIELDS)
# All leaves are read as text and cast afterwards (X1): a quoted number is kept.
LATEST_EVENT_TEXT_SCHEMA = (
    "struct<event_id string, event_type string, schema_version string, occurred_at string, "
    "data struct<location_id string, source string, retrieved_at string, timezone string, "
    f"current struct<valid_at string, interval_seconds string, {_TEXT_METRICS}>, "
    f"hourly array<struct<valid_at string, {_TEXT_METRICS}>>, "
    f"daily array<struct<date string, {_TEXT_DAILY}>>>, _corrupt_record string>"
)
# Only what the rules and the newest-wins choice need: the parser still reads
# every token but builds no metric values.
LATEST_EVENT_SCREEN_SCHEMA = (
    "struct<event_id string, event_type string, schema_version string, "
    "data struct<location_id string, source string, retrieved_at string, timezone string, "
    "current struct<valid_at string, interval_seconds string>, "
    "hourly array<struct<valid_at string>>, daily array<struct<date string>>>, _corrupt_record string>"
)
_CORRUPT = {"columnNameOfCorruptRecord": "_corrupt_record", "mode": "PERMISSIVE"}


def _typed_metrics(prefix: str) -> list[Column]:
    return [safe_cast(F.col(f"{prefix}.{m}"), metric_sql_type(m)).alias(m) for m in METRICS]


def decode_latest_events(log: DataFrame, full: bool = True, carry: list[str] | tuple = ()) -> DataFrame:
    """ST5: log records ``(topic, partition, offset, key, timestamp, value)`` ->
    typed snapshot rows; keeps the record coordinates for ordering and checks.

    ``full=False`` parses only the fields the rules and the newest-wins choice
    need (and keeps the record ``value``), for screening every event before only
    the winners are decoded in full.  Malformed JSON is caught by the parser's
    corrupt-record column, so each record is parsed once.  ``carry`` names
    further input columns passed through unchanged."""
    e = log.withColumn("__e", F.from_json("value", LATEST_EVENT_TEXT_SCHEMA if full else
                                          LATEST_EVENT_SCREEN_SCHEMA, _CORRUPT))
    if full:
        hourly = F.transform(F.col("__e.data.hourly"), lambda h: F.struct(
            safe_cast(h["valid_at"], "timestamp").alias("valid_at"),
            *[safe_cast(h[m], metric_sql_type(m)).alias(m) for m in METRICS]))
        daily = F.transform(F.col("__e.data.daily"), lambda d: F.struct(
            d["date"].alias("date"),
            *[safe_cast(d[f], "bigint" if f == "weather_code" else
                        ("timestamp" if f in ("sunrise", "sunset") else "double")).alias(f) for f in DAILY_FIELDS]))
        current = F.struct(safe_cast(F.col("__e.data.current.valid_at"), "timestamp").alias("valid_at"),
                           safe_cast(F.col("__e.data.current.interval_seconds"), "int").alias("interval_seconds"),
                           *_typed_metrics("__e.data.current"))
        extra = []
    else:
        hourly = F.transform(F.col("__e.data.hourly"),
                             lambda h: F.struct(safe_cast(h["valid_at"], "timestamp").alias("valid_at")))
        daily = F.transform(F.col("__e.data.daily"), lambda d: F.struct(d["date"].alias("date")))
        current = F.struct(safe_cast(F.col("__e.data.current.valid_at"), "timestamp").alias("valid_at"),
                           safe_cast(F.col("__e.data.current.interval_seconds"), "int").alias("interval_seconds"))
        extra = [F.col("value")]
    return e.select(
        F.col("topic"), F.col("partition"), F.col("offset"), F.col("key"), F.col("timestamp"),
        F.col("__e.event_id").alias("event_id"),
        F.col("__e.event_type").alias("event_type"),
        safe_cast(F.col("__e.schema_version"), "int").alias("schema_version"),
        safe_cast(F.col("__e.data.location_id"), "bigint").alias("location_id"),
        F.col("__e.data.source").alias("source"),
        safe_cast(F.col("__e.data.retrieved_at"), "timestamp").alias("retrieved_at"),
        F.col("__e.data.timezone").alias("timezone"),
        current.alias("current"),
        hourly.alias("hourly"),
        daily.alias("daily"),
        (F.col("value").isNull() | F.col("__e._corrupt_record").isNotNull()).alias("bad_json"),
        *extra,
        *[F.col(c) for c in carry],
    )


def latest_from_log(log: DataFrame, in_files: bool = False) -> DataFrame:
    """ST5 + P21 + ST3 end to end: screen every record with the light parse and
    the rules, pick the newest valid snapshot per location, then decode only the
    winners.  Records of a table in files (``in_files``) are chosen by coordinates and
    the winners' values read afterwards; others go through the partial aggregate."""
    screened = hot_state_violations(decode_latest_events(log, full=False))
    candidates = screened.select(
        "location_id", "retrieved_at", "topic", "partition", "offset", "key", "timestamp", "value",
        (F.size("violations") == 0).alias("__valid"))
    winners = latest_snapshots(candidates, valid="__valid", in_files=in_files)
    decoded = decode_latest_events(winners.select("topic", "partition", "offset", "key", "timestamp", "value",
                                                  F.col("location_id").alias("__loc")), carry=["__loc"])
    # The group key is the same text decoded by the same cast; reusing it keeps
    # join-inferred key checks (``location_id IS NOT NULL``) off the JSON parse.
    return decoded.withColumn("location_id", F.col("__loc")).drop("__loc")


def hot_state_violations(events: DataFrame) -> DataFrame:
    """P21 + ST5: rule codes per event (empty array = valid)."""
    checks = [
        (F.col("bad_json"), "invalid_json"),
        (F.coalesce(F.trim("event_id"), F.lit("")) == "", "blank_event_id"),
        (F.col("topic") != TOPIC_OPERATIONAL, "unexpected_topic"),
        (F.col("key").isNull() | (F.col("key") != F.col("location_id").cast("string")), "key_mismatch"),
        (F.col("event_type").isNull() | (F.col("event_type") != TYPE_OPERATIONAL), "unexpected_event_type"),
        (F.col("schema_version").isNull() | (F.col("schema_version") != 1), "unsupported_schema_version"),
        (F.col("location_id").isNull() | (F.col("location_id") < 1), "invalid_location_id"),
        (F.coalesce(F.trim("source"), F.lit("")) == "", "blank_source"),
        (F.coalesce(F.trim("timezone"), F.lit("")) == "", "blank_timezone"),
        (F.col("retrieved_at").isNull(), "missing_retrieved_at"),
        (F.col("current.valid_at").isNull(), "missing_current_time"),
        (F.coalesce(F.col("current.interval_seconds"), F.lit(0)) < 1, "invalid_interval"),
        (F.coalesce(F.size("hourly"), F.lit(0)) < 1, "empty_hourly"),
        (F.coalesce(F.size("daily"), F.lit(0)) < 1, "empty_daily"),
        (F.exists("hourly", lambda h: h["valid_at"].isNull()), "hourly_missing_time"),
        (F.exists("daily", lambda d: ~is_iso_date(d["date"]) | d["date"].isNull()), "daily_bad_date"),
    ]
    codes = F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(code)) for c, code in checks]))
    return events.withColumn("violations", codes)


# Arrival order of a record: earlier = smaller.
ARRIVAL = ["timestamp", "partition", "offset"]


def latest_snapshots(events: DataFrame, valid: str | None = None, in_files: bool = False) -> DataFrame:
    """ST3: per location the strictly-newest ``retrieved_at``; among equal
    ones the first arrival (an equal event later is a no-op).  ``valid`` names
    a boolean column: only those events are applied."""
    order = ["retrieved_at"] + [(c, "asc") for c in ARRIVAL]
    return (newest_only if in_files else latest_per_key)(events, ["location_id"], order, where=valid)


def merge_latest(state: DataFrame, batch: DataFrame) -> DataFrame:
    """Fold a batch of decoded, valid events into the state (same rule).  State
    rows arrived before the batch, so they win ties."""
    s = state.withColumn("__wave", F.lit(0))
    b = batch.withColumn("__wave", F.lit(1))
    both = s.unionByName(b, allowMissingColumns=True)
    order = ["retrieved_at", ("__wave", "asc")] + [(c, "asc") for c in ARRIVAL]
    return latest_per_key(both, ["location_id"], order).drop("__wave")


def current_table(latest: DataFrame) -> DataFrame:
    """The 26-column latest_operational_forecasts row (``updated_at`` = arrival)."""
    return latest.select(
        "location_id", "event_id", "schema_version", "source", "retrieved_at", "timezone",
        F.col("current.valid_at").alias("current_valid_at"),
        F.col("current.interval_seconds").alias("current_interval_seconds"),
        *[F.col(f"current.{m}").alias(f"current_{m}") for m in METRICS],
        F.col("timestamp").alias("updated_at"),
    )


def latest_hourly(latest: DataFrame) -> DataFrame:
    """ST4: hourly children of the winning event, one per valid hour."""
    return inline_rows(latest, ["location_id"], "hourly")


def latest_daily(latest: DataFrame) -> DataFrame:
    """ST4: daily children; the ISO date becomes the key ``forecast_date``."""
    d = inline_rows(latest, ["location_id"], "daily")
    return d.select("location_id", F.to_date(F.col("date")).alias("forecast_date"),
                    *[c for c in DAILY_FIELDS])


def snapshot_document(latest: DataFrame, locations: DataFrame) -> DataFrame:
    """J5 + J10 + K3: one nested document per location - location attributes,
    current conditions, hourly ordered by time and daily ordered by date.  The
    arrays come from the single winning event (bounded by the provider's
    horizon), so no group is ever collected across rows."""
    loc = locations.select("location_id", "city", "country", "country_code", "administrative_area",
                           "latitude", "longitude", F.col("timezone").alias("location_timezone"))
    doc = latest.join(loc, "location_id", "inner")
    return doc.select(
        "location_id", "city", "country", "country_code", "administrative_area", "latitude", "longitude",
        "event_id", "source", "retrieved_at", "timezone", F.struct(*(F.lit(v).alias(k) for k, v in UNITS.items())).alias("units"),
        "current", F.array_sort("hourly").alias("hourly"),
        F.array_sort("daily").alias("daily"),
    )


def document_json(document: DataFrame) -> DataFrame:
    """(location_id, document), each document as JSON text with the event as
    ``forecast_id`` and the location's attributes in one object.  Absent values are
    written as null."""
    location = F.struct(F.col("location_id").alias("id"), "city", "country", "country_code", "administrative_area", "latitude", "longitude")
    data = F.struct(F.col("event_id").alias("forecast_id"), location.alias("location"), "source", "retrieved_at", "timezone",
                    "units", "current", "hourly", "daily")
    return document.select("location_id", F.to_json(F.struct(data.alias("data")), JSON_OPTIONS).alias("document"))
