"""Checked queries whose input has defects, and of the sinks; see ``registry``."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from hindcast import oracle as O
from hindcast.plans import damage as D
from hindcast.plans.models import Models
from hindcast.plans.quality_suite import state_checks, warehouse_checks
from hindcast.registry import LOC_DOUBLES, RAW_LOG_SQL, SYNC_AT, _ingested, _latest, _log, _marts, _models, register


@register("quality_violations", [], lambda: O.damaged_report_sql(
    warehouse_checks(), D.warehouse_damage(), O.accuracy_sql(), O.model_ctes()))
def q_quality_violations(spark, sf_dir):
    """Every warehouse data test over models with defects of every kind."""
    from hindcast.operators.quality import report
    m, damage = _marts(spark, sf_dir), D.warehouse_damage()
    return report(warehouse_checks(), {t: D.damaged(getattr(m, t), damage[t]) for t in Models.MODEL_NAMES})


STATE_SQL = """
m_locations as (select *, source_created_at as created_at, source_updated_at as updated_at from loc),
m_latest_operational_forecasts as (
  select l.location_id, l.event_id, 1 as schema_version, l.source, l.retrieved_at, l.timezone,
    f.valid_at as current_valid_at, 900 as current_interval_seconds, l.kafka_timestamp as updated_at
  from lat l join lat_first f on l.location_id = f.location_id),
m_latest_operational_hourly as (select location_id, valid_at from lat_hours),
m_latest_operational_daily as (select location_id, day as forecast_date from lat_daily)"""


@register("state_violations", [], lambda: O.damaged_report_sql(state_checks(), D.state_damage(), O.latest_ctes(), STATE_SQL))
def q_state_violations(spark, sf_dir):
    """Q7: keys and constraints of the state tables, each broken by some location."""
    from hindcast.operators.quality import report
    L, latest = _latest(spark, sf_dir)
    locations = _models(spark, sf_dir).stg_locations.withColumnsRenamed(
        {"source_created_at": "created_at", "source_updated_at": "updated_at"})
    tables = {"locations": locations, "latest_operational_forecasts": L.current_table(latest),
              "latest_operational_hourly": L.latest_hourly(latest), "latest_operational_daily": L.latest_daily(latest)}
    damage = D.state_damage()
    return report(state_checks(), {t: D.damaged(df, damage[t]) for t, df in tables.items()})


RAW_SQL = {"model_run_events": "mr_raw", "operational_forecast_events": "op_raw", "verification_weather_events": "vev_raw"}


@register("rule_violations", [], lambda: O.with_ctes(body="\nunion all\n".join(
    D.defects_sql(RAW_SQL[t], defects) for t, defects in D.log_defects().items())))
def q_rule_violations(spark, sf_dir):
    """Every (record, rule) in logs with a defect for each rule of their records."""
    from hindcast.sources import raw
    logs = [D.defective_log(_log(spark, sf_dir, t), defects) for t, defects in D.log_defects().items()]
    return raw.violation_rows(logs[0].unionByName(logs[1]).unionByName(logs[2]), _ingested())


# Rule of a location snapshot -> (column, value that breaks it).
LOCATION_DEFECTS = {
    "invalid_provider_id": ("open_meteo_location_id", "0"), "blank_city": ("city", "' '"), "blank_country": ("country", "null"),
    "invalid_country_code": ("country_code", "'A'"), "invalid_latitude": ("latitude", "-90.25"),
    "invalid_longitude": ("longitude", "null"), "blank_timezone": ("timezone", "''"), "negative_population": ("population", "-1"),
    "missing_source_timestamp": ("source_updated_at", "null"), "invalid_location_id": ("location_id", "0"),
}


@register("location_violations", [], lambda: O.with_ctes(body="\nunion all\n".join(
    f"select open_meteo_location_id{'' if code != 'invalid_provider_id' else ' * 0'} as open_meteo_location_id, '{code}' as violation "
    f"from loc where location_id % 31 = {n}" for n, code in enumerate(LOCATION_DEFECTS))))
def q_location_violations(spark, sf_dir):
    """Every (row, rule) in a snapshot with a defect for each rule."""
    from hindcast.operators.locations import location_violations
    damage = D.Damage({c: f"case when location_id % 31 = {n} then {value} else {c} end"
                       for n, (c, value) in enumerate(LOCATION_DEFECTS.values())})
    rows = location_violations(D.damaged(_models(spark, sf_dir).stg_locations, damage))
    return rows.select("open_meteo_location_id", F.explode("violations").alias("violation"))


LOCATION_SQL = ("location_id, open_meteo_location_id, city, country, country_code, latitude, longitude, timezone, elevation, "
                "population, administrative_area, source_created_at, source_updated_at")


@register("location_swap", LOC_DOUBLES, lambda: O.with_ctes(body=f"select {LOCATION_SQL}, timestamp '{SYNC_AT}' as synced_at from loc"))
def q_location_swap(spark, sf_dir):
    """A catalog table replaced twice by whole snapshots, each from a folder of its own."""
    from hindcast.operators.locations import swap_snapshot
    from hindcast.streaming.io import scratch_root
    name, root = f"locations_{uuid.uuid4().hex}", scratch_root(spark, "locations")
    snapshot = _models(spark, sf_dir).stg_locations
    swap_snapshot(snapshot.where("population is not null"), name, root, F.lit("2024-01-01").cast("timestamp"))
    swap_snapshot(snapshot, name, root, F.lit(SYNC_AT).cast("timestamp"))
    return spark.table(name)


@register("location_export", LOC_DOUBLES, lambda: O.with_ctes(body=f"select {LOCATION_SQL} from loc"))
def q_location_export(spark, sf_dir):
    """The ordered catalog exported as JSON lines and read back."""
    from hindcast.operators.locations import list_locations
    from hindcast.sources.sinks import export_json_lines
    from hindcast.streaming.io import scratch_root
    rows = _models(spark, sf_dir).stg_locations.select(*LOCATION_SQL.split(", "))
    path = scratch_root(spark, "location-export")
    export_json_lines(list_locations(rows), path)
    return spark.read.schema(rows.schema).json(path)


@register("appended_loads", [], lambda: O.with_ctes(body=f"""
select event_id, location_id, period_start, period_end, retrieved_at, {RAW_LOG_SQL} from vev_raw"""))
def q_appended_loads(spark, sf_dir):
    """Verification rows appended batch by batch (a log partition each) to one table."""
    from hindcast.sources import raw
    from hindcast.sources.sinks import append_load
    from hindcast.streaming.io import scratch_root
    path = scratch_root(spark, "appended")
    log = _log(spark, sf_dir, "verification_weather_events")
    for partition in (0, 1, 2):
        batch = raw.verification_rows(log.where(F.col("partition") == partition), _ingested())
        append_load(raw.strict(batch).drop("payload"), path)
    return spark.read.parquet(path).drop("event_type", "schema_version", "source", "reference_kind")


# Every weather code with its condition and label.
CODES_SQL = """
codes(code, condition, label) as (values (0, 'clear', 'Clear sky'), (1, 'mainlyClear', 'Mainly clear'),
  (2, 'partlyCloudy', 'Partly cloudy'), (3, 'overcast', 'Overcast'), (45, 'fog', 'Foggy'), (48, 'fog', 'Foggy'),
  (51, 'drizzle', 'Drizzle'), (53, 'drizzle', 'Drizzle'), (55, 'drizzle', 'Drizzle'),
  (56, 'freezingDrizzle', 'Freezing drizzle'), (57, 'freezingDrizzle', 'Freezing drizzle'),
  (61, 'rain', 'Rain'), (63, 'rain', 'Rain'), (65, 'rain', 'Rain'), (66, 'freezingRain', 'Freezing rain'),
  (67, 'freezingRain', 'Freezing rain'), (71, 'snow', 'Snowfall'), (73, 'snow', 'Snowfall'), (75, 'snow', 'Snowfall'),
  (77, 'snowGrains', 'Snow grains'), (80, 'rainShowers', 'Rain showers'), (81, 'rainShowers', 'Rain showers'),
  (82, 'rainShowers', 'Rain showers'), (85, 'snowShowers', 'Snow showers'), (86, 'snowShowers', 'Snow showers'),
  (95, 'thunderstorm', 'Thunderstorm'), (96, 'thunderstormWithHail', 'Thunderstorm with hail'),
  (99, 'thunderstormWithHail', 'Thunderstorm with hail'))"""


@register("condition_codes", [], lambda: O.with_ctes(CODES_SQL, body="""
select event_id, coalesce(condition, 'unknown') as condition, coalesce(label, 'Unknown conditions') as label
from events left join codes on code = event_id % 103 - 2"""))
def q_condition_codes(spark, sf_dir):
    """a code from each event's number, so every code and every gap between them."""
    from hindcast.operators.derived import condition, condition_label
    from hindcast.sources.tables import read_table
    events = read_table(spark, sf_dir, "events").select("event_id", (F.col("event_id") % 103 - 2).alias("code"))
    return events.select("event_id", condition("code").alias("condition"), condition_label("code").alias("label"))
