"""Registry of checked queries: Spark builder + DuckDB oracle per key.

Each Spark builder takes ``(spark, sf_dir)`` and returns a lazy DataFrame over
the full driver tables; each oracle returns SQL over the driver's views.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hindcast import oracle as O
from hindcast.output import finalize, round_sql
from hindcast.plans.models import Models
from hindcast.schemas import METRICS


@dataclass
class Query:
    spark: Callable[[SparkSession, str], DataFrame]
    oracle: Callable[[], str] | None
    doubles: list[str]


QUERIES: dict[str, Query] = {}

FLOAT_METRICS = [m for m in METRICS if m not in ("weather_code", "is_day")]


def register(name: str, doubles: list[str] | None = None, sql: Callable[[], str] | None = None):
    def deco(fn):
        def spark_fn(spark: SparkSession, sf_dir: str) -> DataFrame:
            return finalize(fn(spark, sf_dir))
        spark_fn.__name__ = name
        spark_fn.__doc__ = fn.__doc__
        d = list(doubles or [])
        oracle = (lambda: round_sql(sql(), d)) if sql is not None else None
        QUERIES[name] = Query(spark_fn, oracle, d)
        return fn
    return deco


def _models(spark: SparkSession, sf_dir: str) -> Models:
    """Models over the raw tables landed from ``sf_dir`` (landed once per input);
    staging and intermediate models parse the JSON payloads on every query."""
    return Models.from_landed(spark, sf_dir)


def _marts(spark: SparkSession, sf_dir: str) -> Models:
    """Marts over the materialized typed intermediate layer (JSON parsed once)."""
    return Models.with_materialized_intermediate(spark, sf_dir)


# --------------------------------------------------------------------------- flagship
AGG_DOUBLES = ["resolution_km", "temperature_mean_error", "temperature_mae", "temperature_rmse",
               "apparent_temperature_mae", "relative_humidity_mean_error", "relative_humidity_mae",
               "precipitation_mean_error", "precipitation_mae", "precipitation_rmse", "rain_mae",
               "snowfall_mae", "cloud_cover_mae", "pressure_msl_mae", "visibility_mae",
               "wind_speed_10m_mae", "wind_direction_10m_mae", "wind_gusts_10m_mae", "uv_index_mae",
               "weather_code_exact_match_rate", "day_night_match_rate",
               "precipitation_probability_brier_score"]


@register("agg_model_accuracy", AGG_DOUBLES, lambda: O.with_ctes(O.accuracy_sql(), body=O.agg_sql()))
def q_agg_model_accuracy(spark, sf_dir):
    """J1 J2 E1-E8 A1-A10 over W1 W4 W5 J6 P10: accuracy rollup."""
    return _marts(spark, sf_dir).agg_model_accuracy


ACC_ERRORS = ["temperature_error", "temperature_absolute_error", "temperature_squared_error",
              "apparent_temperature_error", "apparent_temperature_absolute_error",
              "relative_humidity_error", "relative_humidity_absolute_error",
              "precipitation_error", "precipitation_absolute_error", "precipitation_squared_error",
              "rain_error", "rain_absolute_error", "snowfall_error", "snowfall_absolute_error",
              "cloud_cover_error", "cloud_cover_absolute_error", "pressure_msl_error",
              "pressure_msl_absolute_error", "visibility_error", "visibility_absolute_error",
              "wind_speed_10m_error", "wind_speed_10m_absolute_error",
              "wind_direction_10m_absolute_error", "wind_gusts_10m_error",
              "wind_gusts_10m_absolute_error", "uv_index_error", "uv_index_absolute_error",
              "precipitation_probability_brier_score"]
ACC_PAIRS = [m for m in FLOAT_METRICS if m not in ("precipitation_probability", "showers")]
ACC_DOUBLES = (["resolution_km", "forecast_precipitation_probability"]
               + [f"forecast_{m}" for m in ACC_PAIRS] + [f"reference_{m}" for m in ACC_PAIRS] + ACC_ERRORS)


@register("fct_forecast_accuracy", ACC_DOUBLES, lambda: O.with_ctes(O.accuracy_sql(), body="select * from acc"))
def q_fct_forecast_accuracy(spark, sf_dir):
    """Matched forecast/reference hours with errors."""
    return _marts(spark, sf_dir).fct_model_forecast_accuracy


FC_COLS = ["event_id", "location_id", "model_id", "model_name", "provider", "resolution_km",
           "forecast_run_at", "retrieved_at", "valid_at", "forecast_date_utc", "lead_time_hours"]


@register("fct_model_forecasts", ["resolution_km"] + FLOAT_METRICS,
          lambda: O.with_ctes(body=f"select {', '.join(FC_COLS)}, {O.BUCKET} as lead_time_bucket, "
                                   f"{', '.join(METRICS)}, ingested_at from fc"))
def q_fct_model_forecasts(spark, sf_dir):
    """Typed model-run hours with lead buckets (after W1 J6 P10)."""
    return _marts(spark, sf_dir).fct_model_forecasts


VC_COLS = ["event_id", "location_id", "valid_at", "verification_date_utc", "source", "reference_kind",
           "retrieved_at"]


@register("fct_verification", FLOAT_METRICS,
          lambda: O.with_ctes(body=f"select v.{', v.'.join(VC_COLS)}, l.timezone as verification_timezone, "
                                   "v.period_start, v.period_end, "
                                   f"v.{', v.'.join(METRICS)}, v.ingested_at, v.verification_version_count "
                                   "from vc v left join loc l on v.location_id = l.location_id"))
def q_fct_verification(spark, sf_dir):
    """Canonical (latest) verification per location-hour with version counts."""
    return _marts(spark, sf_dir).fct_verification_weather


LOC_COLS = ["location_id", "open_meteo_location_id", "city", "administrative_area", "country",
            "country_code", "latitude", "longitude", "timezone", "elevation", "population",
            "source_created_at", "source_updated_at", "synced_at"]


@register("dim_locations", ["latitude", "longitude", "elevation"],
          lambda: O.with_ctes(body=f"select {', '.join(LOC_COLS)} from loc"))
def q_dim_locations(spark, sf_dir):
    """Newest normalized version of each location."""
    return _models(spark, sf_dir).dim_locations


# --------------------------------------------------------------------------- staging
JSON_TEXT = ["payload", "hourly_forecasts_json", "hourly_weather_json", "current_conditions_json",
             "daily_forecasts_json"]
LOG_SQL = "kafka_topic, kafka_partition, kafka_offset, kafka_key, kafka_timestamp, ingested_at"


def _no_json(df: DataFrame) -> DataFrame:
    """JSON text is checked through the parsed layers; drop it from value checks."""
    return df.drop(*[c for c in JSON_TEXT if c in df.columns])


@register("stg_model_run_events", ["resolution_km"], lambda: O.with_ctes(body=f"""
select event_id, 'forecast.model_run.snapshot' as event_type, cast(1 as bigint) as schema_version,
  location_id, model_id, model_name, provider, resolution_km, forecast_run_at, retrieved_at,
  retrieved_at as event_occurred_at, {LOG_SQL}
from mr_raw qualify row_number() over (partition by event_id order by ingested_at desc,
  kafka_partition desc, kafka_offset desc) = 1"""))
def q_stg_model_run_events(spark, sf_dir):
    """De-duplicated model-run events (replays collapse to the newest delivery)."""
    return _no_json(_models(spark, sf_dir).stg_model_run_events)


@register("stg_verification_events", [], lambda: O.with_ctes(body=f"""
select v.event_id, 'weather.verification.snapshot' as event_type, cast(1 as bigint) as schema_version,
  v.location_id, '{O.fx.VERIFICATION_SOURCE}' as source, 'reanalysis' as reference_kind, v.period_start,
  v.period_end, v.retrieved_at, v.retrieved_at as event_occurred_at, l.timezone as verification_timezone,
  v.{LOG_SQL.replace(', ', ', v.')}
from vev_raw v left join loc l on v.location_id = l.location_id"""))
def q_stg_verification_events(spark, sf_dir):
    """De-duplicated verification events with envelope fields."""
    return _no_json(_models(spark, sf_dir).stg_verification_weather_events)


@register("stg_operational_events", [], lambda: O.with_ctes(body=f"""
select event_id, 'forecast.latest.snapshot' as event_type, cast(1 as bigint) as schema_version,
  location_id, source, retrieved_at, retrieved_at as event_occurred_at, timezone as forecast_timezone,
  {LOG_SQL}
from op_raw"""))
def q_stg_operational_events(spark, sf_dir):
    """De-duplicated operational snapshot events."""
    return _no_json(_models(spark, sf_dir).stg_operational_forecast_events)


@register("stg_locations", ["latitude", "longitude", "elevation"], lambda: O.with_ctes(body="""
select location_id, open_meteo_location_id, city, country, country_code, latitude, longitude, timezone,
  elevation, population, administrative_area, source_created_at, source_updated_at, synced_at from loc"""))
def q_stg_locations(spark, sf_dir):
    """Newest normalized location versions."""
    return _models(spark, sf_dir).stg_locations


# --------------------------------------------------------------------------- intermediate
@register("int_model_run_hourly", ["resolution_km"] + FLOAT_METRICS, lambda: O.with_ctes(body=f"""
select f.event_id, f.location_id, f.model_id, f.model_name, f.provider, f.resolution_km, f.forecast_run_at,
  f.retrieved_at, f.retrieved_at as event_occurred_at,
  f.retrieved_at + interval 1 minute + case when f.location_id % 7 = 0 then interval 1 hour else interval 0 hour end
    as ingested_at,
  f.valid_at, f.lead_time_hours, {', '.join('f.' + m for m in METRICS)}
from fc f"""))
def q_int_model_run_hourly(spark, sf_dir):
    """One typed row per model-run event x hourly element."""
    return _models(spark, sf_dir).int_model_run_hourly_forecasts


@register("int_verification_hourly", FLOAT_METRICS, lambda: O.with_ctes(body=f"""
select v.event_id, v.location_id, '{O.fx.VERIFICATION_SOURCE}' as source, 'reanalysis' as reference_kind,
  v.retrieved_at, l.timezone as verification_timezone, v.period_start, v.period_end,
  v.retrieved_at as event_occurred_at, v.ingested_at, v.valid_at,
  {O._metric_select(O.fx.VERIFICATION_FORMULAS)}
from vall v left join loc l on v.location_id = l.location_id"""))
def q_int_verification_hourly(spark, sf_dir):
    """Every verification version's hours (before W4)."""
    return _models(spark, sf_dir).int_verification_hourly_weather


@register("int_operational_hourly", FLOAT_METRICS, lambda: O.with_ctes(body=f"""
select r.event_id, r.location_id, r.source, r.retrieved_at, r.timezone as forecast_timezone,
  r.retrieved_at as event_occurred_at, r.ingested_at, h.valid_at,
  datesub('hour', r.retrieved_at, h.valid_at) as forecast_horizon_hours,
  {', '.join('h.' + m for m in METRICS)}
from op_raw r join ohm h on r.location_id = h.location_id and r.day = h.day"""))
def q_int_operational_hourly(spark, sf_dir):
    """Typed operational hours with signed whole-hour horizons."""
    return _models(spark, sf_dir).int_operational_hourly_forecasts


# --------------------------------------------------------------------------- marts
@register("dim_forecast_models", ["resolution_km"], lambda: O.with_ctes(body="""
select model_id, any_value(model_name) as model_name, any_value(provider) as provider,
  any_value(resolution_km) as resolution_km,
  min(forecast_run_at) as first_forecast_run_at, max(forecast_run_at) as latest_forecast_run_at,
  count(*) as forecast_run_count
from runs group by model_id"""))
def q_dim_forecast_marts(spark, sf_dir):
    """Model dimension with run summary."""
    return _marts(spark, sf_dir).dim_forecast_models


@register("fct_operational_hourly", FLOAT_METRICS, lambda: O.with_ctes(body=f"""
select r.event_id, r.location_id, r.source, r.retrieved_at as snapshot_at, r.timezone as forecast_timezone,
  h.valid_at, cast((h.valid_at at time zone 'UTC') at time zone r.timezone as date) as local_forecast_date,
  datesub('hour', r.retrieved_at, h.valid_at) as forecast_horizon_hours,
  {', '.join('h.' + m for m in METRICS)}, r.ingested_at
from op_raw r join ohm h on r.location_id = h.location_id and r.day = h.day"""))
def q_fct_operational_hourly(spark, sf_dir):
    """Operational hours with local forecast dates in each snapshot's zone."""
    return _marts(spark, sf_dir).fct_operational_hourly_forecasts


@register("fct_forecast_revisions", ["temperature_2m", "precipitation_probability", "previous_temperature_2m",
                                     "temperature_revision", "previous_precipitation_probability",
                                     "precipitation_probability_revision"], lambda: O.with_ctes(body="""
select event_id, location_id, model_id, model_name, provider, forecast_run_at, valid_at, lead_time_hours,
  temperature_2m, precipitation_probability,
  lag(forecast_run_at) over w as previous_forecast_run_at,
  lag(temperature_2m) over w as previous_temperature_2m,
  temperature_2m - lag(temperature_2m) over w as temperature_revision,
  lag(precipitation_probability) over w as previous_precipitation_probability,
  precipitation_probability - lag(precipitation_probability) over w as precipitation_probability_revision
from fc
window w as (partition by location_id, model_id, valid_at order by forecast_run_at, retrieved_at, event_id)"""))
def q_fct_forecast_revisions(spark, sf_dir):
    """Revision of each forecast against the previous run (lag in small groups)."""
    return _marts(spark, sf_dir).fct_forecast_revisions


@register("revisions_by_model", ["sum_revision"], lambda: O.with_ctes(body="""
select model_id, count(previous_temperature_2m) as revised, sum(temperature_2m - previous_temperature_2m) as sum_revision
from (select model_id, temperature_2m, lag(temperature_2m) over
  (partition by location_id, model_id, valid_at order by forecast_run_at, retrieved_at, event_id)
  as previous_temperature_2m from fc) t group by model_id"""))
def q_revisions_by_model(spark, sf_dir):
    """An aggregate that reads few of the revision mart's columns."""
    return _marts(spark, sf_dir).fct_forecast_revisions.groupBy("model_id").agg(
        F.count("previous_temperature_2m").alias("revised"), F.sum("temperature_revision").alias("sum_revision"))


# --------------------------------------------------------------------------- quality
def _suite():
    from hindcast.plans.quality_suite import warehouse_checks
    return warehouse_checks()


@register("quality_report", [], lambda: O.quality_report_sql(_suite()))
def q_quality_report(spark, sf_dir):
    """Every warehouse data test over every model, one report."""
    from hindcast.operators.quality import report

    m = _marts(spark, sf_dir)
    tables = {name: getattr(m, name) for name in Models.MODEL_NAMES}
    return report(_suite(), tables)


def _built_in_two_loads(spark, sf_dir):
    """The kept tables after two loads: all raw rows but the newest run date's first,
    then that date's, of which only the touched dates are built again."""
    import uuid

    from hindcast.plans import by_date as B
    from hindcast.session import ensure_checkpoint_dir
    from hindcast.sources.landing import land_all

    raw = land_all(spark, sf_dir)
    root = f"{ensure_checkpoint_dir(spark).rstrip('/')}/tables/by-date-{uuid.uuid4().hex}"
    newest = {t: spark.read.parquet(raw[t]).agg(F.max(B.LAYOUT[t][0])).first()[0] for t in B.TYPED.values()}
    first = {t: sorted(B._dates(spark.read.parquet(raw[t]), B.LAYOUT[t][0]) - {newest[t]}) for t in newest}
    written = B.advance(spark, raw, root, first)
    B.refresh_states(spark, raw, root, _suite(), written)
    written = B.advance(spark, raw, root, {t: [d] for t, d in newest.items()})
    B.refresh_states(spark, raw, root, _suite(), written)
    return raw, root, written


@register("quality_report_by_date", [], lambda: O.quality_report_sql(_suite()))
def q_quality_report_by_date(spark, sf_dir):
    """The report merged from check states by date, after a load
    whose dates alone were read again."""
    from hindcast.plans.by_date import report_from_states

    raw, root, _ = _built_in_two_loads(spark, sf_dir)
    return report_from_states(spark, raw, root, _suite())


@register("accuracy_by_date", AGG_DOUBLES, lambda: O.with_ctes(O.accuracy_sql(), body=O.agg_sql()))
def q_accuracy_by_date(spark, sf_dir):
    """The rollup over marts of which the second load rebuilt only touched dates."""
    from hindcast.plans.by_date import kept_models

    raw, root, _ = _built_in_two_loads(spark, sf_dir)
    return kept_models(spark, raw, root).agg_model_accuracy


# --------------------------------------------------------------------------- latest state (hot path)
def _latest(spark, sf_dir):
    from hindcast.operators import latest as L
    from hindcast.sources.landing import read_landed
    from hindcast.sources.logs import log_records

    log = log_records(read_landed(spark, sf_dir, "operational_forecast_events"))
    return L, L.latest_from_log(log, in_files=True)


CURRENT_ABSENT_SQL = {"precipitation_probability", "visibility", "uv_index"}


@register("latest_current", [f"current_{m}" for m in FLOAT_METRICS], lambda: O.with_ctes(O.latest_ctes(), body=f"""
select l.location_id, l.event_id, cast(1 as bigint) as schema_version, l.source, l.retrieved_at, l.timezone,
  f.valid_at as current_valid_at, cast(900 as bigint) as current_interval_seconds,
  {', '.join((('cast(null as double) as current_' + m) if m in CURRENT_ABSENT_SQL else ('f.' + m + ' as current_' + m)) for m in METRICS)},
  l.kafka_timestamp as updated_at
from lat l join lat_first f on l.location_id = f.location_id"""))
def q_latest_current(spark, sf_dir):
    """ST3 ST5 P21: newest operational snapshot per location (strictly-newer rule)."""
    L, latest = _latest(spark, sf_dir)
    return L.current_table(latest)


@register("latest_hourly", FLOAT_METRICS, lambda: O.with_ctes(O.latest_ctes(), body=f"""
select location_id, valid_at, {', '.join(METRICS)} from lat_hours"""))
def q_latest_hourly(spark, sf_dir):
    """ST4: hourly children of each location's latest snapshot."""
    L, latest = _latest(spark, sf_dir)
    return L.latest_hourly(latest)


DAILY_DOUBLES = ["temperature_2m_max", "temperature_2m_min", "apparent_temperature_max",
                 "apparent_temperature_min", "precipitation_sum", "precipitation_probability_max",
                 "precipitation_hours", "wind_speed_10m_max", "wind_gusts_10m_max",
                 "wind_direction_10m_dominant", "daylight_duration_seconds", "uv_index_max"]


@register("latest_daily", DAILY_DOUBLES, lambda: O.with_ctes(O.latest_ctes(), body="""
select location_id, cast(day as date) as forecast_date, weather_code, temperature_2m_max, temperature_2m_min,
  apparent_temperature_max, apparent_temperature_min, precipitation_sum, precipitation_probability_max,
  precipitation_hours, wind_speed_10m_max, wind_gusts_10m_max, wind_direction_10m_dominant, sunrise, sunset,
  daylight_duration_seconds, uv_index_max from lat_daily"""))
def q_latest_daily(spark, sf_dir):
    """ST4: daily children of each location's latest snapshot."""
    L, latest = _latest(spark, sf_dir)
    return L.latest_daily(latest)


@register("latest_document", ["latitude", "longitude", "current_temperature_2m"],
          lambda: O.with_ctes(O.latest_ctes(), body="""
select l.location_id, c.city, c.country, c.country_code, c.administrative_area, c.latitude, c.longitude,
  l.event_id, l.retrieved_at, f.valid_at as current_valid_at, f.temperature_2m as current_temperature_2m,
  h.n as hourly_count, h.first_valid_at, h.last_valid_at, cast(1 as bigint) as daily_count,
  cast(l.day as date) as first_daily_date
from lat l join lat_first f on l.location_id = f.location_id
join loc c on l.location_id = c.location_id
join (select location_id, count(*) as n, min(valid_at) as first_valid_at, max(valid_at) as last_valid_at
      from lat_hours group by location_id) h on l.location_id = h.location_id"""))
def q_latest_document(spark, sf_dir):
    """Per-location document (flattened to scalars for the check)."""
    L, latest = _latest(spark, sf_dir)
    doc = L.snapshot_document(latest, _models(spark, sf_dir).dim_locations)
    return doc.select(
        "location_id", "city", "country", "country_code", "administrative_area", "latitude", "longitude",
        "event_id", "retrieved_at", F.col("current.valid_at").alias("current_valid_at"),
        F.col("current.temperature_2m").alias("current_temperature_2m"),
        F.size("hourly").cast("bigint").alias("hourly_count"),
        F.try_element_at("hourly", F.lit(1))["valid_at"].alias("first_valid_at"),
        F.try_element_at("hourly", F.lit(-1))["valid_at"].alias("last_valid_at"),
        F.size("daily").cast("bigint").alias("daily_count"),
        F.to_date(F.try_element_at("daily", F.lit(1))["date"]).alias("first_daily_date"),
    )


@register("latest_document_json", ["latitude", "current_temperature_2m", "hourly_temperature_2m"], lambda: O.with_ctes(O.latest_ctes(), body="""
select l.location_id, l.event_id as forecast_id, l.location_id as inner_id, c.city, c.administrative_area, c.latitude, l.retrieved_at,
  'celsius mm km/h hPa m' as units, f.valid_at as current_valid_at, f.temperature_2m as current_temperature_2m,
  h.n as hourly_count, h.t as hourly_temperature_2m, cast(l.day as date) as first_daily_date
from lat l join lat_first f on l.location_id = f.location_id
join loc c on l.location_id = c.location_id
join (select location_id, count(*) as n, sum(temperature_2m) as t from lat_hours group by location_id) h on l.location_id = h.location_id"""))
def q_latest_document_json(spark, sf_dir):
    """The documents as JSON text with units, read back from the text."""
    L, latest = _latest(spark, sf_dir)
    text = L.document_json(L.snapshot_document(latest, _models(spark, sf_dir).dim_locations))
    d = F.from_json("document", "data struct<forecast_id string, location struct<id bigint, city string, administrative_area string, "
                    "latitude double>, retrieved_at timestamp, units struct<temperature string, precipitation string, wind_speed string, "
                    "pressure string, visibility string>, current struct<valid_at timestamp, temperature_2m double>, "
                    "hourly array<struct<temperature_2m double>>, daily array<struct<`date` string>>>")
    t = text.select("location_id", d["data"].alias("d"))
    return t.select(
        "location_id", "d.forecast_id", F.col("d.location.id").alias("inner_id"), "d.location.city", "d.location.administrative_area",
        "d.location.latitude", "d.retrieved_at",
        F.concat_ws(" ", *(F.col(f"d.units.{u}") for u in L.UNITS)).alias("units"),
        F.col("d.current.valid_at").alias("current_valid_at"), F.col("d.current.temperature_2m").alias("current_temperature_2m"),
        F.size("d.hourly").cast("bigint").alias("hourly_count"),
        F.aggregate("d.hourly", F.lit(0.0), lambda x, h: x + F.coalesce(h["temperature_2m"], F.lit(0.0))).alias("hourly_temperature_2m"),
        F.to_date(F.try_element_at("d.daily", F.lit(1))["date"]).alias("first_daily_date"))


# --------------------------------------------------------------------------- location catalog
def _bridge(spark, sf_dir):
    from hindcast.sources.bridge import Bridge
    return Bridge.load(spark, sf_dir)


SEARCH_TERM = "customer#0000001"
LOC_DOUBLES = ["latitude", "longitude", "elevation"]


@register("location_search", LOC_DOUBLES, lambda: O.with_ctes(body=f"""
select * from loc where lower(city) like lower('{SEARCH_TERM}') || '%'
order by population desc nulls last, city, location_id limit 10"""))
def q_location_search(spark, sf_dir):
    """City prefix search, population desc NULLS LAST, top 10."""
    from hindcast.operators.locations import search
    return search(_models(spark, sf_dir).dim_locations, SEARCH_TERM, "", 10)


# Every location asks for a beginning of its own city, of 1 to 19 letters; some in their
# country, some with a wildcard inside or in front.
REQUESTS_SQL = """
asked as (select location_id as request_id,
    case when location_id % 11 = 0 then '_' || substr(city, 2, location_id % 19)
         when location_id % 13 = 0 then substr(city, 1, 9) || '%' || (location_id % 100)
         else substr(city, 1, 1 + location_id % 19) end as term,
    case when location_id % 3 = 0 then ' ' || lower(country_code) end as country_code from loc)"""


@register("bulk_location_search", [], lambda: O.with_ctes(REQUESTS_SQL, body="""
select a.request_id, row_number() over (partition by a.request_id
    order by l.population desc nulls last, l.city, l.location_id) as position, l.location_id, l.city, l.country_code, l.population
from asked a join loc l on lower(l.city) like lower(a.term) || '%'
  and (a.country_code is null or upper(trim(a.country_code)) = l.country_code)
qualify position <= 10"""))
def q_bulk_location_search(spark, sf_dir):
    """P15 K1 for a table of terms: each request's ten best matches."""
    from hindcast.operators.search import bulk_search
    dim = _models(spark, sf_dir).dim_locations
    i = F.col("location_id")
    term = (F.when(i % 11 == 0, F.concat(F.lit("_"), F.substring("city", F.lit(2), i % 19)))
            .when(i % 13 == 0, F.concat(F.substring("city", 1, 9), F.lit("%"), (i % 100).cast("string")))
            .otherwise(F.substring("city", F.lit(1), 1 + i % 19)))
    requests = dim.select(i.alias("request_id"), term.alias("term"),
                          F.when(i % 3 == 0, F.concat(F.lit(" "), F.lower("country_code"))).alias("country_code"))
    return bulk_search(dim, requests).select("request_id", "position", "location_id", "city", "country_code", "population")


@register("location_lookup", [], lambda: O.with_ctes(body="""
select r.location_id, l.city, case when l.location_id is null then 'missing' else 'found' end as status
from (select distinct user_id + 1 as location_id from events
      union select distinct user_id + 1000001 from events where user_id % 10 = 0) r
left join loc l on r.location_id = l.location_id"""))
def q_location_lookup(spark, sf_dir):
    """P20: bulk lookup of requested ids (semi join) with the missing ones (anti join)."""
    from hindcast.operators.locations import lookup
    ev = _bridge(spark, sf_dir).events
    req = ev.select((F.col("user_id") + 1).alias("location_id")).unionByName(
        ev.filter(F.col("user_id") % 10 == 0).select((F.col("user_id") + 1_000_001).alias("location_id")))
    dim = _models(spark, sf_dir).dim_locations
    found, missing = lookup(dim, req)
    return found.select("location_id", "city", F.lit("found").alias("status")).unionByName(
        missing.select("location_id", F.lit(None).cast("string").alias("city"), F.lit("missing").alias("status")))


ALLOW = [" aa", "bh", "CO", "DV ", "ec"]


@register("allowed_locations", LOC_DOUBLES, lambda: O.with_ctes(body="""
select * from loc where country_code in ('AA', 'BH', 'CO', 'DV', 'EC')"""))
def q_allowed_locations(spark, sf_dir):
    """Allow-list filter with trimmed, upper-cased two-letter codes."""
    from hindcast.operators.locations import allowed_locations
    return allowed_locations(_models(spark, sf_dir).dim_locations, ALLOW)


@register("geocode_candidates", LOC_DOUBLES, lambda: O.with_ctes(body="""
select location_id as request_id, open_meteo_location_id, city, country, country_code, latitude, longitude,
  timezone, elevation, population, administrative_area
from loc where location_id % 13 <> 1"""))
def q_geocode_candidates(spark, sf_dir):
    """Landed geocoding responses -> normalized candidates (incomplete responses rejected)."""
    from hindcast.operators.locations import geocode_candidates
    cand, _ = geocode_candidates(_bridge(spark, sf_dir).geocoding())
    return cand


STALE_BEFORE = "2024-01-25 00:00:00"


@register("due_locations", LOC_DOUBLES, lambda: O.with_ctes(O.latest_ctes(), body=f"""
select c.*, l.retrieved_at as forecast_retrieved_at from loc c left join lat l on c.location_id = l.location_id
where l.location_id is null or l.retrieved_at <= timestamp '{STALE_BEFORE}'
order by l.retrieved_at asc nulls first, c.location_id limit 100"""))
def q_due_locations(spark, sf_dir):
    """Locations due for a forecast (none yet, or stale), oldest first, top 100."""
    from hindcast.operators.locations import due_for_forecast
    _, latest = _latest(spark, sf_dir)
    dim = _models(spark, sf_dir).dim_locations
    return due_for_forecast(dim, latest, F.lit(STALE_BEFORE).cast("timestamp"), 100)


MERGE_NOW = "2024-02-01 00:00:00"


@register("location_merge", LOC_DOUBLES, lambda: O.with_ctes(body=f"""
select location_id, open_meteo_location_id, city, country, country_code, latitude, longitude, timezone, elevation,
  population, administrative_area, source_created_at as created_at, timestamp '{MERGE_NOW}' as updated_at
from loc where location_id % 2 = 0 and location_id % 13 <> 1
union all
select location_id, open_meteo_location_id, city, country, country_code, latitude, longitude, timezone, elevation,
  population, administrative_area, source_created_at as created_at, source_updated_at as updated_at
from loc where location_id % 2 = 0 and location_id % 13 = 1
union all
select (select max(location_id) from loc where location_id % 2 = 0)
    + row_number() over (order by open_meteo_location_id) as location_id,
  open_meteo_location_id, city, country, country_code, latitude, longitude, timezone, elevation, population,
  administrative_area, timestamp '{MERGE_NOW}' as created_at, timestamp '{MERGE_NOW}' as updated_at
from loc where location_id % 2 = 1 and location_id % 13 <> 1"""))
def q_location_merge(spark, sf_dir):
    """ST6 (P13 -> ST6): upsert geocoded candidates into the even-numbered half of the catalog."""
    from hindcast.operators.locations import geocode_candidates, merge_locations
    dim = _models(spark, sf_dir).dim_locations
    existing = dim.filter(F.col("location_id") % 2 == 0).select(
        "location_id", "open_meteo_location_id", "city", "country", "country_code", "latitude", "longitude",
        "timezone", "elevation", "population", "administrative_area",
        F.col("source_created_at").alias("created_at"), F.col("source_updated_at").alias("updated_at"))
    cand, _ = geocode_candidates(_bridge(spark, sf_dir).geocoding())
    return merge_locations(existing, cand, F.lit(MERGE_NOW).cast("timestamp"), arrival="request_id")


@register("location_merge_ids", [], lambda: O.with_ctes(body="""
select count(*) as n, count(distinct location_id) as distinct_ids, min(location_id) as least, max(location_id) as greatest
from (select (select max(location_id) from loc where location_id % 2 = 0)
    + row_number() over (order by open_meteo_location_id) as location_id
  from loc where location_id % 2 = 1 and location_id % 13 <> 1) t"""))
def q_location_merge_ids(spark, sf_dir):
    """ST6: ids given to new locations are distinct and without gaps after the maximum."""
    merged = q_location_merge(spark, sf_dir)
    fresh = merged.filter(F.col("created_at") == F.lit(MERGE_NOW).cast("timestamp"))
    return fresh.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("location_id").alias("distinct_ids"),
                     F.min("location_id").alias("least"), F.max("location_id").alias("greatest"))


SYNC_AT = "2024-01-02 00:00:00"


@register("location_snapshot", LOC_DOUBLES, lambda: O.with_ctes(body=f"""
select location_id, open_meteo_location_id, city, country, country_code, latitude, longitude, timezone, elevation,
  population, administrative_area, source_created_at, source_updated_at, timestamp '{SYNC_AT}' as synced_at
from loc"""))
def q_location_snapshot(spark, sf_dir):
    """Validated full snapshot (upper-case codes, rules, synced_at stamped)."""
    from hindcast.operators.locations import validated_snapshot
    return validated_snapshot(_models(spark, sf_dir).stg_locations, F.lit(SYNC_AT).cast("timestamp"))


REFERENCE_TIME = "2024-01-22 16:00:00"


def _targets(spark, sf_dir):
    from hindcast.operators.locations import verification_targets
    dim = _models(spark, sf_dir).dim_locations
    # Every 50th location carries an unknown zone: it must fail alone, not the job.
    dim = dim.withColumn("timezone", F.when(F.col("location_id") % 50 == 0, F.lit("Invalid/Timezone"))
                         .otherwise(F.col("timezone")))
    return verification_targets(dim, F.lit(REFERENCE_TIME).cast("timestamp"), 7)


TARGETS_SQL = f"""
tz as (select location_id, case when location_id % 50 = 0 then 'Invalid/Timezone' else timezone end as timezone
       from loc),
ok as (select location_id, timezone,
         cast((timestamp '{REFERENCE_TIME}' at time zone 'UTC') at time zone timezone as date) - 7 as target_date
       from tz where timezone <> 'Invalid/Timezone'),
tgt as (select t.location_id, t.timezone, o.target_date,
          case when o.location_id is null then 'failed' else 'due' end as status
        from tz t left join ok o on t.location_id = o.location_id)"""


@register("verification_targets", [], lambda: O.with_ctes(TARGETS_SQL, body="select * from tgt"))
def q_verification_targets(spark, sf_dir):
    """per-location verification target date in its own zone; bad zones fail alone."""
    return _targets(spark, sf_dir)


@register("cycle_report", [], lambda: O.with_ctes(TARGETS_SQL, body="""
select status, count(*) as locations from (
  select case when t.status = 'failed' then 'failed'
              when exists (select 1 from vc v where v.location_id = t.location_id
                           and cast(v.valid_at as date) = t.target_date) then 'published'
              else 'due' end as status
  from tgt t) group by status"""))
def q_cycle_report(spark, sf_dir):
    """Verification cycle outcome counts (failed / published / still due)."""
    from hindcast.operators.locations import cycle_report
    t = _targets(spark, sf_dir)
    have = (_marts(spark, sf_dir).fct_verification_weather
            .select("location_id", F.col("verification_date_utc").alias("target_date")).distinct())
    have = have.withColumn("__has", F.lit(True))
    o = t.join(have, ["location_id", "target_date"], "left").withColumn(
        "status", F.when(F.col("status") == "failed", "failed")
        .when(F.col("__has").isNotNull(), "published").otherwise("due"))
    return cycle_report(o)


# --------------------------------------------------------------------------- derived display values
NOW = "2024-01-15 12:00:00"


def _now():
    return F.lit(NOW).cast("timestamp")


CITY_SQL = f"""
city as (select l.location_id, l.timezone, l.retrieved_at,
  (timestamp '{NOW}' at time zone 'UTC') at time zone l.timezone as city_now from lat l),
today as (select c.location_id, d.sunrise, d.sunset from city c
  join lat_daily d on c.location_id = d.location_id and d.date = strftime(c.city_now, '%Y-%m-%d'))"""


@register("next_24_hours", ["temperature_2m"], lambda: O.with_ctes(O.latest_ctes(), body=f"""
select h.location_id, row_number() over (partition by h.location_id order by h.valid_at) as position,
  h.valid_at, h.temperature_2m, h.weather_code
from lat_hours h join lat_first f on h.location_id = f.location_id
where h.valid_at >= greatest(timestamp '{NOW}', f.valid_at)
qualify position <= 24"""))
def q_next_24_hours(spark, sf_dir):
    """The next 24 hours of each location's latest snapshot."""
    from hindcast.operators.derived import upcoming_hours
    _, latest = _latest(spark, sf_dir)
    up = latest.select("location_id", F.posexplode(upcoming_hours("hourly", "current.valid_at", _now())))
    return up.select("location_id", (F.col("pos") + 1).cast("bigint").alias("position"),
                     F.col("col.valid_at").alias("valid_at"), F.col("col.temperature_2m").alias("temperature_2m"),
                     F.col("col.weather_code").alias("weather_code"))


@register("upcoming_days", ["temperature_2m_max"], lambda: O.with_ctes(O.latest_ctes(), CITY_SQL, body="""
select d.location_id, cast(d.day as date) as forecast_date, d.temperature_2m_max
from lat_daily d join city c on d.location_id = c.location_id
where cast(d.day as date) >= cast(c.city_now as date)"""))
def q_upcoming_days(spark, sf_dir):
    """Daily rows on or after each city's local date."""
    from hindcast.operators.derived import upcoming_days, with_city_clock
    _, latest = _latest(spark, sf_dir)
    c = with_city_clock(latest, _now())
    d = c.select("location_id", F.inline(upcoming_days("daily", "city_now")))
    return d.select("location_id", F.to_date("date").alias("forecast_date"), "temperature_2m_max")


FILL = ["precipitation_probability", "uv_index", "visibility", "cloud_cover", "pressure_msl", "wind_gusts_10m"]
CUR_NULL = {"precipitation_probability", "visibility", "uv_index"}


@register("nearest_hour_fill", FILL, lambda: O.with_ctes(O.latest_ctes(), body=f"""
select f.location_id, f.valid_at as current_valid_at, n.valid_at as nearest_valid_at,
  {', '.join(('n.' + m if m in CUR_NULL else f'coalesce(f.{m}, n.{m})') + ' as ' + m for m in FILL)}
from lat_first f join (
  select h.*, f2.valid_at as cur from lat_hours h join lat_first f2 on h.location_id = f2.location_id
  qualify row_number() over (partition by h.location_id
    order by abs(epoch(h.valid_at) - epoch(f2.valid_at)), h.valid_at) = 1) n on f.location_id = n.location_id"""))
def q_nearest_hour_fill(spark, sf_dir):
    """Current conditions filled from the nearest hourly row."""
    from hindcast.operators.derived import fill_current, nearest_hour
    _, latest = _latest(spark, sf_dir)
    n = latest.select("location_id", "current", nearest_hour("hourly", "current.valid_at").alias("nearest"))
    return n.select("location_id", F.col("current.valid_at").alias("current_valid_at"),
                    F.col("nearest.valid_at").alias("nearest_valid_at"), *fill_current("current", "nearest"))


@register("nearest_hour_join", ["nearest_temperature_2m"], lambda: O.with_ctes(body="""
select r.event_id, r.location_id, r.retrieved_at, v.valid_at as nearest_valid_at, v.event_id as nearest_event_id,
  v.temperature_2m as nearest_temperature_2m
from op_raw r left join vc v on r.location_id = v.location_id
qualify row_number() over (partition by r.event_id
  order by abs(epoch(v.valid_at) - epoch(r.retrieved_at)), v.valid_at) = 1"""))
def q_nearest_hour_join(spark, sf_dir):
    """J8 between tables: every snapshot with its location's nearest verified hour."""
    from hindcast.operators.asof import nearest_join
    m = _marts(spark, sf_dir)
    snapshots = m.stg_operational_forecast_events.select("event_id", "location_id", "retrieved_at")
    return nearest_join(snapshots, m.fct_verification_weather, ["location_id"], "retrieved_at", "valid_at",
                        ["event_id", "temperature_2m"])


def _cond_sql(col: str, idx: int) -> str:
    from hindcast.operators.derived import CONDITIONS, UNKNOWN
    whens = " ".join(f"when {col} in ({', '.join(map(str, codes))}) then '{c[idx]}'"
                     for codes, *c in [(x[0], x[1], x[2]) for x in CONDITIONS])
    return f"case {whens} else '{UNKNOWN[idx]}' end"


@register("condition_labels", [], lambda: O.with_ctes(O.latest_ctes(), body=f"""
select location_id, valid_at, weather_code, {_cond_sql('weather_code', 0)} as condition,
  {_cond_sql('weather_code', 1)} as label from lat_hours"""))
def q_condition_labels(spark, sf_dir):
    """WMO code -> condition and label for every latest hourly row."""
    from hindcast.operators.derived import condition, condition_label
    from hindcast.operators.unnest import inline_rows
    _, latest = _latest(spark, sf_dir)
    h = inline_rows(latest, ["location_id"], "hourly")
    return h.select("location_id", "valid_at", "weather_code", condition("weather_code").alias("condition"),
                    condition_label("weather_code").alias("label"))


@register("freshness", [], lambda: O.with_ctes(O.latest_ctes(), body=f"""
select location_id, retrieved_at, epoch(timestamp '{NOW}') - epoch(retrieved_at) > 7200 as is_stale from lat"""))
def q_freshness(spark, sf_dir):
    """stale when strictly older than two hours at a fixed ``now``."""
    from hindcast.operators.derived import is_stale
    _, latest = _latest(spark, sf_dir)
    return latest.select("location_id", "retrieved_at", is_stale("retrieved_at", _now()).alias("is_stale"))


@register("daylight", [], lambda: O.with_ctes(O.latest_ctes(), CITY_SQL, body=f"""
select c.location_id,
  case when t.sunrise is not null and t.sunset is not null
       then timestamp '{NOW}' >= t.sunrise and timestamp '{NOW}' < t.sunset
       else hour(c.city_now) >= 6 and hour(c.city_now) < 18 end as is_daylight
from city c left join today t on c.location_id = t.location_id"""))
def q_daylight(spark, sf_dir):
    """Daylight from today's sun times in the city's zone, else clock hours."""
    from hindcast.operators.derived import is_daylight, todays_daily, with_city_clock
    _, latest = _latest(spark, sf_dir)
    c = with_city_clock(latest, _now())
    t = todays_daily("daily", "city_now")
    return c.select("location_id", is_daylight(_now(), "city_now", t, "current.is_day").alias("is_daylight"))


@register("day_period", [], lambda: O.with_ctes(O.latest_ctes(), CITY_SQL, body=f"""
select c.location_id,
  case when t.sunrise is not null and t.sunset is not null then
    case when timestamp '{NOW}' >= t.sunrise - interval 90 minute and timestamp '{NOW}' < t.sunrise + interval 2 hour
           then 'morning'
         when timestamp '{NOW}' >= t.sunset - interval 2 hour and timestamp '{NOW}' < t.sunset + interval 90 minute
           then 'evening'
         when timestamp '{NOW}' >= t.sunrise + interval 2 hour and timestamp '{NOW}' < t.sunset - interval 2 hour
           then 'day'
         else 'night' end
  else case when hour(c.city_now) >= 5 and hour(c.city_now) < 9 then 'morning'
            when hour(c.city_now) >= 9 and hour(c.city_now) < 17 then 'day'
            when hour(c.city_now) >= 17 and hour(c.city_now) < 20 then 'evening' else 'night' end
  end as period
from city c left join today t on c.location_id = t.location_id"""))
def q_day_period(spark, sf_dir):
    """morning/day/evening/night from sun windows, else clock hours."""
    from hindcast.operators.derived import day_period, todays_daily, with_city_clock
    _, latest = _latest(spark, sf_dir)
    c = with_city_clock(latest, _now())
    t = todays_daily("daily", "city_now")
    return c.select("location_id", day_period(_now(), "city_now", t, "current.is_day").alias("period"))


# --------------------------------------------------------------------------- cold-path ingest
def _log(spark, sf_dir, table):
    from hindcast.sources.landing import read_landed
    from hindcast.sources.logs import log_records
    return log_records(read_landed(spark, sf_dir, table))


def _ingested():
    # The load time of a batch is a parameter: here one minute after the record time.
    return F.col("timestamp") + F.expr("INTERVAL 1 MINUTE")


RAW_LOG_SQL = ("kafka_topic, kafka_partition, kafka_offset, kafka_key, kafka_timestamp, "
               "kafka_timestamp + interval 1 minute as ingested_at")


@register("raw_model_run", [], lambda: O.with_ctes(body=f"""
select event_id, 'forecast.model_run.snapshot' as event_type, cast(1 as bigint) as schema_version, location_id,
  model_id, provider, forecast_run_at, retrieved_at, {RAW_LOG_SQL} from mr_raw"""))
def q_raw_model_run(spark, sf_dir):
    """Model-run log records -> raw rows (strict: any violation fails the batch)."""
    return _raw_model_runs(spark, sf_dir)


def _raw_model_runs(spark, sf_dir):
    from hindcast.sources import raw
    return raw.strict(raw.model_run_rows(_log(spark, sf_dir, "model_run_events"), _ingested())).drop("payload")


@register("raw_operational", [], lambda: O.with_ctes(body=f"""
select event_id, 'forecast.latest.snapshot' as event_type, cast(1 as bigint) as schema_version, location_id,
  source, retrieved_at, {RAW_LOG_SQL} from op_raw"""))
def q_raw_operational(spark, sf_dir):
    """Operational snapshot records -> raw rows."""
    from hindcast.sources import raw
    return raw.strict(raw.operational_rows(_log(spark, sf_dir, "operational_forecast_events"),
                                           _ingested())).drop("payload")


@register("raw_verification", [], lambda: O.with_ctes(body=f"""
select event_id, 'weather.verification.snapshot' as event_type, cast(1 as bigint) as schema_version, location_id,
  '{O.fx.VERIFICATION_SOURCE}' as source, 'reanalysis' as reference_kind, period_start, period_end, retrieved_at,
  {RAW_LOG_SQL} from vev_raw"""))
def q_raw_verification(spark, sf_dir):
    """Verification records -> raw rows (period and ordering rules)."""
    from hindcast.sources import raw
    return raw.strict(raw.verification_rows(_log(spark, sf_dir, "verification_weather_events"),
                                            _ingested())).drop("payload")


def _broken_log(spark, sf_dir):
    """All three topics with deterministic defects on a few locations' records."""
    mr = _log(spark, sf_dir, "model_run_events")
    mr = mr.withColumn("__loc", F.split("key", ":").getItem(0).try_cast("bigint"))
    loc = F.col("__loc")
    mr = (mr.withColumn("key", F.when(loc % 97 == 3, F.lit("wrong-key")).otherwise(F.col("key")))
          .withColumn("value", F.when(loc % 89 == 5, F.lit("not-json"))
                      .when(loc % 79 == 11, F.regexp_replace("value", r'"lead_time_hours":\d+',
                                                              '"lead_time_hours":999'))
                      .otherwise(F.col("value")))).drop("__loc")
    vr = _log(spark, sf_dir, "verification_weather_events")
    vr = vr.withColumn("topic", F.when(F.col("key").try_cast("bigint") % 83 == 7, F.lit("forecast.unknown"))
                       .otherwise(F.col("topic")))
    op = _log(spark, sf_dir, "operational_forecast_events")
    return mr.unionByName(vr).unionByName(op)


@register("ingest_violations", [], lambda: O.with_ctes(body="""
select kafka_topic, kafka_partition, kafka_offset, 'invalid_json' as violation from mr_raw where location_id % 89 = 5
union all
select kafka_topic, kafka_partition, kafka_offset, 'key_mismatch' from mr_raw
  where location_id % 97 = 3 and location_id % 89 <> 5
union all
select kafka_topic, kafka_partition, kafka_offset, 'lead_time_mismatch' from mr_raw
  where location_id % 79 = 11 and location_id % 89 <> 5
union all
select 'forecast.unknown', kafka_partition, kafka_offset, 'unknown_topic' from vev_raw where location_id % 83 = 7"""))
def q_ingest_violations(spark, sf_dir):
    """Every (record, rule) failing in a log with defective records."""
    from hindcast.sources import raw
    return raw.violation_rows(_broken_log(spark, sf_dir), _ingested())


# --------------------------------------------------------------------------- provider responses
def _responses(spark, sf_dir, optional):
    from hindcast.sources import response as R
    parsed = R.with_violations(R.parse_responses(_bridge(spark, sf_dir).responses()), optional)
    return R, parsed


@register("response_hourly", FLOAT_METRICS, lambda: O.with_ctes(body=f"""
select location_id, day as run_at, valid_at, datesub('hour', day, valid_at) as lead_time_hours,
  {', '.join(('case when location_id % 37 = 0 then null else ' + m + ' end as ' + m) if m == 'precipitation_probability' else m for m in METRICS)}
from ohm where location_id % 31 <> 0 and location_id % 41 <> 0"""))
def q_response_hourly(spark, sf_dir):
    """Landed responses -> hourly rows (optional probability; bad responses rejected)."""
    R, parsed = _responses(spark, sf_dir, ["precipitation_probability"])
    ok = parsed.filter(F.size("violations") == 0)
    return R.hourly_rows(ok, ["location_id", "run_at"], run_at=F.col("run_at"))


@register("response_violations", [], lambda: O.with_ctes(body="""
select distinct location_id, day as run_at, 'series_length:wind_gusts_10m' as violation from ohm
  where location_id % 31 = 0
union all
select distinct location_id, day, 'invalid_is_day' from ohm where location_id % 41 = 0
union all
select distinct location_id, day, 'missing_series:precipitation_probability' from ohm where location_id % 37 = 0"""))
def q_response_violations(spark, sf_dir):
    """F17 F18 (strict operational flavour): every rule a response breaks; all 17 series required."""
    R, parsed = _responses(spark, sf_dir, [])
    return parsed.select("location_id", "run_at", F.explode("violations").alias("violation"))


@register("response_daily", ["temperature_2m_max", "temperature_2m_min", "precipitation_sum",
                              "daylight_duration_seconds"],
          lambda: O.with_ctes(body="""
select location_id, day as run_at, cast(day as date) as forecast_date, max(temperature_2m) as temperature_2m_max,
  min(temperature_2m) as temperature_2m_min, sum(precipitation) as precipitation_sum,
  case when location_id % 4 <> 0 then day + interval 5 hour + interval 45 minute end as sunrise,
  case when location_id % 4 <> 0 then 44100e0 end as daylight_duration_seconds
from ohm where location_id % 31 <> 0 and location_id % 41 <> 0 group by location_id, day"""))
def q_response_daily(spark, sf_dir):
    """Daily block -> rows with ISO dates and UTC sunrise."""
    R, parsed = _responses(spark, sf_dir, ["precipitation_probability"])
    ok = parsed.filter(F.size("violations") == 0)
    return R.daily_rows(ok, ["location_id", "run_at"]).select(
        "location_id", "run_at", "forecast_date", "temperature_2m_max", "temperature_2m_min", "precipitation_sum",
        "sunrise", "daylight_duration_seconds")


@register("response_current", [m for m in FLOAT_METRICS if m not in ("precipitation_probability", "visibility",
                                                                     "uv_index")], lambda: O.with_ctes(body=f"""
select location_id, day as run_at, valid_at, cast(900 as bigint) as interval_seconds,
  {', '.join(m for m in METRICS if m not in ('precipitation_probability', 'visibility', 'uv_index'))}
from ohm where location_id % 31 <> 0 and location_id % 41 <> 0
qualify row_number() over (partition by location_id, day order by valid_at) = 1"""))
def q_response_current(spark, sf_dir):
    """Current conditions (14 metrics) from valid responses."""
    R, parsed = _responses(spark, sf_dir, ["precipitation_probability"])
    ok = parsed.filter(F.size("violations") == 0)
    return R.current_row(ok, ["location_id", "run_at"])


@register("daily_violations", [], lambda: O.with_ctes("""
days as (select distinct location_id, day as run_at from ohm)""", body="""
select location_id, run_at, 'empty_daily_time' as violation from days where location_id % 7 = 0
union all
select location_id, run_at, 'missing_daily_series:uv_index_max' from days where location_id % 7 <> 0 and location_id % 11 = 0
union all
select location_id, run_at, 'daily_series_length:sunrise' from days where location_id % 7 <> 0 and location_id % 13 = 0
union all
select location_id, run_at, 'invalid_daily_date' from days where location_id % 7 <> 0 and location_id % 17 = 0"""))
def q_daily_violations(spark, sf_dir):
    """Daily blocks that are absent, lack a series, are too short or have no date."""
    from hindcast.sources import response as R
    parsed = R.parse_responses(_bridge(spark, sf_dir).responses(daily_defects=True))
    return parsed.select("location_id", "run_at", F.explode(R.daily_violations()).alias("violation"))


VERIFIED = [m for m in METRICS if m in O.VERIFICATION_SERIES]


def _verification_responses(spark, sf_dir):
    from hindcast.sources import response as R
    parsed = R.parse_responses(_bridge(spark, sf_dir).verification_responses())
    return R, parsed.withColumn("violations", R.verification_violations())


@register("verification_response_hourly", FLOAT_METRICS, lambda: O.with_ctes(body=f"""
select location_id, retrieved_at, valid_at,
  {', '.join(f"{f} as {m}" if m in VERIFIED else f"cast(null as double) as {m}" for m, f in O.fx.VERIFICATION_FORMULAS.items())}
from (select *, count(*) over (partition by event_id) as n from vall) v
where location_id % 23 <> 0 and location_id % 29 <> 0 and (location_id % 43 <> 0 or n = 1)"""))
def q_verification_response_hourly(spark, sf_dir):
    """Reanalysis responses (13 series) -> hourly rows; bad responses rejected."""
    R, parsed = _verification_responses(spark, sf_dir)
    return R.verification_rows(parsed.filter(F.size("violations") == 0), ["location_id", "retrieved_at"])


@register("verification_response_violations", [], lambda: O.with_ctes("""
sent as (select event_id, location_id, retrieved_at, count(*) as n from vall group by all)""", body="""
select location_id, retrieved_at, 'missing_series:rain' as violation from sent where location_id % 23 = 0
union all
select location_id, retrieved_at, 'series_length:snowfall' from sent where location_id % 29 = 0
union all
select location_id, retrieved_at, 'unordered_hourly_time' from sent where location_id % 43 = 0 and n > 1"""))
def q_verification_response_violations(spark, sf_dir):
    """Every rule that a reanalysis response breaks."""
    _, parsed = _verification_responses(spark, sf_dir)
    return parsed.select("location_id", "retrieved_at", F.explode("violations").alias("violation"))


# --------------------------------------------------------------------------- event identity and records
@register("event_identity", [], lambda: O.with_ctes(body="""
select event_id, event_id as recomputed_event_id, kafka_key as partition_key, period_start, period_end
from vev_raw"""))
def q_event_identity(spark, sf_dir):
    """Verification identities recomputed from the payload (period = first/last hour)."""
    from hindcast.functions import identity as I
    from hindcast.functions.json import parse_text_fields, safe_cast
    stg = _models(spark, sf_dir).stg_verification_weather_events
    hourly = F.from_json("hourly_weather_json", "array<struct<valid_at string>>")
    first, last = I.period_bounds(hourly)
    d = stg.select("event_id", "source", "reference_kind", "location_id", "retrieved_at",
                   safe_cast(first, "timestamp").alias("first_valid"), safe_cast(last, "timestamp").alias("last_valid"))
    return d.select(
        "event_id",
        I.verification_event_id("source", "reference_kind", "location_id", "retrieved_at", "first_valid",
                                "last_valid").alias("recomputed_event_id"),
        I.location_key("location_id").alias("partition_key"),
        F.col("first_valid").alias("period_start"), F.col("last_valid").alias("period_end"))


@register("event_records", [], lambda: O.with_ctes(body="""
select 'forecast.runs' as topic, cast(location_id as varchar) || ':' || model_id as key, event_id,
  hour_count as hourly_count, first_valid_at, last_valid_at from runs"""))
def q_event_records(spark, sf_dir):
    """Typed hours -> one event per run -> Kafka records (value text not compared)."""
    from hindcast.operators.events import assemble_model_run_events, kafka_records
    hours = _marts(spark, sf_dir).int_model_run_hourly_forecasts
    ev = assemble_model_run_events(hours)
    rec = kafka_records(ev)
    parsed = F.from_json("value", "struct<data struct<hourly array<struct<valid_at string>>>>")
    h = parsed["data"]["hourly"]
    return rec.select(
        "topic", "key",
        F.col("headers")[0]["value"].cast("string").alias("event_id"),
        F.size(h).cast("bigint").alias("hourly_count"),
        F.try_element_at(h, F.lit(1))["valid_at"].try_cast("timestamp").alias("first_valid_at"),
        F.try_element_at(h, F.lit(-1))["valid_at"].try_cast("timestamp").alias("last_valid_at"))


PAYLOAD_SUMS = [m for m in METRICS if m != "is_day"]
_SUMS_SQL = ", ".join(f"sum({m}) as {m}" for m in PAYLOAD_SUMS) + ", count(*) filter (where is_day) as is_day"
_DAILY_SUMS = ["temperature_2m_max", "temperature_2m_min", "precipitation_sum", "precipitation_hours", "wind_gusts_10m_max",
               "daylight_duration_seconds"]


@register("event_payloads", [m for m in FLOAT_METRICS] + [f"daily_{d}" for d in _DAILY_SUMS], lambda: O.with_ctes(f"""
run_sums as (select event_id, min(valid_at) as first_valid_at, max(valid_at) as last_valid_at, count(*) as hourly_count, {_SUMS_SQL}
  from fc group by event_id),
ver_sums as (select event_id, min(valid_at) as first_valid_at, max(valid_at) as last_valid_at, count(*) as hourly_count, {_SUMS_SQL}
  from (select event_id, valid_at, {O._metric_select(O.fx.VERIFICATION_FORMULAS)} from vall) group by event_id),
op_sums as (select location_id, day, min(valid_at) as first_valid_at, max(valid_at) as last_valid_at, count(*) as hourly_count, {_SUMS_SQL},
    max(temperature_2m) as daily_temperature_2m_max, min(temperature_2m) as daily_temperature_2m_min,
    sum(precipitation) as daily_precipitation_sum, cast(count_if(precipitation > 0) as double) as daily_precipitation_hours,
    max(wind_gusts_10m) as daily_wind_gusts_10m_max, case when location_id % 4 <> 0 then 44100e0 end as daily_daylight_duration_seconds
  from ohm group by location_id, day)""", body=f"""
select 'forecast.runs' as topic, cast(r.location_id as varchar) || ':' || r.model_id as key, r.event_id,
  'forecast.model_run.snapshot' as event_type, '1' as schema_version, r.retrieved_at as occurred_at, r.location_id, r.model_id as made_by,
  r.forecast_run_at as starts_at, cast(null as timestamp) as ends_at, cast(null as varchar) as timezone, s.* exclude (event_id),
  cast(null as bigint) as daily_count, cast(null as date) as daily_date,
  {', '.join(f'cast(null as double) as daily_{d}' for d in _DAILY_SUMS)}
from runs r join run_sums s on r.event_id = s.event_id
union all by name
select 'weather.verification' as topic, v.kafka_key as key, v.event_id, 'weather.verification.snapshot' as event_type, '1' as schema_version,
  v.retrieved_at as occurred_at, v.location_id, '{O.fx.VERIFICATION_SOURCE}/reanalysis' as made_by, v.period_start as starts_at,
  v.period_end as ends_at, l.timezone, s.* exclude (event_id)
from vev_raw v join ver_sums s on v.event_id = s.event_id left join loc l on v.location_id = l.location_id
union all by name
select 'forecast.latest' as topic, o.kafka_key as key, o.event_id, 'forecast.latest.snapshot' as event_type, '1' as schema_version,
  o.retrieved_at as occurred_at, o.location_id, o.source as made_by, s.first_valid_at as starts_at, cast(null as timestamp) as ends_at,
  o.timezone, s.* exclude (location_id, day), cast(1 as bigint) as daily_count, cast(o.day as date) as daily_date
from op_raw o join op_sums s on o.location_id = s.location_id and o.day = s.day"""))
def q_event_payloads(spark, sf_dir):
    """Typed rows of all three streams -> events -> records, with every field of their payloads read back."""
    from hindcast.functions.json import safe_cast
    from hindcast.operators import events as EV, latest as L
    from hindcast.schemas import metric_sql_type
    from hindcast.sources.landing import read_landed
    from hindcast.sources.logs import log_records
    from hindcast.streaming.io import scratch_root
    m = _marts(spark, sf_dir)
    # the three kinds of rows are read from one typed table, so each record is parsed once
    root = scratch_root(spark, "snapshots")
    L.decode_latest_events(log_records(read_landed(spark, sf_dir, "operational_forecast_events"))).write.option("compression", "zstd").parquet(root)
    snaps = spark.read.parquet(root)
    keys = EV.SNAPSHOT_KEYS
    operational = EV.assemble_operational_events(snaps.select(*keys, "timezone", "current"), snaps.select(*keys, F.inline("hourly")),
                                                 snaps.select(*keys, F.inline("daily")))
    made = [EV.kafka_records(e) for e in (EV.assemble_model_run_events(m.int_model_run_hourly_forecasts),
                                          EV.assemble_verification_events(m.int_verification_hourly_weather), operational)]
    hourly = ", ".join(f"`{x}` {metric_sql_type(x)}" for x in METRICS)
    daily = ", ".join(f"`{x}` double" for x in _DAILY_SUMS)
    value = F.from_json("value", "event_id string, event_type string, schema_version int, occurred_at string, data struct<location_id bigint, "
                        "source string, reference_kind string, retrieved_at string, timezone string, model struct<model_id string>, "
                        "forecast_run_at string, period_start string, period_end string, current struct<valid_at string>, "
                        f"hourly array<struct<valid_at string, {hourly}>>, daily array<struct<`date` string, {daily}>>>")
    rec = made[0].unionByName(made[1]).unionByName(made[2]).select("topic", "key", "headers", value.alias("v"))
    header = lambda n, name: F.when(F.col("headers")[n]["key"] == name, F.col("headers")[n]["value"].cast("string"))
    at = lambda c: safe_cast(F.col(c), "timestamp")
    hours, days = F.col("v.data.hourly"), F.col("v.data.daily")
    total = lambda x: F.when(F.exists(hours, lambda h: h[x].isNotNull()), F.aggregate(
        hours, F.lit(0).cast(metric_sql_type(x)), lambda t, h: t + F.coalesce(h[x], F.lit(0).cast(metric_sql_type(x)))))
    one = F.try_element_at(days, F.lit(1))
    agreed = (header(0, "event_id") == F.col("v.event_id")) & (header(1, "event_type") == F.col("v.event_type"))
    return rec.select(
        "topic", "key", F.when(agreed, header(0, "event_id")).alias("event_id"), header(1, "event_type").alias("event_type"),
        header(2, "schema_version").alias("schema_version"), at("v.occurred_at").alias("occurred_at"),
        F.col("v.data.location_id").alias("location_id"),
        F.coalesce("v.data.model.model_id", F.concat_ws("/", "v.data.source", "v.data.reference_kind")).alias("made_by"),
        F.coalesce(at("v.data.forecast_run_at"), at("v.data.period_start"), at("v.data.current.valid_at")).alias("starts_at"),
        at("v.data.period_end").alias("ends_at"), F.col("v.data.timezone").alias("timezone"),
        safe_cast(F.try_element_at(hours, F.lit(1))["valid_at"], "timestamp").alias("first_valid_at"),
        safe_cast(F.try_element_at(hours, F.lit(-1))["valid_at"], "timestamp").alias("last_valid_at"),
        F.size(hours).alias("hourly_count"), *(total(x).alias(x) for x in PAYLOAD_SUMS),
        F.size(F.filter(hours, lambda h: h["is_day"])).alias("is_day"),
        F.when(days.isNotNull(), F.size(days)).cast("bigint").alias("daily_count"), F.to_date(one["date"]).alias("daily_date"),
        *(one[d].alias(f"daily_{d}") for d in _DAILY_SUMS))


# --------------------------------------------------------------------------- streaming
def _every_topic_ok(status: dict) -> None:
    failed = {k: v for k, v in status.items() if v != "ok"}
    if failed:
        raise RuntimeError(str(failed))


def _all_logs(spark, sf_dir):
    return (_log(spark, sf_dir, "model_run_events").unionByName(_log(spark, sf_dir, "verification_weather_events"))
            .unionByName(_log(spark, sf_dir, "operational_forecast_events")))


@register("stream_ingest", [], lambda: O.with_ctes(body=f"""
select event_id, 'forecast.model_run.snapshot' as event_type, cast(1 as bigint) as schema_version, location_id,
  model_id, provider, forecast_run_at, retrieved_at, {RAW_LOG_SQL} from mr_raw"""))
def q_stream_ingest(spark, sf_dir):
    """S1 S2 S4 S5 S6 ST1 ST2: per-topic streaming cold path (availableNow) into replay-safe raw tables."""
    out = spark.read.parquet(f"{_cold_path(spark, sf_dir)}/raw/model_run_events")
    return out.drop("payload", "batch_id", "run_date")


def _cold_path(spark, sf_dir):
    from hindcast.sources.landing import build_session
    from hindcast.streaming import cold_path, io
    root = io.scratch_root(spark, "cold-path")
    io.append_log(_all_logs(spark, sf_dir), f"{root}/log", "timestamp")
    own = build_session(spark)  # one micro-batch is many tasks
    _every_topic_ok(cold_path.start_cold_path(own, lambda topic: io.log_stream(own, f"{root}/log", topic=topic), f"{root}/raw",
                                              f"{root}/checkpoints", ingested_at=cold_path.minute_after_record))
    return root


@register("stream_ingest_tables", [], lambda: O.with_ctes(body=" union all ".join(
    f"select '{table}' as raw_table, event_id, kafka_topic, kafka_partition, kafka_offset, kafka_key from {cte}"
    for table, cte in (("model_run_events", "mr_raw"), ("verification_weather_events", "vev_raw"),
                       ("operational_forecast_events", "op_raw")))))
def q_stream_ingest_tables(spark, sf_dir):
    """ST1 ST2: the log coordinates in all three raw tables that the streams have loaded."""
    root = _cold_path(spark, sf_dir)
    parts = [spark.read.parquet(f"{root}/raw/{t}").select(
        F.lit(t).alias("raw_table"), "event_id", "kafka_topic", "kafka_partition", "kafka_offset", "kafka_key")
        for t in ("model_run_events", "verification_weather_events", "operational_forecast_events")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@register("stream_latest", [f"current_{m}" for m in FLOAT_METRICS], lambda: O.with_ctes(O.latest_ctes(), body=f"""
select l.location_id, l.event_id, cast(1 as bigint) as schema_version, l.source, l.retrieved_at, l.timezone,
  f.valid_at as current_valid_at, cast(900 as bigint) as current_interval_seconds,
  {', '.join((('cast(null as double) as current_' + m) if m in CURRENT_ABSENT_SQL else ('f.' + m + ' as current_' + m)) for m in METRICS)},
  l.kafka_timestamp as updated_at
from lat l join lat_first f on l.location_id = f.location_id"""))
def q_stream_latest(spark, sf_dir):
    """ST3 ST4 ST5 streaming: latest state in the state store, its changes by micro-batch."""
    from hindcast.operators import latest as L
    from hindcast.streaming import io, state
    root = io.scratch_root(spark, "latest-state")
    io.append_log(_log(spark, sf_dir, "operational_forecast_events"), f"{root}/log", "timestamp")
    # every micro-batch commits every partition of the state: two for each core, not hundreds
    own = io.state_session(spark, spark__sql__shuffle__partitions=str(2 * spark.sparkContext.defaultParallelism))
    admitted = io.log_stream(own, f"{root}/log", io.share_of_log(spark, f"{root}/log", batches=8, least=1_000_000))
    state.run_latest_state(own, admitted, f"{root}/state", f"{root}/checkpoint")
    return L.current_table(state.current_state(spark, f"{root}/state"))


@register("stream_dedup", [], lambda: O.with_ctes(body="""
select distinct event_id, kafka_key as key, kafka_timestamp as timestamp from mr_raw"""))
def q_stream_dedup(spark, sf_dir):
    """ST8: replays removed incrementally (dropDuplicatesWithinWatermark on event_id)."""
    from hindcast.schemas import LOG_RECORD_SCHEMA  # noqa: F401
    from hindcast.streaming import dedup, io
    root = io.scratch_root(spark, "dedup")
    io.append_log(_log(spark, sf_dir, "model_run_events"), f"{root}/log", "timestamp")
    s = io.log_stream(spark, f"{root}/log").withColumn("event_id", F.get_json_object("value", "$.event_id"))
    out = dedup.dedupe_stream(s).select("event_id", "key", "timestamp")
    io.run_available_now(out.writeStream.format("parquet").option("path", f"{root}/out")
                         .option("checkpointLocation", f"{root}/checkpoint").outputMode("append"))
    return spark.read.parquet(f"{root}/out")


LATE_DELAY = "1 day"
# Rows come by the week of their retrieval.  A week's watermark is the greatest least
# hour of both sides among the weeks before it in which both have rows, less the delay.
LATE_SQL = """
arrivals as (select 'f' as side, event_id, location_id, valid_at, date_trunc('week', retrieved_at) as week from fc
  union all select 'v', event_id, location_id, valid_at, date_trunc('week', retrieved_at) from vall),
weeks as (select week, max(valid_at) filter (side = 'f') as f, max(valid_at) filter (side = 'v') as v from arrivals group by week),
marks as (select week, max(case when f is not null and v is not null then least(f, v) - interval 1 day end)
  over (order by week rows between unbounded preceding and 1 preceding) as mark from weeks),
timed as (select a.*, coalesce(a.valid_at <= m.mark, false) as late from arrivals a join marks m on a.week = m.week)"""


def _late(spark, sf_dir):
    """One run of the late join for each session and input: (folder, dropped rows)."""
    from hindcast.streaming import io, late
    key = (id(spark._jsparkSession), sf_dir)
    if key not in _LATE_RUNS:
        m = _marts(spark, sf_dir)
        root = io.scratch_root(spark, "late-verification")
        fc = m.int_model_run_hourly_forecasts.select(
            F.col("event_id").alias("forecast_event_id"), "location_id", "valid_at", "retrieved_at",
            F.col("temperature_2m").alias("forecast_temperature_2m"))
        vr = m.int_verification_hourly_weather.select(
            F.col("event_id").alias("verification_event_id"), "location_id", "valid_at", "retrieved_at", "ingested_at",
            F.col("temperature_2m").alias("reference_temperature_2m"))
        _LATE_RUNS[key] = root, late.run_by_arrival(spark, fc, vr, "retrieved_at", root, LATE_DELAY)
    return _LATE_RUNS[key]


_LATE_RUNS: dict = {}


@register("stream_late_verification", ["temperature_error"], lambda: O.with_ctes(LATE_SQL, body="""
select f.event_id as forecast_event_id, v.event_id as verification_event_id, f.location_id, f.valid_at,
  fc.temperature_2m - ({temperature}) as temperature_error
from timed f join timed t on f.side = 'f' and t.side = 'v' and f.location_id = t.location_id and f.valid_at = t.valid_at
  and not f.late and not t.late
join vall v on v.event_id = t.event_id and v.valid_at = t.valid_at
join fc on fc.event_id = f.event_id and fc.valid_at = f.valid_at
qualify row_number() over (partition by f.event_id, f.valid_at order by v.retrieved_at desc) = 1""".format(
    temperature=O.qualified(O.fx.VERIFICATION_FORMULAS["temperature_2m"], "v"))))
def q_stream_late_verification(spark, sf_dir):
    """ST7 (+W4 in batch): forecasts joined with late, re-issued verification as both arrive;
    the newest version that was in time."""
    from hindcast.operators.dedup import latest_per_key
    matches = spark.read.parquet(f"{_late(spark, sf_dir)[0]}/matches")
    best = latest_per_key(matches, ["forecast_event_id", "valid_at"],
                          ["verification_retrieved_at", "ingested_at", "verification_event_id"])
    return best.select("forecast_event_id", "verification_event_id", "location_id", "valid_at",
                       (F.col("forecast_temperature_2m") - F.col("reference_temperature_2m")).alias("temperature_error"))


@register("stream_late_drops", [], lambda: O.with_ctes(LATE_SQL, body="""
select week, count(*) filter (late) as dropped_rows from timed group by week"""))
def q_stream_late_drops(spark, sf_dir):
    """ST7: rows that the watermark refused, by the week in which they arrived."""
    told = _late(spark, sf_dir)[1]
    return spark.createDataFrame(told, "week timestamp, dropped_rows long")


@register("content_loads", [], lambda: O.with_ctes(body="""
select kafka_partition, count(*) as loaded_rows, cast(1 as bigint) as loads, cast(2 as bigint) as attached from mr_raw group by kafka_partition"""))
def q_content_loads(spark, sf_dir):
    """Each partition's rows loaded three times, in other orders and with other load
    times: one load, two re-attached."""
    from hindcast.sources.sinks import finished_loads, load_once
    from hindcast.streaming.io import scratch_root
    root = scratch_root(spark, "content-loads")
    # every try reads its partition's mapped rows: they are made once, and kept by partition
    _raw_model_runs(spark, sf_dir).write.option("compression", "zstd").partitionBy("kafka_partition").parquet(f"{root}/mapped")
    rows = spark.read.parquet(f"{root}/mapped").withColumn("kafka_partition", F.col("kafka_partition").cast("bigint"))
    told = []
    for p in (0, 1, 2):
        mine = rows.where(F.col("kafka_partition") == p)
        tries = [load_once(x, f"{root}/table", f"{root}/ledger", "model-run") for x in (
            mine, mine.repartition("kafka_offset").withColumn("ingested_at", F.current_timestamp()),
            mine.sortWithinPartitions(F.desc("event_id")))]
        told += [(p, *t) for t in tries]
    tries = spark.createDataFrame(told, "kafka_partition long, load_id string, written boolean")
    table = spark.read.parquet(f"{root}/table").groupBy("load_id").agg(F.count(F.lit(1)).alias("loaded_rows"))
    known = finished_loads(spark, f"{root}/ledger").groupBy("load_id").agg(F.count(F.lit(1)).alias("loads"))
    seen = tries.groupBy("kafka_partition", "load_id").agg(F.count_if(~F.col("written")).alias("attached"))
    return seen.join(table, "load_id").join(known, "load_id").drop("load_id")


# --------------------------------------------------------------------------- scans and views
@register("raw_scan_by_date", [], lambda: O.with_ctes(body="""
select event_id, location_id, model_id, forecast_run_at, kafka_offset from mr_raw
where cast(forecast_run_at as date) between date '2024-01-08' and date '2024-01-14'"""))
def q_raw_scan_by_date(spark, sf_dir):
    """One week of the date-partitioned raw table (directory pruning on run_date)."""
    from hindcast.sources.landing import read_landed
    raw = read_landed(spark, sf_dir, "model_run_events", keep_date=True)
    week = raw.filter(F.col("run_date").between(F.lit("2024-01-08").cast("date"), F.lit("2024-01-14").cast("date")))
    return week.select("event_id", "location_id", "model_id", "forecast_run_at", "kafka_offset")


@register("mart_views", ["mean_temperature_mae"], lambda: O.with_ctes(O.accuracy_sql(), body=f"""
select model_id, lead_time_bucket, sum(matched_hour_count) as matched_hours,
  count(distinct location_id) as locations, avg(temperature_mae) as mean_temperature_mae
from ({O.agg_sql()}) a group by model_id, lead_time_bucket"""))
def q_mart_views(spark, sf_dir):
    """Every model registered as a temp view; SQL over the accuracy rollup view."""
    m = _marts(spark, sf_dir)
    prefix = f"v{zlib.crc32(sf_dir.encode())}_"
    m.register_views(prefix)
    return spark.sql(f"""
        select model_id, lead_time_bucket, sum(matched_hour_count) as matched_hours,
               count(distinct location_id) as locations, avg(temperature_mae) as mean_temperature_mae
        from {prefix}agg_model_accuracy group by model_id, lead_time_bucket""")


from hindcast import registry_checks  # noqa: E402,F401  registers its queries here
