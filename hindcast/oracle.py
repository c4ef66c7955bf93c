"""DuckDB reference SQL for the correctness check.

Each query recomputes a model straight from the driver tables (``events``,
``customer``, ``nation``, ``region``) with plain SQL: no JSON payloads, no
de-duplication of replays, no version ranking - those are what the Spark side
exercises.  The bridge arithmetic (``hindcast.sources.formulas``) is shared so
both sides start from the same weather values.
"""

from __future__ import annotations

import re

from hindcast.plans.damage import Damage, damaged_sql
from hindcast.schemas import METRICS, VERIFICATION_SERIES  # noqa: F401
from hindcast.sources import formulas as fx


def _metric_select(formulas: dict[str, str]) -> str:
    return ",\n    ".join(f"{formulas[m]} as {m}" for m in METRICS)


def qualified(formula: str, table: str) -> str:
    """A formula whose one-letter variables are columns of ``table``."""
    return re.sub(r"(?<![\w.])([exksh])(?![\w(])", rf"{table}.\1", formula)


def _rfc(col: str) -> str:
    # Instants here are whole seconds, so RFC 3339 has no fraction.
    return f"strftime({col}, '%Y-%m-%dT%H:%M:%SZ')"


def _sha(*parts: str) -> str:
    return "sha256(concat_ws('|', " + ", ".join(parts) + "))"


BUCKET = ("case when lead_time_hours <= 6 then '00-06h' when lead_time_hours <= 24 then '07-24h' "
          "when lead_time_hours <= 72 then '25-72h' else '73h+' end")


def ctes() -> str:
    """Common table expressions shared by the oracle queries."""
    tz = fx.timezone_case("r.r_name")
    return f"""
loc as (
  select c.c_custkey + 1 as location_id,
    c.c_custkey + 1000000 as open_meteo_location_id,
    c.c_name as city,
    case when c.c_custkey % 5 in (0, 1) then null else c.c_mktsegment end as administrative_area,
    n.n_name as country,
    chr(65 + n.n_nationkey) || chr(65 + (n.n_nationkey * 7) % 26) as country_code,
    cast(c.c_custkey % 180 as double) - 89.5e0 as latitude,
    cast((c.c_custkey * 7) % 360 as double) - 179.75e0 as longitude,
    {tz} as timezone,
    case when c.c_custkey % 10 = 0 then null else c.c_acctbal / 10e0 end as elevation,
    case when c.c_custkey % 7 = 0 then null else c.c_custkey * 1000 end as population,
    timestamp '2023-12-01 00:00:00' as source_created_at,
    timestamp '2023-12-15 00:00:00' + cast(c.c_custkey % 30 as integer) * interval 1 day as source_updated_at,
    timestamp '2024-01-01 00:00:00' as synced_at
  from customer c join nation n on c.c_nationkey = n.n_nationkey
  join region r on n.n_regionkey = r.r_regionkey
),
ev as (
  select event_id as e, user_id + 1 as location_id, event_type as model_id,
         date_trunc('hour', ts) as valid_at, value as x,
         cast(json_extract_string(props, '$.k') as bigint) as k
  from events
),
base as (
  select location_id, model_id, valid_at, min(e) as e, max(x) as x, max(k) as k from ev
  group by location_id, model_id, valid_at
),
fh as (
  select *, hour(valid_at) as h,
         date_trunc('week', valid_at) - s * interval 1 day as forecast_run_at
  from (select *, unnest([0, 1, 2]) as s from base)
),
fc as (
  select
    {_sha(fx.PROVIDER_SQL, 'model_id', 'cast(location_id as varchar)', _rfc('forecast_run_at'))} as event_id,
    location_id, model_id,
    {fx.MODEL_NAME_SQL} as model_name,
    {fx.PROVIDER_SQL} as provider,
    {fx.RESOLUTION_SQL} as resolution_km,
    forecast_run_at,
    forecast_run_at + interval 30 minute as retrieved_at,
    valid_at,
    cast(valid_at as date) as forecast_date_utc,
    datesub('hour', forecast_run_at, valid_at) as lead_time_hours,
    forecast_run_at + interval 31 minute
      + case when location_id % 7 = 0 then interval 1 hour else interval 0 hour end as ingested_at,
    {_metric_select(fx.FORECAST_FORMULAS)}
  from fh
),
vev as (
  select event_id as e, user_id + 1 as location_id, date_trunc('hour', ts) as valid_at, value as x,
         cast(json_extract_string(props, '$.k') as bigint) as k
  from events where date_trunc('hour', ts) <= (select max(ts) from events) - interval {fx.VERIFICATION_LAG_DAYS} day
),
vbase as (
  select location_id, valid_at, min(e) as e, max(x) as x, max(k) as k from vev group by location_id, valid_at
),
vver as (
  select *, hour(valid_at) as h, date_trunc('day', valid_at) as day
  from (select *, unnest(range(1, e % 3 + 2)) as s from vbase)
),
vday as (
  select location_id, day, s, min(valid_at) as period_start, max(valid_at) as period_end
  from vver group by location_id, day, s
),
vall as (
  select
    {_sha(f"'{fx.VERIFICATION_SOURCE}'", "'reanalysis'", 'cast(v.location_id as varchar)',
          _rfc(f'v.day + (7 + v.s) * interval 1 day'), _rfc('d.period_start'), _rfc('d.period_end'))} as event_id,
    v.*, d.period_start, d.period_end,
    v.day + (7 + v.s) * interval 1 day as retrieved_at,
    v.day + (7 + v.s) * interval 1 day + interval 1 minute as ingested_at,
    e % 3 + 1 as verification_version_count
  from vver v join vday d on v.location_id = d.location_id and v.day = d.day and v.s = d.s
),
vc as (
  select event_id, location_id, valid_at, cast(valid_at as date) as verification_date_utc,
    '{fx.VERIFICATION_SOURCE}' as source, 'reanalysis' as reference_kind, retrieved_at,
    period_start, period_end, ingested_at, verification_version_count,
    {_metric_select(fx.VERIFICATION_FORMULAS)}
  from vall where s = e % 3 + 1
),
runs as (
  select event_id, location_id, model_id, model_name, provider, resolution_km, forecast_run_at, retrieved_at,
    count(*) as hour_count, min(valid_at) as first_valid_at, max(valid_at) as last_valid_at
  from fc group by all
),
mr_raw as (
  select r.*, c.copy,
    'forecast.runs' as kafka_topic, location_id % 3 as kafka_partition,
    cast(epoch(forecast_run_at) / 3600 as bigint) * 1000000000 + location_id * 10
      + case model_id when 'click' then 0 when 'view' then 1 when 'purchase' then 2 when 'signup' then 3 else 4 end
      + 5 * c.copy as kafka_offset,
    cast(location_id as varchar) || ':' || model_id as kafka_key,
    retrieved_at as kafka_timestamp,
    retrieved_at + interval 1 minute + c.copy * interval 1 hour as ingested_at
  from runs r join (select unnest([0, 1]) as copy) c on c.copy = 0 or r.location_id % 7 = 0
),
vev_raw as (
  select event_id, location_id, day, s, period_start, period_end, retrieved_at, ingested_at,
    'weather.verification' as kafka_topic, location_id % 3 as kafka_partition,
    cast(epoch(day) / 86400 as bigint) * 10000000 + location_id * 10 + s as kafka_offset,
    cast(location_id as varchar) as kafka_key, retrieved_at as kafka_timestamp
  from vall group by all
),
oh as (
  select *, hour(valid_at) as h, 0 as s, date_trunc('day', valid_at) as day
  from (select location_id, valid_at, min(e) as e, max(x) as x, max(k) as k from ev group by location_id, valid_at)
),
ohm as (
  select location_id, day, valid_at, e, {_metric_select(fx.FORECAST_FORMULAS)} from oh
),
op_raw as (
  select {_sha(f"'{fx.OPERATIONAL_SOURCE}'", 'cast(o.location_id as varchar)', _rfc('o.day + interval 6 hour'))} as event_id,
    o.location_id, o.day, '{fx.OPERATIONAL_SOURCE}' as source, o.day + interval 6 hour as retrieved_at,
    l.timezone, 'forecast.latest' as kafka_topic, o.location_id % 3 as kafka_partition,
    cast(epoch(o.day) / 86400 as bigint) * 10000000 + o.location_id as kafka_offset,
    cast(o.location_id as varchar) as kafka_key, o.day + interval 6 hour as kafka_timestamp,
    o.day + interval 6 hour + interval 1 minute as ingested_at
  from (select distinct location_id, day from ohm) o left join loc l on o.location_id = l.location_id
)
"""


# Fixed value: millimetres from which precipitation counts as having occurred.
OCCURRED_MM = 0.1

# Error columns of the matched hours, by their name's first part.
ERRORS = {
    "temperature": ("temperature_2m", ["error", "absolute_error", "squared_error"]),
    "apparent_temperature": ("apparent_temperature", ["error", "absolute_error"]),
    "relative_humidity": ("relative_humidity_2m", ["error", "absolute_error"]),
    "precipitation": ("precipitation", ["error", "absolute_error", "squared_error"]),
} | {v: (v, ["error", "absolute_error"]) for v in (
    "rain", "snowfall", "cloud_cover", "pressure_msl", "visibility", "wind_speed_10m", "wind_gusts_10m", "uv_index")}

# Columns of the rollup, by their name's first part.
SUMMARIES = {
    "temperature": ("temperature_2m", ["sample_count", "mean_error", "mae", "rmse"]),
    "apparent_temperature": ("apparent_temperature", ["mae"]),
    "relative_humidity": ("relative_humidity_2m", ["mean_error", "mae"]),
    "precipitation": ("precipitation", ["sample_count", "mean_error", "mae", "rmse"]),
} | {v: (v, ["mae"]) for v in (
    "rain", "snowfall", "cloud_cover", "pressure_msl", "visibility", "wind_speed_10m", "wind_gusts_10m", "uv_index")}


def accuracy_sql() -> str:
    """fct_model_forecast_accuracy from fc x vc."""
    pairs = ["temperature_2m", "apparent_temperature", "relative_humidity_2m", "precipitation",
             "rain", "snowfall", "weather_code", "cloud_cover", "pressure_msl", "visibility",
             "wind_speed_10m", "wind_direction_10m", "wind_gusts_10m", "uv_index", "is_day"]
    cols = ["f.event_id as forecast_event_id", "v.event_id as verification_event_id",
            "f.location_id", "f.model_id", "f.model_name", "f.provider", "f.resolution_km",
            "f.forecast_run_at", "f.retrieved_at as forecast_retrieved_at", "f.valid_at",
            "f.forecast_date_utc", "f.lead_time_hours", f"{BUCKET.replace('lead_time_hours', 'f.lead_time_hours')} as lead_time_bucket",
            "v.source as verification_source", "v.reference_kind",
            "v.retrieved_at as verification_retrieved_at", "v.verification_version_count"]
    for p in pairs:
        cols.append(f"f.{p} as forecast_{p}")
        cols.append(f"v.{p} as reference_{p}")
        if p == "precipitation":
            cols.append("f.precipitation_probability as forecast_precipitation_probability")
    cols += ["f.ingested_at as forecast_ingested_at", "v.ingested_at as verification_ingested_at"]

    diff = {p: f"(forecast_{p} - reference_{p})" for p in pairs}
    direction = "180 - abs(180 - abs(forecast_wind_direction_10m - reference_wind_direction_10m))"
    occurred = f"(reference_precipitation >= {OCCURRED_MM})"
    errs = []
    for column, (variable, kinds) in ERRORS.items():
        made = {"error": diff[variable], "absolute_error": f"abs({diff[variable]})", "squared_error": f"{diff[variable]} ** 2"}
        errs += [f"{made[k]} as {column}_{k}" for k in kinds]
    errs += [f"{direction} as wind_direction_10m_absolute_error",
             "reference_weather_code = forecast_weather_code as weather_code_exact_match",
             "reference_is_day = forecast_is_day as day_night_match",
             f"{occurred} as precipitation_occurred",
             f"(forecast_precipitation_probability / 100.0 - cast({occurred} as integer)) ** 2 as precipitation_probability_brier_score"]
    matched = ("select " + ",\n  ".join(cols) + "\nfrom fc f join vc v on f.location_id = v.location_id "
               "and f.valid_at = v.valid_at")
    return f"acc as (select *, {', '.join(errs)} from ({matched}) m)"


def agg_sql() -> str:
    """The rollup from its definitions, on the matched values themselves: mean of
    f - r, mean of |f - r| and root of the mean of (f - r)^2 for each variable; a match
    rate is the mean of 0 and 1; the Brier score that of (p - occurred)^2."""
    formula = {"mean_error": "avg({f} - {r})", "mae": "avg(abs({f} - {r}))", "rmse": "sqrt(avg(({f} - {r}) ** 2))",
               "sample_count": "count({f} + {r})"}
    columns = []
    for label, (variable, kinds) in SUMMARIES.items():
        f, r = f"forecast_{variable}", f"reference_{variable}"
        columns += [f"{formula[k].format(f=f, r=r)} as {label}_{k}" for k in kinds]
    for flag, variable in (("weather_code_exact_match", "weather_code"), ("day_night_match", "is_day")):
        columns.append(f"avg(cast(forecast_{variable} = reference_{variable} as integer)) as {flag}_rate")
    columns += [
        "avg(180 - abs(180 - abs(forecast_wind_direction_10m - reference_wind_direction_10m))) as wind_direction_10m_mae",
        f"avg((forecast_precipitation_probability / 100.0 - cast(reference_precipitation >= {OCCURRED_MM} as integer)) ** 2)"
        " as precipitation_probability_brier_score",
        "count(*) as matched_hour_count"]
    columns += [f"count(distinct {k}_event_id) as {n}_count" for k, n in (("forecast", "forecast_run"), ("verification", "verification_event"))]
    columns += [f"{edge}({c}) as {name}_{c}" for c in ("forecast_run_at", "valid_at") for edge, name in (("min", "first"), ("max", "latest"))]
    columns.append("max(verification_retrieved_at) as latest_verification_retrieved_at")
    place = [f"l.{c}" for c in ("city", "administrative_area", "country", "country_code", "timezone")]
    keys = [*(f"a.{c}" for c in ("location_id", "model_id", "model_name", "provider", "resolution_km", "lead_time_bucket")), *place]
    return (f"\nselect {', '.join(keys)},\n  " + ",\n  ".join(columns)
            + "\nfrom acc a join loc l using (location_id)\ngroup by " + ", ".join(keys))


def with_ctes(*extra: str, body: str) -> str:
    parts = [ctes().strip()] + [x.strip() for x in extra]
    return "with " + ",\n".join(parts) + "\n" + body.strip()


def model_ctes() -> str:
    """One CTE per warehouse model name (``m_<model>``) over the oracle tables."""
    metrics = ", ".join(METRICS)
    return f"""
m_stg_locations as (select * from loc),
m_dim_locations as (select * from loc),
m_stg_operational_forecast_events as (
  select event_id, location_id, retrieved_at, timezone as forecast_timezone from op_raw),
m_stg_model_run_events as (select event_id, location_id, model_id, forecast_run_at from runs),
m_stg_verification_weather_events as (
  select v.event_id, v.location_id, 'reanalysis' as reference_kind, v.period_start, v.period_end, v.retrieved_at,
    l.timezone as verification_timezone
  from vev_raw v left join loc l on v.location_id = l.location_id),
m_int_operational_hourly_forecasts as (
  select r.event_id, r.location_id, h.valid_at from op_raw r join ohm h on r.location_id = h.location_id and r.day = h.day),
m_fct_operational_hourly_forecasts as (select * from m_int_operational_hourly_forecasts),
m_int_model_run_hourly_forecasts as (select * from fc),
m_fct_model_forecasts as (select * from fc),
m_fct_forecast_revisions as (select * from fc),
m_int_verification_hourly_weather as (select event_id, location_id, 'reanalysis' as reference_kind, valid_at from vall),
m_dim_forecast_models as (
  select model_id, any_value(provider) as provider, min(forecast_run_at) as first_forecast_run_at,
    max(forecast_run_at) as latest_forecast_run_at from runs group by model_id),
m_fct_verification_weather as (select *, {metrics.split(',')[0]} as _m from vc),
m_fct_model_forecast_accuracy as (select * from acc),
m_agg_model_accuracy as ({agg_sql()})"""


def check_sql(c, prefix: str = "m_") -> str:
    """One check over the CTEs ``<prefix><table>``."""
    head = f"select '{c.check_name}' as check_name, '{c.table}' as table_name"
    t = f"{prefix}{c.table}"
    if c.kind == "not_null":
        return f"{head}, '{c.column}' as column_name, count(*) filter (where {c.column} is null) as failing_rows from {t}"
    if c.kind == "expression":
        return f"{head}, '' as column_name, count(*) filter (where {c.condition}) as failing_rows from {t}"
    if c.kind == "unique":
        return (f"{head}, '{c.column}' as column_name, count(*) as failing_rows from "
                f"(select {c.column} from {t} where {c.column} is not null group by {c.column} having count(*) > 1)")
    if c.kind == "grain":
        keys = ", ".join(c.keys)
        return (f"{head}, '{','.join(c.keys)}' as column_name, count(*) as failing_rows from "
                f"(select {keys} from {t} group by {keys} having count(*) > 1)")
    if c.kind == "relationships":
        return (f"{head}, '{c.column}' as column_name, count(*) as failing_rows from {t} x "
                f"where x.{c.column} is not null and not exists "
                f"(select 1 from {prefix}{c.to_table} p where p.{c.to_column} = x.{c.column})")
    if c.kind == "accepted_values":
        vals = ", ".join(f"'{v}'" for v in c.values)
        return (f"{head}, '{c.column}' as column_name, count(*) as failing_rows from "
                f"(select {c.column} from {t} where {c.column} is not null and {c.column} not in ({vals}) "
                f"group by {c.column})")
    raise ValueError(c.kind)


def quality_report_sql(checks) -> str:
    body = "\nunion all\n".join(check_sql(c) for c in checks)
    return with_ctes(accuracy_sql(), model_ctes(), body=body)


def damaged_report_sql(checks, damage, *ctes: str) -> str:
    """The report over ``ctes`` (``m_<table>``) after their damage (``d_<table>``)."""
    tables = dict.fromkeys(t for c in checks for t in (c.table, c.to_table) if t)
    spoiled = ",\n".join(f"d_{t} as ({damaged_sql(f'm_{t}', damage.get(t, Damage()))})" for t in tables)
    return with_ctes(*ctes, spoiled, body="\nunion all\n".join(check_sql(c, "d_") for c in checks))


def latest_ctes() -> str:
    """Latest snapshot per location (newest day) and its hours."""
    return """
lat as (select * from op_raw qualify row_number() over (partition by location_id order by retrieved_at desc) = 1),
lat_hours as (select h.* from ohm h join lat l on h.location_id = l.location_id and h.day = l.day),
lat_first as (select * from lat_hours qualify row_number() over (partition by location_id order by valid_at) = 1),
lat_daily as (
  select location_id, day, strftime(day, '%Y-%m-%d') as date, max(weather_code) as weather_code,
    max(temperature_2m) as temperature_2m_max, min(temperature_2m) as temperature_2m_min,
    max(apparent_temperature) as apparent_temperature_max, min(apparent_temperature) as apparent_temperature_min,
    sum(precipitation) as precipitation_sum, max(precipitation_probability) as precipitation_probability_max,
    cast(count(*) filter (where precipitation > 0) as double) as precipitation_hours,
    max(wind_speed_10m) as wind_speed_10m_max, max(wind_gusts_10m) as wind_gusts_10m_max,
    cast(null as double) as wind_direction_10m_dominant,
    case when location_id % 4 <> 0 then day + interval 5 hour + interval 45 minute end as sunrise,
    case when location_id % 4 <> 0 then day + interval 18 hour end as sunset,
    case when location_id % 4 <> 0 then 44100e0 end as daylight_duration_seconds,
    cast(null as double) as uv_index_max
  from lat_hours group by location_id, day)"""
