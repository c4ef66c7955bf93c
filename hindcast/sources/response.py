"""Provider responses (struct of parallel arrays, local wall time) -> typed rows
(S8, F9, F11, F17-F19).

A landed response is parsed once with a typed schema.  Rules are evaluated per
response into ``violations`` (any violation rejects the whole response, like the
reference's mapper error); valid responses are pivoted column->row with
``inline(arrays_zip(...))``.  Absent optional series are replaced by an array of
NULLs of the right length first, because ``arrays_zip`` with a NULL input is NULL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hindcast.functions.time import is_iso_date, wall_time_to_utc, with_valid_zone
from hindcast.schemas import CURRENT_METRICS, METRICS, VERIFICATION_SERIES

# Provider series types (is_day arrives as 0/1).
_SERIES_TYPE = {m: ("bigint" if m in ("weather_code", "is_day") else "double") for m in METRICS}
DAILY_SERIES = ["weather_code", "temperature_2m_max", "temperature_2m_min", "apparent_temperature_max",
                "apparent_temperature_min", "precipitation_sum", "precipitation_probability_max",
                "precipitation_hours", "wind_speed_10m_max", "wind_gusts_10m_max", "wind_direction_10m_dominant",
                "sunrise", "sunset", "daylight_duration_seconds", "uv_index_max"]
_DAILY_TYPE = {d: ("bigint" if d == "weather_code" else "string" if d in ("sunrise", "sunset") else "double")
               for d in DAILY_SERIES}

# Fixed value: the one daily series that the provider names otherwise.
_PROVIDER_KEY = {"daylight_duration_seconds": "daylight_duration"}


def _daily_key(series: str) -> str:
    return _PROVIDER_KEY.get(series, series)


RESPONSE_SCHEMA = (
    "struct<timezone string, "
    "current struct<time string, `interval` bigint, "
    + ", ".join(f"`{m}` {_SERIES_TYPE[m]}" for m in CURRENT_METRICS) + ">, "
    "hourly struct<time array<string>, "
    + ", ".join(f"`{m}` array<{_SERIES_TYPE[m]}>" for m in METRICS) + ">, "
    "daily struct<time array<string>, "
    + ", ".join(f"`{_daily_key(d)}` array<{_DAILY_TYPE[d]}>" for d in DAILY_SERIES) + ">>"
)

LOCAL_MINUTE = "yyyy-MM-dd'T'HH:mm"


def parse_responses(responses: DataFrame, body_col: str = "body") -> DataFrame:
    """Landed response text -> typed struct ``r`` (plus a valid-zone flag)."""
    r = responses.withColumn("r", F.from_json(F.col(body_col), RESPONSE_SCHEMA))
    r = r.withColumn("timezone", F.col("r.timezone"))
    return with_valid_zone(r, "timezone", flag="zone_ok")


def hourly_violations(optional: list[str], series: list[str] = METRICS) -> Column:
    """F18 + F17: non-empty times, every present series as long as the times,
    required ones of ``series`` present, ``is_day`` in {0, 1, NULL}, times parseable."""
    n = F.size(F.coalesce(F.col("r.hourly.time"), F.array()))
    checks = [(n < 1, F.lit("empty_hourly_time")), (~F.col("zone_ok"), F.lit("unknown_timezone"))]
    for m in series:
        s = F.col(f"r.hourly.{m}")
        if m not in optional:
            checks.append((s.isNull(), F.lit(f"missing_series:{m}")))
        checks.append((s.isNotNull() & (F.size(s) != n), F.lit(f"series_length:{m}")))
    checks.append((F.exists(F.coalesce(F.col("r.hourly.is_day"), F.array()),
                            lambda x: x.isNotNull() & ~x.isin(0, 1)), F.lit("invalid_is_day")))
    checks.append((F.exists(F.coalesce(F.col("r.hourly.time"), F.array()),
                            lambda t: F.try_to_timestamp(t, F.lit(LOCAL_MINUTE)).isNull()), F.lit("invalid_time")))
    return F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), code) for c, code in checks]))


def daily_violations() -> Column:
    """F11 + F18 for the daily block: at least one date (an absent block has none), ISO
    dates, every series present and as long as the dates, times of sunrise and sunset
    that can be read."""
    dates = F.coalesce(F.col("r.daily.time"), F.array())
    n = F.size(dates)
    checks = [(n < 1, F.lit("empty_daily_time")), (F.exists(dates, lambda d: d.isNull() | ~is_iso_date(d)), F.lit("invalid_daily_date"))]
    for d in DAILY_SERIES:
        s = F.col(f"r.daily.{_daily_key(d)}")
        checks += [((n > 0) & s.isNull(), F.lit(f"missing_daily_series:{d}")),
                   (s.isNotNull() & (F.size(s) != n), F.lit(f"daily_series_length:{d}"))]
        if d in ("sunrise", "sunset"):
            checks.append((F.exists(s, _unreadable), F.lit(f"invalid_daily_time:{d}")))
    return F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), code) for c, code in checks]))


def _unreadable(time: Column) -> Column:
    return time.isNotNull() & F.try_to_timestamp(time, F.lit(LOCAL_MINUTE)).isNull()


def current_violations() -> Column:
    """F17 + F19 for the current block, where a response has one: a time that can be read, ``is_day`` in {0, 1, NULL}."""
    time, is_day = F.col("r.current.time"), F.col("r.current.is_day")
    checks = [(F.col("r.current").isNotNull() & (time.isNull() | _unreadable(time)), F.lit("invalid_current_time")),
              (is_day.isNotNull() & ~is_day.isin(0, 1), F.lit("invalid_current_is_day"))]
    return F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), code) for c, code in checks]))


def with_violations(parsed: DataFrame, optional: list[str]) -> DataFrame:
    return parsed.withColumn("violations", F.concat(hourly_violations(optional), daily_violations(), current_violations()))


def verification_violations() -> Column:
    """F18 for reanalysis responses: hours alone, of 13 series, all required, at times
    that strictly increase (P8)."""
    times = F.transform(F.coalesce(F.col("r.hourly.time"), F.array()), lambda t: F.try_to_timestamp(t, F.lit(LOCAL_MINUTE)))
    unordered = F.exists(F.transform(times, lambda t, i: F.when(i > 0, F.get(times, i - 1)) >= t), lambda x: F.coalesce(x, F.lit(False)))
    return F.concat(hourly_violations([], VERIFICATION_SERIES),
                    F.array_compact(F.array(F.when(unordered, F.lit("unordered_hourly_time")))))


def verification_rows(valid: DataFrame, keep: list[str]) -> DataFrame:
    """Reanalysis hours: the 13 series, and NULL for the metrics that reanalysis lacks."""
    return hourly_rows(valid, keep)


def _filled(col: str, n: Column, sql_type: str) -> Column:
    """A present series, or NULLs of the right length when it is absent."""
    return F.coalesce(F.col(col), F.array_repeat(F.lit(None).cast(sql_type), n))


def hourly_rows(valid: DataFrame, keep: list[str], run_at: Column | None = None) -> DataFrame:
    """F18 + F9 + F17: one row per time step with UTC ``valid_at``; with
    ``run_at`` also ``lead_time_hours`` (whole hours from the run)."""
    n = F.size("r.hourly.time")
    zipped = F.arrays_zip(F.col("r.hourly.time").alias("time"),
                          *[_filled(f"r.hourly.{m}", n, _SERIES_TYPE[m]).alias(m) for m in METRICS])
    extra = [run_at.alias("__run")] if run_at is not None else []
    rows = valid.select(*keep, "timezone", *extra, F.inline(zipped))
    rows = rows.withColumn("valid_at", wall_time_to_utc("time", "timezone", LOCAL_MINUTE))
    cols = [F.col(c) for c in keep] + [F.col("valid_at")]
    if run_at is not None:
        cols.append(F.timestamp_diff("HOUR", F.col("__run"), F.col("valid_at")).alias("lead_time_hours"))
    metrics = [F.when(F.col(m) == 1, True).when(F.col(m) == 0, False).alias(m) if m == "is_day" else F.col(m)
               for m in METRICS]
    return rows.select(*cols, *metrics)


def daily_rows(valid: DataFrame, keep: list[str]) -> DataFrame:
    """Daily block -> rows: DateType date, UTC sunrise/sunset."""
    n = F.size("r.daily.time")
    zipped = F.arrays_zip(F.col("r.daily.time").alias("date"),
                          *[_filled(f"r.daily.{_daily_key(d)}", n, _DAILY_TYPE[d]).alias(d) for d in DAILY_SERIES])
    rows = valid.select(*keep, "timezone", F.inline(zipped))
    out = []
    for d in DAILY_SERIES:
        if d in ("sunrise", "sunset"):
            out.append(wall_time_to_utc(d, "timezone", LOCAL_MINUTE).alias(d))
        else:
            out.append(F.col(d))
    return rows.select(*keep, F.to_date(F.try_to_timestamp("date", F.lit("yyyy-MM-dd"))).alias("forecast_date"), *out)


def current_row(valid: DataFrame, keep: list[str]) -> DataFrame:
    """current conditions, 14 metrics (probability, visibility, UV absent)."""
    return valid.select(
        *keep,
        wall_time_to_utc(F.col("r.current.time"), F.col("timezone"), LOCAL_MINUTE).alias("valid_at"),
        F.col("r.current.interval").alias("interval_seconds"),
        *[(F.when(F.col("r.current.is_day") == 1, True).when(F.col("r.current.is_day") == 0, False)
           if m == "is_day" else F.col(f"r.current.{m}")).alias(m) for m in CURRENT_METRICS],
    )
