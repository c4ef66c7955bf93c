"""Arithmetic that turns the driver's ``events`` rows into weather values.

The driver tables are generic (users, event types, values).  The bridge maps
them onto the forecast data model with the SQL expressions below.  Each one
is plain ANSI SQL over the columns

* ``e``  the source event id (bigint), ``x`` its value (double), ``k`` the
  integer in its ``props`` JSON,
* ``s``  the variant index: forecast run offset ``j`` (0..2) or verification
  version ``v`` (1..3),
* ``h``  the UTC hour of ``valid_at`` (0..23),

so the same text runs in Spark (``F.expr``) and in the DuckDB oracle.
"""

from __future__ import annotations

# Literals are written in exponent form (``5e-1``) so both engines type them
# DOUBLE; plain ``0.5`` is a DECIMAL in Spark and DuckDB and would change the
# rounding of the results.
# Forecast metric formulas (model runs and operational snapshots).
FORECAST_FORMULAS = {
    "temperature_2m": "x / 10e0 + cast((e + s) % 7 - 3 as double) * 5e-1",
    "apparent_temperature": "x / 10e0 + cast((e + s) % 5 - 1 as double)",
    "relative_humidity_2m": "cast((k + 3 * s) % 101 as double)",
    "precipitation": "greatest(0e0, cast(k - 50 + 5 * s as double) / 10e0)",
    "precipitation_probability": "case when e % 13 = 0 then cast(null as double) else cast((k + 7 * s) % 101 as double) end",
    "rain": "greatest(0e0, cast(k - 50 + 5 * s as double) / 10e0) * 5e-1",
    "showers": "greatest(0e0, cast(k - 50 + 5 * s as double) / 10e0) * 25e-2",
    "snowfall": "case when h < 6 then greatest(0e0, cast(k - 50 + 5 * s as double) / 10e0) * 1e-1 else 0e0 end",
    "weather_code": "case when e % 17 = 0 then cast(null as bigint) else cast((e + s) % 4 as bigint) end",
    "cloud_cover": "cast((e * 7 + s * 11) % 101 as double)",
    "pressure_msl": "1000e0 + cast(e % 40 as double) + cast(s as double) * 5e-1",
    "visibility": "case when e % 11 = 0 then cast(null as double) else 10000e0 + cast(k * 100 - s * 50 as double) end",
    "wind_speed_10m": "x / 20e0 + cast(s as double)",
    "wind_direction_10m": "cast((e * 37 + s * 20) % 360 as double)",
    "wind_gusts_10m": "x / 15e0 + cast(2 * s as double)",
    "uv_index": "case when e % 11 = 0 then cast(null as double) else cast(k % 12 as double) end",
    "is_day": "case when e % 19 = 0 then cast(null as boolean) else (h >= 6 and h < 18) end",
}

# Verification (reanalysis) formulas; the four metrics a
# reanalysis response does not carry are NULL.
VERIFICATION_FORMULAS = {
    "temperature_2m": "x / 10e0 + cast(s as double) * 1e-1",
    "apparent_temperature": "x / 10e0 + cast(s as double) * 2e-1 - 5e-1",
    "relative_humidity_2m": "cast((k + 2 * s) % 101 as double)",
    "precipitation": "greatest(0e0, cast(k - 50 + s as double) / 10e0)",
    "precipitation_probability": "cast(null as double)",
    "rain": "greatest(0e0, cast(k - 50 + s as double) / 10e0) * 5e-1",
    "showers": "cast(null as double)",
    "snowfall": "case when h < 6 then greatest(0e0, cast(k - 50 + s as double) / 10e0) * 1e-1 else 0e0 end",
    "weather_code": "case when e % 23 = 0 then cast(null as bigint) else cast((e + s) % 4 as bigint) end",
    "cloud_cover": "cast((e * 5 + s) % 101 as double)",
    "pressure_msl": "1000e0 + cast(e % 40 as double) + cast(s as double) * 25e-2",
    "visibility": "cast(null as double)",
    "wind_speed_10m": "x / 18e0 + cast(s as double) * 5e-1",
    "wind_direction_10m": "cast((e * 41 + s * 7) % 360 as double)",
    "wind_gusts_10m": "x / 14e0 + cast(s as double)",
    "uv_index": "cast(null as double)",
    "is_day": "(h >= 6 and h < 18)",
}

# Time zone per driver region (r_name), and the model attributes
# derived from the driver's event_type (which plays the forecast model).
REGION_TIMEZONES = {
    "AFRICA": "Africa/Johannesburg",
    "AMERICA": "America/New_York",
    "ASIA": "Asia/Jakarta",
    "EUROPE": "Europe/Berlin",
    "MIDDLE EAST": "Asia/Dubai",
}
MODEL_NAME_SQL = "concat(upper(model_id), ' Global')"
PROVIDER_SQL = "concat('provider-', model_id)"
RESOLUTION_SQL = "cast(length(model_id) as double) * 15e-1"

# Sources named in the synthetic events.
OPERATIONAL_SOURCE = "best_match"
VERIFICATION_SOURCE = "reanalysis_archive"

# Number of earlier runs (one day apart) that forecast each hour.
RUN_OFFSETS = 3
# Hours of the verification lag: a version v is retrieved (7 + v) days after its day.
VERIFICATION_LAG_DAYS = 7


def timezone_case(col: str = "r_name") -> str:
    whens = " ".join(f"when '{r}' then '{z}'" for r, z in REGION_TIMEZONES.items())
    return f"case {col} {whens} else 'UTC' end"
