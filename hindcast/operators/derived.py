"""Derived display values over latest snapshots.

The reference computes these in the app for one forecast; here they are
column expressions over the latest-snapshot table (one row per location with
its ``current`` struct and ordered ``hourly``/``daily`` arrays), so they run
row-wise with array functions: no shuffle, no join, nothing gathered.  ``now``
is always a parameter (a Column), never the wall clock.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hindcast.functions.time import try_date, with_valid_zone

# WMO weather codes -> condition and label.
CONDITIONS = [
    ([0], "clear", "Clear sky"),
    ([1], "mainlyClear", "Mainly clear"),
    ([2], "partlyCloudy", "Partly cloudy"),
    ([3], "overcast", "Overcast"),
    ([45, 48], "fog", "Foggy"),
    ([51, 53, 55], "drizzle", "Drizzle"),
    ([56, 57], "freezingDrizzle", "Freezing drizzle"),
    ([61, 63, 65], "rain", "Rain"),
    ([66, 67], "freezingRain", "Freezing rain"),
    ([71, 73, 75], "snow", "Snowfall"),
    ([77], "snowGrains", "Snow grains"),
    ([80, 81, 82], "rainShowers", "Rain showers"),
    ([85, 86], "snowShowers", "Snow showers"),
    ([95], "thunderstorm", "Thunderstorm"),
    ([96, 99], "thunderstormWithHail", "Thunderstorm with hail"),
]
UNKNOWN = ("unknown", "Unknown conditions")

# Staleness threshold and the metrics filled from the nearest hour.
STALE_AFTER_SECONDS = 2 * 3600
FILLED_FROM_NEAREST = ["precipitation_probability", "uv_index", "visibility", "cloud_cover",
                       "pressure_msl", "wind_gusts_10m"]


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def condition(code) -> Column:
    """condition name for a WMO code (anything else, NULL included: unknown)."""
    c = _col(code)
    expr = None
    for codes, name, _ in CONDITIONS:
        expr = (F.when(c.isin(codes), F.lit(name)) if expr is None else expr.when(c.isin(codes), F.lit(name)))
    return expr.otherwise(F.lit(UNKNOWN[0]))


def condition_label(code) -> Column:
    c = _col(code)
    expr = None
    for codes, _, label in CONDITIONS:
        expr = (F.when(c.isin(codes), F.lit(label)) if expr is None else expr.when(c.isin(codes), F.lit(label)))
    return expr.otherwise(F.lit(UNKNOWN[1]))


def is_stale(retrieved_at, now: Column) -> Column:
    """strictly older than two hours."""
    return (F.unix_micros(now) - F.unix_micros(_col(retrieved_at))) > STALE_AFTER_SECONDS * 1_000_000


def upcoming_hours(hourly, current_valid_at, now: Column, limit: int = 24) -> Column:
    """P18 + W8: hours at or after ``greatest(now, current.valid_at)``, first
    ``limit`` by time (a top-k inside the snapshot's own bounded array)."""
    cutoff = F.greatest(now, _col(current_valid_at))
    return F.slice(F.array_sort(F.filter(_col(hourly), lambda h: h["valid_at"] >= cutoff)), 1, limit)


def nearest_hour(hourly, at) -> Column:
    """The hourly element with least |valid_at - at| in whole seconds; the
    earliest wins a tie (first in time order)."""
    a = _col(at)
    keyed = F.transform(_col(hourly), lambda h: F.struct(
        F.abs(F.unix_seconds(h["valid_at"]) - F.unix_seconds(a)).alias("d"), h["valid_at"].alias("t"),
        h.alias("h")))
    return F.try_element_at(F.array_sort(keyed), F.lit(1))["h"]


def fill_current(current, nearest) -> list[Column]:
    """current value, else the nearest hour's, for six metrics."""
    return [F.coalesce(_col(current)[m], _col(nearest)[m]).alias(m) for m in FILLED_FROM_NEAREST]


def with_city_clock(latest: DataFrame, now: Column) -> DataFrame:
    """Local wall time of ``now`` in each snapshot's zone (NULL for unknown
    zones, checked against the JVM's zone list first: never a failed job)."""
    z = with_valid_zone(latest, "timezone", flag="__zone_ok")
    local = F.when(F.col("__zone_ok"), F.from_utc_timestamp(now, F.when(F.col("__zone_ok"), F.col("timezone"))
                                                            .otherwise(F.lit("UTC"))))
    return z.withColumn("city_now", local).drop("__zone_ok")


def todays_daily(daily, city_now) -> Column:
    """The daily element whose date is the city's local date."""
    key = F.date_format(_col(city_now), "yyyy-MM-dd")
    return F.try_element_at(F.filter(_col(daily), lambda d: d["date"] == key), F.lit(1))


def upcoming_days(daily, city_now) -> Column:
    """Days on or after the city's date; unparseable dates are kept, and an
    unknown zone (``city_now`` NULL) keeps everything."""
    today = F.to_date(_col(city_now))
    return F.filter(_col(daily), lambda d: today.isNull() | try_date(d["date"]).isNull()
                    | (try_date(d["date"]) >= today))


def is_daylight(now: Column, city_now, today, current_is_day) -> Column:
    """sunrise <= now < sunset from today's row; else local hour in [6, 18);
    unknown zone -> current ``is_day`` or true."""
    t = _col(today)
    local_hour = F.hour(_col(city_now))
    return (F.when(_col(city_now).isNull(), F.coalesce(_col(current_is_day), F.lit(True)))
            .when(t["sunrise"].isNotNull() & t["sunset"].isNotNull(),
                  (now >= t["sunrise"]) & (now < t["sunset"]))
            .otherwise((local_hour >= 6) & (local_hour < 18)))


def day_period(now: Column, city_now, today, current_is_day) -> Column:
    """morning/day/evening/night from sun windows (sunrise -90 min..+2 h,
    sunset -2 h..+90 min), else clock hours 5-9-17-20."""
    t = _col(today)
    sr, ss = t["sunrise"], t["sunset"]
    m_start = sr - F.expr("INTERVAL 90 MINUTES")
    m_end = sr + F.expr("INTERVAL 2 HOURS")
    e_start = ss - F.expr("INTERVAL 2 HOURS")
    e_end = ss + F.expr("INTERVAL 90 MINUTES")
    by_sun = (F.when((now >= m_start) & (now < m_end), "morning")
              .when((now >= e_start) & (now < e_end), "evening")
              .when((now >= m_end) & (now < e_start), "day").otherwise("night"))
    h = F.hour(_col(city_now))
    by_clock = (F.when((h >= 5) & (h < 9), "morning").when((h >= 9) & (h < 17), "day")
                .when((h >= 17) & (h < 20), "evening").otherwise("night"))
    return (F.when(_col(city_now).isNull(),
                   F.when(F.coalesce(_col(current_is_day), F.lit(True)), "day").otherwise("night"))
            .when(sr.isNotNull() & ss.isNotNull(), by_sun)
            .otherwise(by_clock))
