"""Bridge: the driver's generic tables -> the forecast data model.

``events`` (user, type, time, value, props) becomes forecast hours, model-run
events, reanalysis verification events and operational snapshots with JSON
payloads and Kafka-style log metadata; ``customer`` x ``nation`` x ``region``
becomes the reference ``locations`` table.  Everything is lazy DataFrame code:
grouping keys are bounded by construction (an event holds one run's hours, at
most ``7*24 + 48`` of them; a verification event or snapshot holds one day), so
``collect_list`` never gathers an unbounded group.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hindcast.functions import identity
from hindcast.schemas import (
    CURRENT_METRICS,
    METRICS,
    REFERENCE_KIND,
    SCHEMA_VERSION,
    TOPIC_MODEL_RUN,
    TOPIC_OPERATIONAL,
    TOPIC_VERIFICATION,
    TYPE_MODEL_RUN,
    TYPE_OPERATIONAL,
    TYPE_VERIFICATION,
    VERIFICATION_SERIES,
)
from hindcast.sources import formulas as fx
from hindcast.sources.tables import read_table

# JSON writer options: microsecond RFC 3339 instants, NULL fields kept.
JSON_OPTIONS = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "ignoreNullFields": "false"}


def _metrics(formulas: dict[str, str]) -> list[Column]:
    return [F.expr(formulas[m]).alias(m) for m in METRICS]


def event_hours(events: DataFrame) -> DataFrame:
    """One row per (location, model, valid hour): the least event id, the greatest
    value and the greatest ``k`` of all the hour's events."""
    return _hours(events, F.col("event_type").alias("model_id"))


def location_hours(events: DataFrame, verified_only: bool) -> DataFrame:
    """One row per (location, valid hour) over all event types, as ``event_hours``.
    Verification arrives ``VERIFICATION_LAG_DAYS`` late: hours newer than that,
    counted from the newest event, are not verified yet."""
    if verified_only:
        newest = events.agg(F.max(F.col("ts").cast("timestamp")))
        events = events.filter(F.date_trunc("hour", F.col("ts").cast("timestamp"))
                               <= newest.scalar() - F.expr(f"make_dt_interval({fx.VERIFICATION_LAG_DAYS}, 0, 0, 0)"))
    return _hours(events)


def _hours(events: DataFrame, *keys: Column) -> DataFrame:
    """Order-independent aggregates with fixed-width buffers: a hot key is combined in
    each task before the shuffle, and every event of an hour counts."""
    e = events.select(
        (F.col("user_id") + 1).alias("location_id"), *keys,
        F.date_trunc("hour", F.col("ts").cast("timestamp")).alias("valid_at"),
        F.col("event_id").alias("e"),
        F.col("value").alias("x"),
        F.get_json_object("props", "$.k").cast("bigint").alias("k"),
    )
    by = [c for c in e.columns if c not in ("e", "x", "k")]
    return e.groupBy(*by).agg(F.min("e").alias("e"), F.max("x").alias("x"), F.max("k").alias("k"))


#: What an hour's metrics are computed from.  Rows are grouped, dealt and sorted with
#: these; metrics and payload text, ten times as wide, are made after the last shuffle.
_HOUR = ("valid_at", "e", "x", "k")


#: Date columns that landing adds to packs; the raw rows keep them, and with them the order.
_LANDING_DATES = ("run_date", "period_date", "retrieved_date")


def _landing_date(packs: DataFrame) -> list[str]:
    return [c for c in _LANDING_DATES if c in packs.columns]


def _packed(hours: DataFrame, *keys: str) -> DataFrame:
    """One row for each of ``keys`` with its hours in order."""
    return hours.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(*_HOUR))).alias("hours"))


def _hourly(formulas: dict[str, str], *more: tuple[str, str]) -> Column:
    """The packed hours as structs of ``valid_at``, the expressions ``more`` (name, SQL over
    the hour ``r``) and the metrics."""
    fields = [("valid_at", "r.valid_at"), *more]
    for m in METRICS:
        text = re.sub(r"(?<![\w.])([exk])(?![\w(])", r"r.\1", formulas[m])
        fields.append((m, re.sub(r"(?<![\w.])h(?![\w(])", "hour(r.valid_at)", text)))
    return F.expr(f"transform(hours, r -> named_struct({', '.join(f'{n!r}, {sql}' for n, sql in fields)}))")


def model_run_packs(events: DataFrame) -> DataFrame:
    """One row per (location, model, run) and delivery, with the hours it forecasts.  Each
    event hour is forecast by ``RUN_OFFSETS`` runs: the run at the start of its ISO week
    and the runs 1 and 2 days before it, so a week's hours are packed once (the offsets
    are under 7 days, so no run has hours of two weeks).  Events of locations divisible
    by 7 are delivered twice."""
    hours = event_hours(events).withColumn("week", F.date_trunc("week", "valid_at"))
    weeks = _packed(hours, "location_id", "model_id", "week")
    runs = weeks.select("*", F.explode(F.sequence(F.lit(0), F.lit(fx.RUN_OFFSETS - 1))).alias("s"))
    runs = runs.withColumn("forecast_run_at", F.col("week") - F.expr("make_dt_interval(s, 0, 0, 0)"))
    copies = F.when(F.col("location_id") % 7 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return runs.withColumn("__copy", F.explode(copies)).drop("week")


def model_run_events(packs: DataFrame) -> DataFrame:
    """Raw ``model_run_events`` rows of ``model_run_packs``: one event per (location, model,
    run) with a JSON payload; a second delivery is ingested an hour later at a higher
    offset."""
    runs = (packs
            .withColumn("hourly", _hourly(fx.FORECAST_FORMULAS, (
                "lead_time_hours", "timestampdiff(HOUR, forecast_run_at, r.valid_at)")))
            .withColumn("model_name", F.expr(fx.MODEL_NAME_SQL))
            .withColumn("provider", F.expr(fx.PROVIDER_SQL))
            .withColumn("resolution_km", F.expr(fx.RESOLUTION_SQL).cast("double"))
            .withColumn("retrieved_at", F.col("forecast_run_at") + F.expr("make_dt_interval(0, 0, 30, 0)"))
            .withColumn("event_id", identity.model_run_event_id("provider", "model_id", "location_id",
                                                                 "forecast_run_at")))
    envelope = F.struct(
        F.col("event_id"),
        F.lit(TYPE_MODEL_RUN).alias("event_type"),
        F.lit(SCHEMA_VERSION).alias("schema_version"),
        F.col("retrieved_at").alias("occurred_at"),
        F.struct(
            "location_id",
            F.struct("model_id", "model_name", "provider", "resolution_km").alias("model"),
            "forecast_run_at", "retrieved_at", "hourly",
        ).alias("data"),
    )
    run_hour = (F.unix_seconds("forecast_run_at") / 3600).cast("bigint")
    model_idx = F.expr("case model_id when 'click' then 0 when 'view' then 1 when 'purchase' then 2 "
                       "when 'signup' then 3 else 4 end")
    return runs.select(
        "event_id",
        F.lit(TYPE_MODEL_RUN).alias("event_type"),
        F.lit(SCHEMA_VERSION).cast("bigint").alias("schema_version"),
        "location_id", "model_id", "provider", "forecast_run_at", "retrieved_at",
        F.lit(TOPIC_MODEL_RUN).alias("kafka_topic"),
        (F.col("location_id") % 3).alias("kafka_partition"),
        (run_hour * 1_000_000_000 + F.col("location_id") * 10 + model_idx + F.col("__copy") * 5).alias("kafka_offset"),
        identity.location_model_key("location_id", "model_id").alias("kafka_key"),
        F.col("retrieved_at").alias("kafka_timestamp"),
        F.to_json(envelope, JSON_OPTIONS).alias("payload"),
        (F.col("retrieved_at") + F.expr("make_dt_interval(0, __copy, 1, 0)")).alias("ingested_at"),
        *_landing_date(packs),
    )


def verification_packs(events: DataFrame, locations: DataFrame | None = None) -> DataFrame:
    """One row per (location, UTC day, version) with that version's hours (hours have
    ``e % 3 + 1`` versions each, ``s`` = v), retrieved ``7 + v`` days after the day starts;
    with its location's time zone where ``locations`` are given."""
    base = location_hours(events, verified_only=True).withColumn("day", F.date_trunc("day", "valid_at"))
    days = _packed(base, "location_id", "day")
    days = days.select("location_id", "day", F.explode(F.sequence(F.lit(1), F.lit(3))).alias("s"), "hours")
    days = days.withColumn("hours", F.filter("hours", lambda r: r["e"] % 3 + 1 >= F.col("s"))).where(F.size("hours") > 0)
    first, last = identity.period_bounds("hours")
    days = days.withColumn("period_start", first).withColumn("period_end", last)
    return days if locations is None else with_timezones(days, locations)


def verification_events(packs: DataFrame) -> DataFrame:
    """``verification_packs`` as events, with the metrics of their hours."""
    days = (packs
            .withColumn("retrieved_at", F.col("day") + F.expr(f"make_dt_interval({fx.VERIFICATION_LAG_DAYS} + s, 0, 0, 0)"))
            .withColumn("source", F.lit(fx.VERIFICATION_SOURCE))
            .withColumn("reference_kind", F.lit(REFERENCE_KIND))
            .withColumn("event_id", identity.verification_event_id(
                "source", "reference_kind", "location_id", "retrieved_at", "period_start", "period_end")))
    return days.withColumn("hourly", _hourly(fx.VERIFICATION_FORMULAS)).drop("hours")


def with_timezones(df: DataFrame, locations: DataFrame) -> DataFrame:
    """Attach each location's time zone (the locations table is a dimension;
    the join leaves the choice of broadcast to AQE's runtime size check)."""
    return df.join(locations.select("location_id", "timezone"), "location_id", "left")


def verification_raw(packs: DataFrame) -> DataFrame:
    """Raw ``verification_weather_events`` rows of ``verification_packs``."""
    days = verification_events(packs)
    envelope = F.struct(
        F.col("event_id"),
        F.lit(TYPE_VERIFICATION).alias("event_type"),
        F.lit(SCHEMA_VERSION).alias("schema_version"),
        F.col("retrieved_at").alias("occurred_at"),
        F.struct("location_id", "source", "reference_kind", "retrieved_at", "timezone",
                 "period_start", "period_end", "hourly").alias("data"),
    )
    offset = (F.unix_seconds("day") / 86400).cast("bigint") * 10_000_000 + F.col("location_id") * 10 + F.col("s")
    return days.select(
        "event_id",
        F.lit(TYPE_VERIFICATION).alias("event_type"),
        F.lit(SCHEMA_VERSION).cast("bigint").alias("schema_version"),
        "location_id", "source", "reference_kind", "period_start", "period_end", "retrieved_at",
        F.lit(TOPIC_VERIFICATION).alias("kafka_topic"),
        (F.col("location_id") % 3).alias("kafka_partition"),
        offset.alias("kafka_offset"),
        identity.location_key("location_id").alias("kafka_key"),
        F.col("retrieved_at").alias("kafka_timestamp"),
        F.to_json(envelope, JSON_OPTIONS).alias("payload"),
        (F.col("retrieved_at") + F.expr("make_dt_interval(0, 0, 1, 0)")).alias("ingested_at"),
        *_landing_date(packs),
    )


def operational_packs(events: DataFrame, locations: DataFrame) -> DataFrame:
    """One row per (location, UTC day): the "latest" snapshot retrieved at 06:00 that day,
    with that day's hours (so early hours have negative horizons) and its time zone."""
    base = location_hours(events, verified_only=False).withColumn("day", F.date_trunc("day", "valid_at"))
    days = with_timezones(_packed(base, "location_id", "day"), locations)
    return days.withColumn("retrieved_at", F.col("day") + F.expr("make_dt_interval(0, 6, 0, 0)"))


def operational_snapshots(packs: DataFrame) -> DataFrame:
    """``operational_packs`` with current, hourly and daily values."""
    days = (packs
            .withColumn("source", F.lit(fx.OPERATIONAL_SOURCE))
            .withColumn("event_id", identity.operational_event_id("source", "location_id", "retrieved_at"))
            .withColumn("s", F.lit(0)).withColumn("hourly", _hourly(fx.FORECAST_FORMULAS)))
    rain = F.filter(F.col("hourly.precipitation"), lambda p: p.isNotNull())
    days = days.withColumns({
        "t_max": F.array_max("hourly.temperature_2m"), "t_min": F.array_min("hourly.temperature_2m"),
        "a_max": F.array_max("hourly.apparent_temperature"), "a_min": F.array_min("hourly.apparent_temperature"),
        "p_sum": F.when(F.size(rain) > 0, F.aggregate(rain, F.lit(0.0), lambda a, p: a + p)),
        "pp_max": F.array_max("hourly.precipitation_probability"),
        "p_hours": F.size(F.filter(rain, lambda p: p > 0)).cast("double"),
        "ws_max": F.array_max("hourly.wind_speed_10m"), "wg_max": F.array_max("hourly.wind_gusts_10m"),
        "wc_max": F.array_max("hourly.weather_code")})
    first = F.try_element_at("hourly", F.lit(1))
    current = F.struct(
        first["valid_at"].alias("valid_at"),
        F.lit(900).alias("interval_seconds"),
        *[(first[m] if m in CURRENT_METRICS else F.lit(None).cast("double")).alias(m) for m in METRICS],
    )
    sunrise = F.when(F.col("location_id") % 4 != 0, F.col("day") + F.expr("make_dt_interval(0, 5, 45, 0)"))
    sunset = F.when(F.col("location_id") % 4 != 0, F.col("day") + F.expr("make_dt_interval(0, 18, 0, 0)"))
    daily = F.array(F.struct(
        F.date_format("day", "yyyy-MM-dd").alias("date"),
        F.col("wc_max").alias("weather_code"),
        F.col("t_max").alias("temperature_2m_max"),
        F.col("t_min").alias("temperature_2m_min"),
        F.col("a_max").alias("apparent_temperature_max"),
        F.col("a_min").alias("apparent_temperature_min"),
        F.col("p_sum").alias("precipitation_sum"),
        F.col("pp_max").alias("precipitation_probability_max"),
        F.col("p_hours").alias("precipitation_hours"),
        F.col("ws_max").alias("wind_speed_10m_max"),
        F.col("wg_max").alias("wind_gusts_10m_max"),
        F.lit(None).cast("double").alias("wind_direction_10m_dominant"),
        sunrise.alias("sunrise"),
        sunset.alias("sunset"),
        F.when(sunrise.isNotNull(), F.lit(44100.0)).alias("daylight_duration_seconds"),
        F.lit(None).cast("double").alias("uv_index_max"),
    ))
    return days.select(
        *_landing_date(packs), "event_id", "location_id", "day", "timezone", "source", "retrieved_at",
        current.alias("current"), "hourly", daily.alias("daily"),
    )


def operational_raw(packs: DataFrame) -> DataFrame:
    """Raw ``operational_forecast_events`` rows of ``operational_packs``."""
    snaps = operational_snapshots(packs)
    envelope = F.struct(
        F.col("event_id"),
        F.lit(TYPE_OPERATIONAL).alias("event_type"),
        F.lit(SCHEMA_VERSION).alias("schema_version"),
        F.col("retrieved_at").alias("occurred_at"),
        F.struct("location_id", "source", "retrieved_at", "timezone", "current", "hourly", "daily").alias("data"),
    )
    offset = (F.unix_seconds("day") / 86400).cast("bigint") * 10_000_000 + F.col("location_id")
    return snaps.select(
        "event_id",
        F.lit(TYPE_OPERATIONAL).alias("event_type"),
        F.lit(SCHEMA_VERSION).cast("bigint").alias("schema_version"),
        "location_id", "source", "retrieved_at",
        F.lit(TOPIC_OPERATIONAL).alias("kafka_topic"),
        (F.col("location_id") % 3).alias("kafka_partition"),
        offset.alias("kafka_offset"),
        identity.location_key("location_id").alias("kafka_key"),
        F.col("retrieved_at").alias("kafka_timestamp"),
        F.to_json(envelope, JSON_OPTIONS).alias("payload"),
        (F.col("retrieved_at") + F.expr("make_dt_interval(0, 0, 1, 0)")).alias("ingested_at"),
        *_landing_date(packs),
    )


def locations_raw(customer: DataFrame, nation: DataFrame, region: DataFrame) -> DataFrame:
    """Reference ``locations`` rows (with untrimmed text, lower-case codes and
    an older superseded version for every ninth customer)."""
    geo = nation.join(region, nation["n_regionkey"] == region["r_regionkey"]).select(
        "n_nationkey", "n_name", F.expr(fx.timezone_case("r_name")).alias("timezone"))
    # nation x region is fixed at 25 rows by the TPC-H schema: a bounded broadcast.
    c = customer.join(F.broadcast(geo), customer["c_nationkey"] == geo["n_nationkey"])
    code = F.concat(F.expr("char(65 + n_nationkey)"), F.expr("char(65 + (n_nationkey * 7) % 26)"))
    cur = c.select(
        (F.col("c_custkey") + 1).alias("location_id"),
        (F.col("c_custkey") + 1_000_000).alias("open_meteo_location_id"),
        F.concat(F.col("c_name"), F.when(F.col("c_custkey") % 4 == 0, F.lit("  ")).otherwise(F.lit(""))).alias("city"),
        F.concat(F.lit(" "), F.col("n_name")).alias("country"),
        F.when(F.col("c_custkey") % 3 == 0, F.lower(code)).otherwise(code).alias("country_code"),
        ((F.col("c_custkey") % 180) - 89.5).cast("double").alias("latitude"),
        (((F.col("c_custkey") * 7) % 360) - 179.75).cast("double").alias("longitude"),
        F.col("timezone"),
        F.when(F.col("c_custkey") % 10 == 0, F.lit(None)).otherwise(F.col("c_acctbal") / 10.0).alias("elevation"),
        F.when(F.col("c_custkey") % 7 == 0, F.lit(None)).otherwise(F.col("c_custkey") * 1000).cast("bigint").alias("population"),
        F.when(F.col("c_custkey") % 5 == 0, F.lit(None))
         .when(F.col("c_custkey") % 5 == 1, F.lit("  "))
         .otherwise(F.concat(F.lit(" "), F.col("c_mktsegment"))).alias("administrative_area"),
        F.lit("2023-12-01 00:00:00").cast("timestamp").alias("source_created_at"),
        (F.lit("2023-12-15 00:00:00").cast("timestamp")
         + F.expr("make_dt_interval(cast(c_custkey % 30 as int), 0, 0, 0)")).alias("source_updated_at"),
        F.lit("2024-01-01 00:00:00").cast("timestamp").alias("synced_at"),
    )
    old = (cur.filter(F.col("location_id") % 9 == 1)
           .withColumn("city", F.concat(F.lit("Old "), F.col("city")))
           .withColumn("source_updated_at", F.col("source_updated_at") - F.expr("make_dt_interval(1, 0, 0, 0)"))
           .withColumn("synced_at", F.col("synced_at") - F.expr("make_dt_interval(1, 0, 0, 0)")))
    return cur.unionByName(old)


@dataclass
class Bridge:
    """Lazy handles on the bridged domain tables for one driver directory."""

    events: DataFrame
    customer: DataFrame
    nation: DataFrame
    region: DataFrame

    @classmethod
    def load(cls, spark: SparkSession, sf_dir: str) -> "Bridge":
        return cls(
            events=read_table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value", "props"),
            customer=read_table(spark, sf_dir, "customer"),
            nation=read_table(spark, sf_dir, "nation"),
            region=read_table(spark, sf_dir, "region"),
        )

    def locations(self) -> DataFrame:
        return locations_raw(self.customer, self.nation, self.region)

    def current_locations(self) -> DataFrame:
        """Newest version per location (what the dimension will hold)."""
        return self.locations().filter(~F.col("city").startswith("Old "))

    def model_run_packs(self) -> DataFrame:
        return model_run_packs(self.events)

    def verification_packs(self) -> DataFrame:
        return verification_packs(self.events, self.current_locations())

    def operational_packs(self) -> DataFrame:
        return operational_packs(self.events, self.current_locations())

    def model_run_raw(self) -> DataFrame:
        return model_run_events(self.model_run_packs())

    def verification_raw(self) -> DataFrame:
        return verification_raw(self.verification_packs())

    def operational_raw(self) -> DataFrame:
        return operational_raw(self.operational_packs())

    def geocoding(self) -> DataFrame:
        return geocoding_responses(self.customer, self.nation, self.region)

    def responses(self, daily_defects: bool = False) -> DataFrame:
        return provider_responses(self.events, self.current_locations(), daily_defects)

    def verification_responses(self) -> DataFrame:
        return verification_responses(self.events, self.current_locations())


def geocoding_responses(customer: DataFrame, nation: DataFrame, region: DataFrame) -> DataFrame:
    """Landed geocoding responses, one per customer (a search that returned it);
    every 13th lacks its zone, which makes the whole response incomplete."""
    loc = locations_raw(customer, nation, region).filter(~F.col("city").startswith("Old "))
    result = F.struct(
        F.col("open_meteo_location_id").alias("id"),
        F.trim("city").alias("name"),
        F.trim("country").alias("country"),
        F.col("country_code"),
        "latitude", "longitude",
        F.when(F.col("location_id") % 13 == 1, F.lit("")).otherwise(F.col("timezone")).alias("timezone"),
        "elevation", "population",
        F.col("administrative_area").alias("admin1"),
    )
    return loc.select(F.col("location_id").alias("request_id"),
                      F.to_json(F.struct(F.array(result).alias("results"))).alias("body"))


def _local_minute(instant) -> Column:
    return F.date_format(F.from_utc_timestamp(instant, F.col("timezone")), "yyyy-MM-dd'T'HH:mm")


def verification_responses(events: DataFrame, locations: DataFrame) -> DataFrame:
    """Landed reanalysis responses, one per (location, UTC day, version): the 13 series
    that reanalysis has.  Defects on purpose: locations divisible by 23 omit ``rain``,
    by 29 send a short ``snowfall`` series, by 43 repeat their first time."""
    days = verification_events(verification_packs(events, locations))
    loc = F.col("location_id")
    less = lambda a: F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0)))

    def series(m):
        a = F.transform("hourly", lambda r: r[m].cast("bigint") if m == "is_day" else r[m])
        a = F.when(loc % 23 != 0, a) if m == "rain" else F.when(loc % 29 == 0, less(a)).otherwise(a) if m == "snowfall" else a
        return a.alias(m)

    times = F.transform("hourly", lambda r: _local_minute(r["valid_at"]))
    times = F.when((loc % 43 == 0) & (F.size(times) > 1), F.transform(times, lambda t, i: F.when(i == 1, times[0]).otherwise(t))).otherwise(times)
    body = F.struct(F.col("timezone"), F.struct(times.alias("time"), *[series(m) for m in VERIFICATION_SERIES]).alias("hourly"))
    return days.select("location_id", "retrieved_at", F.to_json(body).alias("body"))


def provider_responses(events: DataFrame, locations: DataFrame, daily_defects: bool = False) -> DataFrame:
    """Landed provider responses, one per (location, UTC day): parallel arrays in
    the location's local wall time.  Defects on purpose: locations divisible by
    31 send a short ``wind_gusts_10m`` series, by 37 omit
    ``precipitation_probability``, by 41 send ``is_day = 2`` first; with
    ``daily_defects`` those divisible by 7 send no daily block, by 11 omit its
    ``uv_index_max``, by 13 send a short ``sunrise``, by 17 a date that is none."""
    base = location_hours(events, verified_only=False).withColumn("s", F.lit(0))
    base = base.withColumn("h", F.hour("valid_at"))
    hours = base.select("location_id", "valid_at", *_metrics(fx.FORECAST_FORMULAS))
    rec = F.struct("valid_at", *METRICS)
    days = (hours.withColumn("day", F.date_trunc("day", "valid_at"))
            .groupBy("location_id", "day")
            .agg(F.array_sort(F.collect_list(rec)).alias("rows"),
                 F.max("temperature_2m").alias("t_max"), F.min("temperature_2m").alias("t_min"),
                 F.max("apparent_temperature").alias("a_max"), F.min("apparent_temperature").alias("a_min"),
                 F.sum("precipitation").alias("p_sum"), F.max("precipitation_probability").alias("pp_max"),
                 F.count_if(F.col("precipitation") > 0).cast("double").alias("p_hours"),
                 F.max("wind_speed_10m").alias("ws_max"), F.max("wind_gusts_10m").alias("wg_max"),
                 F.max("weather_code").alias("wc_max")))
    days = with_timezones(days, locations)
    loc = F.col("location_id")
    local = _local_minute
    broken = lambda n: F.lit(daily_defects) & (loc % n == 0)
    no_doubles = F.array(F.lit(None).cast("double"))

    def series(m):
        s = F.transform("rows", lambda r: r[m].cast("bigint") if m == "is_day" else r[m])
        if m == "is_day":
            s = F.when(loc % 41 == 0, F.concat(F.array(F.lit(2).cast("bigint")), F.slice(s, 2, F.greatest(F.size(s) - 1, F.lit(0))))).otherwise(s)
        if m == "wind_gusts_10m":
            s = F.when(loc % 31 == 0, F.slice(s, 1, F.greatest(F.size(s) - 1, F.lit(0)))).otherwise(s)
        if m == "precipitation_probability":
            s = F.when(loc % 37 != 0, s)
        return s.alias(m)

    first = F.try_element_at("rows", F.lit(1))
    sunrise = F.when(loc % 4 != 0, F.col("day") + F.expr("make_dt_interval(0, 5, 45, 0)"))
    sunset = F.when(loc % 4 != 0, F.col("day") + F.expr("make_dt_interval(0, 18, 0, 0)"))
    body = F.struct(
        F.col("timezone"),
        F.struct(local(first["valid_at"]).alias("time"), F.lit(900).alias("interval"),
                 *[(first[m].cast("bigint") if m == "is_day" else first[m]).alias(m) for m in CURRENT_METRICS]
                 ).alias("current"),
        F.struct(F.transform("rows", lambda r: local(r["valid_at"])).alias("time"),
                 *[series(m) for m in METRICS]).alias("hourly"),
        F.when(~broken(7), F.struct(
            F.array(F.when(broken(17), F.lit("2024-13-01")).otherwise(F.date_format("day", "yyyy-MM-dd"))).alias("time"),
            F.array("wc_max").alias("weather_code"),
            F.array("t_max").alias("temperature_2m_max"), F.array("t_min").alias("temperature_2m_min"),
            F.array("a_max").alias("apparent_temperature_max"), F.array("a_min").alias("apparent_temperature_min"),
            F.array("p_sum").alias("precipitation_sum"), F.array("pp_max").alias("precipitation_probability_max"),
            F.array("p_hours").alias("precipitation_hours"),
            F.array("ws_max").alias("wind_speed_10m_max"), F.array("wg_max").alias("wind_gusts_10m_max"),
            no_doubles.alias("wind_direction_10m_dominant"),
            F.when(broken(13), F.array().cast("array<string>")).otherwise(F.array(local(sunrise))).alias("sunrise"),
            F.array(local(sunset)).alias("sunset"),
            F.array(F.when(sunrise.isNotNull(), F.lit(44100.0))).alias("daylight_duration"),
            F.when(~broken(11), no_doubles).alias("uv_index_max"))).alias("daily"),
    )
    return days.select("location_id", F.col("day").alias("run_at"), F.to_json(body).alias("body"))
