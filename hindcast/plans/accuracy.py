"""Forecast verification: matched rows with error metrics (J1, E1-E8) and the
accuracy rollup by location x model x lead bucket (J2, A1-A10)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hindcast.functions import metrics as m
from hindcast.operators.joins import join_dimension

# Metrics compared with a reference value (probability has only a
# forecast side and showers is not compared).
PAIRED = ["temperature_2m", "apparent_temperature", "relative_humidity_2m", "precipitation",
          "rain", "snowfall", "weather_code", "cloud_cover", "pressure_msl", "visibility",
          "wind_speed_10m", "wind_direction_10m", "wind_gusts_10m", "uv_index", "is_day"]


def _matched_columns():
    f, v = "f.", "v."
    cols = [
        F.col(f + "event_id").alias("forecast_event_id"),
        F.col(v + "event_id").alias("verification_event_id"),
        F.col(f + "location_id").alias("location_id"),
        F.col(f + "model_id").alias("model_id"),
        F.col(f + "model_name").alias("model_name"),
        F.col(f + "provider").alias("provider"),
        F.col(f + "resolution_km").alias("resolution_km"),
        F.col(f + "forecast_run_at").alias("forecast_run_at"),
        F.col(f + "retrieved_at").alias("forecast_retrieved_at"),
        F.col(f + "valid_at").alias("valid_at"),
        F.col(f + "forecast_date_utc").alias("forecast_date_utc"),
        F.col(f + "lead_time_hours").alias("lead_time_hours"),
        F.col(f + "lead_time_bucket").alias("lead_time_bucket"),
        F.col(v + "source").alias("verification_source"),
        F.col(v + "reference_kind").alias("reference_kind"),
        F.col(v + "retrieved_at").alias("verification_retrieved_at"),
        F.col(v + "verification_version_count").alias("verification_version_count"),
    ]
    for name in PAIRED:
        cols.append(F.col(f + name).alias(f"forecast_{name}"))
        if name == "precipitation":
            cols.append(F.col(v + name).alias(f"reference_{name}"))
            cols.append(F.col(f + "precipitation_probability").alias("forecast_precipitation_probability"))
            continue
        cols.append(F.col(v + name).alias(f"reference_{name}"))
    cols += [F.col(f + "ingested_at").alias("forecast_ingested_at"),
             F.col(v + "ingested_at").alias("verification_ingested_at")]
    return cols


def fct_model_forecast_accuracy(fct_model_forecasts: DataFrame, fct_verification: DataFrame) -> DataFrame:
    """Inner equi-join on (location_id, valid_at); the verification side is
    one row per key (W4), so a hot forecast key only fans out 1:1 and AQE's
    skew-join splitting applies to the forecast side."""
    fc = fct_model_forecasts.alias("f")
    vr = fct_verification.alias("v")
    matched = fc.join(vr, (F.col("f.location_id") == F.col("v.location_id"))
                      & (F.col("f.valid_at") == F.col("v.valid_at")), "inner").select(*_matched_columns())

    def e(name):
        return f"forecast_{name}", f"reference_{name}"

    out = []
    t = e("temperature_2m")
    out += [m.error(*t).alias("temperature_error"), m.absolute_error(*t).alias("temperature_absolute_error"),
            m.squared_error(*t).alias("temperature_squared_error")]
    a = e("apparent_temperature")
    out += [m.error(*a).alias("apparent_temperature_error"),
            m.absolute_error(*a).alias("apparent_temperature_absolute_error")]
    h = e("relative_humidity_2m")
    out += [m.error(*h).alias("relative_humidity_error"), m.absolute_error(*h).alias("relative_humidity_absolute_error")]
    p = e("precipitation")
    out += [m.error(*p).alias("precipitation_error"), m.absolute_error(*p).alias("precipitation_absolute_error"),
            m.squared_error(*p).alias("precipitation_squared_error")]
    for name, label in [("rain", "rain"), ("snowfall", "snowfall"), ("cloud_cover", "cloud_cover"),
                        ("pressure_msl", "pressure_msl"), ("visibility", "visibility"),
                        ("wind_speed_10m", "wind_speed_10m")]:
        out += [m.error(*e(name)).alias(f"{label}_error"), m.absolute_error(*e(name)).alias(f"{label}_absolute_error")]
    out.append(m.circular_direction_error(*e("wind_direction_10m")).alias("wind_direction_10m_absolute_error"))
    for name in ["wind_gusts_10m", "uv_index"]:
        out += [m.error(*e(name)).alias(f"{name}_error"), m.absolute_error(*e(name)).alias(f"{name}_absolute_error")]
    out += [
        m.exact_match(*e("weather_code")).alias("weather_code_exact_match"),
        m.exact_match(*e("is_day")).alias("day_night_match"),
        m.precipitation_occurred("reference_precipitation").alias("precipitation_occurred"),
        m.brier_score("forecast_precipitation_probability", "reference_precipitation")
        .alias("precipitation_probability_brier_score"),
    ]
    return matched.select("*", *out)


GROUP_KEYS = ["location_id", "city", "administrative_area", "country", "country_code", "timezone",
              "model_id", "model_name", "provider", "resolution_km", "lead_time_bucket"]


# The rollup's columns in order.  Means and roots of means name the error
# column, rates the match column.
MEANS = {
    "temperature_mean_error": "temperature_error", "temperature_mae": "temperature_absolute_error",
    "apparent_temperature_mae": "apparent_temperature_absolute_error",
    "relative_humidity_mean_error": "relative_humidity_error", "relative_humidity_mae": "relative_humidity_absolute_error",
    "precipitation_mean_error": "precipitation_error", "precipitation_mae": "precipitation_absolute_error",
    "rain_mae": "rain_absolute_error", "snowfall_mae": "snowfall_absolute_error",
    "cloud_cover_mae": "cloud_cover_absolute_error", "pressure_msl_mae": "pressure_msl_absolute_error",
    "visibility_mae": "visibility_absolute_error", "wind_speed_10m_mae": "wind_speed_10m_absolute_error",
    "wind_direction_10m_mae": "wind_direction_10m_absolute_error", "wind_gusts_10m_mae": "wind_gusts_10m_absolute_error",
    "uv_index_mae": "uv_index_absolute_error",
    "precipitation_probability_brier_score": "precipitation_probability_brier_score",
}
ROOTS = {"temperature_rmse": "temperature_squared_error", "precipitation_rmse": "precipitation_squared_error"}
RATES = {"weather_code_exact_match_rate": "weather_code_exact_match", "day_night_match_rate": "day_night_match"}
SAMPLES = {"temperature_sample_count": "temperature_absolute_error", "precipitation_sample_count": "precipitation_absolute_error"}
FIRSTS = {"first_forecast_run_at": "forecast_run_at", "first_valid_at": "valid_at"}
LASTS = {"latest_forecast_run_at": "forecast_run_at", "latest_valid_at": "valid_at",
         "latest_verification_retrieved_at": "verification_retrieved_at"}
DISTINCTS = {"forecast_run_count": "forecast_event_id", "verification_event_count": "verification_event_id"}
SUMMARY = [
    "matched_hour_count", "forecast_run_count", "verification_event_count", "first_forecast_run_at",
    "latest_forecast_run_at", "first_valid_at", "latest_valid_at", "latest_verification_retrieved_at",
    "temperature_sample_count", "temperature_mean_error", "temperature_mae", "temperature_rmse",
    "apparent_temperature_mae", "relative_humidity_mean_error", "relative_humidity_mae", "precipitation_sample_count",
    "precipitation_mean_error", "precipitation_mae", "precipitation_rmse", "rain_mae", "snowfall_mae", "cloud_cover_mae",
    "pressure_msl_mae", "visibility_mae", "wind_speed_10m_mae", "wind_direction_10m_mae", "wind_gusts_10m_mae",
    "uv_index_mae", "weather_code_exact_match_rate", "day_night_match_rate", "precipitation_probability_brier_score",
]


def _partial_sums() -> list[Column]:
    """What a pair of events adds to the rollup, in fixed-width columns: sums and counts
    of each error, least and greatest instants."""
    errors = dict.fromkeys([*MEANS.values(), *ROOTS.values()])
    return [F.count(F.lit(1)).alias("hours"),
            *(F.sum(c).alias(f"sum_{c}") for c in errors), *(F.count(c).alias(f"n_{c}") for c in [*errors, *RATES.values()]),
            *(F.count_if(F.col(c)).alias(f"sum_{c}") for c in RATES.values()),
            *(F.min(c).alias(f"least_{c}") for c in FIRSTS.values()), *(F.max(c).alias(f"most_{c}") for c in LASTS.values())]


def _merged() -> list[Column]:
    """The rollup's columns from the partial sums of a group's pairs."""
    mean = lambda c: F.try_divide(F.sum(f"sum_{c}"), F.sum(f"n_{c}"))
    made = {"matched_hour_count": F.sum("hours")}
    made |= {name: mean(c) for name, c in (MEANS | RATES).items()} | {name: F.sqrt(mean(c)) for name, c in ROOTS.items()}
    made |= {name: F.sum(f"n_{c}") for name, c in SAMPLES.items()}
    made |= {name: F.min(f"least_{c}") for name, c in FIRSTS.items()} | {name: F.max(f"most_{c}") for name, c in LASTS.items()}
    made |= {name: F.coalesce(F.max(F.when(F.col(c).isNotNull(), F.col(f"rank_{c}"))), F.lit(0)).cast("bigint")
             for name, c in DISTINCTS.items()}
    return [made[name].alias(name) for name in SUMMARY]


FACT_KEYS = ["location_id", "model_id", "model_name", "provider", "resolution_km", "lead_time_bucket"]
DIM_KEYS = ["city", "administrative_area", "country", "country_code", "timezone"]


def rolled_up(accuracy: DataFrame) -> DataFrame:
    """A1-A10 by the fact keys, with both distinct counts (A3) exact and no ``Expand``.

    First the hours of each pair of events (a run and a verification event share at most
    a day's hours) are combined, in the map tasks already, into one row of sums.  These
    few rows are then brought together by the fact keys; there the greatest dense rank
    of an id is the number of distinct ids, and the sums are merged.  Both ranks and the
    last aggregate share the one shuffle."""
    pairs = accuracy.groupBy(*FACT_KEYS, *DISTINCTS.values()).agg(*_partial_sums())
    group = Window.partitionBy(*FACT_KEYS)
    ranked = pairs.withColumns({f"rank_{c}": F.dense_rank().over(group.orderBy(F.col(c).asc_nulls_last()))
                                for c in DISTINCTS.values()})
    return ranked.groupBy(*FACT_KEYS).agg(*_merged())


def agg_model_accuracy(accuracy: DataFrame, dim_locations: DataFrame, dim_rows: int | None = None) -> DataFrame:
    """J2 + A1-A10: the rollup by the 11 keys of the model.

    The dimension holds one row per ``location_id`` (W2), so its five columns
    are functionally dependent on ``location_id``: rolling up by the fact keys
    first and joining the dimension afterwards gives the same rows, with the
    wide aggregate over six keys and the join over the (much smaller) rollup.
    The join is a size-checked broadcast."""
    rolled = rolled_up(accuracy)
    loc = dim_locations.select("location_id", *DIM_KEYS)
    enriched = join_dimension(rolled, loc, "location_id", "inner", dim_rows=dim_rows)
    names = [c for c in rolled.columns if c not in FACT_KEYS]
    return enriched.select(*GROUP_KEYS, *names)
