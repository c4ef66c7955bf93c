"""The model graph wired together: raw tables -> staging -> intermediate -> marts.

:class:`Models` memoizes each model's DataFrame so a graph built once shares
subplans (Spark reuses identical exchanges inside one query).  ``materialize``
writes the typed intermediate layer to Parquet so JSON is parsed once when many
marts are computed from it (the survey's advice for scale).
"""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property, partial

from pyspark.sql import DataFrame, SparkSession

from hindcast.plans import accuracy, intermediate, marts, staging
from hindcast.sources.bridge import Bridge


def _given(table: DataFrame | Callable) -> DataFrame:
    return table() if callable(table) else table


class Models:
    def __init__(self, raw_locations: DataFrame | Callable, raw_model_runs: DataFrame | Callable,
                 raw_verification: DataFrame | Callable, raw_operational: DataFrame | Callable,
                 intermediate: dict[str, DataFrame | Callable] | None = None, in_files: bool = False):
        """``in_files``: the raw event tables are read from Parquet files as they stand,
        so that their rows have coordinates (``operators.dedup``).  A table may be given
        as a function, called when a model first reads it."""
        self.in_files = in_files
        self._raw = {"locations": raw_locations, "model_runs": raw_model_runs,
                     "verification": raw_verification, "operational": raw_operational}
        # Pre-built typed intermediate tables (see ``with_materialized_intermediate``).
        self._intermediate = intermediate or {}

    @cached_property
    def raw_locations(self) -> DataFrame:
        return _given(self._raw["locations"])

    @cached_property
    def raw_model_runs(self) -> DataFrame:
        return _given(self._raw["model_runs"])

    @cached_property
    def raw_verification(self) -> DataFrame:
        return _given(self._raw["verification"])

    @cached_property
    def raw_operational(self) -> DataFrame:
        return _given(self._raw["operational"])

    @classmethod
    def from_bridge(cls, spark: SparkSession, sf_dir: str) -> "Models":
        """Models straight over the lazily bridged raw tables (no landing)."""
        b = Bridge.load(spark, sf_dir)
        return cls(b.locations(), b.model_run_raw(), b.verification_raw(), b.operational_raw())

    @classmethod
    def from_landed(cls, spark: SparkSession, sf_dir: str) -> "Models":
        """Models over the landed (written once, date-partitioned) raw tables."""
        from hindcast.sources.landing import read_landed

        return cls(*(partial(read_landed, spark, sf_dir, t) for t in (
            "locations", "model_run_events", "verification_weather_events", "operational_forecast_events")), in_files=True)

    @classmethod
    def with_materialized_intermediate(cls, spark: SparkSession, sf_dir: str) -> "Models":
        """Marts over the typed intermediate layer written once to Parquet, so the
        JSON payloads are parsed once no matter how many marts read them."""
        from hindcast.sources.landing import INTERMEDIATE_LAYOUT, read_intermediate

        base = cls.from_landed(spark, sf_dir)
        base._intermediate = {t: partial(read_intermediate, spark, sf_dir, t) for t in INTERMEDIATE_LAYOUT}
        return base

    # staging
    @cached_property
    def stg_locations(self) -> DataFrame:
        return staging.stg_locations(self.raw_locations)

    @cached_property
    def stg_model_run_events(self) -> DataFrame:
        return staging.stg_model_run_events(self.raw_model_runs, self.in_files)

    @cached_property
    def stg_verification_weather_events(self) -> DataFrame:
        return staging.stg_verification_weather_events(self.raw_verification, self.in_files)

    @cached_property
    def stg_operational_forecast_events(self) -> DataFrame:
        return staging.stg_operational_forecast_events(self.raw_operational, self.in_files)

    # intermediate
    @cached_property
    def int_model_run_hourly_forecasts(self) -> DataFrame:
        if "int_model_run_hourly_forecasts" in self._intermediate:
            return _given(self._intermediate["int_model_run_hourly_forecasts"])
        return intermediate.int_model_run_hourly_forecasts(self.raw_model_runs, self.in_files)

    @cached_property
    def int_verification_hourly_weather(self) -> DataFrame:
        if "int_verification_hourly_weather" in self._intermediate:
            return _given(self._intermediate["int_verification_hourly_weather"])
        return intermediate.int_verification_hourly_weather(self.raw_verification, self.in_files)

    @cached_property
    def int_operational_hourly_forecasts(self) -> DataFrame:
        if "int_operational_hourly_forecasts" in self._intermediate:
            return _given(self._intermediate["int_operational_hourly_forecasts"])
        return intermediate.int_operational_hourly_forecasts(self.raw_operational, self.in_files)

    # marts
    @cached_property
    def dim_locations(self) -> DataFrame:
        return marts.dim_locations(self.stg_locations)

    @cached_property
    def dim_forecast_models(self) -> DataFrame:
        return marts.dim_forecast_models(self.int_model_run_hourly_forecasts)

    @cached_property
    def fct_model_forecasts(self) -> DataFrame:
        return marts.fct_model_forecasts(self.int_model_run_hourly_forecasts)

    @cached_property
    def fct_operational_hourly_forecasts(self) -> DataFrame:
        return marts.fct_operational_hourly_forecasts(self.int_operational_hourly_forecasts)

    @cached_property
    def fct_forecast_revisions(self) -> DataFrame:
        return marts.fct_forecast_revisions(self.int_model_run_hourly_forecasts)

    @cached_property
    def fct_verification_weather(self) -> DataFrame:
        return marts.fct_verification_weather(self.int_verification_hourly_weather)

    @cached_property
    def fct_model_forecast_accuracy(self) -> DataFrame:
        return accuracy.fct_model_forecast_accuracy(self.fct_model_forecasts, self.fct_verification_weather)

    @cached_property
    def agg_model_accuracy(self) -> DataFrame:
        # Size bound for the dimension broadcast: the raw reference table's row
        # count (a Parquet metadata count) bounds the de-duplicated dimension.
        return accuracy.agg_model_accuracy(self.fct_model_forecast_accuracy, self.dim_locations,
                                           dim_rows=self.raw_locations.count())

    MODEL_NAMES = [
        "stg_locations", "stg_model_run_events", "stg_verification_weather_events",
        "stg_operational_forecast_events", "int_model_run_hourly_forecasts",
        "int_verification_hourly_weather", "int_operational_hourly_forecasts", "dim_locations",
        "dim_forecast_models", "fct_model_forecasts", "fct_operational_hourly_forecasts",
        "fct_forecast_revisions", "fct_verification_weather", "fct_model_forecast_accuracy",
        "agg_model_accuracy",
    ]

    def register_views(self, prefix: str = "") -> list[str]:
        """Register every model as a temp view (``createOrReplaceTempView``)."""
        names = []
        for name in self.MODEL_NAMES:
            getattr(self, name).createOrReplaceTempView(prefix + name)
            names.append(prefix + name)
        return names
