"""hindcast: forecast-verification analytics as composable Spark DataFrame operators.

Every public operator is a function ``DataFrame -> DataFrame`` (no actions inside)
built from ``pyspark.sql.functions`` so Catalyst plans it and whole-stage codegen
runs it.  The session time zone must be UTC (see :mod:`hindcast.session`).
"""

from hindcast.schemas import METRICS  # noqa: F401

__all__ = ["METRICS"]
