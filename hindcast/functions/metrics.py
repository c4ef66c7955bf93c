"""Forecast-error expressions.

Every expression propagates NULL like the warehouse SQL: an error is NULL when
either side is NULL, and exact matches use ``=`` (not null-safe equality).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def error(forecast, reference) -> Column:
    """Signed error, forecast minus reference."""
    return _col(forecast) - _col(reference)


def absolute_error(forecast, reference) -> Column:
    """E2."""
    return F.abs(_col(forecast) - _col(reference))


def squared_error(forecast, reference) -> Column:
    """E3."""
    return F.pow(_col(forecast) - _col(reference), 2)


def circular_direction_error(forecast, reference) -> Column:
    """Smallest angle between two directions in degrees, 0..180.

    Written with CASE rather than ``least`` because ``least`` skips NULLs in
    Spark (X2); both branches are NULL together, so the result is the same."""
    d = F.abs(_col(forecast) - _col(reference))
    return F.when(d <= F.lit(360) - d, d).otherwise(F.lit(360) - d)


def exact_match(forecast, reference) -> Column:
    """E5: equality, NULL when either side is NULL."""
    return _col(forecast) == _col(reference)


# Fixed value: precipitation of at least this many mm counts as "occurred".
PRECIPITATION_OCCURRED_MM = 0.1


def precipitation_occurred(reference_precipitation) -> Column:
    """Reference >= 0.1 mm, NULL-preserving."""
    return _col(reference_precipitation) >= PRECIPITATION_OCCURRED_MM


def brier_score(probability_pct, reference_precipitation) -> Column:
    """(p/100 - o)^2 with o = 1 where precipitation occurred, else 0; NULL if
    either is NULL."""
    return F.pow(_col(probability_pct) / 100.0 - precipitation_occurred(reference_precipitation).cast("int"), 2)


def match_rate(flag) -> Column:
    """Share of true among non-NULL flags; NULL when there are none."""
    b = _col(flag)
    return F.try_divide(F.count_if(b), F.count(b))


def rmse(squared) -> Column:
    """A8."""
    return F.sqrt(F.avg(_col(squared)))
