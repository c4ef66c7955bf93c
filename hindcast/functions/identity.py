"""Event identity and partition keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def rfc3339(ts) -> Column:
    """UTC instant as RFC 3339 text with the fraction's trailing zeros trimmed
    and a ``Z`` suffix (``2026-09-19T00:00:00Z``, ``...T00:00:00.5Z``)."""
    c = _col(ts)
    frac = F.regexp_replace(F.date_format(c, "SSSSSS"), "0+$", "")
    return F.when(c.isNull(), F.lit(None).cast("string")).otherwise(
        F.concat(
            F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss"),
            F.when(frac == "", F.lit("")).otherwise(F.concat(F.lit("."), frac)),
            F.lit("Z"),
        )
    )


def sha256_identity(*parts) -> Column:
    """SHA-256 hex over ``|``-joined identity parts (NULL parts make NULL)."""
    cols = [_col(p).cast("string") for p in parts]
    joined = F.concat_ws("|", *cols)
    any_null = None
    for c in cols:
        any_null = c.isNull() if any_null is None else (any_null | c.isNull())
    return F.when(any_null, F.lit(None).cast("string")).otherwise(F.sha2(joined, 256))


def model_run_event_id(provider, model_id, location_id, forecast_run_at) -> Column:
    """Model run identity: provider|model|location|run time (not retrieval time)."""
    return sha256_identity(F.trim(_col(provider)), F.trim(_col(model_id)),
                           _col(location_id), rfc3339(forecast_run_at))


def operational_event_id(source, location_id, retrieved_at) -> Column:
    return sha256_identity(_col(source), _col(location_id), rfc3339(retrieved_at))


def verification_event_id(source, kind, location_id, retrieved_at, first_valid, last_valid) -> Column:
    return sha256_identity(F.trim(_col(source)), _col(kind), _col(location_id),
                           rfc3339(retrieved_at), rfc3339(first_valid), rfc3339(last_valid))


def location_key(location_id) -> Column:
    """partition key of operational and verification events."""
    return _col(location_id).cast("string")


def location_model_key(location_id, model_id) -> Column:
    """partition key of model-run events, ``location:model``."""
    return F.concat_ws(":", _col(location_id).cast("string"), F.trim(_col(model_id)))


def period_bounds(hourly_array) -> tuple[Column, Column]:
    """First and last ``valid_at`` of an hourly array."""
    a = _col(hourly_array)
    return F.try_element_at(a, F.lit(1))["valid_at"], F.try_element_at(a, F.lit(-1))["valid_at"]
