"""Time arithmetic with UTC instants and IANA zones.

All instants are ``TimestampType`` in a UTC session.  Local calendar values
are derived explicitly with ``from_utc_timestamp``; a zone id that Java does not
know makes that expression fail the job (X5), so zone columns are checked with
:func:`valid_zone` (a join against the zones the JVM knows) before use.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MICROS_PER_HOUR = 3_600_000_000


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def utc_date(ts) -> Column:
    """calendar date of a UTC instant."""
    return F.to_date(_col(ts))


def local_date(ts, zone) -> Column:
    """calendar date of an instant in the zone held by another column."""
    return F.to_date(F.from_utc_timestamp(_col(ts), _col(zone)))


def local_wall_time(ts, zone) -> Column:
    return F.from_utc_timestamp(_col(ts), _col(zone))


def hours_between(later, earlier) -> Column:
    """F8: whole hours from ``earlier`` to ``later``, truncated toward zero."""
    return F.timestamp_diff("HOUR", _col(earlier), _col(later))


def lead_time_bucket(lead_hours) -> Column:
    """<=6, <=24, <=72, else (NULL also lands in the last bucket)."""
    c = _col(lead_hours)
    # Bucket labels.
    return (F.when(c <= 6, "00-06h").when(c <= 24, "07-24h")
            .when(c <= 72, "25-72h").otherwise("73h+"))


def lead_micros(valid_at, run_at) -> Column:
    return F.unix_micros(_col(valid_at)) - F.unix_micros(_col(run_at))


def wall_time_to_utc(text, zone, fmt: str = "yyyy-MM-dd'T'HH:mm") -> Column:
    """local wall-clock text in ``zone`` -> UTC instant (NULL if unparseable)."""
    local = F.try_to_timestamp(_col(text), F.lit(fmt))
    return F.to_utc_timestamp(local, _col(zone))


def is_iso_date(text) -> Column:
    """``YYYY-MM-DD`` that is a real calendar date (timestamps rejected)."""
    c = _col(text)
    return c.rlike(r"^\d{4}-\d{2}-\d{2}$") & F.try_to_timestamp(c, F.lit("yyyy-MM-dd")).isNotNull()


def try_date(text) -> Column:
    """ISO date text -> DateType, NULL when it is not a valid ``YYYY-MM-DD``."""
    c = _col(text)
    return F.when(is_iso_date(c), F.to_date(F.try_to_timestamp(c, F.lit("yyyy-MM-dd"))))


def whole_utc_hour(ts) -> Column:
    """Run times must sit on a whole UTC hour."""
    return F.unix_micros(_col(ts)) % MICROS_PER_HOUR == 0


def zone_table(spark: SparkSession) -> DataFrame:
    """Every zone id the JVM accepts, as a one-column DataFrame (about 600 rows,
    fixed by the JDK's tz database, so broadcasting it is size-bounded)."""
    jvm = spark.sparkContext._jvm
    ids = sorted(str(z) for z in jvm.java.time.ZoneId.getAvailableZoneIds())
    ids += ["UTC", "GMT", "Z"]
    return spark.createDataFrame([(z,) for z in sorted(set(ids))], "zone_id string")


def with_valid_zone(df: DataFrame, zone_col: str, spark: SparkSession | None = None,
                    flag: str = "zone_is_valid") -> DataFrame:
    """Add a boolean ``flag``: the zone column names a zone the JVM knows.

    Implemented as a left join against the bounded zone list (broadcast), so a
    bad zone becomes a failure row instead of failing the whole job (X5)."""
    spark = spark or df.sparkSession
    zones = F.broadcast(zone_table(spark).withColumn(flag, F.lit(True)))
    out = df.join(zones, F.trim(F.col(zone_col)) == zones["zone_id"], "left").drop("zone_id")
    return out.withColumn(flag, F.coalesce(F.col(flag), F.lit(False)))


def safe_local_date(ts, zone, zone_ok) -> Column:
    """Local date only where ``zone_ok``; NULL otherwise (never evaluates a bad zone)."""
    z = F.when(_col(zone_ok), _col(zone)).otherwise(F.lit("UTC"))
    return F.when(_col(zone_ok), local_date(ts, z))


def verification_target_date(reference_ts, zone, zone_ok, lag_days: int = 7) -> Column:
    """local date of the reference time minus ``lag_days``; NULL if the zone is bad."""
    return F.date_sub(safe_local_date(reference_ts, zone, zone_ok), lag_days)
