"""Location catalog operators (P12-P15, P20, K1, K2, J4, ST6, S7, F12, A14).

The reference answers these per request against a database; here each is a
DataFrame operator that works for one request or a whole table of them.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hindcast.functions.time import verification_target_date, with_valid_zone
from hindcast.operators.dedup import latest_per_key
from hindcast.operators.sequence import dense_index

# Search limits and the default allow-list of country codes.
DEFAULT_SEARCH_LIMIT = 10
MAX_SEARCH_LIMIT = 100
DEFAULT_ALLOWED_COUNTRY_CODES = ["ID", "SG", "MY", "TH", "VN", "PH", "JP", "KR", "CN"]


def clamp_limit(limit: int | None) -> int:
    if limit is None:
        return DEFAULT_SEARCH_LIMIT
    if limit < 1 or limit > MAX_SEARCH_LIMIT:
        raise ValueError(f"limit must be between 1 and {MAX_SEARCH_LIMIT}")
    return limit


def city_prefix(term: str) -> Column:
    """``lower(city) LIKE lower(term) || '%'`` (``%``/``_`` in the term act
    as wildcards, as in the reference)."""
    return F.like(F.lower(F.col("city")), F.concat(F.lower(F.lit(term)), F.lit("%")))


def search(locations: DataFrame, term: str, country_code: str = "", limit: int | None = None) -> DataFrame:
    """K1: prefix search, optional country, population desc NULLS LAST, city, id."""
    n = clamp_limit(limit)
    cc = country_code.strip().upper()
    cond = city_prefix(term)
    if cc:
        cond = cond & (F.col("country_code") == cc)
    return (locations.filter(cond)
            .orderBy(F.col("population").desc_nulls_last(), F.col("city").asc(), F.col("location_id").asc())
            .limit(n))


def normalize_country_codes(codes: Sequence[str]) -> list[str]:
    """Trim + upper; every code must have two letters."""
    out = []
    for c in codes:
        c = c.strip().upper()
        if len(c) != 2:
            raise ValueError(f"invalid country code {c!r}")
        out.append(c)
    if not out:
        raise ValueError("at least one country is required")
    return sorted(set(out))


def allowed_locations(locations: DataFrame, codes: Sequence[str] = DEFAULT_ALLOWED_COUNTRY_CODES) -> DataFrame:
    """Rows whose country code is on the allow-list (case-insensitive)."""
    allow = normalize_country_codes(codes)
    return locations.filter(F.upper(F.trim("country_code")).isin(allow))


def lookup(locations: DataFrame, requested_ids: DataFrame, id_col: str = "location_id") -> tuple[DataFrame, DataFrame]:
    """P20 in bulk: (found rows, missing ids).  Semi/anti joins, so the
    requested ids are never collected."""
    req = requested_ids.select(F.col(id_col).alias("location_id")).distinct()
    found = locations.join(req, "location_id", "left_semi")
    missing = req.join(locations.select("location_id"), "location_id", "left_anti")
    return found, missing


def due_for_forecast(locations: DataFrame, latest_current: DataFrame, stale_before: Column,
                     limit: int | None = None) -> DataFrame:
    """J4 + K2: locations with no latest forecast or one retrieved at or before
    ``stale_before``; oldest first (missing first), then id."""
    n = clamp_limit(limit)
    lat = latest_current.select("location_id", F.col("retrieved_at").alias("forecast_retrieved_at"))
    j = locations.join(lat, "location_id", "left")
    due = j.filter(F.col("forecast_retrieved_at").isNull() | (F.col("forecast_retrieved_at") <= stale_before))
    return due.orderBy(F.col("forecast_retrieved_at").asc_nulls_first(), F.col("location_id")).limit(n)


# ----------------------------------------------------------------------------- geocoding
GEOCODING_SCHEMA = ("struct<results array<struct<id bigint, name string, country string, country_code string, "
                    "latitude double, longitude double, timezone string, elevation double, population bigint, "
                    "admin1 string>>>")


def geocode_candidates(responses: DataFrame, body_col: str = "body") -> tuple[DataFrame, DataFrame]:
    """Landed geocoding responses -> (candidates, rejected responses).

    A response is rejected whole when any result lacks id, name, country, code
    or zone; otherwise each result becomes a candidate with a trimmed area
    (blank -> NULL) and an upper-case code."""
    r = responses.withColumn("__g", F.from_json(F.col(body_col), GEOCODING_SCHEMA))
    incomplete = F.exists(F.coalesce(F.col("__g.results"), F.array()), lambda x: (
        F.coalesce(x["id"], F.lit(0)) == 0) | (F.coalesce(x["name"], F.lit("")) == "")
        | (F.coalesce(x["country"], F.lit("")) == "") | (F.coalesce(x["country_code"], F.lit("")) == "")
        | (F.coalesce(x["timezone"], F.lit("")) == ""))
    r = r.withColumn("__incomplete", incomplete)
    rejected = r.filter("__incomplete").drop("__g", "__incomplete")
    good = r.filter(~F.col("__incomplete")).select(*[c for c in responses.columns], F.inline("__g.results"))
    cand = good.select(
        *[c for c in responses.columns if c != body_col],
        F.col("id").alias("open_meteo_location_id"),
        F.col("name").alias("city"), "country",
        F.upper("country_code").alias("country_code"),
        "latitude", "longitude", "timezone", "elevation", "population",
        F.nullif(F.trim("admin1"), F.lit("")).alias("administrative_area"),
    )
    return cand, rejected


# ----------------------------------------------------------------------------- rules, merge, snapshot
def location_violations(df: DataFrame) -> DataFrame:
    """Row rules of a location snapshot as a ``violations`` array."""
    rules = [
        (F.col("location_id").isNull() | (F.col("location_id") < 1), "invalid_location_id"),
        (F.col("open_meteo_location_id").isNull() | (F.col("open_meteo_location_id") <= 0), "invalid_provider_id"),
        (F.coalesce(F.trim("city"), F.lit("")) == "", "blank_city"),
        (F.coalesce(F.trim("country"), F.lit("")) == "", "blank_country"),
        (F.length(F.trim(F.coalesce("country_code", F.lit("")))) != 2, "invalid_country_code"),
        (F.col("latitude").isNull() | (F.col("latitude") < -90) | (F.col("latitude") > 90), "invalid_latitude"),
        (F.col("longitude").isNull() | (F.col("longitude") < -180) | (F.col("longitude") > 180), "invalid_longitude"),
        (F.coalesce(F.trim("timezone"), F.lit("")) == "", "blank_timezone"),
        (F.col("population") < 0, "negative_population"),
        (F.col("source_created_at").isNull() | F.col("source_updated_at").isNull(), "missing_source_timestamp"),
    ]
    codes = F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(code)) for c, code in rules]))
    return df.withColumn("violations", codes)


def validated_snapshot(snapshot: DataFrame, synced_at: Column) -> DataFrame:
    """Upper-case codes, stamp ``synced_at``; rows must satisfy the rules
    (``raise_error`` fails the job on the first bad row: all-or-nothing)."""
    v = location_violations(snapshot.withColumn("country_code", F.upper(F.trim("country_code"))))
    checked = v.withColumn("__ok", F.when(F.size("violations") == 0, F.lit(True)).otherwise(
        F.raise_error(F.concat(F.lit("invalid location snapshot row: "),
                               F.col("open_meteo_location_id").cast("string")))))
    return checked.filter("__ok").drop("__ok", "violations").withColumn("synced_at", synced_at)


def write_snapshot(snapshot: DataFrame, path: str, synced_at: Column) -> None:
    """Refuse an empty snapshot, then replace the table as a whole."""
    if snapshot.isEmpty():
        raise ValueError("refusing to replace locations with an empty snapshot")
    validated_snapshot(snapshot, synced_at).write.mode("overwrite").parquet(path)


def swap_snapshot(snapshot: DataFrame, table: str, root: str, synced_at: Column) -> str:
    """Replace catalog table ``table`` by the snapshot: (the folder that now holds it).

    The rows go to a new folder below ``root`` first; only when all are valid and written
    is the table pointed there, so readers see the old rows or the new ones, and an empty
    snapshot, a bad row or a lost driver leaves the table as it was."""
    spark = snapshot.sparkSession
    path = f"{root.rstrip('/')}/{uuid.uuid4().hex}"
    write_snapshot(snapshot, path, synced_at)
    if spark.catalog.tableExists(table):
        spark.sql(f"alter table {table} set location '{path}'")
        spark.catalog.refreshTable(table)
    else:
        spark.sql(f"create table {table} using parquet location '{path}'")
    return path


def merge_locations(existing: DataFrame, incoming: DataFrame, now: Column, arrival: str) -> DataFrame:
    """ST6: upsert by provider id.  Matched rows keep ``location_id`` and
    ``created_at`` and take the incoming attributes with ``updated_at = now``;
    new provider ids get ids after the current maximum, in provider-id order.
    Of several incoming rows of one provider id the one with the greatest
    ``arrival`` column counts.

    One full outer join on the provider id; new ids come from
    :func:`hindcast.operators.sequence.dense_index` (range-partitioned and written
    once, no single-task window) plus the existing maximum (a one-row aggregate)."""
    attrs = ["city", "country", "country_code", "latitude", "longitude", "timezone", "elevation",
             "population", "administrative_area"]
    inc = latest_per_key(incoming.select("open_meteo_location_id", *attrs,
                                         F.col(arrival).alias("__arrival")),
                         ["open_meteo_location_id"], [("__arrival", "desc")]).drop("__arrival")
    e = existing.alias("e")
    i = inc.alias("i")
    j = e.join(i, F.col("e.open_meteo_location_id") == F.col("i.open_meteo_location_id"), "full_outer")
    matched_or_old = j.filter(F.col("e.location_id").isNotNull()).select(
        F.col("e.location_id").alias("location_id"),
        F.col("e.open_meteo_location_id").alias("open_meteo_location_id"),
        *[F.when(F.col("i.open_meteo_location_id").isNotNull(), F.col(f"i.{a}")).otherwise(F.col(f"e.{a}")).alias(a)
          for a in attrs],
        F.col("e.created_at").alias("created_at"),
        F.when(F.col("i.open_meteo_location_id").isNotNull(), now).otherwise(F.col("e.updated_at")).alias("updated_at"),
    )
    new = j.filter(F.col("e.location_id").isNull()).select(
        F.col("i.open_meteo_location_id").alias("open_meteo_location_id"), *[F.col(f"i.{a}").alias(a) for a in attrs])
    base = existing.agg(F.coalesce(F.max("location_id"), F.lit(0)).alias("__base"))
    # ``base`` is a single-row aggregate: a bounded broadcast.
    new = dense_index(new, ["open_meteo_location_id"], "__idx").join(F.broadcast(base), how="inner")
    new = new.select((F.col("__base") + F.col("__idx")).alias("location_id"), "open_meteo_location_id", *attrs,
                     now.alias("created_at"), now.alias("updated_at"))
    return matched_or_old.unionByName(new)


# ----------------------------------------------------------------------------- verification cycle
def verification_targets(locations: DataFrame, reference_time: Column, lag_days: int = 7) -> DataFrame:
    """each location's target date = local date of the reference time minus
    ``lag_days``; an unknown zone yields ``status = 'failed'`` (not a crash)."""
    z = with_valid_zone(locations.select("location_id", "timezone"), "timezone")
    return z.select(
        "location_id", "timezone",
        verification_target_date(reference_time, "timezone", "zone_is_valid", lag_days).alias("target_date"),
        F.when(F.col("zone_is_valid"), F.lit("due")).otherwise(F.lit("failed")).alias("status"),
    )


def cycle_report(outcomes: DataFrame, status_col: str = "status") -> DataFrame:
    """Due / published / failed counts of one ingestion cycle."""
    return outcomes.groupBy(status_col).agg(F.count(F.lit(1)).alias("locations"))


def list_locations(locations: DataFrame) -> DataFrame:
    """K3: every location ordered by id (a global sort: range-partitioned by Spark)."""
    return locations.orderBy("location_id")
