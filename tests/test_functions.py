"""Scalar expressions against the hand-computed and documented cases."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from hindcast.functions import identity, json as J, metrics as M, time as T


def one(spark, col, data=None, schema="x int"):
    df = spark.createDataFrame(data or [(1,)], schema)
    return df.select(col.alias("v")).first()["v"]


def test_errors_and_brier(spark):
    rows = [(30.4, 29.4, 350.0, 10.0, 75.0, 0.2), (30.4, None, 10.0, 350.0, 75.0, 0.05),
            (None, 1.0, None, 1.0, 75.0, None), (1.0, 1.0, 0.0, 0.0, 75.0, 0.1)]
    df = spark.createDataFrame(rows, "f double, r double, fd double, rd double, p double, pr double")
    out = df.select(M.error("f", "r").alias("e"), M.absolute_error("f", "r").alias("a"),
                    M.squared_error("f", "r").alias("s"), M.circular_direction_error("fd", "rd").alias("d"),
                    M.brier_score("p", "pr").alias("b"), M.precipitation_occurred("pr").alias("o")).collect()
    assert out[0]["e"] == pytest.approx(1.0) and out[0]["a"] == pytest.approx(1.0)
    assert out[0]["s"] == pytest.approx(1.0)
    assert out[0]["d"] == pytest.approx(20.0) and out[1]["d"] == pytest.approx(20.0)
    assert out[0]["b"] == pytest.approx(0.0625) and out[1]["b"] == pytest.approx(0.5625)
    assert out[2]["b"] is None and out[2]["o"] is None and out[2]["d"] is None
    assert out[3]["o"] is True  # exactly 0.1 mm counts as occurred
    assert out[1]["e"] is None


def test_lead_bucket(spark):
    df = spark.createDataFrame([(-3,), (6,), (7,), (24,), (25,), (72,), (73,), (None,)], "l int")
    got = [r["b"] for r in df.select(T.lead_time_bucket("l").alias("b")).collect()]
    assert got == ["00-06h", "00-06h", "07-24h", "07-24h", "25-72h", "25-72h", "73h+", "73h+"]


def test_hours_between_truncates_toward_zero(spark):
    df = spark.createDataFrame([("2024-01-01 01:59:59", "2024-01-01 00:00:00"),
                                ("2024-01-01 00:00:00", "2024-01-01 01:59:59")], "a string, b string")
    df = df.select(F.col("a").cast("timestamp").alias("a"), F.col("b").cast("timestamp").alias("b"))
    assert [r["h"] for r in df.select(T.hours_between("a", "b").alias("h")).collect()] == [1, -1]


def test_identity_uses_run_time_not_retrieval(spark):
    df = spark.createDataFrame([("ECMWF", "ecmwf_ifs", 3, "2026-09-19 00:00:00"),
                                ("ECMWF", "ecmwf_ifs", 3, "2026-09-19 06:00:00")],
                               "p string, m string, l long, r string")
    df = df.withColumn("r", F.col("r").cast("timestamp"))
    ids = [x["id"] for x in df.select(identity.model_run_event_id("p", "m", "l", "r").alias("id")).collect()]
    assert ids[0] != ids[1] and len(ids[0]) == 64
    import hashlib
    assert ids[0] == hashlib.sha256(b"ECMWF|ecmwf_ifs|3|2026-09-19T00:00:00Z").hexdigest()


def test_rfc3339_trims_fraction(spark):
    df = spark.createDataFrame([("2026-09-19 00:00:00.500000",), ("2026-09-19 00:00:00",)], "t string")
    got = [r["v"] for r in df.select(identity.rfc3339(F.col("t").cast("timestamp")).alias("v")).collect()]
    assert got == ["2026-09-19T00:00:00.5Z", "2026-09-19T00:00:00Z"]


def test_json_semantics(spark):
    df = spark.createDataFrame([('{"a": "21.5", "b": {"x": 1}, "c": "1", "d": true, "e": 3.7}',)], "j string")
    p = J.parse_text_fields("j", ["a", "b", "c", "d", "e"])
    r = df.select(p.alias("p")).select(
        J.safe_cast(J.scalar_only(F.col("p.a")), "double").alias("a"),
        J.scalar_only(F.col("p.b")).alias("b"),
        J.safe_cast(J.scalar_only(F.col("p.c")), "boolean").alias("c"),
        J.safe_cast(J.scalar_only(F.col("p.d")), "boolean").alias("d"),
        J.safe_cast(J.scalar_only(F.col("p.e")), "bigint").alias("e"),
        J.json_query_array(F.lit('{"a": 1}')).alias("obj"),
    ).first()
    assert r["a"] == 21.5 and r["b"] is None and r["c"] is None and r["d"] is True
    assert r["e"] is None and r["obj"] is None


def test_verification_target_dates_and_bad_zone(spark):
    df = spark.createDataFrame([("Asia/Jakarta",), ("Asia/Tokyo",), ("Invalid/Timezone",)], "z string")
    df = df.withColumn("ref", F.lit("2026-09-22 16:00:00").cast("timestamp"))
    df = T.with_valid_zone(df, "z")
    got = {r["z"]: r["d"] for r in df.select("z", T.verification_target_date("ref", "z", "zone_is_valid", 7)
                                              .alias("d")).collect()}
    assert got["Asia/Jakarta"] == dt.date(2026, 9, 15)
    assert got["Asia/Tokyo"] == dt.date(2026, 9, 16)
    assert got["Invalid/Timezone"] is None


def test_wall_time_to_utc(spark):
    df = spark.createDataFrame([("2026-09-17T13:00", "Asia/Jakarta"), ("bad", "Asia/Jakarta")], "t string, z string")
    got = [r["u"] for r in df.select(T.wall_time_to_utc("t", "z").alias("u")).collect()]
    assert got[0] == dt.datetime(2026, 9, 17, 6, 0) and got[1] is None
