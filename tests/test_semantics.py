"""Behaviour cases documented for the reference system, on small fixtures."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from hindcast.operators import derived as D
from hindcast.operators import latest as L
from hindcast.operators import locations as LOC
from hindcast.operators.quality import Check, report
from hindcast.sources import raw as RAW
from hindcast.sources import response as R
from hindcast.sources.logs import Admission


def _event(eid, retrieved, temp, loc=3):
    return json.dumps({
        "event_id": eid, "event_type": "forecast.latest.snapshot", "schema_version": 1,
        "occurred_at": retrieved,
        "data": {"location_id": loc, "source": "best_match", "retrieved_at": retrieved, "timezone": "Asia/Jakarta",
                 "current": {"valid_at": "2026-09-18T07:00:00Z", "interval_seconds": 900, "temperature_2m": temp,
                             "is_day": True},
                 "hourly": [{"valid_at": "2026-09-18T08:00:00Z", "temperature_2m": temp,
                             "relative_humidity_2m": 75}],
                 "daily": [{"date": "2026-09-18", "temperature_2m_max": 32.2, "temperature_2m_min": 25.1}]}})


def _log(spark, rows):
    data = [("forecast.latest", 0, off, "3", dt.datetime(2026, 9, 18, 8, 0) + dt.timedelta(minutes=off), v)
            for off, v in rows]
    return spark.createDataFrame(data, "topic string, partition int, offset long, key string, timestamp timestamp, "
                                       "value string")


def test_latest_strictly_newer_rule(spark):
    first = _event("a", "2026-09-18T07:00:00Z", 30.0)
    dup = _event("a2", "2026-09-18T07:00:00Z", 99.0)       # same retrieval time, later arrival
    older = _event("b", "2026-09-18T06:00:00Z", 98.0)
    newer = _event("c", "2026-09-18T08:00:00Z", 31.5)
    state = None
    winners = []
    for i, v in enumerate([first, dup, older, newer]):
        ev = L.hot_state_violations(L.decode_latest_events(_log(spark, [(i, v)])))
        assert ev.first()["violations"] == []
        ev = ev.drop("violations")
        state = L.latest_snapshots(ev) if state is None else L.merge_latest(state, ev)
        state = spark.createDataFrame(state.collect(), state.schema)
        winners.append(state.first()["event_id"])
    assert winners == ["a", "a", "a", "c"]
    hourly = L.latest_hourly(state).collect()
    daily = L.latest_daily(state).collect()
    assert len(hourly) == 1 and hourly[0]["temperature_2m"] == 31.5 and len(daily) == 1


def test_hot_rules_reject_bad_event(spark):
    bad = json.loads(_event("x", "2026-09-18T07:00:00Z", 1.0))
    bad["data"]["current"]["interval_seconds"] = 0
    bad["data"]["daily"][0]["date"] = "2026-09-18T00:00:00Z"
    ev = L.hot_state_violations(L.decode_latest_events(_log(spark, [(0, json.dumps(bad)), (1, "not-json")])))
    codes = [set(r["violations"]) for r in ev.orderBy("offset").collect()]
    assert {"invalid_interval", "daily_bad_date"} <= codes[0]
    assert "invalid_json" in codes[1]


def _locs(spark, rows):
    return spark.createDataFrame(rows, "location_id long, open_meteo_location_id long, city string, country string, "
                                       "country_code string, latitude double, longitude double, timezone string, "
                                       "elevation double, population long, administrative_area string, "
                                       "created_at timestamp, updated_at timestamp")


def test_location_upsert_keeps_surrogate_and_search(spark):
    t0 = dt.datetime(2026, 1, 1)
    existing = _locs(spark, [(1, 1642911, "Jakarta", "Indonesia", "ID", -6.2, 106.8, "Asia/Jakarta", 8.0,
                              10_000_000, None, t0, t0)])
    incoming = spark.createDataFrame(
        [(1642911, "Repository City", "Indonesia", "id", -6.2, 106.8, "Asia/Jakarta", 8.0, 10_000_000, None),
         (999, "Repository Town", "Indonesia", "ID", -6.0, 106.0, "Asia/Jakarta", None, None, " ")],
        "open_meteo_location_id long, city string, country string, country_code string, latitude double, "
        "longitude double, timezone string, elevation double, population long, administrative_area string")
    incoming = incoming.withColumn("country_code", F.upper("country_code"))
    now = F.lit("2026-02-01 00:00:00").cast("timestamp")
    merged = LOC.merge_locations(existing, incoming.withColumn("at", F.lit(1)), now, arrival="at")
    rows = {r["open_meteo_location_id"]: r for r in merged.collect()}
    assert rows[1642911]["location_id"] == 1 and rows[1642911]["city"] == "Repository City"
    assert rows[1642911]["country_code"] == "ID" and rows[1642911]["created_at"] == t0
    assert rows[999]["location_id"] == 2
    found = LOC.search(merged, "repository c").collect()
    assert [r["city"] for r in found] == ["Repository City"]
    with pytest.raises(ValueError):
        LOC.clamp_limit(101)


def test_due_list(spark):
    t0 = dt.datetime(2026, 1, 1)
    locs = _locs(spark, [(i, i, f"C{i}", "X", "XX", 0.0, 0.0, "UTC", None, None, None, t0, t0) for i in (1, 2, 3)])
    latest = spark.createDataFrame([(2, dt.datetime(2026, 1, 1, 11)), (3, dt.datetime(2026, 1, 1, 8))],
                                   "location_id long, retrieved_at timestamp")
    due = LOC.due_for_forecast(locs, latest, F.lit("2026-01-01 10:00:00").cast("timestamp"), 10)
    assert [r["location_id"] for r in due.collect()] == [1, 3]


def test_freshness_threshold(spark):
    df = spark.createDataFrame([(dt.datetime(2026, 1, 1, 10, 0),), (dt.datetime(2026, 1, 1, 9, 59),)], "r timestamp")
    now = F.lit("2026-01-01 12:00:00").cast("timestamp")
    assert [x["s"] for x in df.select(D.is_stale("r", now).alias("s")).collect()] == [False, True]


def test_condition_mapping(spark):
    codes = [0, 2, 48, 55, 57, 63, 67, 75, 77, 81, 86, 95, 99, 4, None]
    df = spark.createDataFrame([(c,) for c in codes], "c int")
    got = [r["n"] for r in df.select(D.condition("c").alias("n")).collect()]
    assert got == ["clear", "partlyCloudy", "fog", "drizzle", "freezingDrizzle", "rain", "freezingRain", "snow",
                   "snowGrains", "rainShowers", "snowShowers", "thunderstorm", "thunderstormWithHail", "unknown",
                   "unknown"]


def _sun_frame(spark, zone="Asia/Jakarta", with_sun=True):
    daily = [{"date": "2026-09-20", "sunrise": dt.datetime(2026, 9, 19, 22, 43) if with_sun else None,
              "sunset": dt.datetime(2026, 9, 20, 10, 49) if with_sun else None}]
    return spark.createDataFrame([(1, zone, daily, {"is_day": False})],
                                 "location_id int, timezone string, daily array<struct<date string, sunrise timestamp, "
                                 "sunset timestamp>>, current struct<is_day boolean>")


@pytest.mark.parametrize("now,period,daylight", [
    ("2026-09-19 23:30:00", "morning", True), ("2026-09-20 05:00:00", "day", True),
    ("2026-09-20 10:00:00", "evening", True), ("2026-09-20 15:35:00", "night", False)])
def test_day_period_and_daylight(spark, now, period, daylight):
    n = F.lit(now).cast("timestamp")
    c = D.with_city_clock(_sun_frame(spark), n)
    t = D.todays_daily("daily", "city_now")
    r = c.select(D.day_period(n, "city_now", t, "current.is_day").alias("p"),
                 D.is_daylight(n, "city_now", t, "current.is_day").alias("d")).first()
    assert (r["p"], r["d"]) == (period, daylight)


def test_daylight_fallbacks(spark):
    n = F.lit("2026-09-20 15:00:00").cast("timestamp")  # 22:00 in Jakarta
    c = D.with_city_clock(_sun_frame(spark, with_sun=False), n)
    assert c.select(D.is_daylight(n, "city_now", D.todays_daily("daily", "city_now"),
                                  "current.is_day").alias("d")).first()["d"] is False
    c = D.with_city_clock(_sun_frame(spark, zone="Invalid/Timezone"), n)
    assert c.select(D.is_daylight(n, "city_now", D.todays_daily("daily", "city_now"),
                                  "current.is_day").alias("d")).first()["d"] is False  # falls back to is_day


def test_nearest_hour_fill(spark):
    hourly = [{"valid_at": dt.datetime(2026, 1, 1, 0, 0), "precipitation_probability": 40.0, "uv_index": 6.2,
               "visibility": 12000.0, "cloud_cover": 10.0},
              {"valid_at": dt.datetime(2026, 1, 1, 1, 0), "precipitation_probability": 90.0, "uv_index": 1.0,
               "visibility": 1.0, "cloud_cover": 99.0}]
    schema = ("current struct<valid_at timestamp, precipitation_probability double, uv_index double, "
              "visibility double, cloud_cover double, pressure_msl double, wind_gusts_10m double>, "
              "hourly array<struct<valid_at timestamp, precipitation_probability double, uv_index double, "
              "visibility double, cloud_cover double, pressure_msl double, wind_gusts_10m double>>")
    cur = {"valid_at": dt.datetime(2026, 1, 1, 0, 10), "cloud_cover": 55.0}
    df = spark.createDataFrame([(cur, hourly)], schema)
    r = df.select(*D.fill_current("current", D.nearest_hour("hourly", "current.valid_at"))).first()
    assert r["precipitation_probability"] == 40.0 and r["uv_index"] == 6.2 and r["visibility"] == 12000.0
    assert r["cloud_cover"] == 55.0


def test_quality_checks_catch_broken_copies(spark):
    df = spark.createDataFrame([(1, "a", "reanalysis"), (1, None, "forecast"), (2, "b", None)],
                               "id long, city string, kind string")
    dim = spark.createDataFrame([(1,)], "id long")
    checks = [Check("not_null", "t", "city"), Check("unique", "t", "id"),
              Check("accepted_values", "t", "kind", values=["reanalysis"]),
              Check("relationships", "t", "id", to_table="d", to_column="id"),
              Check("grain", "t", keys=["id", "kind"], name="grain"),
              Check("expression", "t", condition="id > 1", name="range")]
    got = {(r["check_name"], r["column_name"]): r["failing_rows"] for r in report(checks, {"t": df, "d": dim}).collect()}
    assert got[("not_null", "city")] == 1 and got[("unique", "id")] == 1
    assert got[("accepted_values", "kind")] == 1 and got[("relationships", "id")] == 1
    assert got[("grain", "id,kind")] == 0 and got[("range", "")] == 1


def _mr_value(lead=12, key_loc=3):
    return json.dumps({"event_id": "e1", "event_type": "forecast.model_run.snapshot", "schema_version": 1,
                       "occurred_at": "2026-09-19T00:30:00Z",
                       "data": {"location_id": key_loc, "model": {"model_id": "ecmwf_ifs", "model_name": "ECMWF IFS",
                                                                  "provider": "ECMWF", "resolution_km": 9},
                                "forecast_run_at": "2026-09-19T00:00:00Z", "retrieved_at": "2026-09-19T00:30:00Z",
                                "hourly": [{"valid_at": "2026-09-19T12:00:00Z", "lead_time_hours": lead,
                                            "temperature_2m": 30.4}]}})


def test_raw_rules_and_strict_batch(spark):
    rows = [("forecast.runs", 0, 1, "3:ecmwf_ifs", dt.datetime(2026, 9, 19, 0, 30), _mr_value()),
            ("forecast.runs", 0, 2, "3:ecmwf_ifs", dt.datetime(2026, 9, 19, 0, 30), _mr_value(lead=11)),
            ("forecast.runs", 0, 3, "wrong-key", dt.datetime(2026, 9, 19, 0, 30), _mr_value()),
            ("forecast.runs", 0, 4, "3:ecmwf_ifs", dt.datetime(2026, 9, 19, 0, 30), "not-json")]
    log = spark.createDataFrame(rows, "topic string, partition int, offset long, key string, timestamp timestamp, "
                                      "value string")
    mapped = RAW.model_run_rows(log, F.col("timestamp"))
    codes = [r["violations"] for r in mapped.orderBy("kafka_offset").collect()]
    assert codes == [[], ["lead_time_mismatch"], ["key_mismatch"], ["invalid_json"]]
    good, bad = RAW.quarantine(mapped)
    assert good.count() == 1 and bad.count() == 3
    with pytest.raises(Exception):
        RAW.strict(mapped).collect()
    # A consumer that reads no column still runs the checks (nothing pruned away).
    with pytest.raises(Exception):
        RAW.strict(mapped).count()
    with pytest.raises(Exception):
        RAW.strict(mapped).select("kafka_offset").collect()
    # a rule for the makers of events does not stop a consumer
    assert RAW.strict(mapped.filter("kafka_offset <= 2")).count() == 2


def _full_daily(**changed):
    """A daily block of one day; ``changed`` series replace its own, None removes one."""
    from hindcast.sources.response import DAILY_SERIES, _daily_key
    d = {"time": ["2026-09-17"]} | {_daily_key(x): [None] for x in DAILY_SERIES}
    d |= {"sunrise": ["2026-09-17T05:45"], "temperature_2m_max": [32.1]} | changed
    return {k: v for k, v in d.items() if v is not None}


def _resp(spark, hourly, tz="Asia/Jakarta"):
    body = json.dumps({"timezone": tz, "hourly": hourly, "daily": _full_daily()})
    return spark.createDataFrame([(1, dt.datetime(2026, 9, 17, 6, 0), body)], "location_id int, run_at timestamp, "
                                                                              "body string")


def _full_hourly(n=2):
    from hindcast.schemas import METRICS
    h = {"time": ["2026-09-17T13:00", "2026-09-17T14:00"][:n]}
    for m in METRICS:
        h[m] = [1] * n if m in ("is_day", "weather_code") else [1.0] * n
    h["temperature_2m"] = [30.4, None][:n]
    return h


def test_response_mapping(spark):
    p = R.with_violations(R.parse_responses(_resp(spark, _full_hourly())), ["precipitation_probability"])
    assert p.first()["violations"] == []
    rows = R.hourly_rows(p, ["location_id"], run_at=F.col("run_at")).orderBy("valid_at").collect()
    assert rows[0]["valid_at"] == dt.datetime(2026, 9, 17, 6, 0) and rows[0]["lead_time_hours"] == 0
    assert rows[0]["is_day"] is True and rows[1]["temperature_2m"] is None
    daily = R.daily_rows(p, ["location_id"]).first()
    assert daily["sunrise"] == dt.datetime(2026, 9, 16, 22, 45) and daily["temperature_2m_max"] == 32.1


def test_response_rejections(spark):
    short = _full_hourly()
    short["wind_gusts_10m"] = [1.0]
    absent = _full_hourly()
    del absent["precipitation_probability"]
    partial = _full_hourly()
    partial["precipitation_probability"] = [1.0]
    bad_day = _full_hourly()
    bad_day["is_day"] = [2, 1]
    opt = ["precipitation_probability"]

    def codes(h, optional):
        return R.with_violations(R.parse_responses(_resp(spark, h)), optional).first()["violations"]
    assert codes(short, opt) == ["series_length:wind_gusts_10m"]
    assert codes(absent, opt) == []
    assert codes(absent, []) == ["missing_series:precipitation_probability"]
    assert codes(partial, opt) == ["series_length:precipitation_probability"]
    assert codes(bad_day, opt) == ["invalid_is_day"]
    def codes_of(**blocks):
        blocks = {k: v for k, v in ({"daily": _full_daily()} | blocks).items() if v is not None}
        body = json.dumps({"timezone": "Asia/Jakarta", "hourly": _full_hourly(), **blocks})
        df = spark.createDataFrame([(1, body)], "location_id int, body string")
        return R.with_violations(R.parse_responses(df), opt).first()["violations"]
    assert codes_of() == []
    assert codes_of(daily=None) == codes_of(daily={}) == ["empty_daily_time"]  # an absent block has no dates
    assert codes_of(daily=_full_daily(sunset=["late"])) == ["invalid_daily_time:sunset"]
    assert codes_of(daily=_full_daily(uv_index_max=None, precipitation_sum=[])) == [
        "daily_series_length:precipitation_sum", "missing_daily_series:uv_index_max"]
    assert codes_of(daily=_full_daily(time=["2026-09-17T00:00"])) == codes_of(daily=_full_daily(time=[None])) == ["invalid_daily_date"]
    assert codes_of(current={"interval": 900, "is_day": 3}) == ["invalid_current_time", "invalid_current_is_day"]
    assert codes_of(current={"time": "2026-09-17T13:15", "is_day": 1}) == []
    p = R.with_violations(R.parse_responses(_resp(spark, absent)), opt)
    assert R.hourly_rows(p, ["location_id"]).first()["precipitation_probability"] is None


def test_verification_response_needs_its_13_series(spark):
    from hindcast.schemas import METRICS, VERIFICATION_SERIES

    def parsed(**changed):
        h = {k: v for k, v in _full_hourly().items() if k == "time" or k in VERIFICATION_SERIES} | changed
        body = json.dumps({"timezone": "Asia/Jakarta", "hourly": {k: v for k, v in h.items() if v is not None}})
        p = R.parse_responses(spark.createDataFrame([(1, body)], "location_id int, body string"))
        return p.withColumn("violations", R.verification_violations())
    codes = lambda **c: parsed(**c).first()["violations"]
    assert codes() == []
    for m in VERIFICATION_SERIES:
        assert codes(**{m: None}) == [f"missing_series:{m}"] and f"series_length:{m}" in codes(**{m: [1]})
    same = ["2026-09-17T13:00"] * 2
    assert codes(time=same) == codes(time=["2026-09-17T14:00", "2026-09-17T13:00"]) == ["unordered_hourly_time"]
    assert codes(time=[]) [0] == "empty_hourly_time" and "invalid_time" in codes(time=["2026-09-17T13:00", "soon"])
    rows = R.verification_rows(parsed(), ["location_id"]).orderBy("valid_at").collect()
    assert [r.valid_at.hour for r in rows] == [6, 7]
    assert all(rows[0][m] is None for m in METRICS if m not in VERIFICATION_SERIES) and rows[0]["rain"] == 1.0


def test_empty_snapshot_refused(spark, tmp_path):
    empty = spark.createDataFrame([], "location_id long, open_meteo_location_id long, city string, country string, "
                                      "country_code string, latitude double, longitude double, timezone string, "
                                      "population long")
    with pytest.raises(ValueError):
        LOC.write_snapshot(empty, str(tmp_path / "snap"), F.current_timestamp())


def test_replay_safe_load_replaces_its_batch(spark, tmp_path):
    from hindcast.sources.sinks import export_json_lines, replay_safe_load
    df = spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string")
    path = str(tmp_path / "t")
    replay_safe_load(df, path, 7)
    replay_safe_load(df, path, 7)            # the same batch again: no duplicates
    replay_safe_load(df.limit(1), path, 8)
    assert spark.read.parquet(path).count() == 3
    export_json_lines(df, str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).count() == 2


def test_cold_path_topics_fail_independently(spark, tmp_path):
    from hindcast.streaming import cold_path, io
    good = ("forecast.runs", 0, 1, "3:ecmwf_ifs", dt.datetime(2026, 9, 19, 0, 30), _mr_value())
    bad = ("weather.verification", 0, 1, "3", dt.datetime(2026, 9, 19, 0, 30), "not-json")
    log = spark.createDataFrame([good, bad], "topic string, partition int, offset long, key string, "
                                             "timestamp timestamp, value string")
    root = str(tmp_path)
    io.append_log(log, f"{root}/log", "timestamp")
    status = cold_path.start_cold_path(spark, lambda topic: io.log_stream(spark, f"{root}/log", topic=topic),
                                       f"{root}/raw", f"{root}/ck")
    assert status["model_run_events"] == "ok"
    assert status["verification_weather_events"].startswith("failed")
    assert spark.read.parquet(f"{root}/raw/model_run_events").count() == 1


def test_missing_envelope_fields_are_refused(spark):
    for field, code in [("event_type", "unsupported_event_type"), ("schema_version", "unsupported_schema_version")]:
        body = json.loads(_mr_value())
        del body[field]
        rec = spark.createDataFrame([("forecast.runs", 0, 1, "3:ecmwf_ifs", dt.datetime(2026, 9, 19), json.dumps(body))],
                                    "topic string, partition int, offset long, key string, timestamp timestamp, value string")
        got = RAW.model_run_rows(rec, F.col("timestamp")).collect()[0]["violations"]
        assert code in got, (field, got)


def test_stateful_latest_update_mode(spark, tmp_path):
    from hindcast.streaming import io, state
    rows = [(0, _event("a", "2026-09-18T07:00:00Z", 30.0)), (1, _event("b", "2026-09-18T06:00:00Z", 1.0)),
            (2, _event("c", "2026-09-18T08:00:00Z", 31.5)), (3, _event("c2", "2026-09-18T08:00:00Z", 2.0))]
    io.append_log(_log(spark, rows), str(tmp_path / "log"), "timestamp", 2)
    ev = L.decode_latest_events(io.log_stream(spark, str(tmp_path / "log"), Admission(n_bytes=1))).select(
        "location_id", "retrieved_at", "timestamp", "partition", "offset", "event_id")
    q = (state.stateful_latest(ev).writeStream.outputMode("update").format("memory")
         .queryName("latest_update_mode_test").option("checkpointLocation", str(tmp_path / "ck"))
         .trigger(availableNow=True).start())
    q.awaitTermination()
    got = spark.sql("select latest.event_id as e from latest_update_mode_test").collect()
    assert got[-1]["e"] == "c"   # newest retrieval wins; the equal one that arrived later does not
