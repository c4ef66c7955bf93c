"""Streams: admission, state that follows the batch, late rows, loads by content."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from hindcast.operators import latest as L
from hindcast.sources import sinks as S
from hindcast.sources.logs import Admission
from hindcast.streaming import io, late, state

from .test_semantics import _event

LOG = "topic string, partition int, offset long, key string, timestamp timestamp, value string"
T0 = dt.datetime(2026, 9, 18, 8, 0)


def records(spark, rows):
    """(location, offset, event id, retrieved hour, temperature) -> log records."""
    return spark.createDataFrame([("forecast.latest", 0, o, str(loc), T0 + dt.timedelta(minutes=o),
                                   _event(e, f"2026-09-18T{h:02d}:00:00Z", temp, loc)) for loc, o, e, h, temp in rows], LOG)


def test_admission_closes_a_batch_by_bytes(spark, tmp_path):
    rows = [(n, n, f"e{n}", 7, 1.0) for n in range(40)]
    for k in range(8):
        records(spark, rows[k * 5:k * 5 + 5]).coalesce(1).write.mode("append").partitionBy("topic").parquet(str(tmp_path / "log"))
    one = max(p.stat().st_size for p in (tmp_path / "log").rglob("*.parquet"))
    for admission, batches in ((Admission(n_bytes=1), 8), (Admission(n_bytes=one * 4 + one // 2), 2), (Admission(), 1)):
        sizes = []
        s = io.log_stream(spark, str(tmp_path / "log"), admission, topic="forecast.latest")
        q = io.run_available_now(s.writeStream.foreachBatch(io.where_not_empty(lambda b, i: sizes.append(b.count())))
                                 .option("checkpointLocation", str(tmp_path / f"ck{batches}")))
        assert q.exception() is None and sum(sizes) == 40 and len(sizes) == batches
    assert Admission().of_kafka() == {"minOffsetsPerTrigger": "500", "maxOffsetsPerTrigger": "500", "maxTriggerDelay": "1h"}


def test_empty_batches_are_skipped(spark, tmp_path):
    records(spark, [(1, 1, "a", 7, 1.0)]).write.partitionBy("topic").parquet(str(tmp_path / "log"))
    seen = []
    s = io.log_stream(spark, str(tmp_path / "log")).where("offset > 5")
    io.run_available_now(s.writeStream.foreachBatch(io.where_not_empty(lambda b, i: seen.append(i)))
                         .option("checkpointLocation", str(tmp_path / "ck")))
    assert seen == []


def test_a_log_is_read_in_the_order_of_its_appends(spark, tmp_path):
    rows = spark.range(100).select(F.lit("t").alias("topic"), F.lit(0).alias("partition"), F.col("id").alias("offset"), F.lit("k").alias("key"),
                                   F.when(F.col("id") > 0, F.timestamp_seconds(F.col("id") * 37 % 101)).alias("timestamp"), F.lit("v").alias("value"))
    io.append_log(rows.repartition(3), str(tmp_path / "log"), "timestamp", 4)
    seen = []
    io.run_available_now(io.log_stream(spark, str(tmp_path / "log"), Admission(n_bytes=1)).writeStream.foreachBatch(
        lambda b, i: seen.extend(sorted((r.timestamp is not None, r.timestamp) for r in b.select("timestamp").collect())))
        .option("checkpointLocation", str(tmp_path / "ck")))
    order = [t for known, t in seen if known]
    assert len(seen) == 100 and seen.count((False, None)) == 1 and max(order[:20]) < min(order[-20:])


def current(spark, path):
    return {r.location_id: (r.event_id, r.current.temperature_2m) for r in state.current_state(spark, path).collect()}


def test_state_follows_the_batch(spark, tmp_path):
    root = str(tmp_path)
    run = lambda: state.run_latest_state(spark, io.log_stream(spark, f"{root}/log"), f"{root}/state", f"{root}/ck")
    land = lambda rows: records(spark, rows).write.mode("append").partitionBy("topic").parquet(f"{root}/log")
    land([(n, n, f"a{n}", 7, 1.0) for n in range(1, 41)] + [(50, 60, "bad", 7, 1.0)])
    run()
    assert len(current(spark, f"{root}/state")) == 41
    # newer, equal and older events, one without a location: only the newer one counts
    land([(3, 100, "newer", 9, 5.0), (4, 101, "equal", 7, 6.0), (5, 102, "older", 6, 7.0), (0, 103, "refused", 9, 8.0)])
    run()
    got = current(spark, f"{root}/state")
    assert got[3] == ("newer", 5.0) and got[4] == ("a4", 1.0) and got[5] == ("a5", 1.0) and 0 not in got and len(got) == 41
    changes = {r.batch_id: r["count"] for r in spark.read.parquet(f"{root}/state").groupBy("batch_id").count().collect()}
    assert changes == {0: 41, 1: 3}  # the second batch wrote its own locations, not the state
    # a replay of a batch replaces its own changes
    again = spark.read.parquet(f"{root}/state").where("batch_id = 1").select("topic", "partition", "offset", "key", "timestamp")
    batch = state.latest_changes(spark.read.parquet(f"{root}/log").join(again.select("offset"), "offset", "left_semi"))
    state.change_writer(f"{root}/state")(batch, 1)
    assert current(spark, f"{root}/state")[3] == ("newer", 5.0)
    assert spark.read.parquet(f"{root}/state").where("batch_id = 1").count() == 3
    state.fold_changes(spark, f"{root}/state", f"{root}/folded")
    assert current(spark, f"{root}/folded").keys() == got.keys()
    hours = L.latest_hourly(state.current_state(spark, f"{root}/state")).where("location_id = 3").collect()
    assert [h.temperature_2m for h in hours] == [5.0]


def test_state_goes_on_after_a_failed_batch(spark, tmp_path, monkeypatch):
    root = str(tmp_path)
    run = lambda: state.run_latest_state(spark, io.log_stream(spark, f"{root}/log"), f"{root}/state", f"{root}/ck")
    land = lambda rows: records(spark, rows).write.mode("append").partitionBy("topic").parquet(f"{root}/log")
    land([(1, 1, "a", 7, 1.0), (2, 2, "b", 7, 1.0)])
    run()
    land([(1, 3, "c", 8, 2.0)])
    real = state.replay_safe_load

    def dies(*a):
        real(*a)
        raise RuntimeError("after the write, before the commit")
    monkeypatch.setattr(state, "replay_safe_load", dies)
    with pytest.raises(Exception):
        run()
    monkeypatch.setattr(state, "replay_safe_load", real)
    land([(2, 4, "d", 9, 3.0)])
    run()
    assert current(spark, f"{root}/state") == {1: ("c", 2.0), 2: ("d", 3.0)}


def hour(day, h=0):
    return dt.datetime(2024, 1, 1) + dt.timedelta(days=day, hours=h)


def test_late_rows_are_dropped_and_counted(spark, tmp_path):
    f = [(f"f{d}", 1, hour(d), hour(d - 1), 1.0 * d) for d in range(30)]
    v = [(f"v{d}.{s}", 1, hour(d), hour(d + 7 + s), hour(d + 7 + s), 2.0 * d + s) for d in range(30) for s in (1, 2, 3)]
    fc = spark.createDataFrame(f, "forecast_event_id string, location_id long, valid_at timestamp, retrieved_at timestamp, ft double")
    vr = spark.createDataFrame(v, "verification_event_id string, location_id long, valid_at timestamp, retrieved_at timestamp, ingested_at timestamp, rt double")
    told = late.run_by_arrival(spark, fc, vr, "retrieved_at", str(tmp_path), "1 day")
    week = lambda t: (t - dt.timedelta(days=t.weekday())).date()
    weeks = sorted({week(x[3]) for x in f} | {week(x[3]) for x in v})
    mark, drops, kept = None, {}, set()
    for w in weeks:
        mine_f, mine_v = [x for x in f if week(x[3]) == w], [x for x in v if week(x[3]) == w]
        late_row = lambda x: mark is not None and x[2] <= mark
        drops[w] = sum(map(late_row, mine_f + mine_v))
        kept |= {x[0] for x in mine_f + mine_v if not late_row(x)}
        if mine_f and mine_v:
            edge = min(max(x[2] for x in mine_f), max(x[2] for x in mine_v)) - dt.timedelta(days=1)
            mark = edge if mark is None else max(mark, edge)
    assert {p.date(): n for p, n in told} == drops and sum(drops.values()) > 0
    got = {(r.forecast_event_id, r.verification_event_id) for r in spark.read.parquet(str(tmp_path / "matches")).collect()}
    assert got == {(a[0], b[0]) for a in f for b in v if a[2] == b[2] and a[0] in kept and b[0] in kept}


def test_a_load_is_known_by_its_rows(spark, tmp_path):
    rows = spark.range(500).select("id", F.when(F.col("id") % 3 == 0, F.lit("x")).alias("a"), F.when(F.col("id") % 3 == 1, F.lit("x")).alias("b"),
                                   F.current_timestamp().alias("ingested_at"), (F.col("id") % 4).alias("day"))
    path, ledger = str(tmp_path / "t"), str(tmp_path / "l")
    name, written = S.load_once(rows, path, ledger, "p", ["day"])
    assert written and name.startswith("p-")
    other = rows.repartition(7).orderBy(F.desc("id")).withColumn("ingested_at", F.lit("2020-01-01").cast("timestamp"))
    assert S.load_once(other, path, ledger, "p", ["day"]) == (name, False)
    for changed in (rows.where("id <> 7"), rows.union(rows.where("id = 7")), rows.union(rows.where("id = 7")).union(rows.where("id = 7")),
                    rows.withColumns({"a": F.col("b"), "b": F.col("a")}), rows.limit(0)):
        assert S.load_id(changed, "p")[0] != name
    assert S.load_id(rows, "q")[0][2:] == name[2:]
    # a load that died before its ledger entry is made again over its own partition
    assert S.load_once(other, path, str(tmp_path / "lost"), "p", ["day"]) == (name, True)
    assert spark.read.parquet(path).count() == 500 and S.finished_loads(spark, ledger).first().n_rows == 500
    empty, _ = S.load_once(rows.limit(0), path, ledger, "p", ["day"])
    assert empty != name and S.finished_loads(spark, ledger).count() == 2


def test_late_join_keeps_its_state_on_disk(spark, tmp_path):
    """Waiting rows stand in RocksDB, not in the executors' heaps; the caller's session keeps its settings."""
    import os

    from hindcast.streaming import late
    rows = "location_id long, valid_at timestamp, retrieved_at timestamp"
    t = dt.datetime(2024, 1, 1)
    f = spark.createDataFrame([(n, t, t) for n in range(9)], rows)
    v = spark.createDataFrame([(n, t, t + dt.timedelta(days=8)) for n in range(5)], rows)
    before = dict(spark.conf.getAll)
    late.run_by_arrival(spark, f, v, "retrieved_at", str(tmp_path), "20 days")
    assert spark.read.parquet(f"{tmp_path}/matches").count() == 5
    kinds = {os.path.splitext(name)[1] for _, _, names in os.walk(tmp_path / "checkpoint" / "state") for name in names}
    assert ".changelog" in kinds and ".delta" not in kinds
    assert dict(spark.conf.getAll) == before


def test_share_of_log_bounds_micro_batches(spark, tmp_path):
    """However many files a log has, it takes about the named number of micro-batches."""
    log = str(tmp_path / "log")
    spark.range(4000).select(F.lit("t").alias("topic"), F.lit(0).alias("partition"), F.col("id").alias("offset"), F.lit("k").alias("key"),
                             F.timestamp_seconds("id").alias("timestamp"), F.col("id").cast("string").alias("value")).repartition(
        40).write.partitionBy("topic").parquet(log)
    sizes = []
    io.run_available_now(io.log_stream(spark, log, io.share_of_log(spark, log, batches=4, least=1)).writeStream.foreachBatch(
        io.where_not_empty(lambda b, i: sizes.append(b.count()))).option("checkpointLocation", str(tmp_path / "ck")))
    assert sum(sizes) == 4000 and 4 <= len(sizes) <= 6


def test_cold_path_runs_topics_side_by_side_into_small_files(spark, sf_small, tmp_path, monkeypatch):
    from pyspark.sql.streaming import DataStreamWriter, StreamingQuery

    from hindcast.sources import raw
    from hindcast.streaming import cold_path

    rows = [(t, 0, n, "k", T0, "{}") for n, t in enumerate(raw.MAPPERS)]
    io.append_log(spark.createDataFrame(rows, LOG), str(tmp_path / "log"), "timestamp")
    assert all(p.name.endswith(".zstd.parquet") for p in (tmp_path / "log").rglob("part-*"))
    calls = []
    for kind, name in ((DataStreamWriter, "start"), (StreamingQuery, "awaitTermination")):
        monkeypatch.setattr(kind, name, lambda self, *a, f=getattr(kind, name), n=name, **b: (calls.append(n), f(self, *a, **b))[1])
    told = cold_path.start_cold_path(spark, lambda topic: io.log_stream(spark, str(tmp_path / "log"), topic=topic), str(tmp_path / "raw"), str(tmp_path / "c"))
    assert calls == ["start"] * len(told) + ["awaitTermination"] * len(told)
    assert told.pop("unknown_topics") == "ok" and len(told) == 3 and all(x.startswith("failed") for x in told.values())


def test_content_loads_map_the_log_once(spark, sf_small, monkeypatch):
    from hindcast import registry

    plans, load = [], S.load_once
    monkeypatch.setattr(S, "load_once", lambda df, *a: (plans.append(df._jdf.queryExecution().executedPlan().toString()), load(df, *a))[1])
    assert registry.QUERIES["content_loads"].spark(spark, sf_small).count() == 3
    assert len(plans) == 9 and not any("json" in p for p in plans)
    assert not any("kafka_offset#" in line and ", 3)" in line for p in plans for line in p.splitlines() if "Exchange" in line)
