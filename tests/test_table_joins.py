"""Nearest join, bulk search and late materialization against brute force."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from hindcast.operators import dedup as D
from hindcast.operators.asof import nearest_join
from hindcast.operators.search import bulk_search

T0 = dt.datetime(2024, 1, 1)


@pytest.mark.parametrize("chunk", [60, 3600, 86_400])
def test_nearest_join_is_the_least_distance(spark, chunk):
    r = random.Random(chunk)
    when = lambda span: T0 + dt.timedelta(seconds=r.randrange(span), milliseconds=r.choice([0, 0, 400, 999]))
    right = [(k, when(span), n) for n, (k, span) in enumerate([(1, 400), (1, 40_000), (2, 90_000), (2, 3), (None, 100), (4, 200_000)] * 12)]
    right += [right[0], (1, None, 99)]
    left = [(n, k, when(span)) for n, (k, span) in enumerate([(1, 500), (2, 100_000), (3, 50), (None, 50), (4, 260_000)] * 15)]
    left += [(900, 1, None), left[0], (901, 4, T0 - dt.timedelta(days=9)), (902, 4, T0 + dt.timedelta(days=40))]
    ldf = spark.createDataFrame([(*x, "k", 7) for x in left], "id long, key long, at timestamp, r string, second int")
    rdf = spark.createDataFrame(right, "key long, valid_at timestamp, n long")
    got = nearest_join(ldf, rdf, ["key"], "at", "valid_at", ["n"], chunk_seconds=chunk).collect()
    second = lambda t: int((t - T0).total_seconds() // 1)
    want = []
    for i, k, t in left:
        near = [(abs(second(v) - second(t)), v, n) for q, v, n in right if q == k and k is not None and v is not None] if t else []
        best = min(near, default=(None, None, None))
        want.append((i, k, t, "k", 7, best[1], best[2]))
    key = lambda x: tuple((v is None, v) for v in x)
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)
    assert nearest_join(ldf, rdf.limit(0), ["key"], "at", "valid_at", ["n"]).where("nearest_n is not null").count() == 0
    assert nearest_join(ldf.limit(0), rdf, ["key"], "at", "valid_at", ["n"]).count() == 0


def test_nearest_join_pairs_no_rows(spark):
    rows = spark.range(10).select(F.lit(1).alias("key"), F.timestamp_seconds("id").alias("at"), F.col("id").alias("n"))
    plan = nearest_join(rows, rows.withColumnRenamed("at", "valid_at"), ["key"], "at", "valid_at", ["n"])._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Cartesian" not in plan


def like(city, term):
    import re
    out, at = "", 0
    while at < len(term):
        c = term[at]
        if c == "\\" and at + 1 < len(term):
            at += 1
            out += re.escape(term[at])
        else:
            out += ".*" if c == "%" else "." if c == "_" else re.escape(c)
        at += 1
    return re.match("(?s)" + out, city) is not None


def test_bulk_search_against_every_pair(spark):
    r = random.Random(4)
    cities = [(n, r.choice(["Ber", "Bär", "ber", "Lon", "%", "L_n", ""]) + r.choice(["lin", "n", "don", "_", ""]) + str(n % 5),
               r.choice(["DE", "GB", None]), r.choice([None, 5, 50, 500])) for n in range(200)] + [(900, None, "DE", 1)]
    terms = ["", "b", "BER", "ber", "berlin0", "bär", "l_n", "%n", "l%1", "zzz", None, "lond", "Ber%", r"\%", "_"]
    asked = [(n, t, c) for n, (t, c) in enumerate((t, c) for t in terms for c in (None, "", " de", "GB", "xx"))] + [(0, "", None)]
    loc = spark.createDataFrame(cities, "location_id long, city string, country_code string, population long")
    req = spark.createDataFrame(asked, "request_id long, term string, country_code string")
    got = sorted((x.request_id, x.position, x.location_id) for x in bulk_search(loc, req, 7).collect())
    want = []
    for i, t, c in asked:
        c = (c or "").strip().upper()
        hits = [x for x in cities if t is not None and x[1] is not None and like(x[1].lower(), t.lower()) and (not c or x[2] == c)]
        hits.sort(key=lambda x: (x[3] is None, -(x[3] or 0), x[1], x[0]))
        want += [(i, p, x[0]) for p, x in enumerate(hits[:7], 1)]
    assert got == sorted(want)
    plan = bulk_search(loc, req, 7)._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan and "WindowGroupLimit" in plan
    assert bulk_search(loc, req.limit(0), 7).count() == bulk_search(loc.limit(0), req, 7).count() == 0


def test_bulk_search_compares_matching_pairs(spark):
    """A wildcard in front or a common beginning before one must not meet every city."""
    from hindcast.operators import search as S
    loc = spark.range(3000).select(F.col("id").alias("location_id"), F.format_string("City%06d", "id").alias("city"),
                                   F.lit("DE").alias("country_code"), F.col("id").alias("population"))
    terms = [(n, t, None) for n in range(0, 3000, 30) for t in (f"_ity{n:06d}", f"c_ty%{n:03d}", f"c__y{n:06d}_%")]
    req = spark.createDataFrame(terms, "request_id long, term string, country_code string")
    asked = S._terms(req.select("request_id", F.lower("term").alias("__term"), F.lit("").alias("__country")))
    shapes = sorted(r[0] for r in asked.select("__shape").distinct().collect())
    pairs = S.candidates(S._layout(loc, shapes), asked).count()
    assert pairs < 3000  # 900,000 and more when each term meets every city
    got = {(x.request_id, x.location_id) for x in bulk_search(loc, req).where("position = 1").collect()}
    assert got >= {(n, n) for n in range(0, 3000, 30)}


def test_bulk_search_broadcasts_nothing_that_grows(spark):
    """Cities as they are laid out and the best of each key outgrow the driver; the terms that are compared in full may go."""
    from hindcast.operators import search as S
    loc = spark.range(300).select(F.col("id").alias("location_id"), F.format_string("City%06d", "id").alias("city"),
                                  F.lit("DE").alias("country_code"), F.col("id").alias("population"))
    req = loc.select(F.col("location_id").alias("request_id"), F.when(F.col("location_id") % 2 == 0, F.col("city")).otherwise("C%1").alias("term"),
                     F.lit(None).cast("string").alias("country_code"))
    plan = bulk_search(loc, req)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("BroadcastExchange") == 1 and plan.count("SortMergeJoin") == 2 and "BuildLeft" not in plan
    asked = S._terms(req.select(F.lower("term").alias("__term"), F.lit("").alias("__country")))
    many = S.candidates(S._layout(loc, ["x:1:false:false"]), asked, S.TERM_BYTES)._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in many and "SortMergeJoin" in many


@pytest.fixture
def in_files(spark, tmp_path):
    r = random.Random(8)
    rows = [(r.choice(["a", "b", None, f"e{n}"]), r.choice([None, 1, 2, 3]), r.randrange(3), f"p{n}" * 50, r.random() < 0.7) for n in range(400)]
    rows += rows[:30]  # rows equal in everything
    spark.createDataFrame(rows, "key string, t long, o long, payload string, ok boolean").repartition(5).write.parquet(str(tmp_path / "t"))
    return spark.read.parquet(str(tmp_path / "t"))


def test_late_materialization_keeps_what_the_aggregate_keeps(spark, in_files, monkeypatch):
    order = ["t", ("o", "asc")]
    for bound in (D.DEFAULT_BROADCAST_BYTES, 0):  # broadcast, and beyond its bound a shuffle
        monkeypatch.setattr(D, "DEFAULT_BROADCAST_BYTES", bound)
        for got, want in ((D.without_older(in_files, ["key"], order), D.latest_per_key(in_files, ["key"], order)),
                          (D.newest_only(in_files, ["key"], order, where="ok"), D.latest_per_key(in_files, ["key"], order, where="ok"))):
            assert got.columns == want.columns
            part = lambda df: sorted(((x.key or "", x.t or 0, x.o) for x in df.collect()))
            assert part(got) == part(want)
            everything = {tuple(x) for x in in_files.select(*got.columns).collect()}
            assert all(tuple(x) in everything for x in got.collect())
    assert D.without_older(in_files.where("false"), ["key"], order).count() == 0


def test_payload_is_neither_sorted_nor_shuffled(spark, in_files):
    plan = D.without_older(in_files, ["key"], ["t", "o"])._jdf.queryExecution().executedPlan().toString()
    for line in plan.splitlines():
        if any(x in line for x in ("Sort", "Exchange")) and "BroadcastExchange" not in line:
            assert "payload" not in line, line
    assert "SortAggregate" not in plan


def test_versions_of_an_hour(spark):
    rows = [(1, 1, 5, "a"), (1, 1, 7, "b"), (1, 2, 5, "c"), (2, 1, 5, "d"), (2, 1, 5, "e")]
    df = spark.createDataFrame(rows, "location long, hour long, at long, id string")
    got = sorted(map(tuple, D.latest_version(df, ["location", "hour"], ["at", "id"], "n").collect()))
    assert got == [(1, 1, 7, "b", 2), (1, 2, 5, "c", 1), (2, 1, 5, "e", 2)]


def test_rollup_counts_distinct_events_without_expand(spark, sf_small):
    from hindcast.plans import accuracy as A
    from hindcast.plans.models import Models
    acc = Models.with_materialized_intermediate(spark, sf_small).fct_model_forecast_accuracy
    acc = acc.withColumn("verification_event_id", F.when(F.col("lead_time_hours") % 5 != 0, F.col("verification_event_id")))
    rolled = A.rolled_up(acc)
    assert "Expand" not in rolled._jdf.queryExecution().executedPlan().toString()
    want = acc.groupBy(*A.FACT_KEYS).agg(F.count_distinct("forecast_event_id").alias("forecast_run_count"),
                                         F.count_distinct("verification_event_id").alias("verification_event_count"),
                                         F.count(F.lit(1)).alias("matched_hour_count"))
    cols = [*A.FACT_KEYS, "forecast_run_count", "verification_event_count", "matched_hour_count"]
    got = sorted(map(str, rolled.select(*cols).collect()))
    assert got == sorted(map(str, want.select(*cols).collect()))


def test_nearest_join_takes_the_least_of_one_second(spark):
    """Right rows of one second aren't shuffled to be combined; the earliest, then the least, still counts."""
    left = spark.sql("select 1 as key, timestamp'2026-01-02 00:00:10' as at union all select 1, timestamp'2026-01-05 00:00:00'")
    right = spark.sql("""select 1 as key, timestamp'2026-01-02 00:00:10.7' as valid_at, 1 as n union all select 1, timestamp'2026-01-02 00:00:10.2', 9
        union all select 1, timestamp'2026-01-02 00:00:10.2', 5 union all select 1, timestamp'2026-01-02 00:00:10.2', cast(null as int)""")
    for rows, n in ((right, None), (right.where("n is not null"), 5)):
        got = nearest_join(left, rows, ["key"], "at", "valid_at", ["n"])
        assert [(r["nearest_n"], r["nearest_valid_at"].microsecond) for r in got.collect()] == [(n, 200_000)] * 2
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate [") == 1, plan
