"""Operators against brute-force equivalents on small fixtures (incl. a hot key)."""

import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from hindcast.operators.dedup import latest_per_key
from hindcast.operators.sequence import previous_in_sequence


def test_latest_per_key_matches_row_number(spark):
    random.seed(7)
    rows = [(k if i % 3 else 0, random.randint(0, 5), random.randint(0, 3), i) for i, k in
            enumerate(random.choices(range(20), k=400))]
    rows += [(1, None, 2, 1000)]
    df = spark.createDataFrame(rows, "k int, a int, b int, c int")
    got = latest_per_key(df, ["k"], ["a", "b", "c"], count_as="n")
    w = Window.partitionBy("k").orderBy(F.col("a").desc_nulls_last(), F.col("b").desc(), F.col("c").desc())
    ref = df.withColumn("rn", F.row_number().over(w)).filter("rn = 1").drop("rn")
    ref = ref.join(df.groupBy("k").count().withColumnRenamed("count", "n"), "k")
    assert sorted(map(tuple, got.select("k", "a", "b", "c", "n").collect())) == \
        sorted(map(tuple, ref.select("k", "a", "b", "c", "n").collect()))


def test_previous_in_sequence_with_few_columns_read(spark):
    random.seed(3)
    rows = [(i % 300, i, float(i), "x" * (i % 7)) for i in random.sample(range(3000), 3000)]
    rows += [(None, 5000, 1.0, "a"), (None, 5001, 2.0, "b")]
    df = spark.createDataFrame(rows, "g int, t int, v double, other string")
    last = {}
    want = set()
    for g, t, v, _ in sorted(rows, key=lambda r: (str(r[0]), r[1])):
        want.add((g, t, last.get(g)))
        last[g] = v
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for n in (16, 64):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            got = previous_in_sequence(df.repartition(9), ["g"], ["t"], {"v": "pv"}).select("g", "t", "pv")
            assert {tuple(r) for r in got.collect()} == want
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_dense_index_has_no_gap_or_duplicate(spark):
    from hindcast.operators.sequence import dense_index

    n = 1_000_000
    df = spark.range(n).select((F.col("id") * 7919 % n).alias("k"), F.col("id").cast("string").alias("text")).repartition(11)
    out = dense_index(df, ["k"], "i", num_partitions=16)
    row = out.agg(F.countDistinct("i").alias("d"), F.min("i").alias("a"), F.max("i").alias("b"),
                  F.count_if(F.col("i") != F.col("k") + 1).alias("wrong")).first()
    assert (row.d, row.a, row.b, row.wrong) == (n, 1, n, 0)
    assert dense_index(df.limit(0), ["k"], "i").count() == 0


def test_join_dimension_broadcasts_only_under_byte_bound(spark):
    from hindcast.operators.joins import estimated_row_bytes, join_dimension

    fact = spark.range(1000).select((F.col("id") % 50).alias("k"), F.col("id").alias("v"))
    dim = spark.range(50).select(F.col("id").alias("k"), F.concat(F.lit("name-"), F.col("id")).alias("name"))
    assert estimated_row_bytes(dim.schema) == 8 + 8 + 48

    def plan(df):
        return df._jdf.queryExecution().sparkPlan().toString()

    # Only the explicit hint may broadcast here (no statistics-based choice).
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        small = join_dimension(fact, dim, "k", dim_rows=50)
        assert "BroadcastHashJoin" in plan(small)
        # Same rows, but a bound the estimate exceeds: no broadcast hint.
        big = join_dimension(fact, dim, "k", dim_rows=50, max_broadcast_bytes=100)
        assert "BroadcastHashJoin" not in plan(big)
        assert sorted(small.collect()) == sorted(big.collect())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_latest_per_key_where_equals_filter_first(spark):
    random.seed(11)
    # key 0 is hot; key 99 has no valid row and must disappear
    rows = [(0 if i % 3 else random.randint(1, 9), random.randint(0, 4), i, random.random() < 0.6)
            for i in range(500)]
    rows += [(99, 1, 1000, False), (99, 2, 1001, False), (None, 3, 1002, True)]
    df = spark.createDataFrame(rows, "k int, a int, c int, ok boolean")
    got = latest_per_key(df, ["k"], ["a", "c"], count_as="n", where="ok")
    assert "ok" not in got.columns
    ref = latest_per_key(df.filter("ok").drop("ok"), ["k"], ["a", "c"], count_as="n")
    assert sorted(map(tuple, got.select("k", "a", "c", "n").collect()), key=str) == \
        sorted(map(tuple, ref.select("k", "a", "c", "n").collect()), key=str)


def test_inline_rows_equals_inline(spark):
    from hindcast.operators.unnest import inline_rows

    df = spark.createDataFrame(
        [(1, [(1, "a"), (2, "b")]), (2, []), (3, None), (4, [None, (5, "e")]), (5, [(6, None)])],
        "k int, arr array<struct<x int, y string>>")
    got = inline_rows(df, ["k"], "arr")
    ref = df.select("k", F.inline("arr"))
    assert got.columns == ref.columns
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, ref.collect()), key=str)


def test_document_hours_reads_odd_documents_as_text(spark):
    """One parse gives the rows of two: a payload with any value of another type is read as text."""
    from hindcast.functions.json import parse_text_fields, safe_cast, scalar_only
    from hindcast.operators.unnest import document_hours, explode_json_array, typed_hourly

    hour = '{"valid_at": "2026-01-01T00:00:00Z", "lead_time_hours": 3, "temperature_2m": 1.5, "weather_code": 61, "is_day": true}'
    arrays = [f"[{hour}]", "[]", "null", hour, '"text"', f'"[{{}}]"', f"[null, {hour}]", f"[5, {hour}]", f'["x", [{hour}]]', f"[[], {hour}]",
              '[{"temperature_2m": "2.5", "weather_code": "3", "is_day": "true"}]', '[{"weather_code": 3.7, "lead_time_hours": 2.0}]',
              '[{"temperature_2m": {"a": 1}, "is_day": 1, "rain": [1], "valid_at": {"b": 2}}]', '[{"temperature_2m": NaN, "rain": "NaN"}]',
              '[{"rain": 12345678901234567890, "weather_code": 12345678901234567890}]', '[{"rain": 1e400, "snowfall": 0.1000000000000000055}]',
              '[{"rain": 1, "rain": "2"}, {"unknown": {"x": [1, 2]}, "valid_at": "soon", "uv_index": ""}]',
              '[{"rain": 1}, {"rain": tr', f"[{hour}] [{hour}]", '[{"valid_at": " 2026-01-01T00:00:00Z", "is_day": null}]']
    docs = [f'{{"occurred_at": "2026-01-02T00:00:00Z", "data": {{"name": "n{i}", "hourly": {a}, "after": 1}}}}' for i, a in enumerate(arrays)]
    docs += ["", "not json", "[]", "5", "null", None, "{}", '{"data": 5}', f'[{docs[0]}]', docs[0][:-30], docs[0] + docs[0],
             f'{{"occurred_at": {{"t": 1}}, "data": {{"hourly": [{hour}], "name": 7}}}}', f'{{"occurred_at": 5, "data": [{{"hourly": [{hour}]}}]}}']
    df = spark.createDataFrame(list(enumerate(docs)), "id int, payload string")
    lifted = {"at": "occurred_at", "name": "data.name"}
    text = df.withColumn("p", parse_text_fields("payload", ["occurred_at", "data.name", "data.hourly"]))
    text = text.select("id", scalar_only("p.occurred_at").alias("at"), scalar_only("p.data.name").alias("name"), F.col("p.data.hourly").alias("rows"))
    want = typed_hourly(explode_json_array(text, "rows"), ["id", "at", "name"], with_lead=True)
    got = document_hours(df, ["id"], "payload", lifted, "data.hourly", with_lead=True)
    assert got.dtypes == want.dtypes
    rows = lambda d: sorted(map(str, d.collect()))
    assert rows(got) == rows(want) and len(rows(got)) > 20


def test_typed_hours_are_made_by_one_parse(spark, sf_small):
    """No array of element texts, parsed one by one, stands in the typed tables' plans."""
    from hindcast.plans.models import Models

    m = Models.from_bridge(spark, sf_small)
    for df in (m.int_model_run_hourly_forecasts, m.int_verification_hourly_weather, m.int_operational_hourly_forecasts):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert "Generate explode(from_json(ArrayType(StringType" not in plan
        assert plan.count("Generate posexplode") >= 1
