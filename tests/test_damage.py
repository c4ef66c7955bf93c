"""Rules and data tests on data with defects: each finds what it is for."""

import inspect
import re

import pytest
from pyspark.sql import functions as F

from hindcast.operators import locations as LOC
from hindcast.plans import damage as D
from hindcast.registry import QUERIES
from hindcast.sources import raw

#: Enough locations for a defect of every kind.
SF_WIDE = "/root/testdata/sf0.01"


def test_every_kind_of_check_fails_somewhere(spark, sf_small):
    rows = QUERIES["quality_violations"].spark(spark, sf_small).collect()
    kinds = {}
    for r in rows:
        kind = re.sub(r".*_(unique_grain|valid_metrics)$", r"\1", r.check_name)
        kinds.setdefault(kind, []).append(r.failing_rows)
    assert set(kinds) == {"not_null", "unique", "relationships", "accepted_values", "unique_grain", "valid_metrics"}
    assert all(min(n) > 0 for k, n in kinds.items() if k in ("accepted_values", "valid_metrics", "relationships")), kinds
    assert all(sum(x > 0 for x in n) >= 0.8 * len(n) for n in kinds.values()), kinds


def test_every_constraint_of_the_state_tables_fails(spark):
    rows = QUERIES["state_violations"].spark(spark, SF_WIDE).collect()
    assert [r.check_name + " " + r.column_name for r in rows if not r.failing_rows] == []


def test_every_rule_of_the_logs_is_broken(spark):
    found = {r.violation for r in QUERIES["rule_violations"].spark(spark, SF_WIDE).select("violation").distinct().collect()}
    written = set(re.findall(r'^ {8}\(.*, "([a-z_]+)"\),$', inspect.getsource(raw), re.M))
    assert written - found == {"topic_mismatch"}  # records are routed by topic first
    assert set(raw.CONSTRUCTION_RULES) <= found


def test_strict_loads_pass_what_only_makers_must_keep(spark, sf_small):
    from hindcast.registry import _ingested, _log
    log = _log(spark, sf_small, "operational_forecast_events")
    made = [d for d in D.log_defects()["operational_forecast_events"] if set(d.codes) <= set(raw.CONSTRUCTION_RULES)]
    mapped = raw.operational_rows(D.defective_log(log, made), _ingested())
    assert mapped.where(F.size("violations") > 0).count() > 0
    assert raw.strict(mapped).count() == log.count()


def test_damage_sees_the_row_as_it_was(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "location_id long, x string")
    damage = D.Damage({"location_id": "case when location_id = 1 then null else location_id end",
                       "x": "case when location_id = 1 then 'z' else x end"}, repeated="location_id = 2", dropped="location_id = 3")
    assert sorted(map(tuple, D.damaged(df, damage).collect()), key=str) == [(2, "b"), (2, "b"), (None, "z")]


def _snapshot(spark, ids, population=1):
    return spark.createDataFrame(
        [(i, i + 10, "A", "B", "id", 1.0, 2.0, "UTC", None, population, None) for i in ids],
        "location_id long, open_meteo_location_id long, city string, country string, country_code string, latitude double, "
        "longitude double, timezone string, elevation double, population long, administrative_area string").withColumns(
        {c: F.lit("2024-01-01").cast("timestamp") for c in ("source_created_at", "source_updated_at")})


def test_swap_keeps_the_table_when_a_snapshot_is_refused(spark, tmp_path):
    now, root = F.lit("2024-01-02").cast("timestamp"), str(tmp_path)
    LOC.swap_snapshot(_snapshot(spark, [1, 2]), "swapped_locations", root, now)
    try:
        LOC.swap_snapshot(_snapshot(spark, [3, 4, 5]), "swapped_locations", root, now)
        with pytest.raises(Exception, match="invalid location snapshot row"):
            LOC.swap_snapshot(_snapshot(spark, [6], population=-1), "swapped_locations", root, now)
        with pytest.raises(ValueError, match="empty"):
            LOC.swap_snapshot(_snapshot(spark, [7]).limit(0), "swapped_locations", root, now)
        assert sorted(r.location_id for r in spark.table("swapped_locations").collect()) == [3, 4, 5]
        assert {r.country_code for r in spark.table("swapped_locations").collect()} == {"ID"}
    finally:
        spark.sql("drop table swapped_locations")
