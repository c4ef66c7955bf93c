"""Landing: a query lands what it reads and nothing else."""

import os

import pytest

from hindcast.sources import landing as L


@pytest.fixture
def fresh(spark, sf_small, tmp_path, monkeypatch):
    """An empty folder for the landed tables."""
    monkeypatch.setattr(L, "ensure_checkpoint_dir", lambda _: str(tmp_path))
    return spark, sf_small, str(tmp_path)


def landed(folder):
    return {t for run in os.listdir(f"{folder}/landed") for t in os.listdir(f"{folder}/landed/{run}")}


@pytest.mark.parametrize("query, tables", [
    ("location_merge_ids", {"locations"}), ("latest_daily", {"operational_forecast_events"}),
    ("daylight", {"operational_forecast_events"}), ("upcoming_days", {"operational_forecast_events"}),
    ("cycle_report", {"locations", "verification_weather_events", "int_verification_hourly_weather"})])
def test_a_query_lands_only_what_it_reads(fresh, query, tables):
    import __spark_entry__ as E
    spark, sf, folder = fresh
    assert E.queries()[query](spark, sf).count() > 0
    assert landed(folder) == tables


@pytest.mark.parametrize("table", ["model_run_events", "verification_weather_events", "operational_forecast_events"])
def test_payload_goes_through_no_shuffle_or_sort(spark, sf_small, table):
    from hindcast.sources import bridge as B
    b = B.Bridge.load(spark, sf_small)
    packs, rows = {"model_run_events": (b.model_run_packs, B.model_run_events), "verification_weather_events": (b.verification_packs, B.verification_raw),
                   "operational_forecast_events": (b.operational_packs, B.operational_raw)}[table]
    out = L.laid_out(packs(), table, rows)
    plan = out._jdf.queryExecution().executedPlan().toString().replace("AdaptiveSparkPlan", "")
    assert 0 <= plan.index("AS payload#") < min(plan.index("Exchange"), plan.index("Sort"))
    # the writer needs the rows by date: they are, so it sorts nothing again
    order = out._jdf.queryExecution().optimizedPlan().outputOrdering()
    assert order.size() and L.LAYOUT[table][0] in order.apply(0).toString()
