"""Driver contract, a sample of oracle comparisons at sf0.001, and the dashboard over every parameter pair."""

import datetime as dt
import sys
from pathlib import Path

import pytest

import __spark_entry__ as entry
from tessera import constants as C
from tessera.plans import serving
from tessera.plans.lineage import shared_model
from tests.conftest import SF_SMALL

sys.path.insert(0, str(Path(__file__).resolve().parents[1] / "tools"))


def test_entry_smoke(spark):
    df = entry.entry(spark)
    assert df.count() > 0
    assert "snap_rate" in df.columns


def test_every_query_has_an_oracle():
    qs, sqls = entry.queries(), entry.oracle_sql()
    assert set(sqls) <= set(qs)
    assert len(qs) >= 45


@pytest.mark.parametrize("name", ["silver_moves", "silver_sessions", "fact_puzzle", "agg_difficulty",
                                  "quality_checks", "kpis_sessions", "api_daily", "room_concurrency"])
def test_oracle_matches_at_smallest_scale(spark, name):
    from check_oracle import digest, duck

    got = entry.queries()[name](spark, SF_SMALL).toPandas()
    want = duck(SF_SMALL).execute(entry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert digest(got) == digest(want)


def test_dashboard_for_every_filter_and_window(spark):
    m = shared_model(spark, SF_SMALL)
    tables = {n: getattr(m, n) for n in ["dim_date", "fact_session", "fact_puzzle"]}
    as_of = m.events.agg({"event_date": "max"}).first()[0]
    for days in C.DASHBOARD_DAYS:
        for traffic in C.TRAFFIC_FILTERS:
            d = serving.dashboard(spark, tables, days=days, traffic=traffic, as_of=as_of)
            assert d["available"]
            frm, to = dt.date.fromisoformat(d["range"]["from"]), dt.date.fromisoformat(d["range"]["to"])
            assert (to - frm).days == days - 1 and to < as_of
            k = {r["period"]: r for r in d["kpis"].collect()}
            assert set(k) == {"current", "previous"}
            daily = d["daily"].collect()
            assert len(daily) == min(days, (to - m.dim_date.agg({"date": "min"}).first()[0]).days + 1)
            assert sum(r["sessions"] for r in daily) == k["current"]["sessions"]


def test_dashboard_without_data(spark):
    assert serving.dashboard(spark, {}, 30, "all")["reason"] == "no_warehouse"
    m = shared_model(spark, SF_SMALL)
    tables = {"dim_date": m.dim_date, "fact_session": m.fact_session, "fact_puzzle": m.fact_puzzle}
    assert serving.dashboard(spark, tables, 30, "all", as_of=dt.date(2000, 1, 1))["reason"] == "no_data"


def test_parameter_validation():
    assert C.validate_dashboard_params("14", "bot") == (14, "bot")
    assert C.validate_dashboard_params(5, "robots") == (30, "all")
    assert C.validate_dashboard_params(None, None) == (30, "all")


def test_public_views_have_no_personal_columns(spark):
    for name in ["v_daily_activity", "v_daily_puzzles", "v_heatmap", "v_difficulty"]:
        cols = entry.queries()[name](spark, SF_SMALL).columns
        assert not set(cols) & set(serving.PUBLIC_COLUMNS_FORBIDDEN)
