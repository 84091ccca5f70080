"""The SQL form of each report returns the same table as the DataFrame form."""

from datetime import date

import pytest

from routeboard.operators import reports as R
from routeboard.params import CLASS_WINDOW, ReportParams
from routeboard.plans.sql_reports import REPORT_SQL, register_base, sql_report
from routeboard.sources.envelope import events_fact
from routeboard.operators.normalize import normalize
from routeboard.sources.order_lines import order_lines_base
from tests.conftest import SF_SMALL

P = ReportParams(date(2023, 1, 1), date(2025, 8, 31), "week")
EV = ReportParams(date(2024, 1, 10), date(2024, 1, 20), "day")

DATAFRAME = {
    "r01_overview_kpis": R.overview_kpis, "r02_activity_over_time": R.activity_over_time,
    "r03_quarterly_cumulative": R.quarterly_cumulative, "r04_chain_kpis": R.chain_kpis,
    "r05_active_chains": R.active_chains, "r06_moving_average": R.moving_average,
    "r07_txn_ranges": R.txn_ranges, "r08_new_users": R.new_users, "r09_new_user_kpis": R.new_user_kpis,
    "r10_txn_exact": R.txn_exact, "r11_active_days": R.active_days, "r12_paths_per_user": R.paths_per_user,
    "r13_heatmap": R.heatmap, "r14_route_profile": R.route_profile,
    "r15_source_destination": R.source_destination, "r16_route_totals": R.route_totals,
}


@pytest.fixture(scope="module")
def bases(spark):
    return {
        "orders": order_lines_base(spark, SF_SMALL).cache(),
        "events": normalize(events_fact(spark, SF_SMALL), fold_case=False).cache(),
    }


def test_every_report_has_sql():
    assert set(REPORT_SQL) == set(DATAFRAME)


@pytest.mark.parametrize("source,grain", [("orders", "week"), ("orders", "month"), ("events", "day")])
@pytest.mark.parametrize("name", sorted(DATAFRAME))
def test_sql_matches_dataframe(spark, bases, name, source, grain):
    base = bases[source]
    p = (P if source == "orders" else EV).with_grain(grain)
    if name == "r07_txn_ranges" and source == "orders":
        p = CLASS_WINDOW
    register_base(base)
    got = sql_report(spark, name, p)
    want = DATAFRAME[name](base, p)
    assert got.columns == want.columns
    assert got.collect() == want.collect()       # same rows in the same order
