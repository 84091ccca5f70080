"""Cross-report invariants on the order-lines relation (sf0.001)."""

from datetime import date

import pytest
from pyspark.sql import functions as F

from routeboard.operators import derived, reports as R
from routeboard.params import ReportParams
from routeboard.sources.order_lines import order_lines_base
from tests.conftest import SF_SMALL

P = ReportParams(date(2023, 1, 1), date(2025, 8, 31), "week")


@pytest.fixture(scope="module")
def base(spark):
    return order_lines_base(spark, SF_SMALL).cache()


def test_classes_sum_to_users(base):
    users = R.overview_kpis(base, P).first().unique_users
    for report in (R.txn_exact, R.active_days, R.paths_per_user):
        t = report(base, P)
        assert t.agg(F.sum("number_of_users")).first()[0] == users


def test_daily_buckets_sum_to_total(base):
    # an id (order) has a single date here, so day buckets partition the ids
    total = R.overview_kpis(base, P).first().total_transactions
    daily = R.activity_over_time(base, P.with_grain("day")).agg(F.sum("total_transactions")).first()[0]
    assert daily == total


def test_new_user_running_total_matches_kpi(base):
    rows = R.new_users(base, P).collect()
    kpi = R.new_user_kpis(base, P).first()
    assert rows[-1].cumulative_new_users == kpi.cumulative_new_users == sum(r.new_users for r in rows)


def test_first_seen_uses_whole_history(base):
    first = R.first_seen(base)
    before = first.where(F.col("first_txn_date") < P.start).count()
    assert before > 0     # such users exist and are not new in range
    in_range = first.where(F.col("first_txn_date").between(P.start, P.end)).count()
    assert R.new_user_kpis(base, P).first().cumulative_new_users == in_range


def test_quarter_running_totals(base):
    rows = R.quarterly_cumulative(base, P).collect()
    by_q = {}
    for r in rows:
        by_q.setdefault(r.quarter, []).append(r)
    for q, rs in by_q.items():
        vols = [r.total_volume for r in rs if r.total_volume is not None]
        assert rs[-1].cumulative_volume == pytest.approx(sum(vols))


def test_long_form_doubles_top(base):
    top = derived.top_transfers(R.route_totals(base, P))
    assert derived.top_long(top).count() == 2 * top.count()


def test_route_totals_match_profile(base):
    totals = {r.path: (r.number_of_transfers, r.number_of_users, r.volume_of_transfers_usd)
              for r in R.route_totals(base, P).collect()}
    profile = {r.path: (r.number_of_transfers, r.number_of_users, r.volume_usd)
               for r in R.route_profile(base, P).collect()}
    assert totals == profile
