"""The dashboard suite over a materialised base gives the same tables as the standalone queries."""

import pytest

from routeboard.plans.catalog import EVENT_RANGE, QUERIES
from routeboard.plans.dashboard import DERIVED_NAMES, REPORT_NAMES, Dashboard
from routeboard.sources.envelope import events_fact
from routeboard.sources.storage import checkpoint_root
from tests.conftest import SF_SMALL


@pytest.fixture(scope="module")
def run(spark):
    dash = Dashboard.from_fact(events_fact(spark, SF_SMALL), EVENT_RANGE)
    results, seconds = dash.run(parallel=4)
    return dash, results, seconds


def test_all_tables_run(run):
    _, results, seconds = run
    assert set(results) == set(REPORT_NAMES) | set(DERIVED_NAMES)
    assert all(s >= 0 for s in seconds.values())


def test_base_is_written_under_checkpoint_dir(spark, run):
    dash, _, _ = run
    files = dash.base.inputFiles()
    root = checkpoint_root(spark).replace("file:", "")
    assert files and all(root in f for f in files)


@pytest.mark.parametrize("report", ["r01_overview_kpis", "r02_activity_over_time", "r04_chain_kpis",
                                    "r05_active_chains", "r14_route_profile", "r15_source_destination",
                                    "r16_route_totals"])
def test_same_as_standalone_query(spark, run, report):
    _, results, _ = run
    standalone = QUERIES[f"{report}_events"](spark, SF_SMALL).collect()
    key = lambda r: tuple((v is None, str(v)) for v in r)
    assert sorted(results[report], key=key) == sorted(standalone, key=key)


@pytest.fixture(scope="module")
def orders_run(spark):
    from routeboard.plans.catalog import PAGE
    from routeboard.sources.order_lines import order_lines_base
    dash = Dashboard.from_base(order_lines_base(spark, SF_SMALL), PAGE)
    results, _ = dash.run(parallel=4)
    return results


ORDERS_TABLES = [n for n in REPORT_NAMES if n != "r13_heatmap"] + [
    n for n in DERIVED_NAMES if not n.startswith(("d1", "d2"))]


@pytest.mark.parametrize("name", ORDERS_TABLES)
def test_fused_dashboard_equals_standalone(spark, orders_run, name):
    standalone = QUERIES[name](spark, SF_SMALL).collect()
    key = lambda r: tuple((v is None, str(v)) for v in r)
    assert sorted(orders_run[name], key=key) == sorted(standalone, key=key)


def test_clustered_base_same_rows(spark):
    from routeboard.plans.dashboard import materialize_base
    from routeboard.sources.order_lines import order_lines_base
    from routeboard.sources.schema import BASE_COLUMNS
    base = order_lines_base(spark, SF_SMALL).select(*BASE_COLUMNS)
    clustered = materialize_base(base, cluster=True)
    plain = materialize_base(base)
    assert clustered.count() == plain.count() == base.count()
    assert clustered.exceptAll(plain).count() == 0


def test_dashboard_uses_a_supplied_first_seen_table(spark):
    from routeboard.operators import reports as R
    from routeboard.plans.catalog import PAGE
    from routeboard.sources.order_lines import order_lines_base
    base = order_lines_base(spark, SF_SMALL)
    first = R.first_seen(base).cache()
    dash = Dashboard(base, PAGE, first_seen=first)
    got = dash.shared_plans()["m_daily_new_users"]()
    assert sorted(got.collect()) == sorted(R.daily_new_users(base, PAGE).collect())
    first.unpersist()


def test_month_partitioned_base(spark, capsys):
    from routeboard.operators import reports as R
    from routeboard.plans.catalog import PAGE
    from routeboard.plans.dashboard import materialize_base
    from routeboard.sources.order_lines import order_lines_base
    base = order_lines_base(spark, SF_SMALL)
    monthly = materialize_base(base, partition_by_month=True)
    assert "created_month" in monthly.columns
    for report in (R.overview_kpis, R.activity_over_time, R.route_totals, R.new_user_kpis):
        assert sorted(report(monthly, PAGE).collect()) == sorted(report(base, PAGE).collect())
    R.in_range(monthly, PAGE).explain("formatted")
    assert "PartitionFilters: [isnotnull(created_month" in capsys.readouterr().out
