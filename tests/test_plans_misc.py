"""Session settings, storage helpers, pushed ranges, and cleanup on failure."""

import pytest
from pyspark.sql import functions as F

from routeboard.operators import reshape
from routeboard.operators.numbering import number_in_order
from routeboard.plans.catalog import QUERIES
from routeboard.plans.dashboard import Dashboard
from routeboard.plans.session import RECOMMENDED_CONF, cluster_conf
from routeboard.sources.storage import checkpoint_root, scratch_path
from tests.conftest import SF_SMALL


def test_cluster_conf_scales_with_cores():
    conf = cluster_conf(8000, "hdfs:///shared/ckpt")
    assert conf["spark.sql.shuffle.partitions"] == "24000"
    assert conf["spark.checkpoint.dir"] == "hdfs:///shared/ckpt"
    assert conf["spark.sql.adaptive.skewJoin.enabled"] == "true"
    assert int(cluster_conf(4, "x")["spark.sql.shuffle.partitions"]) >= 200
    assert set(RECOMMENDED_CONF) <= set(conf)


def test_checkpoint_root_and_scratch_paths(spark):
    root = checkpoint_root(spark)
    assert root and checkpoint_root(spark) == root
    a, b = scratch_path(spark, "x"), scratch_path(spark, "x")
    assert a != b and a.startswith(root.rstrip("/"))


RANGED = [k for k in QUERIES if not k.endswith("_events") and k[0] in "rd" and k[:3] not in ("r08", "r09", "r13", "d1_", "d2_")
          and k != "r14_route_profile_ranked"] + ["p_running_total"]


@pytest.mark.parametrize("name", RANGED)
def test_range_reaches_the_orders_scan(spark, name, monkeypatch):
    numbered = []      # D3 reads a written table: what counts is the plan that was written there
    monkeypatch.setattr(reshape, "number_in_order", lambda df, *a, **kw: numbered.append(df) or number_in_order(df, *a, **kw))
    df = QUERIES[name](spark, SF_SMALL)
    assert len(numbered) == name.startswith("d3_")
    plan = (numbered or [df])[0]._jdf.queryExecution().executedPlan().toString()
    scans = [line for line in plan.splitlines() if "o_orderdate" in line and "PushedFilters" in line]
    assert scans and all("GreaterThanOrEqual(o_orderdate" in x and "LessThan(o_orderdate" in x for x in scans)


def test_no_round_robin_exchange(spark):
    for name in ("p_normalized", "r02_activity_over_time_events", "r13_heatmap"):
        assert "RoundRobin" not in QUERIES[name](spark, SF_SMALL)._jdf.queryExecution().toString()


def test_params_refuse_a_time_of_day():
    from datetime import date, datetime

    from routeboard import ReportParams
    with pytest.raises(TypeError):
        ReportParams(datetime(2024, 1, 10, 12), date(2024, 1, 20))
    with pytest.raises(TypeError):
        ReportParams(date(2024, 1, 10), datetime(2024, 1, 20))


def test_run_releases_cache_on_failure(spark):
    from routeboard.plans.catalog import PAGE
    from routeboard.sources.order_lines import order_lines_base
    base = order_lines_base(spark, SF_SMALL)
    dash = Dashboard(base, PAGE)
    seen = []

    def failing(df):
        seen.append(df)
        raise RuntimeError("boom")

    with pytest.raises(RuntimeError):
        dash.run(action=failing)
    cached = [df for df in seen if df.storageLevel.useMemory or df.storageLevel.useDisk]
    assert not cached
