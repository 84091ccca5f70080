"""Exact median by digit histograms, on a hot key, close and extreme values, and in the registered queries."""

import random
import statistics

import pytest

from pyspark.sql import functions as F

from routeboard.operators.median import group_median, order_code
from routeboard.plans.catalog import QUERIES
from tests.conftest import SF_SMALL


@pytest.fixture(scope="module")
def skewed(spark):
    rnd = random.Random(7)
    rows = []
    for i in range(6000):                      # hot key: over a third of the rows
        rows.append(("hot", round(rnd.uniform(0, 1000), 2)))
    for i in range(3000):                      # many duplicates of a few values
        rows.append(("dups", float(rnd.choice([1, 2, 2, 3, 3, 3]))))
    for k in range(40):                        # small keys, odd and even sizes
        for j in range(k + 1):
            rows.append((f"k{k}", round(rnd.uniform(-50, 50), 2)))
    rows += [(None, 5.0), (None, 7.0), ("nulls", None), ("one", 42.0), ("one", None)]
    return spark.createDataFrame(rows, "k string, v double"), rows


def expected(rows):
    groups = {}
    for k, v in rows:
        if v is not None:
            groups.setdefault(k, []).append(v)
    return {k: statistics.median(vs) for k, vs in groups.items()}


def test_median(skewed):
    df, rows = skewed
    got = {r.k: r.m for r in group_median(df, "k", "v", "m").collect()}
    want = expected(rows)
    assert set(got) == set(want)              # the all-NULL key is absent
    for k, v in want.items():
        assert got[k] == pytest.approx(v, rel=1e-12, abs=1e-9), k
    assert got[None] == 6.0


def test_order_code(spark):
    values = [float("-inf"), -1.5e300, -2.0, -1.0, -5e-324, 0.0, 5e-324, 1.0, 1.0000000000000002, 2.0, 1.5e300, float("inf"), float("nan")]
    codes = [r.c for r in spark.createDataFrame([(v, i) for i, v in enumerate(values)], "v double, i int").orderBy("i").select(order_code("v").alias("c")).collect()]
    assert codes == sorted(codes) and len(set(codes)) == len(codes)


def test_close_and_extreme_values(spark):
    rng = random.Random(3)
    rows = [("close", 1e6 + k * 2.0 ** -33) for k in range(2001)]                      # differ in the last digit only
    rows += [("far", s * 10.0 ** rng.uniform(-300, 300)) for s in (-1, 1) for _ in range(500)]
    rows += [("zero", 0.0), ("zero", -0.0), ("inf", float("inf")), ("inf", 1.0), ("inf", float("-inf"))]
    got = {r.k: r.m for r in group_median(spark.createDataFrame(rows, "k string, v double"), "k", "v", "m").collect()}
    assert got == {k: pytest.approx(v, rel=1e-12) for k, v in expected(rows).items()}
    assert got["close"] == expected(rows)["close"] and got["inf"] == 1.0


def test_same_as_the_built_in(spark):
    rng = random.Random(4)
    rows = [(rng.choice("abc"), rng.choice([None, rng.uniform(-9, 9), float(rng.randrange(9))]), rng.randrange(1, 4)) for _ in range(3000)]
    df = spark.createDataFrame(rows, "k string, v double, n int")
    want = {r.k: r.m for r in df.groupBy("k").agg(F.median("v").alias("m")).collect()}
    assert {r.k: r.m for r in group_median(df, "k", "v", "m").collect()} == want
    assert group_median(df.limit(0), "k", "v").collect() == []


def test_plan_is_lazy_and_has_no_window_over_a_whole_group(spark, skewed):
    df, _ = skewed
    plan = group_median(df, "k", "v", "m")._jdf.queryExecution().optimizedPlan().toString()
    assert "percentile" not in plan and "median(" not in plan


@pytest.mark.parametrize("name", ["r14_route_profile", "p_median"])
def test_registered_queries_scan_the_fact_once_and_run_nothing_when_built(spark, name):
    tracker = spark.sparkContext.statusTracker()
    group = f"built-{name}"
    spark.sparkContext.setJobGroup(group, group)
    df = QUERIES[name](spark, SF_SMALL)
    jobs = len(tracker.getJobIdsForGroup(group))
    footers = len(QUERIES["p_distinct_rows"](spark, SF_SMALL).columns) and len(tracker.getJobIdsForGroup(group)) - jobs
    assert jobs <= footers, "only the schemas of the six tables are read"
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    final = plan.split("== Initial Plan ==")[0]
    assert final.count("lineitem.parquet") == 1
