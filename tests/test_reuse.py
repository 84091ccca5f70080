"""Kept results: reused by later pages and processes, never for a changed source, removed when old."""

import json
import subprocess
import sys
from datetime import date
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from routeboard.operators.normalize import normalize
from routeboard.params import ReportParams
from routeboard.plans.catalog import EVENT_RANGE
from routeboard.plans.dashboard import NEEDS, REPORT_NAMES, Dashboard
from routeboard.sources.envelope import events_fact
from routeboard.sources.reuse import ResultStore, source_bytes, source_version
from routeboard.sources import storage
from routeboard.sources.storage import scratch_path, sized_shuffles
from tests.conftest import ROOT, SF_SMALL


def ordered(rows):
    return sorted(map(str, rows))


@pytest.fixture()
def store(spark):
    return ResultStore(spark, scratch_path(spark, "store"))


@pytest.fixture()
def source(spark):
    """A stored fact that a test may add files to."""
    path = scratch_path(spark, "fact")
    events_fact(spark, SF_SMALL).write.parquet(path)
    return path


def page(spark, source, store, **kw):
    return Dashboard.from_fact(spark.read.parquet(source), EVENT_RANGE, store=store, **kw)


def test_second_run_makes_nothing(spark, source, store):
    results, _ = page(spark, source, store).run(parallel=4)
    assert "base" in store.made and set(NEEDS["r14_route_profile"]) <= set(store.made)
    later = ResultStore(spark, store.root)
    again, _ = page(spark, source, later).run(parallel=4)
    assert later.made == [] and "base" in later.reused
    assert {n: ordered(r) for n, r in again.items()} == {n: ordered(r) for n, r in results.items()}
    plain, _ = Dashboard(normalize(spark.read.parquet(source), fold_case=False), EVENT_RANGE).run(parallel=4)
    assert {n: ordered(r) for n, r in plain.items()} == {n: ordered(r) for n, r in results.items()}


def test_kept_reports_read_no_base(spark, source, store):
    dash = page(spark, source, store)
    for name in REPORT_NAMES:
        dash.report(name)
    base = {Path(f).parent.name for f in dash.base.inputFiles()}
    later = page(spark, source, ResultStore(spark, store.root))
    for name in REPORT_NAMES:
        read = {Path(f).parent.name for f in later.report(name).inputFiles()}
        assert read and not read & base, name
    assert later.store.made == []


def test_another_process_reuses(spark, source, store):
    page(spark, source, store).report("r16_route_totals")
    script = f"""
import json, sys
sys.path.insert(0, {str(ROOT)!r})
from routeboard.plans.catalog import EVENT_RANGE
from routeboard.plans.dashboard import Dashboard
from routeboard.plans.session import local_session
from routeboard.sources.reuse import ResultStore
spark = local_session(2)
store = ResultStore(spark, {store.root!r})
rows = Dashboard.from_fact(spark.read.parquet({source!r}), EVENT_RANGE, store=store).report("r16_route_totals").collect()
print(json.dumps([store.made, len(rows)]))
"""
    out = subprocess.run([sys.executable, "-c", script], capture_output=True, text=True, timeout=300, check=True).stdout
    made, n = json.loads(out.strip().splitlines()[-1])
    assert made == [] and n > 0


def test_changed_source_is_not_reused(spark, source, store):
    before = page(spark, source, store).report("r01_overview_kpis").collect()
    more = events_fact(spark, SF_SMALL).withColumn("id", F.col("id") + 10**9)
    more.write.mode("append").parquet(source)
    later = ResultStore(spark, store.root)
    after = page(spark, source, later).report("r01_overview_kpis").collect()
    assert "base" in later.made and after[0]["total_transactions"] == 2 * before[0]["total_transactions"]


def test_parameters_are_part_of_the_key(spark, source, store):
    page(spark, source, store).report("r02_activity_over_time")
    monthly = ResultStore(spark, store.root)
    Dashboard.from_fact(spark.read.parquet(source), EVENT_RANGE.with_grain("month"), store=monthly).report("r02_activity_over_time")
    assert monthly.made == ["m_buckets"]          # the cells do not depend on the grain
    other = ResultStore(spark, store.root)
    Dashboard.from_fact(spark.read.parquet(source), ReportParams(date(2024, 1, 10), date(2024, 1, 12), "day"), store=other).report("r02_activity_over_time")
    assert other.made == ["m_cells", "m_buckets"] and other.reused == ["base"]


def test_unfinished_and_expired_entries(spark, store):
    make = lambda: spark.range(3)
    key = store.key("v", "t", start=date(2024, 1, 1))
    spark.range(9).write.parquet(f"{store.root}/{key}/rows-dead")     # a writer that died before its manifest
    assert store.table("v", "t", make, start=date(2024, 1, 1)).count() == 3
    assert store.expire() == 0                                         # young: kept, without an age limit
    old = ResultStore(spark, store.root, max_age=0)
    assert old.table("v", "t", lambda: spark.range(5), start=date(2024, 1, 1)).count() == 5 and old.made == ["t"]
    assert ResultStore(spark, store.root).table("v", "t", make, start=date(2024, 1, 1)).count() == 5
    assert old.expire() == 1
    fresh = ResultStore(spark, store.root)
    assert fresh.table("v", "t", make, start=date(2024, 1, 1)).count() == 3 and fresh.made == ["t"]
    assert fresh.expire(everything=True) == 1 and fresh.expire(everything=True) == 0


def test_first_manifest_stands(spark, store):
    def make():
        ResultStore(spark, store.root).table("v", "t", lambda: spark.range(2))      # another writer is faster
        return spark.range(7)
    assert store.table("v", "t", make).count() == 2


def test_version_follows_the_files(spark, source):
    before = source_version(spark.read.parquet(source))
    assert source_version(spark.read.parquet(source)) == before
    events_fact(spark, SF_SMALL).limit(1).write.mode("append").parquet(source)
    assert source_version(spark.read.parquet(source)) != before


def joined_base(spark, path, n=4000):
    """A normalised relation that merge-joins two stored tables; some users are null, some rows come twice."""
    spark.range(n).selectExpr("id % 1900 AS id", "timestamp_ntz'2024-01-01' + make_dt_interval(id % 40) AS created_at",
                              "id % 7 / 2.0 AS amount_usd").write.parquet(f"{path}/lines")
    spark.range(1900).selectExpr("id AS key", "nullif('u' || id % 50, 'u3') AS user_address").write.parquet(f"{path}/orders")
    lines, orders = spark.read.parquet(f"{path}/lines"), spark.read.parquet(f"{path}/orders").hint("merge")
    return lines.join(orders, lines.id == orders.key).selectExpr(
        "created_at", "to_date(created_at) AS created_date", "id", "user_address", "'a' AS source_chain", "'b' AS destination_chain",
        "'s' AS service", "amount_usd AS amount", "amount_usd", "amount_usd AS fee", "'t' AS raw_asset")


def test_a_task_of_the_kept_base_does_not_grow_with_the_source(spark, store, monkeypatch):
    base = joined_base(spark, scratch_path(spark, "joined"))
    settings = {"spark.sql.shuffle.partitions": "2", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {key: spark.conf.get(key) for key in settings}
    monkeypatch.setattr(storage, "STORED_BYTES", -(-source_bytes(base) // 16), raising=False)
    try:
        for key, value in settings.items():
            spark.conf.set(key, value)
        kept = Dashboard.from_base(base, EVENT_RANGE, store=store).base
        assert spark.conf.get("spark.sql.shuffle.partitions") == "2"
        files = kept.groupBy(F.input_file_name().alias("file")).count().collect()
        assert len(files) == 16 and max(f["count"] for f in files) < kept.count() / 8      # two tasks held half each
        assert ordered(kept.collect()) == ordered(base.select(*kept.columns).collect())
        for f in files:
            days = [r["created_date"] for r in spark.read.parquet(f["file"]).select("created_date").collect()]
            assert days == sorted(days)
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)


def test_sized_shuffles_keep_a_larger_number_and_put_settings_back(spark, monkeypatch):
    partitions, advisory = "spark.sql.shuffle.partitions", "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    before = spark.conf.get(partitions), spark.conf.get(advisory, None)
    for stored, wanted in ((0, int(before[0])), (100 * storage.STORED_BYTES + 1, 101), (1 << 60, storage.MOST_PARTITIONS)):
        with pytest.raises(KeyError), sized_shuffles(spark, stored):
            assert int(spark.conf.get(partitions)) == wanted
            raise KeyError
        assert (spark.conf.get(partitions), spark.conf.get(advisory, None)) == before
