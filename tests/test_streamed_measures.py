"""Measures kept by streams equal the batch reports, after late rows, replays and crashes."""

from datetime import date

import pytest
from pyspark.sql import functions as F

from routeboard.operators import reports as R
from routeboard.operators.normalize import normalize
from routeboard.params import ReportParams
from routeboard.sources.envelope import events_fact
from routeboard.sources.storage import scratch_path
from routeboard.streaming import first_seen_state as state
from routeboard.streaming.cells_stream import StreamedCells, add_batch, start_cells_stream
from tests.conftest import SF_SMALL

PAGES = [ReportParams(date(2024, 1, 10), date(2024, 1, 20), "day"), ReportParams(date(2024, 1, 1), date(2024, 12, 31), "week")]
REPORTS = ["activity_over_time", "quarterly_cumulative", "active_chains", "moving_average", "heatmap"]


def run(spark, raw, folder, out, checkpoint, start):
    stream = spark.readStream.schema(raw.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/*")
    query = start(stream, out, checkpoint=checkpoint)
    assert query.awaitTermination(300)


@pytest.fixture(scope="module")
def streamed(spark):
    """Three loads, days in no order: later loads bring rows of days long reported."""
    raw = events_fact(spark, SF_SMALL)
    folder, out, checkpoint = (scratch_path(spark, x) for x in ("raw", "cells", "ckpt"))
    for k in range(3):
        raw.where(F.pmod(F.xxhash64("id"), F.lit(3)) == k).coalesce(2).write.parquet(f"{folder}/load={k}")
        run(spark, raw, folder, out, checkpoint, start_cells_stream)
    return raw, out


@pytest.mark.parametrize("page", PAGES, ids=["day", "week"])
@pytest.mark.parametrize("report", REPORTS)
def test_reports_equal_the_batch(spark, streamed, report, page):
    raw, out = streamed
    want = getattr(R, report)(normalize(raw, fold_case=False), page)
    got = getattr(StreamedCells(spark, out), report)(page)
    assert got.columns == want.columns
    assert got.collect() == want.collect()


def test_replayed_and_unfinished_batches(spark):
    rows = normalize(events_fact(spark, SF_SMALL), fold_case=False).withColumn("hour", F.hour("created_at"))
    out = scratch_path(spark, "cells")
    add_batch(rows.where("id % 2 = 0"), 0, out)
    add_batch(rows.where("id % 2 = 1"), 1, out)
    add_batch(rows.where("id % 2 = 1"), 1, out)                               # replayed
    rows.groupBy("created_date", "hour", "source_chain", "destination_chain", "raw_asset").agg(
        F.sum("amount_usd").alias("_sum_usd"), F.count("amount_usd").alias("_n_usd"), F.max("amount_usd").alias("_max_usd")
    ).write.parquet(f"{out}/cells/batch=2")                                     # died before its marker
    want = R.activity_over_time(normalize(events_fact(spark, SF_SMALL), fold_case=False), PAGES[0]).collect()
    assert StreamedCells(spark, out).activity_over_time(PAGES[0]).collect() == want


def firsts(df):
    return {r["user_address"]: r["first_txn_date"] for r in df.collect()}


def test_first_seen_state_keeps_one_row_a_user(spark):
    raw = events_fact(spark, SF_SMALL)
    folder, out, checkpoint = (scratch_path(spark, x) for x in ("raw", "state", "ckpt"))
    for k, part in enumerate((raw.where("created_at >= '2024-01-10'"), raw.where("created_at < '2024-01-10'"))):
        part.coalesce(2).write.parquet(f"{folder}/load={k}")
        run(spark, raw, folder, out, checkpoint, state.start_first_seen_state)
    table = state.read_first_seen(spark, out)
    want = R.first_seen(normalize(raw, fold_case=False))
    assert firsts(table) == firsts(want) and table.count() == want.count()
    page = ReportParams(date(2024, 1, 2), date(2024, 1, 20), "day")
    base = normalize(raw, fold_case=False)
    assert R.new_users(base, page, R.daily_new_users(base, page, table)).collect() == R.new_users(base, page).collect()


def test_only_touched_buckets_are_rewritten(spark):
    out = scratch_path(spark, "state")
    rows = spark.createDataFrame([(f"u{i}", date(2024, 1, 5)) for i in range(200)] + [(None, date(2024, 1, 5))], "user_address string, created_date date")
    state.merge_batch(rows, 0, out, buckets=16)
    before = set(spark.read.parquet(out).inputFiles())
    state.merge_batch(spark.createDataFrame([("u3", date(2024, 1, 1)), ("new", date(2024, 2, 1))], rows.schema), 1, out, buckets=16)
    kept = before & set(spark.read.parquet(out).inputFiles())
    assert len(before) - 2 <= len(kept) < len(before)
    got = firsts(state.read_first_seen(spark, out))
    assert len(got) == 202 and got["u3"] == date(2024, 1, 1) and got[None] == date(2024, 1, 5) and got["new"] == date(2024, 2, 1)


def test_crash_while_publishing(spark, monkeypatch):
    out = scratch_path(spark, "state")
    schema = "user_address string, created_date date"
    state.merge_batch(spark.createDataFrame([(f"u{i}", date(2024, 1, 5)) for i in range(50)], schema), 0, out, buckets=4)
    late = spark.createDataFrame([("u7", date(2024, 1, 1))], schema)
    publish = state.publish

    def lost(spark, staged, path):
        for r in spark.read.schema(state.SCHEMA).parquet(staged).select("bucket").distinct().collect():
            state._remove(spark, f"{path}/bucket={r['bucket']}")        # the old bucket is gone, the new one not there yet
        raise OSError("lost")
    monkeypatch.setattr(state, "publish", lost)
    with pytest.raises(OSError):
        state.merge_batch(late, 1, out, buckets=4)
    assert len(firsts(state.read_first_seen(spark, out))) < 50
    monkeypatch.setattr(state, "publish", publish)
    state.merge_batch(late, 1, out, buckets=4)                           # Spark delivers the batch again
    got = firsts(state.read_first_seen(spark, out))
    assert len(got) == 50 and got["u7"] == date(2024, 1, 1) and got["u8"] == date(2024, 1, 5)


def test_empty_batches(spark):
    schema = "user_address string, created_date date"
    out = scratch_path(spark, "state")
    state.merge_batch(spark.createDataFrame([("a", date(2024, 1, 2))], schema), 0, out)
    state.merge_batch(spark.createDataFrame([], schema), 1, out)
    assert firsts(state.read_first_seen(spark, out)) == {"a": date(2024, 1, 2)}
