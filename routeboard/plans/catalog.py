"""Registered queries: every report, derived table and extraction primitive, on the given tables.

Two relations feed them, both derived by Spark from the tables in a data
directory, so every query's work grows with those tables:

* ``orders``: the order/line-item star schema as a normalised transfer
  relation (multi-year history, repeated ids) -- the aggregate, window and
  first-seen logic;
* ``events``: the ``events`` table wrapped as a raw fact with a JSON payload
  in every awkward shape, run through ``normalize`` -- the extraction path and
  the hour-of-day reports.

Each entry is ``(spark, data_dir) -> DataFrame`` and only builds a plan; D3
numbers its rows through a written table, so it runs jobs while it is built.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import date

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.labels import quarter_label, route_label, weekday_label
from ..functions.numeric import stable_round
from ..operators import derived, reports
from ..operators.median import group_median, weigh, weighted_median
from ..operators.normalize import normalize, success_filter
from ..params import CLASS_WINDOW, ReportParams
from ..sources.envelope import events_fact
from ..sources.order_lines import order_lines_base
from ..sources.reuse import ResultStore
from ..sources.storage import scratch_path
from ..sources.tables import read_fact
from ..streaming import StreamedCells, read_first_seen, start_cells_stream, start_first_seen_state
from .dashboard import Dashboard

Query = Callable[[SparkSession, str], DataFrame]
R = reports

PAGE = ReportParams()                                             # 2023-01-01 .. 2025-08-31, week
EVENT_RANGE = ReportParams(date(2024, 1, 10), date(2024, 1, 20), "day")
# events users are first seen on the first days of January; this range starts
# after the first day, so users seen earlier and again inside it are not new
EVENT_COHORT = ReportParams(date(2024, 1, 2), date(2024, 1, 20), "day")


def orders_base(spark: SparkSession, data_dir: str, window: ReportParams | None = None) -> DataFrame:
    return order_lines_base(spark, data_dir, window=window)


def events_base(spark: SparkSession, data_dir: str) -> DataFrame:
    return normalize(read_fact(spark, events_fact(spark, data_dir)), fold_case=False)


# first dates need every transfer, whatever the page's range
WHOLE_HISTORY = (reports.new_users, reports.new_user_kpis)


def _base(base_fn, report, params, spark: SparkSession, d: str) -> DataFrame:
    """The relation a report reads: from the orders only the report's own range."""
    if base_fn is orders_base and report not in WHOLE_HISTORY:
        return orders_base(spark, d, params)
    return base_fn(spark, d)


def _on(base_fn, report, params, **kw) -> Query:
    return lambda spark, d: report(_base(base_fn, report, params, spark, d), params, **kw)


def _derived(base_fn, report, params, make) -> Query:
    return lambda spark, d: make(report(_base(base_fn, report, params, spark, d), params))


# --- primitives -----------------------------------------------------------------
def _folded_events(spark: SparkSession, d: str) -> DataFrame:
    return normalize(read_fact(spark, events_fact(spark, d)), fold_case=True)


def p_extract_strings(spark, d):
    return _folded_events(spark, d).select("id", "user_address", "source_chain", "destination_chain", "raw_asset")


def p_amount(spark, d):
    return _folded_events(spark, d).select("id", "amount")


def p_amount_usd(spark, d):
    return _folded_events(spark, d).select("id", "amount_usd")


def p_fee(spark, d):
    return _folded_events(spark, d).select("id", "fee")


def p_normalized(spark, d):
    return _folded_events(spark, d)


def p_normalized_variant(spark, d):
    """The same normalisation with the payload stored as a VARIANT column."""
    raw = events_fact(spark, d).withColumn("data", F.parse_json("data"))
    return normalize(raw, fold_case=True)


def p_route_label(spark, d):
    b = events_base(spark, d)
    return b.select("id", route_label("source_chain", "destination_chain").alias("path"))


def p_success_filter(spark, d):
    return events_fact(spark, d).where(success_filter()).select("id", "status", "simplified_status")


def p_date_range(spark, d):
    return reports.in_range(events_base(spark, d), EVENT_RANGE).select("id", "created_date")


def p_priced(spark, d):
    return events_base(spark, d).where(F.col("amount_usd").isNotNull()).select("id", "amount_usd")


def p_quarter_label(spark, d):
    days = orders_base(spark, d).select("created_date").distinct()
    return days.select("created_date", quarter_label("created_date").alias("quarter"))


def p_weekday_label(spark, d):
    return events_base(spark, d).select(
        "id", F.hour("created_at").alias("hour"), weekday_label("created_at").alias("day"))


def p_first_seen(spark, d):
    return reports.first_seen(orders_base(spark, d))


def p_median(spark, d):
    m = group_median(orders_base(spark, d), "raw_asset", "amount_usd", "median_amount_usd")
    return m.select("raw_asset", F.round("median_amount_usd", 4).alias("median_amount_usd"))


def p_median_ranked(spark, d):
    """The same from a ready table of distinct values and their weights."""
    weighted = weigh(orders_base(spark, d), "raw_asset", "amount_usd")
    m = weighted_median(weighted, "raw_asset", "amount_usd", "weight", "median_amount_usd")
    return m.select("raw_asset", F.round("median_amount_usd", 4).alias("median_amount_usd"))


def _profile_of_tables(spark, d):
    """R14 from a route measure table and a median table made apart."""
    base = orders_base(spark, d, PAGE)
    return R.route_profile(base, PAGE, measures=R.route_measures(base, PAGE), medians=R.route_medians(base, PAGE))


def p_running_total(spark, d):
    daily = (
        reports.in_range(orders_base(spark, d, PAGE), PAGE)
        .groupBy(F.col("created_date").alias("date"))
        .agg(stable_round(F.sum("amount_usd")).alias("total_volume"))
    )
    return daily.withColumn("running_volume", F.sum("total_volume").over(Window.orderBy("date")))


def p_whole_partition_max(spark, d):
    daily = reports.daily_new_users(orders_base(spark, d), PAGE)
    whole = Window.orderBy("date").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return daily.withColumn("peak_new_users", F.max("new_users").over(whole))


def p_distinct_rows(spark, d):
    return orders_base(spark, d).select("source_chain", "destination_chain").distinct()


def p_stored_fact(spark, d):
    """The raw fact written as a table, read back by path under its contract, and normalised."""
    path = scratch_path(spark, "fact")
    events_fact(spark, d).withColumn("loaded", F.lit("later")).write.parquet(path)
    return normalize(read_fact(spark, path), fold_case=True)


def _kept(base_fn, report: str, params: ReportParams) -> Query:
    """``report`` over the kept base and measure tables: the first call makes them, the second only reads."""
    def query(spark: SparkSession, d: str) -> DataFrame:
        Dashboard.from_base(base_fn(spark, d), params, store=ResultStore(spark)).report(report)
        return Dashboard.from_base(base_fn(spark, d), params, store=ResultStore(spark)).report(report)
    return query


def _streamed(report: str, params: ReportParams) -> Query:
    """``report`` over measures that a stream has kept: the fact arrives in three loads whose days overlap."""
    def query(spark: SparkSession, d: str) -> DataFrame:
        raw = events_fact(spark, d)
        loads, kept, checkpoint = (scratch_path(spark, x) for x in ("loads", "cells", "cells-stream"))
        raw.repartition(3, "id").write.parquet(loads)
        stream = spark.readStream.schema(raw.schema).option("maxFilesPerTrigger", 1).parquet(loads)
        start_cells_stream(stream, kept, checkpoint=checkpoint).awaitTermination()
        return getattr(StreamedCells(spark, kept), report)(params)
    return query


def t_streamed_first_seen(spark, d):
    """The users' first dates, kept by a stream in touched buckets."""
    raw = events_fact(spark, d)
    loads, kept, checkpoint = (scratch_path(spark, x) for x in ("loads", "first-state", "first-state-stream"))
    raw.repartition(3, "id").write.parquet(loads)
    stream = spark.readStream.schema(raw.schema).option("maxFilesPerTrigger", 1).parquet(loads)
    start_first_seen_state(stream, kept, buckets=16, checkpoint=checkpoint).awaitTermination()
    return read_first_seen(spark, kept)


# --- registry ------------------------------------------------------------------
O, E = orders_base, events_base

QUERIES: dict[str, Query] = {
    "r01_overview_kpis": _on(O, R.overview_kpis, PAGE),
    "r01_overview_kpis_events": _on(E, R.overview_kpis, EVENT_RANGE),
    "r02_activity_over_time": _on(O, R.activity_over_time, PAGE),
    "r02_activity_over_time_day": _on(O, R.activity_over_time, PAGE.with_grain("day")),
    "r02_activity_over_time_month": _on(O, R.activity_over_time, PAGE.with_grain("month")),
    "r02_activity_over_time_events": _on(E, R.activity_over_time, EVENT_RANGE),
    "r03_quarterly_cumulative": _on(O, R.quarterly_cumulative, PAGE),
    "r03_quarterly_cumulative_month": _on(O, R.quarterly_cumulative, PAGE.with_grain("month")),
    "r04_chain_kpis": _on(O, R.chain_kpis, PAGE),
    "r04_chain_kpis_events": _on(E, R.chain_kpis, EVENT_RANGE),
    "r05_active_chains": _on(O, R.active_chains, PAGE),
    "r05_active_chains_events": _on(E, R.active_chains, EVENT_RANGE),
    "r06_moving_average": _on(O, R.moving_average, PAGE),
    "r06_moving_average_day": _on(O, R.moving_average, PAGE.with_grain("day")),
    "r07_txn_ranges": _on(O, R.txn_ranges, CLASS_WINDOW),
    "r07_txn_ranges_events": _on(E, R.txn_ranges, CLASS_WINDOW),
    "r08_new_users": _on(O, R.new_users, PAGE),
    "r08_new_users_month": _on(O, R.new_users, PAGE.with_grain("month")),
    "r09_new_user_kpis": _on(O, R.new_user_kpis, PAGE),
    "r10_txn_exact": _on(O, R.txn_exact, PAGE),
    "r11_active_days": _on(O, R.active_days, PAGE),
    "r12_paths_per_user": _on(O, R.paths_per_user, PAGE),
    "r13_heatmap": _on(E, R.heatmap, PAGE),
    "r13_heatmap_range": _on(E, R.heatmap, EVENT_RANGE),
    "r14_route_profile": _on(O, R.route_profile, PAGE),
    "r14_route_profile_ranked": _profile_of_tables,
    "r14_route_profile_events": _on(E, R.route_profile, EVENT_RANGE),
    "r15_source_destination": _on(O, R.source_destination, PAGE),
    "r15_source_destination_events": _on(E, R.source_destination, EVENT_RANGE),
    "r16_route_totals": _on(O, R.route_totals, PAGE),
    "r16_route_totals_events": _on(E, R.route_totals, EVENT_RANGE),
    "d1_heatmap_transfers": _derived(E, R.heatmap, PAGE, derived.heatmap_transfers),
    "d2_heatmap_volume": _derived(E, R.heatmap, PAGE, derived.heatmap_volume),
    "d3_routes_numbered": _derived(O, R.route_profile, PAGE, derived.routes_numbered),
    "d4_top_volume": _derived(O, R.route_totals, PAGE, derived.top_volume),
    "d5_top_transfers": _derived(O, R.route_totals, PAGE, derived.top_transfers),
    "d6_top_long": _derived(O, R.route_totals, PAGE, lambda t: derived.top_long(derived.top_transfers(t))),
    "d7_share_txn_ranges": _derived(O, R.txn_ranges, CLASS_WINDOW, derived.share_of_users),
    "d7_share_txn_exact": _derived(O, R.txn_exact, PAGE, derived.share_of_users),
    "d7_share_active_days": _derived(O, R.active_days, PAGE, derived.share_of_users),
    "d7_share_paths": _derived(O, R.paths_per_user, PAGE, derived.share_of_users),
    "r03_quarterly_cumulative_events": _on(E, R.quarterly_cumulative, EVENT_RANGE),
    "r06_moving_average_events": _on(E, R.moving_average, EVENT_RANGE),
    "r08_new_users_events": _on(E, R.new_users, EVENT_COHORT),
    "r09_new_user_kpis_events": _on(E, R.new_user_kpis, EVENT_COHORT),
    "r10_txn_exact_events": _on(E, R.txn_exact, EVENT_RANGE),
    "r11_active_days_events": _on(E, R.active_days, EVENT_RANGE),
    "r12_paths_per_user_events": _on(E, R.paths_per_user, EVENT_RANGE),
    "d3_routes_numbered_events": _derived(E, R.route_profile, EVENT_RANGE, derived.routes_numbered),
    "d4_top_volume_events": _derived(E, R.route_totals, EVENT_RANGE, derived.top_volume),
    "d6_top_long_events": _derived(E, R.route_totals, EVENT_RANGE,
                                   lambda t: derived.top_long(derived.top_transfers(t))),
    "p_extract_strings": p_extract_strings,
    "p_amount": p_amount,
    "p_amount_usd": p_amount_usd,
    "p_fee": p_fee,
    "p_normalized": p_normalized,
    "p_normalized_variant": p_normalized_variant,
    "p_route_label": p_route_label,
    "p_success_filter": p_success_filter,
    "p_date_range": p_date_range,
    "p_priced": p_priced,
    "p_quarter_label": p_quarter_label,
    "p_weekday_label": p_weekday_label,
    "p_first_seen": p_first_seen,
    "p_median": p_median,
    "p_median_ranked": p_median_ranked,
    "p_running_total": p_running_total,
    "p_whole_partition_max": p_whole_partition_max,
    "p_distinct_rows": p_distinct_rows,
    "p_stored_fact": p_stored_fact,
    "t_streamed_activity": _streamed("activity_over_time", EVENT_RANGE),
    "t_streamed_quarterly": _streamed("quarterly_cumulative", EVENT_RANGE),
    "t_streamed_chains": _streamed("active_chains", EVENT_RANGE),
    "t_streamed_moving_average": _streamed("moving_average", EVENT_RANGE),
    "t_streamed_heatmap": _streamed("heatmap", EVENT_RANGE),
    "t_streamed_first_seen": t_streamed_first_seen,
    "s_kept_activity": _kept(O, "r02_activity_over_time", PAGE),
    "s_kept_activity_events": _kept(E, "r02_activity_over_time", EVENT_RANGE),
    "s_kept_quarterly": _kept(O, "r03_quarterly_cumulative", PAGE),
    "s_kept_chain_kpis": _kept(O, "r04_chain_kpis", PAGE),
    "s_kept_heatmap": _kept(E, "r13_heatmap", PAGE),
    "s_kept_route_profile": _kept(O, "r14_route_profile", PAGE),
    "s_kept_route_profile_events": _kept(E, "r14_route_profile", EVENT_RANGE),
    "s_kept_pairs_events": _kept(E, "r15_source_destination", EVENT_RANGE),
}
