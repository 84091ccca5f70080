"""The sixteen dashboard reports over the normalised transfer relation.

Every report is ``(base, params, ...) -> DataFrame`` and only builds a lazy
plan; nothing runs before the result is read.  ``base`` has ``BASE_COLUMNS`` with chain names as written; reports that
the dashboard shows case-folded fold them here (``fold_case``).

Each report is split in two: a *measure table* -- one scan of the pruned base
and one hash aggregation keyed on a small domain (time bucket, user, route,
hour x weekday) -- and a *finish* step (rounding, classes, windows, order) on
that already aggregated table.  Standalone, a report computes just the
measures it needs.  The dashboard (``plans.dashboard``) computes a measure
table once and finishes several reports from it, e.g. one per-bucket table
serves the activity, active-chain and moving-average reports.

Distinct counts are planned by Spark as an expand + two-level aggregation
keyed on ``(group, value)``, so a hot group is spread over tasks by its
distinct values instead of landing in one task; sums, means and maxima are
combined map-side before the shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.labels import (
    DAY_EXACT_CLASSES,
    PATH_EXACT_CLASSES,
    TXN_EXACT_CLASSES,
    TXN_RANGE_CLASSES,
    CountClass,
    bucketize,
    quarter_label,
    route_label,
    weekday_label,
)
from ..functions.numeric import safe_ratio, stable_round
from ..functions.time import time_bucket
from ..params import CLASS_WINDOW, ReportParams
from .median import group_median, weighted_median
from .normalize import fold

asc = F.asc_nulls_last
desc = F.desc_nulls_first   # the dashboard's warehouse sorts NULL as the largest value


def in_range(base: DataFrame, p: ReportParams) -> DataFrame:
    """Transfers whose date lies in ``[p.start, p.end]`` (pushed to the scan as a range).

    On a base written with one directory per month (``created_month``), the
    month range is added as well, so whole directories are pruned.
    """
    cond = F.col("created_date").between(F.lit(p.start), F.lit(p.end))
    if "created_month" in base.columns:
        cond = cond & F.col("created_month").between(F.trunc(F.lit(p.start), "month"), F.lit(p.end))
    return base.where(cond)


def _volume(col: str = "amount_usd") -> Column:
    return stable_round(F.sum(col))


def _chain(name: str, fold_case: bool) -> Column:
    return fold(F.col(name), fold_case)


def _route(fold_case: bool) -> Column:
    return route_label(_chain("source_chain", fold_case), _chain("destination_chain", fold_case))


def _measures(names: Sequence[str], catalog: dict[str, Column]) -> list[Column]:
    return [catalog[n].alias(n) for n in names]


# --- measure tables ----------------------------------------------------------
OVERALL_MEASURES = ("total_transactions", "unique_users", "number_of_sources", "number_of_destinations",
                    "_sum_usd", "_avg_usd", "_max_usd")


def overall_measures(base: DataFrame, p: ReportParams, names: Sequence[str] = OVERALL_MEASURES,
                     fold_case: bool = True) -> DataFrame:
    """One row of whole-range measures (a global aggregate: one row even when empty)."""
    catalog = {
        "total_transactions": F.count_distinct("id"),
        "unique_users": F.count_distinct("user_address"),
        "number_of_sources": F.count_distinct(_chain("source_chain", fold_case)),
        "number_of_destinations": F.count_distinct(_chain("destination_chain", fold_case)),
        "_sum_usd": F.sum("amount_usd"),
        "_avg_usd": F.avg("amount_usd"),
        "_max_usd": F.max("amount_usd"),
    }
    return in_range(base, p).agg(*_measures(names, catalog))


BUCKET_MEASURES = ("total_transactions", "unique_users", "sources", "destinations", "_sum_usd")


def bucket_measures(base: DataFrame, p: ReportParams, names: Sequence[str] = BUCKET_MEASURES,
                    fold_case: bool = True) -> DataFrame:
    """One row per time bucket of ``p.grain`` (column ``date``)."""
    catalog = {
        "total_transactions": F.count_distinct("id"),
        "unique_users": F.count_distinct("user_address"),
        "sources": F.count_distinct(_chain("source_chain", fold_case)),
        "destinations": F.count_distinct(_chain("destination_chain", fold_case)),
        "_sum_usd": F.sum("amount_usd"),
    }
    return (
        in_range(base, p)
        .groupBy(time_bucket("created_date", p.grain).alias("date"))
        .agg(*_measures(names, catalog))
    )


# --- daily cells: the small-domain part of the measure tables --------------------
def daily_cells(base: DataFrame, p: ReportParams) -> DataFrame:
    """Per day, source, destination and token (as written): sum, count and maximum of the values.

    Days, chains and tokens are few, so the cells are combined map-side and
    every measure over them -- distinct days, chains and tokens, volumes, means,
    maxima -- is read from this table.  Only the distinct ids and users still
    need the transfers (``distinct_transfers``): a transfer becomes one row here
    and two there, where one aggregation for all would make five.
    """
    return in_range(base, p).groupBy("created_date", "source_chain", "destination_chain", "raw_asset").agg(
        F.sum("amount_usd").alias("_sum_usd"), F.count("amount_usd").alias("_n_usd"), F.max("amount_usd").alias("_max_usd"))


def _cell_sums() -> list[Column]:
    return [F.sum("_sum_usd").alias("_sum_usd"), F.max("_max_usd").alias("_max_usd"), F.sum("_n_usd").alias("_n_usd")]


def _with_mean(df: DataFrame) -> DataFrame:
    return df.withColumn("_avg_usd", safe_ratio("_sum_usd", "_n_usd"))


def distinct_transfers(base: DataFrame, p: ReportParams, by: Column | None = None) -> DataFrame:
    """``(by, ids, users)``: distinct transfers and users per group (one row without a group)."""
    rows = in_range(base, p)
    counts = [F.count_distinct("id").alias("ids"), F.count_distinct("user_address").alias("users")]
    return rows.groupBy(by.alias("by")).agg(*counts) if by is not None else rows.agg(*counts)


def bucket_of(p: ReportParams) -> Column:
    return time_bucket("created_date", p.grain)


def route_of(fold_case: bool = False) -> Column:
    return _route(fold_case)


def overall_from_cells(cells: DataFrame, distinct: DataFrame, fold_case: bool = True) -> DataFrame:
    """The ``overall_measures`` of daily cells and ``distinct_transfers``: one row each, put side by side."""
    one = _with_mean(cells.agg(F.count_distinct(_chain("source_chain", fold_case)).alias("number_of_sources"),
                               F.count_distinct(_chain("destination_chain", fold_case)).alias("number_of_destinations"), *_cell_sums()))
    counts = distinct.select(F.col("ids").alias("total_transactions"), F.col("users").alias("unique_users"), F.lit(0).alias("_one"))
    return one.withColumn("_one", F.lit(0)).join(counts, "_one").drop("_one")


def buckets_from_cells(cells: DataFrame, distinct: DataFrame, p: ReportParams, fold_case: bool = True) -> DataFrame:
    """The ``bucket_measures`` of daily cells and of ``distinct_transfers`` by bucket."""
    sums = cells.groupBy(bucket_of(p).alias("date")).agg(
        F.count_distinct(_chain("source_chain", fold_case)).alias("sources"),
        F.count_distinct(_chain("destination_chain", fold_case)).alias("destinations"), *_cell_sums())
    counts = distinct.select(F.col("by").alias("date"), F.col("ids").alias("total_transactions"), F.col("users").alias("unique_users"))
    return sums.join(counts, "date")


def routes_from_cells(cells: DataFrame, distinct: DataFrame, fold_case: bool = False) -> DataFrame:
    """The ``route_measures`` of daily cells and of ``distinct_transfers`` by route."""
    sums = cells.groupBy(_route(fold_case).alias("path")).agg(
        F.count_distinct("created_date").alias("active_days"), F.count_distinct("raw_asset").alias("transferred_tokens"), *_cell_sums())
    counts = distinct.select("by", F.col("ids").alias("number_of_transfers"), F.col("users").alias("number_of_users"))
    return _with_mean(sums.join(counts, F.col("path").eqNullSafe(F.col("by"))).drop("by"))


def quarters_from_cells(cells: DataFrame, p: ReportParams) -> DataFrame:
    """The ``quarterly_cumulative`` report of daily cells."""
    return _cumulative(cells, p, "_sum_usd", (2022, 2026), False)


USER_MEASURES = ("_txns", "_days", "_paths")


def user_measures(base: DataFrame, p: ReportParams, names: Sequence[str] = USER_MEASURES,
                  fold_case: bool = True) -> DataFrame:
    """One row per user (the NULL user included): transfers, active days, routes."""
    catalog = {
        "_txns": F.count_distinct("id"),
        "_days": F.count_distinct("created_date"),
        "_paths": F.count_distinct(_route(fold_case)),
    }
    return in_range(base, p).groupBy("user_address").agg(*_measures(names, catalog))


ROUTE_MEASURES = ("active_days", "number_of_transfers", "number_of_users", "transferred_tokens",
                  "_sum_usd", "_avg_usd", "_max_usd", "_n_usd")


def route_measures(base: DataFrame, p: ReportParams, names: Sequence[str] = ROUTE_MEASURES,
                   fold_case: bool = False) -> DataFrame:
    """One row per route label ``path`` (NULL when a chain is NULL; the NULL route is a group)."""
    catalog = {
        "active_days": F.count_distinct("created_date"),
        "number_of_transfers": F.count_distinct("id"),
        "number_of_users": F.count_distinct("user_address"),
        "transferred_tokens": F.count_distinct("raw_asset"),
        "_sum_usd": F.sum("amount_usd"),
        "_avg_usd": F.avg("amount_usd"),
        "_max_usd": F.max("amount_usd"),
        "_n_usd": F.count("amount_usd"),
    }
    return in_range(base, p).groupBy(_route(fold_case).alias("path")).agg(*_measures(names, catalog))


def route_medians(base: DataFrame, p: ReportParams, fold_case: bool = False) -> DataFrame:
    """``(path, _median_usd)``: exact median transfer value per route."""
    rows = in_range(base, p).select(_route(fold_case).alias("path"), "amount_usd")
    return group_median(rows, "path", "amount_usd", "_median_usd")


# what a route's cells count; the last one weighs the distinct values
_CELLS = ("id", "user_address", "created_date", "raw_asset", "amount_usd")


def route_cells(base: DataFrame, p: ReportParams, fold_case: bool = False) -> DataFrame:
    """``(path, kind, item, usd, weight)``: each distinct id, user, day, token and value of a route.

    One scan and one shuffle, dealt out by route *and* item.  The distinct
    counts, the sums and the median of a route are all read from this table
    (``cell_measures``, ``median.weighted_median``), so the fact behind it is
    not scanned again for the median.  ``weight`` is the number of transfers
    with the value, 0 for the other kinds.
    """
    none = F.lit(None)
    cells = [F.struct(F.lit(c).alias("kind"), F.col(c).cast("string").alias("item"), none.cast("double").alias("usd")) for c in _CELLS[:-1]]
    cells.append(F.struct(F.lit(_CELLS[-1]).alias("kind"), none.cast("string").alias("item"), F.col("amount_usd").alias("usd")))
    rows = in_range(base, p).select(_route(fold_case).alias("path"), F.explode(F.array(*cells)).alias("cell")).select("path", "cell.*")
    return rows.groupBy("path", "kind", "item", "usd").agg(F.count("usd").alias("weight"))


def cell_measures(cells: DataFrame) -> DataFrame:
    """The ``route_measures`` of a ``route_cells`` table."""
    distinct = lambda c: F.count_if((F.col("kind") == c) & F.col("item").isNotNull())
    sums = cells.groupBy("path").agg(
        distinct("created_date").alias("active_days"), distinct("id").alias("number_of_transfers"),
        distinct("user_address").alias("number_of_users"), distinct("raw_asset").alias("transferred_tokens"),
        F.sum(F.col("usd") * F.col("weight")).alias("_sum_usd"), F.max("usd").alias("_max_usd"), F.sum("weight").alias("_n_usd"))
    return sums.withColumn("_avg_usd", safe_ratio("_sum_usd", "_n_usd"))


# --- R01 -------------------------------------------------------------------
def overview_kpis(base: DataFrame, p: ReportParams, measures: DataFrame | None = None) -> DataFrame:
    """One row: transfers, users, volume, volume per user."""
    m = measures if measures is not None else overall_measures(
        base, p, ("total_transactions", "unique_users", "_sum_usd"))
    return m.select(
        "total_transactions",
        "unique_users",
        stable_round("_sum_usd").alias("total_volume"),
        stable_round(safe_ratio("_sum_usd", "unique_users")).alias("average_volume_per_user"),
    )


# --- R02 -------------------------------------------------------------------
def activity_over_time(base: DataFrame, p: ReportParams, measures: DataFrame | None = None) -> DataFrame:
    """Transfers, users and volume per time bucket."""
    m = measures if measures is not None else bucket_measures(
        base, p, ("total_transactions", "unique_users", "_sum_usd"))
    return m.select(
        "date", "total_transactions", "unique_users", stable_round("_sum_usd").alias("total_volume"),
    ).orderBy(asc("date"))


# --- R03 -------------------------------------------------------------------
def quarterly_cumulative(base: DataFrame, p: ReportParams, years: tuple[int, int] | None = (2022, 2026),
                         inclusive_last_day: bool = False) -> DataFrame:
    """Volume per (bucket, quarter) and its running total inside the quarter.

    A bucket that straddles a quarter boundary yields one row per quarter;
    days outside the labelled quarters form the NULL quarter.
    """
    return _cumulative(in_range(base, p), p, "amount_usd", years, inclusive_last_day)


def _cumulative(rows: DataFrame, p: ReportParams, usd: str, years: tuple[int, int] | None, inclusive_last_day: bool) -> DataFrame:
    per_bucket = (
        rows.groupBy(
            time_bucket("created_date", p.grain).alias("date"),
            quarter_label("created_date", years, inclusive_last_day).alias("quarter"),
        )
        .agg(_volume(usd).alias("total_volume"))
    )
    running = Window.partitionBy("quarter").orderBy("date")
    return (
        per_bucket.withColumn("cumulative_volume", F.sum("total_volume").over(running))
        .orderBy(asc("date"), asc("quarter"))
    )


# --- R04 -------------------------------------------------------------------
def chain_kpis(base: DataFrame, p: ReportParams, fold_case: bool = True,
               measures: DataFrame | None = None) -> DataFrame:
    """One row: distinct sources, destinations, mean and max transfer value."""
    m = measures if measures is not None else overall_measures(
        base, p, ("number_of_sources", "number_of_destinations", "_avg_usd", "_max_usd"), fold_case)
    return m.select(
        "number_of_sources",
        "number_of_destinations",
        stable_round("_avg_usd").alias("average_volume"),
        stable_round("_max_usd").alias("max_volume"),
    )


# --- R05 -------------------------------------------------------------------
def active_chains(base: DataFrame, p: ReportParams, fold_case: bool = True,
                  measures: DataFrame | None = None) -> DataFrame:
    """Distinct source and destination chains per time bucket."""
    m = measures if measures is not None else bucket_measures(base, p, ("sources", "destinations"), fold_case)
    return m.select("date", "sources", "destinations").orderBy(asc("date"))


# --- R06 -------------------------------------------------------------------
# Trailing window sizes in buckets and the names the dashboard
# gives them ("30/60/90 day" whatever the grain).
MOVING_WINDOWS = ((5, "avg_30_day_moving"), (9, "avg_60_day_moving"), (13, "avg_90_day_moving"))


def moving_average(base: DataFrame, p: ReportParams,
                   windows: Sequence[tuple[int, str]] = MOVING_WINDOWS,
                   measures: DataFrame | None = None) -> DataFrame:
    """Rounded volume per bucket and trailing means over the last n *buckets*.

    The windows count rows, whatever the grain, and empty buckets are not
    filled in (the dashboard's "30/60/90 day" labels are 5/9/13 buckets).
    The window runs over the aggregated series: one row per bucket.
    """
    m = measures if measures is not None else bucket_measures(base, p, ("_sum_usd",))
    series = m.select("date", stable_round("_sum_usd").alias("usd_volume"))
    cols = [F.col("date"), F.col("usd_volume")]
    for size, name in windows:
        trailing = Window.orderBy("date").rowsBetween(-(size - 1), Window.currentRow)
        cols.append(F.avg("usd_volume").over(trailing).alias(name))
    return series.select(*cols).orderBy(asc("date"))


# --- R07, R10, R11, R12: users per activity class ----------------------------
def users_per_class(per_user: DataFrame, measure: str, classes: Sequence[CountClass],
                    label: str) -> DataFrame:
    """Users per class of a per-user measure.

    ``per_user`` has one row per user (the NULL user is a group of its own that
    adds no user to its class), so counting non-NULL users per class is the
    distinct count -- without a second distinct aggregation.
    """
    return (
        per_user.groupBy(bucketize(measure, classes).alias(label))
        .agg(F.count("user_address").alias("number_of_users"))
        .orderBy(desc("number_of_users"), asc(label))
    )


def txn_ranges(base: DataFrame, p: ReportParams = CLASS_WINDOW, measures: DataFrame | None = None) -> DataFrame:
    """Users per range of transfer count (1, 2, 3-5, ... >50).

    The dashboard always uses 2022-11-01..2025-08-31 here, whatever the page
    range; that window is the default.
    """
    m = measures if measures is not None else user_measures(base, p, ("_txns",))
    return users_per_class(m, "_txns", TXN_RANGE_CLASSES, "class")


def txn_exact(base: DataFrame, p: ReportParams, measures: DataFrame | None = None) -> DataFrame:
    """Users per exact transfer count 1..10, then >10."""
    m = measures if measures is not None else user_measures(base, p, ("_txns",))
    return users_per_class(m, "_txns", TXN_EXACT_CLASSES, "number_of_txns")


def active_days(base: DataFrame, p: ReportParams, measures: DataFrame | None = None) -> DataFrame:
    """Users per number of distinct active days 1..10, then >10."""
    m = measures if measures is not None else user_measures(base, p, ("_days",))
    return users_per_class(m, "_days", DAY_EXACT_CLASSES, "days_of_activity")


def paths_per_user(base: DataFrame, p: ReportParams, fold_case: bool = True,
                   measures: DataFrame | None = None) -> DataFrame:
    """Users per number of distinct routes 1..10, then >10 (routes case-folded)."""
    m = measures if measures is not None else user_measures(base, p, ("_paths",), fold_case)
    return users_per_class(m, "_paths", PATH_EXACT_CLASSES, "number_of_paths")


# --- R08, R09: first-seen users ----------------------------------------------
def first_seen(base: DataFrame) -> DataFrame:
    """``(user_address, first_txn_date)`` over the whole history.

    Any date filter must be applied to the result, never below the min.
    """
    return base.groupBy("user_address").agg(F.min("created_date").alias("first_txn_date"))


def daily_new_users(base: DataFrame, p: ReportParams, first: DataFrame | None = None) -> DataFrame:
    """``(date, new_users)`` for each day in range on which some user was first seen.

    ``first_seen`` has one row per user, so new users per day are a plain count
    of non-NULL users (the NULL user adds nothing, as in a distinct count).
    ``first`` is a ready first-seen table (e.g. ``streaming.first_seen_table``)
    to use instead of scanning the whole history of ``base``.
    """
    return (
        (first if first is not None else first_seen(base))
        .where(F.col("first_txn_date").between(F.lit(p.start), F.lit(p.end)))
        .groupBy(F.col("first_txn_date").alias("date"))
        .agg(F.count("user_address").alias("new_users"))
    )


def new_users(base: DataFrame, p: ReportParams, daily: DataFrame | None = None) -> DataFrame:
    """Users whose first transfer falls in each bucket, and the running total.

    A user has one first date, so a bucket's new users are the sum of its days'.
    """
    d = daily if daily is not None else daily_new_users(base, p)
    per_bucket = (
        d.groupBy(time_bucket("date", p.grain).alias("date"))
        .agg(F.sum("new_users").cast("bigint").alias("new_users"))
    )
    running = Window.orderBy("date")
    return (
        per_bucket.withColumn("cumulative_new_users", F.sum("new_users").over(running).cast("bigint"))
        .orderBy(asc("date"))
    )


def new_user_kpis(base: DataFrame, p: ReportParams, daily: DataFrame | None = None) -> DataFrame:
    """One row: new users in range, and their mean per day that had any."""
    d = daily if daily is not None else daily_new_users(base, p)
    return d.agg(
        F.sum("new_users").cast("bigint").alias("cumulative_new_users"),
        stable_round(F.avg("new_users")).alias("average_daily_new_users"),
    )


# --- R13 -------------------------------------------------------------------
def heatmap_order() -> list[Column]:
    return [asc("hour"), asc("day")]


def heatmap(base: DataFrame, p: ReportParams) -> DataFrame:
    """Transfers and volume per (hour of day, weekday)."""
    return (
        in_range(base, p)
        .groupBy(F.hour("created_at").alias("hour"), weekday_label("created_at").alias("day"))
        .agg(F.count_distinct("id").alias("number_of_transfers"), _volume().alias("volume_of_transfers"))
        .orderBy(*heatmap_order())
    )


# --- R14 -------------------------------------------------------------------
def route_profile(base: DataFrame, p: ReportParams, fold_case: bool = False,
                  measures: DataFrame | None = None, medians: DataFrame | None = None) -> DataFrame:
    """Per route: activity, users, tokens, and volume statistics (not case-folded)."""
    if measures is None and medians is None:
        cells = route_cells(base, p, fold_case)
        measures = cell_measures(cells)
        # the weight is an aggregate: this filter cannot move below the cells, which both parts then share
        medians = weighted_median(cells.where("weight > 0"), "path", "usd", "weight", "_median_usd")
    stats = measures if measures is not None else route_measures(base, p, fold_case=fold_case)
    med = medians if medians is not None else route_medians(base, p, fold_case)
    med = med.withColumnRenamed("path", "_mpath")
    joined = stats.join(med, stats.path.eqNullSafe(med._mpath), "left")
    return joined.select(
        "path",
        "active_days",
        "number_of_transfers",
        "number_of_users",
        stable_round(safe_ratio("number_of_users", "active_days")).alias("avg_daily_users"),
        "transferred_tokens",
        stable_round("_sum_usd").alias("volume_usd"),
        stable_round("_avg_usd").alias("avg_volume_usd"),
        stable_round("_median_usd").alias("median_volume_usd"),
        stable_round("_max_usd").alias("max_volume_usd"),
        stable_round(safe_ratio("_sum_usd", "active_days")).alias("avg_daily_volume_usd"),
    ).orderBy(desc("active_days"), asc("path"))


# --- R15 -------------------------------------------------------------------
def pairs_order() -> list[Column]:
    return [desc("volume_usd"), asc("number_of_transactions"), asc("source_chain"), asc("destination_chain")]


def source_destination(base: DataFrame, p: ReportParams, fold_case: bool = True) -> DataFrame:
    """Volume and transfers per (source, destination), priced transfers only."""
    return (
        in_range(base, p)
        .where(F.col("amount_usd").isNotNull())
        .groupBy(
            _chain("source_chain", fold_case).alias("source_chain"),
            _chain("destination_chain", fold_case).alias("destination_chain"),
        )
        .agg(_volume().alias("volume_usd"), F.count_distinct("id").alias("number_of_transactions"))
        .orderBy(*pairs_order())
    )


# --- R16 -------------------------------------------------------------------
def route_totals(base: DataFrame, p: ReportParams, fold_case: bool = False,
                 measures: DataFrame | None = None) -> DataFrame:
    """Transfers, users and volume per route (not case-folded)."""
    m = measures if measures is not None else route_measures(
        base, p, ("number_of_transfers", "number_of_users", "_sum_usd"), fold_case)
    return m.select(
        "path", "number_of_transfers", "number_of_users",
        stable_round("_sum_usd").alias("volume_of_transfers_usd"),
    ).orderBy(desc("number_of_transfers"), asc("path"))
