"""Derived tables drawn from report results (matrices, top-10s, long form, shares)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .reshape import format_numbers, melt, number_rows, pivot_hours, share_of_total, top_k

TOP_K = 10


def heatmap_transfers(heat: DataFrame) -> DataFrame:
    """D1: weekday x hour matrix of transfer counts (from ``heatmap``)."""
    return pivot_hours(heat, "number_of_transfers")


def heatmap_volume(heat: DataFrame) -> DataFrame:
    """D2: weekday x hour matrix of volume (from ``heatmap``)."""
    return pivot_hours(heat, "volume_of_transfers")


def routes_numbered(profile: DataFrame) -> DataFrame:
    """D3: route profile numbered from 1 in report order, numbers as text."""
    numbered = number_rows(profile, [F.desc_nulls_first("active_days"), F.asc_nulls_last("path")])
    return format_numbers(numbered, skip=("row_number",))


def top_volume(totals: DataFrame, k: int = TOP_K) -> DataFrame:
    """D4: the k routes with the largest volume (NULL volume last; ties in report order)."""
    return top_k(totals, [F.desc_nulls_last("volume_of_transfers_usd"),
                          F.desc_nulls_first("number_of_transfers"), F.asc_nulls_last("path")], k)


def top_transfers(totals: DataFrame, k: int = TOP_K) -> DataFrame:
    """D5: the k routes with the most transfers (ties in report order)."""
    return top_k(totals, [F.desc_nulls_last("number_of_transfers"), F.asc_nulls_last("path")], k)


def top_long(top: DataFrame) -> DataFrame:
    """D6: a top-k table in long form ``(path, metric, count)``, two rows per route."""
    return melt(top, ["path"], ["number_of_transfers", "number_of_users"], "metric", "count")


def share_of_users(classes: DataFrame) -> DataFrame:
    """D7: each class's share of users (from any users-per-class report)."""
    return share_of_total(classes, "number_of_users", "share_of_users")
