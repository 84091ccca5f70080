"""Classification expressions: count classes, quarter and weekday labels, routes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numeric import _col

# A class is (low, high, label); ``high=None`` means open-ended.
CountClass = tuple[int, int | None, str]

# --- Fixed values: class labels exactly as the dashboard shows them ---------
# (irregular spellings such as "4 Txn" and "7 Txn" are part of the contract)

TXN_RANGE_CLASSES: list[CountClass] = [
    (1, 1, "1 Txn"),
    (2, 2, "2 Txns"),
    (3, 5, "3-5 Txns"),
    (6, 10, "6-10 Txns"),
    (11, 15, "11-15 Txns"),
    (16, 25, "16-25 Txns"),
    (26, 50, "26-50 Txns"),
    (51, None, ">50 Txns"),
]

TXN_EXACT_LABELS = [
    "1 Txn", "2 Txns", "3 Txns", "4 Txn", "5 Txns",
    "6 Txns", "7 Txn", "8 Txns", "9 Txns", "10 Txns",
]
TXN_EXACT_OVERFLOW = ">10 Txns"

DAY_EXACT_LABELS = [
    "1 Day", "2 Days", "3 Days", "4 Days", "5 Days",
    "6 Days", "7 Days", "8 Days", "9 Days", "10 Days",
]
DAY_EXACT_OVERFLOW = ">10 Days"

PATH_EXACT_LABELS = [
    "1 Path", "2 Paths", "3 Paths", "4 Paths", "5 Paths",
    "6 Paths", "7 Paths", "8 Paths", "9 Paths", "10 Paths",
]
PATH_EXACT_OVERFLOW = ">10 Paths"

ROUTE_SEPARATOR = "➡"  # the arrow between source and destination

# ---------------------------------------------------------------------------


def exact_classes(labels: Sequence[str], overflow: str) -> list[CountClass]:
    """One class per count 1..len(labels), then one open class above."""
    classes: list[CountClass] = [(i + 1, i + 1, lab) for i, lab in enumerate(labels)]
    classes.append((len(labels) + 1, None, overflow))
    return classes


TXN_EXACT_CLASSES = exact_classes(TXN_EXACT_LABELS, TXN_EXACT_OVERFLOW)
DAY_EXACT_CLASSES = exact_classes(DAY_EXACT_LABELS, DAY_EXACT_OVERFLOW)
PATH_EXACT_CLASSES = exact_classes(PATH_EXACT_LABELS, PATH_EXACT_OVERFLOW)


def bucketize(count: Column | str, classes: Sequence[CountClass]) -> Column:
    """Label of the class containing ``count``; NULL when none does (0, NULL)."""
    count = _col(count)
    expr = None
    for low, high, label in classes:
        cond = count >= low if high is None else count.between(low, high)
        expr = F.when(cond, F.lit(label)) if expr is None else expr.when(cond, F.lit(label))
    return expr


def quarter_label(
    day: Column | str,
    years: tuple[int, int] | None = (2022, 2026),
    inclusive_last_day: bool = False,
) -> Column:
    """``Qn-YYYY`` for the quarter of a DATE.

    Defaults keep the dashboard's behaviour: only 2022-2026 are labelled and
    the last day of every quarter falls outside its quarter (NULL).  Pass
    ``years=None`` to label any year and ``inclusive_last_day=True`` to keep
    the last day.
    """
    day = _col(day)
    label = F.concat(F.lit("Q"), F.quarter(day).cast("string"), F.lit("-"), F.year(day).cast("string"))
    cond = F.lit(True)
    if years is not None:
        cond = F.year(day).between(years[0], years[1])
    if not inclusive_last_day:
        last_day = F.date_sub(F.add_months(F.trunc(day, "quarter"), 3), 1)
        cond = cond & (day < last_day)
    return F.when(cond, label)


def weekday_label(ts: Column | str) -> Column:
    """``1 - Mon`` ... ``7 - Sun`` (Monday first)."""
    ts = _col(ts)
    return F.concat((F.weekday(ts) + 1).cast("string"), F.lit(" - "), F.date_format(ts, "E"))


def route_label(source: Column | str, destination: Column | str) -> Column:
    """``source➡destination``; NULL when either side is NULL."""
    return F.concat(_col(source), F.lit(ROUTE_SEPARATOR), _col(destination))
