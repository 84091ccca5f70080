"""Time bucketing on DATE values (no session time zone involved)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numeric import _col

GRAINS = ("day", "week", "month")


def check_grain(grain: str) -> str:
    if grain not in GRAINS:
        raise ValueError(f"grain must be one of {GRAINS}, got {grain!r}")
    return grain


def time_bucket(day: Column | str, grain: str) -> Column:
    """First day of the ``grain`` bucket holding a DATE, as a DATE.

    Weeks start on Monday.  Working on the DATE (not the timestamp) keeps the
    bucket a pure calendar function, independent of ``spark.sql.session.timeZone``.
    """
    day = _col(day)
    grain = check_grain(grain)
    if grain == "day":
        return day
    return F.trunc(day, grain)
