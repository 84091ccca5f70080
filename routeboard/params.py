"""Report parameters."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date, datetime

from .functions.time import check_grain

# The dashboard's default range and grain, and the date window
# its transaction-class breakdown always uses.
DEFAULT_START = date(2023, 1, 1)
DEFAULT_END = date(2025, 8, 31)
DEFAULT_GRAIN = "week"
CLASS_WINDOW_START = date(2022, 11, 1)
CLASS_WINDOW_END = date(2025, 8, 31)


@dataclass(frozen=True)
class ReportParams:
    """Inclusive date range on the transfer date plus a time-bucket grain."""

    start: date = DEFAULT_START
    end: date = DEFAULT_END
    grain: str = DEFAULT_GRAIN

    def __post_init__(self) -> None:
        check_grain(self.grain)
        # a datetime is a date too, but its time of day would cut the first day short
        if any(not isinstance(d, date) or isinstance(d, datetime) for d in (self.start, self.end)):
            raise TypeError("start and end must be datetime.date values without a time of day")

    def with_grain(self, grain: str) -> "ReportParams":
        return ReportParams(self.start, self.end, grain)


CLASS_WINDOW = ReportParams(CLASS_WINDOW_START, CLASS_WINDOW_END)
