"""Column-expression helpers (all JVM-side built-ins, no UDFs)."""

from .labels import (
    DAY_EXACT_CLASSES,
    PATH_EXACT_CLASSES,
    ROUTE_SEPARATOR,
    TXN_EXACT_CLASSES,
    TXN_RANGE_CLASSES,
    bucketize,
    exact_classes,
    quarter_label,
    route_label,
    weekday_label,
)
from .numeric import NUMBER_PATTERN, safe_ratio, stable_round, strict_double
from .time import GRAINS, check_grain, time_bucket

__all__ = [
    "DAY_EXACT_CLASSES", "PATH_EXACT_CLASSES", "ROUTE_SEPARATOR", "TXN_EXACT_CLASSES",
    "TXN_RANGE_CLASSES", "bucketize", "exact_classes", "quarter_label", "route_label",
    "weekday_label", "NUMBER_PATTERN", "safe_ratio", "stable_round", "strict_double",
    "GRAINS", "check_grain", "time_bucket",
]
