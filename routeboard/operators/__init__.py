"""Relational operators: normalisation, the sixteen reports, derived tables, reshapes."""

from . import derived, reports, reshape
from .median import group_median
from .normalize import normalize, success_filter

__all__ = ["derived", "reports", "reshape", "group_median", "normalize", "success_filter"]
