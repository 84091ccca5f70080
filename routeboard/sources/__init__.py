"""Sources: the raw transfer fact and the relations derived from the given tables."""

from .envelope import events_fact
from .order_lines import DATE_SHIFT_DAYS, order_lines_base
from .schema import BASE_COLUMNS, DATA_SCHEMA, FACT_COLUMNS
from .tables import read_fact, read_table

__all__ = [
    "events_fact", "order_lines_base", "DATE_SHIFT_DAYS", "BASE_COLUMNS", "DATA_SCHEMA",
    "FACT_COLUMNS", "read_fact", "read_table",
]
