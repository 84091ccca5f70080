"""Reshapes applied to report results: pivots, top-k, long form, shares, numbering, text.

They run on report outputs, whose row counts are bounded by the report's
group domain (hours x weekdays, classes, routes), so the global windows and
sorts below see small inputs; they still stay in the Spark plan rather than
being pulled to the driver.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .numbering import number_in_order

HOURS = list(range(24))


def hour_column(h: int) -> str:
    return f"h{h:02d}"


def pivot_hours(heat: DataFrame, value: str, index: str = "day", hour: str = "hour") -> DataFrame:
    """Weekday x hour matrix of ``value`` (mean per cell), absent cells 0.

    Rows whose value is NULL are absent, so a weekday with no value at all has
    no row.  All 24 hour columns are always present (``h00`` .. ``h23``); the
    pivot values are given, so Spark runs no extra job to discover them.
    """
    wide = (
        heat.where(F.col(value).isNotNull())
        .groupBy(index)
        .pivot(hour, HOURS)
        .agg(F.avg(value))
    )
    wide = wide.select(index, *[F.col(str(h)).alias(hour_column(h)) for h in HOURS])
    return wide.na.fill(0, subset=[hour_column(h) for h in HOURS]).orderBy(F.asc_nulls_last(index))


def top_k(df: DataFrame, order: Sequence[Column], k: int = 10) -> DataFrame:
    """First ``k`` rows in ``order`` (planned as a per-partition top-k plus a final merge)."""
    return df.orderBy(*order).limit(k)


def melt(df: DataFrame, id_cols: Sequence[str], value_cols: Sequence[str],
         var_name: str = "metric", value_name: str = "count") -> DataFrame:
    """Wide -> long: one row per (id, value column)."""
    return df.unpivot(list(id_cols), list(value_cols), var_name, value_name)


def share_of_total(df: DataFrame, value: str, out: str = "share") -> DataFrame:
    """``value / sum(value)`` over all rows (a small class table)."""
    total = F.sum(value).over(Window.partitionBy())
    return df.withColumn(out, F.try_divide(F.col(value).cast("double"), total.cast("double")))


def number_rows(df: DataFrame, order: Sequence[Column], out: str = "row_number") -> DataFrame:
    """1-based position of each row in ``order``, as the first column (numbered by ranges, see ``numbering``)."""
    return number_in_order(df, order, out=out).select(out, *df.columns)


def format_numbers(df: DataFrame, skip: Sequence[str] = ()) -> DataFrame:
    """Numeric columns as thousands-separated text.

    Integers as ``1,234``; doubles keep one decimal (``1,234.0``), the way the
    dashboard prints its already-rounded measures.
    """
    cols = []
    for field in df.schema.fields:
        c = F.col(field.name)
        if field.name in skip:
            cols.append(c)
        elif isinstance(field.dataType, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
            cols.append(F.format_number(c, 0).alias(field.name))
        elif isinstance(field.dataType, (T.FloatType, T.DoubleType, T.DecimalType)):
            cols.append(F.format_number(c, 1).alias(field.name))
        else:
            cols.append(c)
    return df.select(*cols)
