"""Row numbers over a whole table, or within groups, without gathering rows in one task.

A global ``row_number()`` sends every row to one task, and one partitioned by
a group sends a hot group there.  ``number_in_order`` numbers in three steps:

1. range-partition the rows on ``(groups, order)`` -- ties are broken by a row
   id, so equal rows spread too -- sort each partition and write it with its
   partition number and the row's place in it (written, because the ranges come
   from a sample and must not be drawn again by a later job);
2. count the rows of each partition (and group);
3. add to a row's place the rows of the earlier partitions.

Without groups step 2 brings one number a partition to the driver; with groups
the running count is a window within each group over at most one row a partition.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.storage import write_and_reload

_ROWS_OF_A_PARTITION = (1 << 33) - 1      # fixed value: the low bits of monotonically_increasing_id()


def _unused(df: DataFrame, name: str) -> str:
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def number_in_order(df: DataFrame, order: Sequence[Column], by: Sequence[str] = (), out: str = "row_number") -> DataFrame:
    """``df`` with the column ``out``: 1-based position in ``order`` (within each ``by`` group; NULL is a group).

    Rows that ``order`` leaves equal are numbered in any order.  ``out`` must
    not be a column of ``df``.  The rows pass through a table in the shared
    checkpoint folder.
    """
    tie, part, place, first, n, before = (_unused(df, c) for c in ("_tie", "_part", "_place", "_first", "_n", "_before"))
    keys = [*[F.col(c).asc_nulls_first() for c in by], *order, F.col(tie).asc()]
    rows = df.withColumn(tie, F.monotonically_increasing_id())
    ranged = (rows.repartitionByRange(*keys).sortWithinPartitions(*keys)
              .withColumn(part, F.spark_partition_id())
              .withColumn(place, F.monotonically_increasing_id().bitwiseAND(F.lit(_ROWS_OF_A_PARTITION))).drop(tie))
    ranged = write_and_reload(ranged, "numbered")
    if not by:
        counts = ranged.groupBy(part).count().collect()           # one row a partition
        earlier, total = {}, 0
        for r in sorted(counts, key=lambda r: r[part]):
            earlier[r[part]], total = total, total + r["count"]
        sums = F.lit([earlier.get(p, 0) for p in range(max(earlier, default=0) + 1)]).cast("array<bigint>")
        number = F.element_at(sums, F.col(part) + 1) + F.col(place) + 1
        return ranged.select(*df.columns, number.alias(out))
    counts = ranged.groupBy(*by, part).agg(F.min(place).alias(first), F.count(F.lit(1)).alias(n))
    running = Window.partitionBy(*by).orderBy(part)
    counts = counts.select(*[F.col(c).alias(f"{before}{k}") for k, c in enumerate(by)], F.col(part).alias(f"{part}r"),
                           (F.sum(n).over(running) - F.col(n) - F.col(first)).alias(before))
    same = F.col(part) == F.col(f"{part}r")
    for k, c in enumerate(by):
        same = same & F.col(c).eqNullSafe(F.col(f"{before}{k}"))
    return ranged.join(counts, same).select(*df.columns, (F.col(before) + F.col(place) + 1).alias(out))
