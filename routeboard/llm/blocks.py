"""Blocks: documents grouped by ranges of their id, so that neighbours in id order meet in one task.

Two passes over the ids (and the lengths of the texts) place the bounds when
the plan is made.  Ids are aggregated, range-partitioned and cut wherever the
rows or the bytes since the last cut reach their limit, so neither outlying
nor sparse ids fill a block.  The rows of an id (or of NULL) that has more than
a block's share are sorted by their text in range partitions, numbered there
and written with their numbers, so no text comes to the driver; rows that are
equal in both fill as many blocks as they need.  The bounds of ids are exact
and the numbers of heavy ids written: block numbers do not change between
readings.

Blocks are ordered like the rows: NULL ids first, then by id, then by text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from routeboard.sources.storage import write_and_reload

MAX_BLOCKS = 1_000_000
BLOCK_BYTES = 8 << 20    # of text


def _cuts(rows: int, size: int):
    """First ids of blocks, and the ids that need several, from (given, id, n, bytes) sorted by id."""
    def run(batches):
        n = total = 0
        fresh, alone = True, False
        for batch in batches:
            out = []
            for given, i, count, weight in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                heavy = count > 1 and (count > rows or weight > size)
                if fresh or alone or heavy or n + count > rows or total + weight > size:
                    out.append((given, i, heavy))
                    n = total = 0
                n, total, fresh, alone = n + count, total + weight, False, heavy
            if out:
                yield pa.record_batch([pa.array(c, ty) for c, ty in zip(zip(*out, strict=True), (pa.bool_(), pa.int64(), pa.bool_()), strict=True)],
                                      names=["given", "id", "heavy"])

    return run


def _placed(rows: int, size: int, given: str, key: str, text: str, place: str):
    """Rows sorted by (given, key, text) with the number of their block, counted from 0 for each id of the partition."""
    def run(batches):
        own, n, total, at = None, 0, 0, 0
        for batch in batches:
            out = []
            sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_pylist()
            for has, i, weight in zip(batch.column(given).to_pylist(), batch.column(key).to_pylist(), sizes, strict=True):
                if own != (has, i):
                    own, n, total, at = (has, i), 0, 0, 0
                elif n + 1 > rows or total + weight > size:
                    n, total, at = 0, 0, at + 1
                n, total = n + 1, total + weight
                out.append(at)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.int64())], names=[*batch.schema.names, place])

    return run


def _heavy_rows(df: DataFrame, heavy: DataFrame, rows: int, size: int, given: Column, key: Column, body: Column) -> DataFrame:
    """The rows of heavy ids with ``heavy_given``, ``heavy_id``, ``part`` and ``place``: the block in the part, which is a range of (id, text).

    Equal rows are told apart by a row id, so they too spread over parts.  The
    rows are written once: the ranges come from a sample and must not be drawn
    again by a later reading.
    """
    long = (df.withColumns({"heavy_given": given, "heavy_id": key, "heavy_text": body, "tie": F.monotonically_increasing_id()})
            .join(heavy, ["heavy_given", "heavy_id"], "left_semi"))
    order = ["heavy_given", "heavy_id", "heavy_text", "tie"]
    ranged = (long.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id())
              .select(*df.columns, "heavy_given", "heavy_id", "heavy_text", "part"))
    placed = ranged.mapInArrow(_placed(rows, size, "heavy_given", "heavy_id", "heavy_text", "place"), T.StructType([*ranged.schema, T.StructField("place", T.LongType())]))
    return write_and_reload(placed.drop("heavy_text"), "heavy-ids")


def with_block(df: DataFrame, rows: int, doc_id: str = "doc_id", text: str = "text", most: int = MAX_BLOCKS, falling: bool = False) -> DataFrame:
    """``df`` with the column ``block``: at most about ``rows`` rows and BLOCK_BYTES of text (one longer text fills a block).

    ``most``: about so many blocks; with more rows or bytes the limits rise.
    ``falling``: the blocks of one id are numbered against the order of its texts.
    ``df`` has no column ``block``, ``heavy_given``, ``heavy_id``, ``heavy_text``, ``tie``, ``part``, ``place`` or ``before``.
    """
    spark = df.sparkSession
    given, key, body = F.col(doc_id).isNotNull(), F.coalesce(F.col(doc_id).cast("long"), F.lit(0)), F.coalesce(F.col(text), F.lit(""))
    ids = df.groupBy(given.alias("given"), key.alias("id")).agg(F.count("*").alias("n"), F.sum(F.octet_length(body)).cast("long").alias("bytes"))
    n, size = df.select(F.count("*"), F.coalesce(F.sum(F.octet_length(body)), F.lit(0))).first()
    rows, size = max(rows, -(-n // most)), max(BLOCK_BYTES, -(-size // most))
    cuts = ids.repartitionByRange("given", "id").sortWithinPartitions("given", "id").mapInArrow(_cuts(rows, size), "given boolean, id long, heavy boolean").collect()
    cuts = sorted((r["given"], r["id"], r["heavy"]) for r in cuts)
    count, before = {c[:2]: 0 for c in cuts if c[2]}, []
    if count:
        wanted = F.broadcast(spark.createDataFrame(list(count), "heavy_given boolean, heavy_id long"))
        long = _heavy_rows(df, wanted, rows, size, given, key, body)
        # one row a part and heavy id; a part is a range, so these are hardly more than parts and heavy ids
        for r in sorted(long.groupBy("heavy_given", "heavy_id", "part").agg(F.max("place").alias("last")).collect(), key=lambda r: r["part"]):
            own = r["heavy_given"], r["heavy_id"]
            before.append((*own, r["part"], count[own]))
            count[own] += r["last"] + 1
    sizes = np.array([max(1, count[c[:2]]) if c[2] else 1 for c in cuts], np.int64)
    ends = np.cumsum(sizes)
    bounds = spark.sparkContext.broadcast((np.array([c[0] for c in cuts], bool), np.array([c[1] for c in cuts], np.int64), ends - sizes))

    @F.pandas_udf("long")
    def block(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        has, first, at = bounds.value
        nulls = int((~has).sum())
        for own, i in batches:
            own = own.to_numpy(bool)
            place = np.where(own, nulls + np.searchsorted(first[nulls:], i.to_numpy(np.int64), side="right"), nulls) - 1
            yield pd.Series(at[place])

    if not count:
        return df.withColumn("block", block(given, key))
    light = df.join(wanted, (given == F.col("heavy_given")) & (key == F.col("heavy_id")), "left_anti").withColumn("block", block(given, key))
    moved = F.broadcast(spark.createDataFrame([(*b, count[b[:2]]) for b in before], "heavy_given boolean, heavy_id long, part int, before long, count long"))
    inside = F.col("before") + F.col("place")
    split = (long.join(moved, ["heavy_given", "heavy_id", "part"])
             .withColumn("block", block("heavy_given", "heavy_id") + (F.col("count") - 1 - inside if falling else inside)))
    return light.unionByName(split.select(*df.columns, "block"))


def blocked(df: DataFrame, rows: int, doc_id: str, text: str) -> DataFrame:
    """(given, doc_id, text, block): whether the id is given, the id (else 0), the text (NULL: empty)."""
    placed = with_block(df.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text")), rows)
    return placed.select(F.col("doc_id").isNotNull().alias("given"), F.coalesce("doc_id", F.lit(0)).alias("doc_id"), "text", "block")


def sorted_rows(block: pa.Table) -> list[tuple[bool, int, str]]:
    """A block's (given, doc_id, text) in the order that decides what comes first."""
    return sorted(zip(block["given"].to_pylist(), block["doc_id"].to_pylist(), block["text"].to_pylist(), strict=True))


def by_bucket(distinct: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """An order of ``distinct`` by hash bucket, the buckets in use, and where each starts in that order."""
    at = (distinct % np.uint64(buckets)).astype(np.int32)
    order = np.argsort(at, kind="stable")
    used, starts = np.unique(at[order], return_index=True)
    return order, used, starts
