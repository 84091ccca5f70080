"""Keep the per-user first transfer date current as raw transfers arrive.

The new-user reports need each user's first date over the *whole* history;
recomputing it scans every transfer ever recorded.  The minimum is mergeable,
so a streaming aggregation keeps it in the state store instead: in update
mode each micro-batch emits the users it touched with their running minimum
(one row per active user, not per transfer), and those rows are appended to a
Parquet table.  Readers take the minimum per user over that table
(``first_seen_table``); ``compact_first_seen`` rewrites it as one row per user
when the appended updates have piled up.  ``foreachBatch`` delivers at least
once; a replayed batch only appends duplicate rows, which the minimum absorbs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.normalize import normalize
from ..sources.storage import stream_checkpoint


def start_first_seen_stream(raw_stream: DataFrame, path: str, checkpoint: str | None = None,
                            available_now: bool = True) -> StreamingQuery:
    """Append ``(user_address, first_txn_date)`` updates of a streaming raw fact to ``path``.

    Unless ``checkpoint`` names a location, it is derived from ``path`` under
    ``spark.checkpoint.dir``, so a restarted job keeps its state.
    """
    spark = raw_stream.sparkSession
    location = checkpoint or stream_checkpoint(spark, "first-seen", path)
    firsts = (
        normalize(raw_stream, fold_case=False)
        .groupBy("user_address")
        .agg(F.min("created_date").alias("first_txn_date"))
    )

    def append(batch: DataFrame, _epoch: int) -> None:
        batch.write.mode("append").parquet(path)

    writer = (
        firsts.writeStream.outputMode("update")
        .option("checkpointLocation", location)
        .foreachBatch(append)
    )
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()


def first_seen_table(spark: SparkSession, path: str) -> DataFrame:
    """``(user_address, first_txn_date)`` from the appended updates (one row per user)."""
    return (
        spark.read.parquet(path)
        .groupBy("user_address")
        .agg(F.min("first_txn_date").alias("first_txn_date"))
    )


def compact_first_seen(spark: SparkSession, path: str, out_path: str) -> DataFrame:
    """Write the per-user minimum of ``path`` to ``out_path`` (one row per user) and read it."""
    first_seen_table(spark, path).write.mode("errorifexists").parquet(out_path)
    return spark.read.parquet(out_path)
