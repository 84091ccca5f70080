"""The per-user first dates as one table with one row a user, kept by touched buckets.

``start_first_seen_stream`` appends a row for each user of each batch, so its
table grows until it is compacted.  Here the table is cut into buckets by a
hash of the user, and a micro-batch rewrites just the buckets its users fall
in: their rows and the batch's are merged to the minimum per user.  The table
always holds one row a user, and a small batch touches few files.

Crash safety.  A batch's new buckets are first written whole to a staging
folder of that batch, and only a finished staging folder replaces buckets of
the table (dynamic partition overwrite).  A batch that is replayed after a crash
in between finds its staging folder finished and publishes it again, so a
bucket that was lost half-way comes back.  The folder of a batch goes when the
next one is published.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.normalize import normalize
from ..sources.storage import stream_checkpoint

BUCKETS = 256            # fixed when the table is made; about a few million users a bucket at 10**9 users
SCHEMA = "user_address string, first_txn_date date, bucket int"


def start_first_seen_state(raw_stream: DataFrame, path: str, buckets: int = BUCKETS, checkpoint: str | None = None,
                           available_now: bool = True) -> StreamingQuery:
    """Keeps ``(user_address, first_txn_date)`` at ``path``, one row a user (the NULL user included)."""
    location = checkpoint or stream_checkpoint(raw_stream.sparkSession, "first-state", path)
    rows = normalize(raw_stream, fold_case=False).select("user_address", "created_date")
    writer = rows.writeStream.option("checkpointLocation", location).foreachBatch(
        lambda batch, number: merge_batch(batch, number, path, buckets))
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()


def _exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def _remove(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def staging(path: str, number: int) -> str:
    return f"{path.rstrip('/')}-staged/batch={number}"


def merge_batch(batch: DataFrame, number: int, path: str, buckets: int = BUCKETS) -> None:
    """Merges one micro-batch into the table; running it again changes nothing."""
    spark, staged = batch.sparkSession, staging(path, number)
    if not _exists(spark, f"{staged}/_SUCCESS"):
        firsts = batch.groupBy("user_address").agg(F.min("created_date").alias("first_txn_date"))
        firsts = firsts.withColumn("bucket", F.pmod(F.xxhash64("user_address"), F.lit(buckets)).cast("int")).persist()
        try:
            touched = [r["bucket"] for r in firsts.select("bucket").distinct().collect()]     # at most ``buckets``
            merged = firsts
            if _exists(spark, path):
                old = spark.read.schema(SCHEMA).parquet(path).where(F.col("bucket").isin(touched))
                merged = firsts.unionByName(old).groupBy("bucket", "user_address").agg(F.min("first_txn_date").alias("first_txn_date"))
            merged.select("user_address", "first_txn_date", "bucket").repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(staged)
        finally:
            firsts.unpersist()
    publish(spark, staged, path)
    if number > 0:
        _remove(spark, staging(path, number - 1))


def publish(spark: SparkSession, staged: str, path: str) -> None:
    """Replaces the table's buckets that a finished staging folder holds."""
    (spark.read.schema(SCHEMA).parquet(staged).repartition("bucket").write.mode("overwrite")
     .option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path))


def read_first_seen(spark: SparkSession, path: str) -> DataFrame:
    """``(user_address, first_txn_date)``, one row a user: the ``first_seen`` of ``Dashboard``."""
    return spark.read.schema(SCHEMA).parquet(path).select("user_address", "first_txn_date")
