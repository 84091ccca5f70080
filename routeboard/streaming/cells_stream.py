"""Keep the measures behind the time reports current as raw transfers arrive.

The reports over time need sums, counts and maxima, which merge, and distinct
transfers and users, which merge as sets.  So each micro-batch leaves its own
share of both, and a report adds up the shares of all batches instead of
scanning the transfers:

* ``cells``: per day, hour, source, destination and token the sum, count and
  maximum of the values (``reports.daily_cells`` with the hour);
* ``ids``: the distinct (day, hour, id);
* ``users``: the distinct (day, user).

A late row simply adds to its day's cells in a later batch, however late it is,
so no watermark cuts anything off and no state is kept between batches.  Every
share is written to a folder named by its batch, and the batch counts once its
marker is written, last.  A batch that is replayed after a crash overwrites its
own folders, so each transfer counts exactly once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.labels import weekday_label
from ..functions.numeric import stable_round
from ..operators import reports
from ..operators.normalize import normalize
from ..params import ReportParams
from ..sources.storage import stream_checkpoint


def start_cells_stream(raw_stream: DataFrame, path: str, checkpoint: str | None = None,
                       available_now: bool = True) -> StreamingQuery:
    """Adds the shares of a streaming raw fact to the tables under ``path`` (read by ``StreamedCells``).

    Unless ``checkpoint`` names a location, it is derived from ``path`` under
    ``spark.checkpoint.dir``, so a restarted job resumes where it stopped.
    """
    location = checkpoint or stream_checkpoint(raw_stream.sparkSession, "cells", path)
    rows = normalize(raw_stream, fold_case=False).select(
        "created_date", F.hour("created_at").alias("hour"), "id", "user_address", "source_chain", "destination_chain", "raw_asset", "amount_usd")
    writer = rows.writeStream.option("checkpointLocation", location).foreachBatch(lambda batch, number: add_batch(batch, number, path))
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()


def add_batch(batch: DataFrame, number: int, path: str) -> None:
    """Writes the shares of one micro-batch; running it again changes nothing."""
    batch = batch.persist()
    try:
        shares = {
            "cells": batch.groupBy("created_date", "hour", "source_chain", "destination_chain", "raw_asset").agg(
                F.sum("amount_usd").alias("_sum_usd"), F.count("amount_usd").alias("_n_usd"), F.max("amount_usd").alias("_max_usd")),
            "ids": batch.select("created_date", "hour", "id").distinct(),
            "users": batch.select("created_date", "user_address").distinct(),
        }
        for kind, share in shares.items():
            share.write.mode("overwrite").parquet(f"{path}/{kind}/batch={number}")
        batch.sparkSession.range(1).write.mode("overwrite").parquet(f"{path}/done/batch={number}")
    finally:
        batch.unpersist()


class StreamedCells:
    """The time reports over the shares of all finished batches; equal to the reports over the transfers."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _table(self, kind: str, p: ReportParams) -> DataFrame:
        done = self.spark.read.parquet(f"{self.path}/done").select("batch").distinct()
        return reports.in_range(self.spark.read.parquet(f"{self.path}/{kind}"), p).join(done, "batch", "left_semi")

    def _distinct(self, p: ReportParams) -> DataFrame:
        """``distinct_transfers`` by bucket, from the sets of days."""
        by = reports.bucket_of(p).alias("by")
        ids = self._table("ids", p).groupBy(by).agg(F.count_distinct("id").alias("ids"))
        users = self._table("users", p).groupBy(by).agg(F.count_distinct("user_address").alias("users"))
        return ids.join(users, "by")

    def _buckets(self, p: ReportParams) -> DataFrame:
        return reports.buckets_from_cells(self._table("cells", p), self._distinct(p), p)

    def activity_over_time(self, p: ReportParams) -> DataFrame:
        """R02"""
        return reports.activity_over_time(None, p, measures=self._buckets(p))

    def quarterly_cumulative(self, p: ReportParams) -> DataFrame:
        """R03"""
        return reports.quarters_from_cells(self._table("cells", p), p)

    def active_chains(self, p: ReportParams) -> DataFrame:
        """R05"""
        return reports.active_chains(None, p, measures=self._buckets(p))

    def moving_average(self, p: ReportParams) -> DataFrame:
        """R06"""
        return reports.moving_average(None, p, measures=self._buckets(p))

    def heatmap(self, p: ReportParams) -> DataFrame:
        """R13"""
        slot = ["hour", weekday_label("created_date").alias("day")]
        volume = self._table("cells", p).groupBy(*slot).agg(stable_round(F.sum("_sum_usd")).alias("volume_of_transfers"))
        count = self._table("ids", p).groupBy(*slot).agg(F.count_distinct("id").alias("number_of_transfers"))
        return count.join(volume, ["hour", "day"]).select("hour", "day", "number_of_transfers", "volume_of_transfers").orderBy(*reports.heatmap_order())
