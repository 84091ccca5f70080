"""Append newly arrived raw transfers, normalised, to the Parquet base table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators.normalize import normalize
from ..sources.schema import BASE_COLUMNS
from ..sources.storage import stream_checkpoint


def start_base_stream(raw_stream: DataFrame, base_path: str, checkpoint: str | None = None,
                      available_now: bool = True) -> StreamingQuery:
    """Normalise a streaming raw fact and append it to ``base_path``.

    The file sink with its checkpoint gives exactly-once appends.  Unless
    ``checkpoint`` names a location, it is derived from ``base_path`` under
    ``spark.checkpoint.dir``, so a restarted job resumes where it stopped.
    ``available_now`` processes what is there and stops (a scheduled job);
    otherwise it keeps running on the default trigger.
    """
    spark = raw_stream.sparkSession
    location = checkpoint or stream_checkpoint(spark, "stream", base_path)
    writer = (
        normalize(raw_stream, fold_case=False).select(*BASE_COLUMNS)
        .writeStream.format("parquet")
        .option("path", base_path)
        .option("checkpointLocation", location)
        .outputMode("append")
    )
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()
