"""Session settings the reports are written for."""

from __future__ import annotations

from pyspark.sql import SparkSession

# Settings that matter for these plans.  AQE coalesces the many small
# post-aggregation partitions, converts sort-merge joins to broadcast joins
# when a side turns out small at run time, and splits skewed join partitions.
# The session time zone is pinned so that timestamp literals mean UTC wall time.
RECOMMENDED_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
    # remove checkpoint files (the median's ranked pairs) once nothing references them
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def local_session(cores: int = 8, shuffle_partitions: int | None = None, app: str = "routeboard",
                  extra: dict[str, str] | None = None) -> SparkSession:
    """A ``local[cores]`` session for tests and benchmarks."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]").appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions or cores))
        .config("spark.driver.memory", "16g")
    )
    for k, v in {**RECOMMENDED_CONF, **(extra or {})}.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def cluster_conf(total_cores: int, checkpoint_dir: str) -> dict[str, str]:
    """Settings for running the dashboard on a large cluster (``total_cores`` executor cores).

    * Shuffles start wide (about 3 partitions per core) and AQE coalesces them
      to ~256 MB each, so an aggregation's final stage neither spills because
      partitions are too big nor drowns in tiny tasks.
    * Scans split files at 256 MB; the normalised base is narrow, so one scan
      task still covers many row groups.
    * AQE splits a join partition 5x larger than the median once it passes
      512 MB -- the fact join's answer to a hot order key.
    * Broadcast stays at Spark's size check: dimension tables under 64 MB are
      shipped, anything larger is shuffled.
    * ``spark.checkpoint.dir`` must be shared storage (HDFS / object store):
      the materialised base and the median's checkpoints live there.
    """
    return {
        **RECOMMENDED_CONF,
        "spark.sql.shuffle.partitions": str(max(200, 3 * total_cores)),
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "256m",
        "spark.sql.adaptive.coalescePartitions.minPartitionSize": "64m",
        "spark.sql.files.maxPartitionBytes": "256m",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "5",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "512m",
        "spark.sql.autoBroadcastJoinThreshold": "64m",
        "spark.checkpoint.dir": checkpoint_dir,
    }
