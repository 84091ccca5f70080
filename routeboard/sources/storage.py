"""Where intermediate results live: the cluster's shared checkpoint directory.

``spark.checkpoint.dir`` names a folder every executor can reach (HDFS, object
store, a shared mount).  We read it from the session and only fall back to a
fresh temporary folder when Spark runs in local mode and nothing is configured
(tests); on a cluster an unset directory is an error, never a machine-local
path.
"""

from __future__ import annotations

import hashlib
import re
import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

STORED_BYTES = 16 << 20     # a shuffle gets one partition for so much of its stored source,
MOST_PARTITIONS = 20_000    # up to so many (larger partitions spill, as any sort does),
SHUFFLED_BYTES = 32 << 20   # and adaptive execution merges partitions up to so much shuffled data
_sized = threading.RLock()  # one thread at a time changes and restores the settings


def checkpoint_root(spark: SparkSession) -> str:
    """The shared checkpoint folder; set on the context if only the conf names it."""
    try:
        sc = spark.sparkContext
    except Exception:  # a remote (Connect) session has no context: the conf must name it
        configured = spark.conf.get("spark.checkpoint.dir", None)
        if not configured:
            raise RuntimeError("spark.checkpoint.dir is not set; point it at a folder shared by the cluster")
        return configured
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        sc.setCheckpointDir(configured)
        return sc.getCheckpointDir() or configured
    if not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):   # local-cluster is a cluster
        raise RuntimeError("spark.checkpoint.dir is not set; point it at a folder shared by the cluster")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="routeboard-ckpt-"))
    return sc.getCheckpointDir()


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    checkpoint_root(spark)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new, unique path under the shared checkpoint folder."""
    return f"{checkpoint_root(spark).rstrip('/')}/routeboard/{name}-{uuid.uuid4().hex}"


def stream_checkpoint(spark: SparkSession, name: str, path: str) -> str:
    """The checkpoint of the stream ``name`` that writes ``path``: the same in every application.

    Directly under the configured ``spark.checkpoint.dir`` (the context's own
    checkpoint folder is new for each application) and named by a digest of
    ``path``, so a restarted job resumes.  Without that setting the caller has
    to pass a location.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        raise ValueError("pass checkpoint=, or set spark.checkpoint.dir to a folder shared by the cluster")
    digest = hashlib.sha256(path.rstrip("/").encode()).hexdigest()[:32]
    return f"{root.rstrip('/')}/routeboard/{name}-{digest}"


@contextmanager
def sized_shuffles(spark: SparkSession, stored_bytes: int) -> Iterator[None]:
    """Inside, the session's shuffles have as many partitions as ``stored_bytes`` of source need.

    A task that merge-joins or sorts holds its whole partition in memory, and a
    fixed ``spark.sql.shuffle.partitions`` makes that grow with the input.  The
    session's own number stands where it is larger, adaptive execution still
    merges small partitions and splits skewed ones, and both settings are put
    back at the end.
    """
    partitions, advisory = "spark.sql.shuffle.partitions", "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    with _sized:
        before = {key: spark.conf.get(key, None) for key in (partitions, advisory)}
        needed = min(-(-stored_bytes // STORED_BYTES), MOST_PARTITIONS)
        try:
            spark.conf.set(partitions, str(max(needed, int(spark.conf.get(partitions)))))
            spark.conf.set(advisory, str(SHUFFLED_BYTES))
            yield
        finally:
            for key, value in before.items():
                spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def write_and_reload(df: DataFrame, name: str, sort_by: tuple[str, ...] = (),
                     partition_by: tuple[str, ...] = (), cluster_by=(), path: str | None = None) -> DataFrame:
    """Write ``df`` as Parquet under the checkpoint folder and scan it back.

    Cuts the lineage (a lost executor re-reads files instead of recomputing
    joins and JSON parsing) and gives later queries column pruning and
    row-group skipping.  ``cluster_by`` range-partitions the rows first (one
    shuffle), so each file holds a narrow slice of those columns;
    ``sort_by`` is a per-task sort that tightens Parquet min/max statistics
    on the filter column.
    """
    mode = "overwrite" if path else "errorifexists"
    path = path or scratch_path(df.sparkSession, name)
    out = df.repartitionByRange(*cluster_by) if cluster_by else df
    out = out.sortWithinPartitions(*sort_by) if sort_by else out
    writer = out.write.mode(mode)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    # the schema is known: no inference pass over the written footers
    loaded = df.sparkSession.read.schema(df.schema).parquet(path)
    loaded._written_to = path
    return loaded


def release(*frames: DataFrame) -> None:
    """Removes what ``write_and_reload`` wrote for ``frames``; nothing may read them (or plans on them) any more."""
    for df in frames:
        path = getattr(df, "__dict__", {}).get("_written_to")
        if path is None:
            raise ValueError("only a table that write_and_reload returned can be released")
        folder = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(folder, True)
