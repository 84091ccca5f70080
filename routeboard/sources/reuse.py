"""Results kept between calls and processes, keyed by what they were made from.

A ``ResultStore`` is a folder on shared storage.  Each entry is one table,
filed under a digest of

* the version of its source (``source_version``: the source's files with their
  sizes and modification times),
* its name and parameters, and
* ``FORMAT``, which changes with the meaning of the stored tables,

so a changed source, range or definition never meets an old result.  An
entry's rows are written to a folder of their own first; the entry exists once
its manifest does, which is created last and in one step.  A writer that dies
leaves rows without a manifest, which nobody reads and ``expire`` removes.  When
two writers make the same entry the first manifest stands.

Entries older than ``max_age`` seconds are made again; ``expire`` removes them
and what unfinished writers left.
"""

from __future__ import annotations

import hashlib
import json
import time
import uuid
from collections.abc import Callable
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from .storage import checkpoint_root

FORMAT = 1                       # raise it when a stored table changes its meaning
UNFINISHED_SECONDS = 24 * 3600   # rows without a manifest are a running writer's for so long


def _file_system(spark: SparkSession, path: str):
    """Hadoop's file system of ``path`` and its ``Path`` class: any store that Spark itself can use."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    return hadoop.Path(path).getFileSystem(spark._jsc.hadoopConfiguration()), hadoop.Path


def source_version(*sources: DataFrame) -> str:
    """A digest of the files that ``sources`` read (paths, sizes, modification times).

    The files are listed, not read.  For a table format with versions of its
    own, pass that version to the store instead.
    """
    digest = hashlib.sha256()
    for df in sources:
        for path in sorted(df.inputFiles()):
            fs, Path = _file_system(df.sparkSession, path)
            status = fs.getFileStatus(Path(path))
            digest.update(f"{path}\0{status.getLen()}\0{status.getModificationTime()}\n".encode())
        digest.update(b"\f")
    return digest.hexdigest()


def source_bytes(*sources: DataFrame) -> int:
    """The stored size of the files that ``sources`` read, listed like ``source_version``."""
    files = ((df.sparkSession, path) for df in sources for path in df.inputFiles())
    return sum(fs.getFileStatus(Path(path)).getLen() for spark, path in files for fs, Path in [_file_system(spark, path)])


def default_root(spark: SparkSession) -> str:
    """Directly under the configured ``spark.checkpoint.dir``, the same in every application.

    Where only a temporary folder is there (local tests), under that one.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    return f"{(configured or checkpoint_root(spark)).rstrip('/')}/routeboard/results"


class ResultStore:
    """Tables under ``root``, made once for each source version, name and parameters."""

    def __init__(self, spark: SparkSession, root: str | None = None, max_age: float | None = None):
        self.spark, self.root, self.max_age = spark, (root or default_root(spark)).rstrip("/"), max_age
        self.made: list[str] = []          # names of the tables that this object had to make
        self.reused: list[str] = []

    def key(self, version: str, name: str, **parameters) -> str:
        plain = {k: v.isoformat() if isinstance(v, date) else v for k, v in parameters.items()}
        return hashlib.sha256(json.dumps([FORMAT, version, name, plain], sort_keys=True).encode()).hexdigest()

    def _manifest(self, key: str) -> dict | None:
        """The entry's manifest, or None if there is none or it is too old."""
        path = f"{self.root}/{key}/manifest.json"
        fs, Path = _file_system(self.spark, path)
        if not fs.exists(Path(path)):
            return None
        stream = fs.open(Path(path))
        try:
            manifest = json.loads(bytes(stream.readAllBytes()))
        finally:
            stream.close()
        return None if self._too_old(manifest["made_at"]) else manifest

    def _too_old(self, made_at: float) -> bool:
        return self.max_age is not None and time.time() - made_at > self.max_age

    def has(self, version: str, name: str, **parameters) -> bool:
        """Whether ``table`` would read a stored table."""
        return self._manifest(self.key(version, name, **parameters)) is not None

    def table(self, version: str, name: str, make: Callable[[], DataFrame], **parameters) -> DataFrame:
        """The stored table; ``make`` builds it only if there is no entry for the key."""
        key = self.key(version, name, **parameters)
        manifest = self._manifest(key)
        if manifest is None:
            manifest = self._write(key, name, make(), parameters)
            self.made.append(name)
        else:
            self.reused.append(name)
        schema = T.StructType.fromJson(manifest["schema"])
        return self.spark.read.schema(schema).parquet(manifest["rows"])

    def _write(self, key: str, name: str, df: DataFrame, parameters: dict) -> dict:
        rows = f"{self.root}/{key}/rows-{uuid.uuid4().hex}"
        df.write.parquet(rows)
        manifest = {"name": name, "parameters": {k: str(v) for k, v in parameters.items()}, "rows": rows,
                    "schema": df.schema.jsonValue(), "made_at": time.time()}
        path, draft = f"{self.root}/{key}/manifest.json", f"{self.root}/{key}/draft-{uuid.uuid4().hex}"
        fs, Path = _file_system(self.spark, path)
        stream = fs.create(Path(draft), False)
        stream.write(json.dumps(manifest).encode())
        stream.close()
        if fs.exists(Path(path)) and self._manifest(key) is None:
            fs.delete(Path(path), False)                # an expired entry makes room
        if fs.rename(Path(draft), Path(path)):          # in one step, never over an existing manifest
            return manifest
        fs.delete(Path(draft), False)                   # another writer was first
        fs.delete(Path(rows), True)
        first = self._manifest(key)
        if first is None:
            raise RuntimeError(f"the entry {key} can't be committed under {self.root}")
        return first

    def expire(self, everything: bool = False) -> int:
        """Removes entries older than ``max_age`` (or all) and rows no manifest names; returns the entries removed."""
        fs, Path = _file_system(self.spark, self.root)
        if not fs.exists(Path(self.root)):
            return 0
        removed = 0
        for entry in fs.listStatus(Path(self.root)):
            folder = entry.getPath()
            manifest = self._manifest(folder.getName())
            if everything or (manifest is None and fs.exists(Path(folder, "manifest.json"))):
                fs.delete(Path(folder, "manifest.json"), False)     # readers stop first
                fs.delete(folder, True)
                removed += 1
                continue
            current = manifest["rows"].rsplit("/", 1)[1] if manifest else None
            for part in fs.listStatus(folder):
                name = part.getPath().getName()
                idle = time.time() - part.getModificationTime() / 1000
                if name not in ("manifest.json", current) and idle > UNFINISHED_SECONDS:
                    fs.delete(part.getPath(), True)
        return removed
