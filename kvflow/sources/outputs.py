"""Key/value sinks: a fixed number of text files, keys partitioned by FNV-1a and sorted by bytes.

All files are reached through Hadoop's file system API, so a folder may be on any file system that Spark can write to.
"""

from __future__ import annotations

import uuid
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kvflow.functions import hashing


class Files:
    """A folder's file system."""

    def __init__(self, spark: SparkSession, folder: str):
        self._jvm = spark._jvm
        self.system = self.path(folder).getFileSystem(spark._jsc.hadoopConfiguration())

    def path(self, name: str) -> Any:
        return self._jvm.org.apache.hadoop.fs.Path(name)

    def names(self, folder: str) -> list[str]:
        at = self.path(folder)
        return sorted(s.getPath().getName() for s in self.system.listStatus(at)) if self.system.exists(at) else []

    def exists(self, name: str) -> bool:
        return self.system.exists(self.path(name))

    def size(self, name: str) -> int:
        """Bytes of a file, or of all files below a folder."""
        return self.system.getContentSummary(self.path(name)).getLength()

    def delete(self, name: str) -> None:
        self.system.delete(self.path(name), True)

    def publish(self, source: str, name: str) -> None:
        """Renames a finished file; one that an earlier attempt published gives way."""
        self.delete(name)
        if not self.system.rename(self.path(source), self.path(name)):
            raise OSError(f"{source} can't be renamed to {name}")

    def write(self, name: str, text: str) -> None:
        """A small file, complete or not there."""
        part = f"{name}.{uuid.uuid4().hex}.part"
        out = self.system.create(self.path(part), True)
        out.write(text.encode())
        out.close()
        self.publish(part, name)

    def read(self, name: str) -> str:
        source = self.system.open(self.path(name))
        try:
            return bytes(source.readAllBytes()).decode()
        finally:
            source.close()


def laid_out(pairs: DataFrame, n: int) -> DataFrame:
    """(reduce_id, key, value) with each key in its partition among n, sorted within it."""
    rows = pairs.select(hashing.reduce_id(F.col("key"), n).alias("reduce_id"), "key", "value")
    return rows.repartitionById(n, "reduce_id").sortWithinPartitions("reduce_id", "key")


def ready_marker(path: str, job: str) -> str:
    return f"{path}.{job}.ready"


def write_partitions(pairs: DataFrame, n: int, folder: str, prefix: str = "mr-out", job: str = "", attempt: int = 1) -> list[str]:
    """Writes key TAB value lines to {folder}/{prefix}-0 to -(n-1), empty partitions included, and returns the paths.

    Spark's committer publishes whole task outputs only; each file gets its name after that, by one rename, and then, for a
    job, a ready marker beside it that names the attempt. A partition holds one reduce id, hence each id has one file at most.
    """
    spark, folder = pairs.sparkSession, folder.rstrip("/")
    files = Files(spark, folder)
    folder = files.path(folder).makeQualified(files.system.getUri(), files.system.getWorkingDirectory()).toString()
    staged = f"{folder}/_staged-{uuid.uuid4().hex}"
    rows = laid_out(pairs, n).select("reduce_id", F.concat_ws("\t", "key", F.col("value").cast("string")).alias("line"))
    try:
        rows.write.partitionBy("reduce_id").option("lineSep", "\n").text(staged)
        out = []
        for r in range(n):
            parts = [p for p in files.names(f"{staged}/reduce_id={r}") if p.startswith("part-")]
            if len(parts) > 1:
                raise OSError(f"reduce id {r} was written to {len(parts)} files")
            path = f"{folder}/{prefix}-{r}"
            if parts:
                files.publish(f"{staged}/reduce_id={r}/{parts[0]}", path)
            else:
                files.write(path, "")
            if job:
                files.write(ready_marker(path, job), f"attempt={attempt}\n")
            out.append(path.removeprefix("file://").removeprefix("file:"))
    finally:
        files.delete(staged)
    return out
