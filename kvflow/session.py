"""Session helpers shared by every operator: reading tables, the shared work folder, checked broadcasts."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which a lookup table may be broadcast; a larger one is joined by shuffle.
BROADCAST_ROWS = 100_000
#: Bytes of input a core below which an input is dealt to all cores before heavy work.
SMALL_SPLIT_BYTES = 1 << 20
#: Attempts of a task on one machine.
TASK_ATTEMPTS = 4
#: Tables written by materialise that are still there.
_left: dict[str, SparkSession] = {}


#: How Spark treats failing and slow tasks: three retries of a task, a backup copy of one that takes 1.5 times the median once
#: three quarters are done, executors left out after repeated failures. Executors are given up after Spark's own time without a
#: heartbeat: a shorter one would lose those that only collect garbage.
FAULT_SETTINGS = {
    "spark.task.maxFailures": "4",
    "spark.speculation": "true",
    "spark.speculation.multiplier": "1.5",
    "spark.speculation.quantile": "0.75",
    "spark.excludeOnFailure.enabled": "true",
    "spark.excludeOnFailure.task.maxTaskAttemptsPerExecutor": "3",
    "spark.excludeOnFailure.stage.maxFailedTasksPerExecutor": "3",
    "spark.executor.heartbeatInterval": "5s",
    "spark.shuffle.compress": "true",
    "spark.io.compression.codec": "zstd",
}


def local_session(cores: int | str = "*", **conf: str) -> SparkSession:
    """A session for tests and benchmarks on one machine."""
    builder = (
        SparkSession.builder.master(f"local[{cores},{TASK_ATTEMPTS}]")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for name, value in conf.items():
        builder = builder.config(name, value)
    return builder.getOrCreate()


def fault_tolerant_session(**conf: str) -> SparkSession:
    """A session for serving jobs, on the master that spark-submit or the environment names, else on this machine."""
    builder = SparkSession.builder.config(map=FAULT_SETTINGS | {"spark.sql.session.timeZone": "UTC"} | conf)
    if not os.environ.get("MASTER") and "spark.master" not in conf:
        builder = builder.master(f"local[*,{TASK_ATTEMPTS}]")
    return builder.getOrCreate()


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The Parquet table `name` of the folder."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share, as spark.checkpoint.dir names it.

    Only where that setting is missing, as in tests on one machine, is a temporary folder set for it.
    """
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(tempfile.mkdtemp(prefix="kvflow-"))
    return context._jsc.sc().getCheckpointDir().get().rstrip("/")


def local_path(folder: str) -> str | None:
    """The path by which ordinary file calls reach the folder, or None where it is in another file system."""
    if folder.startswith("file:"):
        return "/" + folder[len("file:") :].lstrip("/")
    return folder if folder.startswith("/") else None


def materialise(df: DataFrame, what: str) -> DataFrame:
    """Write df once as a table in the shared folder and read it back.

    It cuts the lineage as checkpoint() does, but columnar and compressed, and survives the loss of any executor. The table
    stays until discard() or the end of the session's program.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/kvflow/{what}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    made = spark.read.schema(df.schema).parquet(path)
    made._kvflow_path = path
    if not _left:
        atexit.register(_clear)
    _left[path] = spark
    return made


def discard(*tables: DataFrame) -> None:
    """Delete materialised tables that no unfinished plan reads any more."""
    for table in tables:
        path = getattr(table, "_kvflow_path", None)
        if path and _left.pop(path, None) is not None:
            _delete(table.sparkSession, path)


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def _clear() -> None:
    """Tables that lazy results may have read until now. Where the session is gone, the shared folder's owner clears it."""
    for path, spark in _left.items():
        try:
            _delete(spark, path)
        except Exception:  # noqa: BLE001
            return


def bounded(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if it has at most `rows` rows; otherwise df as it is, joined by shuffle."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def parallel(df: DataFrame) -> DataFrame:
    """df for work that takes much CPU a row: an input of a few MB, which Spark reads in one task, is dealt to all cores.

    Larger inputs have enough splits and stay as they are; nothing is executed to tell.
    """
    n = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(n) if size < n * SMALL_SPLIT_BYTES else df


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
