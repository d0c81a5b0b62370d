"""How many bytes the pairs of a shuffle take in different formats."""

from __future__ import annotations

from dataclasses import dataclass
from pathlib import PurePath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kvflow.functions import hashing
from kvflow.operators.wordcount import count_words, shuffle_sizes
from kvflow.sources.outputs import Files

#: Work folders that a bench may delete begin so.
BENCH_PREFIX = "mr-bench-"


@dataclass(frozen=True)
class Size:
    format: str
    bytes: int
    saved_percent: float


def sample(spark: SparkSession, files: list[str], n_bytes: int) -> DataFrame:
    """(value): the lines of the files that begin within the first n_bytes of each; all with n_bytes of 0 or less."""
    if n_bytes <= 0:
        return spark.read.option("lineSep", "\n").text(files)
    # One row per file, cut by the reader's own position, so only the sample is read.
    heads = spark.createDataFrame([(f,) for f in files], "file string")

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            lines: list[str] = []
            for file in batch.column(0).to_pylist():
                with open(file, "rb") as f:
                    lines += f.read(n_bytes).decode("utf-8", "replace").splitlines()
            yield pa.RecordBatch.from_arrays([pa.array(lines, pa.string())], names=["value"])

    return heads.mapInArrow(run, "value string")


def checked_work_dir(folder: str) -> str:
    """The folder, if it is a relative one that a bench may delete."""
    path = PurePath(folder)
    if path.is_absolute() or ".." in path.parts or not path.name.startswith(BENCH_PREFIX):
        raise ValueError(f"{folder} is no relative folder whose name begins with {BENCH_PREFIX}, so it is not deleted")
    return folder


def format_sizes(spark: SparkSession, files: list[str], n_bytes: int, n_reduce: int, work_dir: str) -> list[Size]:
    """Sizes of the combined word counts of a sample: JSON lines and length-prefixed binary by formula, Parquet as written."""
    system = Files(spark, checked_work_dir(work_dir))
    system.delete(work_dir)
    pairs = count_words(sample(spark, files, n_bytes), "value").select(F.col("word").alias("key"), F.col("cnt").cast("string").alias("value"))
    pairs = pairs.withColumn("reduce_id", hashing.reduce_id(F.col("key"), n_reduce)).repartitionById(n_reduce, "reduce_id")
    plain = f"{work_dir}/none"
    pairs.write.option("compression", "none").partitionBy("reduce_id").parquet(plain)
    kept = spark.read.parquet(plain)
    formula = shuffle_sizes(kept).first()
    sizes = {"json": formula.json_bytes, "binary": formula.binary_bytes, "parquet": system.size(plain)}
    for codec in ("gzip", "zstd"):
        kept.write.option("compression", codec).partitionBy("reduce_id").parquet(f"{work_dir}/{codec}")
        sizes[f"parquet {codec}"] = system.size(f"{work_dir}/{codec}")
    kept.select("key", "value").write.option("compression", "gzip").json(f"{work_dir}/json")
    sizes["json gzip"] = system.size(f"{work_dir}/json")
    system.delete(work_dir)
    whole = sizes["json"]
    return [Size(name, n, (1 - n / whole) * 100 if whole else 0.0) for name, n in sizes.items()]
