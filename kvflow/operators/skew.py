"""Totals per key when a few keys hold most records.

The rows are range-partitioned on the key and a secondary order, with bounds from quantiles that Spark samples. A heavy
key thus spans several partitions, and no partition is much larger than another. Each partition aggregates what it has
of a key; the partial states of keys that cross a boundary are stitched together in a second, small shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kvflow.functions.text import is_integer
from kvflow.session import shuffle_partitions


def spread(df: DataFrame, keys: list[str], order: list[str], partitions: int | None = None) -> DataFrame:
    """df in ranges of (keys, order) of about equal size. Rows that are equal in all of these share a partition."""
    return df.repartitionByRange(partitions or shuffle_partitions(df.sparkSession), *keys, *order)


def stitched(df: DataFrame, keys: list[str], order: list[str], partial: dict[str, Column], partitions: int | None = None) -> DataFrame:
    """One row per key with the sums of the partial columns.

    Repeated rows count once. The range partitioning already satisfies the de-duplication, so it adds no exchange, and
    the partial sums of each key leave a partition as one row.
    """
    once = spread(df, keys, order, partitions).distinct()
    return once.groupBy(*keys).agg(*[F.sum(column).alias(name) for name, column in partial.items()])


def key_totals(df: DataFrame, key: str = "key", value: str = "value", record: str = "kv_id", partitions: int | None = None) -> DataFrame:
    """(key, n_records BIGINT, int_total BIGINT) over different records.

    * Rows with the same record id are copies of one record; rows without an id are one record if key and value agree too.
    * Null and empty keys are left out. Keys count as stored: case, blanks and Unicode form matter.
    * A value counts if it is an optional sign and ASCII digits within BIGINT; others, null included, add nothing, and a
      key with none has the total 0. A total beyond BIGINT raises, as Spark's ANSI mode does.
    * Other columns of df are not read. An empty table gives an empty result.
    """
    number = F.when(is_integer(F.col(value)), F.col(value).try_cast("bigint"))
    rows = df.select(F.col(key).alias("key"), F.col(record).alias("_record"), number.alias("_number"), F.when(F.col(record).isNull(), F.col(value)).alias("_value"))
    # _number is a function of the record, so it never separates two copies.
    return stitched(
        rows.where(F.col("key") != ""), ["key"], ["_record", "_number", "_value"],
        {"n_records": F.lit(1).cast("bigint"), "int_total": F.coalesce(F.col("_number"), F.lit(0).cast("bigint"))}, partitions,
    )
