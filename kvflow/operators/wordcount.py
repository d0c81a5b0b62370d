"""Word count and what derives from it; every aggregate is a built-in with a partial step before the shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kvflow.functions import hashing, text


def pairs(df: DataFrame, column: str, *keep: str) -> DataFrame:
    """(word, *keep) for each word; null and empty texts give no rows."""
    return df.select(*keep, text.words(F.col(column)).alias("word"))


def count_words(df: DataFrame, column: str, *by: str) -> DataFrame:
    """(*by, word, cnt). An empty table gives an empty result."""
    return pairs(df, column, *by).groupBy(*by, "word").agg(F.count("*").alias("cnt"))


def sum_values(df: DataFrame, key: str, value: str) -> DataFrame:
    """(key, total): values that are no integers are skipped; a key without any has 0."""
    return df.groupBy(F.col(key).alias("key")).agg(F.coalesce(F.sum(text.integer_or_skip(F.col(value))), F.lit(0)).alias("total"))


def group_sizes(df: DataFrame, *keys: str | Column) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("cnt"))


def inverted_index(df: DataFrame, column: str, doc: str) -> DataFrame:
    """(word, doc): one row per word and document, so that no list of a frequent word is held by one task."""
    return pairs(df, column, doc).distinct()


def partitioned(counts: DataFrame, n: int) -> DataFrame:
    """Each word with its hash and its output partition among n."""
    return counts.select("word", hashing.fnv1a32(F.col("word")).alias("fnv"), hashing.reduce_id(F.col("word"), n).alias("reduce_id"), "cnt")


def shuffle_sizes(pairs: DataFrame, key: str = "key", value: str = "value") -> DataFrame:
    """Bytes of the pairs as JSON lines and as length-prefixed binary, and how much the latter saves and is, in percent."""
    k, v = F.coalesce(key, F.lit("")), F.coalesce(F.col(value).cast("string"), F.lit(""))
    sums = pairs.agg(
        F.coalesce(F.sum(22 + text.json_string_bytes(k) + text.json_string_bytes(v)), F.lit(0)).alias("json_bytes"),
        F.coalesce(F.sum(8 + F.octet_length(k) + F.octet_length(v)), F.lit(0)).alias("binary_bytes"),
    )
    before, after = F.col("json_bytes"), F.col("binary_bytes")
    return sums.withColumns({"saved_pct": F.round(text.saved_percent(before, after), 6), "ratio_pct": F.round(text.ratio_percent(after, before), 6)})
