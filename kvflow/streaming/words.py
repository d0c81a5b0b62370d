"""Structured Streaming: running word counts, and windowed counts of events with late data."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kvflow.operators.wordcount import count_words


def running_word_counts(lines: DataFrame, column: str = "value") -> DataFrame:
    """(word, cnt) so far; write it in complete or update mode. State is one row per distinct word."""
    return count_words(lines, column)


def windowed_counts(events: DataFrame, time: str = "ts", kind: str = "event_type", size: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(start, kind, n) of tumbling windows; rows later than `late` behind the newest are left out and closed windows leave the state."""
    kept = events.withWatermark(time, late)
    counted = kept.groupBy(F.window(time, size).alias("w"), F.col(kind).alias("kind")).agg(F.count("*").alias("n"))
    return counted.select(F.col("w.start").alias("start"), "kind", "n")
