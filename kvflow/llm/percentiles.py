"""Percentiles per group by exact bisection over counts that can be added up.

A summary is a table of cells (group, day, value, n). Summaries of partitions or days are combined by putting them together.
Each pass cuts the interval that holds a percentile into equal parts, counts the rows below the midpoints between them in one
scan, and keeps the part with the wanted rank, until intervals are single values. Groups hold only counts, never rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kvflow.session import bounded, discard, materialise

#: Thousandths: the median, and the 90th, 99th and 99.9th percentile.
PERMILLE = (500, 900, 990, 999)
#: Values are at least 0 and below 2**BITS.
BITS = 32
#: Bits by which a pass narrows an interval; 1 is plain bisection, and the result is the same.
BITS_A_PASS = 8
ALL_DAYS = "all"
#: Measurements are below 30 days.
LIMIT_MS = 2_592_000_000


def day_of(moment: Column) -> Column:
    """The day in UTC as YYYY-MM-DD whatever the session's zone; '' for null."""
    days = F.floor(F.unix_micros(moment) / F.lit(86_400_000_000)).cast("int")
    return F.coalesce(F.date_format(F.date_from_unix_date(days), "yyyy-MM-dd"), F.lit(""))


def measurements(tasks: DataFrame) -> DataFrame:
    """(type, day, value), one row per row_id with a valid elapsed_ms.

    Rows with the same row_id are copies and count once, also where row_id is null but all else agrees. The type is read
    without regard to case and outer blanks; null types are a group of their own.
    """
    rows = tasks.select("row_id", F.lower(F.trim("type")).alias("type"), day_of(F.col("snapshot_at")).alias("day"), F.col("elapsed_ms").alias("value"))
    return rows.where((F.col("value") >= 0) & (F.col("value") < LIMIT_MS)).distinct().drop("row_id")


def summary(rows: DataFrame, dropped_bits: int = 0) -> DataFrame:
    """(type, day, value, n) of rows (type, day, value), values rounded down by the dropped bits.

    Percentiles of it, or of several put together, are exact with 0 dropped bits, and otherwise too low by at most
    2**dropped_bits - 1; the number of cells of a group is then at most 2**(BITS - dropped_bits).
    """
    step = 1 << dropped_bits
    value = F.col("value") - F.col("value") % step
    return rows.groupBy("type", "day", value.alias("value")).agg(F.count("*").alias("n"))


def percentiles(cells: DataFrame, permille: Sequence[int] = PERMILLE, dropped_bits: int = 0, bits_a_pass: int = BITS_A_PASS) -> DataFrame:
    """(type, day, permille, n, value, error_bound), per day and, as day 'all', over all days.

    value is the least one that at least permille/1000 of the group's n rows do not exceed; the true one lies between value
    and value + error_bound. Equal values and few rows need no special care; an empty table gives an empty result.
    """
    # Made once; each pass reads this summary, whose size has the bound of summary(), and not the rows behind it.
    kept = materialise(cells.select("type", "day", "value", "n"), "summary")
    cells = kept.withColumn("scope", F.explode(F.array(F.col("day"), F.lit(ALL_DAYS))))
    wanted = F.explode(F.array(*[F.lit(p) for p in permille]))
    active, made, left = None, None, BITS
    while left > dropped_bits:
        narrowed = max(dropped_bits, left - bits_a_pass)
        prefix, part = F.shiftright("value", left), F.shiftright("value", narrowed)
        rows = cells.select("type", "scope", prefix.alias("prefix"), part.alias("part"), "n")
        if active is None:
            rows = rows.groupBy("type", "scope", "prefix", "part").agg(F.sum("n").alias("n"))
            whole = Window.partitionBy("type", "scope")
            active = rows.withColumn("total", F.sum("n").over(whole)).withColumn("permille", wanted)
            active = active.withColumn("rank", F.greatest(F.lit(1), F.floor((F.col("total") * F.col("permille") + 999) / 1000)).cast("bigint"))
        else:
            open_intervals = bounded(active.select(F.col("type").alias("_type"), F.col("scope").alias("_scope"), F.col("prefix").alias("_prefix")).distinct())
            same = F.col("type").eqNullSafe(F.col("_type")) & (F.col("scope") == F.col("_scope")) & (F.col("prefix") == F.col("_prefix"))
            rows = rows.join(open_intervals, same, "left_semi").groupBy("type", "scope", "prefix", "part").agg(F.sum("n").alias("n"))
            states = active.select(F.col("type").alias("_type"), F.col("scope").alias("_scope"), F.col("prefix").alias("_prefix"), "total", "permille", "rank")
            active = rows.join(states, same).drop("_type", "_scope", "_prefix")
        # Rows below the midpoints: at most 2**bits_a_pass parts for each percentile of a group.
        upto = Window.partitionBy("type", "scope", "permille").orderBy("part")
        active = active.withColumn("below", F.sum("n").over(upto) - F.col("n"))
        active = active.where((F.col("below") < F.col("rank")) & (F.col("rank") <= F.col("below") + F.col("n")))
        active = active.select("type", "scope", F.col("part").alias("prefix"), "total", "permille", (F.col("rank") - F.col("below")).alias("rank"))
        before, active, left = made, materialise(active, "percentiles"), narrowed
        made = active
        if before is not None:
            discard(before)
    discard(kept)
    assert active is not None
    return active.select(
        "type", F.col("scope").alias("day"), "permille", F.col("total").alias("n"), F.shiftleft("prefix", left).alias("value"), F.lit((1 << left) - 1).cast("bigint").alias("error_bound")
    )
