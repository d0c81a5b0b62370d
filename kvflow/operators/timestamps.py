"""One instant in UTC from timestamps of many notations.

A cascade of anchored patterns is tried in order; the first that matches the whole text rewrites it to one canonical form
(year|month|day|hour|minute|second|fraction|half of day|zone), which is then read strictly. Everything is a built-in
expression, so the cascade stays in generated code, and the only join is with the lookup of sources.
"""

from __future__ import annotations

from datetime import UTC, datetime
from zoneinfo import ZoneInfo

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kvflow.session import bounded

# Month names; the form that needs no reading; the range in which bare numbers are read.
MONTHS = "jan feb mar apr may jun jul aug sep oct nov dec"
MONTH = r"(jan|feb|mar|apr|may|jun|jul|aug|sep|sept|oct|nov|dec|january|february|march|april|june|july|august|september|october|november|december)\.?"
WEEKDAY = r"(?:(?:mon|tue|wed|thu|fri|sat|sun)[a-z]*,? +)?"
PLAIN = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}Z\z"
EPOCH_FROM = int(datetime(2020, 1, 1, tzinfo=UTC).timestamp()) * 1_000_000
EPOCH_TO = int(datetime(2031, 1, 1, tzinfo=UTC).timestamp()) * 1_000_000

#: hour, minute, second, fraction, half of day and zone: groups 4 to 9 of every pattern.
CLOCK = r"(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,](\d+))?)?(?: ?([ap])\.?m\b\.?)?"
ZONE = r" ?([a-z+\-].*)?"
COMPACT_CLOCK = r"(\d{2})(\d{2})(\d{2})(?:[.,](\d+))?()"

#: Pattern and which of its first three groups are year, month and day. None: by the source's date order.
CASCADE: list[tuple[str, str, tuple[int, int, int] | None]] = [
    ("year first", rf"^(\d{{4}})(?:-|/|\.)(\d{{1,2}})(?:-|/|\.)(\d{{1,2}})(?:t| t?){CLOCK}{ZONE}$", (1, 2, 3)),
    ("compact", rf"^(\d{{4}})(\d{{2}})(\d{{2}})[t ]?{COMPACT_CLOCK}{ZONE}$", (1, 2, 3)),
    ("han", rf"^(\d{{4}})\s*年\s*(\d{{1,2}})\s*月\s*(\d{{1,2}})\s*日?\s*{CLOCK}{ZONE}$", (1, 2, 3)),
    ("day, named month", rf"^{WEEKDAY}(\d{{1,2}})[ -]{MONTH}[ -](\d{{4}}),?(?: at)? +{CLOCK}{ZONE}$", (3, 2, 1)),
    ("named month, day", rf"^{WEEKDAY}{MONTH} (\d{{1,2}})(?:st|nd|rd|th)?,? (\d{{4}}),?(?: at)? +{CLOCK}{ZONE}$", (3, 1, 2)),
    ("year last", rf"^(\d{{1,2}})(?:-|/|\.)(\d{{1,2}})(?:-|/|\.)(\d{{4}}),?(?: |t){CLOCK}{ZONE}$", None),
]
ORDERS = {"dmy": (3, 2, 1), "mdy": (3, 1, 2)}


def _canonical(pattern: str, text: Column, ymd: tuple[int, int, int]) -> Column:
    return F.regexp_replace(text, pattern, "|".join(f"${i}" for i in (*ymd, 4, 5, 6, 7, 8, 9)))


def _epoch_micros(text: Column) -> Column:
    """A bare number as microseconds, by the unit that puts it into the years from 2020 to 2030."""
    number = text.try_cast("decimal(30,7)")
    found = F.lit(None).cast("bigint")
    for factor in (1, 1_000, 1_000_000):
        micros = F.floor(number * factor).try_cast("bigint")
        found = F.when((micros >= EPOCH_FROM) & (micros < EPOCH_TO), micros).otherwise(found)
    return F.when(text.rlike(r"^\d{9,17}(?:\.\d+)?$"), found)


@F.pandas_udf(T.MapType(T.StringType(), T.IntegerType()))
def _abbreviations(zone: pd.Series) -> pd.Series:
    """What the abbreviations used in a zone mean there, in seconds east of UTC, from the zone database."""

    def of(name: str | None) -> dict[str, int] | None:
        try:
            there = ZoneInfo(name)
        except (TypeError, ValueError, OSError, KeyError):
            return None
        moments = [datetime(year, month, 15, tzinfo=UTC).astimezone(there) for year in range(2036, 1999, -1) for month in range(1, 13)]
        found: dict[str, int] = {}
        for moment in moments:
            if (name := moment.tzname()) and name.isalpha():
                found.setdefault(name.lower(), int(moment.utcoffset().total_seconds()))
        return found

    return zone.map(of)


def sources_lookup(sources: DataFrame) -> DataFrame:
    """(_source, _zone, _order, _abbr), one row per source; a source listed twice keeps its least zone and order."""
    one = sources.groupBy(F.col("crawler_id").alias("_source")).agg(F.min("tz_name").alias("_zone"), F.min(F.lower("date_order")).alias("_order"))
    return one.withColumn("_abbr", _abbreviations("_zone"))


def zone_names(df: DataFrame) -> DataFrame:
    """(_lower, _name): the zone names that Spark's own zone database has. About 600, whatever the data."""
    spark = df.sparkSession
    names = sorted(spark._jvm.java.util.ArrayList(spark._jvm.java.time.ZoneId.getAvailableZoneIds()))
    return spark.createDataFrame([(str(n).lower(), str(n)) for n in names], "_lower string, _name string")


def normalise(df: DataFrame, sources: DataFrame, keys: list[str], text: str = "timestamp", source: str = "crawler_id") -> DataFrame:
    """(*keys, utc_micros BIGINT): the instant that `text` names, null if it names none.

    * Outer white space and letter case do not count. Finer digits than microseconds are cut off, missing ones are zero.
    * A time without zone is the wall clock of the row's source. One that occurs twice is the earlier instant; one that is
      skipped moves on by the length of the gap. Without a known source it names no instant.
    * A zone may be Z, UTC, GMT, a numeric offset (a name in brackets after it is ignored), a zone name, or an abbreviation,
      which means what it means in the source's zone; one that is not used there names no instant.
    * All-numeric dates follow the source's date order unless the year comes first. Impossible dates and times, dates
      without time, times without date, null and empty texts name no instant.
    * Bare numbers are seconds, milliseconds or microseconds, whichever falls in 2020 to 2030, unless they are a 14-digit
      date and time.
    * Repeated rows each get their result; other columns are not read, so their names don't matter.
    """
    raw = F.lower(F.regexp_replace(F.col(text), r"^\s+|\s+$", ""))
    kept = [F.col(name).alias(f"_key{i}") for i, name in enumerate(keys)]
    rows = df.select(*kept, F.regexp_replace(raw, r"\s+", " ").alias("_text"), F.col(source).alias("_by"))
    rows = rows.join(bounded(sources_lookup(sources)), F.col("_by") == F.col("_source"), "left")

    canonical = F.lit(None).cast("string")
    for _, pattern, ymd in reversed(CASCADE):
        if ymd:
            form = _canonical(pattern, F.col("_text"), ymd)
        else:
            form = F.lit(None).cast("string")
            for order, groups in ORDERS.items():
                form = F.when(F.col("_order") == order, _canonical(pattern, F.col("_text"), groups)).otherwise(form)
        canonical = F.when(F.col("_text").rlike(pattern), form).otherwise(canonical)
    rows = rows.withColumn("_parts", F.split(canonical, r"\|"))
    part = lambda i: F.get(F.col("_parts"), i)
    number = lambda i: part(i).try_cast("int")

    named_month = (F.instr(F.lit(MONTHS), F.substring(part(1), 1, 3)) + 3) / 4
    month = F.when(part(1).rlike("^[a-z]"), named_month.cast("int")).otherwise(number(1))
    hour = number(3)
    hour24 = (
        F.when(part(7) == "", F.when(hour < 24, hour))
        .when((hour >= 1) & (hour <= 12), hour % 12 + F.when(part(7) == "p", 12).otherwise(0))
    )
    second = F.when(part(5) == "", F.lit(0)).otherwise(F.when(number(5) < 60, number(5)))
    fraction = F.rpad(F.substring(part(6), 1, 6), 6, "0").cast("int")
    wall = F.try_make_timestamp(number(0), month, number(2), hour24, F.when(number(4) < 60, number(4)), (second + fraction / F.lit(1_000_000)).cast("decimal(8,6)"), F.lit("UTC"))
    rows = rows.withColumn("_wall", wall)

    zone = F.regexp_replace(part(8), r" *\[[^\]]*\]$| *\([^)]*\)$", "")
    rows = rows.withColumn("_tail", F.regexp_replace(zone, r"^(?:utc|gmt) ?(?=[+-]\d)", ""))
    rows = rows.join(bounded(zone_names(df)), F.when(F.col("_tail").contains("/"), F.col("_tail")) == F.col("_lower"), "left")
    tail = F.col("_tail")
    digits = F.regexp_replace(tail, r"[^0-9]", "")
    hours, minutes = F.substring(digits, 1, 2).try_cast("int"), F.coalesce(F.substring(digits, 3, 2).try_cast("int"), F.lit(0))
    sign = F.when(tail.startswith("-"), -1).otherwise(1)
    offset = (
        F.when(tail.isin("z", "utc", "gmt", "ut"), F.lit(0))
        .when(tail.rlike(r"^[+-]\d{2}(?::?\d{2})?$"), F.when((hours <= 18) & (minutes < 60), sign * (hours * 3600 + minutes * 60)))
        .when(tail.rlike(r"^[a-z]{2,5}$"), F.try_element_at(F.col("_abbr"), tail))
    )
    # A source whose zone is not in the database would raise; it counts as unknown.
    rows = rows.withColumn("_zone", F.when(F.col("_abbr").isNotNull(), F.col("_zone")))
    named = F.when(tail == "", F.col("_zone")).when(tail.contains("/"), F.col("_name"))
    instant = F.when(named.isNotNull(), F.unix_micros(F.to_utc_timestamp(F.col("_wall"), named))).otherwise(F.unix_micros("_wall") - offset.cast("bigint") * 1_000_000)
    return rows.select(*[F.col(f"_key{i}").alias(name) for i, name in enumerate(keys)], F.coalesce(instant, _epoch_micros(F.col("_text"))).alias("utc_micros"))


def is_plain(text: Column) -> Column:
    """Whether text is already YYYY-MM-DDTHH:MM:SSZ."""
    return text.rlike(PLAIN)
