"""Text functions as Catalyst columns: words, markup removal, white space, numbers, report formats."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# The patterns that define a word, a tag, white space and a printable character.
WORD = r"[a-zA-Z\p{IsHan}]+"
TAG = r"<[^>]*>"
SPACE = r"[\t\n\f\r ]+"
INTEGER = "[+-]?[0-9]+"
UNPRINTABLE = r"[^\p{L}\p{M}\p{N}\p{P}\p{S} ]"
#: Stands between the texts that a merge joins.
MERGE_SEPARATOR = "\n---\n"


def tokenize(text: Column) -> Column:
    """Array of the words of text: runs of ASCII letters and Han characters, case kept. Null stays null."""
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def words(text: Column) -> Column:
    """One row per word, in lower case."""
    return F.explode(F.transform(tokenize(text), F.lower))


def strip_tags(html: Column) -> Column:
    """Every tag becomes one blank; script and style bodies stay, entities are not decoded."""
    return F.regexp_replace(html, TAG, " ")


def collapse_space(text: Column) -> Column:
    return F.regexp_replace(text, SPACE, " ")


def strip_unprintable(text: Column) -> Column:
    return F.regexp_replace(text, UNPRINTABLE, "")


def clean_html(html: Column) -> Column:
    """Visible text of a page on one line. Null stays null."""
    return F.trim(strip_unprintable(F.trim(collapse_space(strip_tags(html)))))


def is_integer(value: Column) -> Column:
    return value.rlike(rf"^{INTEGER}\z")


def read_integer(value: str) -> int | None:
    """The same as integer_or_skip for one value in Python."""
    number = int(value) if re.fullmatch(INTEGER, value) else None
    return number if number is not None and -(1 << 63) <= number < 1 << 63 else None


def integer_or_skip(value: Column) -> Column:
    """value as BIGINT where it is an optional sign and ASCII digits within range, else null."""
    return F.when(is_integer(value), value.try_cast("bigint"))


def join_texts(texts: Column) -> Column:
    return F.array_join(texts, MERGE_SEPARATOR)


def saved_percent(before: Column, after: Column) -> Column:
    """How much smaller `after` is than `before`, in percent; 0 where `before` is not positive."""
    return F.when(before <= 0, F.lit(0.0)).otherwise((1 - after / before) * 100)


def ratio_percent(part: Column, total: Column) -> Column:
    """part in percent of total; 0 where total is not positive."""
    return F.when(total <= 0, F.lit(0.0)).otherwise(part / total * 100)


def json_string_bytes(value: Column) -> Column:
    """UTF-8 bytes of value inside a JSON string: two for a quote, backslash, LF, CR and tab, six for other control characters."""
    return F.octet_length(value) + F.regexp_count(value, F.lit(r'["\\\n\r\t]')) + 5 * F.regexp_count(value, F.lit(r"[\x00-\x08\x0b\x0c\x0e-\x1f]"))


def human_bytes(n: int) -> str:
    """1536 as '1.50 KB'."""
    if n < 1024:
        return f"{n} B"
    power = min(6, (n.bit_length() - 1) // 10)
    return f"{n / 1024**power:.2f} {'KMGTPE'[power - 1]}B"


def comma_list(text: str) -> list[str]:
    """Parts between commas without outer blanks; empty ones are left out."""
    return [part for part in map(str.strip, text.split(",")) if part]
