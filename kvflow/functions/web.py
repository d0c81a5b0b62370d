"""Functions on URLs and on crawl records in JSON."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

CRAWL_RECORD = T.StructType([T.StructField(name, T.StringType()) for name in ("url", "html", "timestamp")])
# An authority after an optional scheme; a malformed percent escape.
AUTHORITY = r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//([^/?#]*)"
BAD_ESCAPE = r"%(?![0-9A-Fa-f]{2})"
BAD_PORT = r":[^:\]]*[^0-9:\]][^:\]]*$"
BAD_HOST = r"[\x00- \x7f^`{}|\\]"


def extract_domain(url: Column) -> Column:
    """Host and port of an absolute or scheme-relative URL, user information dropped, case kept; '' if there is none.

    Null, control characters, malformed escapes and ports that are no numbers give ''.
    """
    host = F.regexp_replace(F.regexp_extract(url, AUTHORITY, 1), "^.*@", "")
    broken = url.rlike(r"[\x00-\x1f\x7f]") | host.rlike(BAD_ESCAPE) | host.rlike(BAD_PORT) | host.rlike(BAD_HOST)
    return F.when(url.isNull() | broken, F.lit("")).otherwise(host)


def parse_crawl_json(line: Column) -> Column:
    """Struct url, html, timestamp of a JSON line by Spark's parser: null where the line is no object."""
    return F.from_json(line, CRAWL_RECORD, {"allowSingleQuotes": "false"})


def _no_number(name: str) -> None:
    raise ValueError(name)


def _strict(line: str | None) -> dict | None:
    try:
        record = json.loads(line, parse_constant=_no_number)
    except (TypeError, ValueError, RecursionError):
        return None
    found = dict.fromkeys(CRAWL_RECORD.names, "")
    if record is None:
        return found
    if not isinstance(record, dict):
        return None
    for name, value in record.items():
        if (field := name.lower()) in found and value is not None:
            if not isinstance(value, str):
                return None
            # Half of a surrogate pair is no character.
            found[field] = value.encode("utf-16", "surrogatepass").decode("utf-16", "replace")
    return found


@F.pandas_udf(CRAWL_RECORD)
def parse_crawl_json_strict(line: pd.Series) -> pd.DataFrame:
    """The same with strict decoding: field names in any case, another type than text or trailing characters reject the line."""
    return pd.DataFrame([_strict(x) or dict.fromkeys(CRAWL_RECORD.names) for x in line], columns=CRAWL_RECORD.names)


def emit_crawl_json(count: Column, merged: Column, unique: Column) -> Column:
    """{"count","merged_text","unique_count"} with <, >, & and the two line separators escaped."""
    text = F.to_json(F.struct(count.alias("count"), merged.alias("merged_text"), unique.alias("unique_count")))
    for char in "<>&\u2028\u2029":
        text = F.replace(text, F.lit(char), F.lit(f"\\u{ord(char):04x}"))
    return text
