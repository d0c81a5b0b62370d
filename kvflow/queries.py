"""Queries of the core and the SQL that DuckDB runs beside them."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kvflow.functions import hashing, text, web
from kvflow.operators import crawl_clean, nested, skew, timestamps, wordcount
from kvflow.plans.jobs import mapped
from kvflow.plans.registry import REGISTRY, Entry
from kvflow.session import materialise, shared_folder, table
from kvflow.sources.lines import crawl_records as crawl_lines
from kvflow.sources.lines import read_lines
from kvflow.sources.outputs import laid_out, write_partitions
from kvflow.streaming.words import running_word_counts, windowed_counts

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under the function's name, with its SQL if it has one."""

    def register(function: Query) -> Query:
        QUERIES[function.__name__] = function
        if sql:
            SQL[function.__name__] = sql
        return function

    return register


@query()
def p2_found(spark: SparkSession, d: str) -> DataFrame:
    records = table(spark, d, "crawl_records")
    unread = records.where(~F.coalesce(timestamps.is_plain(F.col("timestamp")), F.lit(False)))
    return timestamps.normalise(unread, table(spark, d, "crawlers"), ["rec_id"]).where("utc_micros IS NOT NULL")


@query("""
    WITH RECURSIVE layers AS (
        SELECT ckpt_id, 0 AS n, trim(body, chr(65279) || chr(32) || chr(9) || chr(13) || chr(10)) AS b FROM job_checkpoints
        UNION ALL
        SELECT ckpt_id, n + 1, trim(json_extract_string(b, '$'), chr(65279) || chr(32) || chr(9) || chr(13) || chr(10)) FROM layers WHERE n < 4 AND b LIKE '"%"' AND json_valid(b)),
    documents_ AS (SELECT ckpt_id, CASE WHEN json_valid(b) THEN b::JSON END AS j FROM layers WHERE b LIKE '{%}'),
    lists AS (SELECT ckpt_id, child, json_extract(j, '$.' || child) AS v FROM documents_, (VALUES ('map_tasks'), ('reduce_tasks'), ('decisions'), ('map_done_for_reduce')) AS c(child) WHERE j IS NOT NULL),
    shaped AS (SELECT *, json_type(v) AS kind, CASE WHEN json_type(v) = 'OBJECT' THEN json_keys(v) END AS names FROM lists WHERE json_type(v) IN ('ARRAY', 'OBJECT')),
    elements AS (
        SELECT ckpt_id, child, unnest(range(json_array_length(v)::BIGINT))::INT AS idx, unnest(json_extract(v, '$[*]')) AS e FROM shaped WHERE kind = 'ARRAY'
        UNION ALL
        SELECT ckpt_id, child, unnest(names)::INT, unnest(list_transform(names, lambda k: json_extract(v, '$."' || k || '"'))) FROM shaped WHERE kind = 'OBJECT' AND len(list_filter(names, lambda k: NOT regexp_full_match(k, '[0-9]+'))) = 0
        UNION ALL
        SELECT ckpt_id, child, 0, v FROM shaped WHERE kind = 'OBJECT' AND len(list_filter(names, lambda k: NOT regexp_full_match(k, '[0-9]+'))) > 0),
    cells AS (
        SELECT ckpt_id, child, idx, unnest(range(json_array_length(e)::BIGINT))::INT AS sub_idx, unnest(json_extract(e, '$[*]')) AS c FROM elements WHERE child = 'map_done_for_reduce' AND json_type(e) = 'ARRAY'
        UNION ALL
        SELECT ckpt_id, child, idx, unnest(names)::INT, unnest(list_transform(names, lambda k: json_extract(e, '$."' || k || '"'))) FROM (SELECT *, json_keys(e) AS names FROM elements WHERE child = 'map_done_for_reduce' AND json_type(e) = 'OBJECT'))
    SELECT ckpt_id, child, idx, -1 AS sub_idx, CASE WHEN json_type(e) = 'OBJECT' THEN coalesce(json_extract_string(e, CASE child WHEN 'decisions' THEN '$.type' ELSE '$.state' END), '') ELSE '' END AS val
    FROM elements WHERE child <> 'map_done_for_reduce' AND json_type(e) <> 'NULL'
    UNION ALL
    SELECT ckpt_id, child, idx, sub_idx, CASE json_extract_string(c, '$') WHEN '1' THEN 'true' WHEN '0' THEN 'false' ELSE json_extract_string(c, '$') END FROM cells WHERE json_type(c) <> 'NULL'
""")
def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return nested.flatten_lists(table(spark, d, "job_checkpoints"), "ckpt_id", "body", nested.CHECKPOINT_LISTS)


@query("""
    SELECT key, count(*) AS n_records,
           coalesce(sum(CASE WHEN regexp_full_match(value, '[+-]?[0-9]+') THEN try_cast(value AS BIGINT) END), 0)::BIGINT AS int_total
    FROM (SELECT DISTINCT kv_id, key, value FROM key_values) WHERE key <> '' GROUP BY key
""")
def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return skew.key_totals(table(spark, d, "key_values"))


# Word count and what derives from it.

_TOKENS = r"SELECT doc_id, lang, source, unnest(regexp_extract_all(text, '[a-zA-Z\p{Han}]+')) AS w FROM documents"
_WORDS = f"SELECT doc_id, lang, source, lower(w) AS word FROM ({_TOKENS})"
_COUNTS = f"SELECT word, count(*)::BIGINT AS cnt FROM ({_WORDS}) GROUP BY word"
_FNV = """list_reduce(list_prepend(2166136261::BIGINT, list_transform(range(octet_length(encode(word))),
          lambda i: ('0x' || substr(hex(encode(word)), (2 * i + 1)::INT, 2))::BIGINT)), lambda h, b: (xor(h, b) * 16777619) & 4294967295)"""
_PLACED = f"SELECT word, {_FNV} AS fnv, ({_FNV} % 3)::INT AS reduce_id, cnt FROM ({_COUNTS})"


def _counts(spark: SparkSession, d: str) -> DataFrame:
    return wordcount.count_words(table(spark, d, "documents"), "text")


@query(_COUNTS)
def wordcount_(spark: SparkSession, d: str) -> DataFrame:
    return _counts(spark, d)


QUERIES["wordcount"], SQL["wordcount"] = QUERIES.pop("wordcount_"), SQL.pop("wordcount_")


@query(_WORDS.replace("doc_id, lang, source, lower", "doc_id, lower"))
def wordcount_tokens(spark: SparkSession, d: str) -> DataFrame:
    return wordcount.pairs(table(spark, d, "documents"), "text", "doc_id")


@query(f"SELECT lang, word, count(*)::BIGINT AS cnt FROM ({_WORDS}) GROUP BY ALL")
def wordcount_by_lang(spark: SparkSession, d: str) -> DataFrame:
    return wordcount.count_words(table(spark, d, "documents"), "text", "lang")


@query(f"SELECT source, word, count(*)::BIGINT AS cnt FROM ({_WORDS}) GROUP BY ALL")
def wordcount_by_source(spark: SparkSession, d: str) -> DataFrame:
    return wordcount.count_words(table(spark, d, "documents"), "text", "source")


@query("""SELECT key, coalesce(sum(CASE WHEN regexp_full_match(value, '[+-]?[0-9]+') THEN try_cast(value AS BIGINT) END), 0)::BIGINT AS total
          FROM key_values GROUP BY key""")
def sum_by_key(spark: SparkSession, d: str) -> DataFrame:
    return wordcount.sum_values(table(spark, d, "key_values"), "key", "value")


@query(f"SELECT word AS key, cnt::VARCHAR AS value FROM ({_COUNTS})")
def reduce_udf(spark: SparkSession, d: str) -> DataFrame:
    """The registered map and reduce functions by their names."""
    mapper, reducer, _ = REGISTRY.resolve("wordcount_map", "wordcount_reduce")
    return reducer.function(mapper.function(table(spark, d, "documents").select(F.col("text").alias("value"))))


@query(f"SELECT count(*)::BIGINT AS map_output_records, count(DISTINCT word)::BIGINT AS reduce_output_keys FROM ({_WORDS})")
def job_counters(spark: SparkSession, d: str) -> DataFrame:
    return _counts(spark, d).agg(F.sum("cnt").alias("map_output_records"), F.count("*").alias("reduce_output_keys"))


@query(f"SELECT DISTINCT word FROM ({_WORDS})")
def distinct_keys(spark: SparkSession, d: str) -> DataFrame:
    return wordcount.pairs(table(spark, d, "documents"), "text").distinct()


@query(f"SELECT max(cnt)::BIGINT AS max_group_size FROM ({_COUNTS})")
def max_group_size(spark: SparkSession, d: str) -> DataFrame:
    return _counts(spark, d).agg(F.max("cnt").alias("max_group_size"))


@query(_PLACED)
def hash_partition(spark: SparkSession, d: str) -> DataFrame:
    return wordcount.partitioned(_counts(spark, d), 3)


@query(f"SELECT reduce_id, count(*)::BIGINT AS n_keys, sum(cnt)::BIGINT AS n_records FROM ({_PLACED}) GROUP BY reduce_id")
def partition_sizes(spark: SparkSession, d: str) -> DataFrame:
    return hash_partition(spark, d).groupBy("reduce_id").agg(F.count("*").alias("n_keys"), F.sum("cnt").alias("n_records"))


@query(f"SELECT reduce_id, word AS key, cnt::VARCHAR AS value FROM ({_PLACED})")
def sort_within_partition(spark: SparkSession, d: str) -> DataFrame:
    return laid_out(_counts(spark, d).select(F.col("word").alias("key"), F.col("cnt").cast("string").alias("value")), 3)


@query(f"SELECT 'mr-out-' || reduce_id::VARCHAR AS name, word || chr(9) || cnt::VARCHAR AS line FROM ({_PLACED})")
def sink_tsv(spark: SparkSession, d: str) -> DataFrame:
    """The lines of the partition files as they were written, with the names of their files."""
    return _written_counts(spark, d).select(F.regexp_extract("file", "[^/]+$", 0).alias("name"), F.col("value").alias("line"))


@query(f"SELECT word, cnt FROM ({_COUNTS}) ORDER BY word")
def total_order_single_partition(spark: SparkSession, d: str) -> DataFrame:
    """Totally ordered, as one reducer's file is; the order is made by range partitions."""
    return _counts(spark, d).orderBy("word")


_ESCAPED = """(strlen(coalesce({0}, '')) + len(regexp_extract_all(coalesce({0}, ''), '["\\\\\n\r\t]')) + 5 * len(regexp_extract_all(coalesce({0}, ''), '[\x00-\x08\x0b\x0c\x0e-\x1f]')))"""
_SIZES = f"""SELECT json_bytes, binary_bytes, round((1 - binary_bytes / json_bytes) * 100, 6) AS saved_pct, round(binary_bytes / json_bytes * 100, 6) AS ratio_pct
    FROM (SELECT sum(22 + {_ESCAPED.format("key")} + {_ESCAPED.format("value")})::BIGINT AS json_bytes,
                 sum(8 + strlen(coalesce(key, '')) + strlen(coalesce(value, '')))::BIGINT AS binary_bytes FROM (SOURCE))"""


@query(_SIZES.replace("SOURCE", f"SELECT word AS key, cnt::VARCHAR AS value FROM ({_COUNTS})"))
def shuffle_size_estimate(spark: SparkSession, d: str) -> DataFrame:
    return wordcount.shuffle_sizes(_counts(spark, d).select(F.col("word").alias("key"), F.col("cnt").alias("value")))


@query(_SIZES.replace("SOURCE", "SELECT key || chr(1) || chr(9) AS key, value || chr(34) || chr(10) || chr(92) || chr(31) AS value FROM key_values"))
def shuffle_size_escapes(spark: SparkSession, d: str) -> DataFrame:
    """Sizes of pairs with signs that JSON escapes in each."""
    pairs = table(spark, d, "key_values").select(F.concat("key", F.lit("\x01\t")).alias("key"), F.concat("value", F.lit('"\n\\\x1f')).alias("value"))
    return wordcount.shuffle_sizes(pairs)


@query(f"SELECT DISTINCT word, doc_id FROM ({_WORDS})")
def inverted_index(spark: SparkSession, d: str) -> DataFrame:
    return wordcount.inverted_index(table(spark, d, "documents"), "text", "doc_id")


@query("SELECT doc_id, title FROM documents WHERE regexp_matches(text, '[0-9]{4}')")
def grep_filter(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where(F.col("text").rlike("[0-9]{4}")).select("doc_id", "title")


@query(f"SELECT word, cnt FROM ({_COUNTS}) ORDER BY cnt DESC, word LIMIT 20")
def top_k_words(spark: SparkSession, d: str) -> DataFrame:
    return _counts(spark, d).orderBy(F.desc("cnt"), "word").limit(20)


@query("SELECT lang, text, count(*)::BIGINT AS n, min(doc_id) AS first_doc FROM documents WHERE text <> '' GROUP BY lang, text")
def dedup_within_key(spark: SparkSession, d: str) -> DataFrame:
    documents = table(spark, d, "documents").where("text <> ''")
    return documents.groupBy("lang", "text").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_doc"))


@query("SELECT doc_id, sha256(text) AS sha256, strlen(text)::INT AS n_bytes FROM documents WHERE text IS NOT NULL")
def sha256_hex(spark: SparkSession, d: str) -> DataFrame:
    documents = table(spark, d, "documents").where("text IS NOT NULL")
    return documents.select("doc_id", hashing.sha256_hex(F.col("text")).alias("sha256"), F.octet_length("text").alias("n_bytes"))


@query()
def stream_wordcount(spark: SparkSession, d: str) -> DataFrame:
    """Word count by Structured Streaming over the same files, each micro-batch replacing the table of results."""
    schema = table(spark, d, "documents").schema
    rows = spark.readStream.schema(schema).parquet(f"{d}/documents.parquet*")
    done: list[DataFrame] = []

    def keep(batch: DataFrame, _: int) -> None:
        done[:] = [materialise(batch, "stream")]

    stream = running_word_counts(rows, "text").writeStream.outputMode("complete").foreachBatch(keep)
    stream.option("checkpointLocation", f"{shared_folder(spark)}/kvflow/stream-{uuid.uuid4().hex}").trigger(availableNow=True).start().awaitTermination()
    if not done:
        raise RuntimeError("the stream gave no result")
    return done[0]


SQL["stream_wordcount"] = _COUNTS

# Crawl cleaning.

_CLEAN = r"""trim(regexp_replace(trim(regexp_replace(regexp_replace(html, '<[^>]*>', ' ', 'g'), '[\t\n\f\r ]+', ' ', 'g')), '[^\p{L}\p{M}\p{N}\p{P}\p{S} ]', '', 'g'))"""
_HOST = r"""regexp_replace(regexp_extract(url, '^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//([^/?#]*)', 1), '^.*@', '')"""
_DOMAIN = rf"""CASE WHEN url IS NULL OR regexp_matches(url, '[\x00-\x1f\x7f]') OR regexp_matches({_HOST}, '%([^0-9A-Fa-f]|.[^0-9A-Fa-f]|.?$)')
               OR regexp_matches({_HOST}, ':[^:\]]*[^0-9:\]][^:\]]*$') OR regexp_matches({_HOST}, '[\x00- \x7f^`{{}}|\\]') THEN '' ELSE {_HOST} END"""
_ROWS = f"SELECT * FROM (SELECT rec_id AS ord, {_DOMAIN} AS domain, {_CLEAN} AS cleaned FROM crawl_records) WHERE domain <> '' AND cleaned <> ''"
_UNIQUE = f"SELECT domain, cleaned, min(ord) AS first, count(*)::BIGINT AS n FROM ({_ROWS}) GROUP BY domain, cleaned"


def _rows(spark: SparkSession, d: str) -> DataFrame:
    return crawl_clean.cleaned_rows(table(spark, d, "crawl_records"), F.col("rec_id"))


@query(_ROWS)
def crawl_clean_rows(spark: SparkSession, d: str) -> DataFrame:
    return _rows(spark, d)


@query(f"""SELECT domain, sum(n)::BIGINT AS count, count(*)::BIGINT AS unique_count,
           string_agg(cleaned, chr(10) || '---' || chr(10) ORDER BY first, cleaned) AS merged_text FROM ({_UNIQUE}) GROUP BY domain""")
def crawl_clean_(spark: SparkSession, d: str) -> DataFrame:
    return crawl_clean.merged_per_domain(_rows(spark, d))


QUERIES["crawl_clean"], SQL["crawl_clean"] = QUERIES.pop("crawl_clean_"), SQL.pop("crawl_clean_")


@query(f"SELECT domain, sum(n)::BIGINT AS count, count(*)::BIGINT AS unique_count FROM ({_UNIQUE}) GROUP BY domain")
def crawl_counts(spark: SparkSession, d: str) -> DataFrame:
    return crawl_clean.counts_per_domain(_rows(spark, d))


_QUOTED = """replace(replace(replace(replace(replace(to_json(merged_text)::VARCHAR, '<', '\\u003c'), '>', '\\u003e'), '&', '\\u0026'), chr(8232), '\\u2028'), chr(8233), '\\u2029')"""


@query(f"""SELECT domain, '{{"count":' || count::VARCHAR || ',"merged_text":' || {_QUOTED} || ',"unique_count":' || unique_count::VARCHAR || '}}' AS value FROM (
           SELECT domain, sum(n)::BIGINT AS count, count(*)::BIGINT AS unique_count, string_agg(cleaned, chr(10) || '---' || chr(10) ORDER BY first, cleaned) AS merged_text FROM ({_UNIQUE}) GROUP BY domain)""")
def emit_crawl_json(spark: SparkSession, d: str) -> DataFrame:
    merged = crawl_clean.merged_per_domain(_rows(spark, d))
    return merged.select("domain", web.emit_crawl_json(F.col("count"), F.col("merged_text"), F.col("unique_count")).alias("value"))


#: The same by cutting the text at its signs, without a pattern.
_DOMAIN_BY_PARTS = """(SELECT CASE WHEN url IS NULL OR place = 0 OR len(translate(url, controls, '')) < len(url) OR translate(host, signs, '') <> host
              OR scheme <> '' AND (right(scheme, 1) <> ':' OR translate(lower(scheme[1]), letters, '') <> '' OR translate(lower(scheme[:-2]), letters || '0123456789+.-', '') <> '')
              OR len(list_filter(string_split(host, '%')[2:], lambda x: len(x) < 2 OR translate(lower(x[1:2]), '0123456789abcdef', '') <> '')) > 0
              OR contains(tail, ':') AND translate(string_split(tail, ':')[-1], '0123456789', '') <> '' THEN '' ELSE host END
       FROM (SELECT *, string_split(host, ']')[-1] AS tail
             FROM (SELECT *, string_split(split_part(split_part(split_part(url[place + 2:], '/', 1), '?', 1), '#', 1), '@')[-1] AS host
                   FROM (SELECT strpos(url, '//') AS place, url[:strpos(url, '//') - 1] AS scheme, 'abcdefghijklmnopqrstuvwxyz' AS letters,
                                list_reduce(list_transform(range(1, 32), lambda i: chr(i::INT)), lambda a, b: a || b) || chr(127) AS controls, ' ^`{}|' || chr(92) AS signs))))"""


@query(f"SELECT rec_id, {_DOMAIN_BY_PARTS} AS domain FROM crawl_records")
def extract_domain(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "crawl_records").select("rec_id", web.extract_domain(F.col("url")).alias("domain"))


@query(f"SELECT rec_id, {_CLEAN} AS cleaned FROM crawl_records")
def clean_html(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "crawl_records").select("rec_id", text.clean_html(F.col("html")).alias("cleaned"))


@query(r"SELECT rec_id, regexp_replace(html, '<[^>]*>', ' ', 'g') AS stripped, regexp_replace(html, '[\t\n\f\r ]+', ' ', 'g') AS collapsed FROM crawl_records")
def strip_and_collapse(spark: SparkSession, d: str) -> DataFrame:
    html = F.col("html")
    return table(spark, d, "crawl_records").select("rec_id", text.strip_tags(html).alias("stripped"), text.collapse_space(html).alias("collapsed"))


@query("SELECT rec_id, url, html, timestamp FROM crawl_records WHERE coalesce(url, html, timestamp) IS NOT NULL")
def parse_crawl_json(spark: SparkSession, d: str) -> DataFrame:
    """Records as JSON lines and back."""
    lines = table(spark, d, "crawl_records").select("rec_id", F.to_json(F.struct("url", "html", "timestamp")).alias("value"))
    parsed = lines.select("rec_id", web.parse_crawl_json(F.col("value")).alias("r")).select("rec_id", "r.*")
    return parsed.where("coalesce(url, html, timestamp) IS NOT NULL")


@query(r"SELECT rec_id FROM crawl_records WHERE regexp_matches(html, '[^\s\x0b]')")
def filter_blank_lines(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "crawl_records").where(F.col("html").rlike(r"\S")).select("rec_id")


@query(f"SELECT rec_id FROM (SELECT rec_id, {_DOMAIN} AS domain FROM crawl_records) WHERE domain <> ''")
def filter_no_domain(spark: SparkSession, d: str) -> DataFrame:
    return extract_domain(spark, d).where("domain <> ''").select("rec_id")


@query(f"SELECT rec_id FROM (SELECT rec_id, {_CLEAN} AS cleaned FROM crawl_records) WHERE cleaned <> ''")
def filter_empty_text(spark: SparkSession, d: str) -> DataFrame:
    return clean_html(spark, d).where("cleaned <> ''").select("rec_id")


# Files: written by the sinks into the shared folder and scanned again.


def _scratch(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/kvflow/files-{uuid.uuid4().hex}"


def _written_counts(spark: SparkSession, d: str) -> DataFrame:
    """Word counts written to three partition files and read as lines with their file."""
    pairs = _counts(spark, d).select(F.col("word").alias("key"), F.col("cnt").cast("string").alias("value"))
    return read_lines(spark, [f"file://{path}" if path.startswith("/") else path for path in write_partitions(pairs, 3, _scratch(spark))])


@query(f"SELECT word AS key, cnt::VARCHAR AS value FROM ({_COUNTS})")
def scan_text(spark: SparkSession, d: str) -> DataFrame:
    parts = F.split("value", "\t")
    return _written_counts(spark, d).select(parts[0].alias("key"), parts[1].alias("value"))


@query(f"SELECT 'mr-out-' || reduce_id::VARCHAR AS name, count(*)::BIGINT AS n_lines FROM ({_PLACED}) GROUP BY reduce_id")
def scan_multi_file(spark: SparkSession, d: str) -> DataFrame:
    return _written_counts(spark, d).groupBy(F.regexp_extract("file", "[^/]+$", 0).alias("name")).agg(F.count("*").alias("n_lines"))


@query("SELECT coalesce(url, '') AS url, coalesce(html, '') AS html, coalesce(timestamp, '') AS timestamp FROM crawl_records WHERE coalesce(url, html, timestamp) IS NOT NULL")
def scan_jsonl(spark: SparkSession, d: str) -> DataFrame:
    folder = _scratch(spark)
    lines = table(spark, d, "crawl_records").select(F.to_json(F.struct("url", "html", "timestamp")).alias("value"))
    lines.union(spark.createDataFrame([("",), (" \t",), ("no json",)], "value string")).write.text(folder)
    return crawl_lines(read_lines(spark, [folder]))


# The table of lines that strict reading takes or leaves, by number; the rest of the columns is what it makes of them.
_STRICT = [
    ('{"url":"//h/1","html":"a","timestamp":"t"}', ("//h/1", "a", "t")),
    ('{"URL":"//h/2","Html":"b"}', ("//h/2", "b", "")),
    ('{"url":123,"html":"c"}', None),
    ('{"url":"//h/4","timestamp":5}', None),
    ('{"url":"//h/5"} trailing', None),
    ("{'url':'//h/6'}", None),
    ('{"url":"//h/7","url":"//h/8"}', ("//h/8", "", "")),
    ('{"url":null,"html":"d","other":[1]}', ("", "d", "")),
    ("null", ("", "", "")),
    ("[1]", None),
    ("", None),
]


@query("SELECT * FROM (VALUES " + ", ".join(f"('{line.replace(chr(39), chr(39) * 2)}', '{r[0]}', '{r[1]}', '{r[2]}')" for line, r in _STRICT if r) + ") AS t(line, url, html, timestamp)")
def strict_json(spark: SparkSession, d: str) -> DataFrame:
    lines = spark.createDataFrame([(line,) for line, _ in _STRICT], "value string").where("value <> ''")
    read = lines.select(F.col("value").alias("line"), web.parse_crawl_json_strict(F.col("value")).alias("r")).where("r.url IS NOT NULL")
    return read.select("line", "r.*")


@query(f"SELECT word AS key, cnt::VARCHAR AS value FROM ({_COUNTS})")
def combine_udf(spark: SparkSession, d: str) -> DataFrame:
    """The same count by Python map and combine functions, which run before the shuffle."""
    _, reducer, _ = REGISTRY.resolve("wordcount_map", "wordcount_reduce")
    combine = Entry(_python_sum, native=False)
    lines = table(spark, d, "documents").where("text IS NOT NULL").select(F.col("source").alias("file"), F.col("text").alias("value"))
    return reducer.function(mapped(lines, Entry(_python_words, native=False), combine))


def _python_words(_: str, contents: str) -> list[tuple[str, str]]:
    import regex

    return [(word.lower(), "1") for word in regex.findall(r"[a-zA-Z\p{Han}]+", contents)]


def _python_sum(_: str, values: list[str]) -> str:
    return str(sum(int(v) for v in values))


@query("SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS start, event_type AS kind, count(*)::BIGINT AS n FROM events GROUP BY ALL")
def windowed_events(spark: SparkSession, d: str) -> DataFrame:
    """The streaming windows over a finished table."""
    return windowed_counts(table(spark, d, "events")).select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "kind", "n")


# Patterns that map and reduce functions express: aggregates, joins of tagged inputs, secondary order.


@query("SELECT event_type, count(*)::BIGINT AS cnt FROM events GROUP BY event_type")
def count_per_key(spark: SparkSession, d: str) -> DataFrame:
    return wordcount.group_sizes(table(spark, d, "events"), "event_type")


@query("SELECT kv_id, key, CASE WHEN regexp_full_match(value, '[+-]?[0-9]+') THEN try_cast(value AS BIGINT) END AS number FROM key_values WHERE regexp_full_match(value, '[+-]?[0-9]+')")
def atoi_or_skip(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "key_values").select("kv_id", "key", text.integer_or_skip(F.col("value")).alias("number")).where("number IS NOT NULL")


@query("""SELECT l_suppkey, count(*)::BIGINT AS n, round(sum(l_quantity)::DOUBLE, 4) AS total, round(avg(l_quantity)::DOUBLE, 6) AS mean,
          min(l_quantity)::DOUBLE AS least, max(l_quantity)::DOUBLE AS most FROM lineitem GROUP BY l_suppkey""")
def aggregates_by_key(spark: SparkSession, d: str) -> DataFrame:
    q = F.col("l_quantity").cast("double")
    return table(spark, d, "lineitem").groupBy("l_suppkey").agg(
        F.count("*").alias("n"), F.round(F.sum(q), 4).alias("total"), F.round(F.avg(q), 6).alias("mean"), F.min(q).alias("least"), F.max(q).alias("most")
    )


@query("""SELECT o_custkey, count(DISTINCT o_orderkey)::BIGINT AS n_orders, count(*)::BIGINT AS n_lines FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_custkey""")
def reduce_side_join(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("lines"))
    joined = table(spark, d, "orders").select("o_orderkey", "o_custkey").join(lines, F.col("o_orderkey") == F.col("l_orderkey"))
    return joined.groupBy("o_custkey").agg(F.count_distinct("o_orderkey").alias("n_orders"), F.sum("lines").alias("n_lines"))


@query("""SELECT o_custkey, o_orderkey, (row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey))::INT AS nth FROM orders""")
def secondary_sort(spark: SparkSession, d: str) -> DataFrame:
    ordered = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return table(spark, d, "orders").select("o_custkey", "o_orderkey", F.row_number().over(ordered).alias("nth"))


@query("""SELECT job_id, count(*)::BIGINT AS n_tasks, sum((lower(trim(state)) = 'completed')::INT)::BIGINT AS n_done,
          round(sum((lower(trim(state)) = 'completed')::INT) / count(*), 6) AS ratio FROM dashboard_tasks GROUP BY job_id""")
def partition_readiness(spark: SparkSession, d: str) -> DataFrame:
    done = F.sum(F.when(F.lower(F.trim("state")) == "completed", 1).when(F.col("state").isNotNull(), 0))
    return table(spark, d, "dashboard_tasks").groupBy("job_id").agg(
        F.count("*").alias("n_tasks"), done.alias("n_done"), F.round(done / F.count("*"), 6).alias("ratio")
    )


@query("SELECT job_id, round(median(elapsed_ms)::DOUBLE, 3) AS median_ms FROM dashboard_tasks WHERE elapsed_ms >= 0 AND elapsed_ms < 2592000000 GROUP BY job_id")
def median_by_job(spark: SparkSession, d: str) -> DataFrame:
    valid = table(spark, d, "dashboard_tasks").where("elapsed_ms >= 0 AND elapsed_ms < 2592000000")
    # Counts per value are made before the shuffle by job; of a job only its different values meet in one task, and these may spill.
    counts = valid.groupBy("job_id", "elapsed_ms").agg(F.count("*").alias("n"))
    job = Window.partitionBy("job_id").orderBy("elapsed_ms")
    ranked = counts.withColumn("upto", F.sum("n").over(job)).withColumn("total", F.sum("n").over(job.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    middle = lambda rank: F.min(F.when(F.col("upto") >= rank, F.col("elapsed_ms")))
    both = middle(F.floor((F.col("total") + 1) / 2)) + middle(F.floor(F.col("total") / 2) + 1)
    return ranked.groupBy("job_id").agg(F.round(both.cast("double") / 2, 3).alias("median_ms"))


@query("SELECT ckpt_id, job_id FROM (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY stored_at DESC NULLS LAST, ckpt_id DESC) AS r FROM job_checkpoints) WHERE r = 1")
def latest_checkpoints(spark: SparkSession, d: str) -> DataFrame:
    newest = F.max_by("ckpt_id", F.struct(F.coalesce(F.unix_micros("stored_at"), F.lit(-(1 << 62))), "ckpt_id"))
    return table(spark, d, "job_checkpoints").groupBy("job_id").agg(newest.alias("ckpt_id"))
