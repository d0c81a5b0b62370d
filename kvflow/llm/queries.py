"""Queries of the training-data operators and the SQL that DuckDB runs beside them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from kvflow.llm import mixing, neardup, pages, percentiles, terms, tokens, truncation
from kvflow.session import table

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
def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return neardup.duplicate_pairs(table(spark, d, "crawl_records"))


@query()
def p1_classes(spark: SparkSession, d: str) -> DataFrame:
    return neardup.class_links(table(spark, d, "crawl_records"))


@query()
def p1_groups(spark: SparkSession, d: str) -> DataFrame:
    return neardup.groups(table(spark, d, "crawl_records"))


_PERCENTILES = """
    WITH once AS (
        SELECT DISTINCT row_id, lower(trim(type)) AS type, strftime(DATE '1970-01-01' + (epoch_us(snapshot_at) // 86400000000)::INT, '%Y-%m-%d') AS day,
               elapsed_ms AS v
        FROM dashboard_tasks WHERE elapsed_ms >= 0 AND elapsed_ms < 2592000000),
    scoped AS (SELECT type, coalesce(day, '') AS day, v FROM once UNION ALL SELECT type, 'all', v FROM once),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY type, day ORDER BY v) AS r, count(*) OVER (PARTITION BY type, day) AS n FROM scoped)
    SELECT type, day, p::INT AS permille, n::BIGINT AS n, v::BIGINT AS value, 0::BIGINT AS error_bound
    FROM ranked, (VALUES (500), (900), (990), (999)) AS w(p) WHERE r = greatest(1, (n * p + 999) // 1000)
"""


@query(_PERCENTILES)
def p3_percentiles(spark: SparkSession, d: str) -> DataFrame:
    return percentiles.percentiles(percentiles.summary(percentiles.measurements(table(spark, d, "dashboard_tasks"))))


@query(_PERCENTILES.replace("elapsed_ms AS v", "elapsed_ms - elapsed_ms % 256 AS v").replace("row_id,", "row_id, elapsed_ms,").replace("0::BIGINT AS error", "255::BIGINT AS error"))
def p3_rounded(spark: SparkSession, d: str) -> DataFrame:
    """From summaries that drop eight bits: values too low by at most 255 ms."""
    cells = percentiles.summary(percentiles.measurements(table(spark, d, "dashboard_tasks")), dropped_bits=8)
    return percentiles.percentiles(cells, dropped_bits=8)


_TERMS = """
    WITH records AS (SELECT DISTINCT kv_id, key, value FROM key_values),
    total AS (SELECT count(*) AS n_all FROM records),
    words AS (SELECT kv_id, key, value, unnest(list_transform(regexp_extract_all(value, '[a-zA-Z\\p{Han}]+'), lambda w: lower(w))) AS w FROM records),
    per_record AS (SELECT w, kv_id, key, value, count(*) AS n FROM words GROUP BY ALL),
    counts AS (
        SELECT 'key' AS field, key AS term, count(*)::BIGINT AS n_occurrences, count(*)::BIGINT AS n_records FROM records WHERE key <> '' GROUP BY key
        UNION ALL
        SELECT 'value', w, sum(n)::BIGINT, count(*)::BIGINT FROM per_record GROUP BY w),
    marked AS (SELECT counts.*, CASE WHEN n_records < 3 THEN 'rare' WHEN n_records > n_all * 0.02 THEN 'common' END AS mark FROM counts, total)
    SELECT field, term, n_occurrences, n_records, mark FROM marked
"""


@query(_TERMS + " WHERE mark IS NOT NULL")
def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return p4_terms(spark, d).where("mark IS NOT NULL")


@query(_TERMS)
def p4_terms(spark: SparkSession, d: str) -> DataFrame:
    return terms.marked(terms.term_counts(table(spark, d, "key_values"))).drop("n_all")


@query(_TERMS)
def p4_spilled(spark: SparkSession, d: str) -> DataFrame:
    """The same with buffers so small that all terms go through files, split by hash bits more than once."""
    return terms.marked(terms.term_counts(table(spark, d, "key_values"), part_rows=500)).drop("n_all")


@query()
def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return pages.main_pieces(table(spark, d, "crawl_records"))


@query()
def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokens.encode(table(spark, d, "documents"), "doc_id", "text")


@query()
def p9_mix(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix(table(spark, d, "documents"), table(spark, d, "mix_targets"))


@query()
def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixing.shares(p9_mix(spark, d), table(spark, d, "mix_targets"))


@query()
def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return truncation.truncated(table(spark, d, "documents")).select("doc_id")


@query()
def p10_rates(spark: SparkSession, d: str) -> DataFrame:
    documents = table(spark, d, "documents")
    return truncation.rates(documents, truncation.truncated(documents))


