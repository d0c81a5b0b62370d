"""Crawl cleaning: visible text per domain, duplicates within a domain counted once and merged."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kvflow.functions import text, web
from kvflow.session import parallel


def cleaned_rows(df: DataFrame, order: Column) -> DataFrame:
    """(ord, domain, cleaned) of records with url and html; those without a domain or text are left out."""
    source = parallel(df.select(order.alias("ord"), "url", "html")).withColumn("domain", web.extract_domain(F.col("url"))).where("domain <> ''")
    # As a generated column the text is made once; a plain one would be made for the filter and again for the result.
    rows = source.select("ord", "domain", F.explode(F.array(text.clean_html(F.col("html")))).alias("cleaned"))
    return rows.where("cleaned <> ''")


def unique_texts(rows: DataFrame) -> DataFrame:
    """(domain, cleaned, first, n): one row per different text of a domain, with the first place and the number of copies.

    The shuffle key holds the text, so a domain with most of the rows is spread over all tasks.
    """
    return rows.groupBy("domain", "cleaned").agg(F.min("ord").alias("first"), F.count("*").alias("n"))


def counts_per_domain(rows: DataFrame) -> DataFrame:
    """(domain, count, unique_count) without merging texts: safe for domains of any size."""
    return unique_texts(rows).groupBy("domain").agg(F.sum("n").alias("count"), F.count("*").alias("unique_count"))


def merged_per_domain(rows: DataFrame) -> DataFrame:
    """(domain, count, unique_count, merged_text): different texts in the order of their first place.

    merged_text is one value per domain, hence at most 2 GB; counts_per_domain serves beyond that.
    """
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("first", "cleaned"))), lambda x: x["cleaned"])
    return unique_texts(rows).groupBy("domain").agg(
        F.sum("n").alias("count"), F.count("*").alias("unique_count"), text.join_texts(ordered).alias("merged_text")
    )
