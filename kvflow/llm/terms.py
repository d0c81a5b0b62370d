"""How often every distinct key and word occurs, by recursive radix spilling.

Terms are hashed; the exchange partitions them by the hash, after each task has combined what it has of a term. A task that
receives more than its buffer writes the terms by four bits of the hash to files, splits a file that is still too large by
the next four bits, and so on, and lets DuckDB aggregate each part. The files lie in the shared folder, in whatever file
system that is, and go with the task; what DuckDB itself spills of a part goes there too, where the folder is mounted.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator
from itertools import chain
from typing import Any

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kvflow.functions.text import tokenize
from kvflow.session import local_path, materialise, shared_folder

#: Rows that a task combines before it passes them on, and that it aggregates at once; more are split by hash bits.
COMBINE_ROWS = 400_000
PART_ROWS = 1_000_000
RADIX_BITS = 4
MEMORY_LIMIT = "256MB"
#: A term in fewer records is rare, one in a larger share of all records is common.
RARE_BELOW = 3
COMMON_ABOVE = 0.02
SCHEMA = pa.schema([("field", pa.string()), ("term", pa.string()), ("h", pa.int64()), ("occ", pa.int64()), ("rec", pa.int64())])
SUMS = "SELECT field, term, h, sum(occ)::BIGINT AS occ, sum(rec)::BIGINT AS rec"
AS_SQL = "field string, term string, h bigint, occ bigint, rec bigint"


def occurrences(records: DataFrame, key: str, value: str) -> DataFrame:
    """(field, term, h, occ, rec): each term of each record; rec is 1 at its first occurrence there. Field '' counts records."""
    none = F.array().cast("array<struct<field:string,term:string,occ:bigint,rec:bigint>>")

    def cell(field: str, term: Column, rec: Column) -> Column:
        return F.struct(F.lit(field).alias("field"), term.alias("term"), F.lit(1).cast("bigint").alias("occ"), rec.cast("bigint").alias("rec"))

    words = F.sort_array(F.transform(tokenize(F.col(value)), F.lower))
    first = lambda w, i: F.when((i > 0) & (w == F.get(F.col("_words"), i - 1)), 0).otherwise(1)
    rows = records.withColumn("_words", words)
    of_key = F.when(F.col(key) != "", F.array(cell("key", F.col(key), F.lit(1)))).otherwise(none)
    of_words = F.coalesce(F.transform("_words", lambda w, i: cell("value", w, first(w, i))), none)
    cells = F.concat(F.array(cell("", F.lit(""), F.lit(1))), of_key, of_words)
    return rows.select(F.inline(cells)).select("field", "term", F.xxhash64("field", "term").alias("h"), "occ", "rec")


def _database(folder: str) -> duckdb.DuckDBPyConnection:
    """A DuckDB database in memory with a limit, which may spill into the folder where file calls reach it, and nowhere else."""
    place = local_path(folder)
    return duckdb.connect(":memory:", config={"threads": 1, "preserve_insertion_order": "false", "memory_limit": MEMORY_LIMIT, "temp_directory": f"{place}/kvflow-duckdb-{uuid.uuid4().hex}" if place else ""})


def _combined(batches: Iterator[pa.RecordBatch], folder: str) -> Iterator[pa.RecordBatch]:
    """Partial sums of a task's terms, at most COMBINE_ROWS rows at a time."""
    held, rows = [], 0
    with _database(folder) as db:
        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows >= COMBINE_ROWS:
                yield from _summed(db, pa.Table.from_batches(held))
                held, rows = [], 0
        if held:
            yield from _summed(db, pa.Table.from_batches(held))


def _summed(db: duckdb.DuckDBPyConnection, part: pa.Table) -> Iterator[pa.RecordBatch]:
    db.register("part", part)
    yield from db.sql(f"{SUMS} FROM part GROUP BY field, term, h").to_arrow_table().cast(SCHEMA).to_batches(max_chunksize=50_000)
    db.unregister("part")


class Part:
    """A file of terms that agree in the low bits of their hash."""

    def __init__(self, place: tuple[fs.FileSystem, str]):
        self.system, folder = place
        self.path = f"{folder}/{uuid.uuid4().hex}.arrow"
        self.rows, self.first, self.mixed = 0, None, False
        self.sink: Any = None

    def write(self, batch: pa.RecordBatch) -> None:
        if not batch.num_rows:
            return
        if self.sink is None:
            self.sink = self.system.open_output_stream(self.path)
            self.writer = pa.ipc.new_stream(self.sink, SCHEMA, options=pa.ipc.IpcWriteOptions(compression="zstd"))
            self.first = batch.column(2)[0].as_py()
        self.rows += batch.num_rows
        self.mixed = self.mixed or bool(pc.any(pc.not_equal(batch.column(2), self.first)).as_py())
        self.writer.write_batch(batch)

    def read(self) -> Iterator[pa.RecordBatch]:
        if self.sink is None:
            return
        self.writer.close()
        self.sink.close()
        with self.system.open_input_stream(self.path) as source:
            yield from pa.ipc.open_stream(source)
        self.system.delete_file(self.path)


def _split(batches: Iterable[pa.RecordBatch], bits: int, place: tuple[fs.FileSystem, str]) -> list[Part]:
    """The batches as files by four bits of the hash."""
    parts = [Part(place) for _ in range(1 << RADIX_BITS)]
    for batch in batches:
        digit = (batch.column(2).to_numpy() >> bits) & ((1 << RADIX_BITS) - 1)
        order = np.argsort(digit, kind="stable")
        batch, edges = batch.take(pa.array(order)), np.searchsorted(digit[order], np.arange((1 << RADIX_BITS) + 1))
        for part, at, end in zip(parts, edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            part.write(batch.slice(at, end - at))
    return parts


def _sums_of(part: Part, bits: int, place: tuple[fs.FileSystem, str], db: duckdb.DuckDBPyConnection, part_rows: int) -> Iterator[pa.RecordBatch]:
    if part.rows > part_rows and part.mixed and bits < 64:
        for child in _split(part.read(), bits, place):
            yield from _sums_of(child, bits + RADIX_BITS, place, db, part_rows)
        return
    # A part of one hash is summed piece by piece: its different terms are few.
    held: list[pa.RecordBatch] = []
    rows = 0
    for batch in part.read():
        held.append(batch)
        rows += batch.num_rows
        if rows > part_rows and not part.mixed:
            held = list(_summed(db, pa.Table.from_batches(held)))
            rows = 0
    if held:
        yield from _summed(db, pa.Table.from_batches(held))


def radix_sums(batches: Iterator[pa.RecordBatch], folder: str, part_rows: int = PART_ROWS) -> Iterator[pa.RecordBatch]:
    """Full sums of all terms in the batches. What exceeds part_rows goes to files in the folder, by hash bits.

    Rows of one term are never separated, so the result does not depend on how far the parts were split.
    """
    held: list[pa.RecordBatch] = []
    rows = 0
    with _database(folder) as db:
        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows > part_rows:
                break
        else:
            if held:
                yield from _summed(db, pa.Table.from_batches(held))
            return
        system, at = fs.FileSystem.from_uri(folder if "://" in folder or not folder.startswith("file:") else "file://" + folder[len("file:") :])
        place = (system, f"{at}/kvflow/terms-{uuid.uuid4().hex}")
        system.create_dir(place[1])
        try:
            parts = _split(chain(held, batches), 0, place)
            held.clear()
            for part in parts:
                yield from _sums_of(part, RADIX_BITS, place, db, part_rows)
        finally:
            system.delete_dir(place[1])


def term_counts(df: DataFrame, record: str = "kv_id", key: str = "key", value: str = "value", part_rows: int = PART_ROWS) -> DataFrame:
    """(field, term, n_occurrences, n_records, n_all): every distinct key and every distinct word of value.

    * A record is a distinct record id; rows with the same id are equal by contract and count once, rows without an id
      once for each different key and value. n_all is the number of all records, with or without terms.
    * Keys are taken as stored, null and empty ones give no term; words are runs of ASCII letters and Han characters in
      lower case. Very long values are sorted once each. An empty table gives an empty result.
    """
    spark = df.sparkSession
    folder = shared_folder(spark)
    records = df.select(F.col(record).alias("_id"), F.col(key).alias("_key"), F.col(value).alias("_value")).distinct()
    terms = occurrences(records, "_key", "_value").mapInArrow(lambda batches: _combined(batches, folder), AS_SQL)
    terms = terms.repartition("h").mapInArrow(lambda batches: radix_sums(batches, folder, part_rows), AS_SQL)
    counted = materialise(terms.drop("h"), "terms")
    total = counted.where(F.col("field") == "").agg(F.sum("rec")).first()[0] or 0
    return counted.where(F.col("field") != "").select("field", "term", F.col("occ").alias("n_occurrences"), F.col("rec").alias("n_records"), F.lit(total).cast("bigint").alias("n_all"))


def marked(counts: DataFrame, rare_below: int = RARE_BELOW, common_above: float = COMMON_ABOVE) -> DataFrame:
    """counts with mark: 'rare' in too few records, 'common' in too large a share of all, otherwise null."""
    common = F.col("n_records") > F.col("n_all") * F.lit(common_above)
    return counts.withColumn("mark", F.when(F.col("n_records") < rare_below, "rare").when(common, "common"))
