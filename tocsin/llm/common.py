"""Shared column expressions and table helpers of the training-data operators."""

from __future__ import annotations

import ctypes
import gc
import string
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tocsin.session import discard, materialize, row_count

#: Runs of letters and digits, with every code point beyond ASCII counted as a letter.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: Rows that may be broadcast after a count has proven the bound (ids or short rows).
BROADCAST_ROWS = 500_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lower_ascii(text: Column) -> Column:
    """Lower-cases A-Z and nothing else; null becomes the empty string.

    Texts that are all ASCII (as many characters as bytes) take the faster ``lower``.
    """
    text = F.coalesce(text.cast("string"), F.lit(""))
    slow = F.translate(text, string.ascii_uppercase, string.ascii_lowercase)
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(slow)


def words(text: Column) -> Column:
    """Array of the lower-cased words of a text; empty for null."""
    return F.regexp_extract_all(lower_ascii(text), F.lit(WORD), F.lit(0))


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not use, upper or lower case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def broadcast_counted(stored: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast hint for a materialized table whose count is within the bound."""
    return F.broadcast(stored) if row_count(stored) <= max_rows else stored


@contextmanager
def small_batches(spark: SparkSession, rows: int = 1000):
    """Jobs inside exchange fewer rows at a time with Python, for rows that may hold long values."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    old = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, old)


def release_memory() -> None:
    """For the end of a Python task: what it freed goes back to the system, as the worker process
    stays for later stages."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def text_hash(text: Column) -> Column:
    """64-bit hash of a text; null counts as the empty string."""
    return F.xxhash64(F.coalesce(text.cast("string"), F.lit("")))


def drop_rows(docs: DataFrame, gone: DataFrame, name: str) -> DataFrame:
    """``docs`` without the rows whose doc_id and text hash stand in ``gone`` (doc_id, th).

    Rows with the same id and another text stay. The keys are written once; few of them are
    broadcast, so that texts do not move, many of them meet the documents in a shuffled anti
    join. Null ids match null ids.
    """
    key, th = fresh(docs, "gone_id"), fresh(docs, "gone_th")
    gone = materialize(gone.select(F.col("doc_id").alias(key), F.col("th").alias(th)).distinct(), name)
    same = docs["doc_id"].eqNullSafe(gone[key]) & (text_hash(docs["text"]) == gone[th])
    return docs.join(broadcast_counted(gone), same, "left_anti")


__all__ = ["BROADCAST_ROWS", "WORD", "broadcast_counted", "discard", "drop_rows", "fresh", "lower_ascii", "materialize", "release_memory", "row_count", "small_batches", "table", "text_hash", "words"]
