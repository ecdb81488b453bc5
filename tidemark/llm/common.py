"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import written

__all__ = ["carried", "documents_of", "lean", "partitions", "read_table", "text_or_empty", "written"]

#: Bytes of one batch of texts that goes to Python; sessions that allow more are held to this, so that a batch of long texts does not fill a worker.
BATCH_BYTES = 2 << 20


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables, opened by Spark only (the folder may be in a store that nothing else can open)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def hold_batches(spark: SparkSession) -> None:
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    allowed = spark.conf.get(key).rstrip("b")
    if not allowed.isdigit() or not 0 < int(allowed) <= BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


def lean(run: Callable) -> Callable:
    """run, for mapInArrow, after which a worker gives the memory of its task back: Spark keeps workers for later tasks, and what their allocators hold on to counts as the executor's."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL(None).malloc_trim(0)
            except (AttributeError, OSError):  # another C library
                pass

    return wrapped


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def documents_of(docs: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """The two columns that every text operator reads, and those to carry along; all others, also ones named like an operator's own, are left behind. Batches of texts
    that go to Python are held to BATCH_BYTES from here on."""
    hold_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty("text").alias("text"), *carry)


def carried(docs: DataFrame, carry: tuple[str, ...]) -> str:
    """The carried columns as the end of a schema string."""
    return "".join(f", {c} {docs.schema[c].dataType.simpleString()}" for c in carry)
