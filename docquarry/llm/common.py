"""Helpers that several corpus operators share."""

from __future__ import annotations

import ctypes
import gc
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from docquarry.session import ship_package

#: Rows of one Arrow batch; texts may be long, so batches stay small.
ARROW_ROWS = 512

_SPACE = re.compile(rb"[\x20\x09-\x0d]")


def bounded_batches(spark: SparkSession) -> None:
    """Sends the package to the executors and keeps the batches that go to Python small."""
    ship_package(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))


def narrow(docs: DataFrame, *exprs: str) -> DataFrame:
    """Only what an operator reads; other columns, whatever their names, stay out of its plan."""
    bounded_batches(docs.sparkSession)
    return docs.selectExpr(*exprs)


def releasing(run):
    """A function of batches that gives freed memory back to the system when a task's last batch is done: Python
    processes wait for later tasks, and what they hold counts as the executor's."""

    def released(batches):
        yield from run(batches)
        gc.collect()
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL(None).malloc_trim(0)
        except (AttributeError, OSError):
            pass  # another C library

    return released


def word_blocks(data: bytes, size: int = 1 << 20):
    """Lists of the words of data (runs of bytes other than space and \\t \\n \\v \\f \\r).

    A long text comes in several lists, so that memory does not follow its length.
    """
    at = 0
    while len(data) - at > size:
        cut = _SPACE.search(data, at + size)
        if not cut:
            break
        yield data[at : cut.start()].split()
        at = cut.end()
    yield (data[at:] if at else data).split()
