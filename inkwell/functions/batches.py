"""Bounds for the Arrow batches that Python workers see."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import SparkSession

Batches = Iterator[pa.RecordBatch]


def release() -> None:
    """Give memory that is free back to the system: workers are kept for later tasks, and so would it be."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


#: Bytes of a batch that goes to a worker; the usual 64 MB are held several times over, by the executor and by the worker.
BATCH_BYTES, BATCH_CONF = 4 << 20, "spark.sql.execution.arrow.maxBytesPerBatch"


def small_batches() -> None:
    """Lower the session's size of batches to BATCH_BYTES, unless it is lower already."""
    spark = SparkSession.getActiveSession()
    if spark is not None:
        said = spark.conf.get(BATCH_CONF, "64m")
        now = -1 if said.startswith("-") else spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(said)
        if now < 0 or now > BATCH_BYTES:
            spark.conf.set(BATCH_CONF, str(BATCH_BYTES))


def lean(function: Callable[[Batches], Batches], rows: int = 0) -> Callable[[Batches], Batches]:
    """A function for mapInArrow that sees so many rows at a time, if given, and leaves no memory behind when it ends.

    Batches of the session are small from then on.
    """
    small_batches()

    def run(batches: Batches) -> Batches:
        try:
            yield from function(b.slice(k, rows or b.num_rows) for b in batches for k in range(0, max(1, b.num_rows), rows or max(1, b.num_rows)))
        finally:
            release()

    return run


#: Bytes of texts that are Python strings at one time, several times over.
SLICE_BYTES = 1 << 20


def slices(batch: pa.RecordBatch, most_bytes: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """A batch in parts of some rows, about so many bytes each; none of an empty one."""
    rows = max(1, batch.num_rows * most_bytes // max(1, batch.nbytes))
    yield from (batch.slice(k, rows) for k in range(0, batch.num_rows, rows))
