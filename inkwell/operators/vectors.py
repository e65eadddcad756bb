"""Exact cosine search over vectors: blocks of them against a query, or column against column."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

THRESHOLD = 0.30


def valid_vector(vector: Column) -> Column:
    """Not empty, every entry a finite number."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return F.coalesce((F.size(vector) > 0) & F.forall(vector, finite), F.lit(False))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def cosine(a: Column, b: Column, mismatch: Column | None = None) -> Column:
    """0 where a norm is 0; mismatch (null) where the lengths differ."""
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    value = F.when(norms == 0, F.lit(0.0)).otherwise(dot(a, b) / norms)
    return F.when(F.size(a) == F.size(b), value).otherwise(F.lit(None).cast("double") if mismatch is None else mismatch)


def block_similarity(block: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Cosine of every row with the query, 0 where a norm is 0. Sums run row by row in one order, so equal rows get equal values."""
    norms = np.sqrt((block * block).sum(1)) * math.sqrt(float((query * query).sum()))
    products = (block * query).sum(1)
    return np.divide(products, norms, out=np.zeros(len(block)), where=norms != 0)


#: Numbers of a block; batches of longer vectors are taken in several blocks.
BLOCK_NUMBERS = 1 << 20


def scored(records: DataFrame, query: Sequence[float], vector: str = "embedding") -> DataFrame:
    """records with similarity; rows of other lengths, or without a vector, are dropped.

    Vectors come in Arrow batches, whose numbers lie one after another: a batch is a matrix without a copy of any row.
    A null in a vector makes its similarity null.
    """
    wanted, at = [float(x) for x in query], records.columns.index(vector)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q = np.array(wanted)
        step = max(1, BLOCK_NUMBERS // max(1, len(q)))
        for batch in batches:
            for k in range(0, batch.num_rows, step):
                some = batch.slice(k, step)
                numbers = some.column(at).flatten()
                block = np.asarray(numbers.fill_null(float("nan")) if numbers.null_count else numbers).astype(np.float64).reshape(some.num_rows, -1)
                found = block_similarity(block, q) if len(q) else np.zeros(some.num_rows)
                lost = np.isnan(block).any(1) if numbers.null_count else np.zeros(some.num_rows, bool)
                yield pa.RecordBatch.from_arrays([*some.columns, pa.array(found, pa.float64(), mask=lost)], names=[*some.schema.names, "similarity"])

    fitting = records.where(F.size(vector) == len(wanted))
    return fitting.mapInArrow(run, StructType([*fitting.schema.fields, StructField("similarity", DoubleType())]))


def top_similar(records: DataFrame, query: Sequence[float], note: str, order: str, threshold: float = THRESHOLD, per_note: int = 3, limit: int = 20, cap_first: bool = False) -> DataFrame:
    """Best rows by similarity with at most per_note of each note.

    The cap keeps a note's best rows; with cap_first it keeps its first ones by order, whatever their
    similarity, which is how the resident index ranks.
    """
    if cap_first:  # the resident index has one number of dimensions; a query of another finds nothing
        records = records.where(F.size("embedding") == len(query))
    hits = scored(records, query).where(F.col("similarity") >= threshold)
    within = Window.partitionBy(note).orderBy(*([F.asc(order)] if cap_first else [F.desc("similarity"), F.asc(order)]))
    kept = hits.withColumn("_n", F.row_number().over(within)).where(F.col("_n") <= per_note).drop("_n")
    top = kept.orderBy(F.desc("similarity"), F.asc(order)).limit(limit)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("similarity"), F.asc(order))).cast("int"))


def diagnostics(records: DataFrame, query: Sequence[float], order: str, top: int = 10) -> tuple[DataFrame, DataFrame]:
    """(raw top without threshold or cap, one row of counts)."""
    counts = records.agg(F.count(F.lit(1)).alias("evaluated"), F.count_if(F.size("embedding") == len(query)).alias("same_dimensions"))
    return scored(records, query).orderBy(F.desc("similarity"), F.asc(order)).limit(top), counts
