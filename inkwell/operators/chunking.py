"""Overlapping chunks that end at spaces."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from inkwell.functions.batches import lean, slices
from inkwell.functions.text import SPACE

SIZE, OVERLAP, LEAST = 1200, 150, 30
_SPACES = re.compile(f"[{SPACE}]+")


def chunks_of(text: str, size: int = SIZE, overlap: int = OVERLAP, least: int = LEAST) -> list[str]:
    """Cleaned chunks of the raw text; only U+0020 is a place to break."""
    clean = lambda t: _SPACES.sub(" ", t).strip(" ")
    found, start, n = [], 0, len(text)
    while start < n:
        end = min(start + size, n)
        if end < n:
            before = text.rfind(" ", start + 1, end + 1)
            after = text.find(" ", end) if before < 0 else -1
            end = before if before >= 0 else after if after >= 0 else end
        if len(piece := clean(text[start:end])) >= least:
            found.append(piece)
        following = max(0, end - overlap)
        if end >= n or following <= start:
            break
        start = following
    if not found and (whole := clean(text)):
        return [whole]
    return found


def chunk_notes(notes: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, path, chunk_index, chunk_id, text) of notes (key, path, text); null texts have no chunks."""
    kind = notes.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole)):
            rows = [(k, p, i, f"{p}::{i}", c) for k, p, t in zip(*(x.to_pylist() for x in batch.columns)) for i, c in enumerate(chunks_of(t or ""))]
            columns = list(zip(*rows)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], batch.schema.field(0).type), pa.array(columns[1], pa.string()), pa.array(columns[2], pa.int32()), pa.array(columns[3], pa.string()), pa.array(columns[4], pa.string())], names=[key, "path", "chunk_index", "chunk_id", "text"])

    return notes.select(key, "path", "text").mapInArrow(lean(run), f"{key} {kind}, path string, chunk_index int, chunk_id string, text string")
