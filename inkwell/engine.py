"""The search engine in one place: text, semantic and hybrid search over notes, chunks and their vectors; what can be cancelled."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.operators import hybrid, text_search, vectors
from inkwell.operators.generation import Provider
from inkwell.operators.maintenance import query_input

# Fixed numbers: hits of each side that a hybrid search fuses, and characters of a semantic hit's snippet.
TEXT_HITS, SEMANTIC_HITS, PER_NOTE, SNIPPET = 40, 30, 3, 280
WITHOUT_VECTORS = "The semantic part of the search is not available; only text results were used."


@contextmanager
def cancellable(spark: SparkSession, name: str) -> Iterator[None]:
    """Jobs inside carry a tag; cancel(spark, name), from any thread, ends them and what they would have published is never pointed to."""
    spark.addTag(name)
    try:
        yield
    finally:
        spark.removeTag(name)


def cancel(spark: SparkSession, name: str) -> list[str]:
    return spark.interruptTag(name)


@dataclass
class Found:
    """Results, whether vectors took part, and what the user should know."""

    results: DataFrame
    semantic: bool
    warnings: list[str] = field(default_factory=list)


@dataclass
class SearchEngine:
    """notes (path, basename), chunks (path, chunk_index, chunk_id, text) and searchable records (chunk_id, embedding, ord) of one model; the latter may be missing."""

    notes: DataFrame
    chunks: DataFrame
    records: DataFrame | None = None
    provider: Provider | None = None
    model: str = ""
    dimensions: int | None = None
    weights: tuple[float | None, float | None] = (0.7, 0.3)

    def vector(self, query: str) -> list[float] | None:
        """The query's vector; None where there is no provider, it refuses, or its dimensions aren't the records'."""
        if self.provider is None or self.records is None:
            return None
        reply = self.provider([query_input(query, self.model)])
        vector = reply.vectors[0] if reply.vectors else None
        return vector if vector and (self.dimensions is None or len(vector) == self.dimensions) else None

    def text(self, query: str, limit: int = 30, per_note: int = PER_NOTE) -> DataFrame:
        return text_search.search_text(self.notes, self.chunks, query, per_note, limit)

    def semantic(self, vector: list[float], limit: int = 20, threshold: float = vectors.THRESHOLD) -> DataFrame:
        """Best chunks by similarity: rank, path, chunk_id, similarity, snippet. Records without a chunk are dropped; only vectors and places are ranked, texts join the few that are left."""
        places = self.chunks.select("chunk_id", "path")
        own = self.records.select("chunk_id", "embedding", "ord").join(places, "chunk_id")
        top = vectors.top_similar(own, vector, "path", "ord", threshold, PER_NOTE, limit).select("rank", "path", "chunk_id", "similarity", "ord")
        texts = self.chunks.select("chunk_id", "text").join(F.broadcast(top), "chunk_id")  # limit rows
        snippet = F.when(F.length("text") > SNIPPET, F.concat(F.substring("text", 1, SNIPPET), F.lit("..."))).otherwise(F.col("text"))
        return texts.select("rank", "path", "chunk_id", "similarity", "ord", snippet.alias("snippet")).orderBy("rank")

    def hybrid(self, query: str, limit: int = 20) -> Found:
        """Text hits of the query's telling terms and semantic hits of the whole query, fused; text hits alone if there is no vector."""
        hits = hybrid.scale_text(self.text(hybrid.prepared_query(query), TEXT_HITS).withColumn("ord", F.col("rank")))
        vector = self.vector(query)
        if vector is None:
            none = self.notes.select("path", F.lit(0.0).alias("similarity"), F.lit(0).alias("ord")).limit(0)
            return Found(hybrid.fuse(hits, none, hybrid.weights_of(*self.weights), limit), False, [WITHOUT_VECTORS])
        return Found(hybrid.fuse(hits, self.semantic(vector, SEMANTIC_HITS), hybrid.weights_of(*self.weights), limit), True)

    def search(self, mode: str, query: str, limit: int = 20) -> Found:
        """A search by mode: text, semantic or hybrid. Blank queries find nothing; a semantic search without a vector finds nothing and says so."""
        if mode not in ("text", "semantic", "hybrid"):
            raise ValueError(f"no such mode: {mode}")
        if mode == "hybrid":
            return self.hybrid(query, limit)
        if mode == "text":
            return Found(self.text(query, limit), False)
        vector = self.vector(query) if query.strip() else None
        if vector is None:
            schema = "rank int, path string, chunk_id string, similarity double, ord string, snippet string"
            return Found(self.notes.sparkSession.createDataFrame([], schema), False, [WITHOUT_VECTORS])
        return Found(self.semantic(vector, limit), True)
