"""Five stages over the documents table; each one's result is written and read again for the next.

A stage takes (spark, docs, sf_dir) and works on all that its predecessor kept. All but the last
return the columns of documents. Null texts count as empty ones in every stage and stay null; repeated
rows are treated alike, but for the near-dedup, which keeps one; an empty table stays empty through all
stages. Columns that documents has beside doc_id, text and n_chars go through unchanged.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from inkwell.llm import bpe, decontaminate, line_dedup, near_dups, weak_quality
from inkwell.llm.common import cut, discard, load


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weak-label classifier rejects go."""
    return weak_quality.keep_good(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that repeat others go, but for one of each group; the documents stay."""
    return line_dedup.remove_lines(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates stays."""
    return near_dups.keep_one(docs)


def leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain a benchmark item go."""
    return decontaminate.drop_leaks(docs, load(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and of the text they decode to."""
    return bpe.round_trip(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality classifier", quality),
    ("line dedup", lines),
    ("near-dedup", near),
    ("decontamination", leaks),
    ("bpe", tokens),
]

#: No stage can be put in SQL: models, sketches and tokenizers; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows for the documents table."""
    docs, held = load(spark, sf_dir, "documents"), None
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            before, held = held, cut(docs, f"stage-{k}")
            discard(before)
            docs = held
    return docs
