"""Generation of vectors: providers as plug-ins, batches halved where an input is at fault, checkpoints, publication."""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkwell.functions.batches import lean, slices
from inkwell.operators import maintenance as M
from inkwell.operators.providers import DEFAULT_INPUTS, MOST_INPUTS
from inkwell.operators.vectors import valid_vector
from inkwell.sources import publish

#: Inputs that are tried first, to learn the dimensions, and those of a part of the checkpoint.
PROBES, PART_INPUTS = 3, 100_000


@dataclass
class Reply:
    """A provider's answer to some inputs: a vector for each, or what went wrong. Only errors of scope input that aren't fatal are an input's own."""

    vectors: list[list[float]] | None = None
    category: str | None = None
    scope: str = "operation"
    fatal: bool = True
    message: str | None = None
    requests: int = 1


Provider = Callable[[list[str]], Reply]


def word_embedder(dimensions: int = 16, refuse: str | None = None) -> Provider:
    """A deterministic provider for tests and offline use: words counted by the first hexadecimal digit of their MD5, at unit length.

    An input that holds the refused text makes its request fail like one that is too large.
    """

    def embed(inputs: list[str]) -> Reply:
        if refuse is not None and any(refuse in x for x in inputs):
            return Reply(category="input-rejected", scope="input", fatal=False)
        vectors = []
        for text in inputs:
            counts = [0] * dimensions
            for word in re.findall("[a-z0-9]+", text.lower()):
                counts[int(hashlib.md5(word.encode()).hexdigest()[0], 16) % dimensions] += 1
            norm = math.sqrt(sum(c * c for c in counts)) or 1.0
            vectors.append([c / norm for c in counts])
        return Reply(vectors)

    return embed


def ordered_vectors(items: list[tuple[int, list[float]]], inputs: int) -> list[list[float]] | None:
    """Reply items (index, vector) in the order of the inputs; None unless every index is there once."""
    found = dict(items)
    return [found[i] for i in range(inputs)] if len(items) == inputs and sorted(found) == list(range(inputs)) else None


@dataclass
class Outcome:
    """Vectors or error categories by place, requests that were made, and what stopped the rest."""

    results: dict[int, tuple[list[float] | None, str | None]] = field(default_factory=dict)
    requests: int = 0
    fatal: str | None = None


def embed_batch(inputs: list[str], provider: Provider, dimensions: int | None) -> Outcome:
    """Vectors of a batch. If one of its inputs is at fault, halves are tried, left first, until it is alone; any other error stops."""
    outcome, waiting = Outcome(), [(0, len(inputs))] if inputs else []
    while waiting:
        first, last = waiting.pop()
        reply = provider(inputs[first:last])
        outcome.requests += reply.requests
        if reply.vectors is not None:
            wrong = None
            if len(reply.vectors) != last - first:
                wrong = "invalid-response"
            elif not all(v and all(isinstance(x, (int, float)) and math.isfinite(x) for x in v) for v in reply.vectors):
                wrong = "invalid-vector"
            elif dimensions and any(len(v) != dimensions for v in reply.vectors):
                wrong = "dimension-mismatch"
            if wrong:
                outcome.fatal = wrong
                break
            outcome.results |= {first + k: (v, None) for k, v in enumerate(reply.vectors)}
        elif reply.scope != "input" or reply.fatal:
            outcome.fatal = reply.category or "unknown"
            break
        elif last - first == 1:
            outcome.results[first] = (None, reply.category)
        else:
            middle = first + (last - first) // 2
            waiting += [(middle, last), (first, middle)]
    return outcome


def embed_inputs(inputs: DataFrame, provider: Provider, dimensions: int | None, batch: int = DEFAULT_INPUTS) -> DataFrame:
    """(chunk_id, embedding, error, fatal) of inputs (chunk_id, input), by requests of batch inputs from within the tasks.

    An input that the provider refuses has an error and no vector. What stops a task is the error of all
    that it had left, marked fatal; other tasks go on, and a checkpoint keeps what was made.
    """
    size = min(MOST_INPUTS, max(1, batch))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stopped: str | None = None
        for rows in batches:
            for k in range(0, rows.num_rows, size):
                some = rows.column(0).slice(k, size).to_pylist()
                outcome = Outcome(fatal=stopped) if stopped else embed_batch(rows.column(1).slice(k, size).to_pylist(), provider, dimensions)
                stopped = outcome.fatal
                of = [outcome.results.get(i, (None, outcome.fatal)) for i in range(len(some))]
                lost = [i not in outcome.results for i in range(len(some))]
                yield pa.RecordBatch.from_arrays([pa.array(some, pa.string()), pa.array([v for v, _ in of], pa.list_(pa.float32())), pa.array([e for _, e in of], pa.string()), pa.array(lost, pa.bool_())], names=["chunk_id", "embedding", "error", "fatal"])

    return inputs.select("chunk_id", "input").mapInArrow(lean(run), "chunk_id string, embedding array<float>, error string, fatal boolean")


def probe(inputs: DataFrame, provider: Provider, order: list[str]) -> int | None:
    """The dimensions that the provider's vectors have, learned from the first inputs in an order that it takes; None if it takes none of them."""
    for row in inputs.orderBy(*order).limit(PROBES).select("input").collect():
        reply = provider([row.input])
        if reply.vectors and reply.vectors[0]:
            return len(reply.vectors[0])
        if reply.scope != "input" or reply.fatal:
            raise RuntimeError(f"the provider can't be used: {reply.category}")
    return None


RECORD = ("chunk_id", "text_hash", "dimensions", "embedding", "input_hash", "provider", "model")
RECORD_SCHEMA = "chunk_id string, text_hash string, dimensions int, embedding array<float>, input_hash string, provider string, model string"
#: Parts of the checkpoint are tables of their own; a part is published when all of its inputs are answered.
PART = "checkpoint-"


def checkpoint_parts(own: publish.Writer) -> list[str]:
    return [] if own.since is None else [t for t in own.since.tables if t.startswith(PART)]


def read_checkpoint(own: publish.Writer) -> DataFrame:
    """Records of all parts of the checkpoint; of several of one chunk the last part's."""
    rows = own.spark.createDataFrame([], RECORD_SCHEMA + ", part string")
    for part in checkpoint_parts(own):
        rows = rows.unionByName(own.read(part).where("embedding is not null").select(*RECORD, F.lit(part).alias("part")))
    last = rows.groupBy("chunk_id").agg(F.max_by(F.struct(*RECORD), "part").alias("r"))
    return last.select("r.*")


def update_vectors(own: publish.Writer, chunks: DataFrame, provider: Provider, name: str, model: str, hash_of: Callable[[Column], Column], batch: int = DEFAULT_INPUTS, part_inputs: int = PART_INPUTS) -> dict:
    """Bring the published vectors up to date with chunks (chunk_id, text_hash, input, order columns path and chunk_index).

    The plan says which records stay, which a checkpoint has and which are to be made. Inputs are answered in
    parts of about part_inputs; each part's vectors and errors are published as one more part of the checkpoint as soon as it is done, so a
    run that is killed loses what its last part had asked for, and the next run asks for the rest only. What stops the provider ends the run
    after its part. At the end the records are published and the checkpoint's parts dropped, in one version. Another writer's
    publication in between raises Conflict; the parts before it stay. Returns the plan's mode and counts, errors by category and whether records were published.
    """
    spark, manifest = own.spark, {} if own.since is None else own.since.manifest
    published = {k: v for k, v in manifest.get("embeddings", {}).items() if k not in ("total", "publication_id")}
    held = manifest.get("checkpoint") or {}
    target = M.target_identity(name, model, published, held.get("dimensions") if (held.get("provider"), held.get("model")) == (name, model) else None)
    if target["dimensions"] is None:
        target["dimensions"] = probe(chunks, provider, ["path", "chunk_index", "chunk_id"])
    hashed = hash_of(F.col("input"))
    with publish.staged(spark, own.root) as folder:

        def pinned(df: DataFrame, table: str, *by: str) -> DataFrame:
            df.write.partitionBy(*by).parquet(f"{folder}/{table}")
            return spark.read.schema(df.schema).parquet(f"{folder}/{table}")

        keyed = pinned(chunks.withColumn("published_hash", hashed).withColumn("target_hash", hashed), "chunks")
        canonical = own.read("embeddings") if own.has("embeddings") else spark.createDataFrame([], RECORD_SCHEMA)
        state = "missing" if "embeddings" not in manifest else "readable" if canonical.take(1) else "empty"
        plan, origins = M.update_plan(keyed, canonical.select(*RECORD), read_checkpoint(own), published, target, valid_vector(F.col("embedding")), state)
        origins = pinned(origins, "origins")
        row = plan.first().asDict()

        parts = -(-row["to_generate"] // part_inputs)
        of_part = F.pmod(F.xxhash64("chunk_id"), F.lit(max(1, parts))).cast("int").alias("part")
        wanted = keyed.join(origins.where("origin = 'generate'"), "chunk_id").select("chunk_id", "text_hash", "input", "target_hash", of_part)
        wanted = pinned(wanted, "wanted", "part") if parts else wanted
        shape = [F.lit(target["dimensions"]).cast("int").alias("dimensions"), "embedding", F.col("target_hash").alias("input_hash"), F.lit(name).alias("provider"), F.lit(model).alias("model")]
        errors, stopped = Counter(), False
        tasks = max(1, min(spark.sparkContext.defaultParallelism, -(-part_inputs // batch)))
        for k in range(parts):
            some = wanted.where(F.col("part") == k).drop("part")
            made = embed_inputs(some.repartition(tasks), provider, target["dimensions"], batch).join(some.drop("input"), "chunk_id")
            # Vectors and errors go out in one write: a second pass would ask the provider again.
            table = f"{PART}{own.since.number + 1 if own.since else 1:012d}"
            own.publish({table: made.select("chunk_id", "text_hash", *shape, "error", "fatal")}, None, {"checkpoint": target})
            for r in own.read(table).where("error is not null").groupBy("error").agg(F.count(F.lit(1)).alias("n"), F.max("fatal").alias("fatal")).collect():
                errors[r.error] += r.n
                stopped |= r.fatal
            if stopped:
                break
        result = row | {"errors": dict(errors), "published": False}
        if not stopped and row["total"] and (row["to_generate"] or row["requires_publication"]):
            reused = canonical.select(*RECORD).join(origins.where("origin = 'canonical'").select("chunk_id"), "chunk_id", "left_semi")
            current = keyed.join(origins.where("origin <> 'canonical'").select("chunk_id"), "chunk_id", "left_semi").select("chunk_id", "text_hash", F.col("target_hash").alias("input_hash"))
            fresh = read_checkpoint(own).join(current, ["chunk_id", "text_hash", "input_hash"], "left_semi")
            publish.publish_records(own, reused.unionByName(fresh.select(*RECORD)), keyed, target, {"checkpoint": None}, checkpoint_parts(own))
            result["published"] = True
        return result


def update_entry(entries: DataFrame, path: str, vector: list[float], model: str) -> DataFrame:
    """entries (path, vector, model, …) with the vector and model of one path."""
    own = F.col("path") == path
    return entries.withColumn("vector", F.when(own, F.array(*map(F.lit, vector))).otherwise(F.col("vector"))).withColumn("model", F.when(own, F.lit(model)).otherwise(F.col("model")))


def analyse_notes(notes: DataFrame, analyse: Callable[[str], str], most_chars: int) -> DataFrame:
    """(path, result, error) of every note (path, text): what an analysis says of its first characters, or why it failed; one note's failure leaves the others alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole)):
            results, errors = [], []
            for text in batch.column(1).to_pylist():
                try:
                    results.append(analyse((text or "")[:most_chars]))
                    errors.append(None)
                except Exception as e:  # a plug-in's own failure is a row's
                    results.append(None)
                    errors.append(str(e)[:300])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(results, pa.string()), pa.array(errors, pa.string())], names=["path", "result", "error"])

    return notes.select("path", "text").mapInArrow(lean(run), "path string, result string, error string")
