"""Vectors as little-endian float32 in one file, with a JSON-lines side file and a manifest: written, checked and read."""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.functions.text import in_order
from inkwell.sources import publish

META = "chunkId string, path string, index int, textHash string, embeddingInputHash string, vectorOrdinal long"
#: Files of a generation carry its name; manifests are numbered, and the one of the greatest number that names a whole set counts.
MANIFEST, METADATA, VECTORS = "embeddings.binary.{:012d}.json", "embeddings.{}.meta.jsonl", "embeddings.{}.vectors.f32"
FORMAT, VERSION = "embeddings-binary", 1


@dataclass(frozen=True)
class Limits:
    records: int
    dimensions: int
    vector_bytes: int
    metadata_bytes: int
    total_bytes: int
    peak_bytes: int
    reserve_bytes: int


# Fixed limits of the format: it is for resident indexes; larger ones are tables.
LIMITS = {
    "desktop": Limits(200_000, 4096, 64 << 20, 32 << 20, 96 << 20, 192 << 20, 32 << 20),
    "mobile": Limits(50_000, 3072, 16 << 20, 8 << 20, 24 << 20, 64 << 20, 16 << 20),
}


class BadSet(ValueError):
    """A set of files that can't be read safely; code says why."""

    def __init__(self, code: str) -> None:
        super().__init__(code)
        self.code = code


def peak(vector_bytes: Column, metadata_bytes: Column, records: Column, profile: str = "desktop") -> Column:
    """Estimated bytes at the peak of reading: both files, the vectors once more, records, the larger file's digest and a reserve."""
    return vector_bytes * 2 + metadata_bytes + F.greatest(metadata_bytes * 2, records * 384) + F.greatest(vector_bytes, metadata_bytes) + LIMITS[profile].reserve_bytes


def limit_code(records: Column, dimensions: Column, metadata_bytes: Column, profile: str = "desktop") -> Column:
    """Why a set of these sizes isn't read under a profile's limits, or null."""
    most = LIMITS[profile]
    vector_bytes = records * dimensions * 4
    return (
        F.when(records > most.records, "binary-record-limit-exceeded").when(dimensions > most.dimensions, "binary-dimension-limit-exceeded")
        .when((vector_bytes > most.vector_bytes) | (metadata_bytes > most.metadata_bytes) | (vector_bytes + metadata_bytes > most.total_bytes), "binary-resource-limit-exceeded")
        .when(peak(vector_bytes, metadata_bytes, records, profile) > most.peak_bytes, "binary-estimated-peak-limit-exceeded")
    )


def pack_vectors(vectors: list[list[float]]) -> bytes:
    """The file's content for a small set of vectors of one length."""
    return np.asarray(vectors, "<f4").tobytes()


def manifests(spark: SparkSession, folder: str) -> list[str]:
    """Names of a folder's manifests, the newest first."""
    start, end = MANIFEST.split("{:012d}")
    return [n for n in reversed(publish.names_in(spark, folder)) if n.startswith(start) and n.endswith(end) and n[len(start) : -len(end)].isdigit()]


def write_set(spark: SparkSession, folder: str, records: DataFrame, identity: dict, publication_id: str, profile: str = "desktop") -> str:
    """Write records (chunkId, path, index, textHash, embeddingInputHash, embedding) as a set; returns its generation.

    The format's limits are checked first, so what the driver holds, as Arrow buffers, is at most total_bytes. The files have
    names of their own and the manifest, with sizes and digests, goes last: until then, and if the writing stops before, the set
    before it is the one that is read. It is checked before older sets are swept.
    """
    size = records.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("chunkId").alias("ids"), F.count_if((F.size("embedding") != identity["dimensions"]) | F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))).alias("bad"), F.coalesce(F.sum(F.length("chunkId") * 4 + F.length("path") * 4 + 200), F.lit(0)).alias("meta")).first()
    code = spark.range(1).select(limit_code(F.lit(size.n), F.lit(identity["dimensions"]), F.lit(size.meta), profile)).first()[0]
    if code or size.bad or size.ids != size.n:
        raise BadSet(code or ("binary-vector-invalid" if size.bad else "binary-metadata-invalid"))
    rows = records.select("chunkId", "path", "index", "textHash", "embeddingInputHash", F.col("embedding").cast("array<float>").alias("embedding")).orderBy(*in_order(F.col("chunkId"))).toArrow()  # within the limits
    vectors = b"".join(np.asarray(part.flatten(), "<f4").tobytes() for part in rows.column("embedding").chunks)
    lines = [json.dumps({k: v for k, v in r.items() if v is not None} | {"vectorOrdinal": i}) for i, r in enumerate(rows.drop_columns(["embedding"]).to_pylist())]
    metadata = "".join(line + "\n" for line in lines).encode()
    generation = uuid.uuid4().hex
    files = {"metadataFile": METADATA.format(generation), "vectorsFile": VECTORS.format(generation)}
    digest = lambda data: "sha256:" + hashlib.sha256(data).hexdigest()
    manifest = {
        "format": FORMAT, "version": VERSION, "generationId": generation, "sourcePublicationId": publication_id, "byteOrder": "little-endian", "numericType": "float32",
        "provider": identity["provider"], "model": identity["model"], "dimensions": identity["dimensions"], "inputFormatVersion": str(identity.get("input_version", 1)), "prefixMode": identity.get("prefix_mode", "none"),
        "recordCount": len(lines), **files, "metadataByteLength": len(metadata), "vectorsByteLength": len(vectors), "metadataDigest": digest(metadata), "vectorsDigest": digest(vectors),
    }
    publish.write_file(spark, f"{folder}/{files['vectorsFile']}", vectors)
    publish.write_file(spark, f"{folder}/{files['metadataFile']}", metadata)
    newest = next(iter(manifests(spark, folder)), None)
    number = 1 if newest is None else int(newest.split(".")[-2]) + 1
    publish.write_file(spark, f"{folder}/{MANIFEST.format(number)}", json.dumps(manifest).encode())
    check_set(spark, folder, MANIFEST.format(number), profile)
    sweep_sets(spark, folder, MANIFEST.format(number))
    return generation


def read_manifest(spark: SparkSession, folder: str, name: str | None = None) -> dict:
    """A manifest, the newest unless one is named; BadSet if there is none, if it isn't of this format or if a file that it names is missing."""
    there = publish.names_in(spark, folder)
    name = name or next(iter(manifests(spark, folder)), None)
    if name is None:
        raise BadSet("binary-manifest-missing")
    try:
        m = json.loads(publish.read_file(spark, f"{folder}/{name}"))
    except ValueError:
        raise BadSet("binary-manifest-invalid") from None
    if not isinstance(m, dict) or m.get("format") != FORMAT or m.get("version") != VERSION:
        raise BadSet("binary-unsupported-version" if isinstance(m, dict) and "version" in m else "binary-manifest-invalid")
    texts = ("generationId", "sourcePublicationId", "provider", "model", "metadataFile", "vectorsFile", "metadataDigest", "vectorsDigest")
    counts = ("dimensions", "recordCount", "metadataByteLength", "vectorsByteLength")
    if not all(isinstance(m.get(k), str) and m[k] for k in texts) or not all(isinstance(m.get(k), int) and m[k] >= 0 for k in counts) or not m["dimensions"]:
        raise BadSet("binary-manifest-invalid")
    for kind in ("metadata", "vectors"):
        if m[f"{kind}File"] not in there:
            raise BadSet(f"binary-{kind}-missing")
    return m


def check_set(spark: SparkSession, folder: str, name: str | None = None, profile: str = "desktop") -> dict:
    """The manifest of a set that passes all checks of limits, sizes, digests and metadata; BadSet says what is wrong."""
    m = read_manifest(spark, folder, name)
    code = spark.range(1).select(limit_code(F.lit(m["recordCount"]), F.lit(m["dimensions"]), F.lit(m["metadataByteLength"]), profile)).first()[0]
    if code:
        raise BadSet(code)
    parts = spark.read.format("binaryFile").load([f"{folder}/{m['metadataFile']}", f"{folder}/{m['vectorsFile']}"]).select(F.col("path").endswith(m["vectorsFile"]).alias("vectors"), "length", F.concat(F.lit("sha256:"), F.sha2("content", 256)).alias("digest")).collect()
    for part in parts:
        kind = "vectors" if part.vectors else "metadata"
        if part.length != m[f"{kind}ByteLength"] or part.vectors and part.length != m["recordCount"] * m["dimensions"] * 4:
            raise BadSet("binary-size-mismatch")
        if part.digest != m[f"{kind}Digest"]:
            raise BadSet("binary-digest-mismatch")
    meta = spark.read.schema(META + ", _bad string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad").json(f"{folder}/{m['metadataFile']}")
    ordinal = F.col("vectorOrdinal")
    bad = F.col("_bad").isNotNull() | F.col("chunkId").isNull() | F.col("path").isNull() | F.col("textHash").isNull() | ~F.coalesce((F.col("index") >= 0) & (ordinal >= 0) & (ordinal < m["recordCount"]), F.lit(False))
    seen = meta.select("*").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("chunkId").alias("ids"), F.count_distinct("vectorOrdinal").alias("ordinals"), F.count_if(bad).alias("bad")).first()
    if seen.bad or not seen.n == seen.ids == seen.ordinals == m["recordCount"]:
        raise BadSet("binary-metadata-invalid")
    return m


def sweep_sets(spark: SparkSession, folder: str, keep: str) -> None:
    """Remove all manifests but one, and then all files of sets that it doesn't name."""
    m = read_manifest(spark, folder, keep)
    for name in manifests(spark, folder):
        if name != keep:
            publish.remove(spark, f"{folder}/{name}")
    ends = (METADATA.split("{}")[1], VECTORS.split("{}")[1])
    for name in publish.names_in(spark, folder):
        if name.endswith(ends) and name not in (m["metadataFile"], m["vectorsFile"]):
            publish.remove(spark, f"{folder}/{name}")


def recover_set(spark: SparkSession, folder: str, profile: str = "desktop") -> str | None:
    """After a crash: the generation of the newest set that passes all checks, which alone is left in the folder; None if there is none, and then nothing is removed."""
    for name in manifests(spark, folder):
        try:
            m = check_set(spark, folder, name, profile)
        except BadSet:
            continue
        sweep_sets(spark, folder, name)
        return m["generationId"]
    return None


def read_set(spark: SparkSession, folder: str, profile: str = "desktop") -> DataFrame:
    """The newest set's records with their vectors, after all checks; BadSet says what is wrong."""
    m = check_set(spark, folder, None, profile)
    return read_vectors(spark, f"{folder}/{m['metadataFile']}", f"{folder}/{m['vectorsFile']}", m["dimensions"])


def copied_publication(spark: SparkSession, folder: str) -> str | None:
    """The publication that a set stands for; None if there is none that can be read."""
    try:
        return read_manifest(spark, folder)["sourcePublicationId"]
    except BadSet:
        return None


def read_vectors(spark: SparkSession, meta_path: str, vectors_path: str, dimensions: int, sha256: str | None = None) -> DataFrame:
    """Records with their vectors, joined by ordinal; a wrong digest or length, or a number that isn't finite, fails the read.

    The file is one binary value, as its format has it, so its size is bounded by the format's limits;
    the task that holds it hands the vectors out in batches.
    """
    raw = spark.read.format("binaryFile").load(vectors_path).select("content", F.sha2("content", 256).alias("digest"))

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content, digest in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if sha256 is not None and digest != sha256:
                    raise ValueError("the vectors' digest differs")
                if len(content) % (4 * dimensions):
                    raise ValueError("the vectors' size is no multiple of a vector's")
                rows = np.frombuffer(content, "<f4").reshape(-1, dimensions)
                for k in range(0, len(rows), 1024):
                    some = rows[k : k + 1024]
                    if not np.isfinite(some).all():
                        raise ValueError("binary-vector-invalid")
                    yield pa.RecordBatch.from_arrays([pa.array(np.arange(k, k + len(some)), pa.int64()), pa.array(list(some), pa.list_(pa.float32()))], names=["vectorOrdinal", "embedding"])

    meta = spark.read.schema(META).option("mode", "FAILFAST").json(meta_path)
    return meta.join(raw.mapInArrow(split, "vectorOrdinal long, embedding array<float>"), "vectorOrdinal")
