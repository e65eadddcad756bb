"""Index files as lines: lenient, strict and checking readers of notes, chunks, vector records, manifests and checkpoints.

Lines are rows (file, ord, line), so that any number of files is read in one pass; what a reader says
of a file as a whole is an aggregate of its lines. A file's lines are never gathered.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from inkwell.operators.vectors import valid_vector

# Fixed limits of the formats.
MOST_CHUNKS, MOST_CHUNK_BYTES = 100_000, 50 << 20
JSONL_LIMITS = {"desktop": (96 << 20, 192 << 20, 32 << 20), "mobile": (24 << 20, 64 << 20, 16 << 20)}
CHECKPOINT_VERSION = 1

RECORD = "chunkId string, path string, index bigint, textHash string, model string, provider string, dimensions bigint, createdAt string, embeddingInputHash string, embedding array<double>"
CHUNK = "chunkId string, path string, chunkIndex bigint, text string, textHash string, createdAt string"
NOTE = "path string, basename string, extension string, size bigint, mtime bigint, contentHash string, indexedAt string"
METADATA = "schemaVersion bigint, operationId string, createdAt string, updatedAt string, provider string, model string, dimension bigint, inputFormatVersion string, completedRecords bigint"
MANIFEST = "embeddingsEnabled boolean, embeddings struct<provider:string,model:string,dimensions:bigint,updatedAt:string,publicationId:string,totalEmbeddings:bigint>, embeddingInput struct<version:bigint,prefixMode:string>"
PREFIX_MODES = ("none", "nomic-search-query-document")


def lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, ord, line) of text files; ord follows the order of lines within a file."""
    return spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("ord"), F.col("value").alias("line"))


def blank(line: Column) -> Column:
    return F.trim(F.regexp_replace(line, r"[\r\n\t]", " ")) == ""


def is_json(line: Column) -> Column:
    return F.try_parse_json(line).isNotNull()


def filled(value: Column) -> Column:
    return F.coalesce(F.trim(value) != "", F.lit(False))


def parsed(rows: DataFrame, schema: str = RECORD) -> DataFrame:
    """Lines that aren't blank, with good (it is JSON) and r, the record."""
    kept = rows.where(~blank(F.col("line"))).withColumn("good", is_json(F.col("line")))
    return kept.withColumn("r", F.when(F.col("good"), F.from_json("line", schema)))


# ---- readers of vector records -----------------------------------------------------------------


def lenient_records(rows: DataFrame) -> DataFrame:
    """(file, ord, record's fields): lines that don't parse are skipped."""
    return parsed(rows).where("good").select("file", "ord", "r.*")


def last_records(rows: DataFrame) -> DataFrame:
    """The last record of each chunkId of a file; records without one are left out."""
    found = lenient_records(rows).where(F.coalesce(F.col("chunkId"), F.lit("")) != "")
    value = F.struct(*(c for c in found.columns if c not in ("file", "chunkId")))
    return found.groupBy("file", "chunkId").agg(F.max_by(value, "ord").alias("r")).select("file", "chunkId", "r.*")


def canonical_records(rows: DataFrame) -> DataFrame:
    """(file, ord, named, record's fields) of every line that isn't blank: one that doesn't parse, or names no chunk, is an invalid record and not a skipped one."""
    named = F.coalesce(F.col("r.chunkId") != "", F.lit(False))
    return parsed(rows).select("file", "ord", named.alias("named"), "r.*")


def readability(files: DataFrame, rows: DataFrame) -> DataFrame:
    """(file, readability, records) of files (file, exists, readable): missing, unreadable, empty or readable."""
    counts = rows.where(~blank(F.col("line"))).groupBy("file").agg(F.count(F.lit(1)).alias("records"))
    state = F.when(~F.col("exists"), "missing").when(~F.col("readable"), "unreadable").when(F.col("records") == 0, "empty").otherwise("readable")
    return files.join(counts, "file", "left").withColumn("records", F.coalesce("records", F.lit(0))).select("file", state.alias("readability"), F.when(state == "readable", F.col("records")).otherwise(0).alias("records"))


def strict_records(rows: DataFrame) -> DataFrame:
    """lenient_records of the files whose every line parses."""
    bad = parsed(rows).where("not good").select("file").distinct()
    return lenient_records(rows.join(bad, "file", "left_anti"))


def record_shape(r: str = "r") -> Column:
    """A record has all its fields, of their types, and as many numbers as it says."""
    c = lambda name: F.col(f"{r}.{name}")
    texts = reduce(lambda a, b: a & b, (c(n).isNotNull() for n in ("chunkId", "path", "index", "textHash", "model", "provider", "createdAt")))
    return F.coalesce(texts & (c("dimensions") > 0) & valid_vector(c("embedding")) & (c("dimensions") == F.size(c("embedding"))), F.lit(False))


def checked_records(files: DataFrame, rows: DataFrame, newline_needed: bool = True) -> DataFrame:
    """(file, valid, reason, records): the first thing wrong with each of files (file, count, dimensions, ends_with_newline).

    count and dimensions may be null for any. The first line at fault gives the reason: an empty line,
    no JSON, no record, other dimensions, a chunk that an earlier line has; then the count of records.
    """
    r = parsed(rows.where(~blank(F.col("line")))).unionByName(rows.where(blank(F.col("line"))).withColumn("good", F.lit(True)), allowMissingColumns=True)
    seen = F.row_number().over(Window.partitionBy("file", "r.chunkId").orderBy("ord"))
    r = r.join(files.select("file", "dimensions"), "file").withColumn("nth", seen)
    fault = (
        F.when(blank(F.col("line")), "empty-line")
        .when(~F.col("good"), "invalid-json-line")
        .when(~record_shape(), "invalid-record")
        .when(F.col("r.dimensions") != F.col("dimensions"), "dimension-mismatch")
        .when(F.col("nth") > 1, "duplicate-chunk-id")
    )
    per = r.withColumn("fault", fault).groupBy("file").agg(F.expr("min_by(fault, ord) FILTER (WHERE fault IS NOT NULL)").alias("fault"), F.count(F.lit(1)).alias("records"))
    both = files.join(per, "file", "left").withColumn("records", F.coalesce("records", F.lit(0)))
    wrong = (
        F.when((F.col("records") == 0) & ~F.coalesce(F.col("count") == 0, F.lit(False)), "empty-content")
        .when((F.col("records") > 0) & F.lit(newline_needed) & ~F.col("ends_with_newline"), "truncated-last-line")
        .when(F.col("fault").isNotNull(), F.col("fault"))
        .when(F.col("count") != F.col("records"), "record-count-mismatch")
    )
    return both.select("file", wrong.isNull().alias("valid"), wrong.alias("reason"), F.when(wrong.isNull(), F.col("records")).otherwise(0).alias("records"))


# ---- identities, checkpoints and publications ----------------------------------------------------


def published_identity(manifest: Column) -> Column:
    """What a manifest says of its vectors: provider, model, dimensions, input_version, prefix_mode, updated_at; nulls where it doesn't say."""
    m = F.from_json(manifest, MANIFEST)
    on = is_json(manifest) & F.coalesce(m["embeddingsEnabled"], F.lit(False)) & m["embeddings"].isNotNull()
    e, i = m["embeddings"], m["embeddingInput"]
    mode = F.when(i["prefixMode"].isin(*PREFIX_MODES), i["prefixMode"])
    said = lambda c: F.when(on, c)
    return F.struct(said(e["provider"]).alias("provider"), said(e["model"]).alias("model"), said(e["dimensions"]).alias("dimensions"), said(i["version"]).alias("input_version"), said(mode).alias("prefix_mode"), F.coalesce(said(e["updatedAt"]), F.lit("")).alias("updated_at"))


def runtime_identity(manifest: Column) -> Column:
    """The same for a source to be searched: null unless everything is there, with input version 1; with the publication id."""
    m, own = F.from_json(manifest, MANIFEST), published_identity(manifest)
    whole = own["provider"].isNotNull() & own["model"].isNotNull() & (own["dimensions"] > 0) & m["embeddings"]["updatedAt"].isNotNull() & (own["input_version"] == 1) & own["prefix_mode"].isNotNull()
    return F.when(whole, F.struct(*(own[n].alias(n) for n in ("provider", "model", "dimensions", "input_version", "prefix_mode", "updated_at")), m["embeddings"]["publicationId"].alias("publication_id")))


def identity_complete(identity: Column) -> Column:
    return F.coalesce(filled(identity["provider"]) & filled(identity["model"]) & (identity["dimensions"] > 0) & (identity["input_version"] > 0) & filled(identity["prefix_mode"]), F.lit(False))


def checked_checkpoints(checkpoints: DataFrame, rows: DataFrame, identity: dict) -> DataFrame:
    """(file, valid, reason, records) of checkpoints (file, metadata, ends_with_newline; metadata null if its file is missing).

    identity: provider, model, input_format and maybe dimensions that a checkpoint must have.
    """
    m = F.from_json("metadata", METADATA)
    c = checkpoints.withColumn("m", m)
    shape = reduce(lambda a, b: a & b, (F.col(f"m.{n}").isNotNull() for n in ("operationId", "createdAt", "updatedAt", "provider", "model", "inputFormatVersion")))
    shape = F.coalesce(shape & (F.col("m.schemaVersion") == CHECKPOINT_VERSION) & (F.col("m.dimension") > 0) & (F.col("m.completedRecords") >= 0), F.lit(False))
    other = (F.col("m.provider") != identity["provider"]) | (F.col("m.model") != identity["model"]) | (F.col("m.inputFormatVersion") != identity["input_format"])
    if identity.get("dimensions"):
        other = other | (F.col("m.dimension") != identity["dimensions"])
    checked = checked_records(c.select("file", F.col("m.completedRecords").alias("count"), F.col("m.dimension").alias("dimensions"), "ends_with_newline"), rows)
    strange = lenient_records(rows).join(c.select("file", F.col("m.provider").alias("p"), F.col("m.model").alias("o")), "file").where("provider <> p or model <> o").select("file").distinct().withColumn("strange", F.lit(True))
    both = c.join(checked.withColumnRenamed("reason", "content"), "file").join(strange, "file", "left")
    wrong = (
        F.when(F.col("metadata").isNull(), "checkpoint-pair-incomplete")
        .when(~is_json(F.col("metadata")), "invalid-checkpoint-metadata-json")
        .when(~shape, "invalid-checkpoint-metadata")
        .when(other, "incompatible-checkpoint")
        .when(F.col("content").isNotNull(), F.col("content"))
        .when(F.coalesce("strange", F.lit(False)), "checkpoint-record-identity-mismatch")
    )
    return both.select("file", wrong.isNull().alias("valid"), wrong.alias("reason"), F.when(wrong.isNull(), F.col("records")).otherwise(0).alias("records"))


def checked_publications(publications: DataFrame, rows: DataFrame) -> DataFrame:
    """(file, valid, reason) of published pairs (file, manifest; null if one of the two is missing)."""
    p = publications.withColumn("m", F.from_json("manifest", MANIFEST))
    e = F.col("m.embeddings")
    files = p.select("file", e["totalEmbeddings"].alias("count"), e["dimensions"].alias("dimensions"), F.lit(True).alias("ends_with_newline"))
    content = checked_records(files, rows, newline_needed=False).select("file", F.col("reason").alias("content"))
    strange = lenient_records(rows).join(p.select("file", e["provider"].alias("p"), e["model"].alias("o")), "file").where("provider <> p or model <> o").select("file").distinct().withColumn("strange", F.lit(True))
    both = p.join(content, "file").join(strange, "file", "left")
    wrong = (
        F.when(F.col("manifest").isNull(), "canonical-pair-incomplete")
        .when(~is_json(F.col("manifest")), "canonical-read-error")
        .when(~F.coalesce(F.col("m.embeddingsEnabled"), F.lit(False)), "manifest-embeddings-disabled")
        .when(e.isNull(), "manifest-embeddings-missing")
        .when(~F.coalesce((e["totalEmbeddings"] >= 0) & (e["dimensions"] > 0), F.lit(False)), "manifest-embeddings-invalid")
        .when(e["provider"].isNull() | e["model"].isNull(), "manifest-identity-invalid")
        .when(F.col("content").isNotNull(), F.col("content"))
        .when(F.coalesce("strange", F.lit(False)), "canonical-record-identity-mismatch")
    )
    return both.select("file", wrong.isNull().alias("valid"), wrong.alias("reason"))


# ---- sizes and sources -----------------------------------------------------------------------------


def line_sizes(rows: DataFrame) -> DataFrame:
    """(file, records, bytes): lines that aren't blank, and UTF-8 bytes with a newline after every line."""
    return rows.groupBy("file").agg(F.count_if(~blank(F.col("line"))).alias("records"), F.sum(F.octet_length("line") + 1).alias("bytes"))


def jsonl_peak(size: Column, records: Column, dimensions: Column, profile: str = "desktop") -> Column:
    """Estimated bytes at the peak of reading a file of records into packed vectors."""
    reserve, text = JSONL_LIMITS[profile][2], size * 2
    per_line = F.greatest(F.ceil(text / F.greatest(records, F.lit(1))), dimensions * 32 + 4096)
    return (text + F.least(text, per_line) + records * 384 + records * dimensions * 12 + reserve).cast("long")


def choose_source(sources: DataFrame, profile: str = "desktop") -> DataFrame:
    """sources (…, publication_id, binary, jsonl_bytes, records, dimensions, jsonl_good) with source, fallback and error.

    binary says how the derived copy was found: ok, outdated, missing, invalid, resource-limit,
    digest-unavailable or read-failed. It comes first if the publication has an id; else the lines are
    read, unless they are too large to be read safely or don't parse.
    """
    largest, peak, _ = JSONL_LIMITS[profile]
    times, margin, guard = {"desktop": (3, 32 << 20, 192 << 20), "mobile": (5, 8 << 20, 64 << 20)}[profile]
    unsafe = (F.col("jsonl_bytes") > largest) | (jsonl_peak(F.col("jsonl_bytes"), F.col("records"), F.col("dimensions"), profile) > peak)
    blocked = F.col("jsonl_bytes") * times + margin > guard
    identified = F.col("publication_id").isNotNull()
    direct = identified & (F.col("binary") == "ok")
    source = F.when(direct, "binary").when(unsafe | blocked, "not-loaded").when(~F.col("jsonl_good"), "not-loaded").otherwise("jsonl")
    why = F.when(~identified, "legacy-manifest").when(F.col("binary").isin("outdated", "missing", "invalid", "resource-limit", "read-failed"), F.concat(F.lit("binary-"), F.col("binary"))).otherwise(F.col("binary"))
    fallback = F.when(direct, "none").when(unsafe | blocked, "no-safe-source").when(~F.col("jsonl_good"), "jsonl-read-failed").otherwise(why)
    error = F.when(direct, F.lit(None)).when(unsafe, "jsonl-estimated-peak-limit-exceeded").when(blocked, f"{profile}-bridge-read-limit-exceeded").when(~F.col("jsonl_good"), "invalid-jsonl")
    return sources.select("*", source.alias("source"), fallback.alias("fallback"), error.alias("error"))


def searchable(records: DataFrame, states: DataFrame) -> DataFrame:
    """Records of chunks whose state (chunk_id, state) is valid."""
    return records.join(states.where("state = 'valid'").select("chunk_id"), "chunk_id", "left_semi")


def runtime_index(records: DataFrame, states: DataFrame, identity: dict) -> DataFrame:
    """(chunk_id, ord, embedding as floats) of the first record of each searchable chunk.

    No rows at all if one of these has another provider, model or number of dimensions than identity.
    """
    first = Window.partitionBy("chunk_id").orderBy("ord")
    kept = searchable(records, states).withColumn("_n", F.row_number().over(first)).where("_n = 1")
    fits = (F.col("provider") == identity["provider"]) & (F.col("model") == identity["model"]) & (F.col("dimensions") == identity["dimensions"]) & valid_vector(F.col("embedding")) & (F.size("embedding") == identity["dimensions"])
    kept = kept.withColumn("_fits", F.coalesce(fits, F.lit(False)))
    whole = kept.agg(F.coalesce(F.min("_fits"), F.lit(False)).alias("_whole"))
    return kept.crossJoin(F.broadcast(whole)).where("_whole").select("chunk_id", "ord", F.col("embedding").cast("array<float>").alias("embedding"))  # one row


def embedding_stats(entries: DataFrame) -> DataFrame:
    """One row: entries, and those with a vector."""
    return entries.agg(F.count(F.lit(1)).alias("total"), F.count_if(F.coalesce(F.size("embedding") > 0, F.lit(False))).alias("with_vector"))


# ---- notes and chunks ------------------------------------------------------------------------------


def notes_status(contents: DataFrame) -> DataFrame:
    """(file, status, reason, notes) of notes files (file, size, content): null sizes are missing files, null contents can't be read."""
    one = F.try_parse_json("content")
    shape = F.coalesce(F.schema_of_variant(one).startswith("ARRAY"), F.lit(False))
    reason = (
        F.when(F.col("size") == 0, "empty-file").when(F.col("content").isNull(), "read-error").when(blank(F.col("content")), "empty-content").when(one.isNull(), "invalid-json").when(~shape, "invalid-shape")
    )
    status = F.when(F.col("size").isNull(), "missing").when(reason.isNotNull(), "unavailable").otherwise("available")
    count = F.when(status == "available", F.coalesce(F.json_array_length("content"), F.lit(0))).otherwise(0)
    return contents.select("file", status.alias("status"), F.when(status == "unavailable", reason).alias("reason"), count.alias("notes"))


def chunks_status(files: DataFrame, rows: DataFrame, strict: bool, most: int = MOST_CHUNKS) -> DataFrame:
    """(file, status, reason, chunks) of chunk files (file, size; null if missing).

    Lenient readers skip lines that don't parse and stop at the limit; strict ones refuse both. The
    limit is the format's: what lies beyond is counted in neither case.
    """
    p = rows.where(~blank(F.col("line"))).withColumn("good", is_json(F.trim(F.regexp_replace("line", r"\r$", ""))))
    nth = F.count(F.when(F.col("good"), 1)).over(Window.partitionBy("file").orderBy("ord"))
    p = p.withColumn("nth", nth)  # a file has at most MOST_CHUNK_BYTES
    per = p.groupBy("file").agg(F.least(F.count_if("good"), F.lit(most)).alias("chunks"), F.count_if(~F.col("good") & (F.col("nth") < most)).alias("bad"), (F.count_if((F.col("nth") > most) | ((F.col("nth") == most) & ~F.col("good"))) > 0).alias("more"))
    both = files.join(per, "file", "left").withColumn("chunks", F.coalesce("chunks", F.lit(0)))
    bad, more = F.coalesce(F.col("bad") > 0, F.lit(False)), F.coalesce("more", F.lit(False))
    reason = F.when(F.col("size") > MOST_CHUNK_BYTES, "file-too-large").when(F.lit(strict) & bad, "invalid-json-lines").when(F.lit(strict) & more, "chunk-limit-reached")
    warning = F.when(bad, "invalid-json-lines").when(more, "chunk-limit-reached")
    status = F.when(F.col("size").isNull(), "missing").when(reason.isNotNull(), "unavailable").otherwise("available")
    return both.select("file", status.alias("status"), F.when(status == "unavailable", reason).alias("reason"), F.when(status == "available", warning).alias("warning"), F.when(status == "available", F.col("chunks")).otherwise(0).alias("chunks"))


def good_shapes(rows: DataFrame, schema: str) -> DataFrame:
    """(file, good): whether every record has all fields of a note or chunk, none null."""
    p = parsed(rows, schema)
    names = [part.split()[0] for part in schema.split(", ")]
    whole = reduce(lambda a, b: a & b, (F.col(f"r.{n}").isNotNull() for n in names))
    return p.groupBy("file").agg(F.min(F.col("good") & F.coalesce(whole, F.lit(False))).alias("good"))


def readiness(states: DataFrame) -> DataFrame:
    """states with ready and reason, for indexes that are to be updated: the first of everything that can be wrong.

    states: manifest (text or null), notes_status, notes_reason, chunks_status, chunks_reason (of the
    readers above), notes_good, chunks_good, notes, chunks (counts).
    """
    m = F.from_json("manifest", "indexType string, version double, totalNotes bigint, totalChunks bigint")
    shape = (m["indexType"] == "text") & m["version"].isNotNull()
    off = (m["totalNotes"].isNotNull() & (m["totalNotes"] != F.col("notes"))) | (m["totalChunks"].isNotNull() & (m["totalChunks"] != F.col("chunks")))
    of = lambda kind: F.concat(F.lit(f"{kind}-"), F.when(F.col(f"{kind}_status") == "missing", "missing").otherwise(F.col(f"{kind}_reason")))
    reason = (
        F.when(F.col("manifest").isNull(), "manifest-missing")
        .when(blank(F.col("manifest")), "manifest-empty")
        .when(~is_json(F.col("manifest")), "manifest-invalid-json")
        .when(~F.coalesce(shape, F.lit(False)), "manifest-invalid-shape")
        .when(F.col("notes_status") != "available", of("notes"))
        .when(F.col("chunks_status") != "available", of("chunks"))
        .when(~F.col("notes_good"), "notes-invalid-shape")
        .when(~F.col("chunks_good"), "chunks-invalid-shape")
        .when(off, "manifest-count-mismatch")
    )
    return states.withColumn("reason", reason).withColumn("ready", F.col("reason").isNull())


def usability(states: DataFrame) -> DataFrame:
    """states (as for readiness, and stale) with usability: missing, invalid, stale or ready."""
    r = readiness(states)
    return r.withColumn("usability", F.when(F.col("reason") == "manifest-missing", "missing").when(F.col("reason").isNotNull(), "invalid").when(F.col("stale"), "stale").otherwise("ready"))
