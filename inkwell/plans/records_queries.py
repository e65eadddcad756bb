"""Queries on index files as lines, made from rows of the tables, with DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from inkwell.operators.maintenance import is_stale
from inkwell.plans import maintenance_queries as Q
from inkwell.plans.search_queries import CHUNKS, NOTES, chunks
from inkwell.sources import records as R
from inkwell.sources.notes import notes, table

IDENTITY = {"provider": "ollama", "model": "nomic-embed-text", "dimensions": 64}
FORMAT = "1:nomic-search-query-document"


def vector_lines(s, d):
    """Seven files of vector records, each but the first with a fault at some line."""
    v = F.col("vec_id")
    f, k = v % 7, F.floor(v / 7)
    at = lambda file, line: (f == file) & (k == line)
    named = F.when(at(5, 6), F.concat(F.lit("c"), (v - 35).cast("string"))).when(at(6, 4), "").otherwise(F.concat(F.lit("c"), v.cast("string")))
    record = F.struct(
        named.alias("chunkId"), F.concat(F.lit("n/"), v.cast("string"), F.lit(".md")).alias("path"), k.alias("index"), F.when(~at(3, 2), "h").alias("textHash"), F.lit("nomic-embed-text").alias("model"),
        F.when(at(0, 8), "mistral").otherwise("ollama").alias("provider"), F.lit(64).alias("dimensions"), F.lit("2024-01-01").alias("createdAt"), F.col("embedding"),
    )
    line = F.to_json(record)
    line = F.when(at(1, 3), "  ").when(at(2, 5), F.substring(line, 1, 60)).otherwise(line)
    return table(s, d, "embeddings").select(F.concat(F.lit("f"), f.cast("string")).alias("file"), v.alias("ord"), line.alias("line"))


def files(s, d):
    n = table(s, d, "embeddings").groupBy((F.col("vec_id") % 7).alias("f")).agg(F.count(F.lit(1)).alias("n"))
    f = F.col("f")
    return n.select(F.concat(F.lit("f"), f.cast("string")).alias("file"), (F.col("n") + (f == 6).cast("long")).alias("count"), F.when(f == 4, 65).otherwise(64).alias("dimensions"), F.lit(True).alias("ends_with_newline"))


def records_checked(s, d):
    return R.checked_records(files(s, d), vector_lines(s, d))


def manifests(s, d):
    k = F.col("c_custkey") % 8
    text = lambda version, mode, extra="": f'{{"embeddingsEnabled": true, "embeddings": {{"provider": "ollama", "model": "m", "dimensions": 64, "updatedAt": "t", "totalEmbeddings": 5{extra}}}, "embeddingInput": {{"version": {version}, "prefixMode": "{mode}"}}}}'
    manifest = (
        F.when(k == 0, text(1, "none", ', "publicationId": "p"')).when(k == 1, text(2, "none")).when(k == 2, text(1, "odd")).when(k == 3, '{"embeddingsEnabled": false, "embeddings": {"provider": "x"}}')
        .when(k == 4, '{"embeddingsEnabled": true}').when(k == 5, '{"embeddingsEnabled": true, "embeddings": {"model": "m"}}').when(k == 6, "{oops").otherwise(text(1, "nomic-search-query-document"))
    )
    return table(s, d, "customer").select("c_custkey", manifest.alias("manifest"))


def published_identities(s, d):
    m = manifests(s, d).withColumn("i", R.published_identity(F.col("manifest"))).withColumn("run", R.runtime_identity(F.col("manifest")))
    return m.select("c_custkey", "i.provider", "i.model", "i.dimensions", "i.input_version", "i.prefix_mode", "i.updated_at", R.identity_complete(F.col("i")).alias("complete"), F.col("run").isNotNull().alias("searchable"), F.col("run.publication_id").alias("publication_id"))


def checkpoints_checked(s, d):
    n = F.col("count")
    f = F.col("file")
    of = lambda provider, dimension, count: F.concat(F.lit(f'{{"schemaVersion": 1, "operationId": "o", "createdAt": "t", "updatedAt": "t", "provider": "{provider}", "model": "nomic-embed-text", "dimension": {dimension}, "inputFormatVersion": "{FORMAT}", "completedRecords": '), count.cast("string"), F.lit("}"))
    meta = F.when(f == "f1", F.lit(None)).when(f == "f2", "{").when(f == "f3", '{"schemaVersion": 2}').when(f == "f4", of("mistral", 64, n)).when(f == "f5", of("ollama", 64, n)).when(f == "f6", of("ollama", 64, n - 1)).otherwise(of("ollama", 64, n))
    return R.checked_checkpoints(files(s, d).select("file", meta.alias("metadata"), "ends_with_newline"), vector_lines(s, d), {"provider": "ollama", "model": "nomic-embed-text", "input_format": FORMAT, "dimensions": 64})


def publications_checked(s, d):
    f, n = F.col("file"), F.col("count").cast("string")
    of = lambda model, dims, count: F.concat(F.lit(f'{{"embeddingsEnabled": true, "embeddings": {{"provider": "ollama", "model": "{model}", "dimensions": {dims}, "updatedAt": "t", "totalEmbeddings": '), count, F.lit("}}"))
    text = F.when(f == "f1", F.lit(None)).when(f == "f2", '{"embeddingsEnabled": false}').when(f == "f3", '{"embeddingsEnabled": true}').when(f == "f4", of("nomic-embed-text", 0, n)).when(f == "f5", of("nomic-embed-text", 64, n)).when(f == "f6", of("nomic-embed-text", 64, n)).otherwise(of("nomic-embed-text", 64, n))
    return R.checked_publications(files(s, d).select("file", text.alias("manifest")), vector_lines(s, d))


def document_lines(s, d):
    return notes(s, d).select(F.col("path").alias("file"), F.posexplode(F.split("text", "\n")).alias("ord", "line"))


def source_choice(s, d):
    k = F.col("o_orderkey")
    binary = F.element_at(F.array(*map(F.lit, ("ok", "outdated", "missing", "invalid", "resource-limit", "digest-unavailable", "read-failed"))), (k % 7 + 1).cast("int"))
    rows = table(s, d, "orders").select("o_orderkey", F.when(k % 3 > 0, k.cast("string")).alias("publication_id"), binary.alias("binary"), (k * 1009).alias("jsonl_bytes"), (k % 3000).alias("records"), F.lit(768).alias("dimensions"), (k % 11 > 0).alias("jsonl_good"))
    return R.choose_source(rows).select("o_orderkey", "source", "fallback", "error")


def vector_states(s, d):
    return Q.states(s, d).select("chunk_id", "state")


def vector_records(s, d):
    return Q.records(s, d).withColumn("ord", F.col("vec_id"))


def notes_files(s, d):
    k = F.col("doc_id") % 7
    note = '{"path": "a.md"}'
    text = F.when(k == 0, F.lit(None)).when(k == 1, "").when(k == 2, " \n ").when(k == 3, "[{").when(k == 4, "{}").when(k == 5, "[]").otherwise(F.concat(F.lit(f"[{note}"), F.repeat(F.lit(f", {note}"), (F.col("doc_id") % 5).cast("int")), F.lit("]")))
    files = notes(s, d).select(F.col("path").alias("file"), F.when((k == 0) & (F.col("doc_id") % 2 == 0), F.lit(None)).when(k == 0, 9).otherwise(F.length(text)).alias("size"), text.alias("content"))
    return R.notes_status(files)


def chunk_lines(s, d):
    """A file for each note, a line for each chunk; some lines are broken or blank."""
    c = chunks(s, d)
    k = F.col("chunk_index")
    line = F.to_json(F.struct(F.col("chunk_id").alias("chunkId"), "path", k.alias("chunkIndex"), F.lit("t").alias("text"), F.lit("h").alias("textHash"), F.when(F.col("doc_id") % 6 > 0, "now").alias("createdAt")))
    line = F.when((F.col("doc_id") % 4 == 1) & (k == 1), "{bad").when(k == 2, " \r").otherwise(F.concat(line, F.lit("\r")))
    return c.select(F.col("path").alias("file"), k.alias("ord"), line.alias("line"))


def chunk_files(s, d):
    k = F.col("doc_id")
    of = notes(s, d).select(F.col("path").alias("file"), F.when(k % 9 == 0, F.lit(None)).when(k % 9 == 1, 60 << 20).otherwise(100).alias("size"))
    rows = chunk_lines(s, d)
    lenient, strict = (R.chunks_status(of, rows, strict, 4) for strict in (False, True))
    return lenient.select("file", "status", "warning", "chunks").join(strict.select("file", F.col("reason").alias("strict_reason")), "file")


def index_readiness(s, d):
    k = F.col("c_custkey")
    manifest = F.when(k % 11 == 0, F.lit(None)).when(k % 11 == 1, " ").when(k % 11 == 2, "{").when(k % 11 == 3, '{"indexType": "vector", "version": 1}').otherwise(F.concat(F.lit('{"indexType": "text", "version": 1, "totalNotes": '), (k % 7).cast("string"), F.lit("}")))
    rows = table(s, d, "customer").select(
        "c_custkey", manifest.alias("manifest"), F.when(k % 13 == 0, "missing").when(k % 13 == 1, "unavailable").otherwise("available").alias("notes_status"), F.when(k % 13 == 1, "invalid-json").alias("notes_reason"),
        F.when(k % 17 == 0, "missing").when(k % 17 == 1, "unavailable").otherwise("available").alias("chunks_status"), F.when(k % 17 == 1, "chunk-limit-reached").alias("chunks_reason"),
        (k % 19 > 0).alias("notes_good"), (k % 23 > 0).alias("chunks_good"), F.lit(3).cast("long").alias("notes"), k.alias("chunks"),
    )
    return R.readiness(rows).select("c_custkey", "ready", "reason")


def index_status(s, d):
    """Four manifests over the stored notes and chunks: their own, one of another count, one of no text index, and their own after a note changed."""
    n, c = notes(s, d), chunks(s, d)
    counts = n.agg(F.count(F.lit(1)).alias("notes")).crossJoin(c.agg(F.count(F.lit(1)).alias("chunks")))  # one row each
    shapes = R.good_shapes(n.select(F.lit("n").alias("file"), F.col("doc_id").alias("ord"), F.to_json(F.struct("path", "basename", "extension", "size", "mtime", F.lit("h").alias("contentHash"), F.lit("t").alias("indexedAt"))).alias("line")), R.NOTE).select(F.col("good").alias("notes_good"))
    changed = n.select("path", "size", F.when(F.col("doc_id") % 100 == 7, F.col("mtime") + 1).otherwise(F.col("mtime")).alias("mtime"))
    stale = is_stale(changed, n.select("path", "size", "mtime")).select("stale")
    cases = s.range(4).select(F.col("id").alias("case"))
    rows = cases.crossJoin(counts).crossJoin(shapes).crossJoin(stale)  # four rows, and one each
    manifest = F.concat(F.lit('{"indexType": "'), F.when(F.col("case") == 2, "other").otherwise("text"), F.lit('", "version": 1, "totalNotes": '), (F.col("notes") + (F.col("case") == 1).cast("long")).cast("string"), F.lit(', "totalChunks": '), F.col("chunks").cast("string"), F.lit("}"))
    one = F.lit("available")
    rows = rows.select("case", "notes", "chunks", "notes_good", F.lit(True).alias("chunks_good"), manifest.alias("manifest"), one.alias("notes_status"), F.lit(None).cast("string").alias("notes_reason"), one.alias("chunks_status"), F.lit(None).cast("string").alias("chunks_reason"), (F.col("stale") & (F.col("case") == 3)).alias("stale"))
    return R.usability(rows).select("case", "notes", "chunks", "usability", "reason")


QUERIES = {
    "records_lenient": lambda s, d: R.lenient_records(vector_lines(s, d)).select("file", "ord", "chunkId", "dimensions", F.size("embedding").alias("length")),
    "records_last": lambda s, d: R.last_records(vector_lines(s, d)).select("file", "chunkId", "ord"),
    "records_canonical": lambda s, d: R.canonical_records(vector_lines(s, d)).select("file", "ord", "named"),
    "records_readability": lambda s, d: R.readability(files(s, d).unionByName(files(s, d).limit(0), allowMissingColumns=True).select("file", (F.col("file") != "f3").alias("exists"), (F.col("file") != "f4").alias("readable")), vector_lines(s, d)),
    "records_strict": lambda s, d: R.strict_records(vector_lines(s, d)).groupBy("file").agg(F.count(F.lit(1)).alias("records")),
    "records_checked": records_checked, "published_identities": published_identities, "checkpoints_checked": checkpoints_checked, "publications_checked": publications_checked,
    "line_sizes": lambda s, d: R.line_sizes(document_lines(s, d)), "source_choice": source_choice,
    "searchable_records": lambda s, d: R.searchable(vector_records(s, d), vector_states(s, d)).select("vec_id", "chunk_id"),
    "runtime_index": lambda s, d: R.runtime_index(vector_records(s, d), vector_states(s, d), IDENTITY).select("chunk_id", "ord", F.size("embedding").alias("length")),
    "embedding_stats": lambda s, d: R.embedding_stats(vector_records(s, d)),
    "notes_files": notes_files, "chunk_files": chunk_files,
    "chunk_shapes": lambda s, d: R.good_shapes(chunk_lines(s, d), R.CHUNK),
    "index_readiness": index_readiness, "index_status": index_status,
}

V = "v AS (SELECT vec_id AS ord, 'f' || vec_id % 7 AS file, vec_id % 7 AS f, vec_id // 7 AS k, CASE WHEN vec_id % 7 = 5 AND vec_id // 7 = 6 THEN 'c' || (vec_id - 35) WHEN vec_id % 7 = 6 AND vec_id // 7 = 4 THEN '' ELSE 'c' || vec_id END AS chunkId FROM embeddings)"
GOOD = "NOT (f = 1 AND k = 3) AND NOT (f = 2 AND k = 5)"
PATHED = "SELECT doc_id, source || '/' || lang || '/doc-' || lpad(doc_id::VARCHAR, 8, '0') || '.md' AS file FROM documents"
CL = """cl AS (SELECT doc_id, path AS file, chunk_index AS k, doc_id % 4 = 1 AND chunk_index = 1 AS bad, doc_id % 6 > 0 AS whole FROM chunks WHERE chunk_index <> 2),
nth AS (SELECT *, count(*) FILTER (NOT bad) OVER (PARTITION BY file ORDER BY k) AS n FROM cl),
per AS (SELECT file, least(count(*) FILTER (NOT bad), 4) AS chunks, count(*) FILTER (bad AND n < 4) > 0 AS bad, count(*) FILTER (n > 4 OR (n = 4 AND bad)) > 0 AS more FROM nth GROUP BY file)"""

ORACLES = {
    "records_lenient": f"WITH {V} SELECT file, ord, chunkId, 64 AS dimensions, 64 AS length FROM v WHERE {GOOD}",
    "records_last": f"WITH {V} SELECT file, chunkId, max(ord) AS ord FROM v WHERE {GOOD} AND chunkId <> '' GROUP BY 1, 2",
    "records_canonical": f"WITH {V} SELECT file, ord, chunkId <> '' AND NOT (f = 2 AND k = 5) AS named FROM v WHERE NOT (f = 1 AND k = 3)",
    "records_readability": f"WITH {V}, n AS (SELECT file, f, count(*) FILTER (NOT (f = 1 AND k = 3)) AS n FROM v GROUP BY 1, 2) SELECT file, CASE f WHEN 3 THEN 'missing' WHEN 4 THEN 'unreadable' ELSE 'readable' END AS readability, CASE WHEN f IN (3, 4) THEN 0 ELSE n END AS records FROM n",
    "records_strict": f"WITH {V} SELECT file, count(*) AS records FROM v WHERE f <> 2 AND {GOOD} GROUP BY 1",
    "records_checked": f"WITH {V} SELECT file, f = 0 AS valid, CASE f WHEN 1 THEN 'empty-line' WHEN 2 THEN 'invalid-json-line' WHEN 3 THEN 'invalid-record' WHEN 4 THEN 'dimension-mismatch' WHEN 5 THEN 'duplicate-chunk-id' WHEN 6 THEN 'record-count-mismatch' END AS reason, CASE WHEN f = 0 THEN count(*) ELSE 0 END AS records FROM v GROUP BY file, f",
    "published_identities": """WITH c AS (SELECT c_custkey, c_custkey % 8 AS k FROM customer) SELECT c_custkey, CASE WHEN k IN (0, 1, 2, 7) THEN 'ollama' END AS provider, CASE WHEN k IN (0, 1, 2, 5, 7) THEN 'm' END AS model, CASE WHEN k IN (0, 1, 2, 7) THEN 64 END AS dimensions,
  CASE k WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 1 WHEN 7 THEN 1 END AS input_version, CASE k WHEN 0 THEN 'none' WHEN 1 THEN 'none' WHEN 7 THEN 'nomic-search-query-document' END AS prefix_mode, CASE WHEN k IN (0, 1, 2, 7) THEN 't' ELSE '' END AS updated_at, k IN (0, 1, 7) AS complete, k IN (0, 7) AS searchable, CASE WHEN k = 0 THEN 'p' END AS publication_id FROM c""",
    "checkpoints_checked": f"WITH {V} SELECT file, false AS valid, CASE f WHEN 0 THEN 'checkpoint-record-identity-mismatch' WHEN 1 THEN 'checkpoint-pair-incomplete' WHEN 2 THEN 'invalid-checkpoint-metadata-json' WHEN 3 THEN 'invalid-checkpoint-metadata' WHEN 4 THEN 'incompatible-checkpoint' WHEN 5 THEN 'duplicate-chunk-id' END AS reason, 0 AS records FROM v WHERE f < 6 GROUP BY file, f UNION ALL SELECT file, true, NULL, count(*) FROM v WHERE f = 6 GROUP BY file",
    "publications_checked": f"WITH {V} SELECT DISTINCT file, false AS valid, CASE f WHEN 0 THEN 'canonical-record-identity-mismatch' WHEN 1 THEN 'canonical-pair-incomplete' WHEN 2 THEN 'manifest-embeddings-disabled' WHEN 3 THEN 'manifest-embeddings-missing' WHEN 4 THEN 'manifest-embeddings-invalid' WHEN 5 THEN 'duplicate-chunk-id' ELSE 'record-count-mismatch' END AS reason FROM v",
    "line_sizes": f"WITH {NOTES}, l AS (SELECT path AS file, unnest(string_split(text, chr(10))) AS line FROM notes) SELECT file, count(*) FILTER (trim(regexp_replace(line, '[\\r\\n\\t]', ' ', 'g')) <> '') AS records, sum(octet_length(encode(line)) + 1)::BIGINT AS bytes FROM l GROUP BY file",
    "source_choice": """WITH o AS (SELECT o_orderkey, o_orderkey % 3 > 0 AS known, (['ok', 'outdated', 'missing', 'invalid', 'resource-limit', 'digest-unavailable', 'read-failed'])[o_orderkey % 7 + 1] AS b, o_orderkey * 1009 AS size, o_orderkey % 3000 AS n, o_orderkey % 11 > 0 AS good FROM orders),
p AS (SELECT *, size * 2 + least(size * 2, greatest(ceil(size * 2.0 / greatest(n, 1)), 768 * 32 + 4096)) + n * 384 + n * 768 * 12 + 33554432 AS peak FROM o),
q AS (SELECT *, known AND b = 'ok' AS direct, size > 100663296 OR peak > 201326592 AS unsafe, size * 3 + 33554432 > 201326592 AS blocked FROM p)
SELECT o_orderkey, CASE WHEN direct THEN 'binary' WHEN unsafe OR blocked OR NOT good THEN 'not-loaded' ELSE 'jsonl' END AS source,
  CASE WHEN direct THEN 'none' WHEN unsafe OR blocked THEN 'no-safe-source' WHEN NOT good THEN 'jsonl-read-failed' WHEN NOT known THEN 'legacy-manifest' WHEN b = 'digest-unavailable' THEN b ELSE 'binary-' || b END AS fallback,
  CASE WHEN direct THEN NULL WHEN unsafe THEN 'jsonl-estimated-peak-limit-exceeded' WHEN blocked THEN 'desktop-bridge-read-limit-exceeded' WHEN NOT good THEN 'invalid-jsonl' END AS error FROM q""",
    "searchable_records": f"WITH {Q.STATE} SELECT vec_id, chunk_id FROM r WHERE chunk_id IN (SELECT chunk_id FROM st WHERE state = 'valid')",
    "runtime_index": f"WITH {Q.STATE} SELECT chunk_id, vec_id AS ord, 64 AS length FROM r WHERE chunk_id IN (SELECT chunk_id FROM st WHERE state = 'valid')",
    "embedding_stats": f"WITH {Q.STATE} SELECT count(*) AS total, count(*) FILTER (length > 0) AS with_vector FROM r",
    "notes_files": f"WITH n AS (SELECT *, doc_id % 7 AS k FROM ({PATHED})) SELECT file, CASE WHEN k = 0 AND doc_id % 2 = 0 THEN 'missing' WHEN k < 5 THEN 'unavailable' ELSE 'available' END AS status, CASE WHEN k = 0 AND doc_id % 2 = 1 THEN 'read-error' WHEN k = 1 THEN 'empty-file' WHEN k = 2 THEN 'empty-content' WHEN k = 3 THEN 'invalid-json' WHEN k = 4 THEN 'invalid-shape' END AS reason, CASE WHEN k = 6 THEN 1 + doc_id % 5 ELSE 0 END AS notes FROM n",
    "chunk_files": f"""WITH RECURSIVE {NOTES}, {CHUNKS}, {CL}, b AS (SELECT path AS file, doc_id % 9 AS z, coalesce(chunks, 0) AS chunks, coalesce(bad, false) AS bad, coalesce(more, false) AS more FROM notes LEFT JOIN per ON per.file = path)
SELECT file, CASE z WHEN 0 THEN 'missing' WHEN 1 THEN 'unavailable' ELSE 'available' END AS status, CASE WHEN z < 2 THEN NULL WHEN bad THEN 'invalid-json-lines' WHEN more THEN 'chunk-limit-reached' END AS warning, CASE WHEN z < 2 THEN 0 ELSE chunks END AS chunks,
  CASE WHEN z = 0 THEN NULL WHEN z = 1 THEN 'file-too-large' WHEN bad THEN 'invalid-json-lines' WHEN more THEN 'chunk-limit-reached' END AS strict_reason FROM b""",
    "chunk_shapes": f"WITH RECURSIVE {NOTES}, {CHUNKS}, {CL} SELECT file, bool_and(whole AND NOT bad) AS good FROM cl GROUP BY file",
    "index_readiness": """WITH c AS (SELECT c_custkey, c_custkey AS k FROM customer), r AS (SELECT c_custkey, CASE k % 11 WHEN 0 THEN 'manifest-missing' WHEN 1 THEN 'manifest-empty' WHEN 2 THEN 'manifest-invalid-json' WHEN 3 THEN 'manifest-invalid-shape'
  ELSE CASE WHEN k % 13 = 0 THEN 'notes-missing' WHEN k % 13 = 1 THEN 'notes-invalid-json' WHEN k % 17 = 0 THEN 'chunks-missing' WHEN k % 17 = 1 THEN 'chunks-chunk-limit-reached' WHEN k % 19 = 0 THEN 'notes-invalid-shape' WHEN k % 23 = 0 THEN 'chunks-invalid-shape' WHEN k % 7 <> 3 THEN 'manifest-count-mismatch' END END AS reason FROM c) SELECT c_custkey, reason IS NULL AS ready, reason FROM r""",
    "index_status": f"""WITH RECURSIVE {NOTES}, {CHUNKS}, x AS (SELECT unnest([0, 1, 2, 3]) AS "case"), s AS (SELECT count(*) FILTER (doc_id % 100 = 7) > 0 AS stale FROM notes)
SELECT "case", (SELECT count(*) FROM notes) AS notes, (SELECT count(*) FROM chunks) AS chunks, CASE "case" WHEN 0 THEN 'ready' WHEN 3 THEN CASE WHEN stale THEN 'stale' ELSE 'ready' END ELSE 'invalid' END AS usability, CASE "case" WHEN 1 THEN 'manifest-count-mismatch' WHEN 2 THEN 'manifest-invalid-shape' END AS reason FROM x, s""",
}
