"""Queries on snapshots, events and vector records, with DuckDB SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkwell.functions.text import in_order
from inkwell.operators import maintenance as M
from inkwell.operators import policy
from inkwell.operators.vectors import valid_vector
from inkwell.plans.search_queries import CHUNKS, NOTES, clean, chunks
from inkwell.sources.notes import notes, table


def vault(s, d):
    return table(s, d, "orders").where("o_orderkey % 10 <> 3").select(F.concat(F.lit("o/"), F.lpad(F.col("o_orderkey").cast("string"), 9, "0"), F.lit(".md")).alias("path"), F.col("o_custkey").alias("size"), F.col("o_orderkey").alias("mtime"), "o_orderkey")


def index(s, d):
    shifted = F.when(F.col("o_orderkey") % 7 == 0, F.col("o_orderkey") + 1).otherwise(F.col("o_orderkey"))
    return table(s, d, "orders").where("o_orderkey % 10 <> 4").select(F.concat(F.lit("o/"), F.lpad(F.col("o_orderkey").cast("string"), 9, "0"), F.lit(".md")).alias("path"), F.col("o_custkey").alias("size"), shifted.alias("mtime"), "o_orderkey")


def entries(s, d):
    k = F.col("o_orderkey")
    return index(s, d).withColumn("embedding", F.when(k % 5 == 0, F.array().cast("array<double>")).when(k % 11 != 0, F.array(F.lit(1.0)))).withColumn("vector", F.when(k % 5 != 0, k))


KINDS = {"signup": "create", "view": "modify", "click": "modify", "error": "delete", "purchase": "rename"}


def events(s, d):
    e = F.col("event_type")
    kind = F.when(e == "signup", "create").when(e.isin("view", "click"), "modify").when(e == "error", "delete").otherwise("rename")
    own = F.concat(F.lit("u/"), F.col("user_id").cast("string"), F.lit(".md"))
    moved = F.concat(F.lit("u/"), F.col("user_id").cast("string"), F.lit("-"), F.col("event_id").cast("string"), F.lit(".md"))
    rename = e == "purchase"
    return table(s, d, "events").select(F.col("event_id").alias("seq"), "ts", kind.alias("type"), F.when(rename, moved).otherwise(own).alias("path"), F.when(rename, own).alias("old_path"))


def own_events(s, d):
    return table(s, d, "events").select(F.concat(F.lit("u/"), F.col("user_id").cast("string"), F.lit(".md")).alias("path"), "ts", F.col("event_id").alias("seq"))


def reconcile_exclusions(s, d):
    """Changes to the stored notes when rules get stricter: deletes for what paths or contents now exclude."""
    n = notes(s, d)
    bad = policy.exclusion_reason(F.col("path"), policy.Exclusions(folders=("src3/",), path_terms=())).isNotNull() | policy.content_excluded(F.col("text"), ("thanedble",))
    return M.reconcile(n.where(~bad).select("path", "size", "mtime"), n.select("path", "size", "mtime"))


def event_ignore_reason(s, d):
    k = F.col("event_id") % 6
    raw = F.when(k == 0, F.concat(F.lit("/.Obsidian/"), F.col("event_type"))).when(k == 1, F.concat(F.col("event_type"), F.lit(".md.tmp"))).when(k == 2, F.lit("  ")).when(k == 3, F.concat(F.lit(".inkwell\\"), F.col("event_type"))).when(k == 4, F.concat(F.lit("a/b.bak-"), F.col("event_type"))).otherwise(F.concat(F.lit("notes//"), F.col("event_type"), F.lit(".MD")))
    return table(s, d, "events").select("event_id", policy.ignore_reason(raw).alias("reason"), F.coalesce(policy.is_markdown(raw), F.lit(False)).alias("markdown"))


def batch_parts(s, d):
    n = notes(s, d)
    k, hash_of = F.col("doc_id"), F.md5(F.col("text").cast("binary"))
    indexed = n.where("doc_id % 10 <> 0").select("path", hash_of.alias("hash"))
    kind = F.when(k % 10 == 0, "create").when(k % 7 == 0, "modify").when(k % 7 == 1, "delete").when(k % 7 == 2, "rename").when(k % 7 == 3, "modify")
    moved = F.concat(F.lit("moved/"), F.col("basename"), F.lit(".md"))
    changes = n.select("doc_id", kind.alias("type"), F.when(kind == "rename", moved).otherwise(F.col("path")).alias("path"), F.when(kind == "rename", F.col("path")).alias("old_path"), F.when(k % 7 == 0, F.md5(F.concat("text", F.lit(" x")).cast("binary"))).otherwise(hash_of).alias("hash")).where("type is not null")
    return indexed, changes


def applied(s, d):
    """The index after the batch; two in a hundred notes are gone meanwhile, and some texts hold an excluded term."""
    indexed, changes = batch_parts(s, d)
    excluded = policy.exclusion_reason(F.col("path"), policy.Exclusions(folders=("src3/",), path_terms=())).isNotNull()
    k = F.col("doc_id")
    texts = changes.join(notes(s, d).select("doc_id", "text"), "doc_id").where((F.col("type") != "delete") & (k % 100 > 1)).select("path", "hash", "text")
    return indexed, M.apply_batch(indexed, changes.select("type", "path", "old_path"), texts, excluded, policy.content_excluded(F.col("text"), ("thanedble",)))


def apply_batch_chunks(s, d):
    """Chunk counts by path after the batch: chunks of changed paths are replaced by one each, which stands for their new ones."""
    before, after = applied(s, d)
    own = chunks(s, d).select("path", "chunk_index").join(before.select("path"), "path", "left_semi")
    changed = M.changed_paths(before, after)
    return M.replace_chunks(own, changed, after.select("path", F.lit(0).alias("chunk_index"))).groupBy("path").agg(F.count(F.lit(1)).alias("chunks"))


IDENTITY = {"provider": "ollama", "model": "nomic-embed-text", "dimensions": 64, "input_version": 1, "prefix_mode": "nomic-search-query-document"}
hashed = lambda text: F.md5(text.cast("string").cast("binary"))


def vector_chunks(s, d):
    own = hashed(F.concat(F.lit("search_document: "), F.col("doc_id").cast("string")))
    return table(s, d, "documents").select(F.col("doc_id").cast("string").alias("chunk_id"), hashed(F.col("doc_id")).alias("text_hash"), own.alias("published_hash"), own.alias("target_hash"))


def records(s, d):
    v = F.col("vec_id")
    e = table(s, d, "embeddings")
    e = e.unionByName(e.where("vec_id % 23 = 0"))
    return e.select(
        "vec_id", F.when(v % 31 == 0, F.lit(None).cast("string")).when(v % 29 == 0, F.concat(F.lit("x"), v.cast("string"))).otherwise(v.cast("string")).alias("chunk_id"),
        F.when(v % 7 == 0, "bad").otherwise(hashed(v)).alias("text_hash"), F.when(v % 11 == 0, 63).otherwise(64).alias("dimensions"),
        F.when(v % 13 == 0, F.array().cast("array<float>")).otherwise(F.col("embedding")).alias("embedding"),
        F.when(v % 37 == 0, "other").when(v % 17 != 0, hashed(F.concat(F.lit("search_document: "), v.cast("string")))).alias("input_hash"),
        F.when(v % 19 == 0, "mistral").otherwise("ollama").alias("provider"), F.lit("nomic-embed-text").alias("model"),
    )


def states(s, d, published=IDENTITY):
    return M.vector_state(vector_chunks(s, d), records(s, d), published, valid_vector(F.col("embedding")), IDENTITY)


#: Cases of an update: published identity, target, how the canonical file reads, which records it has, whether there is a checkpoint.
CASES = {
    "compatible": (IDENTITY, IDENTITY, "readable", "same", True),
    "mixed": (IDENTITY, IDENTITY, "readable", "all", True),
    "model changed": (IDENTITY | {"model": "old", "prefix_mode": "none"}, IDENTITY, "readable", "all", False),
    "incomplete": (IDENTITY | {"provider": " "}, IDENTITY, "readable", "all", False),
    "missing": (IDENTITY, IDENTITY, "missing", "all", False),
    "empty": (IDENTITY, IDENTITY, "empty", "all", True),
    "unreadable": (IDENTITY, IDENTITY, "unreadable", "all", True),
    "no dimensions": (IDENTITY, IDENTITY | {"dimensions": 0}, "readable", "same", False),
}


def case(s, d, name):
    published, target, readability, kind, held = CASES[name]
    canonical = records(s, d)
    if kind == "same":
        canonical = canonical.where("provider = 'ollama' and dimensions = 64")
    checkpoint = records(s, d).where(F.lit(held) & (F.col("vec_id") % 2 == 0) & (F.col("vec_id") % 23 > 0))
    return M.update_plan(vector_chunks(s, d), canonical, checkpoint, published, target, valid_vector(F.col("embedding")), readability)


def update_plan(s, d):
    rows = [case(s, d, name)[0].select(F.lit(name).alias("case"), "*") for name in CASES]
    return reduce(DataFrame.unionByName, rows).withColumn("reasons", F.array_join("reasons", "|"))


def resource_guard(s, d):
    b = F.col("o_orderkey") * 9973
    desk, mob = M.guarded(b, "desktop"), M.guarded(b, "mobile")
    return table(s, d, "orders").select("o_orderkey", desk[0].alias("desktop_peak"), desk[1].alias("desktop_allowed"), mob[0].alias("mobile_peak"), mob[1].alias("mobile_allowed"))


STATUSES = (401, 403, 404, 408, 413, 429, 500, 503, 418, 200)


def http_classify(s, d):
    """What errors of the events would mean as statuses, which are taken from their numbers."""
    c = policy.http_category(F.col("status"))
    status = F.get(F.array(*map(F.lit, STATUSES)), (F.col("event_id") % len(STATUSES)).cast("int"))
    return table(s, d, "events").where("event_type = 'error'").select("event_id", status.alias("status")).select("event_id", "status", c.alias("category"), F.when(F.col("status") == 413, "input").otherwise("operation").alias("scope"), (F.col("status") != 413).alias("fatal"))


def redact_message(s, d):
    said = F.concat(F.lit("Failed\n with Bearer  "), F.col("props"), F.lit(" bearer abc.DEF-1 and API key = x"), F.col("event_id").cast("string"), F.lit("  "), F.repeat(F.lit("z "), (F.col("event_id") % 150).cast("int")))
    return table(s, d, "events").select("event_id", policy.redacted(said).alias("message"))


def missing_vectors(s, d):
    r = records(s, d)
    return r.where(F.col("embedding").isNull() | (F.size("embedding") <= 0) | (F.col("provider") != "ollama")).orderBy("vec_id").select("vec_id").limit(20)


QUERIES = {
    "reconcile_plan": lambda s, d: M.reconcile(vault(s, d), index(s, d)),
    "index_staleness": lambda s, d: M.is_stale(vault(s, d).drop("o_orderkey"), index(s, d).drop("o_orderkey")),
    "sync_status": lambda s, d: M.sync_status(vault(s, d), entries(s, d)),
    "legacy_incremental": lambda s, d: M.incremental_entries(vault(s, d), entries(s, d)),
    "legacy_build": lambda s, d: M.incremental_entries(vault(s, d), entries(s, d)).where("outcome <> 'removed'").select("path", "mtime", "vector"),
    "reconcile_exclusions": reconcile_exclusions, "event_ignore_reason": event_ignore_reason,
    "debounce_events": lambda s, d: M.debounce(own_events(s, d), "6 hours"),
    "coalesce_events": lambda s, d: M.coalesce_events(events(s, d)),
    "schedule_fires": lambda s, d: M.schedule_fires(own_events(s, d), 6 * 3600, 24 * 3600),
    "event_summary": lambda s, d: M.event_summary(events(s, d)).withColumn("paths", F.array_join("paths", "|")),
    "apply_batch": lambda s, d: applied(s, d)[1], "apply_batch_chunks": apply_batch_chunks,
    "embedding_state": lambda s, d: states(s, d).select("chunk_id", "state", F.array_join("reasons", "|").alias("reasons"), "reusable"),
    "embedding_state_unpublished": lambda s, d: states(s, d, {}).select("chunk_id", "state", F.array_join("reasons", "|").alias("reasons"), "reusable"),
    "obsolete_ids": lambda s, d: M.obsolete_ids(vector_chunks(s, d), records(s, d)),
    "embedding_state_summary": lambda s, d: M.state_summary(states(s, d), records(s, d)),
    "mixed_identity": lambda s, d: M.mixed_identity(records(s, d), IDENTITY),
    "update_plan": update_plan, "update_plan_records": lambda s, d: case(s, d, "compatible")[1], "missing_vectors": missing_vectors,
    "validation_candidates": lambda s, d: chunks(s, d).orderBy(*in_order(F.col("path")), "chunk_index", *in_order(F.col("chunk_id"))).limit(3).select("path", "chunk_index", "chunk_id"),
    "embedding_input": lambda s, d: chunks(s, d).select("chunk_id", M.embedding_input(F.col("path"), F.col("chunk_index"), F.col("text"), "nomic-embed-text").alias("input")),
    "resource_guard": resource_guard, "http_classify": http_classify, "redact_message": redact_message,
}

PATH = "'o/' || lpad(o_orderkey::VARCHAR, 9, '0') || '.md' AS path, o_custkey AS size"
SNAP = f"""v AS (SELECT {PATH}, o_orderkey AS mtime, o_orderkey FROM orders WHERE o_orderkey % 10 <> 3),
i AS (SELECT {PATH}, o_orderkey + (o_orderkey % 7 = 0)::INT AS mtime, o_orderkey FROM orders WHERE o_orderkey % 10 <> 4),
n AS (SELECT *, CASE WHEN o_orderkey % 5 = 0 THEN 0 WHEN o_orderkey % 11 <> 0 THEN 1 ELSE 0 END AS filled, CASE WHEN o_orderkey % 5 <> 0 THEN o_orderkey END AS vector FROM i)"""
INC = "SELECT path, coalesce(v.mtime, n.mtime) AS mtime, CASE WHEN v.mtime = n.mtime THEN n.vector END AS vector, CASE WHEN v.path IS NULL THEN 'removed' WHEN n.path IS NULL THEN 'added' WHEN v.mtime <> n.mtime THEN 'updated' ELSE 'kept' END AS outcome FROM v FULL JOIN n USING (path)"
EV = """e AS (SELECT event_id AS seq, ts, user_id, CASE event_type WHEN 'signup' THEN 'create' WHEN 'error' THEN 'delete' WHEN 'purchase' THEN 'rename' ELSE 'modify' END AS type,
  'u/' || user_id || CASE WHEN event_type = 'purchase' THEN '-' || event_id ELSE '' END || '.md' AS path, CASE WHEN event_type = 'purchase' THEN 'u/' || user_id || '.md' END AS old_path FROM events)"""
STATE = """r0 AS (SELECT * FROM embeddings UNION ALL SELECT * FROM embeddings WHERE vec_id % 23 = 0),
r AS (SELECT vec_id, CASE WHEN vec_id % 31 = 0 THEN NULL WHEN vec_id % 29 = 0 THEN 'x' || vec_id ELSE vec_id::VARCHAR END AS chunk_id, CASE WHEN vec_id % 7 = 0 THEN 'bad' ELSE md5(vec_id::VARCHAR) END AS text_hash,
  CASE WHEN vec_id % 11 = 0 THEN 63 ELSE 64 END AS dimensions, CASE WHEN vec_id % 13 = 0 THEN 0 ELSE 64 END AS length, vec_id % 17 = 0 AND vec_id % 37 <> 0 AS no_input, vec_id % 37 = 0 AS other_input, CASE WHEN vec_id % 19 = 0 THEN 'mistral' ELSE 'ollama' END AS provider FROM r0),
c AS (SELECT doc_id::VARCHAR AS chunk_id, md5(doc_id::VARCHAR) AS text_hash FROM documents),
g AS (SELECT chunk_id, count(*) AS n, any_value(text_hash) AS th, any_value(dimensions) AS dim, any_value(length) AS len, any_value(no_input) AS no_input, any_value(other_input) AS other_input, any_value(provider) AS provider FROM r WHERE chunk_id IS NOT NULL GROUP BY chunk_id),
s AS (SELECT c.chunk_id, n, CASE WHEN n IS NULL THEN '' WHEN n > 1 THEN 'invalid-record' ELSE array_to_string(list_filter([CASE WHEN th <> c.text_hash THEN 'text-hash-mismatch' END, CASE WHEN len = 0 THEN 'invalid-vector' END,
  CASE WHEN dim <> len THEN 'dimension-mismatch' END, CASE WHEN no_input THEN 'missing-input-hash' END, CASE WHEN provider <> 'ollama' THEN 'published-provider-mismatch' END, CASE WHEN dim = len AND dim <> 64 THEN 'dimension-mismatch' END,
  CASE WHEN other_input THEN 'input-hash-mismatch' END], lambda x: x IS NOT NULL), '|') END AS reasons,
  coalesce(n = 1 AND th = c.text_hash AND len > 0 AND dim = len AND dim = 64 AND NOT no_input AND NOT other_input AND provider = 'ollama', false) AS reusable,
  CASE WHEN n IS NULL THEN '' WHEN n > 1 THEN 'invalid-record' ELSE array_to_string(list_filter([CASE WHEN th <> c.text_hash THEN 'text-hash-mismatch' END, CASE WHEN len = 0 THEN 'invalid-vector' END, CASE WHEN dim <> len THEN 'dimension-mismatch' END,
  CASE WHEN no_input THEN 'missing-input-hash' END, 'published-provider-mismatch', 'published-model-mismatch', CASE WHEN dim = len THEN 'dimension-mismatch' END, 'published-input-format-mismatch'], lambda x: x IS NOT NULL), '|') END AS unpublished FROM c LEFT JOIN g USING (chunk_id)),
st AS (SELECT chunk_id, CASE WHEN n IS NULL THEN 'missing' WHEN reasons = '' THEN 'valid' ELSE 'stale' END AS state, reasons, reusable FROM s),
sm AS (SELECT count(*) FILTER (state = 'valid') AS valid, count(*) FILTER (state = 'missing') AS missing, count(*) FILTER (state = 'stale') AS stale, (SELECT count(*) FROM g WHERE chunk_id NOT IN (SELECT chunk_id FROM c)) AS obsolete,
  (SELECT (sum(n) - count(*))::BIGINT FROM g) AS duplicate, (SELECT count(*) FROM r WHERE chunk_id IS NULL) AS invalid FROM st)"""


def plan_sql(name: str) -> str:
    """The row of one case, by counting over sets of records."""
    published, target, readability, kind, held = CASES[name]
    complete, whole = M.identity_complete(published), M.identity_complete(target)
    read = "false" if readability != "readable" else "provider = 'ollama' AND dimensions = 64" if kind == "same" else "true"
    size = 64 if target["dimensions"] is None else target["dimensions"]
    fits = f"c.text_hash = r.text_hash AND length = 64 AND dimensions = 64 AND NOT no_input AND NOT other_input AND provider = 'ollama' AND {size} = 64"
    bad = "n > 1 OR th <> c_hash OR len = 0 OR dim <> len OR no_input OR " + (f"provider <> '{published['provider']}' OR {published['model'] != 'nomic-embed-text'} OR dim <> {published['dimensions']} OR other_input" if complete else "true")
    changes = [reason for key, reason in M.CHANGES if complete and published[key] != target[key]]
    fixed = {"missing": ("initial-build", "canonical-missing"), "unreadable": ("indeterminate", "canonical-unreadable"), "empty": ("initial-build", "canonical-empty")}
    if readability == "missing":
        mode, why = fixed["missing"]
    elif not complete:
        mode, why = "full-rebuild", "published-identity-incomplete"
    elif changes:
        mode, why = "full-rebuild", ""
    elif readability in fixed:
        mode, why = fixed[readability]
    else:
        mode, why = ("", "published-identity-compatible") if whole else ("full-rebuild", "target-identity-incomplete")
    mode_sql = f"'{mode}'" if mode else "CASE WHEN mixed OR mismatch THEN 'full-rebuild' ELSE 'incremental' END"
    why_sql = f"'{why}'" if mode else f"CASE WHEN mode = 'incremental' THEN '{why}' END"
    said = "".join(f"'{x}', " for x in changes) + (f"{why_sql}, " if why else "")
    rr = f"(SELECT * FROM r WHERE {read})"
    return f"""SELECT '{name}' AS "case", mode, total, reusable, recoverable, to_generate, CASE WHEN known THEN stale ELSE 0 END AS stale, CASE WHEN known THEN missing ELSE 0 END AS missing, CASE WHEN known THEN obsolete ELSE 0 END AS obsolete, publish AS requires_publication,
  CASE WHEN mode = 'full-rebuild' THEN true WHEN known THEN to_generate > 0 OR publish OR missing + stale + obsolete + duplicate + invalid > 0 END AS work_available, array_to_string(list_filter([
  CASE WHEN duplicate > 0 THEN 'canonical-has-duplicates' END, CASE WHEN invalid > 0 THEN 'canonical-has-invalid-records' END, CASE WHEN {readability != "unreadable"} AND missing > 0 THEN 'missing-chunks' END, CASE WHEN stale > 0 THEN 'stale-chunks' END, CASE WHEN obsolete > 0 THEN 'obsolete-records' END,
  CASE WHEN mixed THEN 'canonical-identity-mixed' END, CASE WHEN {complete} AND mismatch THEN 'canonical-record-identity-mismatch' END, {said}CASE WHEN recoverable > 0 THEN 'checkpoint-compatible-records' END, CASE WHEN known AND to_generate = 0 THEN 'no-generation-needed' END,
  CASE WHEN recoverable > 0 AND to_generate = 0 THEN 'checkpoint-covers-all' END, CASE WHEN publish THEN 'publication-needed' END], lambda x: x IS NOT NULL), '|') AS reasons FROM (
SELECT *, total > 0 AND to_generate = 0 AND (obsolete > 0 OR duplicate > 0 OR invalid > 0 OR (mode <> 'incremental' AND records > 0) OR recoverable > 0) AS publish FROM (
SELECT *, mode <> 'indeterminate' AS known, CASE WHEN mode = 'incremental' THEN reuse ELSE 0 END AS reusable, CASE WHEN mode = 'incremental' THEN held_rest ELSE held END AS recoverable, CASE WHEN mode = 'indeterminate' THEN 0 WHEN mode = 'incremental' THEN total - reuse - held_rest ELSE total - held END AS to_generate FROM (
SELECT *, {mode_sql} AS mode FROM (
SELECT count(*) AS total, (SELECT count(*) FROM {rr}) AS records, count(*) FILTER (n IS NULL) AS missing, count(*) FILTER (n IS NOT NULL AND ({bad})) AS stale, count(*) FILTER (reuse) AS reuse, count(*) FILTER (held) AS held, count(*) FILTER (held AND NOT reuse) AS held_rest,
  (SELECT count(DISTINCT chunk_id) FROM {rr} WHERE chunk_id NOT IN (SELECT chunk_id FROM c)) AS obsolete, (SELECT count(chunk_id) - count(DISTINCT chunk_id) FROM {rr}) AS duplicate, (SELECT count(*) FROM {rr} WHERE chunk_id IS NULL) AS invalid,
  (SELECT count(DISTINCT (provider, dimensions)) > 1 FROM {rr}) AS mixed, (SELECT count(*) FILTER (provider <> '{published["provider"]}' OR dimensions <> {published["dimensions"]} OR {published["model"] != "nomic-embed-text"}) > 0 FROM {rr}) AS mismatch FROM (
SELECT c.chunk_id, c.text_hash AS c_hash, n, th, len, dim, no_input, other_input, provider, coalesce(n = 1 AND fits, false) AS reuse, h.chunk_id IS NOT NULL AS held FROM c
  LEFT JOIN (SELECT r.chunk_id, count(*) AS n, any_value(r.text_hash) AS th, any_value(length) AS len, any_value(dimensions) AS dim, any_value(no_input) AS no_input, any_value(other_input) AS other_input, any_value(provider) AS provider, bool_and({fits}) AS fits FROM {rr} r JOIN c USING (chunk_id) GROUP BY r.chunk_id) USING (chunk_id)
  LEFT JOIN (SELECT r.chunk_id FROM r JOIN c USING (chunk_id) WHERE {held} AND vec_id % 2 = 0 AND vec_id % 23 > 0 AND {fits}) h ON h.chunk_id = c.chunk_id)))))"""


BAD = "(starts_with(path, 'src3/') OR contains(lower(text), 'thanedble'))"

BATCH = """k AS (SELECT *, CASE WHEN doc_id % 10 = 0 THEN 'create' WHEN doc_id % 7 = 0 THEN 'modify' WHEN doc_id % 7 = 1 THEN 'delete' WHEN doc_id % 7 = 2 THEN 'rename' WHEN doc_id % 7 = 3 THEN 'modify' ELSE 'none' END AS type, doc_id % 10 <> 0 AS old, doc_id % 100 > 1 AS there, contains(lower(text), 'thanedble') AS banned FROM notes),
l AS (SELECT *, type NOT IN ('none', 'delete') AND ((starts_with(path, 'src3/') AND type <> 'rename') OR (there AND banned)) AS out FROM k),
b AS (SELECT *, type NOT IN ('none', 'delete') AND NOT out AND there AS written, CASE WHEN type = 'rename' AND NOT out AND there THEN 'moved/' || basename || '.md' ELSE path END AS new_path,
  CASE WHEN type NOT IN ('none', 'delete') AND NOT out AND there AND doc_id % 7 = 0 THEN md5(text || ' x') ELSE md5(text) END AS new_hash, type <> 'delete' AND NOT out AND (old OR (type NOT IN ('none', 'delete') AND there)) AS stays FROM l)"""

ORACLES = {
    "reconcile_plan": f"WITH {SNAP}, x AS (SELECT path, CASE WHEN v.path IS NULL THEN 'delete' WHEN i.path IS NULL THEN 'create' WHEN v.size <> i.size OR v.mtime <> i.mtime THEN 'modify' END AS change_type FROM v FULL JOIN i USING (path)) SELECT change_type, path, CASE change_type WHEN 'delete' THEN 0 WHEN 'create' THEN 1 ELSE 2 END::INT AS ord FROM x WHERE change_type IS NOT NULL",
    "index_staleness": f"WITH {SNAP} SELECT (SELECT count(*) FROM v) AS expected, (SELECT count(*) FROM i) AS indexed, (SELECT count(*) FROM v) <> (SELECT count(*) FROM i) OR EXISTS (SELECT 1 FROM v WHERE (path, size, mtime) NOT IN (SELECT (path, size, mtime) FROM i)) AS stale",
    "sync_status": f"WITH {SNAP}, b AS (SELECT v.path AS vp, n.path AS np, v.mtime AS vm, n.mtime AS nm, filled FROM v FULL JOIN n ON v.path = n.path) SELECT count(vp) AS vault_notes, count(np) AS indexed_notes, count(*) FILTER (np IS NULL) AS new_notes, count(*) FILTER (vm <> nm) AS changed_notes, count(*) FILTER (vp IS NULL) AS removed_notes, count(*) FILTER (vp IS NOT NULL AND np IS NOT NULL AND filled = 0) AS without_embedding, count(*) FILTER (vm <> nm AND filled = 1) AS outdated_embeddings FROM b",
    "legacy_incremental": f"WITH {SNAP} {INC}",
    "legacy_build": f"WITH {SNAP} SELECT path, mtime, vector FROM ({INC}) WHERE outcome <> 'removed'",
    "reconcile_exclusions": f"WITH {NOTES} SELECT 'delete' AS change_type, path, 0 AS ord FROM notes WHERE {BAD}",
    "event_ignore_reason": "SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'internal-path' WHEN 1 THEN 'temporary-file' WHEN 2 THEN 'missing-path' WHEN 3 THEN 'internal-path' WHEN 4 THEN 'temporary-file' END AS reason, event_id % 6 = 5 AS markdown FROM events",
    "debounce_events": "WITH e AS (SELECT 'u/' || user_id || '.md' AS path, ts, event_id, coalesce(ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) >= INTERVAL 6 HOUR, true) AS new FROM events), g AS (SELECT *, sum(new::INT) OVER (PARTITION BY path ORDER BY ts) AS k FROM e) SELECT path, max(ts) + INTERVAL 6 HOUR AS fires_at, max(event_id) AS last_seq, count(*) AS events FROM g GROUP BY path, k",
    "coalesce_events": f"""WITH RECURSIVE {EV}, k AS (SELECT *, coalesce(old_path, path) AS key, row_number() OVER (PARTITION BY coalesce(old_path, path) ORDER BY seq) AS n, count(*) OVER (PARTITION BY coalesce(old_path, path)) AS last, min(seq) OVER (PARTITION BY coalesce(old_path, path)) AS first_seq FROM e),
f AS (SELECT key, n, last, first_seq, type, path, old_path FROM k WHERE n = 1 UNION ALL
  SELECT k.key, k.n, k.last, k.first_seq, CASE WHEN f.type = 'create' AND k.type = 'modify' THEN 'create' ELSE k.type END, k.path, CASE WHEN k.type = 'rename' THEN coalesce(f.old_path, f.path) ELSE k.old_path END FROM f JOIN k ON k.key = f.key AND k.n = f.n + 1)
SELECT key, type, path, old_path, first_seq FROM f WHERE n = last""",
    "schedule_fires": """WITH RECURSIVE e AS (SELECT 'u/' || user_id || '.md' AS path, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS n FROM events),
f AS (SELECT path, n, ts AS start, ts AS last FROM e WHERE n = 1 UNION ALL
  SELECT e.path, e.n, CASE WHEN e.ts >= least(f.last + INTERVAL 6 HOUR, f.start + INTERVAL 24 HOUR) THEN e.ts ELSE f.start END, e.ts FROM f JOIN e ON e.path = f.path AND e.n = f.n + 1)
SELECT path, start AS dirty_since, least(max(last) + INTERVAL 6 HOUR, start + INTERVAL 24 HOUR) AS fires_at, count(*) AS events FROM f GROUP BY path, start""",
    "event_summary": f"WITH {EV}, n AS (SELECT *, coalesce(old_path || ' -> ', '') || path AS shown, row_number() OVER (PARTITION BY type ORDER BY seq) AS n FROM e) SELECT type, count(*) AS events, arg_min(path, seq) AS first_path, string_agg(shown, '|' ORDER BY seq) FILTER (n <= 20) AS paths, greatest(count(*) - 20, 0)::BIGINT AS omitted FROM n GROUP BY type",
    "apply_batch": f"WITH {NOTES}, {BATCH} SELECT new_path AS path, new_hash AS hash FROM b WHERE stays",
    "apply_batch_chunks": f"WITH RECURSIVE {NOTES}, {CHUNKS}, {BATCH}, n AS (SELECT path, count(*) AS n FROM chunks GROUP BY path), z AS (SELECT new_path AS path, CASE WHEN old AND new_path = b.path AND new_hash = md5(text) THEN n ELSE 1 END AS chunks FROM b LEFT JOIN n USING (path) WHERE stays) SELECT * FROM z WHERE chunks IS NOT NULL",
    "embedding_state": f"WITH {STATE} SELECT * FROM st",
    "embedding_state_unpublished": f"WITH {STATE} SELECT chunk_id, CASE WHEN n IS NULL THEN 'missing' ELSE 'stale' END AS state, unpublished AS reasons, reusable FROM s",
    "obsolete_ids": f"WITH {STATE} SELECT chunk_id FROM g WHERE chunk_id NOT IN (SELECT chunk_id FROM c) ORDER BY 1",
    "embedding_state_summary": f"WITH {STATE} SELECT * FROM sm",
    "mixed_identity": f"WITH {STATE} SELECT count(DISTINCT (provider, dimensions)) AS identities, count(DISTINCT (provider, dimensions)) > 1 AS mixed, count(*) FILTER (provider <> 'ollama' OR dimensions <> 64) > 0 AS mismatch FROM r",
    "update_plan": f"WITH {STATE} " + " UNION ALL ".join(map(plan_sql, CASES)),
    "update_plan_records": f"""WITH {STATE}, k AS (SELECT chunk_id, count(*) AS n, bool_and(text_hash = md5(chunk_id) AND length = 64 AND NOT no_input AND NOT other_input) AS fits FROM r WHERE provider = 'ollama' AND dimensions = 64 GROUP BY chunk_id),
h AS (SELECT DISTINCT chunk_id FROM r WHERE vec_id % 2 = 0 AND vec_id % 23 > 0 AND text_hash = md5(chunk_id) AND length = 64 AND dimensions = 64 AND NOT no_input AND NOT other_input AND provider = 'ollama')
SELECT chunk_id, CASE WHEN k.n = 1 AND k.fits THEN 'canonical' WHEN h.chunk_id IS NOT NULL THEN 'checkpoint' ELSE 'generate' END AS origin FROM c LEFT JOIN k USING (chunk_id) LEFT JOIN h USING (chunk_id)""",
    "missing_vectors": f"WITH {STATE} SELECT vec_id FROM r WHERE length = 0 OR provider <> 'ollama' ORDER BY vec_id LIMIT 20",
    "validation_candidates": f"WITH RECURSIVE {NOTES}, {CHUNKS} SELECT path, chunk_index, path || '::' || chunk_index AS chunk_id FROM chunks ORDER BY path COLLATE en_us, path, chunk_index LIMIT 3",
    "embedding_input": f"WITH RECURSIVE {NOTES}, {CHUNKS} SELECT path || '::' || chunk_index AS chunk_id, 'search_document: Título: ' || 'doc-' || lpad(doc_id::VARCHAR, 8, '0') || chr(10) || 'Caminho: ' || path || chr(10) || 'Bloco: ' || chunk_index || chr(10) || 'Conteúdo:' || chr(10) || text AS input FROM chunks",
    "resource_guard": "SELECT o_orderkey, o_orderkey * 9973 * 3 + 33554432 AS desktop_peak, o_orderkey * 9973 <= 100663296 AND o_orderkey * 9973 * 3 + 33554432 <= 201326592 AS desktop_allowed, o_orderkey * 9973 * 5 + 8388608 AS mobile_peak, o_orderkey * 9973 <= 12582912 AND o_orderkey * 9973 * 5 + 8388608 <= 67108864 AS mobile_allowed FROM orders",
    "http_classify": "SELECT event_id, status, CASE status WHEN 401 THEN 'authentication' WHEN 403 THEN 'authorization' WHEN 404 THEN 'model-not-found' WHEN 408 THEN 'timeout' WHEN 413 THEN 'input-rejected' WHEN 429 THEN 'rate-limit' ELSE CASE WHEN status >= 500 THEN 'connection' ELSE 'unknown' END END AS category, CASE WHEN status = 413 THEN 'input' ELSE 'operation' END AS scope, status <> 413 AS fatal FROM (SELECT event_id, [401, 403, 404, 408, 413, 429, 500, 503, 418, 200][event_id % 10 + 1] AS status FROM events WHERE event_type = 'error')",
    "redact_message": r"WITH m AS (SELECT event_id, " + clean(r"'Failed' || chr(10) || ' with Bearer  ' || props || ' bearer abc.DEF-1 and API key = x' || event_id || '  ' || repeat('z ', (event_id % 150)::INT)") + r" AS t FROM events), r AS (SELECT event_id, regexp_replace(regexp_replace(t, 'Bearer\s+[A-Za-z0-9._~+/=-]+', 'Bearer [redacted]', 'gi'), 'api[_ -]?key\s*[:=]\s*[A-Za-z0-9._~+/=-]+', 'api key [redacted]', 'gi') AS t FROM m) SELECT event_id, CASE WHEN length(t) > 220 THEN substring(t, 1, 217) || '...' ELSE t END AS message FROM r",
}
