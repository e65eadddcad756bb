"""Index maintenance: diffs, change events, the state of stored vectors and update plans."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# ---- snapshots -------------------------------------------------------------------------------


def reconcile(vault: DataFrame, index: DataFrame) -> DataFrame:
    """Changes (change_type, path, ord) that bring index (path, size, mtime) to vault: deletes, creates, modifies, each by path."""
    v, i = vault.select("path", F.col("size").alias("vs"), F.col("mtime").alias("vm")), index.select("path", F.col("size").alias("is"), F.col("mtime").alias("im"))
    change = F.when(F.col("vm").isNull(), "delete").when(F.col("im").isNull(), "create").when((F.col("vs") != F.col("is")) | (F.col("vm") != F.col("im")), "modify")
    rows = v.join(i, "path", "full_outer").select("path", change.alias("change_type")).where("change_type is not null")
    return rows.withColumn("ord", F.when(F.col("change_type") == "delete", 0).when(F.col("change_type") == "create", 1).otherwise(2)).select("change_type", "path", "ord")


def is_stale(vault: DataFrame, index: DataFrame) -> DataFrame:
    """One row: counts of both sides and whether they differ in number, presence, size or mtime."""
    same = vault.join(index, ["path", "size", "mtime"], "left_anti").agg(F.count(F.lit(1)).alias("unmatched"))
    counts = vault.agg(F.count(F.lit(1)).alias("expected")).crossJoin(index.agg(F.count(F.lit(1)).alias("indexed"))).crossJoin(same)  # one row each
    return counts.select("expected", "indexed", ((F.col("expected") != F.col("indexed")) | (F.col("unmatched") > 0)).alias("stale"))


def sync_status(vault: DataFrame, entries: DataFrame) -> DataFrame:
    """One row of counts: entries (path, mtime, embedding) against vault (path, mtime)."""
    both = vault.select("path", F.col("mtime").alias("vm")).join(entries.select("path", F.col("mtime").alias("im"), "embedding"), "path", "full_outer")
    known, present = F.col("im").isNotNull(), F.col("vm").isNotNull()
    empty = F.coalesce(F.size("embedding") <= 0, F.lit(True))
    changed = known & present & (F.col("vm") != F.col("im"))
    n = lambda c, name: F.count_if(c).alias(name)
    return both.agg(n(present, "vault_notes"), n(known, "indexed_notes"), n(present & ~known, "new_notes"), n(changed, "changed_notes"), n(known & ~present, "removed_notes"), n(known & present & empty, "without_embedding"), n(changed & ~empty, "outdated_embeddings"))


def incremental_entries(vault: DataFrame, entries: DataFrame) -> DataFrame:
    """(path, mtime, vector, outcome): the index after an update; a vector stays where the time is the same, removed rows are reported."""
    both = vault.select("path", F.col("mtime").alias("vm")).join(entries.select("path", F.col("mtime").alias("im"), "vector"), "path", "full_outer")
    outcome = F.when(F.col("vm").isNull(), "removed").when(F.col("im").isNull(), "added").when(F.col("vm") != F.col("im"), "updated").otherwise("kept")
    return both.select("path", F.coalesce("vm", "im").alias("mtime"), F.when(F.col("vm") == F.col("im"), F.col("vector")).alias("vector"), outcome.alias("outcome"))


# ---- events ----------------------------------------------------------------------------------


def coalesce_events(events: DataFrame) -> DataFrame:
    """Events (seq, type, path, old_path) to one per key, old_path or else path: key, type, path, old_path, first_seq.

    The fold over a key's events depends on its last event and, for a modify, on the last event before
    it that is no modify: so two maxima do, and no key's events are gathered however many it has.
    """
    row = F.struct("type", "path", "old_path")
    keyed = events.withColumn("key", F.coalesce("old_path", "path"))
    last = keyed.groupBy("key").agg(F.max_by(row, "seq").alias("last"), F.expr("max_by(type, seq) FILTER (WHERE type <> 'modify')").alias("base"), F.min("seq").alias("first_seq"))
    kind = F.when((F.col("last.type") == "modify") & (F.col("base") == "create"), "create").otherwise(F.col("last.type"))
    old = F.when(F.col("last.type") == "rename", F.col("key")).otherwise(F.col("last.old_path"))
    return last.select("key", kind.alias("type"), F.col("last.path").alias("path"), old.alias("old_path"), "first_seq")


def debounce(events: DataFrame, gap: str) -> DataFrame:
    """Per path, bursts of events (path, ts, seq) closer than the gap: the last one's seq and when it fires."""
    bursts = events.groupBy("path", F.session_window("ts", gap).alias("w")).agg(F.max("seq").alias("last_seq"), F.count(F.lit(1)).alias("events"))
    return bursts.select("path", F.col("w.end").alias("fires_at"), "last_seq", "events")


def schedule_fires(events: DataFrame, quiet_s: int, cap_s: int) -> DataFrame:
    """Per path, when a dirty state fires: after a quiet time since the last event, or a longest time since the first.

    (path, dirty_since, fires_at, events). A quiet time always fires, so events fall into bursts without
    one, found by a window; only bursts longer than the longest time are folded, one burst at a time.
    """
    quiet, cap = F.make_interval(secs=F.lit(quiet_s)), F.make_interval(secs=F.lit(cap_s))
    by_path = Window.partitionBy("path").orderBy("ts")
    fresh = F.coalesce(F.lag("ts").over(by_path) + quiet <= F.col("ts"), F.lit(True))
    rows = events.select("path", "ts", F.sum(fresh.cast("int")).over(by_path).alias("burst"))
    bursts = rows.groupBy("path", "burst").agg(F.min("ts").alias("first"), F.max("ts").alias("last"), F.count(F.lit(1)).alias("events"))
    short = bursts.where(F.col("first") + cap > F.col("last")).select("path", F.col("first").alias("dirty_since"), F.least(F.col("last") + quiet, F.col("first") + cap).alias("fires_at"), "events")
    long = rows.join(bursts.where(F.col("first") + cap <= F.col("last")).select("path", "burst"), ["path", "burst"])

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        calm, most = pd.Timedelta(seconds=quiet_s), pd.Timedelta(seconds=cap_s)
        times, found, first = rows["ts"].sort_values().reset_index(drop=True), [], 0
        while first < len(times):
            last = int(times.searchsorted(times[first] + most))
            found.append((times[first], min(times[last - 1] + calm, times[first] + most), last - first))
            first = last
        return pd.DataFrame({"path": rows["path"].iloc[0], "dirty_since": [f[0] for f in found], "fires_at": [f[1] for f in found], "events": [f[2] for f in found]})

    return short.unionByName(long.groupBy("path", "burst").applyInPandas(fold, "path string, dirty_since timestamp, fires_at timestamp, events long"))


def event_summary(events: DataFrame, most: int = 20) -> DataFrame:
    """Per type: events, the first path, the first paths (at most so many, old ones with an arrow) and how many more events there are."""
    shown = F.when(F.col("old_path").isNotNull(), F.concat("old_path", F.lit(" -> "), "path")).otherwise(F.col("path"))
    counts = events.groupBy("type").agg(F.count(F.lit(1)).alias("events"), F.min_by("path", "seq").alias("first_path"))
    within = Window.partitionBy("type").orderBy("seq")
    firsts = events.withColumn("n", F.row_number().over(within)).where(F.col("n") <= most).withColumn("shown", shown)  # limited before its shuffle
    paths = firsts.groupBy("type").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "shown"))), lambda x: x["shown"]).alias("paths"))
    return counts.join(paths, "type").select("type", "events", "first_path", "paths", F.greatest(F.col("events") - most, F.lit(0)).alias("omitted"))


def apply_batch(index: DataFrame, changes: DataFrame, texts: DataFrame, excluded: Column, content_excluded: Column | None = None) -> DataFrame:
    """The index (path, hash, …) after coalesced changes (type, path, old_path) with texts (path, hash, …, and text if content_excluded reads it).

    Of each change but a delete: an excluded path loses its rows, the old one's too; without a text
    nothing changes; an excluded text is like an excluded path. A modify whose hash is the indexed one
    changes nothing; a rename removes both paths and writes the new one. texts have the index's further columns.
    """
    own = [c for c in index.columns if c != "path"]
    banned = content_excluded if content_excluded is not None else F.lit(False)
    found = texts.withColumn("_banned", F.coalesce(banned, F.lit(False))).select("path", *(F.col(name).alias(f"_{name}") for name in own), "_banned")
    c = changes.withColumn("_out", F.coalesce(excluded, F.lit(False))).join(found, "path", "left")
    delete = F.col("type") == "delete"
    out = ~delete & (F.col("_out") | F.coalesce("_banned", F.lit(False)))
    write = ~delete & ~out & F.col("_hash").isNotNull()
    both = F.array_compact(F.array("path", "old_path"))
    gone = F.when(delete, F.array(F.coalesce("old_path", "path"))).when(out, both).when(write & (F.col("type") == "rename"), both).when(write, F.array("path"))
    touched = c.select(F.explode(gone).alias("path")).distinct()
    written = c.where(write).select("path", *(F.col(f"_{name}").alias(name) for name in own)).dropDuplicates(["path"])
    return index.join(touched, "path", "left_anti").unionByName(written)


def changed_paths(before: DataFrame, after: DataFrame) -> DataFrame:
    """Paths whose rows (path, hash) differ between two indexes: their chunks are to be replaced, and without any nothing is published."""
    a, b = before.select("path", F.col("hash").alias("old")), after.select("path", F.col("hash").alias("new"))
    return a.join(b, "path", "full_outer").where(~F.col("old").eqNullSafe(F.col("new"))).select("path", F.col("new").isNotNull().alias("stays"))


def replace_chunks(chunks: DataFrame, changed: DataFrame, rebuilt: DataFrame) -> DataFrame:
    """chunks (path, …) without those of changed paths, and with the rebuilt ones of paths that stay."""
    new = rebuilt.join(changed.where("stays").select("path"), "path", "left_semi")
    return chunks.join(changed.select("path"), "path", "left_anti").unionByName(new.select(*chunks.columns))


# ---- vectors ---------------------------------------------------------------------------------

#: Version of the input's format, and the first of prefix modes.
INPUT_VERSION = 1


def identity_complete(identity: dict) -> bool:
    """A provider, a model, dimensions, an input version and a prefix mode."""
    named = lambda key: isinstance(identity.get(key), str) and bool(identity[key].strip())
    counted = lambda key: isinstance(identity.get(key), int) and identity[key] > 0
    return named("provider") and named("model") and counted("dimensions") and counted("input_version") and named("prefix_mode")


def vector_state(chunks: DataFrame, records: DataFrame, published: dict, valid: Column, target: dict | None = None) -> DataFrame:
    """Per chunk (chunk_id, text_hash, published_hash, target_hash): state, reasons and reusable.

    records: chunk_id, text_hash, dimensions, embedding, input_hash, provider, model. published and
    target are identities: provider, model, dimensions, input_version, prefix_mode; published_hash and
    target_hash are hashes of a chunk's input under their prefix modes. A chunk is missing without a
    record, valid without a reason and stale otherwise; of several records none is looked at. reusable
    says that its one record can go into the next publication, which has target's identity.
    """
    value = F.struct("text_hash", "dimensions", F.size("embedding").alias("length"), valid.alias("valid"), "input_hash", "provider", "model")
    per = records.where(F.coalesce(F.col("chunk_id"), F.lit("")) != "").groupBy("chunk_id").agg(F.count(F.lit(1)).alias("n"), F.first(value).alias("r"))
    r = lambda c: F.col(f"r.{c}")
    other = lambda a, b: ~a.eqNullSafe(b)
    own_size = other(r("dimensions"), r("length"))
    has_input = F.coalesce(r("input_hash"), F.lit("")) != ""
    tests = [(other(r("text_hash"), F.col("c.text_hash")), "text-hash-mismatch"), (~r("valid"), "invalid-vector"), (own_size, "dimension-mismatch"), (~has_input, "missing-input-hash")]
    if identity_complete(published):
        tests += [
            (other(r("provider"), F.lit(published["provider"])), "published-provider-mismatch"),
            (other(r("model"), F.lit(published["model"])), "published-model-mismatch"),
            (~own_size & other(r("dimensions"), F.lit(published["dimensions"])), "dimension-mismatch"),
            (F.lit(published["input_version"] != INPUT_VERSION), "published-input-format-mismatch"),
            (has_input & other(r("input_hash"), F.col("c.published_hash")), "input-hash-mismatch"),
        ]
    else:
        tests += [(F.lit(True), "published-provider-mismatch"), (F.lit(True), "published-model-mismatch"), (~own_size, "dimension-mismatch"), (F.lit(True), "published-input-format-mismatch")]
    reasons = F.array_compact(F.array(*(F.when(t, F.lit(name)) for t, name in tests)))
    none = F.array().cast("array<string>")
    reasons = F.when(F.col("n").isNull(), none).when(F.col("n") > 1, F.array(F.lit("invalid-record"))).otherwise(reasons)
    reusable = F.lit(False)
    if target is not None:
        same = (r("text_hash") == F.col("c.text_hash")) & (r("provider") == F.lit(target.get("provider"))) & (r("model") == F.lit(target.get("model"))) & r("valid") & ~own_size & has_input & (r("input_hash") == F.col("c.target_hash"))
        if target.get("dimensions") is not None:
            same = same & (r("dimensions") == target["dimensions"])
        reusable = F.coalesce((F.col("n") == 1) & same, F.lit(False))
    joined = chunks.alias("c").join(per.alias("p"), "chunk_id", "left").select("chunk_id", "n", reasons.alias("reasons"), reusable.alias("reusable"))
    state = F.when(F.col("n").isNull(), "missing").when(F.size("reasons") == 0, "valid").otherwise("stale")
    return joined.select("chunk_id", state.alias("state"), "reasons", "reusable")


def state_summary(states: DataFrame, records: DataFrame) -> DataFrame:
    """One row: valid, missing, stale, obsolete, duplicate and invalid counts."""
    s = states.agg(*(F.count_if(F.col("state") == k).alias(k) for k in ("valid", "missing", "stale")))
    named = records.where(F.coalesce(F.col("chunk_id"), F.lit("")) != "").groupBy("chunk_id").agg(F.count(F.lit(1)).alias("n"))
    obsolete = named.join(states, "chunk_id", "left_anti").agg(F.count(F.lit(1)).alias("obsolete"))
    duplicate = named.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicate"))
    invalid = records.agg(F.count_if(F.coalesce(F.col("chunk_id"), F.lit("")) == "").alias("invalid"))
    return s.crossJoin(obsolete).crossJoin(duplicate).crossJoin(invalid)  # one row each


def mixed_identity(records: DataFrame, published: dict | None = None) -> DataFrame:
    """One row: identities of the records that have one, whether these are several, and whether one differs from published."""
    i = records.where((F.trim("provider") != "") & (F.trim("model") != "") & (F.col("dimensions") > 0)).select("provider", "model", "dimensions").distinct()
    p = published or {}
    differs = (F.col("provider") != F.lit(p.get("provider"))) | (F.col("model") != F.lit(p.get("model"))) | (F.col("dimensions") != F.lit(p.get("dimensions")))
    return i.agg(F.count(F.lit(1)).alias("identities"), (F.count(F.lit(1)) > 1).alias("mixed"), (F.count_if(differs) > 0).alias("mismatch"))


CHANGES = (("provider", "provider-changed"), ("model", "model-changed"), ("dimensions", "dimension-changed"), ("input_version", "input-version-changed"), ("prefix_mode", "prefix-mode-changed"))


def update_plan(chunks: DataFrame, canonical: DataFrame, checkpoint: DataFrame, published: dict, target: dict, valid: Column, readability: str = "readable") -> tuple[DataFrame, DataFrame]:
    """(one row that says what an update of the vectors does, the origin of every chunk's vector).

    chunks, canonical and checkpoint are as for vector_state; readability is missing, empty, unreadable or
    readable, and records that weren't read are none. The row: mode by the first rule that holds, counts,
    requires_publication, work_available (null if it can't be told) and reasons, in order. The origins are (chunk_id,
    origin): canonical records that can be reused in an incremental update, then checkpoint ones, the rest to be generated.
    """
    if readability != "readable":
        canonical = canonical.limit(0)
    complete = identity_complete(published)
    changes = [reason for key, reason in CHANGES if published.get(key) != target.get(key)] if complete else []
    states = vector_state(chunks, canonical, published, valid, target)
    held = vector_state(chunks, checkpoint, {}, valid, target).where("reusable").select("chunk_id", F.lit(True).alias("held"))
    identity = mixed_identity(canonical, published if complete else None)

    if readability == "missing":
        mode, why = F.lit("initial-build"), "canonical-missing"
    elif not complete:
        mode, why = F.lit("full-rebuild"), "published-identity-incomplete"
    elif changes:
        mode, why = F.lit("full-rebuild"), None
    elif readability == "unreadable":
        mode, why = F.lit("indeterminate"), "canonical-unreadable"
    elif readability == "empty":
        mode, why = F.lit("initial-build"), "canonical-empty"
    elif not identity_complete(target):
        mode, why = F.lit("full-rebuild"), "target-identity-incomplete"
    else:
        mode, why = F.when(F.col("mixed") | F.col("mismatch"), "full-rebuild").otherwise("incremental"), "published-identity-compatible"

    one_mode = identity.select("mixed", "mismatch", mode.alias("mode"))  # one row
    chunk_rows = states.join(held, "chunk_id", "left").crossJoin(F.broadcast(one_mode.select("mode")))
    reused = (F.col("mode") == "incremental") & F.col("reusable")
    origin = F.when(reused, "canonical").when(F.coalesce("held", F.lit(False)), "checkpoint").when(F.col("mode") != "indeterminate", "generate").otherwise("unknown")
    origins = chunk_rows.select("chunk_id", "state", origin.alias("origin"))

    n = lambda c, name: F.count_if(c).alias(name)
    counts = origins.agg(F.count(F.lit(1)).alias("total"), *(n(F.col("origin") == k, k) for k in ("canonical", "checkpoint", "generate")))
    row = counts.crossJoin(state_summary(states, canonical)).crossJoin(one_mode).crossJoin(canonical.agg(F.count(F.lit(1)).alias("records")))  # one row each
    cleanup = (F.col("obsolete") > 0) | (F.col("duplicate") > 0) | (F.col("invalid") > 0) | ((F.col("mode") != "incremental") & (F.col("records") > 0)) | (F.col("checkpoint") > 0)
    done = F.col("generate") == 0
    publish = (F.col("total") > 0) & done & cleanup
    read = F.lit(readability != "unreadable")
    readable = F.lit(readability == "readable")
    said = [
        (read & (F.col("duplicate") > 0), "canonical-has-duplicates"), (read & (F.col("invalid") > 0), "canonical-has-invalid-records"), (read & (F.col("missing") > 0), "missing-chunks"), (read & (F.col("stale") > 0), "stale-chunks"),
        (read & (F.col("obsolete") > 0), "obsolete-records"), (readable & F.col("mixed"), "canonical-identity-mixed"), (readable & F.lit(complete) & F.col("mismatch"), "canonical-record-identity-mismatch"),
        *((F.lit(True), reason) for reason in changes),
        (F.lit(why is not None) & ((F.lit(why) != "published-identity-compatible") | (F.col("mode") == "incremental")), why or ""),
        (F.col("checkpoint") > 0, "checkpoint-compatible-records"), ((F.col("mode") != "indeterminate") & done, "no-generation-needed"), ((F.col("checkpoint") > 0) & done, "checkpoint-covers-all"), (publish, "publication-needed"),
    ]
    known = F.col("mode") != "indeterminate"
    count = lambda c: F.when(known, F.col(c)).otherwise(0).cast("long")
    work = (F.col("generate") > 0) | publish | reduce(lambda a, b: a | b, (F.col(c) > 0 for c in ("missing", "stale", "obsolete", "duplicate", "invalid")))
    available = F.when(F.col("mode") == "full-rebuild", True).when(known, work)
    plan = row.select(
        "mode", "total", F.col("canonical").alias("reusable"), F.col("checkpoint").alias("recoverable"), F.col("generate").alias("to_generate"), count("stale").alias("stale"), count("missing").alias("missing"), count("obsolete").alias("obsolete"),
        publish.alias("requires_publication"), available.alias("work_available"), F.array_compact(F.array(*(F.when(c, F.lit(r)) for c, r in said))).alias("reasons"),
    )
    return plan, origins.select("chunk_id", "origin")


def obsolete_ids(chunks: DataFrame, records: DataFrame) -> DataFrame:
    """Chunk ids of records without a current chunk, in order."""
    named = records.where(F.coalesce(F.col("chunk_id"), F.lit("")) != "").select("chunk_id").distinct()
    return named.join(chunks.select("chunk_id"), "chunk_id", "left_anti").orderBy("chunk_id")


# Fixed set of models that want prefixes.
PREFIX_MODELS = ("nomic-embed-text-v2-moe", "nomic-embed-text", "nomic-embed-text-v1.5", "nomic-embed-text-v2")


def prefix_mode(model: str) -> str:
    return "nomic-search-query-document" if model.lower() in PREFIX_MODELS else "none"


def input_format(model: str) -> str:
    """Version and prefix mode of a model's inputs."""
    return f"{INPUT_VERSION}:{prefix_mode(model)}"


def query_input(query: str, model: str) -> str:
    return f"search_query: {query}" if model.lower() in PREFIX_MODELS else query


def target_identity(provider: str, model: str, published: dict, checkpoint_dimensions: int | None = None) -> dict:
    """The identity that the next vectors will have; dimensions are published ones of the same space, else a checkpoint's, else not known yet."""
    target = {"provider": provider, "model": model, "dimensions": None, "input_version": INPUT_VERSION, "prefix_mode": prefix_mode(model)}
    if identity_complete(published) and all(published[k] == target[k] for k in ("provider", "model", "input_version", "prefix_mode")):
        return target | {"dimensions": published["dimensions"]}
    return target | {"dimensions": checkpoint_dimensions if checkpoint_dimensions and checkpoint_dimensions > 0 else None}


# Fixed template of a chunk's input.
def embedding_input(path: Column, index: Column, text: Column, model: str) -> Column:
    name = F.element_at(F.split(path, "/"), -1)
    base = F.regexp_replace(name, r"^(.*?)\.md", "$1")  # the first ".md" anywhere
    body = F.concat(F.lit("Título: "), base, F.lit("\nCaminho: "), path, F.lit("\nBloco: "), index.cast("string"), F.lit("\nConteúdo:\n"), text)
    return F.concat(F.lit("search_document: "), body) if model.lower() in PREFIX_MODELS else body


# Fixed limits of a guarded read: largest file, amplification, largest peak, margin.
GUARDS = {"desktop": (96 << 20, 3, 192 << 20, 32 << 20), "mobile": (12 << 20, 5, 64 << 20, 8 << 20)}


def guarded(size: Column, profile: str) -> tuple[Column, Column]:
    """(peak bytes, allowed) of reading a file of so many bytes."""
    largest, times, peak, margin = GUARDS[profile]
    need = size * times + margin
    return need, (size >= 0) & (size <= largest) & (need <= peak)
