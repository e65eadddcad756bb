"""A published index kept up to date by a stream of events and by reconciliation, with DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from inkwell.operators import chunking
from inkwell.plans.maintenance_queries import EV, events
from inkwell.plans.search_queries import CHUNKS
from inkwell.sources import publish
from inkwell.sources.notes import table
from inkwell.sources.shared import new_folder
from inkwell.streaming.events import Rules, apply_stream, catch_up, rebuild

#: Where the stream's batches are cut, the term that keeps texts out, and the beginning of paths that are kept out.
CUTS, TERM, FOLDER = ("2024-01-11", "2024-01-21"), "thanedble", "u/7"


def rules(s):
    chunk = lambda n: chunking.chunk_notes(n.withColumn("k", F.lit(0)), "k").drop("k")
    return Rules(F.col("path").startswith(FOLDER), F.lower("text").contains(TERM), chunk)


def hashed(rows):
    text = F.col("text")
    return rows.select("path", F.md5(text.cast("binary")).alias("hash"), F.octet_length(text).cast("long").alias("size"), F.lit(1).cast("long").alias("mtime"), "text")


def documents(s, d):
    return table(s, d, "documents").select("doc_id", F.concat(F.lit("u/"), F.col("doc_id").cast("string"), F.lit(".md")).alias("path"), F.coalesce("text", F.lit("")).alias("text"))


def vault(s, d):
    """Finds notes by path: all documents are there by the users' paths, and what users' renames have moved."""

    def of(wanted, mark):
        user, moved = F.concat(F.lit("u/"), F.col("user_id").cast("string")), F.col("event_id").cast("string")
        moves = table(s, d, "events").where("event_type = 'purchase'").select(F.concat(user, F.lit("-"), moved, F.lit(".md")).alias("path"), F.concat(user, F.lit(".md")).alias("source"))
        # The document that each path has its text from, so that documents take part in one join.
        sources = wanted.select("path", F.col("path").alias("source")).unionByName(moves.join(mark(wanted), "path", "left_semi"))
        return hashed(documents(s, d).select(F.col("path").alias("source"), "text").join(mark(sources), "source").select("path", "text"))

    return of


def before(s, d):
    """The notes that are indexed first: two thirds of the documents, every second one in another state than now."""
    text = F.when(F.col("doc_id") % 2 == 0, F.concat("text", F.lit(" before"))).otherwise(F.col("text"))
    return hashed(documents(s, d).where("doc_id % 3 <> 0").select("path", text.alias("text")))


def summary(s, root):
    """Per note of the index, what its chunks are."""
    own = publish.read(s, root, "chunks").groupBy("path").agg(F.count(F.lit(1)).alias("chunks"), F.sum(F.length("text")).alias("chars"), F.max_by(F.md5(F.col("text").cast("binary")), "chunk_index").alias("last_chunk"))
    return publish.read(s, root, "index").join(own, "path", "left").select("path", "hash", F.coalesce("chunks", F.lit(0).cast("long")).alias("chunks"), "chars", "last_chunk")


def applied_stream(s, d):
    """Index and chunks after a stream over all events, in three starts on one checkpoint."""
    folder = new_folder(s, "applied-stream")
    with publish.writer(s, f"{folder}/index", "rebuild") as own:
        rebuild(own, before(s, d), rules(s))
    rows, edges = events(s, d), [None, *CUTS, None]
    for low, high in zip(edges, edges[1:]):
        some = rows if low is None else rows.where(F.col("ts") >= low)
        some = some if high is None else some.where(F.col("ts") < high)
        some.select("seq", "type", "path", "old_path").write.mode("append").parquet(f"{folder}/events")
        stream = s.readStream.schema("seq long, type string, path string, old_path string").parquet(f"{folder}/events")
        query = apply_stream(stream, f"{folder}/index", vault(s, d), rules(s), f"{folder}/checkpoint").trigger(availableNow=True).start()
        query.awaitTermination()
    return summary(s, f"{folder}/index")


def caught_up(s, d):
    """Index and chunks after a reconciliation with all documents; sizes alone tell of changes."""
    root = new_folder(s, "caught-up")
    with publish.writer(s, root, "rebuild") as own:
        rebuild(own, before(s, d), rules(s))
    with publish.writer(s, root, "catch-up") as own:
        catch_up(own, hashed(documents(s, d).where("doc_id % 10 <> 4")), rules(s))
    return summary(s, root)


QUERIES = {"applied_stream": applied_stream, "caught_up": caught_up}

DOCS = "docs AS (SELECT doc_id, 'u/' || doc_id || '.md' AS path, coalesce(text, '') AS text FROM documents)"
START = f"""{DOCS}, v AS (SELECT path, text FROM docs UNION ALL SELECT e.path, docs.text FROM e JOIN docs ON e.user_id = docs.doc_id WHERE e.type = 'rename'),
s0 AS (SELECT path, text || CASE WHEN doc_id % 2 = 0 THEN ' before' ELSE '' END AS text FROM docs WHERE doc_id % 3 <> 0 AND NOT starts_with(path, '{FOLDER}') AND NOT contains(lower(text), '{TERM}'))"""
LAST = f"""{CHUNKS}, c AS (SELECT path, count(*) AS chunks, sum(length(text))::BIGINT AS chars, arg_max(md5(text), chunk_index) AS last_chunk FROM chunks GROUP BY path)
SELECT path, md5(notes.text) AS hash, coalesce(chunks, 0)::BIGINT AS chunks, chars, last_chunk FROM notes LEFT JOIN c USING (path)"""


def batch_sql(k: int, when: str) -> str:
    """State k after the events of some time, from state k - 1."""
    return f"""l{k} AS (SELECT coalesce(old_path, path) AS key, arg_max(type, seq) AS last, arg_max(path, seq) AS path, bool_or(type = 'rename') AS moves FROM e WHERE {when} GROUP BY 1),
k{k} AS (SELECT l.last AS type, l.path, CASE WHEN last = 'rename' THEN key END AS old_path, v.text, starts_with(l.path, '{FOLDER}') OR coalesce(contains(lower(v.text), '{TERM}'), false) AS out FROM l{k} l LEFT JOIN v ON v.path = l.path),
g{k} AS (SELECT path FROM k{k} WHERE type = 'delete' OR out OR text IS NOT NULL UNION SELECT old_path FROM k{k} WHERE old_path IS NOT NULL AND (out OR text IS NOT NULL)),
s{k} AS (SELECT * FROM s{k - 1} WHERE path NOT IN (SELECT path FROM g{k}) UNION SELECT path, text FROM k{k} WHERE type <> 'delete' AND NOT out AND text IS NOT NULL)"""


TIMES = (f"ts < '{CUTS[0]}'", f"ts >= '{CUTS[0]}' AND ts < '{CUTS[1]}'", f"ts >= '{CUTS[1]}'")
NUMBERED = "notes AS (SELECT row_number() OVER () AS doc_id, path, text FROM {})"

ORACLES = {
    "applied_stream": f"WITH RECURSIVE {EV}, {START}, " + ", ".join(batch_sql(k, when) for k, when in enumerate(TIMES, 1)) + f", {NUMBERED.format('s3')}, {LAST}",
    "caught_up": f"""WITH RECURSIVE {EV}, {START}, n AS (SELECT path, text FROM docs WHERE doc_id % 10 <> 4 AND NOT starts_with(path, '{FOLDER}')),
b AS (SELECT n.path, CASE WHEN s0.path IS NOT NULL AND octet_length(encode(s0.text)) = octet_length(encode(n.text)) THEN s0.text WHEN contains(lower(n.text), '{TERM}') THEN NULL ELSE n.text END AS text FROM n LEFT JOIN s0 USING (path)),
z AS (SELECT * FROM b WHERE text IS NOT NULL), {NUMBERED.format("z")}, {LAST}""",
}
