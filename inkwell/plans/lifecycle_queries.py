"""Queries on the making of vectors and on resident copies, with DuckDB SQL."""

from __future__ import annotations

import hashlib

from pyspark.sql import functions as F

from inkwell.engine import SearchEngine
from inkwell.operators import generation as G
from inkwell.operators import maintenance as M
from inkwell.operators import providers as P
from inkwell.plans import maintenance_queries as Q
from inkwell.plans.search_queries import CHUNKS, MIXED, NOTES, chunks, fused_sql, text_hits_sql
from inkwell.sources import vectors_file
from inkwell.sources.notes import notes, table

REFUSED = "thanedble"


def inputs(s, d):
    return chunks(s, d).select("chunk_id", F.col("text").alias("input"))


def generated_vectors(s, d):
    v = G.embed_inputs(inputs(s, d), G.word_embedder(16, REFUSED), 16)
    total = F.aggregate(F.transform("embedding", lambda x, i: x.cast("double") * (i + 1)), F.lit(0.0), lambda a, b: a + b)
    return v.select("chunk_id", F.size("embedding").alias("length"), F.round(total, 3).alias("checksum"), "error", "fatal")


def stopped_vectors(s, d):
    """A provider whose vectors have other dimensions than expected stops every task."""
    return G.embed_inputs(inputs(s, d), G.word_embedder(8), 16).select("chunk_id", F.size("embedding").alias("length"), "error", "fatal")


def reply_orders(s, d):
    """Whether items of replies (orders) by index (lines) stand for every input once."""
    k = F.col("l_linenumber")
    index = F.when((F.col("l_orderkey") % 5 == 0) & (k == 2), 0).otherwise(k - 1)
    rows = table(s, d, "lineitem").select("l_orderkey", index.alias("index"))
    n = F.count(F.lit(1))
    return rows.groupBy("l_orderkey").agg(n.alias("items"), ((F.count_distinct("index") == n) & (F.min("index") == 0) & (F.max("index") == n - 1)).alias("valid"))


def query_inputs(s, d):
    e = table(s, d, "part")
    return e.select("p_partkey", *(F.concat(F.lit(M.query_input("", model)), F.col("p_name")).alias(name) for name, model in (("prefixed", "Nomic-Embed-Text"), ("plain", "mistral-embed"))), F.lit(M.input_format("nomic-embed-text-v2")).alias("format"))


def updated_entries(s, d):
    e = Q.entries(s, d).select("path", F.array(F.lit(1.0), F.lit(2.0)).alias("vector"), F.lit("old").alias("model"))
    new = G.update_entry(e, "o/000000007.md", [0.5], "new")
    return new.select("path", F.size("vector").alias("length"), "model")


def analysed_notes(s, d):
    def analyse(text: str) -> str:
        if REFUSED in text:
            raise ValueError("refused")
        return str(len(text.split()))

    return G.analyse_notes(notes(s, d), analyse, 4000)


def copy_limits(s, d):
    k = F.col("o_orderkey")
    n, dims, meta = k * 37, k % 5000 + 1, k * 2011
    return table(s, d, "orders").select("o_orderkey", *(vectors_file.limit_code(n, dims, meta, p).alias(p) for p in vectors_file.LIMITS))


SOUGHT = "the erth that and inst of the tion"


def engine(s, d, refuse=None) -> SearchEngine:
    """Over all notes and chunks, with vectors of the offline provider."""
    own = chunks(s, d)
    made = G.embed_inputs(own.select("chunk_id", F.col("text").alias("input")), G.word_embedder(16), 16).select("chunk_id", "embedding")
    return SearchEngine(notes(s, d), own, made.withColumn("ord", F.col("chunk_id")), G.word_embedder(16, refuse), "words", 16)


def semantic_chunks(s, d):
    return engine(s, d).search("semantic", SOUGHT).results.select("rank", F.round("similarity", 4).alias("similarity"), (F.length("snippet") <= 283).alias("short"))


def refused_semantic(s, d):
    """A provider that refuses the query leaves hybrid search with text alone."""
    return engine(s, d, "erth").search("hybrid", MIXED).results


def chosen_models(s, d):
    names = [m for _, _, m, _ in P.MODELS] + ["", "my-own"]
    k = F.col("c_custkey")
    name = F.element_at(F.array(*map(F.lit, names)), (k % len(names) + 1).cast("int"))
    return table(s, d, "customer").select("c_custkey", *(P.chosen_model(name, p, kind).alias(f"{p}_{kind}") for p in P.BASE_URLS for kind in ("embedding", "chat")))


QUERIES = {
    "semantic_chunks": semantic_chunks, "refused_semantic": refused_semantic, "chosen_models": chosen_models,
    "generated_vectors": generated_vectors, "stopped_vectors": stopped_vectors, "reply_orders": reply_orders, "query_inputs": query_inputs, "updated_entries": updated_entries, "analysed_notes": analysed_notes, "copy_limits": copy_limits,
}


def limit_sql(profile: str) -> str:
    m = vectors_file.LIMITS[profile]
    vec = "(n * dims * 4)"
    return f"""CASE WHEN n > {m.records} THEN 'binary-record-limit-exceeded' WHEN dims > {m.dimensions} THEN 'binary-dimension-limit-exceeded' WHEN {vec} > {m.vector_bytes} OR meta > {m.metadata_bytes} OR {vec} + meta > {m.total_bytes} THEN 'binary-resource-limit-exceeded'
  WHEN {vec} * 2 + meta + greatest(meta * 2, n * 384) + greatest({vec}, meta) + {m.reserve_bytes} > {m.peak_bytes} THEN 'binary-estimated-peak-limit-exceeded' END AS {profile}"""


def query_counts() -> dict[int, int]:
    digits = [int(hashlib.md5(w.encode()).hexdigest()[0], 16) + 1 for w in SOUGHT.split()]
    return {b: digits.count(b) for b in digits}


NAMES = [m for _, _, m, _ in P.MODELS] + ["", "my-own"]


def model_sql(provider: str, kind: str) -> str:
    own = [m for p, k, m, _ in P.MODELS if (p, k) == (provider, kind)]
    others = [m for p, k, m, _ in P.MODELS if k == kind and m not in own]
    default = P.EMBEDDING_MODELS[provider] if kind == "embedding" else (own or [""])[0]
    return f"CASE WHEN name = '' OR list_contains({others!r}::VARCHAR[], name) THEN '{default}' ELSE name END AS {provider}_{kind}"


ORACLES = {
    "semantic_chunks": f"""WITH RECURSIVE {NOTES}, {CHUNKS}, w AS (SELECT path, chunk_index, instr('0123456789abcdef', substring(md5(unnest(regexp_extract_all(lower(text), '[a-z0-9]+'))), 1, 1)) AS b FROM chunks), n AS (SELECT path, chunk_index, b, count(*) AS n FROM w GROUP BY ALL),
s AS (SELECT path, chunk_index, sum(n * CASE b {' '.join(f'WHEN {b} THEN {n}' for b, n in query_counts().items())} ELSE 0 END)::DOUBLE / sqrt(sum(n * n)) / sqrt({sum(n * n for n in query_counts().values())}) AS sim FROM n GROUP BY ALL),
k AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY round(sim, 6) DESC) AS k FROM s WHERE sim >= 0.3) SELECT row_number() OVER (ORDER BY sim DESC)::INT AS rank, round(sim, 4) AS similarity, true AS short FROM k WHERE k <= 3 ORDER BY sim DESC LIMIT 20""",
    "refused_semantic": f"WITH RECURSIVE {NOTES}, {CHUNKS}, {text_hits_sql(MIXED)}, sem AS (SELECT '' AS path, 0.0 AS similarity, 0 AS ord WHERE false), {fused_sql(20)} SELECT * FROM top",
    "chosen_models": f"WITH c AS (SELECT c_custkey, ({NAMES!r})[c_custkey % {len(NAMES)} + 1] AS name FROM customer) SELECT c_custkey, {', '.join(model_sql(p, k) for p in P.BASE_URLS for k in ('embedding', 'chat'))} FROM c",
    "generated_vectors": f"""WITH RECURSIVE {NOTES}, {CHUNKS}, c AS (SELECT path || '::' || chunk_index AS chunk_id, text, contains(text, '{REFUSED}') AS bad FROM chunks),
w AS (SELECT chunk_id, instr('0123456789abcdef', substring(md5(unnest(regexp_extract_all(lower(text), '[a-z0-9]+'))), 1, 1)) AS b FROM c WHERE NOT bad), n AS (SELECT chunk_id, b, count(*) AS n FROM w GROUP BY 1, 2),
t AS (SELECT chunk_id, sum(b * n)::DOUBLE / sqrt(sum(n * n)) AS s FROM n GROUP BY 1)
SELECT c.chunk_id, CASE WHEN bad THEN NULL ELSE 16 END AS length, CASE WHEN NOT bad THEN round(coalesce(s, 0.0), 3) END AS checksum, CASE WHEN bad THEN 'input-rejected' END AS error, false AS fatal FROM c LEFT JOIN t USING (chunk_id)""",
    "stopped_vectors": f"WITH RECURSIVE {NOTES}, {CHUNKS} SELECT path || '::' || chunk_index AS chunk_id, NULL::INT AS length, 'dimension-mismatch' AS error, true AS fatal FROM chunks",
    "reply_orders": "SELECT l_orderkey, count(*) AS items, count(DISTINCT i) = count(*) AND min(i) = 0 AND max(i) = count(*) - 1 AS valid FROM (SELECT l_orderkey, CASE WHEN l_orderkey % 5 = 0 AND l_linenumber = 2 THEN 0 ELSE l_linenumber - 1 END AS i FROM lineitem) GROUP BY l_orderkey",
    "query_inputs": "SELECT p_partkey, 'search_query: ' || p_name AS prefixed, p_name AS plain, '1:nomic-search-query-document' AS format FROM part",
    "updated_entries": f"WITH {Q.SNAP} SELECT path, CASE WHEN path = 'o/000000007.md' THEN 1 ELSE 2 END AS length, CASE WHEN path = 'o/000000007.md' THEN 'new' ELSE 'old' END AS model FROM i",
    "analysed_notes": f"WITH {NOTES}, t AS (SELECT path, substring(text, 1, 4000) AS t FROM notes) SELECT path, CASE WHEN NOT contains(t, '{REFUSED}') THEN len(regexp_extract_all(t, '[^\\s\\x0B\\x1c-\\x1f\\x{{85}}\\x{{a0}}]+'))::VARCHAR END AS result, CASE WHEN contains(t, '{REFUSED}') THEN 'refused' END AS error FROM t",
    "copy_limits": f"WITH o AS (SELECT o_orderkey, o_orderkey * 37 AS n, o_orderkey % 5000 + 1 AS dims, o_orderkey * 2011 AS meta FROM orders) SELECT o_orderkey, {limit_sql('desktop')}, {limit_sql('mobile')} FROM o",
}
