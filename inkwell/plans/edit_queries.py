"""Queries on marks, edits of notes, providers' messages and shown states, with DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from inkwell.functions import text as T
from inkwell.operators import edits as E
from inkwell.operators import highlight as H
from inkwell.operators import providers as P
from inkwell.plans.search_queries import HASH, NOTES, clean
from inkwell.sources.notes import notes, spread, table

TERMS = ["erth", "ng a", "de", "x"]
ALLOWED = "Status, type,tags , area"


def highlight_spans(s, d):
    n = notes(s, d).select("doc_id", H.spans(F.col("text"), TERMS).alias("spans"))
    marks = F.filter("spans", lambda x: x["mark"])
    return n.select("doc_id", F.size("spans").alias("spans"), F.size(marks).alias("marks"), F.array_join(F.transform(marks, lambda x: x["text"]), "|").alias("marked"))


def highlight_terms(s, d):
    words = F.split("p_name", " ")
    return table(s, d, "part").select("p_partkey", F.array_join(H.marked_terms(F.concat(words, F.array(F.lit("De"), F.lit("é"), F.lit("x"), F.lit(" um ")))), "|").alias("terms"))


def device_token(s, d):
    h = F.conv(F.greatest(T.code_point_hash("text"), F.lit(0)).cast("string"), 10, 36)  # -1 has no digits in the SQL: 0
    return notes(s, d).select("doc_id", F.lower(h).alias("token"))


def sections(s, d):
    k = F.col("doc_id")
    text = F.concat(F.when(k % 3 > 0, F.concat(F.lit("intro\n## Analysis\n"), F.col("text"), F.lit("\n"))).otherwise("none\n"), F.when(k % 2 == 0, "## Next\nrest").otherwise("### deeper\nrest"))
    return notes(s, d).select("doc_id", E.section(text, "## Analysis").alias("section"), E.generated(text).alias("generated"))


def comparable_tasks(s, d):
    task = F.concat(F.element_at(F.array(F.lit("- [ ] "), F.lit("- [x]  "), F.lit(""), F.lit("* ")), (F.col("c_custkey") % 4 + 1).cast("int")), F.lit("  Call\t"), F.upper("c_name"), F.lit(" \n now "))
    return table(s, d, "customer").select("c_custkey", E.comparable(task).alias("text"), E.task_text(task).alias("task"))


def prompt_texts(s, d):
    return notes(s, d).select("doc_id", E.truncated(F.col("text")).alias("one"), E.truncated(F.col("text"), E.BATCH_CHARS).alias("several"))


def tagged(s, d):
    """Notes with tags in a frontmatter (two of three) and in the whole text."""
    k = F.col("doc_id")
    return spread(notes(s, d)).select("doc_id", F.concat(F.when(k % 3 > 0, F.lit("---\ntags: [A b, 'Ç']\n---\n")).otherwise(""), F.col("text"), F.lit("\n#Côr #9 x#no #a_b #t"), (k % 4).cast("string")).alias("text"))


def note_tags(s, d):
    t = tagged(s, d).select("doc_id", F.filter(E.existing_tags(F.col("text")), lambda x: x.isin("a_b", "c", "cor", "9", "no", "t0", "t1", "t2", "t3")).alias("tags"))
    selected = F.array(F.lit("Cor"), F.lit("new one"), F.lit("T1"), F.lit("new one"))
    return t.select("doc_id", F.array_join("tags", "|").alias("existing"), F.array_join(E.new_tags(selected, F.col("tags")), "|").alias("new"), F.array_join(E.all_tags(F.col("tags"), selected), "|").alias("all"))


def distinct_lines(s, d):
    return spread(notes(s, d)).select("doc_id", F.array_join(E.distinct_lines(F.split("text", "\n")), "\n").alias("lines"))


def structured_results(s, d):
    k = F.col("event_id")
    yaml = F.create_map(F.lit("Status"), F.col("event_type"), F.lit("owner"), F.lit("me"), F.when(k % 2 == 0, "tags").otherwise("AREA"), F.concat(F.lit("[Ação, b c, "), k.cast("string"), F.lit("]")))
    tags = F.when(k % 3 == 0, F.array(*(F.concat(F.lit(f"T{i} "), F.col("event_type")) for i in range(10))))
    r = table(s, d, "events").select("event_id", E.kept_properties(yaml, ALLOWED).alias("yaml"), E.suggested_tags(tags, yaml).alias("tags"))
    return r.select("event_id", F.array_join(F.array_sort(F.map_keys("yaml")), "|").alias("keys"), F.array_join("tags", "|").alias("tags"))


def note_titles(s, d):
    k = F.col("doc_id")
    text = F.concat(F.when(k % 4 == 0, "---\na: 1\n---\n").when(k % 4 == 1, "---\n").otherwise(""), F.when(k % 3 == 0, "intro\n # Old\n# Second\n").otherwise("## sub\n"), F.lit("end"))
    return notes(s, d).select("doc_id", E.set_title(text, F.concat(F.lit("New "), k.cast("string"))).alias("text"))


def note_tasks(s, d):
    k = F.col("doc_id")
    text = F.when(k % 2 == 0, F.concat(F.col("basename"), F.lit(f"\n\n{E.TASKS}\n- [x] Call  Ana\n"))).otherwise(F.col("basename"))
    return notes(s, d).select("doc_id", E.add_tasks(text, F.when(k % 5 == 0, F.array(F.lit(" "), F.lit("call ana"))).otherwise(F.array(F.lit("call ana"), F.lit("Buy"), F.lit("- [ ] buy "), F.col("basename")))).alias("text"))


def note_properties(s, d):
    k = F.col("doc_id")
    text = F.when(k % 3 == 0, F.col("basename")).when(k % 3 == 1, F.lit("---\ntype: old\nstatus:\ntags: [A b]\n---\nbody")).otherwise("---\ntags:\n  - one\n  - B\nx: 1\n---\nbody")
    tags = F.when(k % 2 == 0, F.array(F.lit("one"), F.lit("two")))
    return notes(s, d).select("doc_id", E.set_properties(text, F.array(F.lit("type"), F.lit("status")), F.array(F.lit("note"), F.lit("open")), tags).alias("text"))


def note_analysis(s, d):
    k = F.col("doc_id")
    text = F.when(k % 3 == 0, F.col("basename")).when(k % 3 == 1, f"a\n{E.ANALYSIS}\nGood  Note\n* [[P/One|x]]\n\n## Next\nz").otherwise(f"{E.ANALYSIS}\n")
    return notes(s, d).select("doc_id", E.add_analysis(text, F.when(k % 2 == 0, "good note").otherwise(F.lit("")), F.array(F.lit("p/one.md"), F.lit("Q/Two.md"), F.lit("q/two")), F.array(F.lit("1"), F.lit("2"), F.lit("3"))).alias("text"))


def note_blocks(s, d):
    x, k = F.col("text"), F.col("doc_id")
    at = E.offset(x, (k % 4).cast("int"), (k % 7).cast("int"))
    block = F.lit("<block>")
    return notes(s, d).select("doc_id", at.cast("int").alias("offset"), F.md5(E.inserted(x, at, block).cast("binary")).alias("inserted"), F.md5(E.appended(x, block).cast("binary")).alias("appended"), F.md5(E.replaced(x, at, at + 5, block).cast("binary")).alias("replaced"))


def api_messages(s, d):
    k = F.col("event_id")
    quoted = F.concat(F.lit('"Bad  Bearer abc.d for '), F.col("event_type"), F.lit('"'))
    reply = (
        F.when(k % 7 == 0, F.concat(F.lit('{"error": {"detail": '), quoted, F.lit(', "message": {"x": "no"}}}'))).when(k % 7 == 1, F.concat(F.lit("[{}, {\"code\": "), quoted, F.lit("}]"))).when(k % 7 == 2, quoted)
        .when(k % 7 == 3, "{oops").when(k % 7 == 4, '{"other": "x"}').when(k % 7 == 5, F.concat(F.lit('{"code": 5, "message": ""}'))).otherwise(F.concat(F.lit('{"error": "model '), F.col("event_type"), F.lit(' not found, pull it"}')))
    )
    e = table(s, d, "events").select("event_id", P.api_message(reply).alias("message"), (F.lit(400) + k % 6).alias("status"))
    return e.select("event_id", "message", P.missing_model(F.col("message")).alias("no_model"), P.wrong_endpoint(F.col("status"), F.col("message")).alias("no_endpoint"))


def short_messages(s, d):
    said = F.concat(F.lit(" \n"), F.repeat(F.concat(F.col("event_type"), F.lit(" \t")), (F.col("event_id") % 90).cast("int")))
    return table(s, d, "events").select("event_id", P.short_message(said).alias("message"))


URLS = ["", "  ", "http://h:1/api/chat//", "http://h:1/api", "https://api.mistral.ai", "https://api.mistral.ai/v1/embeddings/", "https://m/v1/v1", "https://openrouter.ai/api/v1/embeddings/models", "https://OPENROUTER.ai", "http://localhost:11434/api/embed", "https://x/api/v1/api/v1"]


def base_urls(s, d):
    u = F.element_at(F.array(*map(F.lit, URLS)), (F.col("c_custkey") % len(URLS) + 1).cast("int"))
    return table(s, d, "customer").select("c_custkey", *(P.base_url(u, p).alias(p) for p in P.BASE_URLS), *(P.chosen_url(u, p).alias(f"chosen_{p}") for p in P.BASE_URLS))


def batch_sizes(s, d):
    k = F.col("c_custkey")
    v = F.when(k % 5 == 0, "many").when(k % 5 == 1, F.concat(k.cast("string"), F.lit(".9"))).when(k % 5 == 2, F.concat(F.lit("-"), k.cast("string"))).otherwise(k.cast("string"))
    count, percent = P.progress(k * 1.5, F.when(k % 4 > 0, F.lit(200)).when(k % 8 == 0, F.lit(0)))
    return table(s, d, "customer").select("c_custkey", P.batch_size(v).alias("inputs"), count.alias("done"), percent.alias("percentage"))


def shown_status(s, d):
    k = F.col("o_orderkey")
    pick = lambda names, by: F.element_at(F.array(*map(F.lit, names)), (by % len(names) + 1).cast("int"))
    operation, ready, work = pick(["idle", "idle", "idle", "running", "idle", "cancelling", "done"], k), k % 5 > 0, pick(["ready", "ready", "dirty", "error", "ready"], F.floor(k / 3))
    mode, detailed, available, built = pick(["incremental", "full-rebuild", "initial-build"], F.floor(k / 7)), F.when(k % 13 > 0, k % 11 > 0), k % 2 == 0, k % 3 > 0
    return table(s, d, "orders").select("o_orderkey", P.headline(operation, ready, work, mode, detailed, available).alias("headline"), F.array_join(P.actions(operation, ready, mode, detailed, built, available), "|").alias("actions"))


QUERIES = {
    "highlight_html": lambda s, d: notes(s, d).select("doc_id", H.html(F.col("text"), "erth.").alias("html")),
    "highlight_spans": highlight_spans, "highlight_terms": highlight_terms, "device_token": device_token, "sections": sections, "comparable_tasks": comparable_tasks, "prompt_texts": prompt_texts, "note_tags": note_tags,
    "distinct_lines": distinct_lines, "structured_results": structured_results, "note_titles": note_titles, "note_tasks": note_tasks, "note_properties": note_properties, "note_analysis": note_analysis, "note_blocks": note_blocks,
    "api_messages": api_messages, "short_messages": short_messages, "base_urls": base_urls, "batch_sizes": batch_sizes, "shown_status": shown_status,
}

W = r"[\p{Lu}\p{Ll}\p{Lt}0-9_-]"
MARKED = f"(?i)({W}*?(?:erth|ng a){W}*)"
SECTION = "CASE WHEN doc_id % 3 > 0 THEN 'intro' || chr(10) || '## Analysis' || chr(10) || text || chr(10) ELSE 'none' || chr(10) END"
FIRST = "list_filter(list_transform({x}, lambda v, i: CASE WHEN {k} <> '' AND list_position(list_transform({x}, lambda w: {kw}), {k}) = i THEN v END), lambda v: v IS NOT NULL)"
NL = "chr(10)"
ORACLES = {
    "highlight_html": f"SELECT doc_id, regexp_replace(text, '(erth\\.)', '{H.MARK[0]}\\1{H.MARK[1]}', 'gi') AS html FROM documents",
    "highlight_spans": f"WITH x AS (SELECT doc_id, regexp_extract_all(text, '{MARKED}', 1) AS m, list_filter(string_split_regex(regexp_replace(text, '{MARKED}', chr(57344), 'g'), chr(57344)), lambda t: t <> '') AS o FROM documents) SELECT doc_id, (len(m) + len(o))::INT AS spans, len(m)::INT AS marks, array_to_string(m, '|') AS marked FROM x",
    "highlight_terms": "SELECT p_partkey, array_to_string(list_filter(string_split(p_name, ' '), lambda t: length(t) >= 2 AND lower(t) NOT IN ('de', 'do', 'da', 'em', 'no', 'na', 'os', 'as', 'dos', 'das', 'ao', 'aos', 'para', 'com', 'por', 'que', 'se', 'um', 'uma')), '|') AS terms FROM part",
    "device_token": f"""WITH RECURSIVE h AS (SELECT doc_id, {HASH} AS v FROM documents), t(doc_id, v, s) AS (SELECT doc_id, v::BIGINT, '' FROM h UNION ALL SELECT doc_id, v // 36, substring('0123456789abcdefghijklmnopqrstuvwxyz', (v % 36 + 1)::BIGINT, 1) || s FROM t WHERE v > 0 OR s = '') SELECT doc_id, s AS token FROM t WHERE v = 0 AND s <> ''""",
    "sections": f"SELECT doc_id, CASE WHEN doc_id % 3 > 0 THEN '## Analysis' || {NL} || text || CASE WHEN doc_id % 2 = 0 THEN '' ELSE {NL} || '### deeper' || {NL} || 'rest' END ELSE '' END AS section, doc_id % 3 > 0 AS generated FROM documents",
    "comparable_tasks": f"WITH t AS (SELECT c_custkey, c_custkey % 4 AS k, lower({clean('c_name')}) AS n FROM customer) SELECT c_custkey, CASE k WHEN 0 THEN '- [ ] ' WHEN 1 THEN '- [x] ' WHEN 3 THEN '* ' ELSE '' END || 'call ' || n || ' now' AS text, CASE WHEN k = 3 THEN '* ' ELSE '' END || 'call ' || n || ' now' AS task FROM t",
    "prompt_texts": f"SELECT doc_id, {', '.join(f'CASE WHEN length(text) > {n} THEN substring(text, 1, {n}) || chr(10) || chr(10) || {chr(39)}[truncated]{chr(39)} ELSE text END AS {name}' for name, n in (('one', 8000), ('several', 4000)))} FROM documents",
    "note_tags": """WITH t AS (SELECT doc_id, CASE WHEN doc_id % 3 > 0 THEN ['a_b', 'c', 'cor'] ELSE ['cor', 'a_b'] END AS own, 't' || doc_id % 4 AS t, doc_id FROM documents), e AS (SELECT doc_id, list_append(own, t) AS e, t FROM t)
SELECT doc_id, array_to_string(e, '|') AS existing, CASE WHEN t = 't1' THEN 'new_one' ELSE 'new_one|t1' END AS new, array_to_string(e, '|') || CASE WHEN t = 't1' THEN '|new_one' ELSE '|new_one|t1' END AS all FROM e""",
    "distinct_lines": f"WITH l AS (SELECT doc_id, unnest(string_split(text, {NL})) AS v, generate_subscripts(string_split(text, {NL}), 1) AS i FROM documents), k AS (SELECT *, lower({clean('v')}) AS k FROM l), f AS (SELECT doc_id, arg_min(v, i) AS v, min(i) AS i FROM k WHERE k <> '' GROUP BY doc_id, k) SELECT doc_id, coalesce(string_agg(v, {NL} ORDER BY i), '') AS lines FROM documents LEFT JOIN f USING (doc_id) GROUP BY doc_id",
    "structured_results": "SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'Status' ELSE 'AREA|Status' END AS keys, CASE WHEN event_id % 3 = 0 THEN array_to_string(list_transform(generate_series(0, 7), lambda i: 't' || i || '_' || event_type), '|') WHEN event_id % 2 = 0 THEN 'acao|b_c|' || event_id ELSE '' END AS tags FROM events",
    "note_titles": f"""SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN '---' || {NL} || 'a: 1' || {NL} || '---' || {NL} WHEN 1 THEN CASE WHEN doc_id % 3 = 0 THEN '---' || {NL} ELSE '# New ' || doc_id || {NL} || '---' || {NL} END ELSE '' END
  || CASE WHEN doc_id % 3 = 0 THEN 'intro' || {NL} || '# New ' || doc_id || {NL} || '# Second' || {NL} ELSE CASE WHEN doc_id % 4 = 1 THEN '' ELSE '# New ' || doc_id || {NL} END || '## sub' || {NL} END || 'end' AS text FROM documents""",
    "note_tasks": f"""WITH {NOTES}, x AS (SELECT doc_id, basename, CASE WHEN doc_id % 2 = 0 THEN basename || {NL} || {NL} || '{E.TASKS}' || {NL} || '- [x] Call  Ana' || {NL} ELSE basename END AS t FROM notes)
SELECT doc_id, CASE WHEN doc_id % 2 = 0 AND doc_id % 5 = 0 THEN t WHEN doc_id % 2 = 0 THEN t || {NL} || '- [ ] Buy' || {NL} || '- [ ] ' || basename WHEN doc_id % 5 = 0 THEN t || {NL} || {NL} || '{E.TASKS}' || {NL} || '- [ ] call ana' || {NL} ELSE t || {NL} || {NL} || '{E.TASKS}' || {NL} || '- [ ] call ana' || {NL} || '- [ ] Buy' || {NL} || '- [ ] ' || basename || {NL} END AS text FROM x""",
    "note_properties": f"""WITH {NOTES} SELECT doc_id, array_to_string(CASE doc_id % 3
  WHEN 0 THEN ['---', 'type: note', 'status: open'] || CASE WHEN doc_id % 2 = 0 THEN ['tags:', '  - one', '  - two'] ELSE [] END || ['---', basename]
  WHEN 1 THEN ['---', 'type: old', 'status:'] || CASE WHEN doc_id % 2 = 0 THEN ['status: open', 'tags:', '  - a_b', '  - one', '  - two'] ELSE ['tags: [A b]', 'status: open'] END || ['---', 'body']
  ELSE CASE WHEN doc_id % 2 = 0 THEN ['---', 'x: 1', 'type: note', 'status: open', 'tags:', '  - one', '  - b', '  - two', '---', 'body'] ELSE ['---', 'tags:', '  - one', '  - B', 'x: 1', 'type: note', 'status: open', '---', 'body'] END END, {NL}) AS text FROM notes""",
    "note_analysis": f"""WITH {NOTES} SELECT doc_id, array_to_string(CASE doc_id % 3
  WHEN 0 THEN [basename, '', '{E.ANALYSIS}'] || CASE WHEN doc_id % 2 = 0 THEN ['good note', '', '{E.LINKS}'] ELSE ['{E.LINKS}'] END || ['* [[p/one|1]]', '* [[Q/Two|2]]', '']
  WHEN 1 THEN ['a', '{E.ANALYSIS}', 'Good  Note', '* [[P/One|x]]', '', '---', '{E.LINKS}', '* [[Q/Two|2]]', '', '## Next', 'z']
  ELSE ['{E.ANALYSIS}', '', '---'] || CASE WHEN doc_id % 2 = 0 THEN ['good note', '', '{E.LINKS}'] ELSE ['{E.LINKS}'] END || ['* [[p/one|1]]', '* [[Q/Two|2]]', ''] END, {NL}) AS text FROM notes""",
    "note_blocks": f"""WITH l AS (SELECT doc_id, text, string_split(text, {NL}) AS l, doc_id % 4 AS line, doc_id % 7 AS col FROM documents),
o AS (SELECT doc_id, text, least(coalesce(list_sum(list_transform(l[1:least(line, len(l) - 1)], lambda x: length(x) + 1)), 0) + col, length(text))::INT AS pos FROM l),
b AS (SELECT *, substring(text, 1, pos) AS before, substring(text, pos + 1) AS after FROM o)
SELECT doc_id, pos AS "offset", md5(before || CASE WHEN before = '' OR ends_with(before, {NL}) THEN '' ELSE {NL} END || '<block>' || {NL} || after) AS inserted, md5(text || CASE WHEN text = '' OR ends_with(text, {NL}) THEN '' ELSE {NL} END || '<block>' || {NL}) AS appended, md5(before || '<block>' || substring(text, pos + 6)) AS replaced FROM b""",
    "api_messages": """WITH m AS (SELECT event_id, event_id % 7 AS k, 400 + event_id % 6 AS status, CASE WHEN event_id % 7 < 3 THEN 'Bad Bearer [redacted] for ' || event_type WHEN event_id % 7 = 5 THEN '' WHEN event_id % 7 = 6 THEN 'model ' || event_type || ' not found, pull it' END AS message FROM events) SELECT event_id, message, k = 6 AS no_model, k <> 6 AND status IN (400, 404, 405, 422) AS no_endpoint FROM m""",
    "short_messages": f"WITH m AS (SELECT event_id, {clean('repeat(event_type || chr(32) || chr(9), (event_id % 90)::INT)')} AS t FROM events) SELECT event_id, CASE WHEN t = '' THEN NULL WHEN length(t) > 300 THEN substring(t, 1, 297) || '...' ELSE t END AS message FROM m",
    "base_urls": "WITH u(k, ollama, mistral, openrouter, known) AS (VALUES " + ", ".join(
        f"({i}, '{a}', '{b}', '{c}', {known})"
        for i, (a, b, c, known) in enumerate([
            ("http://localhost:11434", "https://api.mistral.ai/v1", "https://openrouter.ai/api/v1", "true"), ("http://localhost:11434", "https://api.mistral.ai/v1", "https://openrouter.ai/api/v1", "true"), ("http://h:1", "http://h:1/api/chat", "http://h:1/api/chat", "false"), ("http://h:1", "http://h:1/api", "http://h:1/api", "false"),
            ("https://api.mistral.ai", "https://api.mistral.ai/v1", "https://api.mistral.ai", "true"), ("https://api.mistral.ai/v1/embeddings", "https://api.mistral.ai/v1", "https://api.mistral.ai/v1", "true"), ("https://m/v1/v1", "https://m/v1", "https://m/v1/v1", "false"), ("https://openrouter.ai/api/v1/embeddings/models", "https://openrouter.ai/api/v1/embeddings/models", "https://openrouter.ai/api/v1", "true"),
            ("https://OPENROUTER.ai", "https://OPENROUTER.ai", "https://openrouter.ai/api/v1", "true"), ("http://localhost:11434", "http://localhost:11434/api/embed", "http://localhost:11434/api/embed", "true"), ("https://x/api/v1/api/v1", "https://x/api/v1/api/v1", "https://x/api/v1", "false"),
        ])
    ) + f"), r AS (SELECT k, ({URLS!r})[k + 1] AS raw, * EXCLUDE (k) FROM u) SELECT c_custkey, ollama, mistral, openrouter, " + ", ".join(f"CASE WHEN known THEN '{url}' ELSE raw END AS chosen_{p}" for p, url in P.BASE_URLS.items()) + f" FROM customer JOIN r ON c_custkey % {len(URLS)} = k",
    "batch_sizes": "SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN 10 WHEN 2 THEN 1 ELSE least(50, greatest(1, c_custkey)) END::INT AS inputs, (CASE WHEN c_custkey % 4 > 0 THEN least(floor(c_custkey * 1.5), 200) WHEN c_custkey % 8 = 0 THEN 0 ELSE floor(c_custkey * 1.5) END)::BIGINT AS done, CASE WHEN c_custkey % 4 > 0 THEN least(100, floor(c_custkey * 1.5 / 200 * 100)) END::INT AS percentage FROM customer",
    "shown_status": """WITH o AS (SELECT o_orderkey AS k, (['idle', 'idle', 'idle', 'running', 'idle', 'cancelling', 'done'])[o_orderkey % 7 + 1] AS op, o_orderkey % 5 > 0 AS ready, (['ready', 'ready', 'dirty', 'error', 'ready'])[o_orderkey // 3 % 5 + 1] AS work, (['incremental', 'full-rebuild', 'initial-build'])[o_orderkey // 7 % 3 + 1] AS mode,
  CASE WHEN o_orderkey % 13 > 0 THEN o_orderkey % 11 > 0 END AS detailed, o_orderkey % 2 = 0 AS available, o_orderkey % 3 > 0 AS built FROM orders)
SELECT k AS o_orderkey, CASE WHEN op IN ('running', 'cancelling') THEN 'operation-active' WHEN NOT ready THEN 'text-index-missing' WHEN work = 'error' THEN 'error' WHEN work = 'dirty' THEN 'dirty' WHEN mode = 'full-rebuild' THEN 'full-rebuild-required' WHEN detailed IS DISTINCT FROM true THEN 'details-unavailable' WHEN available THEN 'update-available' ELSE 'up-to-date' END AS headline,
  'refresh-status' || CASE WHEN op IN ('running', 'cancelling') THEN '|cancel' WHEN NOT ready THEN '' WHEN mode = 'full-rebuild' THEN '|rebuild' WHEN detailed IS NOT DISTINCT FROM false THEN '' WHEN NOT built AND mode <> 'incremental' THEN '|generate' WHEN available THEN '|update' ELSE '' END AS actions FROM o""",
}
