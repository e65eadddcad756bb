"""Queries on note metadata, with DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from inkwell.operators import metadata as X
from inkwell.plans.search_queries import NOTES, PARTS, clean
from inkwell.sources.notes import notes, part_notes, spread, table

#: Lines and folders that rows are made of, by number; what they become is computed from them in SQL as well.
COMMANDS = ["  olá {} ", "/ask  what {}  is", "/TAGS {}", "/yaml", "/Summarize {}", "/{} bar", "/"]
FOLDERS = ["a/{}", "C:\\{}", "x/../{}", " /{}\\sub/ ", "//{}", "a|{}", "  ", "./{}"]


def numbered(options: list[str], key, value):
    """One of the options by key, with the value in its gap."""
    return F.element_at(F.array(*(F.replace(F.lit(o), F.lit("{}"), value) for o in options)), (key % len(options) + 1).cast("int"))


def numbered_sql(options: list[str], key: str, value: str) -> str:
    quote = lambda x: "'" + x.replace("'", "''") + "'"
    return f"replace(([{', '.join(map(quote, options))}])[{key} % {len(options)} + 1], '{{}}', {value})"


def normalise_tags(s, d):
    return spread(part_notes(s, d)).select("p_partkey", F.array_join(X.yaml_tags(F.concat(F.lit("[Ção Téc, "), F.replace("path", F.lit("/"), F.lit(",")), F.lit(", 'x']"))), "|").alias("tags"))


def tag_counts(s, d):
    t = table(s, d, "part").select(F.explode(F.split("p_type", " ")).alias("tag"), F.lit(1).cast("long").alias("n"), F.col("p_partkey").alias("ord"))
    return X.tag_counts(t)


def linked(s, d):
    n = notes(s, d)
    k = F.col("doc_id")
    return n.select("doc_id", F.concat(F.lit("see [["), F.col("path"), F.lit("|x]] and [[Folder\\B"), (k % 5).cast("string"), F.lit("#head]] [[ ]] [[broken [["), F.col("path"), F.lit("]]")).alias("text"))


def front(s, d):
    k = F.col("doc_id")
    t = F.concat(F.when(k % 3 > 0, F.lit("\n---\ntitle: Doc ")).otherwise(F.lit("title: Doc ")), k.cast("string"), F.lit("\ntags: [A b, 'Ç']\n- item: no\ntitle: again\n---\nBody "), k.cast("string"), F.lit(" \n"))
    has, f, body = X.frontmatter(t)
    m = X.properties(f)
    return spread(table(s, d, "documents").select("doc_id")).select("doc_id", has.alias("has"), F.coalesce(F.try_element_at(m, F.lit("title")), F.lit("")).alias("title"), F.array_join(X.yaml_tags(F.coalesce(F.try_element_at(m, F.lit("tags")), F.lit(""))), "|").alias("tags"), F.size(m).alias("n"), body.alias("body"))


def json_extract(s, d):
    k = F.col("event_id") % 4
    t = F.when(k == 0, F.concat(F.lit("ok ```json\n"), F.col("props"), F.lit("\n``` {x}"))).when(k == 1, F.concat(F.lit("a "), F.col("props"), F.lit(" b"))).when(k == 2, "none").otherwise("{broken")
    return table(s, d, "events").select("event_id", F.get_json_object(X.embedded_json(t), "$.k").cast("int").alias("k"))


def filter_links(s, d):
    n = notes(s, d)
    c = n.select(F.col("path").alias("source"), F.explode(F.array(F.upper("path"), F.concat(F.lit("src1/en/doc-"), F.lpad((F.col("doc_id") % 40).cast("string"), 8, "0")), F.concat(F.lit("SRC1/en/doc-"), F.lpad((F.col("doc_id") % 40).cast("string"), 8, "0"), F.lit(".md")))).alias("target"))
    return X.kept_links(c.withColumn("ord", F.length("target")), n)


def folder_notes(s, d):
    top, totals = X.folder_notes(notes(s, d).select("path", "mtime"), "src1/en", F.col("path").rlike("7\\.md$"), 10)
    return top.crossJoin(totals)  # one row of totals


def semantic_availability(s, d):
    k = F.col("event_id")
    pick = lambda by, *names: F.element_at(F.array(*map(F.lit, names)), (by % len(names) + 1).cast("int"))
    r = table(s, d, "events").select(
        "event_id", pick(k, "readable", "readable", "missing", "unreadable", "empty", "readable", "readable").alias("readability"), pick(F.floor(k / 7), "ollama", "ollama", "ollama", "", "mistral").alias("provider"), pick(F.floor(k / 3), "m", "m", "m", "old").alias("model"),
        pick(F.floor(k / 5), "64", "64", "64", "0").cast("int").alias("dimensions"), F.when(k % 13 > 0, 1).alias("input_version"), pick(F.floor(k / 11), "none", "none", "none", "nomic-search-query-document").alias("prefix_mode"), F.when(k % 3 > 0, k % 5).alias("valid"),
        pick(F.floor(k / 2), "binary", "jsonl", "not-loaded").alias("source"), pick(F.floor(k / 4), "none", "binary-outdated", "binary-invalid", "no-safe-source", "binary-read-failed").alias("fallback"),
    )
    return X.availability(r, "ollama", "m", 1, "none").select("event_id", "availability")


def file_names(s, d):
    k = F.col("p_partkey")
    title = F.concat(F.when(k % 9 == 0, F.lit(" ")).otherwise(F.concat(F.lit(" O "), F.col("p_name"), F.lit(" DE a/b: "), F.lower("p_type"), F.lit("? "), F.repeat(F.lit("ção x "), (k % 12).cast("int")))))
    return spread(table(s, d, "part").select("p_partkey", "p_name", "p_type")).select("p_partkey", X.file_name(title).alias("name"))


def displays(s, d):
    n = notes(s, d)
    k = F.col("doc_id")
    first = F.when(k % 5 == 0, "---\nkey: x").when(k % 5 == 1, F.concat(F.lit("tags: [a]\ntype: "), F.col("basename"))).when(k % 5 == 2, F.concat(F.lit("# "), F.upper("basename"), F.lit(".md"))).when(k % 5 == 3, F.col("text")).otherwise("a: 1 b: 2")
    second = F.when(k % 3 == 0, F.expr("substring(text, 5)")).when(k % 3 == 1, " \n").otherwise("plain: text only")
    shown = X.snippet_display(F.array(first, second), F.col("basename"), F.when(k % 2 == 0, "Nome").otherwise("Conteúdo"))
    return n.select("doc_id", X.looks_like_frontmatter(first).alias("frontmatter"), shown["text"].alias("text"), shown["fallback"].alias("fallback"))


def resolved_folders(s, d):
    k, t = F.col("p_partkey"), F.col("p_type")
    existing = table(s, d, "part").select(F.concat(F.lit("01 - "), F.replace("p_type", F.lit(" "), F.lit("_"))).alias("folder")).distinct().withColumn("ord", F.xxhash64("folder") * 0 + F.length("folder"))
    wanted = F.when(k % 3 == 0, F.concat(F.lit("01 - "), F.replace(t, F.lit(" "), F.lit("_")))).when(k % 3 == 1, F.concat(F.lit("Zône/"), F.lower(t))).otherwise(F.col("p_name"))
    return X.resolve_folders(table(s, d, "part").select(k.alias("id"), wanted.alias("folder")), existing)


def commands(s, d):
    line = numbered(COMMANDS, F.col("event_id"), F.col("event_type"))
    kind, argument = X.parse_command(line)
    return table(s, d, "events").select("event_id", kind.alias("kind"), argument.alias("argument"))


def candidates(s, d):
    n = notes(s, d)
    folders = n.select(F.regexp_replace("path", "/[^/]*$", "").alias("folder")).unionByName(n.select(F.substring_index("path", "/", 1).alias("folder"))).unionByName(n.select(F.concat(F.lit("03_Inbox/"), F.substring_index("path", "/", 1)).alias("folder"))).unionByName(n.select(F.concat(F.substring_index("path", "/", 1), F.lit("/02 - Inbox")).alias("folder")))
    return X.folder_candidates(folders, "src1/en", "about src2 and Fr: src3/és", "03_Inbox/src1")


QUERIES = {
    "normalise_tags": normalise_tags, "tag_counts": tag_counts,
    "wikilinks": lambda s, d: linked(s, d).select("doc_id", F.array_join(X.link_targets(F.col("text")), " ").alias("targets")),
    "frontmatter": front, "json_extract": json_extract,
    "folder_key": lambda s, d: part_notes(s, d).select("p_partkey", X.folder_key(F.concat(F.lit("01 - Á/"), F.col("path"))).alias("key"), X.last_segment(F.col("path")).alias("segment")),
    "resolve_folder": resolved_folders,
    "suggested_folder": lambda s, d: table(s, d, "customer").select("c_custkey", X.suggested_folder(numbered(FOLDERS, F.col("c_custkey"), F.col("c_name"))).alias("path")),
    "folder_candidates": candidates, "folder_notes": folder_notes, "filter_links": filter_links, "readable_file_name": file_names, "snippet_display": displays, "parse_command": commands,
    "semantic_availability": semantic_availability,
}

tag = lambda x: f"regexp_replace(regexp_replace(strip_accents(lower(trim({x}))), '\\s+', '_', 'g'), '[^a-z0-9_-]', '', 'g')"
key = lambda x: f"regexp_replace(lower(strip_accents(array_to_string(list_transform(string_split({x}, '/'), lambda p: regexp_replace(trim(p), '^[0-9]+[\\s_.-]*', '')), '/'))), '[^a-z0-9/]', '', 'g')"
FRONT = r"""(trim({x}, ' ' || chr(10)) <> '' AND (starts_with(trim({x}, ' ' || chr(10)), '---') OR CASE WHEN len(list_filter(string_split({x}, chr(10)), lambda l: trim(l) <> '')) > 1
  THEN len(list_filter(string_split({x}, chr(10)), lambda l: regexp_matches(trim(l), '^[A-Za-zÀ-ÿ0-9_-]+:\s*') OR starts_with(trim(l), '- '))) >= greatest(2, ceil(len(list_filter(string_split({x}, chr(10)), lambda l: trim(l) <> '')) * 0.6))
  ELSE len(regexp_extract_all({x}, '((?:^|\s)[A-Za-zÀ-ÿ0-9_-]+:\s+\S)', 1)) >= 2 END))"""
CLEANED = clean(r"regexp_replace(regexp_replace({x}, '^---\s*', ''), '---\s*$', '')").replace("{", "{{").replace("}", "}}").replace("{{x}}", "{x}")
ORACLES = {
    "normalise_tags": f"WITH {PARTS}, t AS (SELECT p_partkey, list_filter(list_transform(list_concat(['Ção Téc'], string_split(replace(path, '/', ','), ','), ['x']), lambda x: {tag('x')}), lambda x: x <> '') AS t FROM parts) SELECT p_partkey, array_to_string(list_filter(t, lambda x, i: list_position(t, x) = i), '|') AS tags FROM t",
    "tag_counts": f"WITH t AS (SELECT unnest(string_split(p_type, ' ')) AS tag, p_partkey FROM part) SELECT {tag('tag')} AS key, count(*) AS uses, arg_min(tag, p_partkey) AS original FROM t GROUP BY 1",
    "wikilinks": f"WITH {NOTES} SELECT doc_id, regexp_replace(path, '.md$', '') || ' ' || basename || ' folder/b' || doc_id % 5 || ' b' || doc_id % 5 || ' broken [[' || regexp_replace(path, '.md$', '') AS targets FROM notes",
    "frontmatter": "SELECT doc_id, doc_id % 3 > 0 AS has, CASE WHEN doc_id % 3 > 0 THEN 'again' ELSE '' END AS title, CASE WHEN doc_id % 3 > 0 THEN 'a_b|c' ELSE '' END AS tags, CASE WHEN doc_id % 3 > 0 THEN 2 ELSE 0 END AS n, CASE WHEN doc_id % 3 > 0 THEN 'Body ' || doc_id ELSE 'title: Doc ' || doc_id || chr(10) || 'tags: [A b, ''Ç'']' || chr(10) || '- item: no' || chr(10) || 'title: again' || chr(10) || '---' || chr(10) || 'Body ' || doc_id END AS body FROM documents",
    "json_extract": "SELECT event_id, CASE WHEN event_id % 4 < 2 THEN (props->>'$.k')::INT END AS k FROM events",
    "folder_key": f"WITH {PARTS}, p AS (SELECT p_partkey, '01 - Á/' || path AS x, path FROM parts) SELECT p_partkey, {key('x')} AS key, string_split(path, '/')[-1] AS segment FROM p",
    "folder_notes": f"WITH {NOTES}, i AS (SELECT path, mtime, ends_with(path, '7.md') AS x FROM notes WHERE starts_with(path, 'src1/en/')) SELECT path, mtime, (SELECT count(*) FROM i) AS found, (SELECT count(*) FROM i WHERE x) AS excluded, (SELECT greatest(count(*) - 10, 0)::BIGINT FROM i WHERE NOT x) AS truncated FROM i WHERE NOT x ORDER BY mtime DESC, path COLLATE en_us, path LIMIT 10",
    "filter_links": f"WITH {NOTES}, t AS (SELECT path AS source, 'src1/en/doc-' || lpad((doc_id % 40)::VARCHAR, 8, '0') AS target FROM notes) SELECT source, target FROM t WHERE target || '.md' <> source AND target || '.md' IN (SELECT path FROM notes)",
    "resolve_folder": f"""WITH e AS (SELECT DISTINCT '01 - ' || replace(p_type, ' ', '_') AS folder FROM part), ek AS (SELECT DISTINCT folder, length(folder) AS ord, unnest([{key('folder')}, {key("string_split(folder, '/')[-1]")}]) AS k FROM e),
w AS (SELECT p_partkey AS id, CASE p_partkey % 3 WHEN 0 THEN '01 - ' || replace(p_type, ' ', '_') WHEN 1 THEN 'Zône/' || lower(p_type) ELSE p_name END AS wanted FROM part), wk AS (SELECT DISTINCT id, wanted, unnest([{key('wanted')}, {key("string_split(wanted, '/')[-1]")}]) AS k FROM w),
h AS (SELECT id, arg_min(folder, (folder <> wanted, ord)) AS folder FROM wk JOIN ek USING (k) GROUP BY id) SELECT id, folder FROM w LEFT JOIN h USING (id)""",
    "suggested_folder": f"""WITH f AS (SELECT c_custkey, trim(replace(trim({numbered_sql(FOLDERS, 'c_custkey', 'c_name')}), '\\', '/')) AS raw FROM customer), p AS (SELECT *, list_filter(list_transform(string_split(regexp_replace(raw, '^/+', ''), '/'), lambda x: trim(x)), lambda x: x <> '') AS parts FROM f)
SELECT c_custkey, CASE WHEN regexp_matches(raw, '^[a-zA-Z]:') OR starts_with(raw, '//') OR contains(raw, '..') OR len(parts) = 0 OR len(list_filter(parts, lambda x: x = '.' OR regexp_matches(x, '[<>:"|?*]'))) > 0 THEN NULL ELSE array_to_string(parts, '/') END AS path FROM p""",
    "folder_candidates": f"""WITH {NOTES}, f AS (SELECT DISTINCT regexp_replace(path, '/[^/]*$', '') AS folder FROM notes UNION SELECT split_part(path, '/', 1) FROM notes UNION SELECT '03_Inbox/' || split_part(path, '/', 1) FROM notes), h AS (SELECT {key("'about src2 and Fr: src3/és'")} AS h),
s AS (SELECT folder, CASE WHEN folder = 'src1/en' THEN 100 ELSE 0 END + CASE WHEN contains(folder, '/') THEN 0 ELSE 30 END + CASE WHEN contains(h, {key("string_split(folder, '/')[-1]")}) THEN 20 ELSE 0 END + CASE WHEN contains(h, {key('folder')}) THEN 30 ELSE 0 END AS score FROM f, h WHERE folder NOT IN ('src1', '03_Inbox/src1')),
r AS (SELECT *, CASE WHEN contains(folder, '/') THEN NULL ELSE row_number() OVER (PARTITION BY contains(folder, '/') ORDER BY folder COLLATE en_us, folder) END AS n FROM s),
o AS (SELECT *, CASE WHEN n <= 20 THEN 0 WHEN folder = 'src1/en' THEN 1 ELSE 2 END AS place FROM r)
SELECT row_number() OVER (ORDER BY place, CASE WHEN place = 0 THEN folder END COLLATE en_us, score DESC, folder COLLATE en_us, folder)::INT AS rank, folder, score::INT AS score FROM o ORDER BY rank LIMIT 100""",
    "readable_file_name": f"""WITH t AS (SELECT p_partkey, {clean("regexp_replace(CASE WHEN p_partkey % 9 = 0 THEN ' ' ELSE ' O ' || p_name || ' DE a/b: ' || lower(p_type) || '? ' || repeat('ção x ', (p_partkey % 12)::INT) END, '[<>:/|?*]', ' ', 'g')")} AS b FROM part),
w AS (SELECT p_partkey, regexp_replace(substring(array_to_string(list_transform(string_split(b, ' '), lambda x, i: CASE WHEN i > 1 AND list_contains({list(X.MINOR)!r}, lower(x)) THEN lower(x) ELSE upper(substring(x, 1, 1)) || substring(x, 2) END), ' '), 1, 80), '\\s+$', '') AS n FROM t) SELECT p_partkey, CASE WHEN n = '' THEN '' ELSE n || '.md' END AS name FROM w""",
    "snippet_display": f"""WITH {NOTES}, x AS (SELECT doc_id, basename, doc_id % 2 = 0 AS named, CASE doc_id % 5 WHEN 0 THEN '---' || chr(10) || 'key: x' WHEN 1 THEN 'tags: [a]' || chr(10) || 'type: ' || basename WHEN 2 THEN '# ' || upper(basename) || '.md' WHEN 3 THEN text ELSE 'a: 1 b: 2' END AS a,
  CASE doc_id % 3 WHEN 0 THEN substring(text, 5) WHEN 1 THEN ' ' || chr(10) ELSE 'plain: text only' END AS b FROM notes), e AS (SELECT *, {FRONT.format(x="a")} AS fa, {FRONT.format(x="b")} AS fb, {CLEANED.format(x="a")} AS ca, {CLEANED.format(x="b")} AS cb FROM x),
r AS (SELECT *, ca <> '' AND lower(regexp_replace(regexp_replace(ca, '(?i)\\.md$', ''), '^#+\\s*', '')) = lower(basename) AS ra FROM e),
u AS (SELECT *, CASE WHEN ca <> '' AND NOT fa AND NOT ra THEN ca WHEN cb <> '' AND NOT fb THEN cb END AS use FROM r)
SELECT doc_id, fa AS frontmatter, CASE WHEN use IS NOT NULL THEN CASE WHEN length(use) > 280 THEN substring(use, 1, 280) || '...' ELSE use END WHEN (fa AND ca <> '') OR (fb AND cb <> '') THEN '{X.IN_METADATA}' WHEN ra OR named THEN '{X.IN_NAME}' END AS text,
  CASE WHEN use IS NOT NULL THEN false WHEN (fa AND ca <> '') OR (fb AND cb <> '') OR ra OR named THEN true END AS fallback FROM u""",
    "parse_command": f"""WITH l AS (SELECT event_id, trim({numbered_sql(COMMANDS, 'event_id', 'event_type')}) AS t FROM events), p AS (SELECT *, string_split_regex(t, '\\s+') AS w FROM l), c AS (SELECT *, lower(w[1]) AS c FROM p)
SELECT event_id, CASE WHEN NOT starts_with(t, '/') THEN 'search' WHEN c IN ('/ask', '/tags', '/yaml') THEN substring(c, 2) WHEN list_contains({list(X.RESERVED)!r}, c) THEN 'notImplemented' ELSE 'unknown' END AS kind,
  CASE WHEN NOT starts_with(t, '/') THEN t WHEN c = '/ask' THEN array_to_string(w[2:], ' ') WHEN c IN ('/tags', '/yaml') THEN '' ELSE c END AS argument FROM c""",
    "semantic_availability": """WITH e AS (SELECT event_id, event_id AS k, (['readable', 'readable', 'missing', 'unreadable', 'empty', 'readable', 'readable'])[event_id % 7 + 1] AS r, (['ollama', 'ollama', 'ollama', '', 'mistral'])[event_id // 7 % 5 + 1] AS p, (['m', 'm', 'm', 'old'])[event_id // 3 % 4 + 1] AS m,
  event_id // 5 % 4 = 3 AS flat, event_id % 13 = 0 OR event_id // 11 % 4 = 3 AS other, CASE WHEN event_id % 3 > 0 THEN event_id % 5 END AS valid, event_id // 2 % 3 = 0 AS copied, (['corpus-load-failed', 'binary-stale', 'binary-invalid', 'binary-required', 'binary-invalid'])[event_id // 4 % 5 + 1] AS why FROM events)
SELECT event_id, CASE WHEN r = 'missing' THEN 'missing' WHEN p = '' OR flat THEN 'incomplete' WHEN p <> 'ollama' OR m <> 'm' OR other THEN 'incompatible' WHEN r = 'empty' OR valid = 0 THEN 'empty' WHEN valid IS NULL OR r = 'unreadable' THEN CASE WHEN copied THEN 'available' ELSE why END ELSE 'available' END AS availability FROM e""",
}
