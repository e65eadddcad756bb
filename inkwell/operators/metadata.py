"""Note metadata: tags, wiki links, frontmatter, folders, file names, snippets for display, commands, embedded JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkwell.functions import text as T

WS = f"[{T.SPACE}]+"
trim = T.trimmed


def normalise_tag(tag: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(T.strip_accents(F.lower(trim(tag))), WS, "_"), "[^a-z0-9_-]", "")


def normalise_tags(tags: Column) -> Column:
    return F.array_distinct(F.filter(F.transform(tags, normalise_tag), lambda t: t != ""))


def yaml_tags(value: Column) -> Column:
    """Tags of a YAML value: an inline list, or names with commas between."""

    def items(v: Column) -> Column:
        inside = F.transform(F.split(F.substring(v, F.lit(2), F.length(v) - 2), ","), lambda x: F.regexp_replace(trim(x), "^[\"']|[\"']$", ""))
        return F.when(v.startswith("[") & v.endswith("]"), inside).otherwise(F.transform(F.split(v, ","), trim))

    return normalise_tags(T.named(trim(value), items))


def tag_counts(tags: DataFrame) -> DataFrame:
    """tags (tag, n, ord) by normalised tag: total and the first original."""
    return tags.withColumn("key", normalise_tag(F.col("tag"))).where("key <> ''").groupBy("key").agg(F.sum("n").alias("uses"), F.min_by("tag", "ord").alias("original"))


def safe_path(path: Column) -> Column:
    return F.regexp_replace(F.lower(trim(F.replace(path, F.lit("\\"), F.lit("/")))), r"\.md$", "")


def bare_name(path: Column) -> Column:
    p = F.regexp_replace(trim(F.replace(path, F.lit("\\"), F.lit("/"))), r"(?i)\.md$", "")
    return F.coalesce(F.element_at(F.filter(F.concat(F.array(F.lit("")), F.split(p, "/")), lambda x: x != ""), -1), p)


def link_targets(text: Column) -> Column:
    """Distinct targets of wiki links: each as path and as bare name."""
    raw = F.filter(F.transform(F.regexp_extract_all(text, F.lit(r"\[\[([^|\]\n#]+)(?:#[^|\]\n]*)?(?:\|[^\]\n]+)?\]\]"), F.lit(1)), trim), lambda x: x != "")
    return F.array_distinct(F.flatten(F.transform(raw, lambda t: F.array(safe_path(t), safe_path(bare_name(t))))))


def front_and_body(text: Column) -> Column:
    """struct(has, front, body): a text split at the first two marks."""

    def parts(t: Column, end: Column) -> Column:
        has = t.startswith("---") & (end > 0)
        front, body = F.when(has, trim(F.substring(t, F.lit(4), end - 4))).otherwise(""), F.when(has, trim(F.substring(t, end + 3, F.length(t)))).otherwise(t)
        return F.struct(has.alias("has"), front.alias("front"), body.alias("body"))

    return T.named(trim(text), lambda t: T.named(F.locate("---", t, 4), lambda end: parts(t, end)))


def frontmatter(text: Column) -> tuple[Column, Column, Column]:
    """(has, frontmatter, body) split at the first two marks."""
    found = front_and_body(text)
    return found["has"], found["front"], found["body"]


def properties(front: Column) -> Column:
    """Lines ``key: value`` as a map; of a repeated key the last line counts."""
    lines = F.filter(F.transform(F.split(front, "\n"), trim), lambda x: ~x.startswith("- ") & (F.instr(x, ":") > 1))
    pairs = F.transform(lines, lambda x: F.struct(trim(F.substring_index(x, ":", 1)).alias("key"), trim(F.substring(x, F.instr(x, ":") + 1, F.length(x))).alias("value")))
    return F.map_from_entries(F.reverse(T.first_of_each(F.reverse(pairs))))


def folder_key(path: Column) -> Column:
    """Folder names compared without leading numbers, accents and separators."""
    parts = F.transform(F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/"), lambda p: F.regexp_replace(trim(p), rf"^\d+[{T.SPACE}_.-]*", ""))
    return F.regexp_replace(F.lower(T.strip_accents(F.array_join(parts, "/"))), "[^a-z0-9/]", "")


def last_segment(path: Column) -> Column:
    return F.coalesce(F.element_at(F.filter(F.concat(F.array(F.lit("")), F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/")), lambda p: trim(p) != ""), -1), F.lit(""))


def suggested_folder(folder: Column) -> Column:
    """A safe relative folder path, or null."""
    raw = trim(F.replace(trim(folder), F.lit("\\"), F.lit("/")))
    parts = F.filter(F.transform(F.split(F.regexp_replace(raw, "^/+", ""), "/"), trim), lambda p: p != "")
    bad = raw.rlike("^[a-zA-Z]:") | raw.rlike("^/{2,}") | raw.contains("..") | (F.size(parts) == 0) | F.exists(parts, lambda p: (p == ".") | p.rlike(r'[<>:"|?*\x00-\x1f]'))
    return F.when(~bad, F.array_join(parts, "/"))


def resolve_folders(suggested: DataFrame, existing: DataFrame) -> DataFrame:
    """suggested (id, folder) to the existing (folder, ord) that is equal, else to the first alike by full or last key.

    Alikeness is four key equalities, so both sides go out under both keys and meet in an equi-join.
    """
    keys = lambda c: F.explode(F.array_distinct(F.array(folder_key(c), folder_key(last_segment(c)))))
    s = suggested.select("id", F.col("folder").alias("wanted")).withColumn("key", keys(F.col("wanted")))
    e = existing.select("folder", "ord").withColumn("key", keys(F.col("folder")))
    hits = s.join(e, "key").groupBy("id").agg(F.min_by("folder", F.struct((F.col("folder") != F.col("wanted")).cast("int"), "ord")).alias("folder"))
    return suggested.select("id").join(hits, "id", "left")


def folder_candidates(folders: DataFrame, current: str, haystack: str, inbox: str = "", limit: int = 100, roots: int = 20) -> DataFrame:
    """Folders ranked as places for a note: the first roots by name, its own, then by score and name.

    A folder scores for being the note's own, a root, and for its last or whole key being in the note's
    text; keys leave out leading numbers, accents and separators. Inbox folders are left out.
    """
    f, h = F.col("folder"), folder_key(F.lit(haystack))
    full, seg = folder_key(f), folder_key(last_segment(f))
    taken_in = seg == "inbox"
    if inbox:
        taken_in = taken_in | full.isin(folder_key(F.lit(inbox)), folder_key(last_segment(F.lit(inbox)))) | seg.isin(folder_key(F.lit(inbox)), folder_key(last_segment(F.lit(inbox))))
    score = F.when(f == current, 100).otherwise(0) + F.when(~f.contains("/"), 30).otherwise(0) + F.when((seg != "") & h.contains(seg), 20).otherwise(0) + F.when((full != "") & h.contains(full), 30).otherwise(0)
    scored = folders.select("folder").distinct().where(~taken_in).select("folder", score.cast("int").alias("score"))
    root = ~f.contains("/")
    first = scored.where(root).orderBy(*T.in_order(f)).limit(roots).select("folder", F.lit(0).alias("place"))
    placed = scored.join(F.broadcast(first), "folder", "left").withColumn("place", F.when(F.col("place") == 0, 0).when(f == current, 1).otherwise(2))  # at most roots rows
    order = [F.asc("place"), *T.in_order(F.when(F.col("place") == 0, f)), F.desc("score"), *T.in_order(f)]
    return placed.orderBy(*order).limit(limit).withColumn("rank", F.row_number().over(Window.orderBy(*order)).cast("int")).select("rank", "folder", "score")


def kept_links(suggested: DataFrame, allowed: DataFrame) -> DataFrame:
    """suggested (source, target, ord) that are allowed (path), no self links, the first of each target kept."""
    s = suggested.withColumn("key", safe_path(F.col("target"))).where(F.col("key") != safe_path(F.col("source")))
    s = s.join(allowed.select(safe_path(F.col("path")).alias("key")).distinct(), "key", "left_semi")
    return s.groupBy("source", "key").agg(F.min_by("target", "ord").alias("target")).select("source", "target")


# Fixed list of words that stay in lower case within a title.
MINOR = (
    "e", "de", "do", "da", "dos", "das", "em", "no", "na", "num", "numa", "para", "pra", "pro", "a", "ao", "aos", "as", "o", "os", "um", "uns", "uma",
    "umas", "com", "por", "que", "se", "lhe", "lhes", "ou", "mas", "mais", "menos", "ser", "ter", "haver", "dar", "ir", "vir", "este", "esta",
    "estes", "estas", "esse", "essa", "esses", "essas", "aquele", "aquela", "aqueles", "aquelas",
)


def file_name(title: Column) -> Column:
    """A readable file name of at most 80 characters, or nothing."""
    base = T.collapse(F.regexp_replace(title, r'[<>:"/\\|?*]', " "))
    capital = lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, F.lit(2), F.length(w)))
    words = F.transform(F.split(base, " "), lambda w, i: F.when((i > 0) & F.lower(w).isin(*MINOR), F.lower(w)).otherwise(capital(w)))
    name = F.regexp_replace(F.substring(F.array_join(words, " "), 1, 80), r"\s+$", "")
    return T.named(name, lambda n: F.when(n == "", "").otherwise(F.concat(n, F.lit(".md"))))


def looks_like_frontmatter(snippet: Column) -> Column:
    def by_lines(t: Column, lines: Column) -> Column:
        yaml = F.size(F.filter(lines, lambda x: x.rlike(r"^[A-Za-zÀ-ÿ0-9_-]+:\s*") | x.startswith("- ")))
        inline = F.size(F.regexp_extract_all(t, F.lit(r"((?:^|\s)[A-Za-zÀ-ÿ0-9_-]+:\s+\S)"), F.lit(1)))
        return F.when(t == "", F.lit(False)).when(t.startswith("---"), F.lit(True)).when(F.size(lines) > 1, yaml >= F.greatest(F.lit(2), F.ceil(F.size(lines) * 0.6))).otherwise(inline >= 2)

    # As one element of an array, a text and its lines have names and are made once.
    lines = lambda t: F.filter(F.transform(F.split(t, "\n"), trim), lambda x: x != "")
    both = F.transform(F.array(trim(snippet)), lambda t: F.struct(t.alias("t"), lines(t).alias("lines")))
    return F.get(F.transform(both, lambda b: by_lines(b["t"], b["lines"])), F.lit(0))


def clean_snippet(snippet: Column) -> Column:
    return T.collapse(F.regexp_replace(F.regexp_replace(snippet, r"^---\s*", ""), r"---\s*$", ""))


def repeats_title(snippet: Column, title: Column) -> Column:
    """Whether a snippet says nothing but the title."""
    bare = lambda c: F.lower(T.collapse(F.regexp_replace(F.regexp_replace(c, r"(?i)\.md$", ""), r"^#+\s*", "")))
    return (bare(snippet) != "") & (bare(snippet) == bare(title))


# Fixed texts that stand for a snippet.
IN_METADATA, IN_NAME = "Correspondência encontrada nos metadados da nota.", "Correspondência encontrada no nome da nota."


def snippet_display(snippets: Column, title: Column, origin: Column, most: int = 280) -> Column:
    """struct(text, highlighted, fallback) of a card's snippets: the first that is neither frontmatter nor the title, else a text that says where the match is; null if there is nothing to show."""
    each = F.filter(F.transform(snippets, lambda s: F.struct(clean_snippet(s).alias("text"), looks_like_frontmatter(s).alias("front"), repeats_title(clean_snippet(s), title).alias("title"))), lambda s: s["text"] != "")
    as_struct = lambda text, marked: F.struct(text.alias("text"), F.lit(marked).alias("highlighted"), F.lit(not marked).alias("fallback"))

    def choice(rows: Column) -> Column:
        useful = F.get(F.filter(rows, lambda s: ~s["front"] & ~s["title"]), F.lit(0))["text"]
        shown = F.when(F.length(useful) > most, F.concat(F.substring(useful, 1, most), F.lit("..."))).otherwise(useful)
        named = F.exists(rows, lambda s: s["title"]) | (origin == "Nome")
        return F.when(useful.isNotNull(), as_struct(shown, True)).when(F.exists(rows, lambda s: s["front"]), as_struct(F.lit(IN_METADATA), False)).when(named, as_struct(F.lit(IN_NAME), False))

    # Patterns run once for each snippet: as the one element of an array, what they find has a name.
    return F.get(F.transform(F.array(each), choice), F.lit(0))


# Fixed list of reserved commands.
RESERVED = ("/search", "/ask", "/summarize", "/improve", "/rewrite", "/continue", "/tags", "/yaml", "/links", "/analyze", "/inbox", "/folder")


def parse_command(line: Column) -> tuple[Column, Column]:
    """(kind, argument) of an input line."""
    t = trim(line)
    parts = F.split(t, WS)
    command = F.lower(F.get(parts, F.lit(0)))
    rest = trim(F.array_join(F.slice(parts, 2, F.size(parts)), " "))
    slash = t.startswith("/")
    kind = F.when(~slash, "search").when(command == "/ask", "ask").when(command == "/tags", "tags").when(command == "/yaml", "yaml").when(command.isin(*RESERVED), "notImplemented").otherwise("unknown")
    return kind, F.when(~slash, t).when(command == "/ask", rest).when(command.isin("/tags", "/yaml"), F.lit("")).otherwise(command)


def embedded_json(text: Column) -> Column:
    """The JSON of a fenced block, else from the first to the last brace; null without any."""
    fenced, braces = F.regexp_extract(text, r"(?s)```json\s*(.*?)\s*```", 1), F.regexp_extract(text, r"(?s)\{.*\}", 0)
    good = lambda c: F.try_parse_json(c).isNotNull()
    return F.when((fenced != "") & good(fenced), fenced).when((braces != "") & good(braces), braces)


def folder_notes(notes: DataFrame, folder: str, excluded: Column, limit: int = 20) -> tuple[DataFrame, DataFrame]:
    """(newest notes of a folder, 1 to 20, one row of found, excluded and truncated counts)."""
    limit = min(20, max(1, limit))
    inside = notes.where(F.col("path").startswith(folder + "/")).withColumn("_x", excluded)
    totals = inside.agg(F.count(F.lit(1)).alias("found"), F.count_if("_x").alias("excluded"), F.greatest(F.count_if(~F.col("_x")) - limit, F.lit(0)).alias("truncated"))
    return inside.where(~F.col("_x")).drop("_x").orderBy(F.desc("mtime"), *T.in_order(F.col("path"))).limit(limit), totals


def availability(status: DataFrame, provider: str, model: str, input_version: int, prefix_mode: str) -> DataFrame:
    """status with availability of semantic search for a device's provider and model: the first problem found, or available.

    status: readability (missing, empty, unreadable, readable), provider, model, dimensions, input_version,
    prefix_mode (as published), valid (searchable records; null if they can't be counted here), source,
    fallback (of choose_source). Where records can't be counted, only a binary copy makes them available.
    """
    c = F.col
    incomplete = (F.coalesce(c("provider"), F.lit("")) == "") | (F.coalesce(c("model"), F.lit("")) == "") | (F.coalesce(c("dimensions"), F.lit(0)) == 0)
    same = (c("provider") == provider) & (c("model") == model) & c("input_version").eqNullSafe(F.lit(input_version)) & c("prefix_mode").eqNullSafe(F.lit(prefix_mode))
    uncounted = c("valid").isNull() | (c("readability") == "unreadable")
    unloaded = (
        F.when(c("source") == "binary", "available").when(c("fallback") == "binary-outdated", "binary-stale").when(c("fallback").isin("binary-invalid", "binary-read-failed"), "binary-invalid")
        .when(c("fallback") == "no-safe-source", "binary-required").otherwise("corpus-load-failed")
    )
    found = (
        F.when(c("readability") == "missing", "missing").when(incomplete, "incomplete").when(~same, "incompatible").when((c("readability") == "empty") | F.coalesce(c("valid") == 0, F.lit(False)), "empty")
        .when(uncounted, unloaded).otherwise("available")
    )
    return status.withColumn("availability", found)


def ranked(df: DataFrame, *order: Column) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.orderBy(*order)).cast("int"))
