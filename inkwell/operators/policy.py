"""Exclusion rules for paths and contents, and the filters built on them."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkwell.functions.text import collapse

# Folders that are never indexed, and the default terms.
OPERATIONAL, CONFIG = ".inkwell/", ".obsidian/"
DEFAULT_FOLDERS = ("03_Pessoal/",)
DEFAULT_TERMS = ("senha", "senhas", "password", "passwords", "palavra-passe", "palavras-passe", "wifi", "wi-fi", "token", "tokens", "secret", "secrets", "api key", "api-key", "chave", "chaves")


@dataclass(frozen=True)
class Exclusions:
    folders: tuple[str, ...] = DEFAULT_FOLDERS
    path_terms: tuple[str, ...] = DEFAULT_TERMS
    content_terms: tuple[str, ...] = ()


def path_tokens(path: Column) -> Column:
    return F.filter(F.split(F.lower(path), "[^a-z0-9]+"), lambda x: x != "")


def exclusion_reason(path: Column, rules: Exclusions) -> Column:
    """The first rule that excludes the path, or null."""
    lower = F.lower(path)
    branches = [(lower.startswith(f.lower()), f"mandatory:{f}") for f in (OPERATIONAL, CONFIG)]
    branches += [(lower.startswith(f.lower()), f"folder:{f}") for f in rules.folders]
    for term in rules.path_terms:
        wanted = term.lower().strip()
        if " " in wanted or "-" in wanted:
            branches.append((F.replace(lower, F.lit("-"), F.lit(" ")).contains(wanted.replace("-", " ")), f"compound:{term}"))
        elif wanted:
            branches.append((F.array_contains(path_tokens(path), wanted), f"term:{term}"))
    return reduce(lambda found, b: F.when(b[0], F.lit(b[1])).otherwise(found), reversed(branches), F.lit(None).cast("string"))


def content_excluded(text: Column, terms: tuple[str, ...]) -> Column:
    wanted = [t.lower().strip() for t in terms if t.strip()]
    return reduce(lambda x, t: x | F.lower(text).contains(t), wanted, F.lit(False))


def parse_lines(setting: Column) -> Column:
    """A setting of one term a line: trimmed, without empties, each once in order."""
    return F.array_distinct(F.filter(F.transform(F.split(setting, "\n"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), lambda x: x != ""))


def parse_terms(setting: Column) -> Column:
    """The same, also split at commas and semicolons."""
    return F.array_distinct(F.filter(F.transform(F.split(setting, "[\n,;]"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), lambda x: x != ""))


def in_prefix(path: Column, prefix: str) -> Column:
    return (F.lower(path) == prefix) | F.lower(path).startswith(prefix + "/")


def event_path(path: Column) -> Column:
    """Trimmed, backslashes and slash runs to one slash, none at either end; null where nothing is left."""
    cleaned = F.trim(F.regexp_replace(F.regexp_replace(F.trim(path), r"[\\/]+", "/"), "^/+|/+$", ""))
    return F.when(cleaned == "", F.lit(None)).otherwise(cleaned)


def ignore_reason(path: Column, config: str = ".obsidian") -> Column:
    """Why a change event is none of ours, or null."""
    p = F.lower(event_path(path))
    return (
        F.when(p.isNull(), "missing-path")
        .when(p.contains(".tmp-") | p.contains(".bak-") | p.endswith(".tmp"), "temporary-file")
        .when(in_prefix(p, ".inkwell") | in_prefix(p, config), "internal-path")
    )


def is_markdown(path: Column) -> Column:
    return F.lower(path).endswith(".md")


def safe_chunks(chunks: DataFrame, rules: Exclusions) -> DataFrame:
    return chunks.where(exclusion_reason(F.col("path"), rules).isNull() & ~content_excluded(F.col("text"), rules.content_terms))


def safe_notes(notes: DataFrame, chunks: DataFrame, rules: Exclusions) -> DataFrame:
    """Notes allowed by path that keep a chunk, or never had one; without content terms every allowed note."""
    allowed = notes.where(exclusion_reason(F.col("path"), rules).isNull())
    if not rules.content_terms:
        return allowed
    state = chunks.groupBy("path").agg(F.max(~content_excluded(F.col("text"), rules.content_terms)).alias("_kept"))
    return allowed.join(state, "path", "left").where(F.coalesce("_kept", F.lit(True))).drop("_kept")


# Fixed patterns of what is redacted.
def redacted(message: Column) -> Column:
    """Messages on one line without bearer tokens and keys, at most 220 characters."""
    line = collapse(message)
    line = F.regexp_replace(line, r"(?i)Bearer\s+[A-Za-z0-9._~+/=-]+", "Bearer [redacted]")
    line = F.regexp_replace(line, r"(?i)api[_ -]?key\s*[:=]\s*[A-Za-z0-9._~+/=-]+", "api key [redacted]")
    return F.when(F.length(line) > 220, F.concat(F.substring(line, 1, 217), F.lit("..."))).otherwise(line)


# Fixed classes of statuses, and those that are one input's own fault.
STATUSES = {401: "authentication", 403: "authorization", 404: "model-not-found", 408: "timeout", 413: "input-rejected", 429: "rate-limit"}
OWN_FAULT = ("input-rejected",)


def http_category(status: Column) -> Column:
    found = F.when(status >= 500, "connection").otherwise("unknown")
    return reduce(lambda c, kv: F.when(status == kv[0], kv[1]).otherwise(c), STATUSES.items(), found)
