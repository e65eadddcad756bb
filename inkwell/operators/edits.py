"""Edits of Markdown notes: sections, titles, tasks, tags and properties, analysis, inserted blocks; and clean-up of structured results."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from inkwell.functions import text as T
from inkwell.operators import metadata as X

#: Headings of the sections that are written, as published; other installations have their own.
ANALYSIS, TASKS, LINKS = "## Analysis", "## Suggested tasks", "Selected internal links:"
# Fixed limits: characters of one note and of each of several in a prompt, suggested tags.
PROMPT_CHARS, BATCH_CHARS, MOST_TAGS = 8000, 4000, 8
TRUNCATED = "\n\n[truncated]"


def comparable(text: Column) -> Column:
    return F.lower(T.collapse(text))


def task_text(task: Column) -> Column:
    """A task without its box, to be compared."""
    return comparable(F.regexp_replace(task, r"^- \[[ xX]\]\s*", ""))


def section(text: Column, heading: str) -> Column:
    """From a heading to the next one of its level, or to the end; empty without it."""
    at = F.instr(text, heading)
    tail = F.substring(text, at, F.length(text))
    body = F.substring(tail, F.lit(len(heading) + 1), F.length(tail))
    return F.when(at == 0, "").otherwise(F.concat(F.lit(heading), F.regexp_replace(body, r"(?s)\n##\s+.*$", "")))


def generated(text: Column) -> Column:
    """Whether a note holds a section that was written for it."""
    return text.contains(ANALYSIS) | text.contains(TASKS)


def truncated(text: Column, most: int = PROMPT_CHARS) -> Column:
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit(TRUNCATED))).otherwise(text)


def existing_tags(text: Column) -> Column:
    """Tags of a note: those of its frontmatter, then #tags of the text, each once."""

    def tags(parts: Column) -> Column:
        listed = X.yaml_tags(F.coalesce(F.try_element_at(X.properties(parts["front"]), F.lit("tags")), F.lit("")))
        inline = F.regexp_extract_all(parts["body"], F.lit(r"(?:^|\s)#([\p{L}0-9_/-]*[\p{L}_/-][\p{L}0-9_/-]*)"), F.lit(1))
        return F.array_union(listed, X.normalise_tags(F.array_distinct(inline)))

    return T.named(X.front_and_body(text), tags)


def new_tags(selected: Column, existing: Column) -> Column:
    """Selected tags that the note lacks."""
    return F.array_except(X.normalise_tags(selected), existing)


def all_tags(existing: Column, selected: Column) -> Column:
    return F.array_union(existing, X.normalise_tags(selected))


def distinct_lines(lines: Column, key=comparable) -> Column:
    """Lines in order, the first of those that compare alike; blank ones are left out."""
    keyed = F.filter(F.transform(lines, lambda x: F.struct(key(x).alias("key"), x.alias("line"))), lambda s: s["key"] != "")
    return F.transform(T.first_of_each(keyed), lambda s: s["line"])


def kept_properties(yaml: Column, allowed: str) -> Column:
    """A map without keys that aren't in the list of names with commas between; tags go too, they are kept apart."""
    names = [n.strip().lower() for n in allowed.split(",")]
    return F.map_filter(yaml, lambda k, _: F.lower(k).isin(*names) & (F.lower(k) != "tags"))


def suggested_tags(tags: Column, yaml: Column, most: int = MOST_TAGS) -> Column:
    """A result's tags, or else those of its YAML; normalised, at most so many."""
    own = F.coalesce(tags, F.array().cast("array<string>"))
    recovered = X.yaml_tags(F.coalesce(F.try_element_at(yaml, F.lit("tags")), F.lit("")))
    return F.slice(F.when(F.size(own) == 0, recovered).otherwise(X.normalise_tags(own)), 1, most)


def inserted(text: Column, at: Column, block: Column) -> Column:
    """text with a block on lines of its own at an offset in code points."""
    before, after = F.substring(text, F.lit(1), at), F.substring(text, at + 1, F.length(text))
    return F.concat(before, F.when((before == "") | before.endswith("\n"), "").otherwise("\n"), block, F.lit("\n"), after)


def appended(text: Column, block: Column) -> Column:
    return inserted(text, F.length(text), block)


def replaced(text: Column, first: Column, last: Column, block: Column) -> Column:
    return F.concat(F.substring(text, F.lit(1), first), block, F.substring(text, last + 1, F.length(text)))


def offset(text: Column, line: Column, column: Column) -> Column:
    """The offset of a position (line and column from 0) in a text, at most its end."""
    lines = F.split(text, "\n")
    whole = F.aggregate(F.transform(F.slice(lines, 1, F.least(line, F.size(lines) - 1)), lambda x: F.length(x) + 1), F.lit(0), lambda a, b: a + b)
    return F.least(whole + column, F.length(text))


# ---- edits that go through the lines of a note, on Arrow batches ------------------------------------


def _frontmatter_end(lines: list[str]) -> int:
    """The number of lines of a frontmatter with its marks; 0 without one."""
    if not lines or lines[0].strip() != "---":
        return 0
    return next((i + 1 for i, line in enumerate(lines[1:], 1) if line.strip() == "---"), 0)


def with_title(text: str, title: str) -> str:
    lines = text.split("\n")
    start = _frontmatter_end(lines)
    at = next((i for i in range(start, len(lines)) if lines[i].strip().startswith("# ")), None)
    lines[start if at is None else at : start if at is None else at + 1] = [f"# {title}"]
    return "\n".join(lines)


@F.pandas_udf(StringType())
def set_title(text: pd.Series, title: pd.Series) -> pd.Series:
    """The first heading of the first level becomes the title; without one it comes first, after a frontmatter. Nulls stay null."""
    return pd.Series([None if t is None or n is None else with_title(t, n) for t, n in zip(text, title)])


def _task_key(task: str) -> str:
    return " ".join(re.sub(r"^- \[[ xX]\]\s*", "", task).split()).lower()


def with_tasks(text: str, tasks: list[str], heading: str = TASKS) -> str:
    here = heading in text
    done = {_task_key(line.strip()) for line in text[text.index(heading) :].split("\n") if re.match(r"- \[[ x]\]", line.strip())} if here else set()
    new: dict[str, str] = {}
    for task in tasks:
        if (key := _task_key(task)) and key not in done:
            new.setdefault(key, task)
    if not new:
        return text
    block = "\n".join(f"- [ ] {t}" for t in new.values())
    return f"{text}\n{block}" if here else f"{text}\n\n{heading}\n{block}\n"


@F.pandas_udf(StringType())
def add_tasks(text: pd.Series, tasks: pd.Series) -> pd.Series:
    """Tasks that the section of tasks lacks, each once and open; the section is made if there is none. Nulls stay null."""
    return pd.Series([None if t is None else with_tasks(t, [x for x in (k if k is not None else []) if x]) for t, k in zip(text, tasks)])


def with_properties(text: str, values: dict[str, str], tags: list[str]) -> str:
    """A note with properties that it lacks and, if there are new tags, its list of tags."""
    lines = text.split("\n")
    end = _frontmatter_end(lines)
    front, body = lines[1 : end - 1] if end else [], lines[end:]
    has = {k.strip(): v.strip() for k, _, v in (line.partition(":") for line in front if ":" in line and not line.strip().startswith("- "))}
    added = [f"{k}: {v}" for k, v in values.items() if not has.get(k)]
    if tags:
        kept, old, listing = [], [], False
        for line in front:
            bare = line.strip()
            if listing and bare.startswith("- "):
                old.append(bare[2:])
                continue
            listing = False
            if bare.startswith("tags:"):
                value = bare[5:].strip()
                old += [x.strip().strip("\"'") for x in value.strip("[]").split(",") if x.strip()]
                listing = not value
                continue
            kept.append(line)
        front = kept
        added += ["tags:", *(f"  - {t}" for t in dict.fromkeys([*map(_tag, old), *tags]) if t)]
    if not added:
        return text
    return "\n".join(["---", *front, *added, "---", *body])


def _tag(tag: str) -> str:
    bare = "".join(c for c in unicodedata.normalize("NFD", tag.strip().lower()) if not 0x300 <= ord(c) <= 0x36F)
    return re.sub(r"[^a-z0-9_-]", "", re.sub(r"\s+", "_", bare))


@F.pandas_udf(StringType())
def set_properties(text: pd.Series, keys: pd.Series, values: pd.Series, tags: pd.Series) -> pd.Series:
    """Properties (keys and values of one length) that a frontmatter lacks, and its tags with the new ones; a frontmatter is made if there is none. Nulls stay null."""
    some = lambda x: [] if x is None else list(x)
    return pd.Series([None if t is None else with_properties(t, dict(zip(some(k), some(v))), some(g)) for t, k, v, g in zip(text, keys, values, tags)])


def with_analysis(text: str, details: str, links: list[tuple[str, str]], heading: str = ANALYSIS) -> str:
    squeezed = lambda x: " ".join(x.split()).lower()
    at = text.find(heading)
    end = len(text) if at < 0 else next((at + len(heading) + m.start() for m in re.finditer(r"\n##\s+", text[at + len(heading) :])), len(text))
    own = "" if at < 0 else text[at:end]
    there = {m.lower().removesuffix(".md") for m in re.findall(r"\[\[([^|\]\n#]+)", own)}
    parts = [details] if details.strip() and squeezed(details) not in squeezed(own) else []
    new = {p.lower().removesuffix(".md"): (p, t) for p, t in reversed(links) if p.lower().removesuffix(".md") not in there}
    if new:
        parts.append(("\n" if parts else "") + LINKS)
        parts += [f"* [[{p.removesuffix('.md')}|{t}]]" for p, t in reversed(new.values())]
    if not parts:
        return text
    block = "\n".join(parts)
    if at < 0:
        return f"{text}\n\n{heading}\n{block}\n"
    return f"{text[:end].rstrip()}\n\n---\n{block}\n{text[end:]}"


@F.pandas_udf(StringType())
def add_analysis(text: pd.Series, details: pd.Series, paths: pd.Series, titles: pd.Series) -> pd.Series:
    """An analysis and links (paths and titles of one length) that the section lacks; the section is made if there is none. Nulls stay null."""
    some = lambda x: [] if x is None else list(x)
    return pd.Series([None if t is None else with_analysis(t, d or "", list(zip(some(p), some(n)))) for t, d, p, n in zip(text, details, paths, titles)])
