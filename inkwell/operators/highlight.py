"""Marked terms in texts: literal queries as HTML, and spans of whole words that hold a term."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from inkwell.functions import text as T

# The mark of a literal match, words that are never marked, and the shortest that is.
MARK = ('<mark style="background-color: var(--text-highlight-bg); color: inherit;">', "</mark>")
STOP_WORDS = ("de", "e", "a", "o", "do", "da", "em", "no", "na", "os", "as", "dos", "das", "ao", "aos", "para", "com", "por", "que", "se", "é", "um", "uma")
LEAST_TERM = 2
#: Letters that have a case, digits, underscore and hyphen.
WORD = r"[\p{Lu}\p{Ll}\p{Lt}0-9_-]"
#: Characters that part spans while they are found; texts don't hold them.
OPEN, CLOSE = "\ue000", "\ue001"


def html(text: Column, query: str) -> Column:
    """text with every occurrence of the query, whatever its case, in a mark; all of it unmarked if the query is blank."""
    if not query.strip():
        return text
    return F.regexp_replace(text, f"(?i)({T.escaped(query)})", f"{MARK[0]}$1{MARK[1]}")


def marked_terms(terms: Column) -> Column:
    """The terms that are marked: two letters or more, and no stop words."""
    plain = lambda t: F.lower(F.trim(t))
    return F.filter(terms, lambda t: (F.length(plain(t)) >= LEAST_TERM) & ~plain(t).isin(*STOP_WORDS))


def spans(text: Column, terms: list[str]) -> Column:
    """array<struct<text, mark>>: words that hold a term are marked, whatever its case; what lies between isn't. Empty spans are left out."""
    kept = [t for t in terms if len(t.strip()) >= LEAST_TERM and t.strip().lower() not in STOP_WORDS]
    if not kept:
        return F.array(F.struct(text.alias("text"), F.lit(False).alias("mark")))
    pattern = f"(?i)({WORD}*?(?:{'|'.join(map(T.escaped, kept))}){WORD}*)"
    pieces = F.split(F.regexp_replace(text, pattern, f"{OPEN}$1{CLOSE}"), f"[{OPEN}{CLOSE}]")
    return F.filter(F.transform(pieces, lambda p, i: F.struct(p.alias("text"), (i % 2 == 1).alias("mark"))), lambda s: s["text"] != "")
