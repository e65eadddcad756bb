"""Keyword search: prefix and word matches scored per chunk, best chunks per note, name and path hits."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkwell.functions import text as T

# Fixed weights of word, prefix and substring matches.
NAME, PATH, CHUNK = (34, 12, 4), (16, 7, 2), (12, 5, 1)
KEYS = "tags?|tipo|projeto|area|contexto|estado"


def padded(normalised: Column) -> Column:
    """The words of a normalised text, each with a space of its own on both sides."""
    return F.concat(F.lit(" "), F.regexp_replace(normalised, "[^a-z0-9]+", "  "), F.lit(" "))


def match_counts(spaced: Column, term: str) -> Column:
    """Words of a padded text equal to the term, else starting with it, else containing it; string functions only, no arrays of words."""
    gone = lambda piece: F.length(spaced) - F.length(F.replace(spaced, F.lit(piece), F.lit("")))
    word = F.floor(gone(f" {term} ") / (len(term) + 2)).cast("int")
    start = F.floor(gone(f" {term}") / (len(term) + 1)).cast("int")
    # The term is found in more places than beginnings of words only if a word has it further on: patterns run for such texts alone.
    rest = F.regexp_replace(spaced, f" {term}[a-z0-9]*", " ")
    further = F.floor(gone(term) / len(term)).cast("int") > start
    inside = F.when(further, F.size(F.regexp_extract_all(rest, F.lit(f"([a-z0-9]+?{term}[a-z0-9]*)"), F.lit(1)))).otherwise(0)
    as_struct = lambda a, b, c: F.struct(a.alias("word"), b.alias("prefix"), c.alias("substr"))
    return F.when(spaced.contains(term), as_struct(word, start - word, inside)).otherwise(as_struct(*[F.lit(0)] * 3))


def any_match(m: Column) -> Column:
    return (m["word"] + m["prefix"] + m["substr"]) > 0


def term_score(m: Column, weights: tuple[int, int, int]) -> Column:
    return F.least(m["word"], F.lit(3)) * weights[0] + F.least(m["prefix"], F.lit(2)) * weights[1] + F.least(m["substr"], F.lit(2)) * weights[2]


def total(columns: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a + b, columns, F.lit(0))


def phrase(normalised: Column, terms_text: str) -> Column:
    pattern = r"\s+".join(map(T.escaped, terms_text.split()))
    words = reduce(lambda a, b: a & b, [normalised.contains(w) for w in dict.fromkeys(terms_text.split())], F.lit(True))
    return words & normalised.rlike(f"(^|[^a-z0-9]){pattern}([^a-z0-9]|$)")


def window_hit(normalised: Column, marker: str, within: int, matched_words: list[tuple[str, Column]], boundary: bool, needs: Sequence[Sequence[str]]) -> Column:
    """A term inside the slice of so many characters from a marker's match on; terms count where their condition holds.

    needs: texts of which a match of the marker has one each; the pattern runs only where they are.
    """
    starts = F.regexp_extract_all(normalised, F.lit(f"(?s)(?={marker})(?=(.{{1,{within}}}))"), F.lit(1))  # zero-width: slices overlap

    def inside(piece: Column) -> Column:
        hits = [cond & (piece.rlike(f"(^|[^a-z0-9_]){t}($|[^a-z0-9_])") if boundary else piece.contains(t)) for t, cond in matched_words]
        return reduce(lambda a, b: a | b, hits, F.lit(False))

    return F.when(reduce(lambda a, b: a & b, [reduce(lambda a, b: a | b, [normalised.contains(x) for x in some]) for some in needs]) & normalised.rlike(marker), F.exists(starts, inside)).otherwise(False)


def score_chunks(chunks: DataFrame, query: str) -> DataFrame:
    """chunks (…, text) with score, matched (count of terms), coverage and terms_found; chunks without a match are dropped."""
    terms = T.terms_of(query)
    distinct = list(dict.fromkeys(terms))
    # A matching word contains the term, so the text does, or has a letter that isn't ASCII: cheap, and before any normalising.
    lower = F.lower("text")
    some = chunks.where(reduce(lambda a, b: a | b, [lower.contains(t) for t in distinct]) | (F.octet_length("text") != F.length("text")))
    # Exploded, a normalised text is made once; a filter on it would be moved to where it is made, and make it again.
    matching = F.filter(F.array(T.normalise(F.col("text"))), lambda x: reduce(lambda a, b: a | b, [x.contains(t) for t in distinct]))
    norm = some.withColumn("_norm", F.explode(matching)).withColumn("_spaced", padded(F.col("_norm")))
    m = norm.select("*", *(match_counts(F.col("_spaced"), t).alias(f"_m{i}") for i, t in enumerate(distinct)))
    at = {t: F.col(f"_m{i}") for i, t in enumerate(distinct)}
    each = [at[t] for t in terms]
    matched = total([F.when(any_match(c), 1).otherwise(0) for c in each])
    full = [(t, c["word"] > 0) for t, c in at.items()]
    heading = window_hit(F.col("_norm"), r"(?:^|\s)#{1,6}\s+", 160, full, True, [["#"]])
    tagged = F.when(F.col("_norm").contains("#"), reduce(lambda a, b: a | b, [cond & F.col("_norm").rlike(f"(^|\\s)#{t}($|[^a-z0-9_])") for t, cond in full], F.lit(False))).otherwise(False)
    keyed = window_hit(F.col("_norm"), rf"(?:^|\s)[a-z0-9_-]*(?:{KEYS})[a-z0-9_-]*:\s*", 180, full, False, [[":"], ["tag", *KEYS.split("|")[1:]]])
    score = (
        total([term_score(c, CHUNK) for c in each])
        + F.when(phrase(F.col("_norm"), T.normalise_value(query)), 14).otherwise(0)
        + F.when(heading, 22).otherwise(0)
        + F.when(tagged | keyed, 20).otherwise(0)
        + F.floor(F.lit(8) * F.col("matched") / len(terms) + 0.5)
    )
    found = F.array_compact(F.array(*(F.when(any_match(c), F.lit(t)) for t, c in zip(terms, each))))
    hits = m.withColumn("matched", matched)  # over 0, by the filter above
    return hits.select(*chunks.columns, score.cast("int").alias("score"), F.col("matched").cast("int").alias("matched"), (F.col("matched") / len(terms)).alias("coverage"), found.alias("terms_found"))


def name_hits(notes: DataFrame, query: str) -> DataFrame:
    """notes (…, basename, path) that match by name or path: score, origin, matched, terms_found."""
    terms, wanted, n = T.terms_of(query), T.normalise_value(query), len(T.terms_of(query))
    a = notes.withColumn("_name", T.normalise(F.col("basename"))).withColumn("_path", T.normalise(F.col("path")))
    # A term in a text is in one of its words, so these are the rows with a match.
    a = a.where(reduce(lambda x, y: x | y, [F.col(c).contains(t) for t in terms for c in ("_name", "_path")]))
    a = a.withColumn("_nw", padded(F.col("_name"))).withColumn("_pw", padded(F.col("_path")))
    a = a.select("*", *(match_counts(F.col("_nw"), t).alias(f"_n{i}") for i, t in enumerate(terms)), *(match_counts(F.col("_pw"), t).alias(f"_p{i}") for i, t in enumerate(terms)))
    of = lambda k: [F.col(f"_{k}{i}") for i in range(n)]
    count = lambda k: total([F.when(any_match(c), 1).otherwise(0) for c in of(k)])
    a = a.withColumn("_nn", count("n")).withColumn("_pn", count("p"))
    a = a.withColumn("_nraw", total([term_score(c, NAME) for c in of("n")])).withColumn("_praw", total([term_score(c, PATH) for c in of("p")]))
    # Fixed numbers of the score.
    half_up = lambda x: F.floor(x + 0.5).cast("int")
    in_path = phrase(F.col("_path"), wanted)
    score = (
        F.when(F.col("_name") == wanted, 120)
        .when(F.col("_nn") == n, F.col("_nraw") + F.when(phrase(F.col("_name"), wanted), 24).otherwise(0) + 14)
        .when(F.col("_nn") >= 2, half_up(F.col("_nraw") + 10 * F.col("_nn") / n))
        .when(F.col("_nn") == 1, F.col("_nraw"))
        .when(in_path, F.col("_praw") + 12)
        .when(F.col("_pn") > 0, half_up(F.col("_praw") + 6 * F.col("_pn") / n))
    )
    named = (F.col("_name") == wanted) | (F.col("_nn") > 0)
    matched = F.when(F.col("_name") == wanted, n).when(F.col("_nn") > 0, F.col("_nn")).when(in_path & (F.col("_pn") == 0), n).otherwise(F.col("_pn"))
    every = F.array(*map(F.lit, terms))
    by = lambda k: F.array_compact(F.array(*(F.when(any_match(c), F.lit(t)) for t, c in zip(terms, of(k)))))
    found = F.when(F.col("_name") == wanted, every).when(F.col("_nn") > 0, by("n")).when(in_path & (F.col("_pn") == 0), every).otherwise(by("p"))
    return a.select(*notes.columns, score.cast("int").alias("score"), F.when(named, "nome").otherwise("caminho").alias("origin"), matched.cast("int").alias("matched"), found.alias("terms_found"))


def last_notes(notes: DataFrame) -> DataFrame:
    """One note of each path, whatever its case: the last by path."""
    return notes.groupBy(F.lower("path").alias("_key")).agg(F.max(F.struct("path", "basename")).alias("_n")).select("_key", "_n.path", "_n.basename")


def search_text(notes: DataFrame, chunks: DataFrame, query: str, per_note: int = 3, limit: int = 30) -> DataFrame:
    """Name, path and chunk hits, best first: path, chunk_id, origin, score, matched, coverage, terms_found, snippet, rank.

    Chunks meet their notes by path in lower case and get the note's path; chunks without a note are
    dropped. The note side of the join carries names only, and only scored chunks meet it; the ranking
    takes per-note tops by a window that is limited before its shuffle.
    """
    terms = T.terms_of(query)
    if not terms:
        return notes.sparkSession.createDataFrame([], "path string, chunk_id string, origin string, score int, matched int, coverage double, terms_found array<string>, snippet string, rank int")
    shown = F.when(F.col("origin") == "nome", F.col("basename")).otherwise(F.col("path"))
    names = name_hits(notes.select("path", "basename"), query).select("path", F.lit(None).cast("string").alias("chunk_id"), "origin", "score", "matched", (F.col("matched") / len(terms)).alias("coverage"), "terms_found", shown.alias("snippet"))
    scored = score_chunks(chunks.select("path", "chunk_index", "chunk_id", "text"), query).withColumn("_key", F.lower("path")).drop("path")
    best = Window.partitionBy("_key").orderBy(F.desc("score"), "chunk_index")
    hits = scored.withColumn("_n", F.row_number().over(best)).where(F.col("_n") <= per_note).join(last_notes(notes), "_key")
    content = hits.select("path", "chunk_id", F.lit("conteudo").alias("origin"), "score", "matched", "coverage", "terms_found", F.col("text").alias("snippet"))
    place = F.when(F.col("origin") == "nome", 0).when(F.col("origin") == "caminho", 1).otherwise(2)
    ordered = [F.desc("score"), F.desc("coverage"), place.asc(), *T.in_order(F.col("path")), F.asc_nulls_first("chunk_id")]
    top = names.unionByName(content).orderBy(*ordered).limit(limit)
    # Snippets are cut from the texts that are left.
    top = top.withColumn("snippet", F.when(F.col("origin") == "conteudo", T.snippet(F.col("snippet"), query)).otherwise(F.col("snippet")))
    return top.withColumn("rank", F.row_number().over(Window.orderBy(*ordered)).cast("int"))
