"""Fusion of keyword and vector hits, note cards and related notes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkwell.functions import text as T
from inkwell.operators import metadata, policy

# Fixed list of terms that don't count in hybrid queries.
STOP_TERMS = (
    "a", "e", "o", "em", "de", "do", "da", "ao", "os", "as", "um", "na", "no", "ne", "se", "te", "me", "lhe", "ou", "ir", "ei", "ai", "oi", "eu",
    "tu", "ele", "ela", "nos", "vos", "lhes", "su", "si", "ja", "já", "so", "só", "ma", "que", "com", "por", "pra", "pro", "num", "numa", "pela",
    "pelo", "pelas", "pelos", "aos", "nas", "nums", "mas", "mais", "dos", "das", "numas", "dum", "duma", "duns", "dumas", "ser", "ter", "dar", "vir",
    "ver", "vai", "foi", "sao", "são", "esta", "este", "pode", "tem", "têm", "for", "era", "sua", "seu", "seus", "suas", "ate", "até", "sob", "sem",
    "cada", "todo", "toda", "menos", "bem", "mal", "sim", "nao", "não", "como", "para", "sobre", "entre", "ainda", "apenas", "depois", "antes",
    "desde", "durante", "mediante", "conforme", "consoante",
)


def hybrid_terms(query: Column) -> Column:
    """The query's terms of three letters or more that are no stop terms, in order."""
    stop = F.array(*map(F.lit, STOP_TERMS))
    return F.filter(F.split(T.collapse(F.lower(query)), " "), lambda t: (F.length(t) >= 3) & ~F.array_contains(stop, t))


def prepared_query(query: str) -> str:
    kept = [t for t in query.lower().split() if len(t) >= 3 and t not in STOP_TERMS]
    return " ".join(kept) or query


def weights_of(text: float | None, semantic: float | None) -> tuple[float, float]:
    """Shares that sum to 1; invalid ones are 0.7 and 0.3."""
    good = lambda w, default: w if isinstance(w, (int, float)) and 0 <= w < float("inf") else default
    a, b = good(text, 0.7), good(semantic, 0.3)
    return (a / (a + b), b / (a + b)) if a + b > 0 else (0.7, 0.3)


def half_up(x: Column) -> Column:
    return F.floor(x + 0.5).cast("int")


# Fixed numbers of the scale.
def text_scale(score: Column, best: Column, only_stop: Column) -> Column:
    """A text score from 0 to 100 relative to the best."""
    raw = F.when((score < 15) | (best <= 15), 0.0).when(best < 30, score / best * 60).otherwise(score / best * 100)
    return half_up(F.least(F.lit(100.0), F.greatest(F.lit(0.0), F.when(only_stop, 0.0).otherwise(raw))))


def scale_text(hits: DataFrame) -> DataFrame:
    """Text hits (score, terms_found) with text_score; the best score is one row, joined to all."""
    stop = F.array(*map(F.lit, STOP_TERMS))
    only_stop = (F.size("terms_found") > 0) & F.forall("terms_found", lambda t: F.array_contains(stop, t))
    best = hits.agg(F.max("score").alias("_best"))
    return hits.crossJoin(F.broadcast(best)).withColumn("text_score", text_scale(F.col("score"), F.col("_best"), only_stop)).drop("_best")


def fuse(text_hits: DataFrame, semantic_hits: DataFrame, weights: tuple[float, float] = (0.7, 0.3), limit: int = 20) -> DataFrame:
    """Best row of each side per note (path), full outer, weighted.

    text_hits: path, text_score, origin, ord; semantic_hits: path, similarity, ord. Returns path, text_score,
    semantic_score, final_score, source, text_origin, rank.
    """
    first = lambda df, by: df.withColumn("_n", F.row_number().over(Window.partitionBy("path").orderBy(F.desc(by), "ord"))).where("_n = 1")
    t = first(text_hits, "text_score").select("path", "text_score", F.col("origin").alias("text_origin"))
    s = first(semantic_hits.withColumn("semantic_score", half_up(F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.col("similarity") * 100)))), "similarity").select("path", "semantic_score")
    both = t.join(s, "path", "full_outer")
    has_t, has_s = F.coalesce(F.col("text_score") > 0, F.lit(False)), F.coalesce(F.col("semantic_score") > 0, F.lit(False))
    x, y = F.col("text_score") / 100 * weights[0], F.col("semantic_score") / 100 * weights[1]
    final = F.when(has_t & has_s, half_up((x + y) * 100)).when(has_t, half_up(x * 100)).when(has_s, F.col("semantic_score")).otherwise(0)
    source = F.when(F.col("text_score").isNotNull() & F.col("semantic_score").isNotNull(), "hibrida").when(F.col("text_score").isNotNull(), "textual").otherwise("semantica")
    ordered = [F.desc("final_score"), F.desc_nulls_last("text_score"), F.desc(F.coalesce("semantic_score", F.lit(0))), *T.in_order(F.col("path"))]
    top = both.select("path", "text_score", "semantic_score", final.cast("int").alias("final_score"), source.alias("source"), "text_origin").orderBy(*ordered).limit(limit)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(*ordered)).cast("int"))


def note_cards(hits: DataFrame, limit: int = 20) -> DataFrame:
    """Hits (path, score, terms_found, total_terms, snippet, rank) grouped to a card per note."""
    rows = hits.withColumn("key", F.lower(F.trim(F.replace("path", F.lit("\\"), F.lit("/")))))
    item = F.struct("rank", "path", "score", "terms_found", "snippet")
    # A note has at most per-note many hits here, so a card's list is short.
    g = rows.groupBy("key").agg(F.array_sort(F.collect_list(item)).alias("items"), F.max("total_terms").alias("total_terms"), F.count(F.lit(1)).alias("chunk_count"))
    terms = F.array_distinct(F.flatten(F.transform("items", lambda i: i["terms_found"])))
    main = F.col("items")[0]
    others = F.array_distinct(F.filter(F.transform("items", lambda i: i["snippet"]), lambda s: s != F.get("items", F.lit(0))["snippet"]))
    cards = g.select("key", main["path"].alias("path"), main["score"].alias("score"), terms.alias("terms"), F.when(F.col("total_terms") > 0, F.size(terms) / F.col("total_terms")).otherwise(0.0).alias("coverage"), main["snippet"].alias("snippet"), F.slice(others, 1, 2).alias("extra"), "chunk_count", main["rank"].alias("best_rank"))
    return cards.orderBy(F.desc("score"), "best_rank").limit(limit)


def folder_of(path: Column) -> Column:
    return F.when(F.instr(path, "/") > 0, F.regexp_replace(path, "/[^/]*$", "")).otherwise("")


# Fixed factors.
def folder_multiplier(current: Column, related: Column) -> Column:
    """1.15 in the same folder, 1.05 under the same root, else 0.85."""
    a, b = F.lower(folder_of(current)), F.lower(folder_of(related))
    root = lambda f: F.coalesce(F.get(F.filter(F.split(f, "/"), lambda p: p != ""), F.lit(0)), F.lit(""))
    return F.when(a == b, 1.15).when((root(a) != "") & (root(a) == root(b)), 1.05).otherwise(0.85)


def title_penalty(title: Column) -> Column:
    t = F.lower(title)
    return F.when(F.replace(t, F.lit("_"), F.lit("-")).rlike(r"^\d{4}-\d{2}-\d{2}$"), 0.3).when(t.rlike("aluno|aluna|estudante|turma|grupo"), 0.5).when((F.length(t) <= 5) & t.rlike(r"^\d+$"), 0.4).otherwise(1.0)


# Fixed beginnings of headings that say nothing about a note.
GENERIC = ("## alunos", "## avaliação", "## turma", "### grupo")


def related_query(title: str, path: str, content: str) -> str:
    """What to search for to find notes like one: its title twice, its folders (names with digits, underscores or capitals only twice), and its first lines that say something."""
    folders = [p for p in path.split("/") if p and not p.endswith(".md") and p != title]
    marked = lambda p: p == p.upper() or "_" in p or any(c.isdecimal() for c in p)
    lines = [line for line in content[:500].split("\n") if len(line.strip()) > 10 and not line.strip().lower().startswith(GENERIC)]
    return " ".join([title, title, *(p for f in folders for p in [f] * (1 + marked(f))), " ".join(lines)])


# Fixed labels of reasons.
ORIGINS = {"nome": "title", "caminho": "path", "conteudo": "content"}


def related_reason(origin: Column, source: Column, multiplier: Column) -> Column:
    """Why a note is related: where its text matched, similar content, and its folder."""
    text = F.when(origin == "nome", ORIGINS["nome"]).when(origin == "caminho", ORIGINS["caminho"]).when(origin == "conteudo", ORIGINS["conteudo"])
    alike = F.when(source.isin("semantica", "hibrida") & ~F.coalesce(text == ORIGINS["conteudo"], F.lit(False)), "similar content")
    folder = F.when(multiplier >= 1.1, "same folder").when(multiplier > 1, "same area")
    said = F.concat_ws(" + ", text, alike, folder)
    return F.when(said == "", source).otherwise(said)


def related(fused: DataFrame, current: str, content: str = "", limit: int = 10) -> DataFrame:
    """Fused rows (path, final_score, source, text_origin) adjusted for folder and title: path, final_score, adjusted, reason, rank.

    The note itself, and those that its content links to by path or name, are left out.
    """
    title = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"(?i)\.md$", "")
    multiplier = folder_multiplier(F.lit(current), F.col("path"))
    adjusted = F.round(F.col("final_score") * multiplier * title_penalty(title), 6)
    targets = fused.sparkSession.range(1).select(F.explode(metadata.link_targets(F.lit(content))).alias("target"))
    rows = fused.where((metadata.safe_path(F.col("path")) != metadata.safe_path(F.lit(current))) & (F.col("final_score") >= 30))
    for key in (metadata.safe_path(F.col("path")), metadata.safe_path(metadata.bare_name(F.col("path")))):
        rows = rows.join(F.broadcast(targets), key == F.col("target"), "left_anti")  # one note's links
    rows = rows.withColumn("adjusted", adjusted).withColumn("reason", related_reason(F.col("text_origin"), F.col("source"), multiplier)).where("adjusted >= 25")
    best = rows.withColumn("_n", F.row_number().over(Window.partitionBy(F.lower("path")).orderBy(F.desc("adjusted"), "path"))).where("_n = 1")
    top = best.select("path", "final_score", "adjusted", "reason").orderBy(F.desc("adjusted"), "path").limit(limit)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("adjusted"), "path")).cast("int"))


def recheck(rows: DataFrame, notes: DataFrame, rules: policy.Exclusions) -> DataFrame:
    """Related rows whose notes (path, text) are still there and excluded neither by path nor by what they hold."""
    kept = rows.where(policy.exclusion_reason(F.col("path"), rules).isNull())
    texts = notes.select("path", "text").join(F.broadcast(kept.select("path")), "path", "left_semi")  # a result's few rows
    fine = texts.where(~policy.content_excluded(F.col("text"), rules.content_terms)).select("path")
    return kept.join(F.broadcast(fine), "path", "left_semi")
