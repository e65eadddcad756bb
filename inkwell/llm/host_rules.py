"""Quality rules whose verdicts are made for whole hosts, in DataFrame functions only.

Each document is measured by rules; failures are summed by host; hosts' failure rates are shrunk
towards the corpus by a beta prior fitted to all hosts (method of moments); hosts whose shrunk rate
is too high are rejected, and that verdict is joined back to their documents.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkwell.llm.common import cut, whole_text

#: White space of the word rule, and the symbols counted.
WORD, SPACE, SYMBOLS = r"[^\x20\x09-\x0D]+", " \t\n\x0b\x0c\r", "#*$%&|<>"
WINDOW = 5


@dataclass(frozen=True)
class HostRules:
    min_words: int = 10
    max_repeat_percent: int = 20
    #: Further rules count for hosts only.
    max_symbol_percent: int = 10
    max_dup_line_percent: int = 30
    #: A host goes when its shrunk failure rate is above this.
    max_host_rate: float = 0.5
    #: Bounds of the prior's weight in documents.
    prior_weight: tuple[float, float] = (1.0, 1000.0)


def repeat_words(windows: Column) -> Column:
    """Words inside windows that occur twice or more, from an array of (hash, position) in hash order."""
    at = lambda j: F.get(windows, j)["h"]
    again = F.filter(F.sequence(F.lit(0), F.size(windows) - 1), lambda j: F.coalesce(at(j) == at(j - 1), F.lit(False)) | F.coalesce(at(j) == at(j + 1), F.lit(False)))
    starts = F.array_sort(F.transform(again, lambda j: F.get(windows, j)["i"]))
    done = F.aggregate(
        starts,
        F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")),
        lambda s, i: F.struct((s["n"] + i + WINDOW - F.greatest(s["end"], i)).alias("n"), (i + WINDOW).alias("end")),
    )
    return done["n"].cast("long")


def measures(docs: DataFrame) -> DataFrame:
    """doc_id, source and the counts of every whole text (null: no words), one row per row of docs."""
    blank = lambda c: F.length(F.translate(c, SPACE, "")) > 0
    text = docs.select("doc_id", "source", whole_text().alias("text"))
    words = text.select(
        "doc_id",
        "source",
        F.regexp_extract_all("text", F.lit(WORD), F.lit(0)).alias("words"),
        F.length(F.translate("text", SPACE, "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        F.filter(F.split("text", "\n"), blank).alias("lines"),
    )
    counts = words.select(
        "doc_id",
        "source",
        F.size("words").cast("long").alias("n_words"),
        "word_chars",
        "n_symbols",
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.transform("words", lambda w: F.xxhash64(w)).alias("hashes"),
    )
    each = F.sequence(F.lit(0), F.size("hashes") - WINDOW)
    of = lambda i: F.xxhash64(*(F.get("hashes", i + k) for k in range(WINDOW)))
    rolled = counts.withColumn("rolled", F.when(F.size("hashes") >= WINDOW, F.transform(each, of)).otherwise(F.array().cast("array<bigint>"))).drop("hashes")
    # Texts without any repeat, nearly all, need no sorting.
    repeated = F.size(F.array_distinct("rolled")) < F.size("rolled")
    pairs = F.when(repeated, F.sort_array(F.transform("rolled", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))
    paired = rolled.withColumn("windows", pairs).drop("rolled")
    return paired.withColumn("n_repeat_words", F.when(F.col("windows").isNull(), F.lit(0).cast("long")).otherwise(repeat_words(F.col("windows")))).drop("windows")


def host_rates(measured: DataFrame, rules: HostRules) -> DataFrame:
    """Per host: documents, failures, shrunk failure rate and verdict. One row for documents without a host."""
    hosts = measured.groupBy("source").agg(F.count(F.lit(1)).alias("n_docs"), F.sum(F.col("failed").cast("long")).alias("n_failed"))
    rate = F.col("n_failed") / F.col("n_docs")
    overall = hosts.agg((F.sum("n_failed") / F.sum("n_docs")).alias("mean"), F.sum("n_docs").alias("all_docs"))
    hosts = hosts.crossJoin(F.broadcast(overall))  # one row
    spread = hosts.agg((F.sum(F.col("n_docs") * (rate - F.col("mean")) * (rate - F.col("mean"))) / F.max("all_docs")).alias("spread"))
    low, high = rules.prior_weight
    weight = F.when(F.col("spread") > 0, F.greatest(F.lit(low), F.least(F.lit(high), F.col("mean") * (1 - F.col("mean")) / F.col("spread") - 1))).otherwise(F.lit(high))
    hosts = hosts.crossJoin(F.broadcast(spread)).withColumn("weight", weight)  # one row
    shrunk = (F.col("n_failed") + F.col("weight") * F.col("mean")) / (F.col("n_docs") + F.col("weight"))
    return hosts.select("source", "n_docs", "n_failed", shrunk.alias("host_rate"), (shrunk > rules.max_host_rate).alias("host_rejected"))


def apply_host_rules(docs: DataFrame, rules: HostRules = HostRules()) -> DataFrame:
    """Counts, base verdict, host rate and final verdict for every row of docs (doc_id, text, source).

    Null text: no words, so base_failed. Null source: those documents form one host of their own.
    Repeated rows are judged alike; an empty table gives no rows. Extra columns are left out.
    """
    base = (F.col("n_words") < rules.min_words) | (100 * F.col("n_repeat_words") > rules.max_repeat_percent * F.col("n_words"))
    further = (100 * F.col("n_symbols") > rules.max_symbol_percent * F.col("word_chars")) | (100 * F.col("n_dup_lines") > rules.max_dup_line_percent * F.col("n_lines"))
    measured = cut(measures(docs).withColumn("base_failed", base).withColumn("failed", base | further), "host-measures")
    hosts = host_rates(measured, rules).withColumnRenamed("source", "host")
    # Digest columns only; a hot host is split by AQE if the hosts are too many to broadcast.
    joined = measured.join(hosts.select("host", "host_rate", "host_rejected"), F.col("source").eqNullSafe(F.col("host")), "left")
    return joined.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & ~F.col("host_rejected")).alias("kept"))


ORACLE = r"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words,
             list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM t),
g AS (SELECT r, i, list_slice(words, i, i + 4) AS win FROM (SELECT r, words, unnest(generate_series(1, len(words) - 4)) AS i FROM w)),
d AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, win) AS n FROM g) WHERE n >= 2),
c AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(generate_series(i, i + 4)) AS p FROM d) GROUP BY r),
m AS (SELECT doc_id, source, len(words)::BIGINT AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
             length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols, len(lines)::BIGINT AS n_lines,
             (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(c.n, 0)::BIGINT AS n_repeat_words
      FROM w LEFT JOIN c USING (r)),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
             n_words < 10 OR 100 * n_repeat_words > 20 * n_words OR 100 * n_symbols > 10 * word_chars OR 100 * n_dup_lines > 30 * n_lines AS failed FROM m),
h AS (SELECT source, count(*) AS n, sum(failed::INT) AS f FROM b GROUP BY source),
o AS (SELECT sum(f)::DOUBLE / sum(n) AS mu, sum(n) AS total FROM h),
s AS (SELECT sum(n * (f::DOUBLE / n - mu) * (f::DOUBLE / n - mu)) / max(total) AS v FROM h, o),
k AS (SELECT CASE WHEN v > 0 THEN greatest(1.0, least(1000.0, mu * (1 - mu) / v - 1)) ELSE 1000.0 END AS m, mu FROM o, s),
x AS (SELECT source, (f + m * mu) / (n + m) > 0.5 AS bad FROM h, k)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT bad AS kept
FROM b LEFT JOIN x ON b.source IS NOT DISTINCT FROM x.source
"""
