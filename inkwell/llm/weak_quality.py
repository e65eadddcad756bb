"""Quality classifier from weak labels.

Heuristic labellers vote good, bad or abstain on every document. How often each pattern of votes
occurs in the whole corpus is all that expectation-maximisation needs to estimate the share of good
documents and each labeller's accuracy (Dawid and Skene's model), whatever the number of documents.
The patterns' posteriors are the labels on which a hashed linear scorer over words, word shapes and
binned document statistics is trained; it scores every document.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkwell.llm.common import lean, whole_text

SPACE = re.compile(r"[^\x20\x09-\x0D]+")
SYMBOLS = frozenset("#*$%&|<>!{}[]\\^~_=+@")
#: Frequent function words of the languages served.
STOP = frozenset("the of and to in is a that it was for on as with de la que le les des et en un une el los las y der die das und ist von zu mit den ein".split())
ENDS = tuple(".!?\"')")
BAD, GOOD, ABSTAIN = 0, 1, 2
BUCKETS = 1 << 16


@dataclass(frozen=True)
class QualityRules:
    #: Distinct texts that the scorer is fitted on: those of the least hashes, of at most so many characters.
    rows: int = 3000
    row_chars: int = 50_000
    steps: int = 40
    em_rounds: int = 200
    threshold: float = 0.5


def statistics(text: str, words: list[str]) -> list[float]:
    """Words, share of words with symbols, of words equal to the one before, of distinct words, of lines with an end, of stop words, of symbol words; mean word length."""
    n = max(1, len(words))
    counts = Counter(words)
    marked = sum(c for w, c in counts.items() if not SYMBOLS.isdisjoint(w))
    lines = [s for s in text.split("\n") if s.strip()]
    ended = sum(s.rstrip().endswith(ENDS) for s in lines) / max(1, len(lines))
    bare = sum(c for w, c in counts.items() if SYMBOLS.issuperset(w))
    return [
        len(words), marked / n, sum(map(str.__eq__, words, words[1:])) / n, len(counts) / math.sqrt(n) if n > 30 else 9.0, ended,
        sum(c for w, c in counts.items() if w.lower().strip(".,;:") in STOP) / n, bare / n, sum(map(len, words)) / n, max(counts.values(), default=0) / n,
    ]


def between(value: float, bad_below: float, good_above: float) -> int:
    return BAD if value < bad_below else GOOD if value >= good_above else ABSTAIN


def votes(s: list[float]) -> str:
    n, marked, twice, variety, ended, stop, bare, length, top = s
    each = [
        between(-marked, -0.2, -0.05),
        between(-twice, -0.15, -0.05),
        between(variety, 2.0, 4.0) if n > 30 else ABSTAIN,
        between(ended, 0.3, 0.7),
        between(stop, 0.03, 0.12) if n > 30 else ABSTAIN,
        between(-bare, -0.1, -0.02),
        BAD if length > 14 or length < 2.5 else GOOD if 3.5 <= length <= 9 else ABSTAIN,
        between(-top, -0.35, -0.2) if n > 10 else ABSTAIN,
        between(n, 1, 40),
    ]
    return "".join(map(str, each))


def estimate(patterns: dict[str, int], rounds: int) -> tuple[float, np.ndarray, dict[str, float]]:
    """Share of good documents, P(vote | bad or good) by labeller, and each pattern's posterior."""
    if not patterns:
        return 0.5, np.zeros((0, 2, 3)), {}
    names = sorted(patterns)
    v = np.array([list(map(int, p)) for p in names])
    n = np.array([patterns[p] for p in names], float)
    good, bad = (v == GOOD).sum(1), (v == BAD).sum(1)
    posterior = np.where(good > 2 * bad, 0.9, np.where(bad >= good, 0.1, 0.5))  # majority first, so that good means good
    for _ in range(rounds):
        share = (n @ posterior + 1) / (n.sum() + 2)
        table = np.zeros((v.shape[1], 2, 3))
        for k in (BAD, GOOD, ABSTAIN):
            table[:, 1, k] = ((v == k) * (n * posterior)[:, None]).sum(0) + 0.5
            table[:, 0, k] = ((v == k) * (n * (1 - posterior))[:, None]).sum(0) + 0.5
        table /= table.sum(2, keepdims=True)
        log = np.log(table)
        odds = math.log(share / (1 - share)) + sum(np.where(v[:, j] == ABSTAIN, 0.0, log[j, 1, v[:, j]] - log[j, 0, v[:, j]]) for j in range(v.shape[1]))
        new = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
        done, posterior = np.abs(new - posterior).max() < 1e-6, new
        if done:
            break
    return float(share), table, dict(zip(names, posterior.tolist()))


def bucket(feature: str) -> int:
    return xxhash.xxh32_intdigest(feature) % BUCKETS


SHAPE = [(re.compile(r"[A-Z]"), "X"), (re.compile(r"[^\W\d_A-Zx]"), "x"), (re.compile(r"\d"), "0")]


def shape(word: str) -> str:
    for pattern, to in SHAPE:
        word = pattern.sub(to, word)
    return re.sub(r"(.)\1+", r"\1", word)


def binned(s: list[float]) -> list[int]:
    """Buckets of the document's statistics."""
    return [bucket(f"#{k}:{round(4 * math.log1p(20 * x))}") for k, x in enumerate(s)]


class Pairs(dict):
    """word -> buckets of the word and of its shape."""

    def __missing__(self, word: str) -> tuple[int, int]:
        self[word] = pair = (bucket(word), bucket("/" + shape(word)))
        return pair


def vector(text: str, known: Pairs) -> tuple[np.ndarray, np.ndarray]:
    """Buckets and weights: words and shapes sum to 1 each, statistics are 1 each."""
    words = SPACE.findall(text)
    pairs = np.array([known[w] for w in words], np.int64).reshape(-1, 2)
    own = binned(statistics(text, words))
    return np.concatenate([pairs[:, 0], pairs[:, 1], own]), np.concatenate([np.full(2 * len(words), 1 / max(1, len(words))), np.ones(len(own))])


def train(rows: list[tuple[np.ndarray, np.ndarray]], posterior: list[float], steps: int) -> tuple[np.ndarray, float]:
    """Logistic weights by full-batch gradient steps with per-bucket scaling."""
    w, b = np.zeros(BUCKETS), 0.0
    if not rows:
        return w, b
    at = np.concatenate([r[0] for r in rows])
    x = np.concatenate([r[1] for r in rows])
    of = np.repeat(np.arange(len(rows)), [len(r[0]) for r in rows])
    y, n = np.array(posterior), len(rows)
    scale, seen = np.full(BUCKETS, 1e-8), 1e-8
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(np.bincount(of, w[at] * x, n) + b, -30, 30)))
        gradient = np.bincount(at, (p - y)[of] * x, BUCKETS) / n + 1e-5 * w
        scale += gradient**2
        seen += (p - y).mean() ** 2
        w -= 0.5 * gradient / np.sqrt(scale)
        b -= 0.5 * (p - y).mean() / math.sqrt(seen)
    return w, b


def _votes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts to pattern counts of the batch."""
    for batch in batches:
        counts = Counter(votes(statistics(t, SPACE.findall(t))) for t in batch.column(0).to_pylist())
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["pattern", "n"])


class Scorer:
    """Scores of texts by a model (weights, base), with a memory of words; forgetting costs time only."""

    def __init__(self, weights: np.ndarray, base: float, memory_words: int = 1_000_000) -> None:
        self.weights, self.base, self.memory = weights, base, memory_words

        class Known(dict):
            """word -> weight of the word and its shape."""

            def __missing__(self, word: str) -> float:
                self[word] = w = float(weights[bucket(word)] + weights[bucket("/" + shape(word))])
                return w

        self.known = Known()

    def score(self, text: str) -> float:
        if len(self.known) > self.memory:
            self.known.clear()
        words = SPACE.findall(text)
        odds = self.base + sum(map(self.known.__getitem__, words)) / max(1, len(words)) + float(self.weights[binned(statistics(text, words))].sum())
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, odds))))


def fit_model(docs: DataFrame, rules: QualityRules) -> tuple[np.ndarray, float]:
    """Weights and base of the scorer."""
    text = docs.select(whole_text().alias("text"))
    patterns = text.mapInArrow(lean(_votes, 1000), "pattern string, n long").groupBy("pattern").agg(F.sum("n").alias("n"))
    _, _, posterior = estimate({r.pattern: r.n for r in patterns.collect()}, rules.em_rounds)  # at most 3 ** labellers rows
    # Hashes alone decide which texts are fitted on; each text counts once, and only those come to the driver.
    short = docs.where(F.length("text") <= rules.row_chars).select("text", F.xxhash64("text").alias("h"))
    last = short.select("h").distinct().orderBy("h").limit(rules.rows).agg(F.max("h")).first()[0]
    some = [] if last is None else sorted(short.where(F.col("h") <= last).select("text").distinct().collect())
    known, rows, targets = Pairs(), [], []
    for t in (r.text for r in some):
        rows.append(vector(t, known))
        targets.append(posterior[votes(statistics(t, SPACE.findall(t)))])
    return train(rows, targets, rules.steps)


def score_quality(docs: DataFrame, rules: QualityRules = QualityRules()) -> DataFrame:
    """doc_id, score (probability of a good document) and kept for every whole text of docs (doc_id, text).

    Null and empty texts have no words; their score is that of such a text. Repeated rows are scored
    alike; an empty table gives no rows. Extra columns are left out.
    """
    model = docs.sparkSession.sparkContext.broadcast(fit_model(docs, rules))  # BUCKETS numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(*model.value)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([scorer.score(t) for t in batch.column(1).to_pylist()], pa.float64())], names=["doc_id", "score"])

    scored = docs.select("doc_id", whole_text().alias("text")).mapInArrow(lean(run, 1000), "doc_id long, score double")
    return scored.select("doc_id", "score", (F.col("score") >= rules.threshold).alias("kept"))


def keep_good(docs: DataFrame, rules: QualityRules = QualityRules()) -> DataFrame:
    """The rows of docs (text), with all their columns, whose own text scores at least the threshold.

    A null text scores as an empty one. Repeated rows score alike, so they stay or go together; a score at
    the threshold stays. An empty table gives no rows; columns of any name go through unchanged.
    """
    model = docs.sparkSession.sparkContext.broadcast(fit_model(docs, rules))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(*model.value)
        for batch in batches:
            yield batch.filter(pa.array([scorer.score(t or "") >= rules.threshold for t in batch.column("text").to_pylist()], pa.bool_()))

    return docs.mapInArrow(lean(run, 1000), docs.schema)
