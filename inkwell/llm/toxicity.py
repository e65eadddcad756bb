"""Toxicity by compression distance: zstandard dictionaries of toxic and of ordinary text.

A window is eight words in a row, each window five words after the one before. In a window every
letter is followed by a check byte of its word so far, so that bytes match a dictionary's only where
words begin alike, and a whole word that a dictionary knows saves far more than parts of it. A window
is compressed with a dictionary trained on ordinary windows, and with the same one that has a
dictionary trained on toxic text before its end; the bytes that the second saves are the window's gain.

Most of what toxic documents say is ordinary. The toxic dictionary is therefore trained on the words of
toxic documents that are significantly more frequent there than in ordinary ones. The log-odds of gains
and a logistic threshold over a document's windows are calibrated on folds of labelled documents that
the dictionary of the other folds hasn't seen; the dictionary that scores is trained on all folds.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkwell.llm.common import lean, whole_text

WORDS = re.compile(r"[^\W\d_]+")
#: Words of a window, and from one window's start to the next.
WINDOW, STEP = 8, 5
#: Gains beyond these count as these.
LEAST, MOST = -4, 24
#: Longer texts are split into words piece by piece, and as many windows are compressed at a time at most.
PIECE, BLOCK = 1 << 20, 1 << 13


@dataclass(frozen=True)
class ToxicityRules:
    #: Labelled rows of either class that the model is fitted on: those of the least hashes, of at most so many characters.
    toxic_rows: int = 1500
    ordinary_rows: int = 2500
    row_chars: int = 100_000
    ordinary_bytes: int = 8192
    toxic_bytes: int = 2048
    #: Ordinary windows that the ordinary dictionary is trained on.
    ordinary_windows: int = 80_000
    folds: int = 4
    #: A word trains the toxic dictionary if its log-odds exceed this, beside being significant among all words.
    least_odds: float = 2.0
    threshold: float = 0.5


class Coded(dict):
    """word -> its bytes in a window: letters, each with a check byte of the word so far, and an end."""

    def __missing__(self, word: str) -> bytes:
        out, state = bytearray(), 0
        for letter in word:
            letter_bytes = letter.encode("utf-8", "surrogatepass")
            state = zlib.crc32(letter_bytes, state)
            out += letter_bytes
            out.append(128 + state % 128)
        out += bytes((32, 128 + (state >> 8) % 128))
        self[word] = found = bytes(out)
        return found


def windows(text: str, coded: Coded) -> Iterator[list[bytes]]:
    """The text's windows, piece by piece; one if it has a word but not WINDOW of them."""
    kept: list[bytes] = []
    first, at = True, 0
    while at < len(text):
        end = at + PIECE
        while end < len(text) and text[end - 1].isalpha():  # a word isn't cut
            end += 1
        kept += map(coded.__getitem__, WORDS.findall(text[at:end].lower()))
        at = end
        last = at >= len(text)
        begun = max(0, -(-(len(kept) - WINDOW) // STEP)) + (last and (first or len(kept) > WINDOW - STEP)) if kept else 0
        yield [b"".join(kept[k : k + WINDOW]) for k in range(0, begun * STEP, STEP)]
        first = first and not begun
        del kept[: begun * STEP]


def compressor(content: bytes):
    """A function from windows to their compressed sizes with a dictionary."""
    dictionary = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    params = zstandard.ZstdCompressionParameters(
        window_log=17, chain_log=14, hash_log=14, search_log=5, min_match=5, target_length=64, strategy=zstandard.STRATEGY_GREEDY,
        write_content_size=False, write_checksum=False, write_dict_id=False,
    )
    dictionary.precompute_compress(compression_params=params)
    compress = zstandard.ZstdCompressor(compression_params=params, dict_data=dictionary).multi_compress_to_buffer

    def sizes(some: list[bytes]) -> np.ndarray:
        return np.fromiter(map(len, compress(some, threads=1)), np.int64, len(some)) if some else np.zeros(0, np.int64)

    return sizes


def train(samples: list[bytes], size: int, segment: int) -> bytes:
    """A dictionary's content; samples that are too few for training are the content themselves."""
    ordered = sorted(samples, key=lambda w: (zlib.crc32(w), w))
    try:
        return zstandard.train_dictionary(size, ordered, k=segment, d=8, steps=4).as_bytes()
    except zstandard.ZstdError:
        return b"".join(dict.fromkeys(ordered))[-size:]


def toxic_dictionary(toxic: list[set[str]], ordinary: list[set[str]], coded: Coded, rules: ToxicityRules) -> bytes:
    """Trained on the words of toxic documents that their share of documents tells from ordinary ones, once for each document."""
    bad, good = (Counter(w for words in docs for w in words) for docs in (toxic, ordinary))
    needed, kept = math.log(len(bad) + 1), set()
    for word, n in bad.items():
        m, share = good[word], (n + good[word]) / (len(toxic) + len(ordinary))
        odds = math.log((n + 0.5) / (len(toxic) + 1)) - math.log((m + 0.5) / (len(ordinary) + 1))
        # The log-likelihood ratio against one rate for both, above what the best of so many words has by chance.
        if odds > rules.least_odds and n * math.log(n / (share * len(toxic))) + (m and m * math.log(m / (share * len(ordinary)))) > needed:
            kept.add(word)
    return train([coded[w] for words in toxic for w in words if w in kept], rules.toxic_bytes, 24)


def histograms(texts: list[str], ordinary, toxic, coded: Coded) -> np.ndarray:
    """A row for each text: how many of its windows have each gain. Some thousand windows are held at a time."""
    found = np.zeros((len(texts), MOST - LEAST + 1), np.int64)
    some: list[bytes] = []
    owners: list[tuple[int, int]] = []  # texts and how many of the windows are theirs

    def count() -> None:
        gains = np.clip(ordinary(some) - toxic(some), LEAST, MOST) - LEAST
        rows = np.repeat([k for k, _ in owners], [n for _, n in owners]).astype(np.int64)
        found[:] += np.bincount(rows * found.shape[1] + gains, minlength=found.size).reshape(found.shape)
        some.clear(), owners.clear()

    for k, text in enumerate(texts):
        for piece in windows(text, coded):
            for at in range(0, len(piece), BLOCK):
                some += piece[at : at + BLOCK]
                owners.append((k, min(BLOCK, len(piece) - at)))
                if len(some) >= BLOCK:
                    count()
    count()
    return found


def features(counts: np.ndarray, odds: np.ndarray) -> np.ndarray:
    """A row for each text, from its windows' log-odds."""
    n, high = np.maximum(1, counts.sum(1)), counts @ np.where(odds > 1, odds, 0)
    most = np.where(counts > 0, odds, 0).max(1, initial=0)
    # The sum of the three windows of most odds.
    order = np.argsort(-odds)
    top = np.diff(np.minimum(3, np.cumsum(counts[:, order], 1)), axis=1, prepend=0) @ odds[order]
    return np.stack([np.ones(len(counts)), high, counts @ odds, most, 20 * high / n, np.log(n + 1), top], 1)


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, steps: int = 25) -> np.ndarray:
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hessian = (x * (weight * p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(x.shape[1])
        w += np.linalg.solve(hessian, x.T @ (weight * (y - p)) - 1e-2 * w)
    return w


def threshold(scores: np.ndarray, y: np.ndarray) -> float:
    """Where precision and recall together, as F1, are best."""
    order = np.argsort(-scores, kind="stable")
    right = np.cumsum(y[order])
    best = int((right / (np.arange(1, len(y) + 1) + y.sum())).argmax())
    below = scores[order[best + 1]] if best + 1 < len(y) else scores[order[best]]
    return float((scores[order[best]] + below) / 2)


def probability(counts: np.ndarray, odds: np.ndarray, weights: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(features(counts, odds) @ weights, -30, 30)))


def fit(toxic: list[str], ordinary: list[str], toxic_share: float, rules: ToxicityRules) -> tuple[bytes, bytes, np.ndarray, np.ndarray]:
    """Both dictionaries, the gains' log-odds and the features' weights; texts count once each."""
    coded = Coded()
    bad, good = sorted(set(toxic)), sorted(set(ordinary) - set(toxic))
    samples = [w for t in good for piece in windows(t, coded) for w in piece]
    content = train(samples[:: max(1, len(samples) // rules.ordinary_windows)], rules.ordinary_bytes, 64)
    plain = compressor(content)
    words = [[set(WORDS.findall(t.lower())) for t in texts] for texts in (bad, good)]
    counts = [np.zeros((len(texts), MOST - LEAST + 1), np.int64) for texts in (bad, good)]
    for fold in range(rules.folds):
        others = [[w for k, w in enumerate(own) if k % rules.folds != fold] for own in words]
        mixed = compressor(content + toxic_dictionary(*others, coded, rules))
        for texts, found in zip((bad, good), counts):
            found[fold :: rules.folds] = histograms(texts[fold :: rules.folds], plain, mixed, coded)
    sums = [found.sum(0) + 0.5 for found in counts]
    odds = np.log(sums[0] / sums[0].sum()) - np.log(sums[1] / sums[1].sum())
    x = np.concatenate([features(found, odds) for found in counts])
    y = np.repeat([1.0, 0.0], [len(bad), len(good)])
    share = min(max(y.mean(), 1e-6), 1 - 1e-6)
    weight = np.where(y > 0, toxic_share / share, (1 - toxic_share) / (1 - share))
    weights = logistic(x, y, weight)
    weights[0] -= threshold(x @ weights, y)
    return content, content + toxic_dictionary(*words, coded, rules), odds, weights


def _score(model, memory_words: int = 100_000):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        content, mixed, odds, weights = model.value
        ordinary, toxic, coded = compressor(content), compressor(mixed), Coded()
        for batch in batches:
            counts = histograms(batch.column(1).to_pylist(), ordinary, toxic, coded)
            if len(coded) > memory_words:  # a memory of words seen; forgetting costs time only
                coded.clear()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(probability(counts, odds, weights))], names=["doc_id", "score"])

    return run


def held_out(folds: int = 5):
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % folds == 0, F.lit(False))


def score_toxicity(docs: DataFrame, labels: DataFrame, rules: ToxicityRules = ToxicityRules()) -> DataFrame:
    """doc_id, held_out, score (0 to 1) and predicted for every whole text of docs (doc_id, text).

    Learns from labels (doc_id, toxic) of documents whose crc32(doc_id) mod 5 isn't 0. Null and empty
    texts have no windows and get the score of such a text. Rows without doc_id count as not held out
    and have no label; a document with both labels counts as toxic. Unless both classes have a labelled
    text, every score is 0. Repeated rows give repeated rows, an empty table none; extra columns are left out.
    """
    known = labels.where(F.col("toxic").isin(0, 1) & ~held_out()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    counts = {r.toxic: r.n for r in known.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    some = [known.where(F.col("toxic") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n) for k, n in ((1, rules.toxic_rows), (0, rules.ordinary_rows))]
    picked = F.broadcast(some[0].unionByName(some[1]))  # at most toxic_rows + ordinary_rows rows
    rows = docs.select("doc_id", "text").join(picked, "doc_id").where(F.length("text").between(1, rules.row_chars)).select("text", "toxic").distinct().collect()
    texts = {k: [r.text for r in rows if r.toxic == k] for k in (1, 0)}
    if not texts[1] or not set(texts[0]) - set(texts[1]):
        return docs.select("doc_id", held_out().alias("held_out"), F.lit(0.0).alias("score"), F.lit(0).alias("predicted"))
    share = counts[1] / (counts[0] + counts[1])
    model = docs.sparkSession.sparkContext.broadcast(fit(texts[1], texts[0], share, rules))  # dictionaries and some numbers
    scored = docs.select("doc_id", whole_text().alias("text")).mapInArrow(lean(_score(model), 1000), "doc_id long, score double")
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= rules.threshold).cast("int").alias("predicted"))
