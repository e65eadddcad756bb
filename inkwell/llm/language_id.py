"""Language identification with error-correcting output codes.

Each language has a codeword of bits; for each bit, a binary classifier over hashed character
trigrams tells the languages with a 1 from those with a 0. A text's bit margins are decoded to the
language of the least weighted logistic loss, the weights being the bits' reliability on rows kept
out of the fit; a text whose best two languages are close is flagged as ambiguous.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from inkwell.llm.common import lean, whole_text

BUCKETS = 1 << 14
#: Numbers that aren't digits, such as fractions and Roman numerals: to a pattern they are like letters.
NUMERALS = {c: " " for c in range(128, sys.maxunicode + 1) if unicodedata.category(chr(c)) in ("Nl", "No")}
NOT_LETTERS = re.compile(r"[\W\d_]+")
#: Parts that a language's rows are ranked in first, so that no task ranks all of them.
PARTS = 64
UNKNOWN = "und"


@dataclass(frozen=True)
class LanguageRules:
    #: Rows of each language that the classifiers are fitted on: those of the least hashes, of at most so many characters.
    rows: int = 500
    row_chars: int = 50_000
    #: Longest codeword; up to five languages get all two-sided splits, more get random ones.
    bits: int = 31
    #: Scale of the margins, which are mean log-odds a trigram, and the probability gap below which a text is ambiguous.
    sharpness: float = 8.0
    ambiguous_gap: float = 0.2


def codewords(languages: int, bits: int) -> np.ndarray:
    """One row of +1 and -1 for each language; no column is constant, no two rows are equal."""
    if languages < 2:
        return np.zeros((languages, 0))
    splits = range(1, 1 << (languages - 1)) if languages <= 5 else []
    columns = [[1 if i == 0 or not s >> (i - 1) & 1 else -1 for i in range(languages)] for s in splits]
    random = np.random.default_rng(7)
    while languages > 5:
        columns = random.choice([-1, 1], (max(bits, 4 * languages.bit_length()), languages)).tolist()
        if all(len(set(c)) == 2 for c in columns) and len(set(zip(*columns))) == languages:
            break
    return np.array(columns, float).T


def trigrams(text: str) -> np.ndarray | None:
    """Hashes, below BUCKETS, of the trigrams of the letters, words apart; null if there is no letter."""
    lower = text.lower()
    letters = NOT_LETTERS.sub(" ", lower if lower.isascii() else lower.translate(NUMERALS)).strip(" ")
    if not letters:
        return None
    points = np.frombuffer(f" {letters} ".encode("utf-32-le"), "<u4").astype(np.uint32)
    mixed = points[:-2] * np.uint32(0x9E3779B1) ^ points[1:-1] * np.uint32(0x85EBCA77) ^ points[2:] * np.uint32(0xC2B2AE3D)
    mixed = (mixed ^ mixed >> np.uint32(15)) * np.uint32(0x2C1B3C6D)
    return mixed >> np.uint32(18)


def histogram(text: str) -> np.ndarray | None:
    """How many of the trigrams have each hash; null if there is no letter."""
    found = trigrams(text)
    return None if found is None else np.bincount(found, minlength=BUCKETS)


def margins(found: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """The mean weights of a text's trigrams, by bit."""
    if len(found) < BUCKETS // 4:
        return weights[found].sum(0) / len(found)
    return np.bincount(found, minlength=BUCKETS) @ weights / len(found)


def fit(samples: dict[str, list[str]], rules: LanguageRules) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    """Languages, codewords, weights of trigrams by bit, reliability of bits; every fourth row is kept out for the last."""
    languages = sorted(samples)
    codes = codewords(len(languages), rules.bits)
    shares, kept = [], []
    for i, language in enumerate(languages):
        found = [h for t in samples[language] if (h := histogram(t)) is not None]
        own = [h for k, h in enumerate(found) if k % 4 != 3]
        # A long text counts as one row: rows are summed as shares.
        total = sum((h / h.sum() for h in own), np.zeros(BUCKETS))
        shares.append((total + 1e-4) / (total.sum() + 1e-4 * BUCKETS))
        kept += [(i, h) for k, h in enumerate(found) if k % 4 == 3]
    share = np.array(shares).reshape(len(languages), BUCKETS)
    weights = np.zeros((BUCKETS, codes.shape[1]))
    for b in range(codes.shape[1]):
        weights[:, b] = np.log(share[codes[:, b] > 0].mean(0)) - np.log(share[codes[:, b] < 0].mean(0))
    right = np.ones(codes.shape[1])
    if kept and codes.shape[1]:
        signs = np.sign(np.array([h @ weights / h.sum() for _, h in kept]))
        right = (signs == codes[[i for i, _ in kept]]).mean(0)
    return languages, codes, weights, np.clip(2 * right - 1, 0.05, 1.0)


def decode(margins: np.ndarray, codes: np.ndarray, reliability: np.ndarray, sharpness: float) -> np.ndarray:
    """Probabilities of the languages from the loss of each codeword."""
    loss = (np.logaddexp(0, -sharpness * codes * margins) * reliability).sum(1)
    p = np.exp(loss.min() - loss)
    return p / p.sum()


def held_out():
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))


def predict_languages(docs: DataFrame, rules: LanguageRules = LanguageRules()) -> DataFrame:
    """doc_id, held_out, lang_pred, score and ambiguous for every whole text of docs (doc_id, text, lang).

    Learns from the text and non-null lang of documents that aren't held out; lang takes no part in a
    prediction. Null texts and texts without a letter are ``und`` with score 0 and not ambiguous; so
    is everything if nothing can be learned. Repeated rows give repeated rows, an empty table none;
    extra columns are left out.
    """
    labelled = docs.where(F.col("lang").isNotNull() & ~held_out() & F.length("text").between(1, rules.row_chars))
    picked = labelled.select("doc_id", "lang", F.pmod(F.xxhash64("doc_id"), F.lit(PARTS)).alias("part"))
    for keys in (["lang", "part"], ["lang"]):  # the least hashes of each part, then of these
        order = Window.partitionBy(*keys).orderBy(F.xxhash64("doc_id"), "doc_id")
        picked = picked.withColumn("n", F.row_number().over(order)).where(F.col("n") <= rules.rows).drop("n")
    picked = picked.select("doc_id", "lang").distinct()
    rows = docs.select("doc_id", "lang", "text").join(F.broadcast(picked), ["doc_id", "lang"]).where(F.length("text").between(1, rules.row_chars)).select("lang", "text").distinct().collect()
    samples: dict[str, list[str]] = {}
    for r in sorted(rows, key=lambda r: (r.lang, r.text)):
        samples.setdefault(r.lang, []).append(r.text)
    model = docs.sparkSession.sparkContext.broadcast(fit(samples, rules))  # BUCKETS x bits numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        languages, codes, weights, reliability = model.value
        for batch in batches:
            names, scores, close = [], [], []
            for text in batch.column(1).to_pylist():
                found = trigrams(text)
                if found is None or not languages:
                    names.append(UNKNOWN), scores.append(0.0), close.append(False)
                    continue
                p = decode(margins(found, weights), codes, reliability, rules.sharpness)
                best = int(p.argmax())
                names.append(languages[best]), scores.append(float(p[best])), close.append(bool(len(p) > 1 and p[best] - np.partition(p, -2)[-2] < rules.ambiguous_gap))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(close, pa.bool_())], names=["doc_id", "lang_pred", "score", "ambiguous"])

    found = docs.select("doc_id", whole_text().alias("text")).mapInArrow(lean(run, 1000), "doc_id long, lang_pred string, score double, ambiguous boolean")
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "ambiguous")
