"""Near-duplicates by improved consistent weighted sampling over TF-IDF word shingles.

1. Document frequencies: a shingle's weight is its count times 1 + SPAN * min(1, log((n + 1) / df) / cap),
   where shingles under COMMON of all documents sit at the cap. Only the others need a number, and
   there are at most (mean shingles per document) / COMMON of them, whatever the corpus. They are
   found exactly in two passes: a count-min sketch of fixed size, summed up over all tasks, never counts too little,
   so the shingles that it has at the share hold all that reach it; these alone are then counted.
2. Each distinct text gets a weighted MinHash signature by consistent weighted sampling, in bands.
3. Texts that share a band are sorted by the samples after it; each is a candidate with the next few
   there. So a bucket of thousands of near copies costs a few pairs for each member. After that, all members of a band
   that holds several classes are joined by their rarest shingles, so many of them that no pair of the similarity can
   do without a common one: of the others, which may be as many as the square of a band, none needs a comparison.
4. Verification computes the weighted Jaccard similarity of the texts; classes are the components.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from inkwell.llm.bpe import pack, unpack
from inkwell.llm.common import cut, discard, fresh, lean, partitions, whole_text
from inkwell.llm.graph import TAIL, bucket_keys, components, mixed_members, neighbours, other_pairs

SHINGLE = 5
COMMON = 1 / 200
CAP = math.log(1 / COMMON)
SPAN = 1.0
#: Rows and columns of the sketch; a count is too great by a 2 ** 19th of all, which is some tenth of the share for documents of 300 shingles.
SKETCH_ROWS, SKETCH_BITS = 4, 19
#: Columns that one row of the sketch's table holds.
SKETCH_PART = 1 << 15


@dataclass(frozen=True)
class NearRules:
    similarity: float = 0.8
    #: A pair at the threshold shares a band with probability 1 - (1 - similarity ** rows) ** bands = 0.998, and with it a sample of what follows with 0.996.
    bands: int = 12
    rows: int = 4


class WordHashes(dict):
    def __missing__(self, word: str) -> int:
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h

    def fresh(self) -> WordHashes:
        if len(self) > 100_000:
            self.clear()
        return self


def mixed(h: np.ndarray, n: int) -> np.ndarray:
    """A hash for every n word hashes in a row."""
    found = np.zeros(max(0, len(h) - n + 1), np.uint64)
    for k in range(n):
        found = (found ^ h[k : len(h) - n + 1 + k]) * np.uint64(0x9E3779B97F4A7C15)
        found ^= found >> np.uint64(29)
    return found


def word_hashes(words: list[str], known: WordHashes) -> np.ndarray:
    return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))


def shingles(text: str, known: WordHashes) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes of five words in a row (of all words if fewer), in order, and their counts."""
    h = word_hashes(text.lower().split(), known)
    return np.unique(mixed(h, min(SHINGLE, len(h))), return_counts=True) if len(h) else (h, h.astype(np.int64))


def all_shingles(texts: list[str], known: WordHashes) -> tuple[np.ndarray, np.ndarray]:
    """The shingles of some texts, repeats and all, and the text of each."""
    words = [t.lower().split() for t in texts]
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    h, owner = np.fromiter(map(known.__getitem__, chain.from_iterable(words)), np.uint64, int(sizes.sum())), np.repeat(np.arange(len(words)), sizes)
    inside = owner[: 1 - SHINGLE] == owner[SHINGLE - 1 :] if len(h) >= SHINGLE else np.zeros(0, bool)
    found, of = [mixed(h, SHINGLE)[inside]], [owner[: len(inside)][inside]]
    for k in np.flatnonzero((sizes > 0) & (sizes < SHINGLE)).tolist():
        found.append(mixed(word_hashes(words[k], known), int(sizes[k]))), of.append(np.array([k]))
    return np.concatenate(found), np.concatenate(of)


@dataclass
class Frequencies:
    """Shingles that COMMON of all documents have, sorted, with their inverse document frequencies."""

    documents: int
    common: np.ndarray
    factors: np.ndarray

    def weights(self, found: np.ndarray, counts: np.ndarray) -> np.ndarray:
        factor = np.full(len(found), 1 + SPAN)
        if len(self.common) and len(found):
            at = np.minimum(np.searchsorted(self.common, found), len(self.common) - 1)
            factor = np.where(self.common[at] == found, self.factors[at], factor)
        return counts * factor


def sketch_places(h: np.ndarray) -> np.ndarray:
    """Where each shingle is counted: a row of places for each row of the sketch."""
    return np.array([(k << SKETCH_BITS) + ((h * np.uint64(factor)) >> np.uint64(64 - SKETCH_BITS)).astype(np.int64) for k, factor in enumerate((0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)[:SKETCH_ROWS])])


def parts_of(texts: Iterator[pa.RecordBatch], size: int = 1 << 21) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """all_shingles() of some texts at a time."""
    known, held, n = WordHashes(), [], 0
    for batch in texts:
        for text in batch.column(0):
            held.append(text.as_py())
            n += len(held[-1])
            if n > size:
                yield all_shingles(held, known.fresh())
                held, n = [], 0
    if held:
        yield all_shingles(held, known.fresh())


def frequencies(texts: DataFrame) -> Frequencies:
    """Over every row of texts (text)."""
    spark, documents = texts.sparkSession, texts.count()
    part = "part int, counts binary"

    def frame(numbers: list[int], payloads: list[bytes]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(numbers, pa.int32()), pa.array(payloads, pa.binary())], names=["part", "counts"])

    def sketch(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(SKETCH_ROWS << SKETCH_BITS, np.uint32)
        for found, _ in parts_of(rows):  # a shingle that a text repeats counts again, which is only too much
            for k, places in enumerate(sketch_places(found)):
                own = slice(k << SKETCH_BITS, (k + 1) << SKETCH_BITS)
                counts[own] += np.bincount(places - own.start, minlength=1 << SKETCH_BITS).astype(np.uint32)
        for k, own in enumerate(counts.reshape(-1, SKETCH_PART)):
            if own.any():
                yield frame([k], [pack(own)])

    def often(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sums of each part, as bits that say where the share is reached."""
        now, total = None, np.zeros(SKETCH_PART, np.int64)
        for batch in rows:
            for k, counts in zip(batch.column(0).to_pylist(), batch.column(1)):
                if k != now and now is not None:
                    yield frame([now], [np.packbits(total >= COMMON * documents).tobytes()])
                    total[:] = 0
                now = k
                total += unpack(counts.as_py())[0]
        if now is not None:
            yield frame([now], [np.packbits(total >= COMMON * documents).tobytes()])

    n = partitions(texts)
    parts = texts.mapInArrow(lean(sketch, 1000), part).repartition(n, "part").sortWithinPartitions("part").mapInArrow(lean(often), part)
    reached = np.zeros((SKETCH_ROWS << SKETCH_BITS) // 8, np.uint8)
    for r in parts.collect():  # a bit for each place of the sketch, whatever the input
        reached[r.part * SKETCH_PART // 8 : (r.part + 1) * SKETCH_PART // 8] = np.frombuffer(bytes(r.counts), np.uint8)
    shared = spark.sparkContext.broadcast(reached)

    def count(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.unpackbits(shared.value).view(bool)
        for found, owner in parts_of(rows):
            likely = bits[sketch_places(found)].all(0)
            found, owner = found[likely], owner[likely]
            order = np.lexsort((owner, found))
            found, owner = found[order], owner[order]
            new = np.ones(len(found), bool)
            new[1:] = (found[1:] != found[:-1]) | (owner[1:] != owner[:-1])
            h, n = np.unique(found[new], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n.astype(np.int64))], names=["h", "n"])

    # At most mean shingles / COMMON rows.
    common = texts.mapInArrow(lean(count, 1000), "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).where(F.col("n") >= COMMON * documents).collect()
    shared.destroy()
    h, n = np.array([r.h for r in common], np.int64).view(np.uint64), np.array([r.n for r in common], float)
    order = np.argsort(h)
    return Frequencies(documents, h[order], 1 + SPAN * np.minimum(1, np.log((documents + 1) / n[order]) / CAP))


class Sampler:
    """Consistent weighted samples: for each of k hashes, the element and level that are least.

    r and c are Gamma(2, 1) and b is uniform, all functions of element and hash: 16 bits each of one
    product; the Gamma values come from tables of their quantiles.
    """

    def __init__(self, size: int, seed: int = 11) -> None:
        random = np.random.default_rng(seed)
        self.salt = random.integers(0, 1 << 63, size, np.uint64)[:, None]
        self.factor = (random.integers(0, 1 << 63, size, np.uint64) | np.uint64(1))[:, None]
        gamma = np.sort(random.gamma(2.0, 1.0, 1 << 20))[8::16]
        self.r = random.permutation(gamma).astype(np.float32)
        self.log_c = np.log(random.permutation(gamma)).astype(np.float32)

    def least(self, elements: np.ndarray, weights: np.ndarray, chunk: int = 1024) -> np.ndarray:
        """A 64-bit value for each hash; equal values mean the same element and level."""
        log_w, best, value = np.log(weights).astype(np.float32), None, None
        for k in range(0, len(elements), chunk):
            e = elements[k : k + chunk]
            mixed = (e ^ self.salt) * self.factor
            parts = mixed.view(np.uint16).reshape(*mixed.shape, 4)
            r = self.r.take(parts[:, :, 3])
            b = parts[:, :, 1].astype(np.float32) * np.float32(2.0**-16) + np.float32(2.0**-17)
            level = np.floor(log_w[k : k + chunk] / r + b)
            a = self.log_c.take(parts[:, :, 2]) - r * (level - b + 1)
            at = a.argmin(1)
            rows = np.arange(len(a))
            own = e[at] + level[rows, at].astype(np.int64).view(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
            if best is None:
                best, value = a[rows, at], own
            else:
                less = a[rows, at] < best
                best, value = np.where(less, a[rows, at], best), np.where(less, own, value)
        return value


def weighted_jaccard(x: tuple[np.ndarray, np.ndarray], y: tuple[np.ndarray, np.ndarray]) -> float:
    """Of two weighted sets of sorted elements; 0 if both are empty."""
    (a, v), (b, w) = x, y
    total = v.sum() + w.sum()
    if not total:
        return 0.0
    _, i, j = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    shared = np.minimum(v[i], w[j]).sum()
    return float(shared / (total - shared))


def prefixes(weighted: DataFrame, similarity: float) -> DataFrame:
    """(bucket, k, size, onward) of weighted sets (k, h, w), a row for each element h of weight w: those of its rarest elements without which a set can't have the weighted Jaccard similarity with any other. size is its weight, onward that of the element and those that come after it.

    Similar sets share at least similarity times the weight of either. In the order of all elements, by
    how many sets hold them and then by number, what either set has from their first common element on weighs that much:
    this element is in the prefixes of both. Elements of one set alone take no part.
    """
    held = weighted.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    total = weighted.groupBy("k").agg(F.sum("w").alias("size"))
    onward = F.sum("w").over(Window.partitionBy("k").orderBy(F.desc("n"), F.desc("h")))
    rows = weighted.join(held, "h").withColumn("onward", onward).join(total, "k")
    return rows.where(F.col("onward") >= (similarity - 1e-9) * F.col("size")).select(F.col("h").alias("bucket"), "k", "size", "onward")


def text_key():
    """128 bits of the text, null as empty."""
    return F.struct(F.xxhash64(whole_text()).alias("x"), F.xxhash64(F.lit(17), whole_text()).alias("y"))


def classes(docs: DataFrame, rules: NearRules = NearRules()) -> DataFrame:
    """(doc_id, k, root) of every row of docs: k is the text's key, root the least key of its class. A table of cut()."""
    spark = docs.sparkSession
    rows = docs.select("doc_id", text_key().alias("k"), whole_text().alias("text"))
    model = frequencies(rows.select("text"))
    shared = spark.sparkContext.broadcast((model.documents, model.common, model.factors))  # at most mean shingles / COMMON numbers

    def sign(batches: Iterator[pa.RecordBatch], memory_keys: int = 100_000) -> Iterator[pa.RecordBatch]:
        known, sampler, model, seen = WordHashes(), Sampler(rules.bands * rules.rows), Frequencies(*shared.value), set()
        for batch in batches:
            keep, found = [], []
            for at, (k, text) in enumerate(zip(zip(*(c.to_pylist() for c in batch.column(0).flatten())), batch.column(1))):
                if k not in seen:  # copies that one task reads are signed once
                    seen.add(k)
                    h, n = shingles(text.as_py(), known.fresh())
                    if len(h):
                        keep.append(at)
                        found.append(sampler.least(h, model.weights(h, n)))
            if len(seen) > memory_keys:
                seen.clear()
            keys = bucket_keys(np.array(found, np.uint64).reshape(len(found), -1), rules.rows) if found else np.zeros((0, rules.bands), np.int64)
            flat = pa.ListArray.from_arrays(pa.array(np.arange(len(keep) + 1) * rules.bands, pa.int32()), pa.array(keys.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(keep, pa.int64())), flat], names=["k", "keys"])

    kind = "struct<x:long,y:long>"
    signed = cut(rows.select("k", "text").mapInArrow(lean(sign, 1000), f"k {kind}, keys array<long>").groupBy("k").agg(F.first("keys").alias("keys")), "signatures")
    keyed = signed.select(F.explode("keys").alias("key"), "k", F.lit(0).alias("size"))
    pairs = cut(neighbours(keyed, keyed.where(F.pmod(F.xxhash64("k"), F.lit(32)) == 0)), "near-pairs")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, model = WordHashes(), Frequencies(*shared.value)
        last, own = None, None
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("x"), batch.column("y")):
                x = x.as_py()
                if x != last:
                    h, n = shingles(x, known.fresh())
                    last, own = x, (h, model.weights(h, n))
                h, n = shingles(y.as_py(), known.fresh())
                keep.append(weighted_jaccard(own, (h, model.weights(h, n))) >= rules.similarity)
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    def texts_of(wanted: DataFrame) -> DataFrame:
        """(k, text) of wanted keys (k), from one row each: copies are spread by doc_id. A table of cut()."""
        place = rows.select("doc_id", "k").join(wanted, "k").groupBy("k").agg(F.min("doc_id").alias("doc_id"))
        at = (F.col("r.k") == F.col("p.k")) & F.col("r.doc_id").eqNullSafe(F.col("p.doc_id"))
        return cut(rows.alias("r").join(place.alias("p"), at).select("r.k", "r.text").groupBy("k").agg(F.min("text").alias("text")), "near-texts")

    def verified(pairs: DataFrame) -> DataFrame:
        """The pairs that reach the similarity. Only texts in a pair are needed again."""
        texts = texts_of(pairs.select(F.col("a").alias("k")).unionByName(pairs.select(F.col("b").alias("k"))).distinct())
        x, y = texts.select(F.col("k").alias("a"), F.col("text").alias("x")), texts.select(F.col("k").alias("b"), F.col("text").alias("y"))
        links = cut(pairs.join(y, "b").join(x, "a").select("a", "b", "x", "y").mapInArrow(lean(verify, 500), f"a {kind}, b {kind}"), "near-links")
        discard(texts)
        return links

    links = verified(pairs)
    roots = components(links, "near-groups")
    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, model = WordHashes(), Frequencies(*shared.value)
        for batch in batches:
            sets = [shingles(text.as_py(), known.fresh()) for text in batch.column(1)]
            h, n = (np.concatenate(c) for c in zip(*sets)) if sets else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
            owner = np.repeat(np.arange(len(sets)), [len(x) for x, _ in sets])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(owner)), pa.array(h.view(np.int64)), pa.array(model.weights(h, n).astype(float))], names=["k", "h", "w"])

    # Whatever could still join two components: what came too far apart in the order of its bands is compared as well.
    members = signed.select(F.explode(F.transform("keys", lambda key: F.shiftright(key, TAIL))).alias("bucket"), "k")
    texts = texts_of(mixed_members(members, roots))
    weighted = cut(texts.mapInArrow(lean(weigh, 500), f"k {kind}, h long, w double"), "mixed-shingles")
    others = other_pairs(prefixes(weighted, rules.similarity), roots, rules.similarity)
    rest = others.join(pairs, ["a", "b"], "left_anti")
    more = None
    if rest.take(1):
        more = verified(rest)
        roots = components(links.unionByName(more), "near-groups")
    found = cut(rows.select("doc_id", "k").join(roots, F.col("k") == F.col("node"), "left").select("doc_id", "k", F.coalesce("root", "k").alias("root")), "near-classes")
    shared.destroy()
    discard(signed, pairs, links, texts, weighted, others, more)
    return found


def near_duplicates(docs: DataFrame, rules: NearRules = NearRules()) -> DataFrame:
    """doc_id and class_id, the least doc_id of its class, for every row of docs (doc_id, text).

    Equal texts, null counting as empty, are one class. Texts without words are linked to equal texts
    only; texts of fewer than five words have one shingle. Repeated rows are in one class; null
    doc_ids are members, and class_id is null only where a class has no other. An empty table gives no
    rows; extra columns are left out.
    """
    labelled = classes(docs, rules)
    names = labelled.groupBy("root").agg(F.min("doc_id").alias("class_id"), F.count(F.lit(1)).alias("class_size"))
    return labelled.join(names, "root").select("doc_id", "class_id", "class_size")


def keep_one(docs: DataFrame, rules: NearRules = NearRules()) -> DataFrame:
    """One row of docs (doc_id, text), with all its columns, of each class: the least by (doc_id, text's key).

    Equal texts, null counting as empty, are one class, as in near_duplicates. Of repeated rows, alike in
    doc_id and text, any one stays; a null doc_id comes first. An empty table gives no rows; columns of any
    name go through unchanged.
    """
    labelled = classes(docs, rules)
    key, of_doc, of_key = fresh(docs, "text_key", "kept_doc", "kept_key")
    best = labelled.groupBy("root").agg(F.min(F.struct("doc_id", "k")).alias("kept"))
    kept = best.select(F.col("kept.doc_id").alias(of_doc), F.col("kept.k").alias(of_key))
    rows = docs.withColumn(key, text_key())
    joined = rows.join(kept, F.col("doc_id").eqNullSafe(F.col(of_doc)) & (F.col(key) == F.col(of_key)), "left_semi")
    return joined.dropDuplicates(["doc_id", key]).select([F.col(f"`{c}`") for c in docs.columns])
