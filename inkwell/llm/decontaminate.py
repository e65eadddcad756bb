"""Benchmark decontamination by CGK embedding, bit sampling and exact edit verification.

Texts and items are sequences of symbols: words (lower case, letters and digits), and single characters
of scripts without spaces. A document contains an item if some stretch of it is within ``edits`` symbol
edits of the item, a fifth of its symbols. Items of one or two symbols are matched exactly.

1. Seeds: by the q-gram lemma such a stretch shares at least symbols - (q - 1) - q x edits runs of q symbols with
   the item, so documents with fewer hold no copy; this drops nearly all of them and loses none. q is three, or two where
   three might leave no run (items of five symbols, which may have one edit).
2. Around the seeds' diagonals, item-sized windows are embedded by the CGK random walk, which maps
   edit distance to Hamming distance. For each of many independent walks, the symbols at a few
   sampled steps form a key; a window is a candidate for the items with an equal key.
3. Candidates are verified by the exact edit distance of the item to the best stretch there.

The index is made once, on the driver, as arrays of some hundred numbers an item, and is sent to every executor.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkwell.llm.common import lean, whole_text

#: Characters of scripts without spaces are symbols of their own.
UNSPACED = "\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff"
WORDS = re.compile(rf"[^\W_{UNSPACED}]+|[{UNSPACED}]")
GRAM = 3


@dataclass(frozen=True)
class LeakRules:
    #: Most edits of an item, as a share of its words.
    share: float = 0.2
    #: Walks and sampled steps: a window at half its length in Hamming distance is found with probability 1 - (1 - 0.5 ** 3) ** 64.
    walks: int = 64
    samples: int = 3
    #: Window starts tried around a seed's diagonal.
    shift: int = 2
    #: Items indexed in one pass over the documents, about a kilobyte each; more take more passes.
    items_at_once: int = 50_000


class WordHashes(dict):
    def __missing__(self, word: str) -> int:
        self[word] = h = xxhash.xxh64_intdigest(word, 3)
        return h


def hashed(text: str, known: WordHashes) -> np.ndarray:
    words = WORDS.findall(text.lower())
    return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))


def grams(h: np.ndarray, size: int = GRAM) -> np.ndarray:
    mixed = np.zeros(max(0, len(h) - size + 1), np.uint64)
    for k in range(size):
        mixed = (mixed ^ h[k : len(h) - size + 1 + k]) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(32)
    return mixed


def most_edits(words: int, share: float) -> int:
    """Edits allowed."""
    return int(share * words)


def seed_size(words: int, share: float) -> int:
    """Symbols of a seed: as many as GRAM, but so few that the edits allowed leave one intact."""
    return next(q for q in range(min(GRAM, words), 0, -1) if q == 1 or most_edits(words, share) <= (words - q) // q)


class Walks:
    """The CGK walks: at each step a bit of the current word decides whether the walk moves on."""

    def __init__(self, rules: LeakRules, seed: int = 5) -> None:
        self.rules, self.seed = rules, seed
        self.made: dict[int, tuple[np.ndarray, list[dict]]] = {}

    def of(self, length: int) -> tuple[np.ndarray, list[np.ndarray]]:
        """For items of so many words: a factor for each step and walk, and for each sample the step in each walk."""
        if length not in self.made:
            random = np.random.default_rng([self.seed, length])
            factors = random.integers(0, 1 << 63, (3 * length, self.rules.walks), np.uint64) * np.uint64(2) + np.uint64(1)
            steps = np.sort(random.integers(0, 2 * length, (self.rules.samples, self.rules.walks)), axis=0)
            self.made[length] = factors, steps
        return self.made[length]

    def keys(self, windows: np.ndarray) -> np.ndarray:
        """(windows, walks) keys of rows of as many word hashes each."""
        n, length = windows.shape
        factors, steps = self.of(length)
        ended = np.concatenate([windows, np.zeros((n, 1), np.uint64)], axis=1)  # past the end there is one symbol more
        at, keys, rows = np.zeros((n, self.rules.walks), np.int64), np.zeros((n, self.rules.walks), np.uint64), np.arange(n)[:, None]
        for step in range(2 * length):
            symbol = ended[rows, at]
            sampled = steps == step
            for times in sampled:
                if times.any():
                    keys = np.where(times, (keys ^ symbol) * np.uint64(0xD6E8FEB86659FD93) + np.uint64(step + 1), keys)
            at = np.minimum(at + (symbol * factors[step] >> np.uint64(63)).astype(np.int64), length)
        return keys

    def named(self, windows: np.ndarray) -> np.ndarray:
        """keys, made different for every length and walk."""
        names = (np.arange(self.rules.walks, dtype=np.uint64) + np.uint64(windows.shape[1] * self.rules.walks)) * np.uint64(0xC2B2AE3D27D4EB4F)
        return (self.keys(windows) ^ names) * np.uint64(0x9E3779B97F4A7C15)


def best_stretch(item: np.ndarray, words: np.ndarray) -> tuple[int, int, int]:
    """(edits, first word, word after the last) of the stretch of words nearest to the item."""
    n = len(words)
    cost, start = np.zeros(n + 1, np.int64), np.arange(n + 1)
    for symbol in item.tolist():
        change = cost[:-1] + (words != symbol)
        new, origin = np.empty(n + 1, np.int64), np.empty(n + 1, np.int64)
        new[0], origin[0] = cost[0] + 1, start[0]
        take = change <= cost[1:] + 1
        new[1:], origin[1:] = np.where(take, change, cost[1:] + 1), np.where(take, start[:-1], start[1:])
        # Insertions run along the row: new[j] = min over i <= j of new[i] + j - i.
        sloped = new - np.arange(n + 1)
        least = np.minimum.accumulate(sloped)
        source = np.maximum.accumulate(np.where(sloped == least, np.arange(n + 1), 0))
        cost, start = least + np.arange(n + 1), origin[source]
    end = int(cost.argmin())
    return int(cost[end]), int(start[end]), end


def found_in(table: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places in values, places in the sorted table) of every equal pair."""
    low, high = np.searchsorted(table, values, "left"), np.searchsorted(table, values, "right")
    sizes = high - low
    ends = np.cumsum(sizes)
    return np.repeat(np.arange(len(values)), sizes), np.arange(ends[-1] if len(ends) else 0) + np.repeat(low - (ends - sizes), sizes)


class Index:
    """Items, their seeds and their keys."""

    @staticmethod
    def arrays(items: list[tuple[int | None, str]], rules: LeakRules) -> tuple:
        """What an index consists of, to be sent to workers."""
        known, walks = WordHashes(), Walks(rules)
        kept = [(i, h) for i, t in items if len(h := hashed(t, known))]
        long = [(i, h) for i, h in kept if len(h) >= GRAM]
        short = [(i, h) for i, h in kept if len(h) < GRAM]
        seeds = sorted((seed_size(len(h), rules.share), g, k, at) for k, (_, h) in enumerate(long) for at, g in enumerate(grams(h, seed_size(len(h), rules.share)).tolist()))
        keys, owners = [np.zeros(0, np.uint64)], [np.zeros(0, np.int32)]
        by_length: dict[int, list[int]] = defaultdict(list)
        for k, (_, h) in enumerate(long):
            by_length[len(h)].append(k)
        for length, of in sorted(by_length.items()):
            for first in range(0, len(of), 256):
                some = of[first : first + 256]
                keys.append(walks.named(np.array([long[k][1] for k in some])).ravel())
                owners.append(np.repeat(np.array(some, np.int32), rules.walks))
        order = np.argsort(np.concatenate(keys), kind="stable")
        pairs = sorted((int(grams(h, len(h))[0]), len(h), k) for k, (_, h) in enumerate(short))
        return (
            [i for i, _ in long], np.concatenate([np.zeros(0, np.uint64), *(h for _, h in long)]), np.array([len(h) for _, h in long], np.int64),
            {q: (np.array([s[1] for s in own], np.uint64), np.array([s[2] for s in own], np.int32), np.array([s[3] for s in own], np.int32)) for q in range(GRAM, 0, -1) if (own := [s for s in seeds if s[0] == q])},
            np.concatenate(keys)[order], np.concatenate(owners)[order],
            [i for i, _ in short], np.array([p[0] for p in pairs], np.uint64), np.array([p[1] for p in pairs], np.int64), np.array([p[2] for p in pairs], np.int64),
        )

    def __init__(self, arrays: tuple, rules: LeakRules) -> None:
        ids, flat, sizes, self.seeds, self.keys, self.key_owners, self.short_ids, self.short, self.short_sizes, self.short_owners = arrays
        self.rules, self.walks = rules, Walks(rules)
        self.items = list(zip(ids, np.split(flat, np.cumsum(sizes)[:-1]))) if len(ids) else []
        self.edits = [most_edits(len(h), rules.share) for _, h in self.items]
        seeds = [seed_size(len(h), rules.share) for _, h in self.items]
        self.needed = [max(1, len(h) - q + 1 - q * e) for (_, h), e, q in zip(self.items, self.edits, seeds)]
        self.filters = {q: np.zeros(1 << 22, bool) for q in self.seeds}
        for q, (hashes, _, _) in self.seeds.items():
            self.filters[q][(hashes >> np.uint64(42)).astype(np.int64)] = True

    def exact(self, h: np.ndarray) -> list[tuple[int | None, int, int, int, int]]:
        """Items of one or two symbols, at their first places."""
        found: dict[int, tuple[int, int]] = {}
        for size in range(1, GRAM) if len(self.short) else ():
            at, hit = found_in(self.short, grams(h, size))
            for a, k in zip(at.tolist(), hit.tolist()):
                if self.short_sizes[k] == size:
                    found.setdefault(int(self.short_owners[k]), (a, size))
        return [(self.short_ids[k], size, 0, a, a + size) for k, (a, size) in sorted(found.items())]

    def search(self, h: np.ndarray) -> list[tuple[int, int, int, int, int]]:
        """(item id, its words, edits, first word, word after the last) of each item in a text's word hashes."""
        exact, hits = self.exact(h), []
        for q, (hashes, owners, offsets) in self.seeds.items():
            own = grams(h, q)
            likely = np.flatnonzero(self.filters[q][(own >> np.uint64(42)).astype(np.int64)])
            places, hit = found_in(hashes, own[likely])
            hits.append((likely[places], owners[hit], offsets[hit]))
        if not sum(len(at) for at, _, _ in hits):
            return exact
        at, owner, offset = (np.concatenate(c) for c in zip(*hits))
        windows: dict[int, set[int]] = defaultdict(set)
        for k, n in zip(*np.unique(owner, return_counts=True)):
            if n >= self.needed[k]:
                length, mine = len(self.items[k][1]), owner == k
                # A copy is at most length + edits words long: count the seeds within such a stretch.
                places = at[mine]
                reach = np.searchsorted(places, places + length + self.edits[k], "left") - np.arange(len(places))
                if reach.max() >= self.needed[k]:
                    diagonals = np.unique(places - offset[mine])
                    windows[length].update((diagonals[:, None] + np.arange(-self.rules.shift, self.rules.shift + 1)).ravel().tolist())
        found: dict[int, tuple[int, int, int]] = {}
        for length, starts in sorted(windows.items()):
            padded = np.concatenate([np.zeros(length, np.uint64), h, np.zeros(length, np.uint64)])
            first = np.array(sorted(s for s in starts if -length < s < len(h)), np.int64)
            for k in range(0, len(first), 256):
                some = first[k : k + 256]
                keys = self.walks.named(padded[(some + length)[:, None] + np.arange(length)])
                of, with_item = found_in(self.keys, keys.ravel())
                for s, i in sorted({(int(some[p // self.rules.walks]), int(self.key_owners[q])) for p, q in zip(of.tolist(), with_item.tolist())}):
                    if len(self.items[i][1]) != length:
                        continue
                    edits = self.edits[i]
                    if i in found and found[i][1] - edits <= s <= found[i][2]:
                        continue
                    a = max(0, s - edits - self.rules.shift)
                    cost, x, y = best_stretch(self.items[i][1], h[a : s + length + edits + self.rules.shift])
                    if cost <= edits and (i not in found or cost < found[i][0]):
                        found[i] = (cost, a + x, a + y)
        return [(self.items[i][0], len(self.items[i][1]), *v) for i, v in sorted(found.items())] + exact


def find_leaks(docs: DataFrame, items: DataFrame, rules: LeakRules = LeakRules()) -> DataFrame:
    """(doc_id, item_id, item_words, edits, first_word, end_word) of every item of items (item_id, text) in docs (doc_id, text).

    One row for each document and item, at the best stretch; of an item of one or two symbols at the
    first. Null texts and items without a symbol hold nothing; null ids stay null. Repeated documents give repeated rows, repeated items a
    row each, though each text is searched for once; empty tables give no rows; extra columns are left out.
    """
    spark = docs.sparkSession
    named = items.select("item_id", F.xxhash64(whole_text()).alias("k1"), F.xxhash64(F.lit(17), whole_text()).alias("k2"), whole_text().alias("text"))
    texts = named.select("k1", "k2", "text").distinct()
    passes = max(1, -(-texts.count() // rules.items_at_once))
    rows = docs.select("doc_id", whole_text().alias("text"))
    result = None
    for k in range(passes):
        some = sorted(texts.where(F.pmod("k1", F.lit(passes)) == k).collect(), key=lambda r: r.text)  # about items_at_once
        keys = [(r.k1, r.k2) for r in some]
        shared = spark.sparkContext.broadcast((keys, Index.arrays([(i, r.text) for i, r in enumerate(some)], rules)))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            keys, arrays = shared.value
            index, known = Index(arrays, rules), WordHashes()
            for batch in batches:
                found = []
                for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                    found += [(doc_id, *keys[leak[0]], *leak[1:]) for leak in index.search(hashed(text.as_py(), known))]
                    if len(known) > 100_000:
                        known.clear()
                columns = list(zip(*found)) or [()] * 7
                yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in columns[:3]), *(pa.array(c, pa.int32()) for c in columns[3:])], names=["doc_id", "k1", "k2", "item_words", "edits", "first_word", "end_word"])

        part = rows.mapInArrow(lean(run, 1000), "doc_id long, k1 long, k2 long, item_words int, edits int, first_word int, end_word int")
        result = part if result is None else result.unionByName(part)
    return result.join(named.drop("text"), ["k1", "k2"]).select("doc_id", "item_id", "item_words", "edits", "first_word", "end_word")


def drop_leaks(docs: DataFrame, items: DataFrame, rules: LeakRules = LeakRules()) -> DataFrame:
    """The rows of docs (text), with all their columns, whose own text contains no item of items (item_id, text).

    Null and empty texts stay, as do all documents if there are no items or these are null or without a
    symbol. Repeated rows stay or go together, repeated items change nothing; an empty table gives no
    rows; columns of any name go through unchanged.
    """
    spark = docs.sparkSession
    kept, passes = docs, max(1, -(-items.select(whole_text()).distinct().count() // rules.items_at_once))
    for k in range(passes):
        some = items.select(whole_text().alias("text")).distinct().where(F.pmod(F.xxhash64("text"), F.lit(passes)) == k).collect()  # about items_at_once
        shared = spark.sparkContext.broadcast(Index.arrays([(0, t) for t in sorted(r.text for r in some)], rules))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index, known = Index(shared.value, rules), WordHashes()
            for batch in batches:
                clean = []
                for text in batch.column("text"):
                    clean.append(not index.search(hashed(text.as_py() or "", known)))
                    if len(known) > 100_000:
                        known.clear()
                yield batch.filter(pa.array(clean, pa.bool_()))

        kept = kept.mapInArrow(lean(run, 1000), docs.schema)
    return kept
