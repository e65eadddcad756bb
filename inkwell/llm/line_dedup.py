"""Fuzzy line dedup: SimHash, sorted tables of drawn words, edit similarity, connected groups.

Lines are normalised (lower case, white space runs to one space). Two lines are linked if their edit
similarity reaches the threshold. SimHash blocks alone don't reach it: lines with a fifth of their
words replaced differ in 7 of 32 bits more or less, and no block of a few bits is left equal. So each of
the tables draws three of a line's words, long ones rather than short, such that similar lines draw the
same ones (three characters in a row instead of words in short lines); lines with equal draws are sorted by what is
drawn after them and each is a candidate with the next few. All others of equal draws, one of those after included, are
candidates once these are linked, unless they are in one group by then: these meet with their texts in one task, and only links
leave it. Of all, lengths too far apart for the
similarity are left out, which loses nothing, and pairs whose 32-bit SimHashes are as far apart as chance has them. Of each connected group, and of exact repeats, the first occurrence by (doc_id, text,
line number) stays.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass
from operator import ne

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkwell.llm.bpe import pack
from inkwell.llm.common import cut, discard, fresh, lean, partitions, whole_text
from inkwell.llm.graph import bucket_keys, components, meetings, merged, once, packed_pairs

#: Tables, and how many draws make a bucket. Lines that share two thirds of their weight share one, and a draw after it, with 0.97.
TABLES, DRAWS = 12, 3
#: Unrelated lines differ in 16 bits of their SimHashes and 3 more or less, those that share two thirds of their words in 6 or 7.
BITS = 13
#: Shorter lines are dealt by three characters in a row, those from WORDS_FROM on by words; lines of similarity 0.8 on either side have one in common.
CHARS_BELOW, WORDS_FROM = 60, 48
#: Runs in scripts without spaces are drawn from by pairs of characters.
UNSPACED = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff]+")
WEIGHTS = {1: 0.05, 2: 0.05, 3: 0.1, 4: 0.4}


@dataclass(frozen=True)
class LineRules:
    #: Lines of fewer characters are compared for exact repeats only. Five words have nine at least.
    min_chars: int = 9
    similarity: float = 0.8
    #: Lines of a bucket that come next in its order, with which one is compared first; the rest of its pairs, of different groups only, come after.
    lags: int = 2
    #: Documents that hold lines to verify are found by broadcast up to so many lines, 40 bytes each, by a shuffled join beyond.
    broadcast_lines: int = 500_000


#: Odd numbers whose powers make words' and lines' hashes.
WORD_BASE, LINE_BASES = np.uint64(0x9E3779B97F4A7C15), (np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0xD6E8FEB86659FD93))
#: ASCII white space, as str.split has it, and the rest of it.
SEPARATORS = np.isin(np.arange(256), [9, 10, 11, 12, 13, 28, 29, 30, 31, 32])
WIDE_SPACE = re.compile("[\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
#: Bytes of text handled at a time; one longer text is a piece of its own.
PIECE = 1 << 20


def normalised(line: str) -> str:
    return " ".join(line.lower().split())


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base ** 1, 2, … modulo 2 ** 64."""
    return np.multiply.accumulate(np.full(max(1, n), base, np.uint64))


def run_hashes(values: np.ndarray, starts: np.ndarray, base: np.uint64) -> np.ndarray:
    """A hash of every run of values, by the sum of each value times a power of its place in the run; starts: where the runs begin, none empty."""
    sizes = np.diff(np.append(starts, len(values)))
    place = np.arange(len(values)) - np.repeat(starts, sizes)
    return mix(np.add.reduceat(values * powers(base, int(sizes.max(initial=0)))[place], starts)) if len(starts) else np.zeros(0, np.uint64)


class WordHashes(dict):
    """token -> the hash that Words gives it."""

    def __missing__(self, token: str) -> int:
        data = np.frombuffer(token.encode("utf-8", "surrogatepass"), np.uint8).astype(np.uint64) + np.uint64(1)
        self[token] = h = int(run_hashes(data, np.zeros(1, np.int64), WORD_BASE)[0])
        return h


class Words:
    """The words of a text in lower case, whose lines end with newlines, found in its bytes: hashes, characters and lines."""

    def __init__(self, text: str) -> None:
        data = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
        apart = SEPARATORS[data]
        inside = np.flatnonzero(~apart)
        new = np.concatenate([np.ones(min(1, len(inside)), bool), np.diff(inside) > 1])
        starts = np.flatnonzero(new)
        letters = data[inside]
        self.hashes = run_hashes(letters.astype(np.uint64) + np.uint64(1), starts, WORD_BASE)
        first = (letters & 0xC0) != 0x80  # not a later byte of a character
        self.chars = np.add.reduceat(first.astype(np.int64), starts) if len(starts) else np.zeros(0, np.int64)
        self.line = np.searchsorted(np.flatnonzero(data == 10), inside[starts])
        #: Where the words of each line with a word begin.
        self.starts = np.flatnonzero(np.concatenate([np.ones(min(1, len(starts)), bool), np.diff(self.line) > 0]))


def line_tokens(line: str) -> set[str]:
    """Words of a normalised line, and pairs of characters where there are no spaces."""
    if line.isascii() or not UNSPACED.search(line):
        return set(line.split(" "))
    found = set(UNSPACED.sub(" ", line).split())
    for run in UNSPACED.findall(line):
        found.update("\0" + run[i : i + 2] for i in range(max(1, len(run) - 1)))
    return found


def weight(token: str) -> float:
    return 1.0 if token[0] == "\0" else WEIGHTS.get(len(token), 1.0)


class Clocks:
    """Times of tokens, exponential with a token's weight as rate: a line draws the token that comes first.

    A time comes from 16 bits of a hash, so four draws share one, and from a table of quantiles for each weight.
    """

    def __init__(self) -> None:
        self.seeds = np.arange(1, TABLES * DRAWS // 4 + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        self.weights = np.array(sorted({*WEIGHTS.values(), 1.0}))
        quantiles = -np.log((np.arange(1 << 16) + 0.5) / (1 << 16))
        self.times = (quantiles / self.weights[:, None]).astype(np.float32).ravel()

    def of(self, hashes: np.ndarray, weights: np.ndarray) -> np.ndarray:
        draws = mix(hashes[:, None] + self.seeds).view(np.uint16).reshape(len(hashes), TABLES * DRAWS)
        return self.times.take(draws + (np.searchsorted(self.weights, weights) << 16)[:, None])


#: Tokens whose times are held at a time, some MB, and the tokens of a run from which it is taken by itself.
TOKENS_AT_ONCE, LONG_RUN = 1 << 15, 512


def least_of_runs(times: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The least of each column over each run of rows."""
    found = np.empty((len(starts), times.shape[1]), times.dtype)
    order = np.argsort(-sizes, kind="stable")
    long = int(np.searchsorted(-sizes[order], -LONG_RUN, "right"))
    for k in order[:long].tolist():
        found[k] = times[starts[k] : starts[k] + sizes[k]].min(0)
    # The others side by side: a row of each run at a time, the longest runs first.
    order = order[long:]
    at, left = starts[order], sizes[order]
    best = times[at]
    steps = range(1, int(left.max(initial=0)))
    for step, n in zip(steps, np.searchsorted(-left, -np.arange(1, len(steps) + 1), "left").tolist()):
        np.minimum(best[:n], times.take(at[:n] + step, 0), out=best[:n])
    found[order] = best
    return found


def table_keys(hashes: np.ndarray, weights: np.ndarray, starts: np.ndarray, clocks: Clocks) -> np.ndarray:
    """A row of TABLES keys for each run of tokens; starts: where the runs begin, none empty."""
    found = np.empty((len(starts), TABLES), np.int64)
    ends = np.append(starts[1:], len(hashes))
    first = 0
    while first < len(starts):
        last = max(first + 1, int(np.searchsorted(ends, starts[first] + TOKENS_AT_ONCE, "right")))
        own = slice(starts[first], ends[last - 1])
        least = least_of_runs(clocks.of(hashes[own], weights[own]), starts[first:last] - starts[first], ends[first:last] - starts[first:last])
        found[first:last] = bucket_keys(least.view(np.uint32).astype(np.uint64), DRAWS)
        first = last
    return found


def simhashes(hashes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """32 bits for each run of tokens, each the majority of the tokens' hashes; starts: where the runs begin, none empty."""
    sizes = np.diff(np.append(starts, len(hashes)))
    found = np.empty(len(starts), np.int64)
    ends, first = np.append(starts[1:], len(hashes)), 0
    while first < len(starts):  # some MB of bits at a time
        last = max(first + 1, int(np.searchsorted(ends, starts[first] + (1 << 16), "right")))
        some = hashes[starts[first] : ends[last - 1]]
        bits = np.unpackbits(some.view(np.uint8).reshape(-1, 8)[:, :4], axis=1)
        counts = np.add.reduceat(bits, starts[first:last] - starts[first], axis=0, dtype=np.int32)
        found[first:last] = np.packbits(2 * counts > sizes[first:last, None], axis=1).view(">u4").ravel()
        first = last
    return found


class Dealer:
    """Lines of documents, with the keys of those not seen lately."""

    def __init__(self, min_chars: int, memory_lines: int = 300_000) -> None:
        self.min_chars, self.memory = min_chars, memory_lines
        self.clocks, self.known, self.seen = Clocks(), WordHashes(), set()

    def batch(self, docs: list[tuple[int | None, int, str]]) -> pa.RecordBatch:
        """Rows of some documents' lines that aren't blank: doc_id, text_hash, line, k1, k2; and one of members: lines that are compared, with their keys and a mark each, characters and SimHash, as packed_pairs() takes them."""
        texts = [WIDE_SPACE.sub(" ", t.lower()) if not t.isascii() else t.lower() for _, _, t in docs]
        w = Words("\n".join(texts))
        first_line = np.cumsum([0, *(t.count("\n") + 1 for t in texts)])[:-1]
        line = w.line[w.starts]
        owner = np.searchsorted(first_line, line, "right") - 1
        k1, k2 = (run_hashes(w.hashes, w.starts, base).view(np.int64) for base in LINE_BASES)
        sizes = np.diff(np.append(w.starts, len(w.hashes)))
        chars = (np.add.reduceat(w.chars, w.starts) if len(w.starts) else np.zeros(0, np.int64)) + sizes - 1

        fresh = np.zeros(len(line), bool)
        for i, k in enumerate(k1.tolist()):
            if k not in self.seen:
                self.seen.add(k)
                fresh[i] = True
        if len(self.seen) > self.memory:
            self.seen.clear()
        fresh &= chars >= self.min_chars
        odd = np.array([bool(UNSPACED.search(t)) if not t.isascii() else False for t in texts], bool)[owner] if len(line) else np.zeros(0, bool)
        by_words = np.flatnonzero(fresh & (chars >= WORDS_FROM) & ~odd)
        owners, keys, marks = [by_words], [], []
        if len(by_words):
            taken = np.zeros(len(line), bool)
            taken[by_words] = True
            of_word = np.repeat(taken, sizes)
            starts = np.cumsum([0, *sizes[by_words]])[:-1]
            letters = w.chars[of_word]
            weights = np.ones(len(letters))
            for n, x in WEIGHTS.items():
                weights[letters == n] = x
            keys.append(table_keys(w.hashes[of_word], weights, starts, self.clocks))
            marks.append(simhashes(w.hashes[of_word], starts))
        sets, of_set = [], []
        split: dict[int, list[str]] = {}
        for i in np.flatnonzero(fresh & ((chars < CHARS_BELOW) | odd)).tolist():
            own = split.setdefault(int(owner[i]), []) or split[int(owner[i])]
            if not own:
                own += texts[owner[i]].split("\n")
            text = " ".join(own[int(line[i] - first_line[owner[i]])].split())
            if len(text) < CHARS_BELOW:
                sets.append({"\0" + text[j : j + 3] for j in range(max(1, len(text) - 2))}), of_set.append(i)
            if odd[i] and len(text) >= WORDS_FROM:
                sets.append(line_tokens(text)), of_set.append(i)
        if sets:
            tokens = [t for s in sets for t in s]
            starts = np.cumsum([0, *map(len, sets)])[:-1]
            owners.append(np.array(of_set, np.int64))
            hashes = np.fromiter(map(self.known.__getitem__, tokens), np.uint64, len(tokens))
            keys.append(table_keys(hashes, np.fromiter(map(weight, tokens), float, len(tokens)), starts, self.clocks))
            marks.append(simhashes(hashes, starts))
            if len(self.known) > self.memory:
                self.known.clear()
        owned = np.concatenate(owners)
        rows, marked = (np.concatenate(keys), np.concatenate(marks)) if keys else (np.zeros((0, TABLES), np.int64), np.zeros(0, np.int64))
        members = pack(k1[owned].view(np.uint64), rows.ravel().view(np.uint64), (chars[owned] << 32 | marked).view(np.uint64)) if len(owned) else None
        n = len(line)
        more = lambda values, kind: pa.array([*values, None], kind)
        return pa.RecordBatch.from_arrays(
            [more((docs[i][0] for i in owner.tolist()), pa.int64()), more((docs[i][1] for i in owner.tolist()), pa.int64()), more((line - first_line[owner]).tolist(), pa.int32()), more(k1.tolist(), pa.int64()), more(k2.tolist(), pa.int64()), pa.array([None] * n + [members], pa.binary())],
            names=["doc_id", "text_hash", "line", "k1", "k2", "members"],
        )


def _lines(min_chars: int):
    """Documents (doc_id, text_hash, text) to a row for each line that isn't blank."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dealer = Dealer(min_chars)
        for batch in batches:
            docs, size = [], 0
            for doc_id, text_hash, text in zip(*batch.columns):
                text = text.as_py()
                docs.append((doc_id.as_py(), text_hash.as_py(), text))
                size += len(text)
                if size >= PIECE:
                    yield dealer.batch(docs)
                    docs, size = [], 0
            if docs:
                yield dealer.batch(docs)

    return run


def edit_distance(x: str, y: str, enough: float = float("inf")) -> int:
    """Levenshtein distance, bit-parallel over the shorter string; what is surely above enough is some lower bound above it."""
    start = 0
    for start, (a, b) in enumerate(zip(x, y)):  # noqa: B007
        if a != b:
            break
    else:
        start = min(len(x), len(y))
    x, y = x[start:], y[start:]
    end = 0
    while end < min(len(x), len(y)) and x[-1 - end] == y[-1 - end]:
        end += 1
    x, y = x[: len(x) - end], y[: len(y) - end]
    if len(x) > len(y):
        x, y = y, x
    if not x:
        return len(y)
    places: dict[str, int] = {}
    for i, c in enumerate(x):
        places[c] = places.get(c, 0) | 1 << i
    full, last = (1 << len(x)) - 1, 1 << (len(x) - 1)
    plus, minus, score = full, 0, len(x)  # where a column of the table rises and falls
    most = enough + len(y)  # the score may fall by one with each character that is left
    for c in y:
        equal = places.get(c, 0)
        zero = (((equal & plus) + plus) ^ plus) | equal | minus
        rise, fall = minus | ~(zero | plus) & full, plus & zero
        score += bool(rise & last) - bool(fall & last)
        most -= 1
        if score > most:
            return math.ceil(enough + score - most)
        rise, fall = (rise << 1 | 1) & full, fall << 1 & full
        plus, minus = fall | ~(zero | rise) & full, rise & zero
    return score


def places_once(words: list[str]) -> dict[str, int]:
    """The words that a line has once, and where."""
    found: dict[str, int] = {}
    for i, w in enumerate(words):
        found[w] = -1 if w in found else i
    return {w: i for w, i in found.items() if i >= 0}


def gaps(a: list[str], b: list[str]) -> list[tuple[str, str]]:
    """What lies between the words that two lines both have once and in one order, with the spaces before, so that missing words count theirs."""
    at, found, i, j = places_once(a), [], 0, 0
    for w, q in [*places_once(b).items(), (None, len(b))]:
        p = len(a) if w is None else at.get(w, -1)
        if p < i:
            continue  # not in a, or out of order
        if p > i or q > j:
            found.append(("".join(" " + v for v in a[i:p]), "".join(" " + v for v in b[j:q])))
        i, j = p + 1, q + 1
    return found


def most_edits(a: list[str], b: list[str], enough: float = float("inf")) -> int:
    """An upper bound of the edits between two lines of words, or some number above enough: common words stay, gaps of one length are changed letter by letter, others replaced; all are compared if that is not enough."""
    between = gaps(a, b)
    total = sum(sum(map(ne, v, w)) if len(v) == len(w) else max(len(v), len(w)) for v, w in between)
    if total > enough or enough == float("inf"):
        total = 0
        for v, w in between:
            total += edit_distance(v, w, enough - total)
            if total > enough:
                break
    return total


def shared_start(x: str, y: str) -> int:
    """How many first characters two strings have in common."""
    low, high = 0, min(len(x), len(y))
    if x[:high] == y[:high]:
        return high
    while high - low > 1:
        middle = (low + high) // 2
        if x[low:middle] == y[low:middle]:
            low = middle
        else:
            high = middle
    return low


def trimmed(x: str, y: str) -> tuple[str, str]:
    """Two strings without the beginning and the end that they have in common; their edit distance stays the same."""
    n = shared_start(x, y)
    x, y = x[n:], y[n:]
    n = shared_start(x[::-1], y[::-1])
    return (x[: len(x) - n], y[: len(y) - n]) if n else (x, y)


def similar(x: str, y: str, similarity: float) -> bool:
    """Whether the edit similarity of two normalised lines reaches the threshold."""
    most = max(len(x), len(y)) * (1 - similarity) + 1e-9
    if abs(len(x) - len(y)) > most:
        return False
    x, y = trimmed(x, y)
    return max(len(x), len(y)) <= most or near_enough(x, y, most)


#: From so many characters on, words that two lines have in common are looked for first.
LONG_LINE = 48


def near_enough(x: str, y: str, most: float) -> bool:
    """Whether two strings are at most so many edits apart."""
    if max(len(x), len(y)) >= LONG_LINE and most_edits(x.split(" "), y.split(" "), most) <= most:
        return True
    return edit_distance(x, y, most) <= most


#: Pairs whose edits are counted side by side, and words of 64 bits that say at most where their characters are.
SIDE_BY_SIDE, PLACE_WORDS = 1024, 1 << 21
#: Fewer pairs for each of their words are faster one by one.
FEW = 3
#: Characters of the second strings after which pairs that are settled are left out.
SETTLED_EACH = 32


def codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of some strings one after another, and where each begins and how long it is."""
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4")
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    return points, np.cumsum(sizes) - sizes, sizes


def within_edits(xs: list[str], ys: list[str], most: np.ndarray) -> np.ndarray:
    """Whether strings are at most so many edits apart, pair by pair: edit_distance(), for many pairs at once."""
    found = np.zeros(len(xs), bool)
    if not len(xs):
        return found
    points, _, _ = codes([*xs, *ys])
    ids = np.zeros(int(points.max(initial=0)) + 1, np.int64)
    ids[points] = 1
    letters = int(ids.sum()) + 1  # and none
    ids[ids > 0] = np.arange(1, letters)
    sizes = np.fromiter(map(len, xs), np.int64, len(xs))
    order, first = np.argsort(-sizes, kind="stable"), 0
    while first < len(order):
        words = max(1, -(-int(sizes[order[first]]) // 64))
        own = order[first : first + max(1, min(SIDE_BY_SIDE, PLACE_WORDS // (letters * words)))]
        own = own[sizes[own] > 64 * (words * 3 // 4 - 1)]  # of about one length
        x, y = [xs[k] for k in own.tolist()], [ys[k] for k in own.tolist()]
        if len(own) < FEW * words:
            found[own] = [edit_distance(v, w, enough) <= enough for v, w, enough in zip(x, y, most[own].tolist())]
        else:
            found[own] = _side_by_side(x, y, most[own], ids, letters, words)
        first += len(own)
    return found


def _side_by_side(xs: list[str], ys: list[str], most: np.ndarray, ids: np.ndarray, letters: int, words: int) -> np.ndarray:
    """within_edits() of some pairs, a bit for each character of xs, so many words for each pair; ids: a number from 1 for each code point."""
    n, one, top = len(xs), np.uint64(1), np.uint64(63)
    points, starts, m = codes(xs)
    owner = np.repeat(np.arange(n), m)
    place = np.arange(len(points)) - starts[owner]
    equal = np.zeros(words * n * letters, np.uint64)  # where a pair's x has a letter
    np.add.at(equal, ((place >> 6) * n + owner) * letters + ids[points], one << (place & 63).astype(np.uint64))
    equal = equal.reshape(words, n * letters)
    points, starts, left = codes(ys)
    owner = np.repeat(np.arange(n), left)
    letter = np.zeros((int(left.max(initial=0)), n), np.int32)
    letter[np.arange(len(points)) - starts[owner], owner] = ids[points]

    found = np.where((m == 0) | (left == 0), np.maximum(m, left) <= most, False)
    lanes = np.flatnonzero((m > 0) & (left > 0) & (np.abs(m - left) <= most))
    # Rows of the table that few enough edits lead to are computed, whole words of them: from a first word up to a last one.
    band = int(most[lanes].max(initial=0))
    size, total, enough = m[lanes], left[lanes], most[lanes]
    plus, minus = np.full((words, len(lanes)), ~np.uint64(0)), np.zeros((words, len(lanes)), np.uint64)  # where a column of the table rises and falls
    until = min(words, -(-(1 + band) // 64))
    bottom = np.full(len(lanes), 64 * until)  # what the last row of them says
    for column in range(1, len(letter) + 1):
        if not len(lanes):
            break
        if until < words and column + band > 64 * until:
            until, bottom = until + 1, bottom + 64
        since = max(0, (column - band - 1) // 64)
        at = lanes * letters + letter[column - 1, lanes]
        up, down = one, np.uint64(0)  # what comes from the word before
        for w in range(since, until):
            same, p, q = equal[w].take(at), plus[w], minus[w]
            both = same | q
            same |= down
            zero = (((same & p) + p) ^ p) | same
            rise, fall = q | ~(zero | p), p & zero
            rise, fall, up, down = rise << one | up, fall << one | down, rise >> top, fall >> top
            plus[w], minus[w] = fall | ~(both | rise), rise & both
        bottom += up.astype(np.int64) - down.astype(np.int64)
        ended = total == column
        settled = column % SETTLED_EACH == 0
        if not settled and not ended.any():
            continue
        some = np.arange(len(lanes)) if settled else np.flatnonzero(ended)
        row, says = _column(plus[since:until, some], minus[since:until, some], bottom[some], 64 * since)
        behind = (size - total + column)[some, None]  # the row that leaves as many characters of both
        least = np.where(row <= size[some, None], says + np.abs(behind - row), np.iinfo(np.int32).max).min(1)
        done = ended[some]
        found[lanes[some[done]]] = says[done, size[some[done]] - 64 * since] <= enough[some[done]]
        gone = some[done | (least > enough[some])]
        if len(gone):
            go = np.delete(np.arange(len(lanes)), gone)
            lanes, size, total, enough, bottom = (c[go] for c in (lanes, size, total, enough, bottom))
            plus, minus = plus[:, go], minus[:, go]
    return found


def _column(plus: np.ndarray, minus: np.ndarray, bottom: np.ndarray, first: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows from first on, and what each pair's column says there; bottom: in the last of them."""
    bits = lambda x: np.unpackbits(np.ascontiguousarray(x.T).view(np.uint8), axis=1, bitorder="little").view(np.int8)
    says = np.zeros((len(bottom), 64 * len(plus) + 1), np.int32)
    np.cumsum(bits(plus) - bits(minus), axis=1, dtype=np.int32, out=says[:, 1:])
    says += (bottom - says[:, -1]).astype(np.int32)[:, None]
    return np.arange(first, first + says.shape[1], dtype=np.int32), says


#: Bins that a line's runs of characters are counted in, and lines and pairs that are counted at a time, some MB.
BINS, LINES_AT_ONCE, PAIRS_AT_ONCE = 2048, 512, 8192
#: Runs of so many characters, and bins, that tell pairs apart: few and short ones first.
FILTERS = ((2, 256), (3, 1024))
FACTORS = (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D)


def run_counts(lines: list[str], run: int = 3, bins: int = BINS) -> np.ndarray:
    """A row for each line: how many of its runs of characters fall in each bin, of which there are a power of two, 255 at most."""
    found = np.empty((len(lines), bins), np.uint8)
    shift = np.uint32(33 - bins.bit_length())
    for first in range(0, len(lines), LINES_AT_ONCE):
        some = lines[first : first + LINES_AT_ONCE]
        points = np.frombuffer("".join(some).encode("utf-32-le", "surrogatepass"), "<u4")
        sizes = np.fromiter(map(len, some), np.int64, len(some))
        n = max(0, len(points) - run + 1)
        runs = np.zeros(n, np.uint32)
        for k in range(run):
            runs ^= points[k : n + k] * np.uint32(FACTORS[k])
        # A run belongs to the line of its first character, if its last is in that line too.
        owner = np.repeat(np.arange(len(some)), sizes)
        inside = owner[:n] == owner[run - 1 :] if n else np.zeros(0, bool)
        at = owner[:n][inside] * bins + (runs * np.uint32(0x2C1B3C6D) >> shift)[inside]
        found[first : first + len(some)] = np.minimum(np.bincount(at, minlength=len(some) * bins), 255).astype(np.uint8).reshape(-1, bins)
    return found


def likely_pairs(lines: list[str], x: np.ndarray, y: np.ndarray, most: np.ndarray, run: int, bins: int) -> np.ndarray:
    """Whether pairs (x, y) of lines have as many runs in common as lines that are at most so many edits apart; no such pair is left out."""
    found = np.empty(len(x), bool)
    for first in range(0, len(x), PAIRS_AT_ONCE):
        own = slice(first, first + PAIRS_AT_ONCE)
        used, at = np.unique(np.concatenate([x[own], y[own]]), return_inverse=True)
        texts = [lines[k] for k in used.tolist()]
        counts, size = run_counts(texts, run, bins), np.fromiter(map(len, texts), np.int64, len(texts))
        full = (counts == 255).any(1)
        i, j = at[: len(at) // 2], at[len(at) // 2 :]
        # An edit changes as many runs as one has characters; full bins may hold more.
        least = np.maximum(size[i], size[j]) - run + 1 - run * np.floor(most[own])
        found[own] = full[i] | full[j] | (np.minimum(counts[i], counts[j]).sum(1, dtype=np.int32) >= least)
    return found


def alike(lines: list[str], x: np.ndarray, y: np.ndarray, similarity: float) -> np.ndarray:
    """Whether pairs (x, y) of normalised lines have the edit similarity, given by their places in lines."""
    size = np.fromiter(map(len, lines), np.int64, len(lines))
    most = np.maximum(size[x], size[y]) * (1 - similarity) + 1e-9
    left = np.flatnonzero(np.abs(size[x] - size[y]) <= most)
    for run, bins in FILTERS:
        left = left[likely_pairs(lines, x[left], y[left], most[left], run, bins)]
    keep, rest = np.zeros(len(x), bool), []
    for k, i, j, enough in zip(left.tolist(), x[left].tolist(), y[left].tolist(), most[left].tolist()):
        # What differs between most pairs is one place, no longer than the edits allowed.
        v, w = trimmed(lines[i], lines[j])
        keep[k] = max(len(v), len(w)) <= enough
        if not keep[k]:
            rest.append((k, v, w) if len(v) <= len(w) else (k, w, v))
    at = np.array([k for k, _, _ in rest], np.int64)
    keep[at] = within_edits([v for _, v, _ in rest], [w for _, _, w in rest], most[at])
    return keep


def _alike(similarity: float):
    """Rows of (a, b, x, y) to the (a, b) whose texts x and y, normalised, have the edit similarity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            coded = pa.concat_arrays([batch.column("x"), batch.column("y")]).dictionary_encode()
            at = np.asarray(coded.indices)
            keep = alike(coded.dictionary.to_pylist(), at[: batch.num_rows], at[batch.num_rows :], similarity)
            yield batch.select(["a", "b"]).filter(pa.array(keep))

    return run


def pairs_met(start: np.ndarray, root: np.ndarray, block: np.ndarray, one: np.ndarray, size: np.ndarray, mark: np.ndarray, similarity: float, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows (i, j), j < i, that meet: of one place, different roots and, unless the place is of one block, different blocks, whose sizes and SimHashes are near enough. start: where the place of each row begins."""
    firsts, seconds = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    place, live, lag = np.arange(len(start)) - start, np.arange(len(start)), 0
    while len(live):
        lag += 1
        live = live[place[live] >= lag]
        before = live - lag
        own = (root[live] != root[before]) & (one[live] | (block[live] != block[before])) & (np.bitwise_count(mark[live] ^ mark[before]) <= bits)
        i, j = live[own], before[own]
        own = np.minimum(size[i], size[j]) >= similarity * np.maximum(size[i], size[j]) - 1e-9
        firsts.append(i[own]), seconds.append(j[own])
    i, j = np.concatenate(firsts), np.concatenate(seconds)
    order = np.argsort(i, kind="stable")  # pairs of a line are counted together
    return i[order], j[order]


def _met(similarity: float, bits: int):
    """Rows of meetings() to the roots (a, b) of members that have the edit similarity, for different ones."""

    def links(rows: pa.Table) -> pa.RecordBatch:
        bucket, x, y = (np.asarray(c) for c in rows.column("place").combine_chunks().flatten())
        root, block, size, mark = (np.asarray(rows.column(c)) for c in ("root", "block", "size", "mark"))
        starts = once([bucket, x, y])
        start = np.repeat(starts, np.diff(np.append(starts, len(bucket))))
        i, j = pairs_met(start, root, block, x == y, size, mark, similarity, bits)
        used, at = np.unique(np.concatenate([i, j]), return_inverse=True)
        lines = rows.column("text").take(pa.array(used)).to_pylist()
        keep = alike(lines, at[: len(i)], at[len(i) :], similarity)
        edges = np.unique(np.sort(np.array([root[i[keep]], root[j[keep]]]), axis=0), axis=1)
        return pa.RecordBatch.from_arrays([pa.array(edges[0]), pa.array(edges[1])], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            # The last place may go on in the next batch.
            parts = [np.asarray(c) for c in batch.column("place").flatten()]
            last = int(once(parts)[-1])
            if held and last == 0 and batch.column("place")[0] != held[-1].column("place")[-1]:
                yield links(pa.Table.from_batches(held))
                held = []
            elif last:
                yield links(pa.Table.from_batches([*held, batch.slice(0, last)]))
                held = []
            held.append(batch.slice(last))
        if held:
            yield links(pa.Table.from_batches(held))

    return run


def _normal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(half, text) with the text normalised."""
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(map(normalised, batch.column(1).to_pylist()), pa.string())], names=["half", "text"])


def line_texts(keyed: DataFrame, wanted: DataFrame, rules: LineRules) -> DataFrame:
    """(half, text) of wanted lines (half, first), normalised, from the document of each one's first occurrence; a table of cut()."""
    places = wanted.select("half", "first.*")
    by_doc = places.groupBy("doc_id", "text_hash").agg(F.collect_list(F.struct("line", "half")).alias("lines"))  # of one document
    if wanted.count() <= rules.broadcast_lines:
        by_doc = F.broadcast(by_doc)
    at = F.col("d.doc_id").eqNullSafe(F.col("w.doc_id")) & (F.col("d.text_hash") == F.col("w.text_hash"))
    opened = keyed.alias("d").join(by_doc.alias("w"), at).select(F.split("d.text", "\n").alias("all"), F.explode("w.lines").alias("one"))
    return cut(opened.select("one.half", F.get("all", F.col("one.line")).alias("text")).groupBy("half").agg(F.min("text").alias("text")).mapInArrow(lean(_normal), "half long, text string"), "line-texts")


def duplicate_lines(docs: DataFrame, rules: LineRules = LineRules()) -> DataFrame:
    """Every line that isn't its group's first occurrence: doc_id, text_hash (xxhash64 of the text), line; repeated rows give repeats."""
    keyed = docs.select("doc_id", F.xxhash64(whole_text()).alias("text_hash"), whole_text().alias("text"))
    rows = cut(keyed.mapInArrow(lean(_lines(rules.min_chars)), "doc_id long, text_hash long, line int, k1 long, k2 long, members binary"), "lines")
    lines = rows.where("k1 is not null").select("doc_id", "text_hash", "line", F.struct("k1", "k2").alias("k"))
    place = F.struct("doc_id", "text_hash", "line")

    # Lines are linked by half of their key: 64 bits. Lengths too far apart for the similarity make no pair, nor do SimHashes that differ like chance.
    sorted_out = cut(packed_pairs(rows.where("members is not null").select("members"), rules.lags, rules.similarity, BITS), "line-members")
    near = cut(sorted_out.where("bucket is null").select("a", "b").distinct(), "near-lines")
    distinct = cut(lines.groupBy("k").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n")), "distinct-lines")

    # Members of a bucket that its order may keep apart are compared after the first links, with the same texts.
    members = sorted_out.where("bucket is not null").select("bucket", F.col("a").alias("k"), F.shiftright("size", 32).alias("size"), F.col("size").bitwiseAND(F.lit((1 << 32) - 1)).alias("mark"))
    halves = near.select(F.explode(F.array("a", "b")).alias("half")).unionByName(members.select(F.col("k").alias("half"))).distinct()
    wanted = cut(distinct.withColumn("half", F.col("k.k1")).join(halves, "half"), "wanted-lines")
    texts = line_texts(keyed, wanted, rules)
    x, y = texts.select(F.col("half").alias("a"), F.col("text").alias("x")), texts.select(F.col("half").alias("b"), F.col("text").alias("y"))
    spread = near.join(x, "a").repartition(partitions(docs), "b")  # few bytes, but much work
    links = cut(spread.join(y, "b").select("a", "b", "x", "y").mapInArrow(lean(_alike(rules.similarity)), near.schema), "line-links")
    roots = components(links, "line-groups")
    # All other pairs of a bucket that could still join two groups, however far apart its order has them.
    more = cut(meetings(members, roots, texts).mapInArrow(lean(_met(rules.similarity, BITS)), near.schema).distinct(), "line-meetings")
    if more.take(1):
        roots = merged(roots, more, "line-groups")
    # Lines without a link keep their own first occurrence; only the others need their group's.
    linked = cut(wanted.join(roots, F.col("half") == F.col("node")).select("k", "half", "first", "n", "root"), "linked-lines")
    discard(sorted_out, near, wanted, texts, links, more)
    of_group = linked.join(linked.groupBy("root").agg(F.min("first").alias("kept")), "root").where((F.col("n") > 1) | (F.col("first") != F.col("kept"))).select("k", "kept")
    # Keys of repeated lines only, so that lines that occur once take no part in the join.
    alone = distinct.where("n > 1").join(linked.select(F.col("half").alias("k1")), F.col("k.k1") == F.col("k1"), "left_anti").select("k", F.col("first").alias("kept"))
    of_key = alone.unionByName(of_group)
    return lines.join(of_key, "k").where(place != F.col("kept")).select("doc_id", "text_hash", "line")


def dedup_report(docs: DataFrame, rules: LineRules = LineRules()) -> DataFrame:
    """doc_id, n_lines, n_removed and removed (line numbers from 0, in order) for every row of docs (doc_id, text).

    Null text: one empty line, like an empty one. Blank lines stay; lines under
    min_chars go only as exact repeats. Rows with equal doc_id
    and text are one document: they lose the same lines. Null doc_ids come first. An empty table gives
    no rows; extra columns are left out.
    """
    dropped = duplicate_lines(docs, rules).groupBy("doc_id", "text_hash").agg(F.array_sort(F.collect_set("line")).alias("removed"))
    rows = docs.select("doc_id", F.xxhash64(whole_text()).alias("text_hash"), F.size(F.split(whole_text(), "\n")).alias("n_lines"))
    at = F.col("d.doc_id").eqNullSafe(F.col("r.doc_id")) & (F.col("d.text_hash") == F.col("r.text_hash"))
    removed = F.coalesce("r.removed", F.array().cast("array<int>"))
    return rows.alias("d").join(dropped.alias("r"), at, "left").select("d.doc_id", "d.n_lines", F.size(removed).alias("n_removed"), removed.alias("removed"))


def remove_lines(docs: DataFrame, rules: LineRules = LineRules()) -> DataFrame:
    """docs (doc_id, text) with all its columns, the text without its duplicate lines.

    A null text stays null, an empty one empty, and blank lines stay; n_chars follows the text if there is
    one. Rows with equal doc_id and text lose the same lines, and a null doc_id is like any other. A
    document of duplicate lines only keeps its row, with an empty text. An empty table gives no rows; columns
    of any other name go through unchanged.
    """
    of_doc, of_hash, dropped_lines = fresh(docs, "lines_doc", "lines_hash", "lines_dropped")
    dropped = duplicate_lines(docs, rules).groupBy(F.col("doc_id").alias(of_doc), F.col("text_hash").alias(of_hash)).agg(F.collect_set("line").alias(dropped_lines))
    at = F.col("doc_id").eqNullSafe(F.col(of_doc)) & (F.xxhash64(whole_text()) == F.col(of_hash))

    names, schema = docs.columns, docs.schema

    def without(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, sizes = [], []
            for text, lines in zip(batch.column("text"), batch.column(dropped_lines)):
                text, lines = text.as_py(), lines.as_py()
                if text is not None and lines:
                    gone = set(lines)
                    text = "\n".join(line for k, line in enumerate(text.split("\n")) if k not in gone)
                texts.append(text), sizes.append(None if not lines or text is None else len(text))
            changed = {"text": pa.array(texts, pa.string())}
            if "n_chars" in names:
                old = batch.column("n_chars").to_pylist()
                changed["n_chars"] = pa.array([o if s is None else s for o, s in zip(old, sizes)], batch.column("n_chars").type)
            yield pa.RecordBatch.from_arrays([changed.get(c, batch.column(k)) for k, c in enumerate(names)], names=names)

    return docs.join(dropped, at, "left").select(*[F.col(f"`{c}`") for c in names], dropped_lines).mapInArrow(lean(without, 1000), schema)
