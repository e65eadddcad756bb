"""Secret scan: base patterns, and probabilistic automata inferred from what those patterns label.

The values that the base patterns find are labelled credentials. For each kind, their prefix tree is
folded by merging statistically compatible states (Hoeffding bound on stop and symbol frequencies)
into a deterministic probabilistic automaton over character classes. Every other run of credential
characters in every document, from the shortest that the base patterns label on, what base spans leave
of a run, and the pieces of either at separators are scored by their log-likelihood under the automata
against that under the class bigrams of all such runs in the corpus; those that score like held-out
credentials do become spans of kind ``format``, of overlapping ones the one with the most nats.
"""

from __future__ import annotations

import math
import re
from collections import Counter, deque
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkwell.llm.common import cut, discard, lean, whole_text

# Fixed values of the base rules.
KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(
    r"(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])"
    r"[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
)
ASSIGN_LEAST = 6
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
#: Runs of credential characters; matches of ACCESS and HEX lie inside one of BASE_LEAST at least.
RUN = re.compile(r"(?<![A-Za-z0-9+/_.=-])[A-Za-z0-9+/_.=-]{%d,}" % ASSIGN_LEAST)
BASE_LEAST = 20
#: The pieces of a run: between any separators, and between those of one kind.
PIECES = [re.compile(r"[^+/_.=-]{%d,}" % ASSIGN_LEAST), *(re.compile(r"[^%s]{%d,}" % (re.escape(c), ASSIGN_LEAST)) for c in "+/_.=-")]
FORMAT = "format"
#: Character classes of the automata; any other character stands for itself.
CLASSES = {c: "0" for c in "0123456789"} | {c: "a" for c in "abcdef"} | {c: "g" for c in "ghijklmnopqrstuvwxyz"} | {c: "A" for c in "ABCDEF"} | {c: "G" for c in "GHIJKLMNOPQRSTUVWXYZ"}
STOP = "$"
SYMBOLS = [*dict.fromkeys(CLASSES.values()), *"+/_.=-", STOP]


@dataclass(frozen=True)
class SecretRules:
    #: Labelled credentials of each kind that an automaton is fitted on: those of the least hashes.
    sample: int = 2000
    #: Confidence of the compatibility test.
    alpha: float = 0.05
    #: Share of held-out credentials that may score below the threshold, and its floor in nats a character.
    quantile: float = 0.02
    least_gain: float = 0.25


def base_spans(text: str, runs: list[tuple[int, int]]) -> list[tuple[int, int, int, str]]:
    """(start, index of kind, end, value) of the base matches, in order; runs: those of RUN in the text."""
    found = []
    if ":" in text or "=" in text:
        found += [(m.start(), 0, m.end(), m[1]) for m in ASSIGN.finditer(text) if len(m[1]) >= ASSIGN_LEAST]
    for a, b in runs:
        if b - a < BASE_LEAST:
            continue
        run = text[a:b]
        if "AKIA" in run:
            found += [(a + m.start(), 1, a + m.end(), m[0]) for m in ACCESS.finditer(run)]
        found += [(a + m.start(), 2, a + m.end(), m[0]) for m in HEX.finditer(run)]
    return sorted(found)


SPAN = "array<struct<start:int,stop:int,kind:string,value:string>>"


PAIRS = "array<struct<a:string,b:string,n:long>>"


def spans_and_rest(text: str) -> tuple[list[tuple[int, int, int, str]], list[tuple[int, int]]]:
    """The base spans, and where runs lie that no base span covers; what one leaves of a run is a run."""
    runs = [m.span() for m in RUN.finditer(text)]
    spans = base_spans(text, runs)
    if not spans:
        return spans, runs
    rest, first = [], 0
    spans_at = sorted((s, e) for s, _, e, _ in spans)
    for a, b in runs:
        while first < len(spans_at) and spans_at[first][1] <= a:
            first += 1
        for s, e in spans_at[first:]:
            if s >= b:
                break
            if s - a >= ASSIGN_LEAST:
                rest.append((a, s))
            a = max(a, e)
        if b - a >= ASSIGN_LEAST:
            rest.append((a, b))
    return spans, rest


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, text) to doc_id, base spans, and with the first row of a batch the class bigrams of its other runs."""
    kind_of = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("kind", pa.string()), ("value", pa.string())]))
    pair_of = pa.list_(pa.struct([("a", pa.string()), ("b", pa.string()), ("n", pa.int64())]))
    for batch in batches:
        if not batch.num_rows:
            continue
        base, values = [], Counter()
        for text in batch.column(1).to_pylist():
            spans, rest = spans_and_rest(text)
            base.append([dict(zip(("start", "stop", "kind", "value"), (s, e, KINDS[k], v))) for s, k, e, v in spans])
            values.update(text[a:b] for a, b in rest)
        pairs = [[{"a": a, "b": b, "n": n} for (a, b), n in sorted(bigram_counts(values).items())], *[[]] * (len(base) - 1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(base, kind_of), pa.array(pairs, pair_of)], names=["doc_id", "base", "pairs"])


def symbols(value: str) -> list[str]:
    return [CLASSES.get(c, c) for c in value]


class Automaton:
    """A deterministic probabilistic automaton over symbols, from a prefix tree with merged states."""

    def __init__(self, values: list[str], alpha: float) -> None:
        self.stops, self.edges, self.weights = [0], [{}], [{}]
        for value in values:
            state = 0
            for s in symbols(value):
                if s not in self.edges[state]:
                    self.edges[state][s] = len(self.edges)
                    self.weights[state][s] = 0
                    self.stops.append(0)
                    self.edges.append({})
                    self.weights.append({})
                self.weights[state][s] += 1
                state = self.edges[state][s]
            self.stops[state] += 1
        self.bound = math.sqrt(0.5 * math.log(2 / alpha))
        self._merge_states()

    def total(self, state: int) -> int:
        return self.stops[state] + sum(self.weights[state].values())

    def _alike(self, f: int, n: int, g: int, m: int) -> bool:
        return not n or not m or abs(f / n - g / m) < self.bound * (1 / math.sqrt(n) + 1 / math.sqrt(m))

    def _compatible(self, one: int, other: int) -> bool:
        """Stop and symbol frequencies agree here and, symbol by symbol, below; other is the root of a tree."""
        pairs = [(one, other)]
        while pairs:
            a, b = pairs.pop()
            n, m = self.total(a), self.total(b)
            if not self._alike(self.stops[a], n, self.stops[b], m):
                return False
            for s in self.edges[a].keys() | self.edges[b].keys():
                if not self._alike(self.weights[a].get(s, 0), n, self.weights[b].get(s, 0), m):
                    return False
                if s in self.edges[a] and s in self.edges[b]:
                    pairs.append((self.edges[a][s], self.edges[b][s]))
        return True

    def _fold(self, into: int, tree: int) -> None:
        """Add the counts of a tree to the automaton from a state on; branches the state lacks are hung there."""
        pairs = [(into, tree)]
        while pairs:
            a, b = pairs.pop()
            self.stops[a] += self.stops[b]
            for s, below in self.edges[b].items():
                if s in self.edges[a]:
                    self.weights[a][s] += self.weights[b][s]
                    pairs.append((self.edges[a][s], below))
                else:
                    self.edges[a][s], self.weights[a][s] = below, self.weights[b][s]

    def _merge_states(self) -> None:
        """Keep or merge states, nearest to the root first; kept ones form the automaton."""
        kept, is_kept = [0], {0}
        frontier = deque((0, s) for s in sorted(self.edges[0]))
        while frontier:
            above, s = frontier.popleft()
            state = self.edges[above][s]
            if state in is_kept:
                continue
            match = next((k for k in kept if self._compatible(k, state)), None)
            if match is None:
                kept.append(state)
                is_kept.add(state)
                frontier.extend((state, x) for x in sorted(self.edges[state]))
            else:
                self.edges[above][s] = match
                self._fold(match, state)
                frontier.extend((k, x) for k in kept for x in sorted(self.edges[k]) if self.edges[k][x] not in is_kept)
        self.kept = kept

    def table(self) -> dict[int, dict[str, tuple[float, int]]]:
        """state -> symbol -> (log-probability, next state), smoothed; unseen symbols keep the state."""
        found = {}
        for state in self.kept:
            n = self.total(state) + 0.1 * len(SYMBOLS)
            found[state] = {s: (math.log(((self.stops[state] if s == STOP else self.weights[state].get(s, 0)) + 0.1) / n), self.edges[state].get(s, state)) for s in SYMBOLS}
        return found


def likelihood(table: dict[int, dict[str, tuple[float, int]]], value: str) -> float:
    state, found = 0, 0.0
    for s in [*symbols(value), STOP]:
        gain, state = table[state][s]
        found += gain
    return found


#: A number for each symbol, by its character; the last one stands for the beginning of a value.
CODES = np.zeros(128, np.int64)
for _c in map(chr, range(33, 127)):
    CODES[ord(_c)] = SYMBOLS.index(CLASSES.get(_c, _c)) if CLASSES.get(_c, _c) in SYMBOLS else 0
BEGIN = len(SYMBOLS)


def coded(values: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The symbols of some values of credential characters one after the other, where each begins, and its length."""
    sizes = np.fromiter(map(len, values), np.int64, len(values))
    return CODES[np.frombuffer("".join(values).encode("ascii"), np.uint8)], np.cumsum(sizes) - sizes, sizes


def bigram_counts(values: Counter) -> Counter:
    some = [v for v in values if v]
    if not some:
        return Counter()
    codes, starts, sizes = coded(some)
    times, wide = np.fromiter((values[v] for v in some), np.int64, len(some)), BEGIN + 1
    before = np.concatenate([[BEGIN], codes[:-1]])
    before[starts] = BEGIN
    pairs = np.concatenate([before * wide + codes, codes[starts + sizes - 1] * wide + SYMBOLS.index(STOP)])
    n = np.bincount(pairs, np.concatenate([np.repeat(times, sizes), times]), wide * wide)
    names = [*SYMBOLS, "^"]
    return Counter({(names[p // wide], names[p % wide]): int(n[p]) for p in np.flatnonzero(n).tolist()})


def background(counts: dict[tuple[str, str], int]) -> dict[tuple[str, str], float]:
    sums = {a: sum(counts.get((a, b), 0) for b in SYMBOLS) for a in ["^", *SYMBOLS]}
    return {(a, b): math.log((counts.get((a, b), 0) + 0.1) / (sums[a] + 0.1 * len(SYMBOLS))) for a in ["^", *SYMBOLS] for b in SYMBOLS}


def gain(tables: list[dict], pairs: dict[tuple[str, str], float], value: str) -> float:
    """Nats a character by which the best automaton beats the background."""
    classes = symbols(value)
    plain = sum(map(pairs.__getitem__, zip(["^", *classes], [*classes, STOP])))
    return (max(likelihood(t, value) for t in tables) - plain) / len(value)


def fit(labelled: dict[str, list[str]], counts: dict[tuple[str, str], int], rules: SecretRules) -> tuple[list[dict], dict, float]:
    """Automata, background and threshold; every fifth credential is held out for the threshold."""
    tables, held, pairs = [], [], background(counts)
    for kind in KINDS:
        values = labelled.get(kind, [])
        own = [v for i, v in enumerate(values) if i % 5 or len(values) < 5]
        if own:
            tables.append(Automaton(own, rules.alpha).table())
            held += [v for i, v in enumerate(values) if not i % 5]
    gains = sorted(gain(tables, pairs, v) for v in held) if tables else []
    return tables, pairs, max(rules.least_gain, gains[int(rules.quantile * len(gains))] if gains else 0.0)


def places_in(run: str) -> set[tuple[int, int]]:
    """A run and its pieces between separators."""
    places = {(0, len(run))}
    if not run.isalnum():
        kinds = [k for k, c in enumerate("+/_.=-", 1) if c in run]  # without a separator, its pieces are the run
        for k in kinds if len(kinds) == 1 else [0, *kinds]:
            places.update(m.span() for m in PIECES[k].finditer(run))
    return places


class Found(dict):
    """run -> (start, stop) in it of what scores like a credential."""

    def __init__(self, tables: list[dict], pairs: dict[tuple[str, str], float], threshold: float) -> None:
        self.fitted, self.threshold = (tables, pairs), threshold
        self.plain = np.array([[pairs[a, b] for b in SYMBOLS] for a in [*SYMBOLS, "^"]])
        self.automata = []
        for table in tables:
            number = {state: k for k, state in enumerate(table)}
            steps = [[table[state][x] for x in SYMBOLS] for state in table]
            self.automata.append((np.array([[g for g, _ in row] for row in steps]), np.array([[number.get(to, 0) for _, to in row] for row in steps]), number[0]))

    def gains(self, values: list[str]) -> np.ndarray:
        """gain() of each value but for rounding; a step for all values at once, the longest first."""
        codes, starts, sizes = coded(values)
        order = np.argsort(-sizes, kind="stable")
        starts, sizes = starts[order], sizes[order]
        stop, n = SYMBOLS.index(STOP), len(values)
        left = np.searchsorted(-sizes, -np.arange(int(sizes.max(initial=0))), "left").tolist()  # values longer than each step
        plain, last = np.zeros(n), np.full(n, BEGIN)
        states, found = [np.full(n, first) for _, _, first in self.automata], [np.zeros(n) for _ in self.automata]
        for step, m in enumerate(left):
            now = codes[starts[:m] + step]
            plain[:m] += self.plain[last[:m], now]
            last[:m] = now
            for (gain_of, to, _), state, total in zip(self.automata, states, found):
                total[:m] += gain_of[state[:m], now]
                state[:m] = to[state[:m], now]
        plain += self.plain[last, stop]
        best = np.max([total + gain_of[state, stop] for (gain_of, _, _), state, total in zip(self.automata, states, found)], axis=0)
        back = np.empty(n)
        back[order] = (best - plain) / sizes
        return back

    def learn(self, runs: set[str]) -> None:
        """Settle new runs of which no place comes near the threshold, all at once; the others are scored one by one when they are asked for."""
        new = [run for run in runs if run not in self]
        places = [{run[a:b] for a, b in places_in(run)} for run in new]
        values = list(set().union(*places))
        high = {v for v, g in zip(values, self.gains(values).tolist()) if g >= self.threshold - 1e-6} if values else set()
        for run, own in zip(new, places):
            if high.isdisjoint(own):
                self[run] = ()

    def __missing__(self, run: str) -> list[tuple[int, int]]:
        scored = ((gain(*self.fitted, run[a:b]), a, b) for a, b in places_in(run))
        best = sorted((-g * (b - a), a, b) for g, a, b in scored if g >= self.threshold)
        self[run] = chosen = []
        for _, a, b in best:
            if all(b <= x or y <= a for x, y in chosen):
                chosen.append((a, b))
        return chosen


def find_secrets(docs: DataFrame, rules: SecretRules = SecretRules()) -> DataFrame:
    """doc_id and spans (start, stop, kind; code points, stop exclusive, in order) of every whole text of docs (doc_id, text).

    Null and empty texts have no spans. Repeated rows give repeated rows, an empty table none; extra
    columns are left out. Without labelled credentials nothing is added to the base spans.
    """
    texts = docs.select("doc_id", whole_text().alias("text"))
    scanned = cut(texts.mapInArrow(lean(_scan, 1000), f"doc_id long, base {SPAN}, pairs {PAIRS}"), "secret-spans")

    values = scanned.select(F.explode("base").alias("s")).groupBy("s.kind", "s.value").agg(F.count(F.lit(1)).alias("n"))
    labelled: dict[str, list[str]] = {}
    for kind in KINDS:  # at most rules.sample values each
        rows = values.where(F.col("kind") == kind).orderBy(F.xxhash64("value"), "value").limit(rules.sample).select("value").collect()
        labelled[kind] = [r.value for r in rows]

    pairs = scanned.select(F.explode("pairs").alias("p")).groupBy("p.a", "p.b").agg(F.sum("p.n").alias("n"))
    fitted = fit(labelled, {(r.a, r.b): r.n for r in pairs.collect()}, rules)  # at most one row for each pair of classes
    discard(scanned)

    def score(batches: Iterator[pa.RecordBatch], memory_runs: int = 100_000) -> Iterator[pa.RecordBatch]:
        known = Found(*fitted)
        for batch in batches:
            found, texts = [], batch.column(1).to_pylist()
            apart = [spans_and_rest(text) for text in texts]
            if fitted[0]:
                known.learn({text[a:b] for text, (_, rest) in zip(texts, apart) for a, b in rest})
            for text, (base, rest) in zip(texts, apart):
                order = [(s, k, e) for s, k, e, _ in base]
                if fitted[0]:
                    order += [(a + x, len(KINDS), a + y) for a, b in rest for x, y in known[text[a:b]]]
                found.append([{"start": s, "stop": e, "kind": (*KINDS, FORMAT)[k]} for s, k, e in sorted(order)])
                if len(known) > memory_runs:  # forgetting costs time only
                    known.clear()
            spans = pa.array(found, pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("kind", pa.string())])))
            yield pa.RecordBatch.from_arrays([batch.column(0), spans], names=["doc_id", "spans"])

    return texts.mapInArrow(lean(score, 1000), "doc_id long, spans array<struct<start:int,stop:int,kind:string>>")


def digest(found: DataFrame) -> DataFrame:
    """Counts by base kind, the base spans' hash and all spans as text."""
    of = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    said = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")
    return found.select("doc_id", *map(of, KINDS), F.sha2(said(F.filter("spans", lambda s: s["kind"] != FORMAT)).cast("binary"), 256).alias("base_sha256"), said(F.col("spans")).alias("spans"))
