"""Weak labels, compression distances and automata against slow versions."""

import math
import random
from collections import Counter

import zstandard
from pyspark.sql import functions as F

from inkwell.llm import line_dedup, secrets, toxicity, weak_quality

# ---- weak labels -------------------------------------------------------------------------------


def slow_estimate(documents, rounds):
    """Dawid and Skene's model, document by document."""
    votes = [list(map(int, d)) for d in documents]
    believed = []
    for v in votes:
        good, bad = v.count(weak_quality.GOOD), v.count(weak_quality.BAD)
        believed.append(0.9 if good > 2 * bad else 0.1 if bad >= good else 0.5)
    for _ in range(rounds):
        share = (sum(believed) + 1) / (len(votes) + 2)
        rate = {}
        for j in range(len(votes[0])):
            for side in (0, 1):
                n = {k: 0.5 + sum((p if side else 1 - p) for v, p in zip(votes, believed) if v[j] == k) for k in (0, 1, 2)}
                for k in n:
                    rate[j, side, k] = n[k] / sum(n.values())
        new = []
        for v in votes:
            odds = math.log(share / (1 - share)) + sum(math.log(rate[j, 1, k] / rate[j, 0, k]) for j, k in enumerate(v) if k != weak_quality.ABSTAIN)
            new.append(1 / (1 + math.exp(-max(-30.0, min(30.0, odds)))))
        done = max(abs(a - b) for a, b in zip(new, believed)) < 1e-6
        believed = new
        if done:
            break
    return share, rate, believed


def test_estimate_equals_a_slow_version():
    r = random.Random(4)
    truth = [r.random() < 0.7 for _ in range(400)]
    accuracy = [0.95, 0.9, 0.8, 0.7, 0.6]
    documents = ["".join("2" if r.random() < 0.2 else str(int(t if r.random() < a else not t)) for a in accuracy) for t in truth]
    share, table, posterior = weak_quality.estimate(Counter(documents), 60)
    slow_share, rate, believed = slow_estimate(documents, 60)
    assert abs(share - slow_share) < 1e-9 and all(abs(table[j, side, k] - x) < 1e-9 for (j, side, k), x in rate.items())
    assert all(abs(posterior[d] - p) < 1e-9 for d, p in zip(documents, believed))
    assert sum((p > 0.5) == t for t, p in zip(truth, believed)) > 370 and abs(share - 0.7) < 0.1


def slow_score(text, weights, base):
    """A text's score from its features, one by one."""
    words = weak_quality.SPACE.findall(text)
    odds = base
    for w in words:
        odds += (weights[weak_quality.bucket(w)] + weights[weak_quality.bucket("/" + weak_quality.shape(w))]) / len(words)
    for k, x in enumerate(weak_quality.statistics(text, words)):
        odds += weights[weak_quality.bucket(f"#{k}:{round(4 * math.log1p(20 * x))}")]
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, odds))))


def test_quality_scores_equal_a_slow_version(spark):
    r = random.Random(7)
    texts = [" ".join(r.choice(["the", "of", "Word", "x1", "###", "and.", "é"]) for _ in range(r.randrange(0, 80))) + r.choice([".", "", "\n"]) for _ in range(120)] + [None, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    weights, base = weak_quality.fit_model(docs, weak_quality.QualityRules())
    found = {x.doc_id: x for x in weak_quality.score_quality(docs).collect()}
    assert all(abs(found[k].score - slow_score(t or "", weights, base)) < 1e-9 for k, t in enumerate(texts))
    kept = {x.doc_id for x in weak_quality.keep_good(docs).collect()}
    assert kept == {k for k, t in enumerate(texts) if slow_score(t or "", weights, base) >= 0.5} == {k for k in found if found[k].kept}
    forgetful = weak_quality.Scorer(weights, base, 1)
    assert [forgetful.score(t or "") for t in texts] == [found[k].score for k in range(len(texts))]


# ---- compression distance ----------------------------------------------------------------------


def test_toxicity_scores_equal_window_by_window_compression():
    r = random.Random(8)
    word = lambda n: "".join(r.choice("bdfgklmnprst") + r.choice("aeiou") for _ in range(n))
    plain, bad = [word(r.randrange(1, 4)) for _ in range(300)], [word(4) for _ in range(4)]
    ordinary = [" ".join(r.choice(plain) for _ in range(r.randrange(3, 90))) for _ in range(120)]
    toxic = [" ".join(r.choice(plain if r.random() < 0.8 else bad) for _ in range(r.randrange(10, 90))) for _ in range(60)]
    content, mixed, odds, weights = toxicity.fit(toxic, ordinary, 0.3, toxicity.ToxicityRules())

    def size(window, dictionary):
        d = zstandard.ZstdCompressionDict(dictionary, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        p = zstandard.ZstdCompressionParameters(window_log=17, chain_log=14, hash_log=14, search_log=5, min_match=5, target_length=64, strategy=zstandard.STRATEGY_GREEDY, write_content_size=False, write_checksum=False, write_dict_id=False)
        d.precompute_compress(compression_params=p)
        return len(zstandard.ZstdCompressor(compression_params=p, dict_data=d).compress(window))

    def slowly(text):
        words, coded = toxicity.WORDS.findall(text.lower()), toxicity.Coded()
        starts = [k for k in range(0, len(words), toxicity.STEP) if k == 0 or k + toxicity.WINDOW - toxicity.STEP < len(words)]
        gains = []
        for k in starts:
            window = b"".join(coded[w] for w in words[k : k + toxicity.WINDOW])
            gains.append(max(toxicity.LEAST, min(toxicity.MOST, size(window, content) - size(window, mixed))))
        own = sorted((odds[g - toxicity.LEAST] for g in gains), reverse=True)
        high = sum(x for x in own if x > 1)
        row = [1, high, sum(own), max([0, *own]), 20 * high / max(1, len(own)), math.log(max(1, len(own)) + 1), sum(own[:3])]
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, sum(a * b for a, b in zip(row, weights))))))

    texts = toxic[:10] + ordinary[:10] + ["", "one", f"{bad[0]} {bad[1]}", "ö Ä ß " * 30]
    fast = toxicity.probability(toxicity.histograms(texts, toxicity.compressor(content), toxicity.compressor(mixed), toxicity.Coded()), odds, weights)
    assert all(abs(a - slowly(t)) < 1e-9 for a, t in zip(fast, texts))
    assert (fast[:10] > 0.5).sum() >= 9 and (fast[10:20] > 0.5).sum() <= 1


# ---- automata ----------------------------------------------------------------------------------


class SlowAutomaton:
    """Merging by sets of prefixes: a state is the set of prefixes that lead to it, and its counts are taken from the values themselves."""

    def __init__(self, values, alpha):
        self.values = [tuple(secrets.symbols(v)) for v in values]
        self.bound = math.sqrt(0.5 * math.log(2 / alpha))
        self.state_of = {p: p for v in self.values for p in (v[:k] for k in range(len(v) + 1))}
        kept, frontier = [()], [((), s) for s in sorted({v[0] for v in self.values if v})]
        while frontier:
            above, s = frontier.pop(0)
            state = self.find(above + (s,)) if above + (s,) in self.state_of else self.step(above, s)
            if state in kept:
                continue
            match = next((k for k in kept if self.compatible(k, state)), None)
            if match is None:
                kept.append(state)
                frontier += [(state, x) for x in sorted(self.after(state)[0])]
            else:
                self.merge(match, state)
                frontier += [(k, x) for k in kept for x in sorted(self.after(k)[0]) if self.step(k, x) not in kept]
        self.kept = kept

    def find(self, prefix):
        while self.state_of[prefix] != prefix:
            prefix = self.state_of[prefix]
        return prefix

    def members(self, state):
        return [p for p in self.state_of if self.find(p) == state]

    def after(self, state):
        """Symbols that follow a state, and how often it is the end."""
        inside, follows, stops = set(self.members(state)), Counter(), 0
        for v in self.values:
            for k in range(len(v) + 1):
                if v[:k] in inside:
                    if k == len(v):
                        stops += 1
                    else:
                        follows[v[k]] += 1
        return follows, stops

    def step(self, state, s):
        return next(self.find(p + (s,)) for p in self.members(state) if p + (s,) in self.state_of)

    def alike(self, f, n, g, m):
        return not n or not m or abs(f / n - g / m) < self.bound * (1 / math.sqrt(n) + 1 / math.sqrt(m))

    def compatible(self, a, b):
        (x, p), (y, q) = self.after(a), self.after(b)
        n, m = x.total() + p, y.total() + q
        return self.alike(p, n, q, m) and all(self.alike(x[s], n, y[s], m) and (s not in x or s not in y or self.compatible(self.step(a, s), self.step(b, s))) for s in x | y)

    def merge(self, a, b):
        below = [(self.step(a, s), self.step(b, s)) for s in self.after(a)[0] if s in self.after(b)[0]]
        self.state_of[b] = a
        for x, y in below:
            if self.find(x) != self.find(y):
                self.merge(self.find(x), self.find(y))

    def likelihood(self, value):
        state, total = (), 0.0
        for s in [*secrets.symbols(value), secrets.STOP]:
            follows, stops = self.after(state)
            total += math.log(((stops if s == secrets.STOP else follows[s]) + 0.1) / (follows.total() + stops + 0.1 * len(secrets.SYMBOLS)))
            if s in follows:
                state = self.step(state, s)
        return total


def test_automata_equal_merging_by_prefixes():
    r = random.Random(9)
    forms = {"key": lambda: "ab" + "".join(r.choice("0123456789") for _ in range(r.randrange(3, 6))), "mixed": lambda: r.choice(["x", "Y"]) + "-" + "".join(r.choice("abcXYZ019") for _ in range(4)), "loop": lambda: "z" + "0g" * r.randrange(0, 5)}
    for make in forms.values():
        values = [make() for _ in range(60)]
        for alpha in (0.05, 0.5):
            fast, slow = secrets.Automaton(values, alpha), SlowAutomaton(values, alpha)
            assert len(fast.kept) == len(slow.kept)
            table = fast.table()
            for v in [*values[:8], "ab12", "q", "", "ab" * 5]:
                assert abs(secrets.likelihood(table, v) - slow.likelihood(v)) < 1e-9, v


def test_added_spans_equal_brute_force(spark):
    r = random.Random(10)
    key = lambda: "tk" + "".join(r.choice("0123456789ABCDEF") for _ in range(14))
    texts = [f"say token = {key()} and more words of prose here {i}" for i in range(80)] + [f"bare {key()} in running prose, path/to_{key()}.txt" for _ in range(30)] 
    texts += [" ".join("".join(r.choice("etaoinshrdlu") for _ in range(r.randrange(3, 11))) for _ in range(60)) for _ in range(60)]
    rows = list(enumerate(texts))
    found = {x.doc_id: [(s.start, s.stop, s.kind) for s in x.spans] for x in secrets.find_secrets(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    rest, labelled = [], {}
    for _, t in rows:
        spans, runs = secrets.spans_and_rest(t)
        rest += [t[a:b] for a, b in runs]
        for _, k, _, v in spans:
            labelled.setdefault(secrets.KINDS[k], set()).add(v)
    order = {k: [x.v for x in spark.createDataFrame([(v,) for v in vs], "v string").orderBy(F.xxhash64("v"), "v").collect()] for k, vs in labelled.items()}
    tables, pairs, least = secrets.fit(order, secrets.bigram_counts(Counter(rest)), secrets.SecretRules())
    for i, t in rows:
        want = [(s, e, secrets.KINDS[k]) for s, k, e, _ in secrets.spans_and_rest(t)[0]]
        for a, b in secrets.spans_and_rest(t)[1]:
            run, places = t[a:b], set()
            for x in range(len(run)):
                for y in range(x + secrets.ASSIGN_LEAST, len(run) + 1):
                    edge = lambda p, marks: p in (0, len(run)) or run[p - 1 if p == x else p] in marks
                    for marks in ("+/_.=-", *"+/_.=-"):
                        if edge(x, marks) and edge(y, marks) and not set(run[x:y]) & set(marks):
                            places.add((x, y))
            places.add((0, len(run)))
            best = sorted((-g * (y - x), x, y) for x, y in places if (g := secrets.gain(tables, pairs, run[x:y])) >= least)
            taken = []
            for _, x, y in best:
                if all(y <= p or q <= x for p, q in taken):
                    taken.append((x, y))
            want += [(a + x, a + y, secrets.FORMAT) for x, y in taken]
        assert found[i] == sorted(want, key=lambda s: (s[0], [*secrets.KINDS, secrets.FORMAT].index(s[2]), s[1])), t
    assert sum(k == "format" for s in found.values() for _, _, k in s) > 25


# ---- lines: filters of pairs -------------------------------------------------------------------


def test_similar_lines_equal_edit_distance():
    r = random.Random(12)
    words = ["".join(r.choice("abcdefg") for _ in range(r.randrange(1, 9))) for _ in range(60)]

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, last = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
        return row[-1]

    for _ in range(400):
        a = [r.choice(words) for _ in range(r.randrange(1, 14))]
        b = list(a)
        for _ in range(r.randrange(0, 4)):
            k = r.randrange(len(b) + 1)
            b[k : k + r.randrange(2)] = [r.choice(words)] * r.randrange(2)
        x, y = " ".join(a), " ".join(b)
        assert distance(x, y) == line_dedup.edit_distance(x, y) == line_dedup.edit_distance(*line_dedup.trimmed(x, y))
        assert line_dedup.similar(x, y, 0.8) == (distance(x, y) <= max(len(x), len(y)) * 0.2 + 1e-9)
        n = line_dedup.shared_start(x, y)
        assert x[:n] == y[:n] and (n == min(len(x), len(y)) or x[n] != y[n])


def test_runs_of_lines_are_counted_as_one_by_one():
    r = random.Random(13)
    lines = ["".join(r.choice("abc é日") for _ in range(r.randrange(0, 40))) for _ in range(50)] + ["", "a", "ab", "aaa" * 200]
    counts = line_dedup.run_counts(lines)
    assert [int(c.sum()) for c in counts[:-1]] == [max(0, len(t) - 2) for t in lines[:-1]] and counts[-1].max() == 255
    for t, c in zip(lines, counts):
        assert (line_dedup.run_counts([t, "xyz"])[0] == c).all()


def test_runs_settled_at_once_are_those_scored_one_by_one():
    r = random.Random(8)
    of = lambda letters, n: "".join(r.choice(letters) for _ in range(n))
    labelled = {"assign": ["ghx_" + of("ABCDabcd0123", 20) for _ in range(60)], "hex": [of("0123456789abcdef", 24) for _ in range(40)]}
    runs = {of("abcxyzABC019+/_.=-", r.randrange(6, 30)) for _ in range(2000)} | {f"{of('abc', 7)}.{v}" for v in labelled["assign"]} | set(labelled["hex"])
    counts = secrets.bigram_counts(Counter({run: 1 + len(run) % 3 for run in runs}))
    slow = Counter()
    for run in runs:
        for pair in zip(["^", *secrets.symbols(run)], [*secrets.symbols(run), secrets.STOP]):
            slow[pair] += 1 + len(run) % 3
    assert counts == slow
    fitted = secrets.fit(labelled, counts, secrets.SecretRules())
    learned, one_by_one = secrets.Found(*fitted), secrets.Found(*fitted)
    values = sorted(runs)
    assert all(abs(g - secrets.gain(*fitted[:2], v)) < 1e-9 for v, g in zip(values, learned.gains(values).tolist()))
    learned.learn(runs)
    assert 0 < len(learned) < len(runs) and {v: list(learned[v]) for v in runs} == {v: list(one_by_one[v]) for v in runs}
    for run in ["abcdef", "abc.defghi_jk", "....", "a-b+c/d=e_f.ghijklm"]:
        assert secrets.places_in(run) == {(0, len(run)), *(m.span() for p in secrets.PIECES for m in p.finditer(run))}
