"""Models and sketches against slow versions in plain Python."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from inkwell.llm import decontaminate, graph, language_id, near_dups
from inkwell.llm.bpe import pack

# ---- near-duplicates: document frequencies -----------------------------------------------------


def test_common_shingles_are_counted_exactly(spark):
    r = random.Random(3)
    texts = [" ".join(r.choice("abc") for _ in range(r.randrange(0, 30))) + f" {'boiler plate of many pages ' * (i % 40 == 0)} t{i} u{i} v{i} w{i} x{i}" for i in range(900)]
    docs = spark.createDataFrame([(t,) for t in texts] + [("",), (" ",)], "text string").repartition(7)
    known, df = near_dups.WordHashes(), Counter()
    for t in texts:
        df.update(near_dups.shingles(t, known)[0].tolist())
    found = near_dups.frequencies(docs)
    want = {h: n for h, n in df.items() if n >= near_dups.COMMON * 902}
    assert found.documents == 902 and found.common.tolist() == sorted(want) and len(want) > 20
    factors = [1 + near_dups.SPAN * min(1, math.log(903 / want[h]) / near_dups.CAP) for h in sorted(want)]
    assert np.allclose(found.factors, factors)


def test_a_crowded_sketch_loses_no_shingle(spark, monkeypatch):
    monkeypatch.setattr(near_dups, "SKETCH_BITS", 15)
    monkeypatch.setattr(near_dups, "SKETCH_ROWS", 1)
    test_common_shingles_are_counted_exactly(spark)


# ---- lines: neighbours of packed members -------------------------------------------------------


@pytest.mark.parametrize("hot", [False, True])
def test_packed_neighbours_are_those_of_rows(spark, hot):
    r = random.Random(5)
    members = []
    for k in range(400):
        keys = [r.randrange(40) << graph.TAIL | r.randrange(3) << 8 | r.randrange(3) for _ in range(4)]
        members.append((k * 7919 - 10**6, keys, r.randrange(10, 14) << 32 | r.randrange(16)))
    if hot:
        members += [(10**7 + k, [(99 << graph.TAIL) | k % 5] * 4, 12 << 32) for k in range(3000)]
    packed = [(pack(np.array([m[0] for m in some], np.int64).view(np.uint64), np.array([m[1] for m in some], np.int64).ravel().view(np.uint64), np.array([m[2] for m in some], np.int64).view(np.uint64)),) for some in (members[i::5] for i in range(5))]
    dealt = spark.createDataFrame(packed, "members binary").repartition(3)
    found = {(x.a, x.b) for x in graph.packed_neighbours(dealt, 2, 0.8, 3).collect()}
    if not hot:
        keyed = spark.createDataFrame([(key, k, size) for k, keys, size in members for key in keys], "key long, k long, size long")
        assert found == {(x.a, x.b) for x in graph.neighbours(keyed, keyed.limit(0), 2, 0.8, 3).collect()}
    else:
        touched = Counter(x for pair in found for x in pair if x >= 10**7)
        assert len(touched) > 2900 and len(found) < 4 * 4 * len(members)  # dealt to several parts, and still no row alone
    everything = {(x.a, x.b) for x in graph.packed_neighbours(dealt, 10_000 if not hot else 2).collect()}
    assert all(a <= b for a, b in everything) and len(everything) >= len(found)
    assert graph.packed_neighbours(dealt.limit(0)).collect() == []


# ---- benchmark items of every length -----------------------------------------------------------


def test_items_of_every_length_are_found_at_their_share_of_edits(spark):
    r = random.Random(11)
    word = lambda: "".join(r.choice("bcdfghklmnprst") + r.choice("aeiou") for _ in range(3))
    items = [(n, " ".join(word() for _ in range(n))) for n in range(1, 25)]
    docs, want = [], set()
    for n, text in items:
        for edits in {0, int(0.2 * n), int(0.2 * n) + 1}:
            for kind in range(3):
                words = text.split()
                for at in sorted(r.sample(range(n), min(n, edits)), reverse=True):
                    words[at : at + (kind != 1)] = [] if kind == 2 else [word()]
                docs.append(" ".join([word() for _ in range(12)] + words + [word() for _ in range(12)]))
                if edits <= int(0.2 * n):
                    want.add((len(docs) - 1, n))
    found = {(x.doc_id, x.item_id) for x in decontaminate.find_leaks(spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    known = decontaminate.WordHashes()
    exact = {(d, n) for d, t in enumerate(docs) for n, u in items if decontaminate.best_stretch(decontaminate.hashed(u, known), decontaminate.hashed(t, known))[0] <= int(0.2 * n)}
    assert want <= exact and found <= exact and len(found) >= 0.99 * len(exact) and {(d, n) for d, n in exact if n == 5} <= found
    given = spark.createDataFrame([(0, "alpha beta zeta delta epsilon")], "doc_id long, text string")
    leaks = decontaminate.find_leaks(given, spark.createDataFrame([(i, "alpha beta gamma delta epsilon") for i in range(50)], "item_id long, text string"), decontaminate.LeakRules(items_at_once=1)).collect()
    assert sorted(x.item_id for x in leaks) == list(range(50)) and {x.edits for x in leaks} == {1}


# ---- languages ---------------------------------------------------------------------------------


def slow_trigrams(text):
    import unicodedata

    letters = "".join(c if unicodedata.category(c)[0] in "LM" and c.isalnum() else " " for c in text.lower())
    letters = f" {' '.join(letters.split())} "
    if letters == "  ":
        return None
    found = []
    for a, b, c in zip(letters, letters[1:], letters[2:]):
        x = (ord(a) * 0x9E3779B1 & 0xFFFFFFFF) ^ (ord(b) * 0x85EBCA77 & 0xFFFFFFFF) ^ (ord(c) * 0xC2B2AE3D & 0xFFFFFFFF)
        found.append(((x ^ x >> 15) * 0x2C1B3C6D & 0xFFFFFFFF) >> 18)
    return found


def slow_predictions(samples, texts, rules):
    """Language and probability of every text, by loops over bits and trigrams."""
    languages = sorted(samples)
    codes = language_id.codewords(len(languages), rules.bits).tolist()
    bits = range(len(codes[0]))
    share, kept = [], []
    for i, language in enumerate(languages):
        rows = [h for t in samples[language] if (h := slow_trigrams(t))]
        total = Counter()
        for k, h in enumerate(rows):
            if k % 4 == 3:
                kept.append((i, h))
                continue
            for x, n in Counter(h).items():
                total[x] += n / len(h)
        scale = sum(total.values()) + 1e-4 * language_id.BUCKETS
        share.append({x: (n + 1e-4) / scale for x, n in total.items()} | {None: 1e-4 / scale})
    of = lambda i, x: share[i].get(x, share[i][None])

    def margins(h):
        got = []
        for b in bits:
            sides = [[i for i in range(len(languages)) if codes[i][b] == sign] for sign in (1, -1)]
            got.append(sum(n * (math.log(sum(of(i, x) for i in sides[0]) / len(sides[0])) - math.log(sum(of(i, x) for i in sides[1]) / len(sides[1]))) for x, n in Counter(h).items()) / len(h))
        return got

    right = [sum((m[b] > 0) == (codes[i][b] > 0) for i, m in ((i, margins(h)) for i, h in kept)) / len(kept) for b in bits]
    weight = [min(1.0, max(0.05, 2 * x - 1)) for x in right]
    found = []
    for t in texts:
        h = slow_trigrams(t or "")
        if not h:
            found.append(("und", 0.0))
            continue
        m = margins(h)
        loss = [sum(math.log1p(math.exp(-rules.sharpness * codes[i][b] * m[b])) * weight[b] for b in bits) for i in range(len(languages))]
        p = [math.exp(min(loss) - x) for x in loss]
        found.append((languages[p.index(max(p))], max(p) / sum(p)))
    return found


def test_languages_equal_a_slow_version(spark):
    r = random.Random(2)
    letters = {"x": "abcdefgh é", "y": "abefijkl ü", "z": "αβγδεζηθ "}
    text = lambda lang, n: "".join(r.choice(letters[lang]) for _ in range(n))
    rows = [(i, text(lang, r.randrange(5, 60)), lang) for i, lang in enumerate(r.choice("xyz") for _ in range(150))]
    rows += [(1000, None, "x"), (1001, "12 ½ Ⅷ ²", "x"), (1002, "a½b Ⅷc", None), (1003, "", "y"), (1004, text("z", 9000), None)]
    found = {x.doc_id: x for x in language_id.predict_languages(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    import zlib

    rules, samples = language_id.LanguageRules(), {}
    learnt = {(lang, t) for i, t, lang in rows if lang and t and zlib.crc32(str(i).encode()) % 3 != 1}
    for lang, t in sorted(learnt):
        samples.setdefault(lang, []).append(t)
    for (i, _, _), (lang, score) in zip(rows, slow_predictions(samples, [t for _, t, _ in rows], rules)):
        assert found[i].lang_pred == lang and abs(found[i].score - score) < 1e-6, i
    assert found[1001].lang_pred == "und" and F is not None


def test_letters_are_the_same_in_ascii_and_other_texts():
    for t in ("12 ab_c Ⅷ d½e ²", "ab c d e", "", "١٢", "́", "aе́ǅ ª º ꟲ", "\x00a\x1f"):
        slow, fast = slow_trigrams(t), language_id.trigrams(t)
        assert (slow is None) == (fast is None)


@pytest.mark.parametrize("hot", [False, True])
def test_members_further_apart_meet_as_well(spark, hot):
    """All pairs of a bucket that share a sample of the tail, are alike in size and differ in few bits: from the order, and from who is left."""
    r = random.Random(12)
    rows = {k: [((1 if hot or b else r.randrange(9)) << graph.TAIL | r.randrange(3) << 8 | r.randrange(3)) + (b << 40) for b in range(2)] for k in range(240)}
    sizes = {k: r.choice([10, 11, 40]) << 32 | r.randrange(32) for k in rows}
    packed = [(pack(*(np.array(x, np.int64).view(np.uint64) for x in ([k for k in some], [y for k in some for y in rows[k]], [sizes[k] for k in some]))),) for some in (range(0, 150), range(140, 240))]
    out = graph.packed_pairs(spark.createDataFrame(packed, "members binary"), 2, 0.8, 3)
    found = {(x.a, x.b) for x in out.where("bucket is null").collect()}
    members = out.where("bucket is not null").selectExpr("bucket", "a as k", "shiftright(size, 32) as size", "size & 4294967295 as mark")
    others = {(x.a, x.b) for x in graph.other_pairs(members, spark.createDataFrame([], "node long, root long"), 0.8, 3).collect()}

    def close(a, b):
        shared = any(x >> 16 == y >> 16 and ((x ^ y) & 255 == 0 or (x ^ y) >> 8 & 255 == 0) for x, y in zip(rows[a], rows[b]))
        x, y = sizes[a], sizes[b]
        return shared and min(x >> 32, y >> 32) >= 0.8 * max(x >> 32, y >> 32) and ((x ^ y) & 31).bit_count() <= 3

    want = {(a, b) for a in rows for b in rows if a < b and close(a, b)}
    assert found < want and found | others == want
