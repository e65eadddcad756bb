"""Each operator against brute force on small fixtures, and on nulls, empty texts and tables, ties, repeats and extra columns."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from inkwell.llm import bpe, decontaminate, graph, host_rules, language_id, line_dedup, near_dups, secrets, sharding, toxicity, weak_quality

SCHEMA = "doc_id long, text string, lang string, source string, k string, bands string, root string"


def frame(spark, texts, **columns):
    rows = [(i, t, columns.get("lang", "en"), columns.get("source", "s"), "x", "y", "z") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


def odd(spark):
    """Nulls in every column, empty, blank and long texts, repeated rows and ties, clashing extra columns."""
    rows = [(1, None, None, None, None, None, None), (None, "a b c d e f", None, None, "", "", ""), (2, "", "en", "s", "", "", ""), (3, " \n\t ", "en", "s", "", "", ""), (4, "word " * 60000, "en", "s", "", "", "")]
    rows += [(5, "one two three four five six seven", "en", "s", "", "", "")] * 3 + [(6, "one two three four five six seven", "en", "s", "", "", "")]
    return spark.createDataFrame(rows, SCHEMA)


def prose(seed, words, vocabulary=4000):
    r = random.Random(seed)
    return " ".join(f"w{r.randrange(vocabulary)}" for _ in range(words))


RUNS = {
    "sharding": lambda d: sharding.assign_shards(d),
    "bpe": lambda d: bpe.round_trip(d, tokenizer()),
    "near": lambda d: near_dups.near_duplicates(d),
    "host": lambda d: host_rules.apply_host_rules(d),
    "lines": lambda d: line_dedup.dedup_report(d),
    "quality": lambda d: weak_quality.score_quality(d),
    "language": lambda d: language_id.predict_languages(d),
    "toxicity": lambda d: toxicity.score_toxicity(d, d.selectExpr("doc_id", "0 as toxic")),
    "secrets": lambda d: secrets.digest(secrets.find_secrets(d)),
}


def tokenizer():
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@pytest.mark.parametrize("name", RUNS)
def test_odd_rows(spark, name):
    docs = odd(spark)
    found = RUNS[name](docs).collect()
    assert Counter(r.doc_id for r in found) == Counter(r.doc_id for r in docs.collect())


@pytest.mark.parametrize("name", RUNS)
def test_empty_table(spark, name):
    assert RUNS[name](frame(spark, ["x"]).where("false")).collect() == []


def test_leaks_odd_rows(spark):
    items = spark.createDataFrame([(1, "one two three four five six seven"), (None, None), (2, "")], "item_id long, text string")
    found = decontaminate.find_leaks(odd(spark), items).collect()
    assert Counter((r.doc_id, r.item_id) for r in found) == {(5, 1): 3, (6, 1): 1}
    assert decontaminate.find_leaks(odd(spark).where("false"), items).collect() == []
    assert decontaminate.find_leaks(odd(spark), items.where("false")).collect() == []


# ---- 1 -----------------------------------------------------------------------------------------


def test_shards_follow_the_ring(spark):
    docs = frame(spark, [f"text {i % 40}" for i in range(700)]).unionByName(frame(spark, ["same"] * 1)).unionByName(frame(spark, ["same"]))
    found = sharding.assign_shards(docs, shards=5, replicas=8).collect()
    counts = Counter(r.shard for r in found)
    assert len(found) == 702 and max(counts.values()) - min(counts.values()) <= 1
    for shard in counts:
        assert sorted(r.slot for r in found if r.shard == shard) == list(range(counts[shard]))
    assert all(r.text_crc32 is not None and r.grown_shard is None and r.law == "rows" for r in found)


def test_overflow_runs_match_a_key_by_key_walk():
    ring, shards, r = sharding.virtual_nodes(4, 6), 4, random.Random(3)
    counts = {arc: r.randrange(0, 30) for arc in range(len(ring))}
    room = sharding.capacities(sum(counts.values()), shards)
    waiting, want, step = [(a, k) for a in sorted(counts) for k in range(counts[a])], {}, 0
    while waiting:
        later = []
        for a, k in waiting:
            shard = ring[(a + step) % len(ring)][1]
            if room[shard]:
                room[shard] -= 1
                want[a, k] = shard
            else:
                later.append((a, k))
        waiting, step = later, step + 1
    got = {(a, k): s for a, lo, hi, s, _ in sharding.overflow_runs(counts, ring, shards) for k in range(lo, hi)}
    assert got == want


def test_one_more_shard_moves_few_rows(spark):
    docs = frame(spark, [f"text {i}" for i in range(3000)])
    a = {r.doc_id: r.shard for r in sharding.assign_shards(docs, 16).collect()}
    b = {r.doc_id: r.shard for r in sharding.assign_shards(docs, 17).collect()}
    moved = sum(a[k] != b[k] for k in a) / len(a)
    assert moved < 0.12  # one of 17 must move, dealing anew would move 16 of 17


def test_many_copies_of_one_row(spark, monkeypatch):
    monkeypatch.setattr(sharding, "CHUNK", 16)
    docs = spark.createDataFrame([(7, "t")] * 300 + [(i, "u") for i in range(100)], "doc_id long, text string")
    found = sharding.assign_shards(docs, 3, 4).collect()
    assert sorted(Counter(r.shard for r in found).values()) == [133, 133, 134]
    assert len({(r.shard, r.slot) for r in found}) == 400


# ---- 2 -----------------------------------------------------------------------------------------

TEXTS = [None, "", " a", "a  b\n\n c", "<|endoftext|>x <|endoftext|>", "it's 'S don't", "日本語 テスト 12３ ½", "\x1c\x1d a\x85b\xa0c", "😀😀 é́", "   ", "\r\n  x", "naïve ²³ ª", "ꟑ Ɐ"]


@pytest.mark.parametrize("block_chars", [1, 30, 1 << 20])
def test_bpe_equals_the_library(spark, block_chars):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokenizer())
    coded = bpe.encode(frame(spark, TEXTS + [prose(1, 500)]), tokenizer(), block_chars=block_chars, memory_words=3)
    for r in bpe.decode(coded, tokenizer()).collect():
        text = (TEXTS + [prose(1, 500)])[r.doc_id] or ""
        ids = tok.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(bytes(r.ids), "<u4").tolist() == ids and r.n_tokens == len(ids)
        assert r.text == tok.decode(ids, skip_special_tokens=False)


def test_bpe_splits_without_the_vocabulary_and_encodes_some_words_at_a_time():
    import json

    from tokenizers import Tokenizer

    with open(tokenizer(), encoding="utf-8") as f:
        spec = json.load(f)
    bare, texts = json.dumps(bpe.bare(spec)), [t or "" for t in TEXTS] + [prose(1, 500)]
    assert len(bare) < 10_000 and spec["model"]["vocab"]
    assert [bpe.Splitter(bare).words(t) for t in texts] == [bpe.Splitter(json.dumps(spec)).words(t) for t in texts]

    class Counting:
        tok, most = Tokenizer.from_file(tokenizer()), 0

        def encode_batch_fast(self, words, **how):
            self.most = max(self.most, len(words))
            return self.tok.encode_batch_fast(words, **how)

    counting, words = Counting(), [f" w{i}" for i in range(2 * bpe.WORDS_AT_ONCE + 1)]
    assert list(bpe.encoded(counting, words)) == [np.array(counting.tok.encode(w, add_special_tokens=False).ids, "<u4").tobytes() for w in words]
    assert counting.most == bpe.WORDS_AT_ONCE


# ---- 3 -----------------------------------------------------------------------------------------


def edited(text, share, seed):
    r, words = random.Random(seed), text.split()
    for i in r.sample(range(len(words)), max(1, int(share * len(words)))):
        words[i] = f"e{r.randrange(10**6)}"
    return " ".join(words)


def test_near_classes_equal_brute_force(spark):
    base = [prose(i, 150) for i in range(30)]
    texts = base + [edited(base[i % 10], 0.01, i) for i in range(40)] + base[:5] + [edited(base[20], 0.3, 1), "a b", "a b", "", None]
    found = {r.doc_id: r.class_id for r in near_dups.near_duplicates(frame(spark, texts)).collect()}
    known = near_dups.WordHashes()
    sets = [near_dups.shingles(t or "", known) for t in texts]
    df = Counter(h for s in sets for h in s[0].tolist())
    often = np.array(sorted(h for h, n in df.items() if n >= near_dups.COMMON * len(texts)), np.uint64)
    n = np.array([df[h] for h in often.tolist()], float)
    model = near_dups.Frequencies(len(texts), often, 1 + near_dups.SPAN * np.minimum(1, np.log((len(texts) + 1) / n) / near_dups.CAP))
    weighted = [(h, model.weights(h, c)) for h, c in sets]
    root = list(range(len(texts)))
    find = lambda x: x if root[x] == x else find(root[x])
    for i in range(len(texts)):
        for j in range(i):
            if (texts[i] or "") == (texts[j] or "") or near_dups.weighted_jaccard(weighted[i], weighted[j]) >= 0.8:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    assert found == {i: find(i) for i in range(len(texts))}


def test_samples_agree_as_often_as_the_sets_do():
    r, sampler = np.random.default_rng(2), near_dups.Sampler(2000)
    elements = np.unique(r.integers(0, 1 << 63, 300, np.uint64))
    a, b = r.uniform(0.2, 3, len(elements)), r.uniform(0.2, 3, len(elements))
    want = np.minimum(a, b).sum() / np.maximum(a, b).sum()
    same = (sampler.least(elements, a) == sampler.least(elements, b)).mean()
    assert abs(same - want) < 0.05


def test_keep_one_row_of_each_class(spark):
    texts = [prose(1, 80)] * 4 + [prose(2, 80)]
    docs = frame(spark, texts).unionByName(frame(spark, texts).where("doc_id = 0"))
    kept = near_dups.keep_one(docs)
    assert sorted(r.doc_id for r in kept.collect()) == [0, 4] and kept.columns == docs.columns


def test_components(spark):
    edges = [(i, i + 1) for i in range(50)] + [(100, i) for i in range(101, 140)] + [(200, 201), (201, 200)]
    found = {r.node: r.root for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {i: 0 for i in range(51)} | {i: 100 for i in range(100, 140)} | {200: 200, 201: 200}


# ---- 4 -----------------------------------------------------------------------------------------


def test_counts_by_hand(spark):
    text = "a b c d e f\na b c d e f\n\n#x a b c d e é"
    r = host_rules.apply_host_rules(frame(spark, [text])).first()
    words = text.split()
    grams = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    covered = {p for i in range(len(words) - 4) if grams[tuple(words[i : i + 5])] > 1 for p in range(i, i + 5)}
    assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(words), sum(map(len, words)), 1, 1, len(covered))
    assert r.base_failed and not r.kept


def test_bad_hosts_take_their_documents_along(spark):
    good, bad = frame(spark, [prose(i, 40) for i in range(30)], source="good"), frame(spark, ["x y"] * 29 + [prose(99, 40)], source="bad")
    found = host_rules.apply_host_rules(good.unionByName(bad)).collect()
    assert sum(r.kept for r in found) == 30 and sum(not r.base_failed for r in found) == 31


# ---- 5 -----------------------------------------------------------------------------------------


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_edit_distance():
    r = random.Random(1)
    for _ in range(300):
        a, b = ("".join(r.choice("abc") for _ in range(r.randrange(14))) for _ in "ab")
        assert line_dedup.edit_distance(a, b) == distance(a, b)


def test_lines_equal_brute_force(spark):
    base = [prose(i, 60, 300) for i in range(12)]
    docs = [f"{base[i % 12]}\nshort line\n{edited(base[(i * 5) % 12], 0.015, i)}" for i in range(30)] + [None, ""]
    found = {r.doc_id: r.removed for r in line_dedup.dedup_report(frame(spark, docs)).collect()}
    lines = [(i, k, line_dedup.normalised(x)) for i, t in enumerate(docs) for k, x in enumerate((t or "").split("\n")) if x.strip()]
    of = similar_groups(sorted({x for _, _, x in lines}))
    first, want = {}, {i: [] for i in range(len(docs))}
    for i, k, x in lines:
        first.setdefault(of[x], (i, k))
    for i, k, x in lines:
        if (i, k) != first[of[x]]:
            want[i].append(k)
    assert found == want and any(want.values())


def test_removed_lines_leave_the_text(spark):
    line = prose(3, 20)
    docs = frame(spark, [f"a\n{line}\nb", f"{line}\nc", None])
    assert [r.text for r in line_dedup.remove_lines(docs).orderBy("doc_id").collect()] == [f"a\n{line}\nb", "c", None]


# ---- 6, 7, 8 -----------------------------------------------------------------------------------


def test_expectation_maximisation_recovers_accuracies():
    r, share, right = random.Random(4), 0.7, [0.95, 0.85, 0.7, 0.9]
    patterns = Counter()
    for _ in range(20000):
        good = r.random() < share
        patterns["".join(str(int(good if r.random() < p else not good)) for p in right)] += 1
    found, table, _ = weak_quality.estimate(dict(patterns), 300)
    assert abs(found - share) < 0.03
    assert all(abs(table[j, 1, 1] - p) < 0.03 for j, p in enumerate(right))


def test_junk_goes_and_prose_stays(spark):
    good = [" ".join(f"the {w} of and" for w in prose(i, 30).split()) + "." for i in range(60)]
    bad = ["the ### of%%% and*** " * 30 for _ in range(6)] + ["For " * 100 for _ in range(6)]
    found = {r.doc_id: r.kept for r in weak_quality.score_quality(frame(spark, good + bad)).collect()}
    assert all(found[i] for i in range(60)) and not any(found[i] for i in range(60, 72))
    assert weak_quality.keep_good(frame(spark, good + bad)).count() == 60


def test_codewords_tell_languages_apart():
    for n in (2, 3, 4, 5, 6, 9):
        codes = language_id.codewords(n, 31)
        assert len({tuple(c) for c in codes}) == n and all(len(set(c)) == 2 for c in codes.T)
    assert min((a != b).sum() for i, a in enumerate(language_id.codewords(4, 31)) for b in language_id.codewords(4, 31)[:i]) == 4


def test_languages_on_held_out_rows(spark):
    syllables = {"aa": ["ka", "lo", "mi"], "bb": ["str", "ung", "ach"], "cc": ["eau", "oux", "ille"]}
    r, rows = random.Random(5), []
    for i in range(240):
        lang = "abc"[i % 3] * 2
        rows.append((i, " ".join("".join(r.choice(syllables[lang]) for _ in range(3)) for _ in range(20)), lang))
    rows += [(900, "123 !?", "aa"), (901, None, "aa")]
    found = {x.doc_id: x for x in language_id.predict_languages(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert all(found[i].lang_pred == lang for i, _, lang in rows[:240])
    assert all(found[i].held_out == (zlib.crc32(str(i).encode()) % 3 == 1) for i in found)
    assert found[900].lang_pred == found[901].lang_pred == "und"


def test_toxicity_on_held_out_rows(spark):
    bad, r, texts, labels = ["grobiansk", "pfuiteufel", "schandmaul"], random.Random(6), [], []
    for i in range(300):
        words = prose(1000 + i, 60, 100000).split()
        if i % 4 == 0:
            for k in r.sample(range(60), 5):
                words[k] = r.choice(bad)
        texts.append(" ".join(words))
        labels.append((i, int(i % 4 == 0)))
    found = toxicity.score_toxicity(frame(spark, texts), spark.createDataFrame(labels, "doc_id long, toxic int")).collect()
    held = [x for x in found if x.held_out]
    assert sum(x.predicted == (x.doc_id % 4 == 0) for x in held) >= 0.9 * len(held) and all(0 <= x.score <= 1 for x in found)


# ---- 9 -----------------------------------------------------------------------------------------


def test_leaks_equal_brute_force(spark):
    items = [(i, prose(500 + i, n, 200)) for i, n in enumerate((15, 20, 30, 44, 55, 12, 9))]
    r, texts = random.Random(8), []
    for i in range(60):
        item = items[i % 7][1].split()
        for _ in range(r.randrange(0, 5)):
            k = r.randrange(len(item))
            kind = r.randrange(3)
            item[k : k + (kind != 1)] = [] if kind == 2 else [f"z{r.randrange(99)}"]
        texts.append(f"{prose(i, 40, 200)} {' '.join(item)} {prose(i + 99, 40, 200)}" if i % 3 else prose(i, 120, 200))
    found = decontaminate.find_leaks(frame(spark, texts), spark.createDataFrame(items, "item_id long, text string")).collect()
    known, want = decontaminate.WordHashes(), {}
    for i, t in enumerate(texts):
        h = decontaminate.hashed(t, known)
        for k, u in items:
            item = decontaminate.hashed(u, known)
            edits = decontaminate.best_stretch(item, h)[0]
            if edits <= decontaminate.most_edits(len(item), 0.2):
                want[i, k] = edits
    got = {(x.doc_id, x.item_id): x.edits for x in found}
    assert set(got) <= set(want) and len(got) >= 0.97 * len(want)
    assert len(want) > 20


def test_best_stretch_is_the_least_distance():
    r = random.Random(9)
    for _ in range(60):
        item, words = [r.randrange(4) for _ in range(r.randrange(1, 7))], [r.randrange(4) for _ in range(r.randrange(1, 12))]
        cost, a, b = decontaminate.best_stretch(np.array(item, np.uint64), np.array(words, np.uint64))
        assert cost == min(distance(item, words[i:j]) for i in range(len(words) + 1) for j in range(i, len(words) + 1)) == distance(item, words[a:b])


# ---- 10 ----------------------------------------------------------------------------------------

ASSIGN = re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def test_base_spans(spark):
    r = random.Random(10)
    hexes = ["".join(r.choice("0123456789abcdef") for _ in range(n)) for n in (23, 24, 40)]
    texts = [f'é token = "{h}" x AKIA{"Q" * n} {h}z' for h in hexes for n in (15, 16)] + ["password: token:abcdefgh", "Secret='x' API_KEY=abcdef", "ſecret=abcdefgh", "a=b", None]
    for row in secrets.digest(secrets.find_secrets(frame(spark, texts))).collect():
        t = texts[row.doc_id] or ""
        want = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(t) if len(m[1]) >= 6]
        want += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20] + [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
        said = ",".join(f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b in sorted(want))
        assert row.base_sha256 == hashlib.sha256(said.encode()).hexdigest()
        assert [row.n_assign, row.n_access, row.n_hex] == [sum(k == i for _, k, _ in want) for i in range(3)]


def test_automata_add_what_looks_like_a_credential(spark):
    r = random.Random(11)
    key = lambda: "zq" + "".join(r.choice("0123456789ABCDEF") for _ in range(30))
    texts = [f"secret={key()}" for _ in range(80)] + [f"{prose(i, 20)} {'anunremarkablylongword' * 2}" for i in range(80)] + [f"bare {key()} here"]
    found = {x.doc_id: x.spans for x in secrets.find_secrets(frame(spark, texts)).collect()}
    assert [(s.start, s.stop, s.kind) for s in found[160]] == [(5, 37, "format")]
    assert not any(found[i] for i in range(80, 160))


# ---- Findings of review 1 ----------------------------------------------------------------------


def similar_groups(lines):
    """line -> least line of its group, by edit similarity alone."""
    root = {x: x for x in lines}

    def find(x):
        return x if root[x] == x else find(root[x])

    for i, x in enumerate(lines):
        for y in lines[:i]:
            if line_dedup.edit_distance(x, y) <= 0.2 * max(len(x), len(y)) + 1e-9:
                a, b = find(x), find(y)
                root[max(a, b)] = min(a, b)
    return {x: find(x) for x in lines}


def test_lines_recall_by_edit_similarity_alone(spark):
    r, lines = random.Random(12), []
    for i in range(120):
        words = ["".join(r.choice("abcdefghijklmnop") for _ in range(r.choice((2, 3, 5, 6, 7, 9)))) for _ in range((10, 20, 30, 50)[i % 4])]
        lines.append(" ".join(words))
        for k in r.sample(range(len(words)), len(words) // 10):  # one word in ten replaced
            words[k] = "".join(r.choice("qrstuvwxyz") for _ in words[k])
        lines.append(" ".join(words))
    of = similar_groups(lines)
    found = {x.doc_id: x.removed for x in line_dedup.dedup_report(frame(spark, lines)).collect()}
    first = {}
    for i, x in enumerate(lines):
        first.setdefault(of[x], i)
    want = {i for i, x in enumerate(lines) if first[of[x]] != i}
    got = {i for i, removed in found.items() if removed}
    assert len(want) > 110 and got <= want and len(got) >= 0.97 * len(want)


def test_short_lines_and_scripts_without_spaces(spark):
    chinese = "今天天气很好我们一起去公园散步然后回家吃晚饭看电视节目听音乐再读一本有意思的书最后早点睡觉明天还要上班"
    docs = ["All rights reserved.\n\nOk", "all  rights reserved.\n\nok", f"x\n{chinese}", f"y\n{chinese}", f"z\n{chinese.replace('公园', '湖边')}", "\n\n \n"]
    found = {x.doc_id: x.removed for x in line_dedup.dedup_report(frame(spark, docs)).collect()}
    assert found == {0: [], 1: [0, 2], 2: [], 3: [1], 4: [1], 5: []}


def test_credentials_short_inside_runs_and_beside_base_spans(spark):
    r = random.Random(13)
    key = lambda: "zq" + "".join(r.choice("0123456789ABCDEF") for _ in range(10))
    texts = [f"secret={key()}" for _ in range(80)] + [f"{prose(i, 20)} unremarkable wording" for i in range(80)]
    one = key()  # the same in every place, so that only the place decides
    more = [f"bare {one} here", f"see /path/x={one}", f"{'0a' * 12}/{one}"]
    found = {x.doc_id: [(s.start, s.stop, s.kind) for s in x.spans] for x in secrets.find_secrets(frame(spark, texts + more)).collect()}
    assert found[160] == [(5, 17, "format")] and found[161] == [(12, 24, "format")]
    assert found[162] == [(0, 24, "hex"), (25, 37, "format")]
    assert not any(found[i] for i in range(80, 160))


# ---- Findings of the verdict on round 1 ----------------------------------------------------------


def test_numerals_are_no_letters(spark):
    rows = [(i, " ".join(["kalomi", "lokami"] * 9) if i % 2 else " ".join(["strung", "achung"] * 9), "ab"[i % 2]) for i in range(40)] + [(100, "½ ²³ Ⅷ", "a"), (101, "Ⅷ lokami", "a")]
    found = {r.doc_id: r.lang_pred for r in language_id.predict_languages(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert found[100] == "und" and found[101] != "und"


def test_short_and_unspaced_items_are_found(spark):
    chinese = "今天天气很好我们一起去公园散步然后回家吃晚饭"
    items = spark.createDataFrame([(1, chinese), (2, "two words"), (3, "Unicorn"), (4, "!?")], "item_id long, text string")
    docs = frame(spark, [f"前言{chinese}后记", f"前言{chinese.replace('公园', '湖边')}后记", "今天天气不好", "these are two, words here", "two more words", "a unicorn!", "a unicorns"])
    found = {(r.doc_id, r.item_id) for r in decontaminate.find_leaks(docs, items).collect()}
    assert found == {(0, 1), (1, 1), (3, 2), (5, 3)}
    assert sorted(r.doc_id for r in decontaminate.drop_leaks(docs, items).collect()) == [2, 4, 6]


def test_toxic_words_are_found_in_long_texts(spark):
    bad, texts, labels = ["grobiansk", "pfuiteufel", "schandmaul"], [], []
    for i in range(300):
        words = prose(3000 + i, 60 if i % 10 else 400, 100000).split()
        if i % 4 == 0:
            for k in range(4):
                words[len(words) // 5 * (k + 1)] = bad[(i + k) % 3]
        texts.append(" ".join(words))
        labels.append((i, int(i % 4 == 0)))
    found = toxicity.score_toxicity(frame(spark, texts), spark.createDataFrame(labels, "doc_id long, toxic int")).collect()
    held = [x for x in found if x.held_out]
    caught = [x.predicted for x in held if x.doc_id % 4 == 0]
    assert sum(caught) >= 0.9 * len(caught) and sum(x.predicted for x in held if x.doc_id % 4) <= 0.05 * len(held)


@pytest.mark.parametrize("piece", [1, 7, 1 << 20])
def test_windows_hold_every_word(monkeypatch, piece):
    monkeypatch.setattr(toxicity, "PIECE", piece)
    for n in (0, 1, 7, 8, 9, 13, 14, 60):
        words = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(n)]
        coded = toxicity.Coded()
        found = [w for p in toxicity.windows(" ".join(words), coded) for w in p]
        want = [b"".join(coded[w] for w in words[k : k + toxicity.WINDOW]) for k in range(0, max(1, n - toxicity.WINDOW + toxicity.STEP), toxicity.STEP)] if n else []
        assert found == want


def test_sorted_buckets_lose_no_pair_of_a_small_bucket(spark):
    r = random.Random(14)
    rows = [(r.randrange(40) << graph.TAIL | 5, k, 10 << 32) for k in range(120)]
    keyed = spark.createDataFrame(rows + rows[:30], "key long, k long, size long")
    found = {(x.a, x.b) for x in graph.neighbours(keyed, keyed.limit(0), lags=200).collect()}
    assert found == {(a, b) for x, a, _ in rows for y, b, _ in rows if x == y and a < b}
    few = graph.neighbours(keyed, keyed, lags=1)
    linked = {x.node: x.root for x in graph.components(few).collect()}
    least = {x: min(k for y, k, _ in rows if y == x) for x, _, _ in rows}
    assert all(linked.get(k, k) == least[x] for x, k, _ in rows)


def test_hot_buckets_are_dealt_to_several_tasks(spark):
    keyed = spark.range(3000).selectExpr("cast(id % 3 as bigint) * 65536 * 100 as key", "id as k", "1 as size").unionByName(spark.range(500).selectExpr("(id % 250 + 1000) * 65536 as key", "id + 10000 as k", "1 as size"))
    pairs = graph.neighbours(keyed, keyed)
    assert {(x.a, x.b) for x in pairs.where("a >= 10000").collect()} == {(10000 + i, 10250 + i) for i in range(250)}
    assert pairs.where("a < 10000").count() > 2900


def test_own_columns_of_any_name_go_through(spark):
    line = prose(3, 20)
    docs = spark.createDataFrame([(1, f"{line}\nx", "k", 7, 3), (2, f"{line}\ny", "k", 8, 4), (None, None, None, None, None)], "doc_id long, text string, _key string, _Lines int, n_chars int").withColumns({c: F.lit("own") for c in ("_doc", "_k", "_hash", "text_key", "kept_doc", "lines_doc", "lines_dropped", "a b")})
    kept = near_dups.keep_one(docs)
    assert kept.columns == docs.columns and {(r.doc_id, r._key, r._Lines, r._doc, r.text_key) for r in kept.collect()} == {(1, "k", 7, "own", "own"), (None, None, None, "own", "own")}
    cleaned = line_dedup.remove_lines(docs)
    assert cleaned.columns == docs.columns
    assert {(r.doc_id, r.text, r.n_chars, r["a b"], r.lines_dropped) for r in cleaned.collect()} == {(1, f"{line}\nx", 3, "own", "own"), (2, "y", 1, "own", "own"), (None, None, None, "own", "own")}


def test_values_of_odd_rows(spark):
    docs = odd(spark)
    near = {(r.doc_id, r.class_id, r.class_size) for r in near_dups.near_duplicates(docs).collect()}
    assert near == {(1, 1, 2), (2, 1, 2), (None, None, 1), (3, 3, 1), (4, 4, 1), (5, 5, 4), (6, 5, 4)}
    lines = sorted(((r.doc_id or 0, r.n_lines, r.removed) for r in line_dedup.dedup_report(docs).collect()))
    assert lines == [(0, 1, []), (1, 1, []), (2, 1, []), (3, 2, []), (4, 1, []), (5, 1, []), (5, 1, []), (5, 1, []), (6, 1, [0])]
    coded = {(r.doc_id, r.n_tokens) for r in bpe.round_trip(docs, tokenizer()).collect()}
    assert {(1, 0), (2, 0)} <= coded and (4, 60001) in coded or (4, 60000) in coded
    assert {r.predicted for r in toxicity.score_toxicity(docs, docs.selectExpr("doc_id", "0 as toxic")).collect()} == {0}


def test_bound_of_edits_is_one():
    r = random.Random(16)
    for _ in range(400):
        a, b = (" ".join(r.choice(["ab", "c", "abc", "de", "x", "yz"]) for _ in range(r.randrange(1, 8))) for _ in "ab")
        assert line_dedup.most_edits(a.split(" "), b.split(" ")) >= distance(a, b)


def test_automata_find_bare_credentials_of_labelled_formats(spark):
    r = random.Random(17)
    alnum, upper = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
    of = lambda letters, n: "".join(r.choice(letters) for _ in range(n))
    formats = [lambda: "ghx_" + of(alnum, 36), lambda: f"xo-{of('0123456789', 12)}-{of(alnum, 24)}", lambda: "SK" + of(upper, 30)]
    plain = [lambda: f"https://example.org/{of('abcdefghijklm', 9)}/{of('nopqrstu', 7)}.html", lambda: f"2024-0{r.randrange(1, 9)}-1{r.randrange(9)}T10:00", lambda: f"module_{of('abcdefghi', 6)}.function_{of('jklmnop', 8)}", lambda: f"v{r.randrange(9)}.{r.randrange(99)}.{r.randrange(9)}-beta", lambda: of("abcdefghijklmnopqrstuvwxyz", 22)]
    texts = [f'{prose(i, 8)} token = "{formats[i % 3]()}"' for i in range(240)]
    bare = [f"{prose(i, 5)} {formats[i % 3]()} {prose(i + 7, 5)}" for i in range(120)]
    clean = [f"{prose(i, 5)} {plain[i % 5]()} {plain[(i + 2) % 5]()}" for i in range(300)]
    found = {x.doc_id: [s for s in x.spans if s.kind == "format"] for x in secrets.find_secrets(frame(spark, texts + bare + clean)).collect()}
    caught = sum(bool(found[240 + i]) for i in range(120))
    false = sum(bool(found[360 + i]) for i in range(300))
    print("caught", caught, "false", false)
    assert caught >= 108 and false <= 15


def test_shards_are_written_whole(spark, tmp_path):
    docs = frame(spark, [f"text {i % 9}" for i in range(60)] + [None, ""]).unionByName(odd(spark))
    assigned = sharding.assign_shards(docs, 4, 8)
    sharding.write_shards(docs, assigned, str(tmp_path / "shards"))
    found = spark.read.parquet(str(tmp_path / "shards")).collect()
    assert Counter((r.doc_id, r.text) for r in found) == Counter((r.doc_id, r.text) for r in docs.collect())
    assert len({(r.shard, r.slot) for r in found}) == len(found) and Counter(r.shard for r in found) == Counter(r.shard for r in assigned.collect())


def test_pairs_far_apart_in_a_bucket_are_compared(spark):
    """A bucket of 3000 members, of which the order brings none together: all pairs of different components whose sizes fit."""
    members = spark.range(3000).select(F.lit(7).cast("long").alias("bucket"), F.col("id").alias("k"), F.when(F.col("id") < 40, 10.0).otherwise(F.pow(F.lit(1.01), F.col("id")) * 100).alias("size"))
    roots = spark.range(20, 3000).select(F.col("id").alias("node"), F.lit(20).cast("long").alias("root"))
    found = {(r.a, r.b) for r in graph.other_pairs(members, roots, 0.8).collect()}
    assert found == {(a, b) for a in range(20) for b in range(a + 1, 40)}
    assert graph.other_pairs(members.limit(0), roots.limit(0), 0.8).collect() == []


def test_a_link_that_the_order_misses_is_found(spark, monkeypatch):
    texts = [" ".join(f"w{(7 * i + j) % 5000}" for j in range(120)) for i in range(3)]
    texts += [t.replace(t.split()[60], "other") for t in texts]
    monkeypatch.setattr(near_dups, "neighbours", lambda keyed, some: keyed.sparkSession.createDataFrame([], "a struct<x:long,y:long>, b struct<x:long,y:long>"))
    found = {r.doc_id: r.class_id for r in near_dups.near_duplicates(frame(spark, texts)).collect()}
    assert all(found[i] == found[i + 3] for i in range(3))


def test_rare_elements_lead_to_every_similar_pair_and_few_others(spark):
    """500 sets of one bucket that have two thirds in common, some of them more: what all pairs give, from a few pairs."""
    r = random.Random(31)
    sets = {k: {h: 1.0 + h % 3 for h in r.sample(range(60), 58)} | {1000 + 30 * k + j: 2.0 for j in range(3 if k % 50 == 0 else 25)} for k in range(500)}
    sets |= {500 + k: dict(list(sets[k].items())[: -1 - k % 4]) for k in range(0, 500, 10)} | {2000: {5: 2.0}, 2001: {5: 2.0}}
    weighted = spark.createDataFrame([(k, h, w) for k, own in sets.items() for h, w in own.items()], "k long, h long, w double")

    def similarity(x, y):
        shared = sum(min(v, y[h]) for h, v in x.items() if h in y)
        return shared / (sum(x.values()) + sum(y.values()) - shared)

    want = {(a, b) for a in sets for b in sets if a < b and similarity(sets[a], sets[b]) >= 0.8}
    none = spark.createDataFrame([], "node long, root long")
    found = {(x.a, x.b) for x in graph.other_pairs(near_dups.prefixes(weighted, 0.8), none, 0.8).collect()}
    print(len(want), len(found), len(sets) ** 2 // 2)
    assert want <= found and len(found) - len(want) < len(sets) ** 2 // 20
    members = spark.createDataFrame([(1, 1), (1, 2), (2, 2), (2, 3), (3, 4), (3, 5)], "bucket long, k long")
    assert {x.k for x in graph.mixed_members(members, spark.createDataFrame([(2, 1), (5, 4)], "node long, root long")).collect()} == {2, 3}


def test_edits_side_by_side_are_those_one_by_one():
    r, xs, ys = random.Random(18), [], []
    for _ in range(600):
        x = [r.choice("abcdé日 ") for _ in range(r.choice((0, 1, 30, 63, 64, 65, 128, 129, 200)))]
        y = list(x)
        for _ in range(r.randrange(0, max(1, len(x) // 3) + 1)):
            k = r.randrange(len(y) + 1)
            y[k : k + r.randrange(2)] = [r.choice("abcdé日 ")] * r.randrange(2)
        xs.append("".join(x)), ys.append("".join(y))
    apart = np.array([line_dedup.edit_distance(x, y) for x, y in zip(xs, ys)])
    for most in (apart, apart - 1, apart + 1, np.array([0.2 * max(len(x), len(y)) for x, y in zip(xs, ys)])):
        assert (line_dedup.within_edits(xs, ys, most) == (apart <= most)).all()
    at = np.arange(len(xs))
    want = [a <= 0.2 * max(len(x), len(y)) + 1e-9 for a, x, y in zip(apart, xs, ys)]
    assert line_dedup.alike([*xs, *ys], at, at + len(xs), 0.8).tolist() == want


def test_members_of_a_bucket_in_different_groups_meet_without_a_row_for_each_pair(spark, monkeypatch):
    monkeypatch.setattr(graph, "BLOCK", 8)
    members = spark.range(60).selectExpr("id % 2 as bucket", "id as k", "20L as size", "0L as mark")
    roots = spark.range(0, 60).where("id < 30 or id % 2 = 0").selectExpr("id as node", "id % 2 as root")
    rows = graph.meetings(members, roots, members.selectExpr("k as half", "cast(k as string) as text")).collect()
    met = {(min(x.k, y.k), max(x.k, y.k)) for x in rows for y in rows if x.place == y.place and x.root != y.root and (x.place.x == x.place.y or x.block != y.block)}
    root = {k: k % 2 if k < 30 or k % 2 == 0 else k for k in range(60)}
    assert met == {(a, b) for a in range(60) for b in range(a + 1, 60) if a % 2 == b % 2 and root[a] != root[b]}
    assert len(rows) < len(met)
    assert {r.node: r.root for r in graph.merged(roots, spark.createDataFrame([(1, 31), (31, 33)], "a long, b long")).collect()} == {k: 1 if k in (31, 33) else k % 2 for k in range(60) if k in (31, 33) or k < 30 or k % 2 == 0}
