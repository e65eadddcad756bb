"""Operators 11 to 13 against brute force, and on nulls, empty and long values, ties, repeats, empty tables and extra columns."""

import datetime
import hashlib
import random
import zlib
from collections import Counter, defaultdict
from decimal import ROUND_FLOOR, Decimal

import pytest
from pyspark.sql import functions as F

from inkwell.llm import alignment, chat, ranking
from inkwell.llm.common import cut

# ---- 11 ----------------------------------------------------------------------------------------

LINES = "sale_id long, line_no int, item_id long, vendor_id long, quantity int, amount double, discount double, flag string, shipped_at timestamp_ntz, place string, cell string"


def lines_of(seed, n):
    r = random.Random(seed)
    some = lambda x, share=0.1: None if r.random() < share else x
    rows = []
    for _ in range(n):
        day = datetime.datetime(2024, r.randrange(1, 4), r.randrange(1, 28))
        rows.append((some(r.randrange(40)), some(r.randrange(3)), some(r.randrange(12)), some(7 if r.random() < 0.5 else r.randrange(4)), some(r.randrange(35)), some(r.randrange(300) / 100), some(r.randrange(3) / 100, 0.05), "f", some(day), "x", None))
    return rows + rows[: n // 10]


def ranked_slowly(rows, most):
    groups = defaultdict(list)
    floor = lambda x: None if x is None else int(Decimal(x).to_integral_value(ROUND_FLOOR))
    for sale, line, item, vendor, quantity, amount, discount, _, day, *_ in rows:
        key = (vendor, -1 if item is None else item % 10, -1 if day is None else 100 * day.year + day.month)
        if sale is not None and zlib.crc32(str(sale).encode()) % 5 == 0:
            key = (-1, -1, -1)
        percent = None if discount is None else floor(100 * discount + 0.5)
        pair = (quantity is not None, -(quantity // 10) if quantity is not None else 0, percent is not None, percent or 0)
        own = (sale, line, quantity, None if amount is None else floor(100 * amount + 0.5))
        groups[key].append((pair, tuple((x is None, x or 0) for x in own), own, percent))
    found = []
    for key, members in groups.items():
        members.sort(key=lambda m: m[:2])
        sizes = Counter(m[0] for m in members)
        for pos, (pair, _, (sale, line, quantity, cents), percent) in enumerate(members, 1):
            place = 1 + sum(n for p, n in sizes.items() if p < pair)
            if most is None or place <= most:
                found.append((*key, pos, place, sale, line, quantity, percent, cents, sizes[pair]))
    return sorted(found, key=repr)


@pytest.mark.parametrize("settings", [{}, {"heavy_rows": 30, "bucket_rows": 20, "ranges": 7}, {"heavy_rows": 0, "ranges": 5}])
@pytest.mark.parametrize("most", [3, None])
def test_ranks_match_brute_force(spark, settings, most):
    rows = lines_of(4, 900)
    lines = cut(spark.createDataFrame(rows, LINES).repartition(3), "lines")
    found = ranking.rank_lines(lines, most, **settings).collect()
    assert sorted(map(tuple, found), key=repr) == ranked_slowly(rows, most)


def test_equal_rows_and_empty_tables_are_ranked(spark):
    lines = spark.createDataFrame([(1, 1, 1, 7, 5, 1.0, 0.0, "f", None, "x", None)] * 400, LINES)
    for settings in ({}, {"heavy_rows": 10, "ranges": 6}):
        found = ranking.rank_lines(cut(lines, "lines"), **settings).collect()
        assert sorted(r.pos for r in found) == list(range(1, 401)) and {(r.place, r.tied, r.month) for r in found} == {(1, 400, -1)}
        assert ranking.rank_lines(lines.where("false"), **settings).collect() == []
    with pytest.raises(ValueError):
        ranking.rank_ties(lines, ["vendor_id"], [ranking.Key("place")], [])


# ---- 12 ----------------------------------------------------------------------------------------


def folded_slowly(log):
    """Messages of each conversation, event by event."""
    done = defaultdict(dict)
    for conv, seq, part, kind, message, role, text in sorted(log, key=lambda e: (e[1], e[2])):
        own = done[conv]
        if kind == "message":
            own[message] = [(seq, part), role, text or "", True]
        elif message in own:
            if kind == "delta":
                own[message][2] += text or ""
            else:
                own[message][2] = (text or "") if kind == "edit" else ""
                for m, state in own.items():
                    if m != message and own[message][0] < state[0]:
                        state[3] = False
    return {c: [(role, text) for _, role, text, left in sorted(own.values()) if left] for c, own in done.items()}


LOG = "conv_id long, seq long, part int, kind string, message long, role string, text string, opened string"
CONVERSATIONS = "conv_id long, turn long, role string, text string, at string, parts string"


def test_logs_fold_as_event_by_event(spark):
    r, log = random.Random(5), []
    for conv in range(40):
        messages = 0
        for seq in range(r.randrange(1, 40)):
            kind = r.choice(["message", "delta", "delta", "delta", "edit", "regenerate"]) if messages else "message"
            messages += kind == "message"
            log.append((conv, seq, 0, kind, messages if kind == "message" else r.randrange(1, messages + 1), r.choice(["user", "assistant"]), r.choice(["a", "<|end|>\n", "</s>", "[\\INST]", " b ", None, "é😀"]), "x"))
    r.shuffle(log)
    want = folded_slowly([e[:7] for e in log])
    rendered = chat.format_log(spark.createDataFrame(log, LOG))
    turns = rendered.select("conv_id", "n_turns", chat.read_back(chat.formatted(F.col("parts"))).alias("turns"), "parts").collect()
    assert {x.conv_id: [tuple(t) for t in x.turns] for x in turns} == {c: m for c, m in want.items() if m}
    for x in turns:
        assert x.n_turns == len(x.turns) and [p.loss for p in x.parts][1::3] == [t.role == "assistant" for t in x.turns]
        assert not any("</s>" in p.text or "[INST]" in p.text for p in x.parts)


def test_escaping_is_reversible(spark):
    r = random.Random(6)
    atoms = ["<", "[", "\\", "|", "/", "s>", "INST]", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|turn|>", "<|end|>\n", "x", "\n", "$1", "é"]
    texts = ["".join(r.choice(atoms) for _ in range(r.randrange(12))) for _ in range(3000)]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", chat.escape(F.col("t")).alias("e")).select("t", "e", chat.unescape(F.col("e")).alias("u")).collect()
    assert all(x.t == x.u for x in rows)
    assert not any(c + rest in x.e for x in rows for c in "<[" for rest in chat.CONTROL if c + rest in ("<|", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>"))
    assert all(x.e == x.t for x in rows if not any(rest in x.t for rest in chat.CONTROL))


def test_digests_of_odd_conversations(spark):
    rows = [(1, 1, "assistant", "b", "", ""), (1, 0, "user", None, "", ""), (2, None, None, "x\n\ny\n", "", ""), (None, 5, "assistant", "z" * 70000, "", ""), (None, 5, "assistant", "z" * 70000, "", ""), (3, 0, "assistant", "<|say|>a<|end|>\n", "", "")]
    docs = spark.createDataFrame(rows, CONVERSATIONS)
    found = {r.conv_id: r for r in chat.format_conversations(chat.with_probe(spark, docs)).collect()}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    probe = "</s>[INST] ok [/INST]"
    want = {1: ("user\n\nassistant\nb\n", "b", 2), 2: ("\nx\n\ny\n\n", "", 1), None: (f"assistant\n{'z' * 70000}\n" * 2, "z" * 140000, 2), 3: ("assistant\n<|say|>a<|end|>\n\n", "<|say|>a<|end|>\n", 1), -7: (f"user\n{probe}\nassistant\n{probe}\n", probe, 2)}
    assert {c: (r.turns_sha256, r.loss_chars, r.loss_sha256, r.n_turns) for c, r in found.items()} == {c: (sha(t), len(loss), sha(loss), n) for c, (t, loss, n) in want.items()}
    assert chat.format_conversations(docs.where("false")).collect() == [] and chat.format_log(spark.createDataFrame([], LOG)).collect() == []


# ---- 13 ----------------------------------------------------------------------------------------


def paths():
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def aligned_slowly(texts):
    import sentencepiece
    from tokenizers import Tokenizer

    first, second = Tokenizer.from_file(paths()[0]), sentencepiece.SentencePieceProcessor(model_file=paths()[1])
    first.encode_special_tokens = True
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in printable)}
    a_bytes = lambda i: bytes(byte[c] for c in first.id_to_token(i))
    b_bytes = lambda i: bytes([int(second.id_to_piece(i)[3:5], 16)]) if second.is_byte(i) else second.id_to_piece(i).replace("▁", " ").encode()
    heads, links = [], []
    for text in texts:
        a, b = (first.encode(f" {text}", add_special_tokens=False).ids, second.encode(text)) if text else ([], [])
        groups = []
        if text and b"".join(map(a_bytes, a)) == b"".join(map(b_bytes, b)) == f" {text}".encode():
            ends = [[sum(len(of(i)) for i in ids[: k + 1]) for k in range(len(ids))] for of, ids in ((a_bytes, a), (b_bytes, b))]
            low = 0
            for c in sorted(set(ends[0]) & set(ends[1])):
                groups.append(tuple([i for i, e in zip(ids, at) if low < e <= c] for ids, at in zip((a, b), ends)))
                low = c
        else:
            a = b = []
        written = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        links.append(Counter((x, y) for g in groups for x in g[0] for y in g[1]))
        heads.append((len(a), len(b), len(groups), hashlib.sha256(written.encode()).hexdigest() if groups else ""))
    count, most = Counter(p for own in links for p in own), Counter()
    for (x, _), n in count.items():
        most[x] = max(most[x], n)
    return [(*h[:3], own.total(), sum(m for p, m in own.items() if count[p] == most[p[0]]), sum(m * count[p] for p, m in own.items()), h[3]) for h, own in zip(heads, links)]


def odd_texts():
    r = random.Random(1)
    atoms = ["a", "b", "é", "ß", "中", "́", "😀", "ا", "1", "٣", ".", "!", "'", "s", "ll", " ", "  ", "\n", "\t", " ", "　", "\r", "_", "th", "ing", "<|endoftext|>", "\x00", "\x1c", "\x85", "​", "<0x0A>", "'ve", ";\r", "() \r\n", "</s>", "the ", "!\x1c", " \xa0 ", "\n \n"]
    return [None, "", " ", "a▁b", "x" * 900, "日" * 300, " " * 200, "the the", "the the"] + ["".join(r.choice(atoms) for _ in range(r.randrange(40))) for _ in range(400)]


@pytest.mark.parametrize("settings", [{}, {"block_chars": 500, "memory_chunks": 20}])
def test_alignment_matches_brute_force(spark, settings):
    texts = odd_texts()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumns({"bucket": F.lit("x"), "Block": F.lit(None).cast("string")})
    found = {r.doc_id: tuple(r)[1:] for r in alignment.digest(alignment.align(cut(docs, "docs"), *paths(), **settings)).collect()}
    assert [found[k] for k in range(len(texts))] == aligned_slowly(texts)


def test_a_long_group_is_counted_without_being_listed(spark, monkeypatch):
    texts = ["".join(random.Random(2).choice("abcdef0123") for _ in range(600)), "aaa bbb"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = [tuple(r) for r in alignment.digest(alignment.align(docs, *paths())).orderBy("doc_id").collect()]
    both = alignment.Pair(*(open(p, "rb").read() for p in paths()))
    listed = alignment.Chunks(both)
    listed.numbers([f" {t}" for t in texts])
    monkeypatch.setattr(alignment, "LISTED", 0)
    counted = alignment.Chunks(both)
    counted.numbers([f" {t}" for t in texts])
    for name in ("pairs", "times", "pair_ends"):
        x, y = getattr(listed, name), getattr(counted, name)
        assert x.data[: x.n].tolist() == y.data[: y.n].tolist()
    assert [w[1:] for w in want] == aligned_slowly(texts)


def test_bit_ranks():
    import numpy as np

    r = np.random.default_rng(3)
    for size in (1, 63, 64, 65, 1000):
        a, b = (np.unique(np.append(r.integers(1, size + 1, size), size)) for _ in "ab")
        cuts, n_a, n_b = alignment.cut_groups(a, b, size)
        want = sorted(set(a.tolist()) & set(b.tolist()))
        assert cuts.tolist() == want and n_a.sum() == len(a) and n_b.sum() == len(b)
        assert np.cumsum(n_a).tolist() == [int((a <= c).sum()) for c in want]


def test_null_ids_empty_tables_and_other_tokenizers(spark):
    import json

    from sentencepiece import sentencepiece_model_pb2

    docs = spark.createDataFrame([(None, "some text"), (1, None), (1, "some text")], "doc_id long, text string")
    assert Counter(r.doc_id for r in alignment.align(docs, *paths()).collect()) == {None: 1, 1: 2}
    assert alignment.align(docs.where("false"), *paths()).collect() == []
    model = sentencepiece_model_pb2.ModelProto()
    model.ParseFromString(open(paths()[1], "rb").read())
    spec = json.load(open(paths()[0]))
    alignment.check(spec, model)
    with pytest.raises(ValueError):
        alignment.check(spec | {"normalizer": {"type": "NFC"}}, model)
    model.normalizer_spec.remove_extra_whitespaces = True
    with pytest.raises(ValueError):
        alignment.check(spec, model)
