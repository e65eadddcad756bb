"""Token by token alignment of two tokenizers over the same bytes.

Texts are cut into chunks at places where both tokenizers always end a token (before a run of white space), so a
chunk's tokens depend on the chunk alone and each distinct chunk is aligned once by a task, as long as it is
remembered. New chunks are aligned together, over one string of bytes:

* a packed bitset for each tokenizer marks where its tokens end; AND of the two yields the shared cuts;
* a cut's rank in each bitset, by popcounts of words and of the word it lies in, is the number of tokens up to it;
* the tokens between two cuts are a group, and every pair across it is a link.

What is known of all documents is how many of them hold a pair of ids linked. Documents are gathered into blocks of
some MB; a block writes its distinct pairs with their documents once, in buckets chosen by the first tokenizer's
id, and what its documents hold as positions in that list. A bucket's task adds up the pairs of all blocks and
finds the greatest count of each id; another answers each block with its pairs' counts, and the block sums them up
by document. A group of very many tokens is never expanded: it is counted by distinct ids. Nothing larger than a
block, or a bucket's distinct pairs, is held in memory, and the pairs of a bucket are bounded by the vocabularies.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkwell.llm.bpe import MAX_BUCKETS, pack, pieces, ragged, unpack
from inkwell.llm.common import cut, lean, partitions, whole_text

#: Characters of text in a block, and in what is aligned at once.
BLOCK_CHARS, STEP_CHARS = 6 << 20, 1 << 20
#: Chunks that a task remembers, some 60 MB, and their characters; beyond that it starts afresh, which costs time only.
MEMORY_CHUNKS, MEMORY_CHARS = 150_000, 4 << 20
#: Bits for an id of the second tokenizer in a pair.
SHIFT = 20
#: Links of a group that are listed one by one.
LISTED = 1 << 12

# White space as both tokenizers' patterns have it, and the pattern that comes before the merges of byte-level BPE.
SPACES = "\t\n\x0b\x0c\r \x85\xa0 " + "".join(map(chr, range(0x2000, 0x200B))) + "    　"
PRE_TOKENS = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


class Pair:
    """Both tokenizers, as far as a task needs them: chunks to ids, and the bytes of every id."""

    def __init__(self, byte_level: str, piece_model: bytes) -> None:
        import sentencepiece
        import tiktoken
        from sentencepiece import sentencepiece_model_pb2

        spec = json.loads(byte_level)
        self.a_bytes = pieces(spec)
        special = {x["id"] for x in spec["added_tokens"]}
        ranks = {self.a_bytes[i]: i for i in spec["model"]["vocab"].values() if i not in special}
        # The same merges as the file's, in the same order, by a faster library; strings of special tokens are plain text.
        self.a = tiktoken.Encoding("a", pat_str=PRE_TOKENS, mergeable_ranks=ranks, special_tokens={})
        model = sentencepiece_model_pb2.ModelProto()
        model.ParseFromString(piece_model)
        model.normalizer_spec.add_dummy_prefix = False  # a chunk has its space
        self.b = sentencepiece.SentencePieceProcessor(model_proto=model.SerializeToString())
        self.b_bytes = [bytes([int(p.piece[3:5], 16)]) if p.type == p.BYTE else p.piece.replace("▁", " ").encode() for p in model.pieces]
        self.a_sizes, self.b_sizes = (np.array([len(x) for x in of], np.int64) for of in (self.a_bytes, self.b_bytes))
        # White space that some piece has behind another character isn't a place to cut.
        plain = [p.piece.replace("▁", " ") for p in model.pieces]
        glued = {y for piece in plain for x, y in zip(piece, piece[1:]) if y in SPACES and x not in SPACES}
        space, glue = re.escape(SPACES), re.escape("".join(sorted(glued)))
        more = f"(?:[{glue}][{space}]*[^{space}]*)*" if glued else ""
        self.chunks = re.compile(f"[{space}]*[^{space}]+{more}|[{space}]+").findall
        # A token's id with what follows it: more of its side, the other side, the next group.
        self.words = [f"{i}{s}" for of, marks in ((self.a_bytes, ",|"), (self.b_bytes, ",;")) for s in marks for i in range(len(of))]

    def tokens(self, chunks: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        return [self.a.encode_ordinary(c) for c in chunks], self.b.encode(chunks, num_threads=1)


def check(spec: dict, model) -> None:
    """Raise ValueError unless the tokenizers are of the kinds that can be aligned chunk by chunk."""
    pre, added = spec["pre_tokenizer"] or {}, {x["id"] for x in spec["added_tokens"]}
    if spec["normalizer"] or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True) or spec["model"].get("dropout") or spec["model"].get("ignore_merges"):
        raise ValueError("the first tokenizer must be byte-level BPE without normaliser, prefix space and dropout")
    ids = spec["model"]["vocab"]
    merged = [ids["".join(m.split(" ") if isinstance(m, str) else m)] for m in spec["model"]["merges"]]
    if merged != sorted(merged) or len(merged) + 256 != len(set(ids.values()) - added):
        raise ValueError("the first tokenizer's ids must follow its merges")
    n = model.normalizer_spec
    if n.name != "identity" or n.precompiled_charsmap or n.remove_extra_whitespaces or not n.add_dummy_prefix or not model.trainer_spec.byte_fallback:
        raise ValueError("the second tokenizer must add a space, change nothing else and fall back to bytes")
    if any("▁" in p.piece.lstrip("▁") for p in model.pieces):
        raise ValueError("the second tokenizer has pieces of several words")


def bitset(ends: np.ndarray, size: int) -> np.ndarray:
    """64-bit words whose bit i is set if a token ends after byte i."""
    marks = np.zeros(-(-size // 64) * 64, np.uint8)
    marks[ends - 1] = 1
    return np.packbits(marks, bitorder="little").view("<u8")


def ranks(words: np.ndarray, at: np.ndarray) -> np.ndarray:
    """How many bits are set up to and with those at some places."""
    before = np.cumsum(np.bitwise_count(words), dtype=np.int64)
    word = at >> 6
    below = words[word] & (np.uint64(0xFFFFFFFFFFFFFFFF) >> (63 - (at & 63)).astype(np.uint64))
    return np.where(word > 0, before[word - 1], 0) + np.bitwise_count(below)


def cut_groups(a_ends: np.ndarray, b_ends: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Shared cuts (ends of groups in bytes), and the tokens of both sides in each group, from the ends of tokens over size bytes."""
    a, b = bitset(a_ends, size), bitset(b_ends, size)
    cuts = np.flatnonzero(np.unpackbits((a & b).view(np.uint8), bitorder="little"))
    return cuts + 1, np.diff(ranks(a, cuts), prepend=0), np.diff(ranks(b, cuts), prepend=0)


class Grown:
    """An array that grows at its end."""

    def __init__(self, kind) -> None:
        self.data, self.n = np.zeros(1 << 16, kind), 0

    def add(self, values: np.ndarray) -> None:
        n = self.n + len(values)
        if n > len(self.data):
            self.data = np.concatenate([self.data[: self.n], np.zeros(max(n, self.n), self.data.dtype)])
        self.data[self.n : n] = values
        self.n = n


class Chunks(dict):
    """Chunks by number, with what is known of them: tokens, groups and links of each (counts), written groups, and pairs with how often."""

    def __init__(self, both: Pair) -> None:
        super().__init__()
        self.both = both
        self.counts, self.pair_ends = [Grown(np.int64) for _ in range(5)], Grown(np.int64)  # n_a, n_b, n_groups, n_links, valid
        self.pairs, self.times, self.texts = Grown(np.int64), Grown(np.int64), []
        self.chars = 0

    def __missing__(self, chunk: str) -> int:
        self[chunk] = number = len(self)
        self.new.append(chunk)
        self.chars += len(chunk)
        return number

    def numbers(self, chunks: list[str]) -> list[int]:
        self.new: list[str] = []
        found = list(map(self.__getitem__, chunks))
        if self.new:
            self.align(self.new)
        return found

    def align(self, new: list[str]) -> None:
        both = self.both
        a_lists, b_lists = both.tokens(new)
        n_a, n_b = (np.fromiter(map(len, x), np.int64, len(x)) for x in (a_lists, b_lists))
        a, b = (np.fromiter((i for ids in x for i in ids), np.int64, int(n.sum())) for x, n in ((a_lists, n_a), (b_lists, n_b)))
        raw = [c.encode() for c in new]
        # A chunk whose tokens aren't its bytes is aligned as one token of each side, and its text counts for nothing.
        a_at, b_at = np.cumsum(n_a) - n_a, np.cumsum(n_b) - n_b
        valid = np.array([b"".join(map(both.a_bytes.__getitem__, x)) == r == b"".join(map(both.b_bytes.__getitem__, y)) for r, x, y in zip(raw, a_lists, b_lists)], bool)
        if not valid.all():
            n_a, n_b = np.where(valid, n_a, 1), np.where(valid, n_b, 1)
            a, b = a[ragged(a_at, n_a)], b[ragged(b_at, n_b)]
        sizes = np.fromiter(map(len, raw), np.int64, len(raw))
        ends = np.cumsum(sizes)
        a_sizes, b_sizes = both.a_sizes[a], both.b_sizes[b]
        if not valid.all():
            for of, n in ((a_sizes, n_a), (b_sizes, n_b)):
                of[(np.cumsum(n) - 1)[~valid]] = sizes[~valid]
        cuts, g_a, g_b = cut_groups(np.cumsum(a_sizes), np.cumsum(b_sizes), int(ends[-1]))
        of_chunk = np.searchsorted(ends, cuts)  # a chunk's end is a cut
        n_groups = np.bincount(of_chunk, minlength=len(new))
        n_links = np.add.reduceat(g_a * g_b, np.cumsum(n_groups) - n_groups)
        for grown, values in zip(self.counts, (n_a, n_b, n_groups, n_links, valid)):
            grown.add(values)
        self._write(a, b, g_a, g_b, n_groups)
        owner, pair, times = self._pairs(a, b, g_a, g_b, of_chunk)
        self.pair_ends.add(self.pairs.n + np.cumsum(np.bincount(owner, minlength=len(new))))
        self.pairs.add(pair)
        self.times.add(times)

    def _write(self, a: np.ndarray, b: np.ndarray, g_a: np.ndarray, g_b: np.ndarray, n_groups: np.ndarray) -> None:
        a_ends, b_ends = np.cumsum(g_a), np.cumsum(g_b)
        a_place = np.arange(len(a)) + np.repeat(b_ends - g_b, g_a)
        b_place = np.arange(len(b)) + np.repeat(a_ends, g_b)
        a_last, b_last = np.zeros(len(a), bool), np.zeros(len(b), bool)
        a_last[a_ends - 1] = b_last[b_ends - 1] = True
        n_a, n_b = len(self.both.a_bytes), len(self.both.b_bytes)
        codes = np.zeros(len(a) + len(b), np.int64)
        codes[a_place] = a + n_a * a_last
        codes[b_place] = 2 * n_a + b + n_b * b_last
        words = list(map(self.both.words.__getitem__, codes.tolist()))
        ends = (a_ends + b_ends)[np.cumsum(n_groups) - 1].tolist()
        self.texts += ["".join(words[x:y])[:-1] for x, y in zip([0, *ends], ends)]

    def _pairs(self, a: np.ndarray, b: np.ndarray, g_a: np.ndarray, g_b: np.ndarray, of_chunk: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(chunk, pair, how often) of all links, by chunk."""
        a_at, b_at, links = np.cumsum(g_a) - g_a, np.cumsum(g_b) - g_b, g_a * g_b
        few = np.flatnonzero(links <= LISTED)
        n = links[few]
        k = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        width = np.repeat(g_b[few], n)
        own = [(np.repeat(of_chunk[few], n), (a[np.repeat(a_at[few], n) + k // width] << SHIFT) | b[np.repeat(b_at[few], n) + k % width], np.ones(len(k), np.int64))]
        for g in np.flatnonzero(links > LISTED).tolist():
            x, x_times = np.unique(a[a_at[g] : a_at[g] + g_a[g]], return_counts=True)
            y, y_times = np.unique(b[b_at[g] : b_at[g] + g_b[g]], return_counts=True)
            own.append((np.full(len(x) * len(y), of_chunk[g]), ((x << SHIFT)[:, None] | y).ravel(), np.outer(x_times, y_times).ravel()))
        owner, pair, times = (np.concatenate(c) for c in zip(*own))
        return summed(owner, pair, times)


def summed(owner: np.ndarray, pair: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (owner, pair) in order, with the sum of their times."""
    if not len(owner):
        return owner, pair, times
    order = np.lexsort((pair, owner))
    owner, pair, times = owner[order], pair[order], times[order]
    first = np.flatnonzero(np.append(True, (owner[1:] != owner[:-1]) | (pair[1:] != pair[:-1])))
    return owner[first], pair[first], np.add.reduceat(times, first)


def sums(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The sum of each run of so many values."""
    ends = np.cumsum(sizes, dtype=np.int64)
    total = np.append(0, np.cumsum(values, dtype=np.int64))
    return total[ends] - total[ends - sizes]


BLOCKS = "block long, bucket int, docs binary, payload binary"
COUNTS = ("n_a", "n_b", "n_groups", "n_links")


def _batch(rows: list[tuple[int, int, bytes | None, bytes]]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * 4
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.binary(), pa.binary()))], names=["block", "bucket", "docs", "payload"])


def _aligned(byte_level, piece_model, buckets: int, block_chars: int, memory_chunks: int):
    """Rows (doc_id, text) to blocks: a row of distinct pairs for each bucket, and one, of bucket -1, of documents."""
    import hashlib

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = Pair(byte_level.value, piece_model.value)
        chunks = Chunks(both)
        number, held, chars = TaskContext.get().partitionId() << 32, Held(), 0

        def step(ids: list, texts: list[str]) -> None:
            nonlocal chunks
            lists = [both.chunks(f" {t}") if t else [] for t in texts]
            sizes = np.fromiter(map(len, lists), np.int64, len(lists))
            flat = np.array(chunks.numbers([c for own in lists for c in own]), np.int64)
            doc = np.repeat(np.arange(len(ids)), sizes)
            got = [sums(grown.data[flat], sizes) for grown in chunks.counts]
            good = (got[4] == sizes) & (sizes > 0)
            ends = np.cumsum(sizes).tolist()
            written = list(map(chunks.texts.__getitem__, flat.tolist()))
            shas = [hashlib.sha256(";".join(written[x:y]).encode()).digest() if ok else b"" for x, y, ok in zip([0, *ends], ends, good.tolist())]
            # Chunks that a document repeats are looked up once.
            flat, doc = flat[good[doc]], doc[good[doc]]
            doc, flat, again = summed(doc, flat, np.ones(len(flat), np.int64))
            pair_ends = chunks.pair_ends.data[: chunks.pair_ends.n]
            first = np.where(flat > 0, pair_ends[flat - 1], 0)
            n = pair_ends[flat] - first
            at = ragged(first, n)
            held.add(ids, [np.where(good, c, 0) for c in got[:4]], shas, *summed(np.repeat(doc, n), chunks.pairs.data[at], chunks.times.data[at] * np.repeat(again, n)))
            if len(chunks) > memory_chunks or chunks.chars > MEMORY_CHARS:
                chunks = Chunks(both)

        for batch in batches:
            ids, texts, size = [], [], 0
            for doc_id, text in zip(batch.column(0), batch.column(1)):
                ids.append(doc_id.as_py())
                texts.append(text.as_py())
                size += len(texts[-1])
                if size >= STEP_CHARS:
                    step(ids, texts)
                    chars, ids, texts, size = chars + size, [], [], 0
                if chars >= block_chars or held.rows() >= 1 << 16:
                    yield _batch(held.block(number, buckets))
                    number, held, chars = number + 1, Held(), 0
            if ids:
                step(ids, texts)
                chars += size
        if held.rows():
            yield _batch(held.block(number, buckets))

    return run


class Held:
    """A block's documents as they come."""

    def __init__(self) -> None:
        self.ids, self.shas, self.counts, self.parts = [], [], [], []

    def rows(self) -> int:
        return len(self.ids)

    def add(self, ids: list, counts: list[np.ndarray], shas: list[bytes], doc: np.ndarray, pair: np.ndarray, times: np.ndarray) -> None:
        self.parts.append((doc + len(self.ids), pair, times))
        self.ids += ids
        self.shas += shas
        self.counts.append(counts)

    def block(self, number: int, buckets: int) -> list[tuple[int, int, bytes | None, bytes]]:
        doc, pair, times = (np.concatenate(c) for c in zip(*self.parts))
        distinct, place, documents = np.unique(pair, return_inverse=True, return_counts=True)
        # A pair's place is its number in the order of buckets, then pairs; buckets go by the first tokenizer's id.
        bucket = bucket_of(distinct, buckets)
        order = np.argsort(bucket, kind="stable")
        moved = np.empty(len(order), np.int64)
        moved[order] = np.arange(len(order))
        sizes = np.bincount(bucket, minlength=buckets)
        ends = np.cumsum(sizes)
        rows = [(number, b, None, pack(distinct[own].astype("<u8"), documents[own].astype("<u4"))) for b in np.flatnonzero(sizes).tolist() if len(own := order[ends[b] - sizes[b] : ends[b]])]
        known = np.array([i is not None for i in self.ids], "u1")
        docs = pack(
            np.array([i or 0 for i in self.ids], "<i8").view("<u8"), known, *(np.concatenate(c).astype("<u8") for c in zip(*self.counts)), np.array([len(s) for s in self.shas], "u1"), np.frombuffer(b"".join(self.shas), "u1"),
            np.bincount(doc, minlength=len(self.ids)).astype("<u4"), sizes.astype("<u4"),
        )
        return [*rows, (number, -1, docs, pack(moved[place].astype("<u4"), times.astype("<u8" if len(times) and times.max() >= 1 << 32 else "<u4")))]


def bucket_of(pair: np.ndarray, buckets: int) -> np.ndarray:
    """Buckets of pairs: all pairs of a first id are in one; neighbouring ids aren't."""
    return (((pair >> SHIFT) * 2654435761 & 0xFFFFFFFF) >> 7) % buckets


def _totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lists of distinct pairs, by bucket, to one row a bucket: pairs, documents that hold them, whether none of the id's pairs has more."""

    def finish(bucket: int, parts: list) -> pa.RecordBatch:
        pair, n = merged(parts)
        head = np.flatnonzero(np.append(True, np.diff(pair >> SHIFT) != 0))
        most = np.repeat(np.maximum.reduceat(n, head), np.diff(np.append(head, len(pair))))
        return _batch([(-1, bucket, None, pack(pair.astype("<u8"), n.astype("<u8"), (n == most).astype("u1")))])

    now, parts, waiting = None, [], 0
    for batch in batches:
        for bucket, payload in zip(batch.column("bucket").to_pylist(), batch.column("payload").to_pylist()):
            if bucket != now:
                if parts:
                    yield finish(now, parts)
                now, parts, waiting = bucket, [], 0
            pair, n = unpack(payload)
            parts.append((pair.astype(np.int64), n.astype(np.int64)))
            waiting += len(pair)
            if waiting > max(1 << 20, len(parts[0][0])):
                parts, waiting = [merged(parts)], 0
    if parts:
        yield finish(now, parts)


def merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    pair, n = (np.concatenate(c) for c in zip(*parts))
    _, pair, n = summed(np.zeros(len(pair), np.int8), pair, n)
    return pair, n


def _answers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A bucket's totals, then its blocks' lists, to the counts of each list's pairs."""
    now = pairs = counts = best = None
    for batch in batches:
        rows = []
        for block, bucket, payload in zip(*(batch.column(k).to_pylist() for k in ("block", "bucket", "payload"))):
            if block == -1:
                now, (pairs, counts, best) = bucket, unpack(payload)
                continue
            if bucket != now:
                raise RuntimeError(f"the pairs of bucket {bucket} have no totals")
            at = np.searchsorted(pairs, unpack(payload)[0])
            rows.append((block, bucket, None, pack(counts[at], best[at])))
        yield _batch(rows)


RESULT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, sha binary"


def _results(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A block's documents, then its answers, to RESULT."""

    def finish(docs: bytes, payload: bytes, answers: list[tuple[int, bytes]]) -> pa.RecordBatch:
        ids, known, *counts, sha_sizes, shas, sizes, listed = unpack(docs)
        place, times = unpack(payload)
        parts = [(b, *unpack(x)) for b, x in answers]
        if [(b, len(n)) for b, n, _ in parts] != [(b, n) for b, n in enumerate(listed.tolist()) if n]:
            raise RuntimeError("answers of a block are missing")
        count = np.concatenate([np.zeros(0, np.int64), *(n.astype(np.int64) for _, n, _ in parts)])
        best = np.concatenate([np.zeros(0, np.int64), *(x.astype(np.int64) for _, _, x in parts)])
        times = times.astype(np.int64)
        n_best, count_sum = (sums(of[place] * times, sizes) for of in (best, count))
        ends, raw = np.cumsum(sha_sizes, dtype=np.int64).tolist(), shas.tobytes()
        columns = [pa.array(ids.view("<i8"), pa.int64(), mask=known == 0), *(pa.array(c.astype(np.int64)) for c in (*counts, n_best, count_sum)), pa.array([raw[x:y] for x, y in zip([0, *ends], ends)], pa.binary())]
        return pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in RESULT.split(", ")])

    now, docs, payload, answers = None, b"", b"", []
    for batch in batches:
        for block, bucket, own, data in zip(*(batch.column(k).to_pylist() for k in ("block", "bucket", "docs", "payload"))):
            if block != now:
                if now is not None:
                    yield finish(docs, payload, answers)
                if bucket != -1:
                    raise RuntimeError(f"block {block} has answers and no documents")
                now, docs, payload, answers = block, own, data, []
            else:
                answers.append((bucket, data))
    if now is not None:
        yield finish(docs, payload, answers)


def align(docs: DataFrame, byte_level_path: str, piece_path: str, block_chars: int = BLOCK_CHARS, memory_chunks: int = MEMORY_CHUNKS) -> DataFrame:
    """Counts of tokens, groups and links of every whole text of docs (doc_id, text), and the SHA-256 of its groups (RESULT).

    n_best counts a document's links whose pair no other pair of the same first id exceeds in documents; count_sum adds
    up the documents of its links' pairs. Texts that are null or empty, or that the second tokenizer can't give back
    (those with U+2581), have no tokens: zeros and an empty digest. A null doc_id stays null; repeated rows are documents
    of their own; an empty table gives none; further columns are left out.
    """
    from sentencepiece import sentencepiece_model_pb2

    with open(byte_level_path, encoding="utf-8") as f, open(piece_path, "rb") as g:
        byte_level, piece_model = f.read(), g.read()
    model = sentencepiece_model_pb2.ModelProto()
    model.ParseFromString(piece_model)
    check(json.loads(byte_level), model)
    context, n = docs.sparkSession.sparkContext, partitions(docs)
    shared = context.broadcast(byte_level), context.broadcast(piece_model)  # vocabulary files, whatever the input
    buckets = min(n, MAX_BUCKETS)
    rows = docs.select("doc_id", whole_text().alias("text"))
    table = cut(rows.mapInArrow(lean(_aligned(*shared, buckets, block_chars, memory_chunks)), BLOCKS), "aligned-blocks")
    lists = table.where("bucket >= 0").select("block", "bucket", F.lit(None).cast("binary").alias("docs"), "payload")
    totals = cut(lists.repartition(n, "bucket").sortWithinPartitions("bucket").mapInArrow(lean(_totals), BLOCKS), "pair-totals")
    answers = totals.unionByName(lists).repartition(n, "bucket").sortWithinPartitions("bucket", "block").mapInArrow(lean(_answers), BLOCKS)
    together = table.where("bucket = -1").unionByName(answers).repartition(n, "block").sortWithinPartitions("block", "bucket")
    return together.mapInArrow(lean(_results), RESULT)


def digest(aligned: DataFrame) -> DataFrame:
    """The counts, with groups_sha256 as lowercase hex."""
    return aligned.select("doc_id", *COUNTS, "n_best", "count_sum", F.lower(F.hex("sha")).alias("groups_sha256"))
