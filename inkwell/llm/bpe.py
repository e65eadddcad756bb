"""Byte-level BPE through a distinct-word table, and decoding through an id-to-piece table.

1. Documents are gathered into blocks of some MB. A block's texts are split into words (the
   tokenizer's own pre-tokens); the block's list of distinct words goes out in buckets chosen by the
   word alone.
2. All lists of one bucket meet in one task, which encodes each distinct word once and answers each
   block with the ids of its words, in the order they came in.
3. The block itself, made a second time from the same rows so that it is shuffled once only, keeps each
   document as positions in that list. Answers meet it, and the ids are joined back by position.

Nothing larger than a block, or some words of a bucket, is held in memory; texts are never
shuffled, only positions, distinct words and ids, each packed by column. A word that makes up a third
of the corpus is one entry of each block's list.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from inkwell.llm.common import lean, partitions, whole_text

#: Characters of text in a block, and the most buckets that words are dealt into.
BLOCK_CHARS, MAX_BUCKETS = 6 << 20, 4096
#: Words that a bucket's task remembers, some 30 MB; beyond that it starts afresh, which costs time only.
MEMORY_WORDS = 150_000
#: Words that are encoded at a time; the library's results take about a KB each.
WORDS_AT_ONCE = 4096

# Fixed values of byte-level pre-tokenisation: contractions, then letters, numbers, others, white space.
CONTRACTIONS = r"'s|'t|'re|'ve|'m|'ll|'d"
#: Below this code point the character classes are spelled out for a fast pattern; other texts are split by the tokenizer.
PLAIN = 0x250


def plain_pattern() -> re.Pattern:
    """The pre-token pattern for texts of characters below PLAIN."""
    kinds: dict[str, str] = {"L": "", "N": "", "Z": ""}
    for c in map(chr, range(PLAIN)):
        kind = "Z" if c.isspace() and c not in "\x1c\x1d\x1e\x1f" else unicodedata.category(c)[0]
        if kind in kinds:
            kinds[kind] += re.escape(c)
    letters, numbers, spaces = kinds["L"], kinds["N"], kinds["Z"]
    return re.compile(f"{CONTRACTIONS}| ?[{letters}]+| ?[{numbers}]+| ?[^{spaces}{letters}{numbers}]+|[{spaces}]+(?![^{spaces}])|[{spaces}]+")


class Splitter:
    """Splits texts into the tokenizer's words; strings of added tokens are words of their own. The tokenizer may be bare()."""

    def __init__(self, tokenizer_json: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(tokenizer_json)
        self.fast, self.not_plain = plain_pattern().findall, re.compile(f"[^\x00-{chr(PLAIN - 1)}]").search
        added = [x["content"] for x in json.loads(tokenizer_json)["added_tokens"]]
        self.added = re.compile("(" + "|".join(map(re.escape, sorted(added, key=len, reverse=True))) + ")") if added else None

    def words(self, text: str) -> list[str]:
        if self.added is not None and self.added.search(text):
            parts = self.added.split(text)
            return [w for i, part in enumerate(parts) for w in ([part] if i % 2 else self.plain(part))]
        return self.plain(text)

    def plain(self, text: str) -> list[str]:
        if not self.not_plain(text):
            return self.fast(text)
        return [text[a:b] for _, (a, b) in self.tokenizer.pre_tokenizer.pre_tokenize_str(text)]


def bare(spec: dict) -> dict:
    """A tokenizer's file without its vocabulary, which splitting doesn't need: some 40 MB less in each task."""
    return spec | {"model": spec["model"] | {"vocab": {}, "merges": []}}


def encoded(tokenizer, words: list[str]) -> Iterator[bytes]:
    """The ids of each word, some words at a time."""
    for k in range(0, len(words), WORDS_AT_ONCE):
        for e in tokenizer.encode_batch_fast(words[k : k + WORDS_AT_ONCE], add_special_tokens=False):
            yield np.array(e.ids, "<u4").tobytes()


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays of unsigned numbers as one compressed value; a number's bytes go to planes of their own."""
    head = np.array([len(arrays), *(x for a in arrays for x in (a.dtype.itemsize, len(a)))], "<u4")
    planes = (np.ascontiguousarray(a.view("u1").reshape(-1, a.dtype.itemsize).T).tobytes() for a in arrays)
    return zstandard.ZstdCompressor(level=3).compress(head.tobytes() + b"".join(planes))


def unpack(data: bytes) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(data)
    n = int(np.frombuffer(raw, "<u4", 1)[0])
    sizes, at, found = np.frombuffer(raw, "<u4", 2 * n, 4), 4 + 8 * n, []
    for width, length in sizes.reshape(n, 2).tolist():
        planes = np.frombuffer(raw, "u1", width * length, at).reshape(width, length)
        found.append(np.ascontiguousarray(planes.T).view(f"<u{width}").ravel())
        at += width * length
    return found


def pack_words(words: list[str]) -> bytes:
    coded = [w.encode() for w in words]
    return pack(np.fromiter(map(len, coded), "<u4", len(coded)), np.frombuffer(b"".join(coded), "u1"))


def unpack_words(data: bytes) -> list[str]:
    sizes, raw = unpack(data)
    ends, text = np.cumsum(sizes).tolist(), raw.tobytes()
    return [text[a:b].decode() for a, b in zip([0, *ends], ends)]


class Ids(dict):
    """Numbers its keys as they come."""

    def __missing__(self, key: str) -> int:
        self[key] = number = len(self)
        return number


BLOCKS = "block long, bucket int, ids binary, payload binary"


def _blocks(tokenizer_json: str, buckets: int, block_chars: int, lists: bool):
    """Rows of documents to blocks' word lists, a row for each bucket, or else to the blocks: positions in the lists (bucket -1) and what they belong to (ids)."""

    def block(ids: list, lengths: list[int], local: Ids, positions: list[np.ndarray], number: int) -> pa.RecordBatch:
        flat = np.concatenate([np.zeros(0, "<u4"), *positions])
        counts = np.bincount(flat, minlength=len(local)).tolist()
        by_bucket: list[list[tuple[int, str]]] = [[] for _ in range(buckets)]
        for word, i in local.items():
            by_bucket[zlib.crc32(word.encode()) % buckets].append((-counts[i], word))
        for words in by_bucket:
            words.sort()
        if lists:
            own = [(b, pack_words([w for _, w in words])) for b, words in enumerate(by_bucket) if words]
            return pa.RecordBatch.from_arrays([pa.array([number] * len(own), pa.int64()), pa.array([b for b, _ in own], pa.int32()), pa.nulls(len(own), pa.binary()), pa.array([x for _, x in own], pa.binary())], names=["block", "bucket", "ids", "payload"])
        # The k-th most frequent word of bucket b has number k * buckets + b: frequent words have small numbers.
        place = np.zeros(len(local), "<u4")
        for b, words in enumerate(by_bucket):
            place[np.fromiter((local[w] for _, w in words), np.int64, len(words))] = np.arange(len(words)) * buckets + b
        known = np.array([x is not None for x in ids], "u1")
        held = pack(np.array([x or 0 for x in ids], "<i8").view("<u8"), known, np.array(lengths, "<u4"), np.array([len(words) for words in by_bucket], "<u4"))
        return pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([-1], pa.int32()), pa.array([held], pa.binary()), pa.array([pack(place[flat])], pa.binary())], names=["block", "bucket", "ids", "payload"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        splitter = Splitter(tokenizer_json.value)
        base, n, chars = TaskContext.get().partitionId() << 32, 0, 0
        ids, lengths, positions, local = [], [], [], Ids()
        for batch in batches:
            for doc_id, text in zip(batch.column(0), batch.column(1)):
                text = text.as_py()
                words = splitter.words(text)
                ids.append(doc_id.as_py())
                lengths.append(len(words))
                positions.append(np.fromiter(map(local.__getitem__, words), "<u4", len(words)))
                chars += len(text)
                if chars >= block_chars or len(ids) >= 1 << 16:
                    yield block(ids, lengths, local, positions, base + n)
                    n, chars, ids, lengths, positions, local = n + 1, 0, [], [], [], Ids()
        if ids:
            yield block(ids, lengths, local, positions, base + n)

    return run


def _answers(tokenizer_json: str, memory_words: int):
    """Word lists to the ids of their words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core; each thread would hold memory of its own
        from tokenizers import Tokenizer

        tokenizer, known = Tokenizer.from_str(tokenizer_json.value), {}
        for batch in batches:
            for block, bucket, payload in zip(*(batch.column(k).to_pylist() for k in ("block", "bucket", "payload"))):
                words = unpack_words(payload)
                if len(known) > memory_words:
                    known.clear()
                if new := [w for w in words if w not in known]:
                    known.update(zip(new, encoded(tokenizer, new)))
                coded = [known[w] for w in words]
                payload = pack(np.fromiter(map(len, coded), "<u4", len(coded)) // 4, np.frombuffer(b"".join(coded), "<u4"))
                yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([bucket], pa.int32()), pa.array([None], pa.binary()), pa.array([payload], pa.binary())], names=["block", "bucket", "ids", "payload"])

    return run


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The indices of runs, one after another."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - lengths), lengths)


def text_of(ids: bytes, pieces: list[bytes]) -> str:
    return b"".join(map(pieces.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


def _joined(buckets: int, pieces=None):
    """A block's row, then its answers, to (doc_id, n_tokens, ids), with the ids' text if there are pieces."""

    def finish(held: bytes, positions: bytes, answers: list[tuple[int, bytes]]) -> Iterator[pa.RecordBatch]:
        docs, known, words, listed = unpack(held)
        (numbers,) = unpack(positions)
        parts = [(b, *unpack(a)) for b, a in answers]
        if [(b, len(own)) for b, own, _ in parts] != [(b, n) for b, n in enumerate(listed.tolist()) if n]:
            raise RuntimeError("the documents changed while they were encoded; make a table of them first")
        sizes = np.concatenate([np.zeros(0, "<u4"), *(p[1] for p in parts)]).astype(np.int64)
        ids = np.concatenate([np.zeros(0, "<u4"), *(p[2] for p in parts)]).astype("<u4")
        first, seen = np.zeros(buckets, np.int64), 0
        for b, own, _ in parts:
            first[b], seen = seen, seen + len(own)
        places = first[numbers % buckets] + numbers // buckets
        starts, at = np.cumsum(sizes) - sizes, 0
        rows: list[tuple] = []
        for doc_id, there, n in zip(docs.view("<i8").tolist(), known.tolist(), words.tolist()):
            of = places[at : at + n]
            at += n
            own = ids[ragged(starts[of], sizes[of])]
            rows.append((doc_id if there else None, len(own), own.tobytes()))
            if len(rows) == 500:
                yield batch_of(rows)
                rows = []
        if rows:
            yield batch_of(rows)

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        some = list(zip(*rows))
        columns = [pa.array(some[0], pa.int64()), pa.array(some[1], pa.int64()), pa.array(some[2], pa.binary())]
        if pieces is None:
            return pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_tokens", "ids"])
        return pa.RecordBatch.from_arrays([*columns, pa.array([text_of(ids, pieces.value) for ids in some[2]], pa.string())], names=["doc_id", "n_tokens", "ids", "text"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, positions, answers = None, b"", b"", []
        for batch in batches:
            for block, bucket, ids, payload in zip(*(batch.column(k).to_pylist() for k in ("block", "bucket", "ids", "payload"))):
                if block != now:
                    if now is not None:
                        yield from finish(held, positions, answers)
                    now, held, positions, answers = block, ids, payload, []
                else:
                    answers.append((bucket, payload))
        if now is not None:
            yield from finish(held, positions, answers)

    return run


def encode(docs: DataFrame, tokenizer_path: str, decoded: bool = False, block_chars: int = BLOCK_CHARS, memory_words: int = MEMORY_WORDS) -> DataFrame:
    """doc_id, n_tokens and ids (little-endian unsigned 32-bit numbers) of every whole text of docs (doc_id, text).

    docs is read twice, and again in part when an executor is lost: it must give the same rows in the same
    partitions and order each time, as a table's files do (cut() makes such a table); else an error is raised. Null and empty texts have no ids. A null
    doc_id stays null; repeated rows give repeated rows; an empty table gives none; extra columns are left out. The tokenizer must be byte-level BPE
    without normaliser, prefix space or dropout; anything else is refused. With decoded, text is what
    the ids decode to, as decode() would find it, made in the same pass.
    """
    with open(tokenizer_path, encoding="utf-8") as f:
        source = f.read()
    spec = json.loads(source)
    pre = spec["pre_tokenizer"] or {}
    if spec["normalizer"] or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True) or spec["model"].get("dropout"):
        raise ValueError("only byte-level BPE without normaliser, prefix space and dropout can be encoded word by word")
    spec["truncation"] = spec["padding"] = None
    spec["post_processor"] = None
    shared = docs.sparkSession.sparkContext.broadcast(json.dumps(spec))  # a vocabulary file, whatever the input
    splitting = docs.sparkSession.sparkContext.broadcast(json.dumps(bare(spec)))
    n = partitions(docs)
    buckets = min(n, MAX_BUCKETS)
    rows = docs.select("doc_id", whole_text().alias("text"))
    # Word lists go to their bucket's task, which answers them; only then do they meet the blocks' positions.
    answers = rows.mapInArrow(lean(_blocks(splitting, buckets, block_chars, True)), BLOCKS).repartition(n, "bucket").mapInArrow(lean(_answers(shared, memory_words)), BLOCKS)
    together = rows.mapInArrow(lean(_blocks(splitting, buckets, block_chars, False)), BLOCKS).unionByName(answers).repartition(n, "block").sortWithinPartitions("block", "bucket")
    table = docs.sparkSession.sparkContext.broadcast(pieces(spec)) if decoded else None
    return together.mapInArrow(lean(_joined(buckets, table)), "doc_id long, n_tokens long, ids binary" + ", text string" * decoded)


def pieces(spec: dict) -> list[bytes]:
    """The bytes of every id of a byte-level tokenizer's file."""
    # Printable bytes stand for themselves, the others for the characters from 256 on, in order.
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = [b for b in range(256) if b not in printable]
    byte = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}
    vocabulary = spec["model"]["vocab"] | {x["content"]: x["id"] for x in spec["added_tokens"]}
    found = [b""] * (1 + max(vocabulary.values()))
    for piece, i in vocabulary.items():
        found[i] = bytes(map(byte.__getitem__, piece)) if all(c in byte for c in piece) else piece.encode()
    return found


def decode(encoded: DataFrame, tokenizer_path: str) -> DataFrame:
    """encoded (with ids) with the text of its ids; null ids give null, bytes that are no UTF-8 the replacement character."""
    with open(tokenizer_path, encoding="utf-8") as f:
        spec = json.load(f)
    shared = encoded.sparkSession.sparkContext.broadcast(pieces(spec))  # one entry for each id of the vocabulary

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [None if ids is None else text_of(ids, shared.value) for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*batch.schema.names, "text"])

    return encoded.mapInArrow(lean(run, 1000), StructType([*encoded.schema.fields, StructField("text", StringType())]))


def round_trip(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every document."""
    both = encode(docs, tokenizer_path, decoded=True)
    return both.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"))
