"""Candidate pairs by sorted sketches, and connected components of an edge table; nothing is collected."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkwell.llm.bpe import unpack
from inkwell.llm.common import cut, discard, lean, partitions

#: Low bits of a key that order its bucket: two more samples of the sketch, TAIL / 2 bits each.
TAIL = 16
#: Members of a bucket that come next in its order, with which one is paired.
LAGS = 4


def bucket_keys(samples: np.ndarray, rows: int) -> np.ndarray:
    """A row of signed 64-bit keys for each row of samples: a bucket for every run of so many samples, and the two samples after it.

    samples: (n, tables * rows) unsigned 64-bit numbers, those of equal elements equal.
    """
    n, size = samples.shape
    parts = samples.reshape(n, size // rows, rows)
    mixed = np.broadcast_to(np.arange(1, size // rows + 1, dtype=np.uint64), parts.shape[:2])
    for k in range(rows):
        mixed = (mixed ^ parts[:, :, k]) * np.uint64(0x9E3779B97F4A7C15)
        mixed = mixed ^ mixed >> np.uint64(29)
    low = (samples * np.uint64(0xC2B2AE3D27D4EB4F) >> np.uint64(64 - TAIL // 2)).reshape(parts.shape)
    after = np.roll(low, -1, axis=1)
    tail = after[:, :, 0] << np.uint64(TAIL // 2) | after[:, :, 1 % rows]
    return (mixed >> np.uint64(TAIL) << np.uint64(TAIL) | tail).view(np.int64)


def _columns(keys: pa.Array) -> list[np.ndarray]:
    parts = keys.flatten() if pa.types.is_struct(keys.type) else [keys]
    return [np.asarray(p) for p in parts]


def once(parts: list[np.ndarray]) -> np.ndarray:
    """Where rows of some columns differ from the row before."""
    return np.flatnonzero(np.concatenate([np.ones(min(1, len(parts[0])), bool), np.logical_or.reduce([p[1:] != p[:-1] for p in parts])]))


def close_in_order(key: np.ndarray, sizes: np.ndarray, carried: int, lags: int, alike: float, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Places (a, b) of members of one bucket at most lags apart in the order of keys that share a sample of the tail and are alike in size and sketch; the first ones carried are paired already."""
    firsts, seconds = [], []
    for lag in range(1, lags + 1):
        at = np.arange(max(lag, carried), len(key))
        differ = (key[at] ^ key[at - lag]).view(np.uint64)
        half = np.uint64((1 << TAIL // 2) - 1)
        at = at[(differ >> np.uint64(TAIL) == 0) & ((differ & half == 0) | (differ >> np.uint64(TAIL // 2) & half == 0))]
        long, short = sizes[at] >> 32, sizes[at - lag] >> 32
        same = (np.minimum(long, short) >= alike * np.maximum(long, short) - 1e-9) & (np.bitwise_count((sizes[at] ^ sizes[at - lag]).astype(np.uint64) & np.uint64(0xFFFFFFFF)) <= bits)
        seconds.append(at[same])
        firsts.append(at[same] - lag)
    return np.concatenate(firsts), np.concatenate(seconds)


def _neighbours(lags: int, alike: float, bits: int):
    """(key, k, size, sketch) in order to pairs (a, b) of different k in one bucket that are close in this order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ks, sizes = np.zeros(0, np.int64), None, np.zeros(0, np.int64)
        for batch in batches:
            carried = len(key)
            own = batch.column(1)
            key, ks, sizes = np.concatenate([key, np.asarray(batch.column(0))]), own if ks is None else pa.concat_arrays([ks, own]), np.concatenate([sizes, np.asarray(batch.column(2))])
            new = once([key, *_columns(ks)])  # a member that several tasks sent counts once
            key, ks, sizes = key[new], ks.take(pa.array(new)), sizes[new]
            firsts, seconds = close_in_order(key, sizes, carried, lags, alike, bits)
            yield pa.RecordBatch.from_arrays([ks.take(pa.array(firsts)), ks.take(pa.array(seconds))], names=["a", "b"])
            key, ks, sizes = key[-lags:], ks.slice(max(0, len(ks) - lags)), sizes[-lags:]

    return run


def neighbours(keyed: DataFrame, some: DataFrame, lags: int = LAGS, alike: float = 0.0, bits: int = 32) -> DataFrame:
    """Distinct pairs (a, b), a < b, of members k of keyed (key, k, size) that are close in the order of one of their buckets.

    size is a long: the upper half a size, of which the lesser of a pair is at least alike times the
    greater; the lower half a sketch, in which they differ in so many bits at most.

    Members of a bucket are sorted by the samples that follow the bucket's own, so that of many in one
    bucket the most alike come together. Each is paired with the next few, so a bucket of any size costs
    rows in proportion to its members and never all their pairs; buckets of up to lags + 1 lose no pair that shares
    a sample of the tail. Similar texts share several tables' buckets, each with an order of its own.

    some: a small part of keyed's rows. Buckets that hold more than a quarter of a partition's share of
    these are dealt to several tasks by k, differently in every table. Empty tables give no rows.
    """
    n = partitions(keyed)
    bucket = F.shiftright("key", TAIL)
    counts = some.groupBy(bucket.alias("bucket")).agg(F.countDistinct("k").alias("n"))
    total = counts.agg(F.sum("n")).first()[0] or 0
    hot = counts.where(F.col("n") > max(64.0, total / (4 * n))).select("bucket").collect()  # fewer than 4 * n
    rows, salt = keyed.select("key", "k", F.col("size").cast("long").alias("size"), bucket.alias("bucket")), F.lit(0)
    if hot:
        rows = rows.join(F.broadcast(keyed.sparkSession.createDataFrame([(r.bucket, True) for r in hot], "bucket long, hot boolean")), "bucket", "left")
        salt = F.when(F.col("hot"), F.pmod(F.xxhash64("k", "bucket"), F.lit(n))).otherwise(0)
    ordered = rows.repartition(n, "bucket", salt).select("key", "k", "size").sortWithinPartitions("key", "k")
    kind = keyed.schema["k"].dataType.simpleString()
    return ordered.mapInArrow(lean(_neighbours(lags, alike, bits)), f"a {kind}, b {kind}").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


#: Members of a bucket that meet in one place, with as many others.
BLOCK = 1024


def rooted(members: DataFrame, roots: DataFrame) -> DataFrame:
    """members (k, …) with the root of each, itself without one, for components (node, root)."""
    return members.join(roots.select(F.col("node").alias("k"), "root"), "k", "left").withColumn("root", F.coalesce("root", "k"))


def _mixed(own: DataFrame) -> DataFrame:
    """(bucket, n) of the buckets that hold members of several roots."""
    return own.groupBy("bucket").agg(F.min("root").alias("least"), F.max("root").alias("most"), F.count(F.lit(1)).alias("n")).where("least != most").select("bucket", "n")


def mixed_members(members: DataFrame, roots: DataFrame) -> DataFrame:
    """Distinct k of members (bucket, k) that share a bucket with a member of another component of roots (node, root)."""
    own = rooted(members.select("bucket", "k"), roots)
    return own.join(_mixed(own), "bucket").select("k").distinct()


def other_pairs(members: DataFrame, roots: DataFrame, alike: float, bits: int = 64) -> DataFrame:
    """Distinct pairs (a, b), a < b, of members (bucket, k, size) that share a bucket, whatever its size, and aren't in one component of roots (node, root).

    Of a pair the lesser size is at least alike times the greater. If members have a further column onward, the most that a member
    may share with another of this bucket, a pair's is alike / (1 + alike) of both sizes at least, as a weighted Jaccard similarity
    of alike wants. If they have a column mark, a pair's differ in so many bits at most. With the links that neighbours() led to, these pairs are all that can change a component: what is linked already needs no comparison. Buckets of one component, as of
    near copies, take no part; the members of others are dealt to blocks, and each pair of blocks meets in a place
    of its own, so that what is held is a block whatever the bucket. Members of a bucket's most common component meet those of
    others only, so a few strays among many near copies cost rows in proportion.
    """
    onward = F.col("onward") if "onward" in members.columns else F.lit(float("inf"))
    mark = F.col("mark") if "mark" in members.columns else F.lit(0).cast("long")
    own = rooted(members.select("bucket", "k", "size", onward.alias("onward"), mark.alias("mark")), roots)
    mixed = _mixed(own).select("bucket", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    some = cut(own.join(mixed, "bucket").withColumn("block", F.pmod(F.xxhash64("k"), F.col("blocks")).cast("int")), "mixed-buckets")
    most = some.groupBy("bucket", "root").agg(F.count(F.lit(1)).alias("n")).groupBy("bucket").agg(F.max_by("root", F.struct("n", "root")).alias("most"))
    told = some.join(most, "bucket").withColumn("most", F.col("root") == F.col("most"))
    every = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    x = told.where("not most").select("bucket", F.col("block").alias("i"), every.alias("j"), F.col("k").alias("a"), F.col("root").alias("of_a"), F.col("size").alias("x"), F.col("onward").alias("on_x"), F.col("mark").alias("mark_x"))
    y = told.select("bucket", every.alias("i"), F.col("block").alias("j"), F.col("k").alias("b"), F.col("root").alias("of_b"), F.col("size").alias("y"), F.col("onward").alias("on_y"), F.col("mark").alias("mark_y"), "most")
    fits = (F.col("most") | (F.col("a") < F.col("b"))) & (F.col("of_a") != F.col("of_b")) & (F.least("x", "y") >= alike * F.greatest("x", "y") - 1e-9)
    fits = fits & ((1 + alike) * F.least("on_x", "on_y") >= (alike - 1e-9) * (F.col("x") + F.col("y"))) & (F.bit_count(F.col("mark_x").bitwiseXOR(F.col("mark_y"))) <= bits)
    pairs = x.join(y, ["bucket", "i", "j"]).where(fits).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    found = cut(pairs.distinct(), "other-pairs")
    discard(some)
    return found


#: Members, and characters of theirs, that meet in one place with as many others.
PLACE_CHARS = 4 << 20


def meetings(members: DataFrame, roots: DataFrame, texts: DataFrame) -> DataFrame:
    """(place, block, k, root, size, mark, text) of members (bucket, k, size, mark) whose bucket holds several components of roots (node, root), dealt to places and sorted by them.

    texts: (half, text) of all members. Any two members of a bucket that are in different components meet in one place at least. A bucket
    of up to BLOCK members is one place. The strays of a larger one, which aren't in its most common component, are dealt to blocks, and so are
    the members of this component: strays meet in all pairs of their blocks, and with each block of the others, which don't meet
    among themselves. Members of one block have met elsewhere unless a place is of this block alone, or of the whole bucket.
    """
    own = rooted(members, roots)
    each = own.groupBy("bucket", "root").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("chars"))
    greatest = F.max(F.struct("n", "root", "chars")).alias("most")
    mixed = each.groupBy("bucket").agg(greatest, F.sum("n").alias("n"), F.sum("chars").alias("chars")).where("n > most.n")
    blocks = lambda n, chars: F.greatest(F.ceil(n / BLOCK), F.ceil(chars / PLACE_CHARS), F.lit(1)).cast("int")
    whole = (F.col("n") <= BLOCK) & (F.col("chars") <= PLACE_CHARS)
    strays = F.when(whole, 1).otherwise(blocks(F.col("n") - F.col("most.n"), F.col("chars") - F.col("most.chars")))
    mixed = mixed.select("bucket", F.col("most.root").alias("most"), whole.alias("whole"), strays.alias("strays"), blocks(F.col("most.n"), F.col("most.chars")).alias("others"))
    stray, dealt = F.col("whole") | (F.col("root") != F.col("most")), F.xxhash64("k")
    some = own.join(mixed, "bucket").withColumn("block", F.when(stray, F.pmod(dealt, F.col("strays"))).otherwise(F.col("strays") + F.pmod(dealt, F.col("others"))).cast("int"))
    last = F.when(F.col("whole"), 0).when(stray, F.col("strays") + F.col("others") - 1).otherwise(F.col("strays") - 1)
    told = some.withColumn("last", last).join(texts, F.col("k") == F.col("half"))
    met = told.select("bucket", "block", "k", "root", "size", "mark", "text", F.explode(F.sequence(F.lit(0), "last")).alias("other"))
    place = F.struct("bucket", F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y")).alias("place")
    return met.select(place, "block", "k", "root", "size", "mark", "text").repartition(partitions(members), "place").sortWithinPartitions("place")


def merged(roots: DataFrame, more: DataFrame, label: str = "components") -> DataFrame:
    """Components (node, root) after further edges (a, b) between their roots, where a node without a root is its own."""
    above = components(more, label)
    moved = roots.join(above.select(F.col("node").alias("root"), F.col("root").alias("to")), "root", "left").select("node", F.coalesce("to", "root").alias("root"))
    return moved.unionByName(above.join(roots.select("node"), "node", "left_anti"))


#: Members that a task gathers before it deals them out, and the parts that a partition's members are dealt to.
DEALT_AT_ONCE, PARTS_EACH = 1 << 19, 4


def packed_neighbours(dealt: DataFrame, lags: int = LAGS, alike: float = 0.0, bits: int = 32) -> DataFrame:
    """neighbours() of members that come packed, as packed_pairs() takes them."""
    return packed_pairs(dealt, lags, alike, bits).where("bucket is null").select("a", "b").distinct()


def further_apart(key: np.ndarray, lags: int, hot: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places, groups) of members, in order of keys, that share a bucket and a sample of the tail with some that may be more than lags apart; hot: those whose bucket is dealt to several parts."""

    def each(x: np.ndarray) -> np.ndarray:
        starts = once([x])
        sizes = np.diff(np.append(starts, len(x)))
        return np.repeat(sizes, sizes)

    half = TAIL // 2
    first = key >> half  # these lie together
    own = np.flatnonzero((each(first) > lags + 1) | hot)
    second = (key >> TAIL) << half | key & ((1 << half) - 1)
    likely = np.flatnonzero((each(key >> TAIL) > lags + 1) | hot)
    _, of, n = np.unique(second[likely], return_inverse=True, return_counts=True)
    likely = likely[(n[of] > 1) | hot[likely]]
    return np.concatenate([own, likely]), np.concatenate([first[own] << 1, second[likely] << 1 | 1])


def packed_pairs(dealt: DataFrame, lags: int = LAGS, alike: float = 0.0, bits: int = 32) -> DataFrame:
    """neighbours() of members that are whole numbers and come packed, and who else is to be compared: rows (a, b, bucket, size).

    Rows of dealt (members) hold arrays of k, of the keys of each in turn, as many for all, and of size. Rows without a bucket are pairs a < b,
    some of them several times. The others are members a, with their size, of a bucket that has a sample of the tail in its
    name, and more members than the order brings together: meetings() has all that are left of its pairs.

    Members go to parts by bucket, many in one row, and a part is sorted at once: what is held is a part, some
    PARTS_EACH-th of a partition. Hot buckets are dealt by k as in neighbours(), found from every 64th member.
    """
    n = partitions(dealt)
    parts = PARTS_EACH * n

    def members(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        k, key, size = (x.view(np.int64) for x in unpack(data))
        each = len(key) // max(1, len(k))
        return np.repeat(k, each), key, np.repeat(size, each)

    def scattered(x: np.ndarray) -> np.ndarray:
        x = x.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return x ^ x >> np.uint64(32)

    def some(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0).to_pylist():
                k, key, _ = members(data)
                own = scattered(k) & np.uint64(63) == 0
                yield pa.RecordBatch.from_arrays([pa.array(key[own] >> TAIL), pa.array(k[own])], names=["bucket", "k"])

    counts = dealt.mapInArrow(lean(some), "bucket long, k long").groupBy("bucket").agg(F.countDistinct("k").alias("n"))
    total = counts.agg(F.sum("n")).first()[0] or 0
    hot = np.array(sorted(r.bucket for r in counts.where(F.col("n") > max(64.0, total / (4 * n))).select("bucket").collect()), np.int64)  # fewer than 4 * n

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def dealt_out(held: list) -> pa.RecordBatch:
            k, key, size = (np.concatenate(c) for c in zip(*held))
            bucket = key >> TAIL
            place = scattered(bucket)
            if len(hot):
                salted = np.isin(bucket, hot)
                place[salted] = scattered((k[salted].view(np.uint64) ^ place[salted]).view(np.int64))
            part = (place % np.uint64(parts)).astype(np.int64)
            order = np.argsort(part, kind="stable")
            k, key, size = k[order], key[order], size[order]
            sizes = np.bincount(part, minlength=parts)
            own, ends = np.flatnonzero(sizes), np.cumsum(sizes)
            data = [b"".join(x[ends[p] - sizes[p] : ends[p]].tobytes() for x in (k, key, size)) for p in own.tolist()]
            return pa.RecordBatch.from_arrays([pa.array(own, pa.int64()), pa.array(data, pa.binary())], names=["part", "members"])

        held, n = [], 0
        for batch in batches:
            for data in batch.column(0).to_pylist():
                held.append(members(data))
                n += len(held[-1][0])
                if n >= DEALT_AT_ONCE:
                    yield dealt_out(held)
                    held, n = [], 0
        if held:
            yield dealt_out(held)

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def close(held: list[bytes]) -> pa.RecordBatch:
            k, key, size = (np.concatenate(c) for c in zip(*(np.frombuffer(x, np.int64).reshape(3, -1) for x in held)))
            order = np.lexsort((k, key))
            k, key, size = k[order], key[order], size[order]
            new = once([key, k])
            k, key, size = k[new], key[new], size[new]
            firsts, seconds = close_in_order(key, size, 0, lags, alike, bits)
            both = np.sort(np.array([k[firsts], k[seconds]]), axis=0)
            both = both[:, np.lexsort(both[::-1])]
            both = both[:, once(list(both))]
            at, groups = further_apart(key, lags, np.isin(key >> TAIL, hot) if len(hot) else np.zeros(len(key), bool))
            none = [pa.nulls(len(at), pa.int64()), pa.nulls(both.shape[1], pa.int64())]
            columns = [pa.concat_arrays([pa.array(both[0]), pa.array(k[at])]), pa.concat_arrays([pa.array(both[1]), none[0]]), pa.concat_arrays([none[1], pa.array(groups)]), pa.concat_arrays([none[1], pa.array(size[at])])]
            return pa.RecordBatch.from_arrays(columns, names=["a", "b", "bucket", "size"])

        now, held = None, []
        for batch in batches:
            for part, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if part != now and held:
                    yield close(held)
                    held = []
                now = part
                held.append(data)
        if held:
            yield close(held)

    dealt_rows = dealt.mapInArrow(lean(deal), "part long, members binary").repartition(n, "part").sortWithinPartitions("part")
    return dealt_rows.mapInArrow(lean(pairs), "a long, b long, bucket long, size long")


def components(edges: DataFrame, label: str = "components", most_rounds: int = 100) -> DataFrame:
    """(node, root) of every node of edges (a, b): root is the least node of its component.

    Alternating large-star and small-star steps: each re-hangs a node's neighbours on the least of
    them, so the number of edges never grows and long chains halve. A node with very many neighbours
    is aggregated to its least neighbour by partial aggregation; its edges are never gathered in one
    row. Every round is cut into a table, and the one before deleted; rounds end when every node hangs on
    a root. Rounds grow with the logarithm of the longest chain; more than most_rounds raise an error,
    and no edge is dropped. Empty edges give no rows.
    """
    now = cut(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct(), label)
    for _ in range(most_rounds):
        # Done if no node hangs on two, and none on a node that hangs itself.
        hung = now.groupBy("u").agg(F.count(F.lit(1)).alias("n"))
        if not now.join(hung.select(F.col("u").alias("v")), "v", "left_semi").limit(1).union(now.join(hung.where("n > 1").select("u"), "u", "left_semi").limit(1)).take(1):
            break
        # Large star: every neighbour greater than the node goes to the least of the node and its neighbours.
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        # Small star: the node and its lesser neighbours go to the least of these.
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        after = cut(small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).where("u != v").distinct(), label)
        discard(now)
        now = after
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
