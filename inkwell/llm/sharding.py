"""Sharding on a consistent-hash ring with virtual nodes and bounded loads.

Every shard owns many virtual nodes on a ring of 2**16 cells. A row's key hashes to a cell and
belongs to the next virtual node clockwise; a shard that is full passes what overflows on to the
next virtual node, round after round. Capacities are floor(n / shards) or one more, so that they
add up to n: counts are at most one apart (law ``rows``), and a row moves only when its own arc or
a full shard in front of it changes.

Only per-arc counts reach the driver (shards x virtual nodes numbers, whatever the input). There
the overflow is solved on counts: it cuts each arc's ordered keys into runs, one run per shard that
takes them. Rows find their run by their rank within the arc, and their slot is the run's first
slot plus the distance from its start, so no second ranking over a whole shard is needed.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from inkwell.llm.common import cut, whole_text

CELLS = 1 << 16
LAW = "rows"
#: Copies of one key that one output task expands at most.
CHUNK = 1 << 16


def virtual_nodes(shards: int, replicas: int) -> list[tuple[int, int]]:
    """(cell, shard) of every virtual node in ring order; a shard's nodes don't depend on the others."""
    ring = []
    for shard in range(shards):
        for replica in range(replicas):
            digest = hashlib.blake2b(f"{shard}/{replica}".encode(), digest_size=8).digest()
            ring.append((int.from_bytes(digest, "big") % CELLS, digest, shard))
    return [(cell, shard) for cell, _, shard in sorted(ring)]


def arcs_of_cells(ring: list[tuple[int, int]]) -> list[int]:
    """The arc, that is the index of the next virtual node clockwise, of every cell."""
    cells = [cell for cell, _ in ring]
    return [bisect_left(cells, cell) % len(ring) for cell in range(CELLS)]


def capacities(rows: int, shards: int) -> list[int]:
    return [rows // shards + (shard < rows % shards) for shard in range(shards)]


def overflow_runs(counts: dict[int, int], ring: list[tuple[int, int]], shards: int) -> list[tuple[int, int, int, int, int]]:
    """(arc, first rank, rank after the last, shard, first slot): who takes which keys of an arc.

    In round r, arc by arc, the keys an arc still holds ask the r-th virtual node from their own;
    it takes as many as its shard has room for. Capacities sum to the number of keys, so all are placed.
    """
    total = sum(counts.values())
    room = capacities(total, shards)
    used = [0] * shards
    waiting = sorted((arc, 0, n) for arc, n in counts.items() if n)
    runs, step = [], 0
    while waiting:
        later = []
        for arc, done, n in waiting:
            shard = ring[(arc + step) % len(ring)][1]
            take = min(n - done, room[shard] - used[shard])
            if take:
                runs.append((arc, done, done + take, shard, used[shard]))
                used[shard] += take
            if done + take < n:
                later.append((arc, done + take, n))
        waiting, step = later, step + 1
    return runs


def assign_shards(docs: DataFrame, shards: int = 16, replicas: int = 128) -> DataFrame:
    """Shard and slot of every row of docs (doc_id, text; other columns are left out).

    Returns doc_id, size (UTF-8 bytes plus 1), text_crc32 (of an empty text where it is null), law,
    shard, slot (gapless from 0 in each shard) and grown_shard (null under this law). A null doc_id
    hashes like any other value. Equal rows are counted once and share one position, so a row that
    makes up a third of the table is one row in the ranking; its copies fill adjacent places and are
    written out in chunks. An empty table gives no rows.
    """
    spark = docs.sparkSession
    text = whole_text()
    keys = (
        docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
        .groupBy("doc_id", "size", "text_crc32")
        .agg(F.count(F.lit(1)).alias("copies"))
        .withColumn("position", F.xxhash64("doc_id", "size", "text_crc32"))
    )
    ring = virtual_nodes(shards, replicas)
    cells = spark.createDataFrame(list(enumerate(arcs_of_cells(ring))), "cell int, arc int")
    cell = F.shiftrightunsigned("position", 48).cast("int").alias("cell")
    placed = keys.select("*", cell).join(F.broadcast(cells), "cell")  # CELLS rows, whatever the input
    before = Window.partitionBy("arc").orderBy("position", "doc_id", "size", "text_crc32").rowsBetween(Window.unboundedPreceding, -1)
    ranked = cut(placed.select("doc_id", "size", "text_crc32", "copies", "arc", F.coalesce(F.sum("copies").over(before), F.lit(0)).alias("rank")), "shard-ranks")

    counts = {r.arc: r.n for r in ranked.groupBy("arc").agg(F.sum("copies").alias("n")).collect()}  # at most shards x replicas rows
    runs = spark.createDataFrame(overflow_runs(counts, ring, shards), "arc int, lo long, hi long, shard int, base long")
    first, last = F.greatest("lo", "rank"), F.least("hi", F.col("rank") + F.col("copies")) - 1
    parts = ranked.join(F.broadcast(runs), "arc").where((F.col("rank") < F.col("hi")) & (F.col("rank") + F.col("copies") > F.col("lo"))).select("*", first.alias("first"), last.alias("last"))
    single = parts.where("first = last").withColumn("at", F.col("first"))
    several = parts.where("first < last").withColumn("from", F.explode(F.sequence("first", "last", F.lit(CHUNK).cast("long"))))
    several = several.repartition("doc_id", "from").withColumn("at", F.explode(F.sequence("from", F.least(F.col("from") + CHUNK - 1, F.col("last"))))).drop("from")
    return single.unionByName(several).select(
        "doc_id", "size", "text_crc32", F.lit(LAW).alias("law"), "shard", (F.col("base") + F.col("at") - F.col("lo")).alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )


def write_shards(docs: DataFrame, assigned: DataFrame, path: str, file_rows: int = 1 << 18) -> None:
    """Write the documents' texts as one folder per shard, whose files hold about file_rows rows in a row each.

    Copies of one row are interchangeable: they are numbered on both sides and meet by number. Null
    texts are written as nulls, null doc_ids as nulls; an empty table writes no shard; extra columns are left out.
    """
    text = whole_text()
    same = ["doc_id", "size", "text_crc32"]
    number = F.row_number().over(Window.partitionBy(*same).orderBy(F.lit(0)))
    keyed = docs.select("doc_id", "text", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32")).withColumn("copy", number)
    placed = assigned.select(*same, "shard", "slot").withColumn("copy", F.row_number().over(Window.partitionBy(*same).orderBy("shard", "slot")))
    on = [F.col(f"d.{c}").eqNullSafe(F.col(f"p.{c}")) for c in [*same, "copy"]]
    rows = keyed.alias("d").join(placed.alias("p"), on).select("d.doc_id", "d.text", "p.shard", "p.slot")
    rows.repartition("shard", F.floor(F.col("slot") / file_rows)).write.partitionBy("shard").parquet(path)
