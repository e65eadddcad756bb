"""Ranking within groups with ties: a hybrid of lexsorts for light groups and one sample sort for heavy ones.

1. Rows are counted exactly by group. A group is heavy if it has more than heavy_rows rows or more than half of what a
   partition would have by a fair deal. Groups hash to CELLS cells; a cell that holds a heavy group is hot. What is broadcast
   is the list of hot cells, at most CELLS numbers whatever the input.
2. Groups of other cells are dealt to buckets of about bucket_rows rows, and each bucket is lexsorted at once by
   applyInPandas: no group there has more than heavy_rows rows, so a task's memory is bounded.
3. Rows of hot cells are sorted by one sample sort over all their groups: splitters taken from a sample deal them to
   ranges, each of which sorts and spills on its own. A running number splits rows that are equal in every key, so a
   group, or one value of it, spreads over as many ranges as its rows need. Rows are counted by range, group and
   pair; prefix sums of these counts over a group's ranges turn places within a range into places within the group.

Nothing but numbers of cells and of ranges, which are settings, reaches the driver.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from inkwell.llm.common import cut, fresh, partitions

CELLS = 1 << 16
HEAVY_ROWS, BUCKET_ROWS = 50_000, 50_000
#: Buckets, and ranges of the sample sort, to a partition.
BUCKETS_EACH, RANGES_EACH = 8, 4
#: No group of so few rows is heavy for its share of a partition alone.
SMALL_ROWS = 2_000
#: Bits of a row's place in monotonically_increasing_id(); those above tell the partition.
PLACE_BITS = 33


@dataclass(frozen=True)
class Key:
    """A column to sort by."""

    column: str
    descending: bool = False
    nulls_last: bool = False

    def order(self) -> Column:
        c = F.col(self.column)
        if self.descending:
            return c.desc_nulls_last() if self.nulls_last else c.desc_nulls_first()
        return c.asc_nulls_last() if self.nulls_last else c.asc_nulls_first()


def starts(new: np.ndarray) -> np.ndarray:
    """For every row, the first row of its run; new marks where runs begin."""
    return np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))


def lexsort_bucket(groups: Sequence[str], pair: Sequence[Key], ties: Sequence[Key], nulls: str, most_place: int | None):
    """For applyInPandas: some whole groups' rows to those rows in order with pos, place and tied. Values are never null; bit k of nulls says that the k-th column's was."""
    columns = [*groups, *(k.column for k in (*pair, *ties))]

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        masks, keys = frame[nulls].to_numpy(), []
        for k, name in enumerate(columns):
            key = Key(name) if k < len(groups) else (*pair, *ties)[k - len(groups)]
            absent, values = (masks >> k) & 1, frame[name].to_numpy()
            if absent.any():
                keys.append(absent if key.nulls_last else 1 - absent)
            keys.append(~values if key.descending else values)
        order = np.lexsort(keys[::-1])
        masks, n = masks[order], len(order)
        sorted_values = {name: frame[name].to_numpy()[order] for name in columns}

        def changes(names: Sequence[str], first: int) -> np.ndarray:
            new = np.zeros(n, bool)
            new[:1] = True
            bits = sum(1 << (first + j) for j in range(len(names)))
            for of in (*(sorted_values[name] for name in names), masks & bits):
                new[1:] |= of[1:] != of[:-1]
            return new

        new_group = changes(groups, 0)
        new_pair = new_group | changes([k.column for k in pair], len(groups))
        group_at, pair_at = starts(new_group), starts(new_pair)
        heads = np.flatnonzero(new_pair)
        sizes = np.diff(np.append(heads, n))
        place = pair_at - group_at + 1
        keep = slice(None) if most_place is None else place <= most_place
        found = {name: values[keep] for name, values in sorted_values.items()}
        found |= {nulls: masks[keep], "pos": (np.arange(n) - group_at + 1)[keep], "place": place[keep], "tied": np.repeat(sizes, sizes)[keep]}
        return pd.DataFrame(found)

    return run


def same(left: str, right: str, names: Sequence[str]) -> Column:
    """Equality of both sides' columns, nulls equal to each other."""
    return reduce(lambda a, b: a & b, (F.col(f"{left}.{c}").eqNullSafe(F.col(f"{right}.{c}")) for c in names))


def _light(rows: DataFrame, groups: Sequence[str], pair: Sequence[Key], ties: Sequence[Key], n_rows: int, most_place: int | None, bucket_rows: int) -> DataFrame:
    columns = rows.columns
    bucket, nulls = fresh(rows, "bucket", "nulls")
    # Several buckets to a partition, if there are rows for them, so that partitions get about as much each.
    even = min(BUCKETS_EACH * partitions(rows), -(-n_rows // max(1, bucket_rows // 50)))
    buckets = max(1, even, -(-n_rows // bucket_rows))
    mask = reduce(lambda a, b: a.bitwiseOR(b), (F.when(F.col(c).isNull(), F.lit(1 << k)).otherwise(F.lit(0)).cast("long") for k, c in enumerate(columns)))
    # The cell is made of the hash's highest bits, the bucket of what is left over by division.
    packed = rows.select(F.pmod(F.xxhash64(*groups), F.lit(buckets)).cast("int").alias(bucket), mask.alias(nulls), *(F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in columns))
    schema = StructType([StructField(c, LongType()) for c in (*columns, nulls, "pos", "place", "tied")])
    sorted_rows = packed.groupBy(bucket).applyInPandas(lexsort_bucket(groups, pair, ties, nulls, most_place), schema)
    back = [F.when(F.col(nulls).bitwiseAND(F.lit(1 << k)) == 0, F.col(c)).alias(c) for k, c in enumerate(columns)]
    return sorted_rows.select(*back, "pos", "place", "tied")


def _heavy(rows: DataFrame, groups: Sequence[str], pair: Sequence[Key], ties: Sequence[Key], number: str, most_place: int | None, ranges: int) -> DataFrame:
    columns, pairs = [c for c in rows.columns if c != number], [k.column for k in pair]
    at, part, n, first, start, before, shift = fresh(rows, "at", "part", "n", "first", "start", "before", "shift")
    order = [*(F.col(c).asc_nulls_first() for c in groups), *(k.order() for k in (*pair, *ties)), F.col(number)]
    dealt = rows.repartitionByRange(ranges, *order).sortWithinPartitions(*order).select(*columns, F.monotonically_increasing_id().alias(at))
    table = cut(dealt, "ranked-ranges").withColumn(part, F.shiftrightunsigned(at, PLACE_BITS))
    runs = table.groupBy(*groups, *pairs, part).agg(F.count(F.lit(1)).alias(n), F.min(at).alias(first))
    # Rows of a group are next to each other in a range; its ranges are numbered in order.
    by_range = runs.groupBy(*groups, part).agg(F.sum(n).alias(n), F.min(first).alias(start))
    earlier = Window.partitionBy(*groups).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    prefix = by_range.select(*groups, part, start, F.coalesce(F.sum(n).over(earlier), F.lit(0)).alias(before))
    placed = runs.alias("l").join(prefix.alias("r").hint("merge"), same("l", "r", [*groups, part])).select("l.*", (F.col(before) + F.col(first) - F.col(start)).alias(before))
    whole = Window.partitionBy(*groups, *pairs)
    ranked = placed.select(*groups, *pairs, part, (F.col(before) - F.col(first) + 1).alias(shift), (F.min(before).over(whole) + 1).alias("place"), F.sum(n).over(whole).alias("tied"))
    if most_place is not None:
        ranked = ranked.where(F.col("place") <= most_place)
    joined = table.alias("l").join(ranked.alias("r").hint("merge"), same("l", "r", [*groups, *pairs, part]))
    return joined.select(*(F.col(f"l.{c}") for c in columns), (F.col(f"l.{at}") + F.col(f"r.{shift}")).alias("pos"), "r.place", "r.tied")


def rank_ties(rows: DataFrame, groups: Sequence[str], pair: Sequence[Key], ties: Sequence[Key], most_place: int | None = None, heavy_rows: int = HEAVY_ROWS, bucket_rows: int = BUCKET_ROWS, ranges: int | None = None) -> DataFrame:
    """Every row's pos, place and tied within its group, for rows of integer columns.

    pos counts a group's rows from 1 by pair, then ties; place is 1 plus the group's rows with an earlier pair; tied
    counts its rows with the same pair. most_place keeps rows whose place is at most that. Returns the groups', pairs'
    and ties' columns as long; others are left out, whatever their names, so none may be called pos, place or tied.
    Null group values form groups of their own; nulls of a key are equal to each other and stand where the key says.
    Rows equal in all these columns are ranked one after another; which of them comes first can't be told. An empty
    table gives no rows. rows is read three times and must give the same rows in the same partitions and order each
    time, as a table's files do. ranges: tasks of the sample sort, RANGES_EACH times the session's shuffle partitions unless given.
    """
    columns = [*groups, *(k.column for k in (*pair, *ties))]
    if len({c.lower() for c in (*columns, "pos", "place", "tied")}) < len(columns) + 3:
        raise ValueError("columns to group and sort by must differ, and none may be called pos, place or tied")
    rows = rows.select(*(F.col(c).cast("long").alias(c) for c in columns))
    cell, number, n = fresh(rows, "cell", "number", "n")
    of = F.shiftrightunsigned(F.xxhash64(*groups), 48).cast("int").alias(cell)
    counts = rows.groupBy(*groups).agg(F.count(F.lit(1)).alias(n)).groupBy(of).agg(F.max(n).alias("most"), F.sum(n).alias("rows"))
    cells = cut(counts, "ranked-cells")  # CELLS rows at most
    n_rows = cells.agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0]
    light = F.col("most") <= min(heavy_rows, max(SMALL_ROWS, n_rows // (2 * partitions(rows))))
    total = cells.agg(F.coalesce(F.sum(F.when(light, F.col("rows"))), F.lit(0)).alias("light"), F.count_if(~light).alias("hot")).first()
    if not total.hot:
        return _light(rows, groups, pair, ties, total.light, most_place, bucket_rows)
    hot = F.broadcast(cells.where(~light).select(cell))
    numbered = rows.select("*", F.monotonically_increasing_id().alias(number), of)
    lighter = rows.select("*", of).join(hot, cell, "left_anti").select(*columns)
    heavier = numbered.join(hot, cell, "left_semi").select(*columns, number)
    return _light(lighter, groups, pair, ties, total.light, most_place, bucket_rows).unionByName(_heavy(heavier, groups, pair, ties, number, most_place, ranges or RANGES_EACH * partitions(rows)))


GROUPS = ("vendor_id", "part", "month")
PAIR = (Key("tens", descending=True), Key("percent"))
TIES = tuple(Key(c, nulls_last=True) for c in ("sale_id", "line_no", "quantity", "amount_cents"))


def line_keys(lines: DataFrame) -> DataFrame:
    """The columns that sale_lines are grouped and ranked by.

    Lines whose sale_id's CRC-32 is divisible by 5 form one group. A null discount gives a null percent, which comes
    first like a null quantity.
    """
    together = F.coalesce(F.crc32(F.col("sale_id").cast("string")) % 5 == 0, F.lit(False))
    unless = lambda c: F.when(together, F.lit(-1).cast("long")).otherwise(c.cast("long"))
    hundredths = lambda c: F.floor(100 * F.col(c) + 0.5).cast("long")
    return lines.select(
        unless(F.col("vendor_id")).alias("vendor_id"),
        unless(F.coalesce(F.col("item_id") % 10, F.lit(-1))).alias("part"),
        unless(F.coalesce(100 * F.year("shipped_at") + F.month("shipped_at"), F.lit(-1))).alias("month"),
        F.floor(F.col("quantity") / 10).cast("long").alias("tens"),
        hundredths("discount").alias("percent"),
        "sale_id",
        "line_no",
        "quantity",
        hundredths("amount").alias("amount_cents"),
    )


def rank_lines(lines: DataFrame, most_place: int | None = 3, **settings: int) -> DataFrame:
    """Lines of sale_lines with a place of at most most_place within vendor, part and month."""
    ranked = rank_ties(line_keys(lines), GROUPS, PAIR, TIES, most_place, **settings)
    return ranked.select("vendor_id", "part", "month", "pos", "place", "sale_id", "line_no", "quantity", "percent", "amount_cents", "tied")


ORACLE = """
WITH ids AS (SELECT DISTINCT sale_id FROM sale_lines WHERE sale_id IS NOT NULL),
crc AS (SELECT sale_id, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(sale_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
          lambda c, b: list_reduce(list_prepend(xor(c, b), [1::BIGINT, 2, 3, 4, 5, 6, 7, 8]), lambda a, i: CASE WHEN a % 2 = 1 THEN xor(a >> 1, 3988292384::BIGINT) ELSE a >> 1 END)), 4294967295::BIGINT) AS crc FROM ids),
k AS (SELECT l.*, coalesce(crc.crc % 5 = 0, false) AS together FROM sale_lines l LEFT JOIN crc USING (sale_id)),
g AS (SELECT CASE WHEN together THEN -1 ELSE vendor_id END AS vendor_id, CASE WHEN together THEN -1 ELSE coalesce(item_id % 10, -1) END AS part,
             CASE WHEN together THEN -1 ELSE coalesce(100 * year(shipped_at) + month(shipped_at), -1) END AS month,
             floor(quantity / 10.0)::BIGINT AS tens, floor(100 * discount + 0.5)::BIGINT AS percent, sale_id, line_no::BIGINT AS line_no, quantity::BIGINT AS quantity,
             floor(100 * amount + 0.5)::BIGINT AS amount_cents FROM k),
r AS (SELECT *, row_number() OVER (PARTITION BY vendor_id, part, month ORDER BY tens DESC NULLS FIRST, percent ASC NULLS FIRST, sale_id NULLS LAST, line_no NULLS LAST, quantity NULLS LAST, amount_cents NULLS LAST) AS pos,
             rank() OVER (PARTITION BY vendor_id, part, month ORDER BY tens DESC NULLS FIRST, percent ASC NULLS FIRST) AS place,
             count(*) OVER (PARTITION BY vendor_id, part, month, tens, percent) AS tied FROM g)
SELECT vendor_id::BIGINT AS vendor_id, part::BIGINT AS part, month::BIGINT AS month, pos, place, sale_id, line_no, quantity, percent, amount_cents, tied FROM r WHERE place <= 3
"""
