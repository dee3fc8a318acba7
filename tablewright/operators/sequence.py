"""Operators that need row order: forward/backward fill, time gaps, global ordinal codes.

A window over a whole table, or over one huge key, would run in a single task.  Here the order column is
cut at split points into ordered blocks; every block works on its own, and what one block must know of
the earlier ones (a last value, a count) is a small table with one row per key and block.

Nothing limits the number of blocks.  Beyond ``ONE_LEVEL`` of them the cut has two levels: about sqrt(blocks) ranges, whose
bounds are literals, and in each range about sqrt(blocks) split points kept as one array in a written table.
What is carried is scanned by the same levels, over ranges and inside ranges, so no task sees more than sqrt(blocks) rows of a key.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.functions.columns import col, plan_bytes
from tablewright.functions.lineage import cut

BYTES_PER_BLOCK = 64 * 1024 * 1024
ONE_LEVEL = 64
# Order values drawn per wanted split point; they only decide how even the blocks are.
DRAWN_PER_POINT = 16
# Text is cut at this many characters to place it (which keeps its order), so a split point has a bounded size.
PLACED_CHARACTERS = 64
BROADCAST_BYTES = 32 * 1024 * 1024
POINT_BYTES = 4 * PLACED_CHARACTERS


def block_count(df: DataFrame) -> int:
    """One block per 64 MB.

    The optimizer's estimate settles small plans. It multiplies the sides of a join, so whatever it takes for large is measured:
    rows and bytes of texts in one job, 16 bytes for any other cell.
    """
    if plan_bytes(df) <= BYTES_PER_BLOCK:
        return 1
    texts = [f.name for f in df.schema if isinstance(f.dataType, (T.StringType, T.BinaryType))]
    sizes = [F.coalesce(F.sum(F.octet_length(col(c))), F.lit(0)).alias(f"b{i}") for i, c in enumerate(texts)]
    rows, *text_bytes = df.agg(F.count(F.lit(1)).alias("n"), *sizes).first()
    return max(1, (rows * 16 * len(df.columns) + sum(text_bytes)) // BYTES_PER_BLOCK)


def _placed_by(df: DataFrame, order: str) -> Column:
    """The part of an order value that places it: the value, or the first characters of a text."""
    if isinstance(df.schema[order].dataType, T.StringType):
        return F.substring(col(order), 1, PLACED_CHARACTERS)
    return col(order)


def _ranges(df: DataFrame, order: str, ranges: int) -> tuple[list, int]:
    """The least order value of each range partition but the first, and the rows that have an order value."""
    if ranges <= 1:
        return [], 0
    parts = df.select(_placed_by(df, order).alias("o")).filter("o is not null").repartitionByRange(ranges, "o")
    least = parts.groupBy(F.spark_partition_id().alias("p")).agg(F.min("o").alias("o"), F.count(F.lit(1)).alias("n")).collect()
    return sorted({r["o"] for r in least})[1:], sum(r["n"] for r in least)


def _range_of(order: Column, points: Sequence) -> Column:
    """Index of the range an order value falls in, from 1: a balanced tree of comparisons.

    NULL has range 0 to itself, whatever the number of ranges.
    """

    def choose(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        middle = (low + high) // 2
        return F.when(order < F.lit(points[middle]), choose(low, middle)).otherwise(choose(middle + 1, high))

    return F.when(order.isNull(), 0).otherwise(choose(0, len(points)) + 1)


def _points_up_to(points: Column, value: Column, most: int) -> Column:
    """How many entries of a sorted array of at most ``most`` are not above the value, by bisection."""
    steps = F.sequence(F.lit(1), F.lit(most.bit_length()))
    start = F.struct(F.lit(0).alias("low"), F.size(points).alias("high"))

    def halve(at: Column, _: Column) -> Column:
        middle = F.floor((at["low"] + at["high"]) / 2).cast("int")
        right = F.struct((middle + 1).alias("low"), at["high"].alias("high"))
        left = F.struct(at["low"].alias("low"), middle.alias("high"))
        return F.when(at["low"] >= at["high"], at).when(F.get(points, middle) <= value, right).otherwise(left)

    return F.aggregate(steps, start, halve, lambda at: at["low"])


def in_blocks(df: DataFrame, order: str, blocks: int | None = None) -> DataFrame:
    """The table with ``_range`` and ``_block``: both ascend with the order value, and equal values share a block.

    Without an order value both are 0.  The split points inside ranges are drawn by a hash of the values from all rows and
    written once, so that every later pass, also one repeated after a loss, cuts at the same places.
    """
    blocks = block_count(df) if blocks is None else blocks
    value = _placed_by(df, order)
    if blocks <= ONE_LEVEL:
        points, _ = _ranges(df, order, blocks)
        return df.withColumn("_range", _range_of(value, points)).withColumn("_block", F.col("_range").cast("long"))
    ranges = math.isqrt(blocks - 1) + 1
    inside = -(-blocks // ranges)
    points, rows = _ranges(df, order, ranges)
    ranged = df.withColumn("_range", _range_of(value, points))
    share = min(1.0, DRAWN_PER_POINT * blocks / max(rows, 1))
    # A value is drawn whole or not at all, so a frequent one gives one entry, however many rows hold it.
    drawn = F.pmod(F.xxhash64(F.lit("cut"), value), F.lit(2**31)) < int(share * 2**31)
    values = ranged.filter(value.isNotNull() & drawn).groupBy("_range").agg(F.array_sort(F.collect_set(value)).alias("s"))
    places = F.sequence(F.lit(1), F.lit(inside - 1))
    chosen = F.transform(places, lambda i: F.get("s", F.floor(i * F.size("s") / inside).cast("int")))
    table = cut(values.select(F.col("_range").alias("_r"), F.array_distinct(chosen).alias("_points")))
    side = F.broadcast(table) if blocks * POINT_BYTES <= BROADCAST_BYTES else table
    found = _points_up_to(F.col("_points"), value, inside)
    block = F.col("_range").cast("long") * inside + F.coalesce(found, F.lit(0))
    joined = ranged.join(side, F.col("_range") == F.col("_r"), "left")
    return joined.select(*[col(c) for c in df.columns], "_range", F.when(value.isNull(), F.lit(0)).otherwise(block).alias("_block"))


def _same(keys: Sequence[str], *placed: tuple[str, str]) -> Column:
    """Join condition of a carried table: equal keys (NULL equals NULL) and equal places."""
    equal = [F.col(a) == F.col(b) for a, b in placed] + [col(k).eqNullSafe(F.col(f"_k{j}")) for j, k in enumerate(keys)]
    return reduce(Column.__and__, equal)


def _carried(ends: DataFrame, keys: Sequence[str], last: Sequence[str] = (), total: Sequence[str] = (), first: Sequence[str] = ()) -> DataFrame:
    """What each block of a key gets from the others: (_k*, _kb, and one column named as its source).

    ``last``: the last value before the block, ``total``: the sum of the blocks before, ``first``: the first value of any block.
    ``ends`` has one row per key and block.  Ranges are summed up and scanned, then the blocks inside each range.
    """
    groups = [col(k) for k in keys]
    at = F.col("_block")

    def known(c: str) -> Column:
        return F.when(F.col(c).isNotNull(), at)

    tops = ends.groupBy(*groups, "_range").agg(
        F.count(F.lit(1)).alias("_blocks"),
        *[F.max_by(c, known(c)).alias(c) for c in last],
        *[F.sum(c).alias(c) for c in total],
        *[F.min_by(c, known(c)).alias(c) for c in first],
    )
    whole = Window.partitionBy(*(groups or [F.lit(0)])).orderBy("_range")
    before = whole.rowsBetween(Window.unboundedPreceding, -1)
    anywhere = whole.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    over_ranges = tops.select(
        *[col(k).alias(f"_k{j}") for j, k in enumerate(keys)],
        F.col("_range").alias("_kr"),
        *[F.last(c, ignorenulls=True).over(before).alias(f"_t{c}") for c in last],
        *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"_t{c}") for c in total],
        *[F.first(c, ignorenulls=True).over(anywhere).alias(f"_t{c}") for c in first],
    )
    inside = Window.partitionBy(*groups, "_range").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    scanned = ends.select(
        *groups,
        "_range",
        "_block",
        *[F.last(c, ignorenulls=True).over(inside).alias(f"_i{c}") for c in last],
        *[F.coalesce(F.sum(c).over(inside), F.lit(0)).alias(f"_i{c}") for c in total],
    )
    return scanned.join(over_ranges, _same(keys, ("_range", "_kr"))).select(
        *[F.col(f"_k{j}") for j in range(len(keys))],
        F.col("_block").alias("_kb"),
        *[F.coalesce(f"_i{c}", f"_t{c}").alias(c) for c in last],
        *[(F.col(f"_i{c}") + F.col(f"_t{c}")).alias(c) for c in total],
        *[F.col(f"_t{c}").alias(c) for c in first],
    )


def fill_in_order(
    df: DataFrame, order_by: str, partition_by: Sequence[str] = (), blocks: int | None = None
) -> DataFrame:
    """Replace each NULL by the last value before it, else by the first value after it, in every column.

    Rows of equal order follow a hash of their cells, so the result is the same for any number of blocks; give a unique ``order_by``
    to know which comes first.  Leading NULLs can only take the partition's first value, so backward filling
    needs one aggregate, no second window.  Rows without an order value come first: they take that first value and give none.
    """
    keys = list(partition_by)
    filled = [c for c in df.columns if c not in {order_by, *keys}]
    if not filled:
        return df
    maps = {f.name for f in df.schema if isinstance(f.dataType, T.MapType)}
    cells = [F.array_sort(F.map_entries(col(c))) if c in maps else col(c) for c in filled]
    tied = F.xxhash64(*[part for cell in cells for part in (cell, cell.isNull())])
    work = in_blocks(df, order_by, blocks).withColumn("_tie", tied)
    groups = [col(k) for k in keys]
    place = F.struct(col(order_by), F.col("_tie"))
    so_far = Window.partitionBy(*groups, "_block").orderBy(col(order_by), "_tie").rowsBetween(Window.unboundedPreceding, 0)
    gives = col(order_by).isNotNull()

    def when_known(c: str) -> Column:
        return F.when(gives & col(c).isNotNull(), place)

    ends = work.groupBy(*groups, "_range", "_block").agg(
        *[F.max_by(col(c), when_known(c)).alias(f"_l{i}") for i, c in enumerate(filled)],
        *[F.min_by(col(c), when_known(c)).alias(f"_f{i}") for i, c in enumerate(filled)],
    )
    places = range(len(filled))
    carried = _carried(ends, keys, last=[f"_l{i}" for i in places], first=[f"_f{i}" for i in places])
    local = work.select(
        *[col(c) for c in df.columns],
        "_block",
        *[
            F.when(gives, F.last(col(c), ignorenulls=True).over(so_far)).otherwise(col(c)).alias(f"_s{i}")
            for i, c in enumerate(filled)
        ],
    )
    joined = local.join(carried, _same(keys, ("_block", "_kb")))
    position = {c: i for i, c in enumerate(filled)}
    return joined.select(
        *[
            F.coalesce(*[f"_{p}{position[c]}" for p in "slf"]).alias(c) if c in position else col(c)
            for c in df.columns
        ]
    )


def time_gaps(
    df: DataFrame, ts: str, max_gap_days: float, partition_by: Sequence[str] = (), blocks: int | None = None
) -> DataFrame:
    """Rows whose distance to the previous timestamp exceeds the limit, with that distance in days."""
    keys = list(partition_by)
    work = in_blocks(df.filter(col(ts).isNotNull()), ts, blocks)
    groups = [col(k) for k in keys]
    ends = work.groupBy(*groups, "_range", "_block").agg(F.max(col(ts)).alias("_earlier"))
    inside = Window.partitionBy(*groups, "_block").orderBy(col(ts))
    joined = work.withColumn("_previous", F.lag(col(ts)).over(inside)).join(
        _carried(ends, keys, last=["_earlier"]), _same(keys, ("_block", "_kb"))
    )
    previous = F.coalesce("_previous", "_earlier")
    gap = (F.unix_micros(col(ts).cast("timestamp")) - F.unix_micros(previous.cast("timestamp"))) / 86_400_000_000.0
    return joined.select(*[col(c) for c in df.columns], previous.alias("previous_ts"), gap.alias("gap_days")).filter(
        F.col("gap_days") > max_gap_days
    )


def ordinal_codes(values: DataFrame, column: str, blocks: int | None = None) -> DataFrame:
    """(value, code): codes 0, 1, 2, ... in sorted order for a column of distinct, non-missing values."""
    work = in_blocks(values.select(col(column)), column, blocks)
    sizes = work.groupBy("_range", "_block").agg(F.count(F.lit(1)).alias("_before"))
    inside = Window.partitionBy("_block").orderBy(col(column))
    ranked = work.withColumn("_r", F.row_number().over(inside)).join(
        _carried(sizes, [], total=["_before"]), F.col("_block") == F.col("_kb")
    )
    return ranked.select(col(column).alias("value"), (F.col("_r") - 1 + F.col("_before")).cast("long").alias("code"))


def totals_before(
    df: DataFrame, order_by: str, columns: Sequence[str], partition_by: Sequence[str] = (), blocks: int | None = None
) -> DataFrame:
    """The table with ``<column>_before``: the sum over all rows of smaller order in the same partition, 0 for the first.

    ``order_by`` must be unique within a partition; NULL is the smallest.
    """
    keys = list(partition_by)
    blocks = block_count(df) if blocks is None else blocks
    groups = [col(k) for k in keys]
    sums = {c: F.sum(col(c)) for c in columns}
    if blocks <= 1:
        earlier = Window.partitionBy(*(groups or [F.lit(0)])).orderBy(col(order_by)).rowsBetween(Window.unboundedPreceding, -1)
        return df.select("*", *[F.coalesce(s.over(earlier), F.lit(0)).alias(f"{c}_before") for c, s in sums.items()])
    work = in_blocks(df, order_by, blocks)
    ends = work.groupBy(*groups, "_range", "_block").agg(*[s.alias(f"_e{i}") for i, s in enumerate(sums.values())])
    inside = Window.partitionBy(*groups, "_block").orderBy(col(order_by)).rowsBetween(Window.unboundedPreceding, -1)
    local = work.select("*", *[F.coalesce(s.over(inside), F.lit(0)).alias(f"_s{i}") for i, s in enumerate(sums.values())])
    joined = local.join(_carried(ends, keys, total=[f"_e{i}" for i in range(len(sums))]), _same(keys, ("_block", "_kb")))
    before = [(F.col(f"_s{i}") + F.col(f"_e{i}")).alias(f"{c}_before") for i, c in enumerate(columns)]
    return joined.select(*[col(c) for c in df.columns], *before)
