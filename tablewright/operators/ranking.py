"""Exact, reproducible sampling and ranking by hash order, without ever sorting a whole group in one task.

Rows are ordered by the md5 of their key.  The first hex digits of that hash cut every group into equal, ordered buckets.
Counting the buckets tells which of them lie wholly inside a quota; only the one bucket that the quota
cuts through is ranked.  A class with a third of all rows is therefore never gathered in one place, and the rows
chosen are exactly the first ``quota`` rows of the global hash order.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tablewright.functions.columns import broadcast_if, col, hash_key

ROWS_PER_BUCKET = 2_000_000
MAX_DIGITS = 5
TOP_N_LIMIT = 10_000
# Sorts after every hex digit: the cut of a group whose quota exceeds its rows.
BEYOND = "~"


def bucket_digits(largest_group: int) -> int:
    """Hex digits needed so that no bucket of the largest group holds many more than ROWS_PER_BUCKET rows."""
    if largest_group <= ROWS_PER_BUCKET:
        return 0
    return min(MAX_DIGITS, math.ceil(math.log(largest_group / ROWS_PER_BUCKET, 16)))


def flag_quota(
    df: DataFrame,
    quotas: DataFrame,
    by: Sequence[str],
    keys: Sequence[str],
    seed: int,
    digits: int,
    groups: int,
    flag: str = "selected",
) -> DataFrame:
    """Mark the first ``quota`` rows of every group in hash order.

    ``quotas`` has the ``by`` columns and a ``quota``, one row per group; ``groups`` is its counted size.  Rows of groups without
    a quota are dropped.  ``keys`` must identify a row.
    """
    hashed = df.withColumn("_h", hash_key(keys, seed))
    wanted = quotas.select(*[col(b).alias(f"_g{i}") for i, b in enumerate(by)], F.col("quota").alias("_quota"))
    if digits == 0:
        ranked = _attach(hashed, wanted, by, groups)
        order = Window.partitionBy(*[col(b) for b in by]).orderBy("_h", *[col(k) for k in keys])
        marked = ranked.withColumn(flag, F.row_number().over(order) <= F.col("_quota"))
        return marked.select(*[col(c) for c in df.columns], flag)

    hashed = hashed.withColumn("_b", F.substring("_h", 1, digits))
    per_bucket = hashed.groupBy(*[col(b) for b in by], "_b").agg(F.count(F.lit(1)).alias("_n"))
    upto = Window.partitionBy(*[col(b) for b in by]).orderBy("_b").rowsBetween(Window.unboundedPreceding, 0)
    running = _attach(per_bucket, wanted, by, groups).withColumn("_upto", F.sum("_n").over(upto))
    cut = F.min(F.when(F.col("_upto") >= F.col("_quota"), F.struct("_b", (F.col("_upto") - F.col("_n")).alias("before"))))
    cuts = (
        running.groupBy(*[col(b) for b in by], "_quota")
        .agg(cut.alias("_at"))
        .select(
            *[col(b).alias(f"_g{i}") for i, b in enumerate(by)],
            F.coalesce(F.col("_at._b"), F.lit(BEYOND)).alias("_cut"),
            (F.col("_quota") - F.coalesce(F.col("_at.before"), F.lit(0))).alias("_room"),
        )
    )
    placed = _attach(hashed, cuts, by, groups)
    settled = placed.filter(F.col("_b") != F.col("_cut")).withColumn(flag, F.col("_b") < F.col("_cut"))
    order = Window.partitionBy(*[col(b) for b in by]).orderBy("_h", *[col(k) for k in keys])
    tight = placed.filter(F.col("_b") == F.col("_cut")).withColumn(flag, F.row_number().over(order) <= F.col("_room"))
    return settled.select(*[col(c) for c in df.columns], flag).unionByName(
        tight.select(*[col(c) for c in df.columns], flag)
    )


def _attach(df: DataFrame, small: DataFrame, by: Sequence[str], groups: int) -> DataFrame:
    """Join the one-row-per-group table; it is broadcast only when its counted size allows."""
    if not by:
        # One row only: its values travel as literals.
        row = small.first()
        for name in small.columns:
            df = df.withColumn(name, F.lit(row[name]))
        return df
    matches = [col(b).eqNullSafe(F.col(f"_g{i}")) for i, b in enumerate(by)]
    condition = matches[0]
    for m in matches[1:]:
        condition = condition & m
    return df.join(broadcast_if(small, groups), condition).drop(*[f"_g{i}" for i in range(len(by))])


def sample_exact(df: DataFrame, n: int, keys: Sequence[str], seed: int = 42, rows: int | None = None) -> DataFrame:
    """Exactly min(n, rows) rows, the first in hash order.

    A small n is a top-n that every task trims before anything moves; a large one goes by bucket quota, so that the sample itself
    is never gathered in one task.
    """
    if n <= TOP_N_LIMIT:
        hashed = df.withColumn("_h", hash_key(keys, seed))
        return hashed.orderBy("_h", *[col(k) for k in keys]).limit(n).drop("_h")
    total = df.count() if rows is None else rows
    quota = df.sparkSession.range(1).select(F.lit(n).cast("long").alias("quota"))
    return flag_quota(df, quota, [], keys, seed, bucket_digits(total), 1).filter("selected").drop("selected")


def hash_rank(
    df: DataFrame, by: Sequence[str], keys: Sequence[str], seed: int, digits: int, name: str = "rank"
) -> DataFrame:
    """1-based position of every row within its group in hash order, ranked bucket by bucket plus an offset."""
    hashed = df.withColumn("_h", hash_key(keys, seed)).withColumn("_b", F.substring("_h", 1, digits))
    within = Window.partitionBy(*[col(b) for b in by], "_b").orderBy("_h", *[col(k) for k in keys])
    if digits == 0:
        return hashed.withColumn(name, F.row_number().over(within)).drop("_h", "_b")
    earlier = (
        Window.partitionBy(*[col(b) for b in by]).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    )
    offsets = (
        hashed.groupBy(*[col(b) for b in by], "_b")
        .agg(F.count(F.lit(1)).alias("_n"))
        .select(
            *[col(b).alias(f"_g{i}") for i, b in enumerate(by)],
            F.col("_b").alias("_gb"),
            F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"),
        )
    )
    condition = F.col("_b") == F.col("_gb")
    for i, b in enumerate(by):
        condition = condition & col(b).eqNullSafe(F.col(f"_g{i}"))
    ranked = hashed.withColumn("_r", F.row_number().over(within)).join(offsets, condition)
    return ranked.select(*[col(c) for c in df.columns], (F.col("_r") + F.col("_before")).cast("int").alias(name))


def stratified_folds(
    df: DataFrame, label: str, k: int, keys: Sequence[str], seed: int = 42, largest_class: int = 0, exact: bool = True
) -> DataFrame:
    """A ``fold`` in 0..k-1 per row; exact folds of one class differ by at most one row.

    ``exact=False`` assigns by hash alone: no shuffle, fold sizes equal only on average.
    """
    if not exact:
        return df.withColumn("fold", F.pmod(F.conv(F.substring(hash_key(keys, seed), 1, 8), 16, 10).cast("long"), F.lit(k)).cast("int"))
    ranked = hash_rank(df, [label], keys, seed, bucket_digits(largest_class), "_rank")
    return ranked.withColumn("fold", ((F.col("_rank") - 1) % k).cast("int")).drop("_rank")


def stratified_split(
    df: DataFrame, target: str, keys: Sequence[str], test_share: float = 0.2, seed: int = 42
) -> DataFrame:
    """Add ``is_test``: round(test_share * rows) rows of every class, chosen in hash order."""
    counts = df.groupBy(col(target)).agg(F.count(F.lit(1)).alias("_n"))
    size = counts.agg(F.count(F.lit(1)).alias("groups"), F.max("_n").alias("largest")).first()
    quotas = counts.select(col(target), F.round(F.col("_n") * test_share).cast("long").alias("quota"))
    return flag_quota(
        df, quotas, [target], keys, seed, bucket_digits(size["largest"] or 0), size["groups"], flag="is_test"
    )
