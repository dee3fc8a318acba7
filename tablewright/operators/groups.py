"""Folds and splits that keep groups of rows together, balanced in every class.

Copies of a row in the train and in the test part make a model look better than it is. Here whole groups (equal rows, or
rows that agree in named columns) are dealt to folds: by falling size, back and forth over the folds, so that two folds
differ by at most the largest group in every class.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.functions.columns import col, groupable
from tablewright.functions.lineage import cut
from tablewright.operators.sequence import totals_before

# Groups of at least this share of all rows have their fold sent to every executor; there are at most a thousand of them.
LARGE_SHARE = 0.001


def group_key(df: DataFrame, columns: Sequence[str], seed: int = 42) -> Column:
    """md5 over the values and NULL flags of the columns; rows without a value agree with each other."""
    keys = groupable(df, columns)
    parts = [F.concat(k.isNull().cast("string"), F.lit(":"), F.coalesce(F.to_json(F.struct(k.alias("v"))), F.lit(""))) for k in keys]
    return F.md5(F.concat_ws("|", *parts, F.lit(str(seed))))


def deal_groups(groups: DataFrame, by: str, k: int, blocks: int | None = None) -> DataFrame:
    """(group, fold) of a table (group, class, rows): groups of a class by falling size, back and forth over the folds."""
    size = F.lpad((F.lit(10**15) - F.col("rows")).cast("string"), 16, "0")
    placed = groups.select("group", col(by), F.concat(size, "group").alias("_order"), F.lit(1).cast("long").alias("_one"))
    place = totals_before(placed, "_order", ["_one"], [by], blocks)
    turn, step = F.floor(F.col("_one_before") / k), F.col("_one_before") % k
    return place.select("group", F.when(turn % 2 == 0, step).otherwise(k - 1 - step).cast("int").alias("fold"))


def grouped_folds(
    df: DataFrame, target: str, k: int, group_by: Sequence[str] | None = None, seed: int = 42, blocks: int | None = None
) -> DataFrame:
    """A ``fold`` in 0..k-1 per row: all rows of a group have the same, and in every class two folds differ by at most the
    largest group of that class.

    ``group_by`` names the columns that make a group; without it equal rows are one. A group with rows of several classes is
    dealt as one of its most frequent class (the least of equally frequent ones), with all its rows.
    """
    names = list(df.columns if group_by is None else group_by)
    keyed = df.withColumn("_group", group_key(df, names, seed))
    cells = keyed.groupBy(F.col("_group").alias("group"), col(target).alias("class")).agg(F.count(F.lit(1)).alias("n"))
    most = F.min(F.struct(-F.col("n"), F.col("class")))["class"]
    groups = cut(cells.groupBy("group").agg(most.alias("class"), F.sum("n").alias("rows")))
    folds = deal_groups(groups, "class", k, blocks).select(F.col("group").alias("_g"), "fold")
    total = groups.agg(F.sum("rows")).first()[0] or 0
    large = groups.filter(F.col("rows") >= max(2.0, LARGE_SHARE * total)).select(F.col("group").alias("_lg"))
    # Rows of a large group find their fold without a shuffle, and do not meet in one task of the join of the others.
    first = F.broadcast(folds.join(F.broadcast(large), F.col("_g") == F.col("_lg")).select("_lg", F.col("fold").alias("_large")))
    marked = keyed.join(first, F.col("_group") == F.col("_lg"), "left")
    spread = F.concat(F.lit("large "), F.spark_partition_id())
    other = marked.withColumn("_key", F.when(F.col("_large").isNull(), F.col("_group")).otherwise(spread))
    joined = other.join(folds, F.col("_key") == F.col("_g"), "left")
    return joined.select(*[col(c) for c in df.columns], F.coalesce("_large", "fold").alias("fold"))


def grouped_split(
    df: DataFrame, target: str, test_share: float = 0.2, group_by: Sequence[str] | None = None, seed: int = 42
) -> DataFrame:
    """Add ``is_test``: the groups of one of round(1 / test_share) folds."""
    folds = max(2, round(1 / test_share))
    return grouped_folds(df, target, folds, group_by, seed).withColumn("is_test", F.col("fold") == 0).drop("fold")
