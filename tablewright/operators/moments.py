"""Pairwise-complete moments of all pairs of columns from one scan, over a whole table or every segment of it.

Columns are cut into blocks of a few. Each row is handed once to every pair of blocks, and an aggregation by block pair
holds the sums of the pairs between them: its code has one size whatever the width of the table, and partial sums
combine before the shuffle, which carries one small row per task and block pair. Values are taken relative to a number near
the middle of their column, so large offsets do not drown the spread.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.functions.columns import col

#: Columns of a block; nine pairs an aggregation stay within what the JIT compiles.
BLOCK = 3


#: The same where only products are summed.
WIDE_BLOCK = 8


def column_moments(df: DataFrame, columns: Sequence[str]) -> dict[str, tuple[int, int, float, float]]:
    """Rows, values, mean and population variance of each column from one scan; 0 for a column without values."""
    x = [col(c).cast("double") for c in columns]
    found = df.agg(
        F.count(F.lit(1)).alias("rows"), *[a.alias(f"{k}{i}") for i, c in enumerate(x) for k, a in (("n", F.count(c)), ("m", F.avg(c)), ("v", F.var_pop(c)))]
    ).first()
    return {c: (found["rows"], found[f"n{i}"], found[f"m{i}"] or 0.0, found[f"v{i}"] or 0.0) for i, c in enumerate(columns)}


def all_pair_moments(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``pair_moments`` of a whole table: between complete columns only products are left to sum."""
    moments = column_moments(df, columns)
    gaps = [c for c in columns if moments[c][0] > moments[c][1]]
    whole = [c for c in columns if c not in gaps]
    middles = {c: m for c, (_, _, m, _) in moments.items()}
    parts = []
    if len(whole) > 1:
        parts.append(_products(df, whole, moments))
    if gaps:
        parts.append(pair_moments(df, [*gaps, *whole], middles, sides=len(gaps)))
    place = F.create_map(*[F.lit(v) for i, c in enumerate(columns) for v in (c, i)])
    found = reduce(DataFrame.union, parts)
    ordered = place[F.col("feature1")] < place[F.col("feature2")]
    swap = lambda a, b: F.when(ordered, F.col(a)).otherwise(F.col(b))
    return found.select(
        swap("feature1", "feature2").alias("feature1"), swap("feature2", "feature1").alias("feature2"), "n", "covariance",
        swap("variance1", "variance2").alias("variance1"), swap("variance2", "variance1").alias("variance2"),
    )


def _block_rows(df: DataFrame, names: Sequence[str], middles: Mapping[str, float], groups: Sequence[str], width: int, sides: int) -> DataFrame:
    """Each row once for every pair of blocks: the values of the first as _x0, _x1, ..., those of the second as _y0, ..."""
    last = (len(names) - 1) // width
    values = F.array(*[col(c).cast("double") - F.lit(float(middles.get(c, 0.0))) for c in names])
    pairs = [(p, q) for p in range((sides - 1) // width + 1) for q in range(p, last + 1)]
    blocks = F.array(*[F.struct(F.lit(p).alias("p"), F.lit(q).alias("q")) for p, q in pairs])
    rows = df.select(*[col(g) for g in groups], values.alias("_v"), F.explode(blocks).alias("_b"))
    side = lambda block, name: [F.get("_v", F.col(f"_b.{block}") * width + i).alias(f"{name}{i}") for i in range(width)]
    return rows.select(*[col(g) for g in groups], F.col("_b.p").alias("_p"), F.col("_b.q").alias("_q"), *side("p", "_x"), *side("q", "_y"))


def product_sums(df: DataFrame, names: Sequence[str], middles: Mapping[str, float], groups: Sequence[str] = ()) -> DataFrame:
    """(groups..., i, j, xy): the sum of products of every two columns i <= j, by their places, relative to the middles.

    For columns without gaps: a product with NULL is left out of its sum.
    """
    width = min(WIDE_BLOCK, len(names))
    rows = _block_rows(df, names, middles, groups, width, len(names))
    cells = [(i, j) for i in range(width) for j in range(width)]
    sums = [F.sum(F.col(f"_x{i}") * F.col(f"_y{j}")).alias(f"xy_{i}_{j}") for i, j in cells]
    place = [F.struct((F.col("_p") * width + i).alias("i"), (F.col("_q") * width + j).alias("j"), F.col(f"xy_{i}_{j}").alias("xy")) for i, j in cells]
    found = rows.groupBy(*[col(g) for g in groups], "_p", "_q").agg(*sums).select(*[col(g) for g in groups], F.inline(F.array(*place)))
    return found.where((F.col("i") <= F.col("j")) & (F.col("j") < len(names)))


def _products(df: DataFrame, names: Sequence[str], moments: Mapping[str, tuple[int, int, float, float]]) -> DataFrame:
    found = product_sums(df, names, {c: moments[c][2] for c in names}).where("i < j")
    listed = lambda values, at: F.get(F.array(*[F.lit(v) for v in values]), F.col(at))
    rows_all, spread = moments[names[0]][0], [moments[c][3] for c in names]
    return found.select(
        listed(names, "i").alias("feature1"), listed(names, "j").alias("feature2"), F.lit(rows_all).cast("long").alias("n"),
        (F.col("xy") / float(max(rows_all, 1))).alias("covariance"), listed(spread, "i").alias("variance1"), listed(spread, "j").alias("variance2"),
    )


def pair_moments(
    df: DataFrame, columns: Sequence[str], middles: Mapping[str, float], groups: Sequence[str] = (), sides: int | None = None
) -> DataFrame:
    """One row per group and pair of columns, over the rows where both have a value.

    Columns: the groups, feature1, feature2, n, covariance, variance1, variance2 (population moments; 0 for a constant side).
    With ``sides`` only pairs that hold one of the first so many columns are given.
    """
    names = list(columns)
    sides = len(names) if sides is None else sides
    if 1 < len(names) <= BLOCK:
        return _few_moments(df, names, middles, groups, sides)
    rows = _block_rows(df, names, middles, groups, BLOCK, sides)
    sums = [s for i in range(BLOCK) for j in range(BLOCK) for s in _sums(i, j)]
    cells = [
        F.struct((F.col("_p") * BLOCK + i).alias("i"), (F.col("_q") * BLOCK + j).alias("j"), *_moments(f"_{i}{j}"))
        for i in range(BLOCK) for j in range(BLOCK)
    ]
    found = rows.groupBy(*groups, "_p", "_q").agg(*sums).select(*[col(g) for g in groups], F.inline(F.array(*cells)))
    feature = F.array(*[F.lit(c) for c in names])
    return found.where((F.col("i") < F.col("j")) & (F.col("i") < sides) & (F.col("j") < len(names))).select(
        *[col(g) for g in groups], F.get(feature, F.col("i")).alias("feature1"), F.get(feature, F.col("j")).alias("feature2"),
        "n", "covariance", "variance1", "variance2",
    )


def _few_moments(df: DataFrame, names: Sequence[str], middles: Mapping[str, float], groups: Sequence[str], sides: int) -> DataFrame:
    """The same for the columns of one block: only the sums of its pairs are kept for a group, and no row is handed out again."""
    pairs = [(i, j) for j in range(len(names)) for i in range(min(j, sides))]
    values = [col(c).cast("double") - F.lit(float(middles.get(c, 0.0))) for c in names]
    rows = df.select(*[col(g) for g in groups], *[v.alias(f"_{side}{i}") for i, v in enumerate(values) for side in "xy"])
    cells = [F.struct(F.lit(names[i]).alias("feature1"), F.lit(names[j]).alias("feature2"), *_moments(f"_{i}{j}")) for i, j in pairs]
    sums = [F.count(F.lit(1)).alias("_rows"), *[s for i, j in pairs for s in _sums(i, j)]]
    found = rows.groupBy(*[col(g) for g in groups]).agg(*sums).where("_rows > 0")
    return found.select(*[col(g) for g in groups], F.inline(F.array(*cells)))


def _sums(i: int, j: int) -> list[Column]:
    x, y, tag = F.col(f"_x{i}"), F.col(f"_y{j}"), f"_{i}{j}"
    both_x, both_y = F.when(y.isNotNull(), x), F.when(x.isNotNull(), y)
    return [
        F.count(x * y).alias(f"n{tag}"), F.sum(x * y).alias(f"xy{tag}"),
        *[
            a for s, v in (("x", both_x), ("y", both_y))
            for a in (F.sum(v).alias(f"{s}{tag}"), F.sum(v * v).alias(f"{s}{s}{tag}"), F.min(v).alias(f"low_{s}{tag}"), F.max(v).alias(f"top_{s}{tag}"))
        ],
    ]


def _moments(tag: str) -> list[Column]:
    c = lambda name: F.col(name + tag)
    n = c("n")

    def spread(s: str) -> Column:
        """Sums leave rounding noise where all values are one, so that case is told by the ends."""
        value = F.greatest(F.try_divide(c(s + s), n) - F.pow(F.try_divide(c(s), n), F.lit(2.0)), F.lit(0.0))
        return F.when(n > 0, F.when(c(f"low_{s}") == c(f"top_{s}"), 0.0).otherwise(value))

    covariance = F.try_divide(c("xy"), n) - F.try_divide(c("x"), n) * F.try_divide(c("y"), n)
    return [n.alias("n"), covariance.alias("covariance"), spread("x").alias("variance1"), spread("y").alias("variance2")]
