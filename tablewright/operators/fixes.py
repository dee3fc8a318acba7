"""Repairs: missing values, duplicates, outliers, imbalance, scaling, and their ordered application.

A repair that needs statistics fits them first (one aggregated row reaches the driver) and applies them as
literals.  The applied plan is then a plain projection or filter: no join, fully compiled, and range filters reach the scan.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.functions.columns import col, groupable, numeric_columns, resolve_target
from tablewright.functions.lineage import cut
from tablewright.operators.profile import class_counts, fence_literals, iqr_bounds
from tablewright.operators.quantiles import quantiles
from tablewright.operators.ranking import bucket_digits, flag_quota
from tablewright.operators.sequence import fill_in_order

DEFAULT_FIXES = {"missing_values": "drop", "duplicates": True}
REBALANCE_GATE = 10
COPIES_PER_TASK_ROW = 10_000


# ---- missing values -----------------------------------------------------------------------------------------------


def drop_missing(df: DataFrame, subset: Sequence[str] | None = None) -> DataFrame:
    return df.na.drop("any", subset=None if subset is None else list(subset))


def fill_mean(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    names = numeric_columns(df) if columns is None else list(columns)
    return fill_values(df, column_means(df, names)) if names else df


def column_means(df: DataFrame, columns: Sequence[str]) -> dict[str, float | None]:
    """The mean of each column, all in one scan; None for a column without values."""
    if not columns:
        return {}
    means = df.agg(*[F.avg(col(c)).alias(f"m{i}") for i, c in enumerate(columns)]).first()
    return {c: means[f"m{i}"] for i, c in enumerate(columns)}


def fill_median(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    names = numeric_columns(df) if columns is None else list(columns)
    return fill_values(df, {c: q[0] for c, q in quantiles(df, names, (0.5,)).items()})


def fill_values(df: DataFrame, values: dict[str, float | None]) -> DataFrame:
    """Filled columns become doubles, as a mean of integers is no integer."""
    return df.select(
        *[
            F.coalesce(col(c).cast("double"), F.lit(values[c]).cast("double")).alias(c) if c in values else col(c)
            for c in df.columns
        ]
    )


def fix_missing(
    df: DataFrame, strategy: str = "drop", order_by: str | None = None, partition_by: Sequence[str] = ()
) -> DataFrame:
    if strategy == "drop":
        return drop_missing(df)
    if strategy == "mean":
        return fill_mean(df)
    if strategy == "median":
        return fill_median(df)
    if strategy == "forward_fill":
        if order_by is None:
            raise ValueError("forward_fill needs order_by: rows of a DataFrame have no order")
        return fill_in_order(df, order_by, partition_by)
    raise ValueError(f"unknown strategy {strategy!r}")


# ---- duplicates ---------------------------------------------------------------------------------------------------


def remove_duplicates(df: DataFrame, keep: str | bool = "first") -> DataFrame:
    """Keep one of each group of equal rows (first and last are the same row), or none when ``keep=False``."""
    maps = {f.name for f in df.schema if isinstance(f.dataType, T.MapType)}
    if keep in ("first", "last"):
        if not maps:
            return df.distinct()
    elif keep is not False:
        raise ValueError(f"unknown keep {keep!r}")
    single = df.select(*groupable(df)).groupBy(*[col(c) for c in df.columns]).agg(F.count(F.lit(1)).alias("_n"))
    if keep is False:
        single = single.filter("_n = 1")
    return single.select(*[F.map_from_entries(col(c)).alias(c) if c in maps else col(c) for c in df.columns])


# ---- outliers -----------------------------------------------------------------------------------------------------


def iqr_predicates(df: DataFrame, k: float = 3.0, exclude: Iterable[str] = ()) -> dict[str, Column]:
    """Per numeric column: true inside the fences; NULL (and a column without values) does not pass."""
    names = numeric_columns(df, exclude)
    fences = iqr_bounds(df, names, k)
    passes = {}
    for c in names:
        if c not in fences:
            passes[c] = F.lit(False)
            continue
        low, high = fence_literals(df, c, fences[c])
        passes[c] = (col(c) >= low) & (col(c) <= high)
    return passes


def zscore_predicates(df: DataFrame, threshold: float = 3.0, exclude: Iterable[str] = ()) -> dict[str, Column]:
    """Per numeric column: |z| below the threshold, with NULL counted as the mean.

    The deviation is that of the mean-filled column: squares over the present rows divided by all rows.  A
    constant column cannot hold an outlier and passes every row.
    """
    names = numeric_columns(df, exclude)
    if not names:
        return {}
    row = df.agg(
        F.count(F.lit(1)).alias("rows"),
        *[F.count(col(c)).alias(f"n{i}") for i, c in enumerate(names)],
        *[F.avg(col(c)).alias(f"m{i}") for i, c in enumerate(names)],
        *[F.var_pop(col(c).cast("double")).alias(f"v{i}") for i, c in enumerate(names)],
    ).first()
    passes = {}
    for i, c in enumerate(names):
        variance = (row[f"v{i}"] or 0.0) * row[f"n{i}"] / row["rows"] if row["rows"] else 0.0
        if variance <= 0:
            passes[c] = F.lit(True)
            continue
        mean, deviation = float(row[f"m{i}"]), variance**0.5
        z = (F.coalesce(col(c).cast("double"), F.lit(mean)) - mean) / deviation
        passes[c] = F.abs(z) < threshold
    return passes


def _all(conditions: Iterable[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def remove_outliers(
    df: DataFrame, method: str = "iqr", threshold: float = 3.0, exclude: Iterable[str] = ()
) -> DataFrame:
    """Keep the rows every numeric column of which passes; all bounds come from the input table."""
    if method == "iqr":
        return df.filter(_all(iqr_predicates(df, threshold, exclude).values()))
    if method == "zscore":
        return df.filter(_all(zscore_predicates(df, threshold, exclude).values()))
    raise ValueError(f"unsupported outlier method {method!r}")


def flag_outliers(
    df: DataFrame, method: str = "iqr", threshold: float = 3.0, exclude: Iterable[str] = (), flag: str = "is_outlier"
) -> DataFrame:
    """Mark instead of remove."""
    if method not in ("iqr", "zscore"):
        raise ValueError(f"unsupported outlier method {method!r}")
    find = iqr_predicates if method == "iqr" else zscore_predicates
    return df.withColumn(flag, ~F.coalesce(_all(find(df, threshold, exclude).values()), F.lit(False)))


# ---- imbalance ----------------------------------------------------------------------------------------------------


def _class_extent(df: DataFrame, target: str):
    return class_counts(df, target).agg(
        F.count(F.lit(1)).alias("classes"), F.max("n").alias("largest"), F.min("n").alias("smallest")
    ).first()


def _gate_open(extent, gate: float) -> bool:
    return bool(extent["classes"]) and extent["largest"] > gate * extent["smallest"]


def undersample(
    df: DataFrame,
    target: str,
    keys: Sequence[str],
    seed: int = 42,
    gate: float = REBALANCE_GATE,
    factor: int = 3,
) -> DataFrame:
    """Cap every class at ``factor`` times the smallest, once the ratio exceeds the gate; rows without class go."""
    extent = _class_extent(df, target)
    if not _gate_open(extent, gate):
        return df
    cap = min(factor * extent["smallest"], extent["largest"])
    quotas = class_counts(df, target).select(F.col("class").alias(target), F.lit(cap).cast("long").alias("quota"))
    marked = flag_quota(
        df.filter(col(target).isNotNull()),
        quotas,
        [target],
        keys,
        seed,
        bucket_digits(extent["largest"]),
        extent["classes"],
        flag="_kept",
    )
    return marked.filter("_kept").drop("_kept")


def oversample(
    df: DataFrame,
    target: str,
    keys: Sequence[str],
    seed: int = 42,
    gate: float = REBALANCE_GATE,
    share: float = 0.5,
) -> DataFrame:
    """Raise every class below ``share`` of the largest to exactly that many rows, once the ratio exceeds the gate.

    Whole copies of the class plus, for the remainder, its first rows in hash order: every original stays.
    """
    extent = _class_extent(df, target)
    if not _gate_open(extent, gate):
        return df
    goal = int(extent["largest"] * share)
    counts = class_counts(df, target).select(
        F.col("class").alias(target),
        F.when(F.col("n") < extent["largest"] * share, F.floor(F.lit(goal) / F.col("n"))).otherwise(1).alias("copies"),
        F.when(F.col("n") < extent["largest"] * share, F.lit(goal) % F.col("n")).otherwise(0).alias("quota"),
    )
    marked = flag_quota(
        df.filter(col(target).isNotNull()),
        counts.select(col(target), "quota"),
        [target],
        keys,
        seed,
        bucket_digits(extent["largest"]),
        extent["classes"],
        flag="_extra",
    )
    copies = counts.select(col(target).alias("_class"), "copies")
    if extent["classes"] <= 100_000:
        copies = F.broadcast(copies)
    whole = marked.join(copies, col(target) == F.col("_class")).withColumn(
        "_times", F.col("copies") + F.col("_extra").cast("int")
    )
    return _replicate(whole, extent["largest"] // extent["smallest"]).select(*[col(c) for c in df.columns])


def _replicate(df: DataFrame, most: int) -> DataFrame:
    """Repeat each row ``_times`` times; very many copies of one row are first spread over tasks in blocks."""
    if most <= COPIES_PER_TASK_ROW:
        return df.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_times").cast("int"))))
    blocks = F.ceil(F.col("_times") / COPIES_PER_TASK_ROW).cast("int")
    spread = df.withColumn("_part", F.explode(F.sequence(F.lit(1), blocks)))
    rest = F.least(F.lit(COPIES_PER_TASK_ROW), F.col("_times") - (F.col("_part") - 1) * COPIES_PER_TASK_ROW)
    return spread.repartition(F.xxhash64(*[col(c) for c in spread.columns])).withColumn(
        "_copy", F.explode(F.sequence(F.lit(1), rest.cast("int")))
    )


def rebalance(df: DataFrame, target: str | None, keys: Sequence[str], method: str = "undersample", seed: int = 42) -> DataFrame:
    name = resolve_target(df, target)
    if method == "undersample":
        return undersample(df, name, keys, seed)
    if method == "oversample":
        return oversample(df, name, keys, seed)
    raise ValueError(f"unknown method {method!r}")


# ---- scaling ------------------------------------------------------------------------------------------------------


def scale_features(df: DataFrame, target: str | None = None, columns: Sequence[str] | None = None) -> DataFrame:
    """Standardise numeric features with the population deviation; NULL stays NULL, a constant becomes 0."""
    name = resolve_target(df, target)
    names = [c for c in (numeric_columns(df) if columns is None else columns) if c != name]
    if not names:
        return df
    row = df.agg(
        *[F.avg(col(c)).cast("double").alias(f"m{i}") for i, c in enumerate(names)],
        *[F.stddev_pop(col(c).cast("double")).alias(f"s{i}") for i, c in enumerate(names)],
    ).first()
    place = {c: i for i, c in enumerate(names)}

    def scaled(c: str) -> Column:
        mean, deviation = row[f"m{place[c]}"], row[f"s{place[c]}"]
        if mean is None:
            return col(c).cast("double").alias(c)
        return ((col(c).cast("double") - F.lit(mean)) / F.lit(deviation or 1.0)).alias(c)

    return df.select(*[scaled(c) if c in place else col(c) for c in df.columns])


# ---- ordered application ------------------------------------------------------------------------------------------


def fix_stages(
    df: DataFrame,
    config: dict | None = None,
    target: str | None = None,
    keys: Sequence[str] | None = None,
    order_by: str | None = None,
) -> list[tuple[str, str, DataFrame]]:
    """The table after each enabled repair: missing, duplicates, outliers, imbalance, scaling, in this order.

    When statistics are still to be fitted after duplicate removal, the shuffled result is cut into the shared checkpoint folder
    once instead of being recomputed for every fit.
    """
    config = DEFAULT_FIXES if config is None else config
    name = resolve_target(df, target)
    keys = list(df.columns if keys is None else keys)
    stages: list[tuple[str, str, DataFrame]] = []
    if config.get("missing_values"):
        strategy = config["missing_values"]
        df = fix_missing(df, strategy, order_by=order_by)
        stages.append(("missing_values", strategy, df))
    fits_follow = any(config.get(step) for step in ("outliers", "imbalance", "scale"))
    if config.get("duplicates"):
        df = remove_duplicates(df)
        if fits_follow:
            df = cut(df)
        stages.append(("duplicates", "first", df))
    if config.get("outliers"):
        df = remove_outliers(df)
        stages.append(("outliers", "iqr", df))
    if config.get("imbalance"):
        df = undersample(df, name, keys)
        stages.append(("imbalance", "undersample", df))
    if config.get("scale"):
        df = scale_features(df, name)
        stages.append(("scaling", "standard", df))
    return stages


def apply_fixes(
    df: DataFrame,
    config: dict | None = None,
    target: str | None = None,
    keys: Sequence[str] | None = None,
    order_by: str | None = None,
) -> DataFrame:
    stages = fix_stages(df, config, target, keys, order_by)
    return stages[-1][2] if stages else df


def fix_summary(
    df: DataFrame,
    config: dict | None = None,
    target: str | None = None,
    keys: Sequence[str] | None = None,
    order_by: str | None = None,
) -> DataFrame:
    """Per repair: strategy, rows before and rows after, all counted in one job."""
    stages = fix_stages(df, config, target, keys, order_by)
    counted = [df, *[stage for _, _, stage in stages]]
    sizes = {
        r["i"]: r["n"]
        for r in reduce(
            DataFrame.union,
            [d.agg(F.count(F.lit(1)).alias("n")).select(F.lit(i).alias("i"), "n") for i, d in enumerate(counted)],
        ).collect()
    }
    rows = [(i + 1, step, strategy, sizes[i], sizes[i + 1]) for i, (step, strategy, _) in enumerate(stages)]
    return df.sparkSession.createDataFrame(
        rows, "position int, step string, strategy string, rows_before bigint, rows_after bigint"
    ).withColumn("rows_removed", F.col("rows_before") - F.col("rows_after"))
