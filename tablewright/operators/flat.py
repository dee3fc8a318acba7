"""The flat 11-number quality profile, of a whole table or of every segment of it at once.

The detectors' report is long; rules and the gain model consume one flat row per table.  The same aggregations grouped by a
segment column give a table of profiles, so thousands of segments are judged in one job.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.functions import scoring
from tablewright.functions.columns import col, numeric_columns, percent, read_number, resolve_target, string_columns
from tablewright.operators.moments import pair_moments
from tablewright.operators.profile import (
    HIGH_CORRELATION,
    iqr_bounds,
    is_class_like,
    outside,
    pearson,
)
from tablewright.operators.repeats import count_repeats

FLAT_COLUMNS = (
    "missing_values",
    "duplicates",
    "outliers",
    "imbalance_ratio",
    "high_correlation_pct",
    "type_inconsistencies",
    "quality_score",
    "dataset_size",
    "n_features",
    "categorical_pct",
    "numeric_pct",
)


def flat_profile(df: DataFrame, target: str | None = None) -> DataFrame:
    """One row with the eleven numbers, all doubles."""
    return _profiles(df, None, resolve_target(df, target)).select(*FLAT_COLUMNS)


def segment_profiles(df: DataFrame, by: str, target: str | None = None) -> DataFrame:
    """One flat profile per value of ``by``.  Outliers are measured against the fences of the whole table."""
    return _profiles(df, by, resolve_target(df, target)).select(F.col("_segment").alias(by), *FLAT_COLUMNS)


def _profiles(df: DataFrame, by: str | None, target: str) -> DataFrame:
    body = df if by is None else df.drop(by)
    numeric, strings, width = numeric_columns(body), string_columns(body), len(body.columns)
    fences = iqr_bounds(df, numeric, 1.5)
    keyed = df.withColumn("_segment", F.lit(0) if by is None else col(by))
    groups = [] if by is None else ["_segment"]

    parts = [_cells(keyed, groups, body.columns, strings, fences), _repeats(keyed.select(*groups, *[col(c) for c in body.columns]), groups)]
    if is_class_like(df, target):
        parts.append(_ratios(keyed, groups, target))
    pairs = len(numeric) * (len(numeric) - 1) // 2
    if pairs:
        middles = {c: (low + high) / 2 for c, (low, high) in fences.items() if math.isfinite(low + high)}
        parts.append(_flagged(keyed, groups, numeric, middles))
    # Each part holds different columns of the same few rows; stacking and taking the sum avoids one join per part.
    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    names = [c for c in stacked.columns if c != "_segment"]
    merged = stacked.groupBy(*groups).agg(*[F.sum(c).alias(c) for c in names])

    def present(name: str, default: float) -> Column:
        return F.coalesce(F.col(name), F.lit(default)) if name in names else F.lit(default)

    rows = F.col("_rows")
    ready = merged.select(
        *[F.col(g) for g in groups],
        percent(F.col("_missing"), rows * width).alias("missing_values"),
        percent(F.coalesce("_repeats", F.lit(0)), rows).alias("duplicates"),
        (percent(F.col("_outliers"), rows * len(numeric)) if numeric else F.lit(0.0)).alias("outliers"),
        present("_ratio", 1.0).alias("imbalance_ratio"),
        (present("_flagged", 0.0) * 100.0 / max(pairs, 1)).alias("high_correlation_pct"),
        F.col("_mixed").cast("double").alias("type_inconsistencies"),
        rows.cast("double").alias("dataset_size"),
        F.lit(float(width)).alias("n_features"),
        F.lit(100.0 * len(strings) / width).alias("categorical_pct"),
        F.lit(100.0 * len(numeric) / width).alias("numeric_pct"),
        present("_flagged", 0.0).alias("_pairs"),
        F.col("_outliers"),
    )
    score = scoring.quality_score(
        F.col("missing_values"), F.col("duplicates"), F.col("_outliers"), F.col("imbalance_ratio"), F.col("_pairs")
    )
    return ready.withColumn("quality_score", score)


def _sum_of(flags: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, flags) if flags else F.lit(0).cast("long")


def _cells(keyed: DataFrame, groups: list[str], names: list[str], strings: list[str], fences: dict) -> DataFrame:
    aggregates = [F.count(F.lit(1)).alias("_rows"), *[F.count(col(c)).alias(f"_p{i}") for i, c in enumerate(names)]]
    aggregates += [F.count_if(outside(keyed, c, f)).alias(f"_o{i}") for i, (c, f) in enumerate(fences.items())]
    aggregates += [F.count(read_number(c)).alias(f"_c{i}") for i, c in enumerate(strings)]
    place = {c: i for i, c in enumerate(names)}
    mixed = [
        ((F.col(f"_c{i}") > 0) & (F.col(f"_p{place[c]}") > F.col(f"_c{i}"))).cast("long") for i, c in enumerate(strings)
    ]
    return keyed.groupBy(*groups).agg(*aggregates).select(
        *groups,
        "_rows",
        (F.col("_rows") * len(names) - _sum_of([F.col(f"_p{i}") for i in range(len(names))])).alias("_missing"),
        _sum_of([F.col(f"_o{i}") for i in range(len(fences))]).alias("_outliers"),
        _sum_of(mixed).alias("_mixed"),
    )


def _repeats(keyed: DataFrame, groups: list[str]) -> DataFrame:
    """Repeated rows of each segment: equal rows of one segment agree in the segment column too."""
    return count_repeats(keyed, groups).withColumnRenamed("repeats", "_repeats")


def _ratios(keyed: DataFrame, groups: list[str], target: str) -> DataFrame:
    classes = (
        keyed.filter(col(target).isNotNull())
        .groupBy(*groups, col(target).alias("_class"))
        .agg(F.count(F.lit(1)).alias("_n"))
    )
    return classes.groupBy(*groups).agg(
        F.try_divide(F.max("_n").cast("double"), F.min("_n").cast("double")).alias("_ratio")
    )


def _flagged(keyed: DataFrame, groups: list[str], numeric: list[str], middles: dict[str, float]) -> DataFrame:
    high = pearson("covariance", "variance1", "variance2") > HIGH_CORRELATION
    moments = pair_moments(keyed, numeric, middles, groups)
    return moments.groupBy(*groups).agg(F.sum(F.when(high, 1.0).otherwise(0.0)).alias("_flagged"))
