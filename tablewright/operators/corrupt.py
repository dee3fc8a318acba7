"""Fault injection on whole tables, reproducible from row keys: missing values, outliers, duplicates, noise."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.functions.columns import col, hash_key, in_share, numeric_columns, unit_interval
from tablewright.operators.ranking import sample_exact


def _cell_key(keys: Sequence[str], column: str, seed: int) -> Column:
    return hash_key(keys, f"{column}-{seed}")


def _numeric(df: DataFrame, keys: Sequence[str], columns: Sequence[str] | None) -> list[str]:
    return [c for c in numeric_columns(df) if c not in keys] if columns is None else list(columns)


def inject_missing(
    df: DataFrame, keys: Sequence[str], share: float = 0.1, columns: Sequence[str] | None = None, seed: int = 42
) -> DataFrame:
    """Blank a share of every numeric column (the keys excepted)."""
    hit = set(_numeric(df, keys, columns))
    return df.select(
        *[
            F.when(~in_share(_cell_key(keys, c, seed), share), col(c)).alias(c) if c in hit else col(c)
            for c in df.columns
        ]
    )


def inject_outliers(
    df: DataFrame,
    keys: Sequence[str],
    share: float = 0.05,
    factor: float = 5.0,
    columns: Sequence[str] | None = None,
    seed: int = 42,
) -> DataFrame:
    """Multiply a share of every numeric column."""
    hit = set(_numeric(df, keys, columns))
    return df.select(
        *[
            F.when(in_share(_cell_key(keys, c, seed), share), col(c) * F.lit(factor))
            .otherwise(col(c).cast("double"))
            .alias(c)
            if c in hit
            else col(c)
            for c in df.columns
        ]
    )


def inject_duplicates(df: DataFrame, keys: Sequence[str], share: float = 0.05, seed: int = 42) -> DataFrame:
    """Append exactly int(share * rows) of the rows once more."""
    rows = df.count()
    return df.unionByName(sample_exact(df, int(share * rows), keys, seed, rows))


def inject_noise(
    df: DataFrame,
    keys: Sequence[str],
    shrink: float = 0.95,
    deviation: float = 0.01,
    columns: Sequence[str] | None = None,
    seed: int = 42,
) -> DataFrame:
    """x * shrink + N(0, deviation).

    The normal deviate comes from the row's hash (Box-Muller), so a recomputed partition draws the same noise.
    """
    hit = set(_numeric(df, keys, columns))

    def noisy(c: str) -> Column:
        key = _cell_key(keys, c, seed)
        radius = F.sqrt(F.log(unit_interval(key, 1)) * -2.0)
        normal = radius * F.cos(unit_interval(key, 9) * (2.0 * math.pi))
        return col(c) * F.lit(shrink) + normal * F.lit(deviation)

    return df.select(*[noisy(c).alias(c) if c in hit else col(c) for c in df.columns])


def corrupt(df: DataFrame, issue: str, keys: Sequence[str], seed: int = 42) -> DataFrame:
    """The table with one issue injected; missing values are injected and their rows then dropped."""
    if issue == "missing_values":
        return inject_missing(df, keys, seed=seed).na.drop("any")
    if issue == "outliers":
        return inject_outliers(df, keys, seed=seed)
    if issue == "duplicates":
        return inject_duplicates(df, keys, seed=seed)
    raise ValueError(f"unknown issue {issue!r}")
