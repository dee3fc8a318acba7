"""Least squares from sums of products: one scan for the fit of a table, or for the fits of all its folds.

The sums of products of each fold come from one aggregation. The fit without a fold needs only the total minus that fold's
sums, and its error on the fold follows from the fold's own sums, so no rows are read again. What reaches the driver is one
square matrix per fold, as wide as the features.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.functions.columns import col
from tablewright.operators.moments import product_sums

ONE = "_one"
# Directions whose share of the (standardised) spread is below this are taken as not there.
SMALLEST = 1e-10


@dataclass
class LinearFit:
    """A fitted plane; ``r2`` on the rows it was fitted on is None for a constant label."""

    features: list[str]
    coefficients: list[float]
    intercept: float
    rows: int
    r2: float | None

    def predicted(self) -> Column:
        """The prediction as an expression over the feature columns."""
        terms = [F.lit(w) * col(c).cast("double") for c, w in zip(self.features, self.coefficients)]
        return reduce(Column.__add__, terms, F.lit(self.intercept))


def _complete(df: DataFrame, names: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """The named columns as doubles, without rows that lack one of them."""
    plain = df.select(*[col(k) for k in keep], *[col(c).cast("double").alias(c) for c in names], F.lit(1.0).alias(ONE))
    return plain.filter(reduce(Column.__and__, [col(c).isNotNull() & ~F.isnan(col(c)) for c in names]))


def _middles(rows: DataFrame, names: Sequence[str]) -> dict[str, float]:
    found = rows.agg(*[F.avg(col(c)).alias(f"m{i}") for i, c in enumerate(names)]).first()
    return {c: found[f"m{i}"] or 0.0 for i, c in enumerate(names)}


def _matrices(rows: DataFrame, names: Sequence[str], middles: dict[str, float], by: Sequence[str]) -> dict:
    """Sums of products of (1, features, label) relative to the middles, one symmetric matrix per group."""
    size = len(names) + 1
    found: dict = {}
    for r in product_sums(rows, [ONE, *names], middles, by).collect():
        m = found.setdefault(r[by[0]] if by else None, np.zeros((size, size)))
        m[r["i"], r["j"]] = m[r["j"], r["i"]] = r["xy"]
    return found


def _solve(m: np.ndarray) -> tuple[np.ndarray, float]:
    """Coefficients and intercept (relative to the middles); of equally good ones those of least standardised length."""
    n, sums = m[0, 0], m[0, 1:]
    spread = m[1:, 1:] - np.outer(sums, sums) / n
    width = np.sqrt(np.clip(np.diag(spread)[:-1], 0.0, None))
    # Subtraction leaves noise where a column is constant.
    noise = 1e-12 * np.abs(np.diag(m)[1:-1])
    moves = width**2 > noise
    weights = np.zeros(len(width))
    if moves.any():
        scale = width[moves]
        shape = spread[:-1, :-1][np.ix_(moves, moves)] / np.outer(scale, scale)
        weights[moves] = np.linalg.pinv(shape, rcond=SMALLEST, hermitian=True) @ (spread[:-1, -1][moves] / scale) / scale
    return weights, float((sums[-1] - weights @ sums[:-1]) / n)


def _errors(m: np.ndarray, weights: np.ndarray, intercept: float) -> tuple[float, float]:
    """Squared errors of a plane on the rows of a matrix, and the label's squared deviations."""
    v = np.concatenate([[-intercept], -weights, [1.0]])
    return max(float(v @ m @ v), 0.0), max(float(m[-1, -1] - m[0, -1] ** 2 / m[0, 0]), 0.0)


def _r2(m: np.ndarray, weights: np.ndarray, intercept: float) -> float | None:
    wrong, spread = _errors(m, weights, intercept)
    return 1.0 - wrong / spread if spread > 1e-12 * abs(m[-1, -1]) else None


def _fit(m: np.ndarray, features: Sequence[str], label: str, middles: dict[str, float]) -> LinearFit:
    weights, intercept = _solve(m)
    level = intercept + middles[label] - sum(w * middles[c] for c, w in zip(features, weights))
    return LinearFit(list(features), [float(w) for w in weights], float(level), int(round(m[0, 0])), _r2(m, weights, intercept))


def fit_linear(df: DataFrame, features: Sequence[str], label: str) -> LinearFit:
    """The least-squares fit over all rows without gaps; a table without such rows is an error."""
    names = [*features, label]
    rows = _complete(df, names)
    middles = _middles(rows, names)
    found = _matrices(rows, names, middles, [])
    if not found or found[None][0, 0] == 0:
        raise ValueError("no row has all features and the label")
    return _fit(found[None], features, label, middles)


def cross_fit_linear(df: DataFrame, features: Sequence[str], label: str, fold: str) -> tuple[LinearFit, DataFrame]:
    """The fit over all rows, and (fold, rows, rmse, r2) of the fit without each fold, measured on that fold.

    Folds that hold all rows have no fit and are left out; ``r2`` is NULL where a fold's label is constant.
    """
    names = [*features, label]
    rows = _complete(df, names, [fold])
    middles = _middles(rows, names)
    found = _matrices(rows, names, middles, [fold])
    if not found:
        raise ValueError("no row has all features and the label")
    total = sum(found.values())
    measured = []
    for key, own in found.items():
        rest = total - own
        if rest[0, 0] > 0.5:
            plane = _solve(rest)
            n = int(round(own[0, 0]))
            measured.append((key, n, float(np.sqrt(_errors(own, *plane)[0] / n)), _r2(own, *plane)))
    kind = df.schema[fold].dataType.simpleString()
    table = df.sparkSession.createDataFrame(measured, f"{_quoted(fold)} {kind}, rows bigint, rmse double, r2 double")
    return _fit(total, features, label, middles), table


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"
