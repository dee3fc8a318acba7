"""Score, band and severity expressions over metric columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def quality_score(
    missing_pct: Column, duplicate_pct: Column, outliers: Column, imbalance_ratio: Column, high_pairs: Column
) -> Column:
    """100 minus capped penalties, never below 0; NULL when a percentage is undefined (empty table)."""
    penalty = (
        F.least(missing_pct * 0.5, F.lit(25.0))
        + F.least(duplicate_pct * 2.0, F.lit(15.0))
        + F.when(outliers > 0, 10.0).otherwise(0.0)
        + F.when(imbalance_ratio > 5, 15.0).when(imbalance_ratio > 2, 10.0).otherwise(0.0)
        + F.when(high_pairs > 3, 10.0).otherwise(0.0)
    )
    known = missing_pct.isNotNull() & duplicate_pct.isNotNull()
    return F.when(known, F.greatest(F.lit(100.0) - penalty, F.lit(0.0)))


def score_band(score: Column) -> Column:
    return F.when(score >= 90, "excellent").when(score >= 70, "good").when(score >= 50, "fair").when(
        score.isNotNull(), "poor"
    )


def attention_class(score: Column) -> Column:
    """The two classes the score chart uses."""
    return F.when(score > 75, "good").when(score.isNotNull(), "attention")


def completeness_severity(worst_missing_pct: Column) -> Column:
    return F.when(worst_missing_pct > 30, "critical").otherwise("medium")


def duplicate_severity(duplicate_pct: Column) -> Column:
    return F.when(duplicate_pct > 5, "high").otherwise("low")


def outlier_severity(worst_outlier_pct: Column) -> Column:
    return F.when(worst_outlier_pct > 10, "high").otherwise("medium")


def imbalance_severity(ratio: Column) -> Column:
    return F.when(ratio > 5, "high").when(ratio > 2, "medium").otherwise("low")
