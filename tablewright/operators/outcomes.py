"""Validation of predicted gains against measured ones, over a registry of datasets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

REGISTRY_SCHEMA = (
    "dataset_id string, source string, size bigint, n_features int, data_types map<string,int>, "
    "quality_issues array<string>, notes string, has_pii boolean, anonymized boolean, registered_at timestamp"
)


def issue_score(issues: Column) -> Column:
    """100 less 5 per known issue, within 30..100."""
    count = F.coalesce(F.when(issues.isNotNull(), F.size(issues)), F.lit(0))
    return F.greatest(F.lit(30), F.least(F.lit(100), F.lit(100) - count * 5)).cast("double")


def latest_registrations(registry: DataFrame) -> DataFrame:
    """One record per dataset, the last registered (of several at one time the last as text); combined before the
    shuffle, so a busy dataset is no hot key."""
    record = F.struct(*[F.col(c) for c in registry.columns if c != "dataset_id"])
    return registry.groupBy("dataset_id").agg(F.max_by(record, F.struct("registered_at", F.to_json(record))).alias("r")).select("dataset_id", "r.*")


def unregistered(outcomes: DataFrame, registry: DataFrame) -> DataFrame:
    return outcomes.join(registry.select("dataset_id"), "dataset_id", "left_anti")


def action_level(score: Column) -> Column:
    return F.when(score > 80, "PASSIVE").when(score > 50, "ACTIVE").otherwise("URGENT")


def fix_benefit(actual: Column) -> Column:
    return F.when(actual > 0.01, "significant").when(actual > 0.005, "minimal").otherwise("negligible")


def outcome_verdict(lab: Column, actual: Column) -> Column:
    return (
        F.when((lab > 0) & (actual < 0), "failure_mode")
        .when(F.abs(lab - actual) > 0.02, "mismatch")
        .otherwise("accurate")
    )


def validate(outcomes: DataFrame, registry: DataFrame, strict: bool = True) -> DataFrame:
    """Judge (dataset_id, lab, actual) rows; ``strict`` raises when an outcome names a dataset nobody registered."""
    known = latest_registrations(registry)
    if strict:
        stray = unregistered(outcomes, known).select("dataset_id").limit(1).collect()
        if stray:
            raise ValueError(f"dataset {stray[0]['dataset_id']!r} is not registered")
    lab, actual = F.col("lab"), F.col("actual")
    error, score = F.abs(lab - actual), issue_score(F.col("quality_issues"))
    return outcomes.join(known.select("dataset_id", "quality_issues"), "dataset_id").select(
        "dataset_id",
        score.alias("quality_score"),
        F.round(lab, 4).alias("lab"),
        F.round(actual, 4).alias("actual"),
        F.round(error, 4).alias("error"),
        (error < 0.015).alias("matches"),
        action_level(score).alias("action_level"),
        fix_benefit(actual).alias("fix_benefit"),
        outcome_verdict(lab, actual).alias("verdict"),
    )


def validation_summary(validation: DataFrame) -> DataFrame:
    """Mean score and gain, matches and their rate, and the two conclusions of the report."""
    matches = F.count_if("matches")
    rate = F.try_divide(matches.cast("double"), F.count(F.lit(1)))
    gain = F.avg("actual")
    return validation.agg(
        F.count(F.lit(1)).alias("datasets"),
        F.avg("quality_score").alias("avg_quality_score"),
        gain.alias("avg_gain"),
        matches.alias("match_count"),
        (rate * 100.0).alias("match_rate_pct"),
        (rate > 0.8).alias("lab_accurate"),
        (F.abs(gain) < 0.02).alias("marginal"),
    )
