"""Fix history as mergeable states: recording effects costs those effects, not the history so far.

A state holds, for one (fix, data type, domain), the number of trials and of each measure the count, the mean and the sum of squared
distances from the mean. Two states merge exactly (up to rounding) into the state of all their effects, in any order and grouping, so a
history may be kept as one small table of states per recorded batch.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablewright.operators.history import ranked, recommendation, score_effects

KEYS = ("fix_name", "data_type", "domain")
MEASURES = ("effectiveness", "f1_improvement", "data_loss_pct")
STATE_SCHEMA = "fix_name string, data_type string, domain string, num_trials bigint, " + ", ".join(
    f"n_{m} bigint, mean_{m} double, m2_{m} double" for m in MEASURES
)


def effect_states(effects: DataFrame) -> DataFrame:
    """The states of effects: one row per (fix, data type, domain). A NULL measure counts as a trial only."""
    parts = [F.count(F.lit(1)).alias("num_trials")]
    for m in MEASURES:
        parts += [F.count(m).alias(f"n_{m}"), F.avg(m).alias(f"mean_{m}"), (F.var_pop(m) * F.count(m)).alias(f"m2_{m}")]
    return score_effects(effects).groupBy(*KEYS).agg(*parts)


def weighted_mean(measure: str, where: Column | None = None) -> Column:
    """The mean of all effects behind states, or behind those where a condition holds; NULL without any."""
    n, mean = F.col(f"n_{measure}"), F.col(f"mean_{measure}")
    if where is not None:
        n = F.when(where, n)
    return F.try_divide(F.sum(n * mean), F.sum(n))


def merge_states(states: DataFrame, by: Sequence[str] = KEYS) -> DataFrame:
    """One state for each value of ``by``. Distances are taken from the common mean, so large equal values do not cancel."""
    key = Window.partitionBy(*by)
    centred = states.withColumns(
        {f"all_{m}": F.try_divide(F.sum(F.col(f"n_{m}") * F.col(f"mean_{m}")).over(key), F.sum(f"n_{m}").over(key)) for m in MEASURES}
    )
    parts = [F.sum("num_trials").alias("num_trials")]
    for m in MEASURES:
        shift = F.col(f"mean_{m}") - F.col(f"all_{m}")
        parts += [
            F.sum(f"n_{m}").alias(f"n_{m}"),
            F.first(f"all_{m}").alias(f"mean_{m}"),
            F.sum(F.col(f"m2_{m}") + F.col(f"n_{m}") * shift * shift).alias(f"m2_{m}"),
        ]
    return centred.groupBy(*by).agg(*parts)


def analyze_states(states: DataFrame) -> DataFrame:
    """``analyze_effectiveness`` of all effects behind the states."""
    merged = merge_states(states, ["fix_name", "data_type"])
    return merged.select(
        "fix_name",
        "data_type",
        F.col("mean_effectiveness").alias("avg_effectiveness"),
        F.sqrt(F.try_divide("m2_effectiveness", "n_effectiveness")).alias("std_effectiveness"),
        F.col("mean_f1_improvement").alias("avg_f1_improvement"),
        F.col("mean_data_loss_pct").alias("avg_data_loss"),
        "num_trials",
        recommendation(F.col("mean_effectiveness")).alias("recommendation"),
    )


def best_fixes_of_states(states: DataFrame, data_types: Sequence[str] | None = None, domain: str | None = None) -> DataFrame:
    """``best_fixes`` of all effects behind the states."""
    chosen = states if data_types is None else states.filter(F.col("data_type").isin(list(data_types)))
    mean = weighted_mean("effectiveness")
    if domain is not None:
        mean = F.coalesce(weighted_mean("effectiveness", F.col("domain") == domain), mean)
    return ranked(chosen.groupBy("data_type", "fix_name").agg(mean.alias("effectiveness")))
