"""What past repairs achieved, and which repairs to recommend from it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tablewright.functions.columns import numeric_columns, string_columns
from tablewright.operators import fixes

HISTORY_SCHEMA = (
    "fix_name string, data_type string, domain string, f1_improvement double, precision_change double, "
    "recall_change double, data_loss_pct double, dataset_size bigint, dataset_characteristics map<string,string>, notes string"
)

# The twelve effects a fresh history starts with
# (fix, data type, domain, F1 gain, precision change, recall change, data loss %, rows).
DEFAULT_EFFECTS = (
    ("drop_missing", "numeric", "general", 0.012, 0.010, 0.015, 2.5, 50000),
    ("drop_missing", "categorical", "general", 0.008, 0.006, 0.010, 3.2, 40000),
    ("drop_missing", "datetime", "general", 0.005, 0.003, 0.007, 5.0, 30000),
    ("remove_duplicates", "numeric", "general", 0.003, 0.002, 0.004, 0.5, 60000),
    ("remove_duplicates", "categorical", "general", 0.007, 0.006, 0.008, 0.3, 50000),
    ("remove_duplicates", "text", "nlp", 0.015, 0.018, 0.012, 0.2, 100000),
    ("remove_outliers", "numeric", "general", -0.005, 0.002, -0.012, 5.0, 40000),
    ("remove_outliers", "numeric", "finance", 0.008, 0.012, 0.004, 2.0, 35000),
    ("scale_features", "numeric", "general", 0.010, 0.008, 0.012, 0.0, 50000),
    ("scale_features", "categorical", "general", 0.0, 0.0, 0.0, 0.0, 40000),
    ("handle_imbalance", "numeric", "general", 0.020, 0.015, 0.025, 0.0, 50000),
    ("handle_imbalance", "numeric", "finance", 0.035, 0.040, 0.030, 0.0, 100000),
)


def default_history(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(*e, {}, "") for e in DEFAULT_EFFECTS], HISTORY_SCHEMA)


def record_effects(history: DataFrame, effects: DataFrame) -> DataFrame:
    return history.unionByName(effects, allowMissingColumns=True)


def effectiveness() -> Column:
    """Percentage points of F1 gained, less half a point per percent of data lost."""
    return F.col("f1_improvement") * 100.0 - F.col("data_loss_pct") * 0.5


def score_effects(history: DataFrame) -> DataFrame:
    return history.withColumn("effectiveness", effectiveness())


def recommendation(mean_score: Column) -> Column:
    return F.when(mean_score > 2.0, "RECOMMENDED").when(mean_score > 0.5, "TRY").otherwise("SKIP")


def analyze_effectiveness(history: DataFrame) -> DataFrame:
    """Per fix and data type: mean and deviation of the score, mean gain and loss, trials, recommendation."""
    return (
        score_effects(history)
        .groupBy("fix_name", "data_type")
        .agg(
            F.avg("effectiveness").alias("avg_effectiveness"),
            F.stddev_pop("effectiveness").alias("std_effectiveness"),
            F.avg("f1_improvement").alias("avg_f1_improvement"),
            F.avg("data_loss_pct").alias("avg_data_loss"),
            F.count(F.lit(1)).alias("num_trials"),
        )
        .withColumn("recommendation", recommendation(F.col("avg_effectiveness")))
    )


def top_effects(history: DataFrame, n: int = 5) -> DataFrame:
    """The n most effective (fix, data type) pairs."""
    return analyze_effectiveness(history).orderBy(F.desc("avg_effectiveness"), "fix_name", "data_type").limit(n)


def best_fixes(history: DataFrame, data_types: Sequence[str] | None = None, domain: str | None = None) -> DataFrame:
    """Helpful fixes per data type, best first: the domain's own mean where it has trials, else the overall mean."""
    chosen = history if data_types is None else history.filter(F.col("data_type").isin(list(data_types)))
    overall = F.avg(effectiveness())
    mean = overall if domain is None else F.coalesce(F.avg(F.when(F.col("domain") == domain, effectiveness())), overall)
    return ranked(chosen.groupBy("data_type", "fix_name").agg(mean.alias("effectiveness")))


def ranked(means: DataFrame) -> DataFrame:
    """Helpful fixes (data_type, fix_name, effectiveness) with their rank within the data type."""
    # One row per fix and data type is left, so ranking within a data type is cheap.
    order = Window.partitionBy("data_type").orderBy(F.desc("effectiveness"), "fix_name")
    return means.filter("effectiveness > 0").withColumn("rank", F.row_number().over(order))


def recommend_fixes(df: DataFrame, history: DataFrame, domain: str | None = None, top: int = 3) -> DataFrame:
    """The best fixes for the numeric and categorical columns the table has, with column counts and expected gain."""
    return recommend_ranked(df, best_fixes(history, domain=domain), top)


def recommend_ranked(df: DataFrame, best: DataFrame, top: int = 3) -> DataFrame:
    """``recommend_fixes`` from ranked fixes, however they were found."""
    present = {"numeric": len(numeric_columns(df)), "categorical": len(string_columns(df))}
    present = {k: n for k, n in present.items() if n}
    counts = F.create_map(*[F.lit(v) for kv in (present or {"": 0}).items() for v in kv])
    rows = best.filter(F.col("data_type").isin(list(present))).filter(F.col("rank") <= top)
    # At most ``top`` rows per class are left.
    everywhere = Window.partitionBy(F.lit(0))
    return rows.select(
        "data_type",
        "fix_name",
        "effectiveness",
        "rank",
        counts[F.col("data_type")].cast("int").alias("column_count"),
        (F.avg("effectiveness").over(everywhere) / 100.0).alias("expected_gain"),
    )


def expected_gain(recommendations: DataFrame) -> DataFrame:
    """Mean effectiveness / 100 over the recommended fixes, 0 without any."""
    return recommendations.agg(F.coalesce(F.avg("effectiveness") / 100.0, F.lit(0.0)).alias("expected_gain"))


def apply_recommended(
    df: DataFrame, history: DataFrame, target: str, keys: Sequence[str], domain: str | None = None, top: int = 2
) -> DataFrame:
    """Apply the best fixes of each column class to the columns of that class, in repair order."""
    names: dict[str, set[str]] = {}
    for r in recommend_fixes(df, history, domain, top).collect():
        names.setdefault(r["fix_name"], set()).add(r["data_type"])
    numeric, strings = numeric_columns(df), string_columns(df)
    columns = {"numeric": numeric, "categorical": strings}
    if "drop_missing" in names:
        df = fixes.drop_missing(df, [c for t in sorted(names["drop_missing"]) for c in columns[t]])
    if "remove_duplicates" in names:
        df = fixes.remove_duplicates(df)
    if "remove_outliers" in names:
        df = fixes.remove_outliers(df, exclude=[*keys, target])
    if "handle_imbalance" in names:
        df = fixes.undersample(df, target, keys)
    if "numeric" in names.get("scale_features", ()):
        df = fixes.scale_features(df, target, [c for c in numeric if c not in (*keys, target)])
    return df
