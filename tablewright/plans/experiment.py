"""Experiments over one table or many, their summaries, and the complete decision flow."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewright.functions import scoring
from tablewright.operators.encode import row_counts
from tablewright.operators.fixes import apply_fixes
from tablewright.operators.flat import flat_profile
from tablewright.operators.gain import GainModel, fix_if_worth
from tablewright.operators.history import expected_gain, recommend_fixes
from tablewright.operators.impact import analyze_impact
from tablewright.operators.profile import score_table
from tablewright.operators.ranking import stratified_split
from tablewright.operators.rules import for_domains, get_rules, judge
from tablewright.operators.tasks import TASKS, task_impact

RESULT_SCHEMA = (
    "dataset string, quality_score double, rows_original bigint, columns_original int, rows_fixed bigint, "
    "columns_fixed int, model string, metric string, original double, fixed double, improvement double, improvement_pct double"
)


@dataclass
class Experiment:
    """One table to examine: how to load it, what to predict, what identifies a row."""

    name: str
    load: Callable[[], DataFrame]
    target: str
    keys: Sequence[str]
    exclude: Sequence[str] = ()
    options: dict = field(default_factory=dict)


def run_experiment(experiment: Experiment, config: dict | None = None) -> DataFrame:
    """Profile, repair, measure: one row per model and metric with the score and both shapes."""
    df = experiment.load()
    fixed = apply_fixes(df, config, experiment.target, experiment.keys)
    score = score_table(df, experiment.target).first()["quality_score"]
    before, after = row_counts(df, fixed)
    impact = analyze_impact(
        df, fixed, experiment.target, experiment.keys, exclude=experiment.exclude, dataset=experiment.name, **experiment.options
    )
    return impact.select(
        "dataset",
        F.lit(score).cast("double").alias("quality_score"),
        F.lit(before).cast("long").alias("rows_original"),
        F.lit(len(df.columns)).alias("columns_original"),
        F.lit(after).cast("long").alias("rows_fixed"),
        F.lit(len(fixed.columns)).alias("columns_fixed"),
        "model",
        "metric",
        "original",
        "fixed",
        "improvement",
        "improvement_pct",
    )


def run_experiments(spark: SparkSession, experiments: Sequence[Experiment], config: dict | None = None) -> DataFrame:
    """All experiments; one that fails leaves one row with its name and error, the others have no error."""
    schema = f"{RESULT_SCHEMA}, error string"
    done = [spark.createDataFrame([], schema)]
    for e in experiments:
        try:
            done.append(run_experiment(e, config).withColumn("error", F.lit(None).cast("string")))
        except Exception as error:  # one bad table must not end the others
            nothing = [None] * (len(done[0].columns) - 2)
            done.append(spark.createDataFrame([(e.name, *nothing, f"{type(error).__name__}: {error}"[:500])], schema))
    return reduce(DataFrame.unionByName, done)


def experiment_summary(results: DataFrame) -> DataFrame:
    """Per dataset: score, shapes and the mean F1 gain over the models."""
    return (
        results.filter("metric = 'f1'")
        .groupBy("dataset", "quality_score", "rows_original", "columns_original", "rows_fixed", "columns_fixed")
        .agg(F.avg("improvement").alias("avg_f1_improvement"))
    )


def data_reduction(tables: dict[str, tuple[DataFrame, DataFrame]]) -> DataFrame:
    """Rows before and after the repairs of every table, all counted in one job."""
    counted = [
        t.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("dataset"), F.lit(side).alias("side"), "n")
        for name, pair in tables.items()
        for side, t in zip(("original", "retained"), pair)
    ]
    # Two rows per table are left to arrange.
    wide = reduce(DataFrame.union, counted).groupBy("dataset").agg(
        F.max(F.when(F.col("side") == "original", F.col("n"))).alias("original"),
        F.max(F.when(F.col("side") == "retained", F.col("n"))).alias("retained"),
    )
    removed = F.col("original") - F.col("retained")
    return wide.withColumns(
        {"removed": removed, "removed_pct": F.try_divide(removed * 100.0, F.col("original").cast("double"))}
    )


def improvement_matrix(results: DataFrame, models: Sequence[str]) -> DataFrame:
    """F1 gain, datasets down and models across."""
    return results.filter("metric = 'f1'").groupBy("dataset").pivot("model", list(models)).agg(F.first("improvement"))


def score_classes(scores: DataFrame) -> DataFrame:
    return scores.withColumn("score_class", scoring.attention_class(F.col("quality_score")))


def decide(
    df: DataFrame,
    target: str,
    keys: Sequence[str],
    rules: DataFrame,
    model: GainModel,
    history: DataFrame,
    features: Sequence[str],
    domain: str = "finance",
    task: str = "classification",
    config: dict | None = None,
    models: Sequence[str] = ("rf",),
    exclude: Sequence[str] = (),
    **size,
) -> DataFrame:
    """The complete flow on one table, one row: profile, domain verdict, prediction, recommendations, gated repair,
    measured gain with the prediction's error, and the task's own metric."""
    if task not in TASKS:
        raise ValueError(f"unknown task {task!r}; known: {', '.join(TASKS)}")
    get_rules(rules, domain)
    profile = flat_profile(df, target)
    known = df.sparkSession.createDataFrame(profile.collect(), profile.schema)
    verdict = judge(for_domains(known, [domain]), rules).first()
    recommended = recommend_fixes(df, history, domain)
    names = [r["fix_name"] for r in recommended.orderBy("data_type", "rank").collect()]
    gain = expected_gain(recommended).first()["expected_gain"]
    fixed, predicted, advice = fix_if_worth(df, known, model, target, keys, config)

    impact = analyze_impact(df, fixed, target, keys, models, exclude, **size)
    actual = impact.filter("metric = 'f1'").agg(F.avg("improvement")).first()[0]
    flagged = stratified_split(df.filter(F.col(target).isNotNull()), target, keys)
    train, test = (flagged.filter(F.col("is_test") == part).drop("is_test") for part in (False, True))
    options = {"models": list(models), **size} if task == "classification" else {}
    own = task_impact(task, train, test, apply_fixes(test, config, target, keys), features, target, **options).first()
    return df.sparkSession.createDataFrame(
        [
            (
                verdict["quality_score"],
                domain,
                verdict["passes_checks"],
                verdict["severity_level"],
                names,
                gain,
                predicted,
                advice,
                actual,
                abs(predicted - actual),
                task,
                own["metric"],
                own["original"],
                own["fixed"],
            )
        ],
        "quality_score double, domain string, passes_checks boolean, severity_level string, recommended array<string>, "
        "expected_gain double, predicted_gain double, verdict string, actual_gain double, prediction_error double, "
        "task string, task_metric string, task_original double, task_fixed double",
    )
