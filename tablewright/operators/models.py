"""Model evaluation with stratified cross-validation on Spark ML.

Each fold of each model is fitted once; accuracy, weighted F1 and ROC-AUC all come from the same kept predictions.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark import StorageLevel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, OneVsRest, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.functions.columns import col
from tablewright.functions.lineage import cut, kept
from tablewright.functions.metrics import classification_metrics
from tablewright.functions.together import together
from tablewright.operators.auc import class_auc
from tablewright.operators.groups import grouped_folds
from tablewright.operators.ranking import stratified_folds

ROWS_PER_PARTITION = 20_000
FIT_ROWS = 200_000
MEASURES = ("accuracy", "f1", "roc_auc")
METRICS_SCHEMA = "model string, accuracy double, f1 double, roc_auc double, failed_folds int, error string"


def build_model(name: str, rows: int, classes: int, seed: int = 42, **size):
    """An untrained classifier on ``features`` and ``label``.

    ``size`` overrides trees, depth and iterations.  The logistic penalty 1/(C*n) on the mean loss equals C=1 on the summed loss.
    """
    if name == "rf":
        return RandomForestClassifier(
            numTrees=size.get("trees", 50), maxDepth=size.get("depth", 10), seed=seed, featureSubsetStrategy="sqrt"
        )
    if name == "lr":
        return LogisticRegression(
            maxIter=size.get("iterations", 1000), regParam=1.0 / max(rows, 1), elasticNetParam=0.0, standardization=False
        )
    if name == "xgb":
        boosted = GBTClassifier(maxIter=size.get("rounds", 50), maxDepth=size.get("boost_depth", 5), stepSize=0.3, seed=seed)
        return boosted if classes <= 2 else OneVsRest(classifier=boosted)
    raise ValueError(f"unknown model {name!r}")


def fold_count(rows: int) -> int:
    """At least 100 rows per fold, between 2 and 5 folds."""
    return min(5, max(2, rows // 100))


def fold_count_column(rows):
    """The same rule as a column expression."""
    return F.least(F.lit(5), F.greatest(F.lit(2), F.floor(rows / 100))).cast("int")


def assemble(df: DataFrame, features: Sequence[str], label: str, keep: Sequence[str] = ()) -> DataFrame:
    """``features`` vector and double ``label``; feature NULLs (columns without any value) become 0."""
    ready = df.select(
        *[F.coalesce(col(c).cast("double"), F.lit(0.0)).alias(c) for c in features],
        col(label).cast("double").alias("label"),
        *[col(k).alias(f"_key{i}") for i, k in enumerate(keep)],
    )
    return VectorAssembler(inputCols=list(features), outputCol="features").transform(ready).select(
        "features", "label", *[f"_key{i}" for i in range(len(keep))]
    )


def sized(df: DataFrame, rows: int) -> DataFrame:
    """Merge tiny partitions before an iterative fit; a large table keeps the partitions it has."""
    return df.coalesce(max(1, math.ceil(rows / ROWS_PER_PARTITION)))


def fit_partitions(rows: int, cores: int) -> int:
    """Partitions of a table that many short jobs read: two a core if they are not tiny, more from FIT_ROWS rows in each on."""
    return max(1, min(math.ceil(rows / ROWS_PER_PARTITION), max(2 * cores, math.ceil(rows / FIT_ROWS))))


def score_array(scored: DataFrame) -> Column:
    """One score per class: probabilities, or raw predictions of a model that has none."""
    return vector_to_array(F.col("probability" if "probability" in scored.columns else "rawPrediction"))


def _measured(predictions: DataFrame, classes: Sequence[float]) -> list[dict]:
    """Accuracy, weighted F1 and ROC-AUC of every model and fold, from predictions computed once."""
    by, spark = ["model", "fold"], predictions.sparkSession
    with kept(predictions) as (stored,):
        jobs = [lambda: classification_metrics(stored.select(*by, "label", "prediction"), by).collect()]
        if len(classes) > 1:
            jobs.append(lambda: class_auc(stored, classes, by).collect())
        rates, *areas = together(spark, jobs)
    auc = {(r["model"], r["fold"]): r["roc_auc"] for r in areas[0]} if areas else {}
    return [
        {"model": r["model"], "fold": r["fold"], "accuracy": r["accuracy"], "f1": r["weighted_f1"], "roc_auc": auc.get((r["model"], r["fold"]), 0.0)}
        for r in rates
    ]


def cross_validate(
    data: DataFrame,
    models: Sequence[str] = ("rf", "lr"),
    keys: Sequence[str] = ("_key0",),
    seed: int = 42,
    folds: int | None = None,
    at_once: int = 4,
    together_by: Sequence[str] | None = None,
    **size,
) -> DataFrame:
    """Mean accuracy, weighted F1 and ROC-AUC over stratified folds, one row per model.

    Up to ``at_once`` folds are fitted side by side; the predictions of all folds and models are kept and measured together, classes
    and folds in one job each for the rates and for the areas.  A model with a fold that cannot be fitted or has no rows to
    measure has no measures (NULL): ``failed_folds`` counts such folds, ``error`` is the first one's message; see ``every_fold``.
    ``together_by`` names columns whose rows of equal values stay in one fold, such as the keys of copied rows; without it rows
    are dealt one by one.
    """
    with kept(data) as (data,):
        return _cross_validated(data, models, keys, seed, folds, at_once, together_by, size)


def every_fold(found: DataFrame) -> DataFrame:
    """The measures of ``cross_validate`` for a caller that hands them on without ``failed_folds``: a failed fold is an error."""
    failed = found.filter("failed_folds > 0").orderBy("model").collect()
    if failed:
        raise RuntimeError("cross-validation failed: " + "; ".join(f"{r['model']}: {r['failed_folds']} folds, {r['error']}" for r in failed))
    return found


def _cross_validated(
    data: DataFrame, models: Sequence[str], keys: Sequence[str], seed: int, folds: int | None, at_once: int, together_by: Sequence[str] | None, size: dict
) -> DataFrame:
    counts = {r["label"]: r["count"] for r in data.groupBy("label").count().collect()}
    rows, classes = sum(counts.values()), sorted(c for c in counts if c is not None)
    k = fold_count(rows) if folds is None else folds
    if together_by is None:
        folded = stratified_folds(data, "label", k, keys, seed, max(counts.values(), default=0))
    else:
        folded = grouped_folds(data, "label", k, together_by, seed)
    # Cut off from the plan that dealt the folds: each task of each fit would report the counters of that plan to the driver.
    parts = fit_partitions(rows, data.sparkSession.sparkContext.defaultParallelism)
    folded = cut(folded.repartition(parts, *[col(key) for key in keys])).persist(StorageLevel.MEMORY_AND_DISK)
    spark, runs = data.sparkSession, [(name, i) for name in models for i in range(k)]

    def run(name: str, i: int) -> DataFrame | str:
        try:
            fitted = build_model(name, max(1, rows - rows // k), len(classes), seed, **size).fit(folded.filter(F.col("fold") != i))
        except Exception as error:  # one failing fold must not end the comparison
            return f"fold {i}: {type(error).__name__}: {error}"[:200]
        scored = fitted.transform(folded.filter(F.col("fold") == i))
        return scored.select(
            F.lit(name).alias("model"), F.lit(i).alias("fold"), "label", "prediction", score_array(scored).alias("scores")
        )

    try:
        folded.count()
        done = together(spark, [lambda n=n, i=i: run(n, i) for n, i in runs], at_once)
        sums = {name: {m: 0.0 for m in MEASURES} for name in models}
        failed = {run: f"fold {run[1]}: no rows to measure" for run in runs}
        failed |= {run: outcome for run, outcome in zip(runs, done) if isinstance(outcome, str)}
        predictions = [outcome for outcome in done if isinstance(outcome, DataFrame)]
        if predictions:
            for r in _measured(reduce(DataFrame.union, predictions), classes):
                del failed[r["model"], r["fold"]]
                for measure in MEASURES:
                    sums[r["model"]][measure] += r[measure] / k
        results = []
        for name in models:
            errors = [failed[name, i] for i in range(k) if (name, i) in failed]
            results.append((name, *[None if errors else sums[name][m] for m in MEASURES], len(errors), next(iter(errors), None)))
    finally:
        folded.unpersist()
    return spark.createDataFrame(results, METRICS_SCHEMA)
