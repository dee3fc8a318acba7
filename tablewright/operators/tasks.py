"""Repair impact by task: classification, regression, clustering."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark import StorageLevel
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.functions.columns import col
from tablewright.functions.lineage import kept
from tablewright.functions.metrics import classification_metrics, davies_bouldin, regression_metrics
from tablewright.operators.clusters import silhouette
from tablewright.operators.linear import fit_linear
from tablewright.operators.models import assemble, build_model, sized

TASK_SCHEMA = "task string, model string, metric string, original double, fixed double, improvement_pct double"
TASKS = ("classification", "regression", "clustering")


def _relative(change: float, base: float) -> float:
    return change / base * 100.0 if base > 0 else 0.0


def classification_impact(
    train: DataFrame,
    test: DataFrame,
    fixed_test: DataFrame,
    features: Sequence[str],
    target: str,
    models: Sequence[str] = ("rf", "lr"),
    **size,
) -> DataFrame:
    """Weighted F1 on the test table and on its repaired version, same fitted models."""
    data = sized(assemble(train, features, target), train.count()).persist(StorageLevel.MEMORY_AND_DISK)
    rows = []
    try:
        counts = data.groupBy("label").count().agg(F.sum("count").alias("n"), F.count(F.lit(1)).alias("k")).first()
        for name in models:
            model = build_model(name, counts["n"], counts["k"], **size).fit(data)
            before, after = (
                classification_metrics(model.transform(assemble(t, features, target)).select("label", "prediction")).first()
                for t in (test, fixed_test)
            )
            a, b = before["weighted_f1"], after["weighted_f1"]
            rows.append(("classification", name, "weighted_f1", a, b, _relative(b - a, a)))
    finally:
        data.unpersist()
    return train.sparkSession.createDataFrame(rows, TASK_SCHEMA)


def regression_impact(
    train: DataFrame,
    test: DataFrame,
    fixed_test: DataFrame,
    features: Sequence[str],
    target: str,
    trees: int = 50,
    depth: int = 10,
    seed: int = 42,
    models: Sequence[str] = ("rf", "lr"),
) -> DataFrame:
    """RMSE, MAE and R2 on the test table and on its repaired version; improvement is the error's reduction."""
    rows = []
    with kept(*[_plain(t, features, target) for t in (train, test, fixed_test)]) as (data, *sides):
        for name in models:
            predicted = _predictor(name, data, features, trees, depth, seed)
            before, after = (regression_metrics(predicted(t)).first() for t in sides)
            for metric in ("rmse", "mae"):
                rows.append(
                    ("regression", name, metric, before[metric], after[metric], _relative(before[metric] - after[metric], before[metric]))
                )
            rows.append(("regression", name, "r2", before["r2"], after["r2"], _relative(after["r2"] - before["r2"], before["r2"])))
    return train.sparkSession.createDataFrame(rows, TASK_SCHEMA)


def _plain(df: DataFrame, features: Sequence[str], target: str) -> DataFrame:
    """Features as doubles, 0 where they are missing, and the label; rows without a label are left out."""
    filled = [F.coalesce(col(c).cast("double"), F.lit(0.0)).alias(c) for c in features]
    return df.select(*filled, col(target).cast("double").alias("_label")).filter("_label is not null")


def _predictor(name: str, data: DataFrame, features: Sequence[str], trees: int, depth: int, seed: int) -> Callable[[DataFrame], DataFrame]:
    """A fitted regressor as a function from a plain table to (label, prediction)."""
    if name == "lr":
        plane = fit_linear(data, features, "_label")
        return lambda t: t.select(F.col("_label").alias("label"), plane.predicted().alias("prediction"))
    if name != "rf":
        raise ValueError(f"unknown model {name!r}")
    forest = RandomForestRegressor(numTrees=trees, maxDepth=depth, featureSubsetStrategy="all", seed=seed)
    model = forest.fit(sized(assemble(data, features, "_label"), data.count()))
    return lambda t: model.transform(assemble(t, features, "_label")).select("label", "prediction")


def cluster(df: DataFrame, features: Sequence[str], k: int, seed: int = 42) -> DataFrame:
    """The table's features with the k-means ``cluster`` of every row; k-means caches its own input."""
    ready = df.select(*[F.coalesce(col(c).cast("double"), F.lit(0.0)).alias(c) for c in features])
    data = VectorAssembler(inputCols=list(features), outputCol="features").transform(ready)
    return KMeans(k=k, seed=seed, predictionCol="cluster").fit(data).transform(data)


def clustering_impact(
    df: DataFrame, fixed: DataFrame, features: Sequence[str], seed: int = 42, evaluated: int | None = 2000
) -> DataFrame:
    """Silhouette (of ``evaluated`` different points against all rows; None: of all) and Davies-Bouldin index before and after."""
    rows = df.count()
    k = min(3, max(2, rows))
    found = []
    for table in (df, fixed):
        points = sized(cluster(table, features, k, seed), rows).persist(StorageLevel.MEMORY_AND_DISK)
        try:
            shape = silhouette(points, features, evaluated=evaluated).first()["silhouette"]
            found.append((shape or 0.0, davies_bouldin(points, features).first()["davies_bouldin"]))
        finally:
            points.unpersist()
    (s0, d0), (s1, d1) = found
    rows = [
        ("clustering", "kmeans", "silhouette", s0, s1, _relative(s1 - s0, s0)),
        ("clustering", "kmeans", "davies_bouldin", d0, d1, _relative((d0 or 0.0) - (d1 or 0.0), d0 or 0.0)),
    ]
    return df.sparkSession.createDataFrame(rows, TASK_SCHEMA)


def task_impact(
    task: str, train: DataFrame, test: DataFrame, fixed_test: DataFrame, features: Sequence[str], target: str, **options
) -> DataFrame:
    if task == "classification":
        return classification_impact(train, test, fixed_test, features, target, **options)
    if task == "regression":
        return regression_impact(train, test, fixed_test, features, target, **options)
    if task == "clustering":
        return clustering_impact(test, fixed_test, features, **options)
    raise ValueError(f"unknown task {task!r}; known: {', '.join(TASKS)}")
