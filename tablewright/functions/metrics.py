"""Model metrics as plain aggregations over prediction tables; any number of models and folds in one job."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.functions.columns import col


def confusion(predictions: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Rows per (label, prediction); partial counts combine before the shuffle."""
    return predictions.groupBy(
        *[col(b) for b in by], F.col("label").cast("double").alias("label"), F.col("prediction").cast("double").alias("prediction")
    ).agg(F.count(F.lit(1)).alias("n"))


def class_metrics(predictions: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Support, precision, recall and F1 of every class; an undefined ratio is 0."""
    cells = confusion(predictions, by)
    hit = F.when(F.col("label") == F.col("prediction"), F.col("n")).otherwise(0)
    sides = F.array(
        F.struct(F.col("label").alias("class"), F.col("n").alias("support"), F.lit(0).cast("long").alias("predicted"), hit.alias("hits")),
        F.struct(F.col("prediction").alias("class"), F.lit(0).cast("long").alias("support"), F.col("n").alias("predicted"), F.lit(0).cast("long").alias("hits")),
    )
    per_class = (
        cells.select(*[col(b) for b in by], F.explode(sides).alias("s"))
        .groupBy(*[col(b) for b in by], F.col("s.class").alias("class"))
        .agg(F.sum("s.support").alias("support"), F.sum("s.predicted").alias("predicted"), F.sum("s.hits").alias("hits"))
    )
    precision = F.coalesce(F.try_divide(F.col("hits").cast("double"), F.col("predicted")), F.lit(0.0))
    recall = F.coalesce(F.try_divide(F.col("hits").cast("double"), F.col("support")), F.lit(0.0))
    f1 = F.coalesce(F.try_divide(F.col("hits") * 2.0, F.col("support") + F.col("predicted")), F.lit(0.0))
    return per_class.withColumns({"precision": precision, "recall": recall, "f1": f1})


def classification_metrics(predictions: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Accuracy and support-weighted precision, recall and F1."""
    weighted = {m: F.try_divide(F.sum(F.col(m) * F.col("support")), F.sum("support")) for m in ("precision", "recall", "f1")}
    return (
        class_metrics(predictions, by)
        .groupBy(*[col(b) for b in by])
        .agg(
            F.sum("support").alias("rows"),
            F.try_divide(F.sum("hits").cast("double"), F.sum("support")).alias("accuracy"),
            weighted["precision"].alias("weighted_precision"),
            weighted["recall"].alias("weighted_recall"),
            weighted["f1"].alias("weighted_f1"),
        )
    )


def regression_metrics(predictions: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """RMSE, MAE and R2 over (label, prediction)."""
    error = F.col("label").cast("double") - F.col("prediction").cast("double")
    spread = F.var_pop(F.col("label").cast("double"))
    return predictions.groupBy(*[col(b) for b in by]).agg(
        F.count(F.lit(1)).alias("rows"),
        F.sqrt(F.avg(error * error)).alias("rmse"),
        F.avg(F.abs(error)).alias("mae"),
        F.when(spread > 0, 1.0 - F.avg(error * error) / spread).alias("r2"),
    )


def davies_bouldin(points: DataFrame, columns: Sequence[str], cluster: str = "cluster") -> DataFrame:
    """Davies-Bouldin index of a clustering: centroid means, mean distances to them, then the few cluster pairs.

    Only the centroids (one row per cluster) leave the distributed aggregation.
    """
    centre = points.groupBy(col(cluster).alias("c")).agg(
        *[F.avg(col(x).cast("double")).alias(f"m{i}") for i, x in enumerate(columns)]
    )
    centroids = {r["c"]: [r[f"m{i}"] for i in range(len(columns))] for r in centre.collect()}
    if len(centroids) < 2:
        return points.sparkSession.createDataFrame([(None,)], "davies_bouldin double")
    means = F.create_map(*[e for c, m in centroids.items() for e in (F.lit(c), F.array(*[F.lit(v) for v in m]))])
    own = means[col(cluster)]
    distance = F.sqrt(sum(((col(x).cast("double") - own[i]) ** 2 for i, x in enumerate(columns)), F.lit(0.0)))
    scatter = {
        r["c"]: r["s"]
        for r in points.groupBy(col(cluster).alias("c")).agg(F.avg(distance).alias("s")).collect()
    }
    worst = []
    for a in centroids:
        ratios = []
        for b in centroids:
            gap = sum((x - y) ** 2 for x, y in zip(centroids[a], centroids[b])) ** 0.5
            if a != b and gap > 0:
                ratios.append((scatter[a] + scatter[b]) / gap)
        worst.append(max(ratios, default=0.0))
    return points.sparkSession.createDataFrame([(sum(worst) / len(worst),)], "davies_bouldin double")
