"""Predict the F1 gain of a repair from the flat quality profile; profiles and predictions are tables of any size."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark import StorageLevel
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.functions.columns import col, hash_key
from tablewright.functions.metrics import regression_metrics
from tablewright.functions.together import together
from tablewright.operators.fixes import apply_fixes, scale_features
from tablewright.operators.linear import cross_fit_linear
from tablewright.operators.models import sized

# What a profile is taken to be where it says nothing.
FEATURE_DEFAULTS = {
    "missing_values": 0.0,
    "duplicates": 0.0,
    "outliers": 0.0,
    "imbalance_ratio": 1.0,
    "high_correlation_pct": 0.0,
    "type_inconsistencies": 0.0,
    "quality_score": 50.0,
    "dataset_size": 1000.0,
    "n_features": 10.0,
    "categorical_pct": 0.0,
    "numeric_pct": 100.0,
}
FEATURES = tuple("log_dataset_size" if f == "dataset_size" else f for f in FEATURE_DEFAULTS)
# The trees of a forest have no limit of depth; Spark grows none deeper.
DEEPEST = 30
# Half width of the interval per model kind.
MARGINS = {"rf": 0.02, "gb": 0.02, "lr": 0.05}


def quality_features(profiles: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """The eleven model features of every profile: defaults filled in, the size on a log scale."""

    def feature(name: str, default: float) -> Column:
        value = F.coalesce(col(name).cast("double"), F.lit(default)) if name in profiles.columns else F.lit(default)
        return F.log1p(value).alias("log_dataset_size") if name == "dataset_size" else value.alias(name)

    return profiles.select(*[col(k) for k in keep], *[feature(n, d) for n, d in FEATURE_DEFAULTS.items()])


def standardised_features(features: DataFrame) -> DataFrame:
    """Features with mean 0 and population deviation 1."""
    names = [c for c in FEATURES if c in features.columns]
    return scale_features(features.withColumn("_none", F.lit(None).cast("string")), "_none", names).drop("_none")


class GainModel:
    """A regressor from quality profiles to F1 gain, with its scaler, saved and loaded as one Spark ML model."""

    def __init__(self, kind: str = "rf", trees: int = 100, depth: int | None = None, seed: int = 42):
        if kind not in MARGINS:
            raise ValueError(f"unknown model kind {kind!r}")
        self.kind, self.trees, self.depth, self.seed = kind, trees, depth, seed
        self.model: PipelineModel | None = None

    def _pipeline(self) -> Pipeline:
        wanted = {"featuresCol": "scaled", "labelCol": "f1_improvement", "predictionCol": "predicted_f1_improvement"}
        if self.kind == "rf":
            learner = RandomForestRegressor(
                numTrees=self.trees, maxDepth=self.depth or DEEPEST, featureSubsetStrategy="all", seed=self.seed, **wanted
            )
        elif self.kind == "gb":
            learner = GBTRegressor(maxIter=self.trees, maxDepth=self.depth or 3, stepSize=0.1, seed=self.seed, **wanted)
        else:
            learner = LinearRegression(**wanted)
        return Pipeline(
            stages=[
                VectorAssembler(inputCols=list(FEATURES), outputCol="vector"),
                StandardScaler(inputCol="vector", outputCol="scaled", withMean=True, withStd=True),
                learner,
            ]
        )

    def train(self, history: DataFrame, folds: int = 5) -> DataFrame:
        """Fit on profiles with a measured ``f1_improvement``; reports train R2 and cross-validated R2 in one row."""
        data = quality_features(history, ["f1_improvement"]).filter("f1_improvement is not null")
        data = data.withColumn(
            "fold", F.pmod(F.conv(F.substring(hash_key(data.columns, self.seed), 1, 8), 16, 10).cast("long"), F.lit(folds))
        ).persist(StorageLevel.MEMORY_AND_DISK)
        stored = data
        try:
            rows = data.count()
            if rows == 0:
                raise ValueError("training data cannot be empty")
            data = sized(data, rows)
            self.model = self._pipeline().fit(data)
            train_r2, by_fold = self._cross_fitted(data) if self.kind == "lr" else self._refitted(data, folds)
            cv = by_fold.agg(F.avg("r2").alias("m"), F.stddev_pop("r2").alias("s")).first() if by_fold is not None else None
            return data.sparkSession.createDataFrame(
                [(self.kind, rows, len(FEATURES), train_r2, cv and cv["m"], cv and cv["s"])],
                "kind string, n_samples bigint, n_features int, train_r2 double, cv_r2_mean double, cv_r2_std double",
            )
        finally:
            stored.unpersist()

    def _cross_fitted(self, data: DataFrame) -> tuple[float | None, DataFrame]:
        """Train R2 and the R2 of every fold from the sums of products of the folds: no fold is fitted by a job of its own."""
        whole, by_fold = cross_fit_linear(data, FEATURES, "f1_improvement", "fold")
        return whole.r2, by_fold

    def _refitted(self, data: DataFrame, folds: int) -> tuple[float | None, DataFrame | None]:
        """The same by a fit per fold."""
        label = F.col("f1_improvement").alias("label")
        predicted = F.col("predicted_f1_improvement").alias("prediction")
        whole = regression_metrics(self.model.transform(data).select(label, predicted)).first()

        def refit(i: int) -> DataFrame | None:
            train, test = data.filter(F.col("fold") != i), data.filter(F.col("fold") == i)
            if train.isEmpty() or test.isEmpty():
                return None
            return self._pipeline().fit(train).transform(test).select(F.lit(i).alias("fold"), label, predicted)

        folded = together(data.sparkSession, [lambda i=i: refit(i) for i in range(folds)])
        scored = [t for t in folded if t is not None]
        return whole["r2"], regression_metrics(reduce(DataFrame.union, scored), ["fold"]) if scored else None

    def _trained(self) -> PipelineModel:
        if self.model is None:
            raise RuntimeError("the model must be trained first")
        return self.model

    def predict(self, profiles: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
        """Predicted gain of every profile, with interval and verdict."""
        scored = self._trained().transform(quality_features(profiles, keep))
        return with_verdict(scored.select(*[col(k) for k in keep], "predicted_f1_improvement", "quality_score"), self.kind)

    def importances(self, top: int = 5) -> DataFrame | None:
        """The most important features; linear models have none."""
        learner = self._trained().stages[-1]
        if not hasattr(learner, "featureImportances"):
            return None
        from pyspark.sql import SparkSession

        weights = [(n, float(w)) for n, w in zip(FEATURES, learner.featureImportances.toArray())]
        spark = SparkSession.getActiveSession()
        return spark.createDataFrame(weights, "feature string, importance double").orderBy(F.desc("importance"), "feature").limit(top)

    def save(self, path: str) -> None:
        """The fitted pipeline, and beside it the kind of model, on which the interval depends."""
        from pyspark.sql import SparkSession

        self._trained().write().overwrite().save(f"{path}/model")
        SparkSession.getActiveSession().createDataFrame([(self.kind,)], "kind string").write.mode("overwrite").parquet(f"{path}/kind")

    @classmethod
    def load(cls, path: str) -> GainModel:
        from pyspark.sql import SparkSession

        loaded = cls(SparkSession.getActiveSession().read.parquet(f"{path}/kind").first()["kind"])
        loaded.model = PipelineModel.load(f"{path}/model")
        return loaded


def with_verdict(predictions: DataFrame, kind: str = "rf") -> DataFrame:
    """Interval around the prediction and whether a repair is worth it."""
    p, size = F.col("predicted_f1_improvement"), F.abs(F.col("predicted_f1_improvement"))
    return predictions.withColumns(
        {
            "predicted_improvement_pct": p * 100.0,
            "interval_low": p - MARGINS[kind],
            "interval_high": p + MARGINS[kind],
            "verdict": F.when(size > 0.01, "worth fixing").when(size > 0.005, "maybe fix").otherwise("skip"),
            "severity": F.when(size > 0.01, "HIGH").when(size > 0.005, "MEDIUM").otherwise("LOW"),
        }
    )


def fix_if_worth(
    df: DataFrame,
    profile: DataFrame,
    model: GainModel,
    target: str,
    keys: Sequence[str],
    config: dict | None = None,
) -> tuple[DataFrame, float, str]:
    """The repaired table when the predicted gain is worth it, else the table as it is; with prediction and verdict."""
    verdict = model.predict(profile).first()
    worth = verdict["verdict"] == "worth fixing"
    fixed = apply_fixes(df, config, target, keys) if worth else df
    return fixed, verdict["predicted_f1_improvement"], verdict["verdict"]
