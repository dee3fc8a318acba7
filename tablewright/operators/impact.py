"""What a repair is worth: the same models on a table before and after, their differences, and train/test generalization."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tablewright.functions.columns import col, numeric_columns, resolve_target, string_columns
from tablewright.functions.lineage import kept
from tablewright.functions.metrics import classification_metrics
from tablewright.functions.together import together
from tablewright.operators.corrupt import corrupt
from tablewright.operators.encode import apply_codes, code_sizes, code_table, fill_mode, prepare_features, row_counts, shared_target_codes
from tablewright.operators.fixes import apply_fixes
from tablewright.operators.models import assemble, build_model, cross_validate, every_fold, sized
from tablewright.operators.profile import score_table
from tablewright.operators.ranking import stratified_split

IMPACT_SCHEMA = "dataset string, model string, metric string, original double, fixed double"
ISSUES = ("missing_values", "outliers", "duplicates")
ID = "_id"


def _with_id(df: DataFrame, target: str, keys: Sequence[str], exclude: Sequence[str]) -> DataFrame:
    """Carry the row keys as one struct, a type no feature step touches, and drop the columns that are no features."""
    resolve_target(df, target)
    tagged = df.withColumn(ID, F.struct(*[col(k).alias(f"k{i}") for i, k in enumerate(keys)]))
    return tagged.drop(*exclude)


def _used(df: DataFrame, target: str, keys: Sequence[str], exclude: Sequence[str]) -> DataFrame:
    """Only what the evaluation reads: keys, target, and features that are not excluded."""
    features = [c for c in [*numeric_columns(df), *string_columns(df)] if c not in exclude]
    wanted = {*features, target, *keys}
    return df.select(*[col(c) for c in df.columns if c in wanted])


def _vectors(df: DataFrame, features: Sequence[str], target: str, keys: Sequence[str]) -> DataFrame:
    """Features a table lacks are 0, as for two tables aligned to the union of their columns."""
    lacking = [F.lit(0).alias(c) for c in features if c not in df.columns]
    identity = [F.col(f"{ID}.k{i}").alias(f"_k{i}") for i in range(len(keys))]
    return assemble(df.select("*", *lacking, *identity), features, target, [f"_k{i}" for i in range(len(keys))])


def _feature_names(*tables: DataFrame, target: str) -> list[str]:
    names = {c for t in tables for c in [*numeric_columns(t, [target]), *string_columns(t, [target])]}
    return sorted(names)


def prepare_pair(
    original: DataFrame, fixed: DataFrame, target: str, keys: Sequence[str], exclude: Sequence[str] = ()
) -> tuple[DataFrame, DataFrame]:
    """Both tables as ``features``, ``label`` and row keys: same feature columns, same target codes."""
    left, right = (fill_mode(_with_id(t, target, keys, exclude), target) for t in (original, fixed))
    left, right, _ = shared_target_codes(left, right, target)
    left, right = together(
        original.sparkSession, [lambda t=t: prepare_features(t, target, keep=[ID])[0] for t in (left, right)]
    )
    names = _feature_names(left, right, target=target)
    return _vectors(left, names, target, keys), _vectors(right, names, target, keys)


def prepare_table(df: DataFrame, target: str, keys: Sequence[str], exclude: Sequence[str] = ()) -> DataFrame:
    """One table as ``features``, ``label`` and row keys."""
    labelled = fill_mode(_with_id(df, target, keys, exclude), target)
    coded = apply_codes(labelled, target, code_table(labelled, column=target))
    ready, _ = prepare_features(coded, target, keep=[ID])
    return _vectors(ready, _feature_names(ready, target=target), target, keys)


def analyze_impact(
    original: DataFrame,
    fixed: DataFrame,
    target: str,
    keys: Sequence[str],
    models: Sequence[str] = ("rf", "lr"),
    exclude: Sequence[str] = (),
    dataset: str = "table",
    seed: int = 42,
    folds: int | None = None,
    known: dict | None = None,
    **size,
) -> DataFrame:
    """Per model and metric: value on the original table, on the fixed one, and the difference; a failed fold is an error.

    ``known`` has the metrics of a fixed table whose labels and features are those of the original (``measure_table``).
    """
    identity = [f"_key{i}" for i in range(len(keys))]
    for t in (original, fixed):
        resolve_target(t, target)
    if known is not None:
        scored = [measure_table(original, target, keys, models, exclude, seed, folds, **size), known]
        return _compared(original.sparkSession, dataset, models, scored)
    # Each table feeds many statistics and fits: it is computed once.  A table compared with itself is measured once.
    unchanged = fixed is original
    tables = [original] if unchanged else [original, fixed]
    with kept(*[_used(t, target, keys, exclude) for t in tables]) as used:
        sides = [prepare_table(used[0], target, keys, exclude)] if unchanged else prepare_pair(*used, target, keys, exclude)
        scored = together(
            original.sparkSession,
            [
                lambda t=t: {r["model"]: r for r in every_fold(cross_validate(t, models, identity, seed, folds, **size)).collect()}
                for t in sides
            ],
        )
    return _compared(original.sparkSession, dataset, models, scored)


def measure_table(
    df: DataFrame, target: str, keys: Sequence[str], models: Sequence[str] = ("rf", "lr"), exclude: Sequence[str] = (), seed: int = 42, folds: int | None = None, **size
) -> dict:
    """The cross-validated metrics of one table by itself, per model."""
    resolve_target(df, target)
    with kept(_used(df, target, keys, exclude)) as (used,):
        ready = prepare_table(used, target, keys, exclude)
        found = cross_validate(ready, models, [f"_key{i}" for i in range(len(keys))], seed, folds, **size)
        return {r["model"]: r for r in every_fold(found).collect()}


def _compared(spark: SparkSession, dataset: str, models: Sequence[str], scored: Sequence[dict]) -> DataFrame:
    rows = [
        (dataset, m, metric, scored[0][m][metric], scored[-1][m][metric])
        for m in models
        for metric in ("accuracy", "f1", "roc_auc")
    ]
    return with_improvement(spark.createDataFrame(rows, IMPACT_SCHEMA))


def with_improvement(impact: DataFrame) -> DataFrame:
    """Add the difference and its percentage, which is undefined for an original of 0."""
    gain = F.col("fixed") - F.col("original")
    return impact.withColumns(
        {
            "improvement": gain,
            "improvement_pct": F.when(F.col("original") > 0, F.try_divide(gain * 100.0, F.col("original"))),
        }
    )


def impact_report(impact: DataFrame, original: DataFrame, fixed: DataFrame) -> DataFrame:
    """The impact rows of F1 with both table shapes and the rows removed."""
    before, after = original.count(), fixed.count()
    return impact.filter("metric = 'f1'").select(
        "dataset",
        "model",
        F.lit(before).alias("rows_original"),
        F.lit(len(original.columns)).alias("columns_original"),
        F.lit(after).alias("rows_fixed"),
        F.lit(len(fixed.columns)).alias("columns_fixed"),
        F.lit(before - after).alias("rows_removed"),
        F.col("original").alias("f1_original"),
        F.col("fixed").alias("f1_fixed"),
        F.col("improvement").alias("f1_improvement"),
        F.col("improvement_pct").alias("f1_improvement_pct"),
    )


def issue_impact(
    df: DataFrame,
    issue: str,
    target: str,
    keys: Sequence[str],
    models: Sequence[str] = ("rf",),
    exclude: Sequence[str] = (),
    **options,
) -> DataFrame:
    """Metrics on the clean table against metrics on the table with one issue injected."""
    body = df.drop(*[c for c in exclude if c not in keys])
    # The target and the keys identify and label rows; only features are corrupted.
    corrupted = corrupt(body, issue, [*keys, target]) if issue != "duplicates" else corrupt(body, issue, keys)
    return analyze_impact(corrupted, body, target, keys, models, exclude=[c for c in exclude if c in keys], dataset=issue, **options)


def rank_issues(df: DataFrame, target: str, keys: Sequence[str], issues: Sequence[str] = ISSUES, **options) -> DataFrame:
    """Issues by the F1 they cost, averaged over the models; rank 1 costs most.

    Corruption leaves labels and columns as they are, so the clean table is measured once for all issues.
    """
    exclude = options.get("exclude", ())
    clean = df.drop(*[c for c in exclude if c not in keys])
    rest = {"models": ("rf",), **options, "exclude": [c for c in exclude if c in keys]}
    known = measure_table(clean, target, keys, **{k: v for k, v in rest.items() if k != "dataset"})
    rows = reduce(DataFrame.unionByName, [issue_impact(df, i, target, keys, known=known, **options) for i in issues])
    cost = rows.filter("metric = 'f1'").groupBy(F.col("dataset").alias("issue")).agg(F.avg("improvement").alias("f1_cost"))
    # One row per issue type, so a global window is fine.
    return cost.withColumn("rank", F.rank().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("f1_cost"))))


def compare_arms(
    df: DataFrame,
    target: str,
    keys: Sequence[str],
    arms: dict[str, Callable[[DataFrame], DataFrame]] | None = None,
    **options,
) -> DataFrame:
    """The same models after no cleaning, after dropping incomplete rows, and after the full set of repairs."""
    arms = arms or {
        "none": lambda t: t,
        "drop_missing": lambda t: t.na.drop("any"),
        "full": lambda t: apply_fixes(t, {"missing_values": "drop", "duplicates": True, "outliers": True}, target, keys),
    }
    rows = [analyze_impact(df, arm(df), target, keys, dataset=name, **options) for name, arm in arms.items()]
    return reduce(DataFrame.unionByName, rows).withColumnRenamed("dataset", "arm")


# ---- train/test generalization ------------------------------------------------------------------------------------


def split_and_fix(
    df: DataFrame, target: str, keys: Sequence[str], config: dict | None = None, seed: int = 42
) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Train and test parts (stratified 80/20), each also after the same repairs."""
    flagged = stratified_split(df, target, keys, 0.2, seed)
    train, test = (flagged.filter(F.col("is_test") == part).drop("is_test") for part in (False, True))
    return train, test, apply_fixes(train, config, target, keys), apply_fixes(test, config, target, keys)


def prepare_train_test(
    train: DataFrame, test: DataFrame, target: str, keys: Sequence[str], exclude: Sequence[str] = ()
) -> tuple[DataFrame, DataFrame]:
    """Means and encoders are fitted on the train part and applied to the test part; an unseen value gets the next free code."""
    left, right = (_with_id(t, target, keys, exclude).filter(col(target).isNotNull()) for t in (train, test))
    codes = code_table(left, column=target)
    size = code_sizes(codes)[0]
    left, right = apply_codes(left, target, codes, size), apply_codes(right, target, codes, size)
    left, fitted = prepare_features(left, target, keep=[ID])
    right, _ = prepare_features(right, target, fitted, keep=[ID])
    names = _feature_names(left, target=target)
    return _vectors(left, names, target, keys), _vectors(right, names, target, keys)


def generalization(
    df: DataFrame,
    target: str,
    keys: Sequence[str],
    models: Sequence[str] = ("rf", "lr"),
    exclude: Sequence[str] = (),
    config: dict | None = None,
    dataset: str = "table",
    seed: int = 42,
    with_score: bool = True,
    **size,
) -> DataFrame:
    """Fit on the repaired train part, measure on the repaired test part; a failing model scores 0.

    One row per model with the train score and the shapes of all four parts.
    """
    rows = []
    with kept(stratified_split(df, target, keys, 0.2, seed)) as (flagged,):
        train, test = (flagged.filter(F.col("is_test") == part).drop("is_test") for part in (False, True))
        score = score_table(train.drop(*keys), target).first()["quality_score"] if with_score else None
        fixes = [apply_fixes(t, config, target, keys) for t in (train, test)]
        with kept(*fixes) as (train_fixed, test_fixed):
            shapes = row_counts(train, test, train_fixed, test_fixed)
            fit_part, eval_part = prepare_train_test(train_fixed, test_fixed, target, keys, exclude)
            with kept(sized(fit_part, shapes[2])) as (fit_part,):
                counts = {r["label"]: r["count"] for r in fit_part.groupBy("label").count().collect()}
                for name in models:
                    try:
                        model = build_model(name, sum(counts.values()), len(counts), seed, **size).fit(fit_part)
                        found = classification_metrics(model.transform(eval_part).select("label", "prediction")).first()
                        rows.append((dataset, name, score, found["weighted_f1"], found["accuracy"], *shapes))
                    except Exception as error:  # a failing model scores 0, the others go on
                        print(f"{name} failed: {type(error).__name__}: {error}"[:200])
                        rows.append((dataset, name, score, 0.0, 0.0, *shapes))
    return df.sparkSession.createDataFrame(
        rows,
        "dataset string, model string, train_quality_score double, test_f1 double, test_accuracy double, "
        "train_rows bigint, test_rows bigint, train_rows_fixed bigint, test_rows_fixed bigint",
    )


def generalization_summary(results: DataFrame) -> DataFrame:
    """Averages over the models, one row per dataset."""
    return results.groupBy("dataset").agg(
        F.first("train_quality_score").alias("train_quality_score"),
        F.avg("test_f1").alias("avg_test_f1"),
        F.avg("test_accuracy").alias("avg_test_accuracy"),
        *[F.max(c).alias(c) for c in ("train_rows", "test_rows", "train_rows_fixed", "test_rows_fixed")],
    )
