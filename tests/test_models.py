import pytest
from pyspark.sql import functions as F

from tablewright.functions import metrics as M
from tablewright.operators import corrupt as C
from tablewright.operators import impact as I
from tablewright.operators import tasks as K
from tablewright.operators.models import build_model, fold_count

SIZE = {"trees": 4, "depth": 3, "iterations": 10, "rounds": 2, "boost_depth": 2}


@pytest.fixture(scope="module")
def table(spark):
    """A class that follows x, with some NULLs and repeated rows."""
    base = spark.range(240).select(
        "id",
        F.when(F.col("id") % 11 != 0, F.col("id") % 20 * 1.0).alias("x"),
        F.when(F.col("id") % 3 == 0, "p").when(F.col("id") % 3 == 1, "q").alias("s"),
        F.when(F.col("id") % 20 > 9, "yes").otherwise("no").alias("y"),
    )
    return base.unionByName(base.filter("id % 10 = 0")).cache()


def test_metrics_against_hand_counts(spark):
    p = spark.createDataFrame([(0, 0)] * 3 + [(0, 1)] + [(1, 1)] * 2 + [(1, 0)] * 2 + [(2, 0)], "label int, prediction int")
    row = M.classification_metrics(p).first()
    assert row["accuracy"] == pytest.approx(5 / 9)
    # f1: class 0 = 2*3/(4+6), class 1 = 2*2/(4+3), class 2 = 0
    assert row["weighted_f1"] == pytest.approx((4 * 0.6 + 4 * 4 / 7 + 0) / 9)


def test_regression_metrics(spark):
    p = spark.createDataFrame([(1.0, 2.0), (3.0, 3.0), (5.0, 4.0)], "label double, prediction double")
    row = M.regression_metrics(p).first()
    assert row["rmse"] == pytest.approx((2 / 3) ** 0.5) and row["mae"] == pytest.approx(2 / 3)
    assert row["r2"] == pytest.approx(1 - 2 / 8)


def test_davies_bouldin(spark):
    points = spark.createDataFrame([(0.0, 0), (2.0, 0), (10.0, 1), (14.0, 1)], "x double, cluster int")
    assert M.davies_bouldin(points, ["x"]).first()[0] == pytest.approx((1 + 2) / 11)
    assert M.davies_bouldin(points.filter("cluster = 0"), ["x"]).first()[0] is None


def test_fold_rule():
    assert [fold_count(n) for n in (50, 250, 10_000)] == [2, 2, 5]
    with pytest.raises(ValueError):
        build_model("svm", 1, 2)


def test_impact_covers_models_and_metrics(table):
    fixed = table.na.drop("any").distinct()
    rows = I.analyze_impact(table, fixed, "y", ["id"], ("rf", "lr"), exclude=["id"], folds=2, **SIZE).collect()
    assert {(r["model"], r["metric"]) for r in rows} == {(m, k) for m in ("rf", "lr") for k in ("accuracy", "f1", "roc_auc")}
    assert all(0 <= r["original"] <= 1 and 0 <= r["fixed"] <= 1 for r in rows)
    forest = next(r for r in rows if r["model"] == "rf" and r["metric"] == "accuracy")
    assert forest["fixed"] > 0.9 and forest["improvement"] == pytest.approx(forest["fixed"] - forest["original"])


def test_generalization_and_unknown_target(table):
    row = I.generalization(table.distinct(), "y", ["id"], ("rf",), exclude=["id"], **SIZE).first()
    assert row["test_f1"] > 0.8 and row["train_rows"] + row["test_rows"] == 240
    with pytest.raises(ValueError):
        I.analyze_impact(table.drop("y"), table.drop("y"), "y", ["id"])


def test_corruption(table):
    clean = table.distinct().select("id", "x").na.drop()
    n = clean.count()
    assert C.corrupt(clean, "duplicates", ["id"]).count() == n + int(0.05 * n)
    hit = C.inject_outliers(clean, ["id"], share=0.5).join(clean.withColumnRenamed("x", "was"), "id")
    changed = hit.filter("x <> was")
    assert changed.count() > 0 and changed.filter("x <> was * 5").count() == 0
    noise = C.inject_noise(clean, ["id"]).join(clean.withColumnRenamed("x", "was"), "id").select((F.col("x") - F.col("was") * 0.95).alias("e"))
    spread = noise.agg(F.avg("e"), F.stddev_pop("e")).first()
    assert abs(spread[0]) < 0.003 and 0.007 < spread[1] < 0.013
    with pytest.raises(ValueError):
        C.corrupt(clean, "typos", ["id"])


def test_tasks(table):
    data = table.na.drop().distinct().withColumn("y", (F.col("y") == "yes").cast("int"))
    noisy = C.inject_noise(data, ["id"], columns=["x"])
    assert K.task_impact("clustering", data, data, noisy, ["x"], "y").count() == 2
    assert K.task_impact("regression", data, data, noisy, ["y"], "x", trees=3, depth=3).count() == 6
    with pytest.raises(ValueError):
        K.task_impact("ranking", data, data, noisy, ["x"], "y")


def test_copies_stay_in_one_fold(table):
    from tablewright.operators.models import cross_validate

    data = I.prepare_table(table, "y", ["id"], ["id"])
    found = cross_validate(data, ["lr"], folds=2, together_by=["_key0"], **SIZE).first()
    assert found["failed_folds"] == 0 and found["error"] is None and found["roc_auc"] > 0.5


def failing_fits(monkeypatch, fails):
    """Fits of the n-th model built fail where ``fails(n)``."""
    from tablewright.operators import models

    build, built = models.build_model, iter(range(1000))

    class Broken:
        def fit(self, df):
            raise ValueError("no memory left")

    monkeypatch.setattr(models, "build_model", lambda *args, **size: Broken() if fails(next(built)) else build(*args, **size))
    return models


def labelled(spark, rows=200):
    return spark.range(rows).select("id", (F.col("id") % 20).cast("double").alias("x"), F.when(F.col("id") % 20 > 9, "yes").otherwise("no").alias("y"))


def test_a_failed_fold_is_no_score(spark, monkeypatch):
    from tablewright.operators import impact

    ready = impact.prepare_table(labelled(spark), "y", ["id"], ["id"])
    models = failing_fits(monkeypatch, lambda n: n == 1)
    found = models.cross_validate(ready, ["lr", "rf"], folds=2, at_once=1, **SIZE)
    broken, whole = found.collect()
    assert [broken[m] for m in models.MEASURES] == [None] * 3 and broken["failed_folds"] == 1 and "fold 1: ValueError: no memory left" in broken["error"]
    assert whole["failed_folds"] == 0 and whole["error"] is None and whole["accuracy"] == 1.0
    with pytest.raises(RuntimeError, match="lr: 1 folds, fold 1: ValueError: no memory left"):
        models.every_fold(found)


def test_a_fold_without_rows_is_no_score(spark):
    from tablewright.operators import impact
    from tablewright.operators.models import cross_validate

    ready = impact.prepare_table(labelled(spark, 2), "y", ["id"], ["id"])
    found = cross_validate(ready, ["rf"], folds=3, **SIZE).first()
    assert found["failed_folds"] >= 1 and found["accuracy"] is None and "fold" in found["error"]


def test_impact_of_a_failed_fold_is_an_error(spark, monkeypatch):
    from tablewright.operators import impact

    failing_fits(monkeypatch, lambda n: n % 2)
    df, options = labelled(spark), {"folds": 2, "models": ["lr"], **SIZE}
    for run in (
        lambda: impact.analyze_impact(df, df.filter("id > 9"), "y", ["id"], exclude=["id"], **options),
        lambda: impact.analyze_impact(df, df, "y", ["id"], exclude=["id"], **options),
        lambda: impact.rank_issues(df, "y", ["id"], ["outliers"], exclude=["id"], **options),
        lambda: impact.compare_arms(df, "y", ["id"], exclude=["id"], **options),
    ):
        with pytest.raises(RuntimeError, match="no memory left"):
            run()


def test_a_query_with_a_failed_fold_is_an_error(spark, sf, monkeypatch):
    from catalog import QUERIES

    failing_fits(monkeypatch, lambda n: n == 1)
    with pytest.raises(RuntimeError, match="no memory left"):
        QUERIES["m06_cv_accuracy"](spark, sf)
