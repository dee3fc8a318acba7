"""Steps that many queries share read their input once and carry no more than they need."""

import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from catalog import learn
from tablewright.functions import lineage
from tablewright.operators import impact, models
from tablewright.operators.moments import pair_moments


def executed(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_pairs_of_few_columns_are_summed_alone(spark):
    rows = [(i % 2, None if i % 7 == 3 else float(i), float(i * i % 11)) for i in range(40)]
    df = spark.createDataFrame(rows, "part int, x double, y double")
    found = pair_moments(df, ["x", "y"], {"x": 20.0}, ["part"])
    plan = executed(found)
    # One pair needs its own sums only; the rows are not handed to a block of nine pairs.
    assert "explode" not in plan and plan.count("max(") == 2
    for r in found.collect():
        both = [(x, y) for part, x, y in rows if part == r["part"] and x is not None]
        mx, my = (sum(v) / len(both) for v in zip(*both))
        assert r["n"] == len(both)
        assert r["covariance"] == pytest.approx(sum((x - mx) * (y - my) for x, y in both) / len(both))
        assert r["variance1"] == pytest.approx(sum((x - mx) ** 2 for x, _ in both) / len(both))
        assert r["variance2"] == pytest.approx(sum((y - my) ** 2 for _, y in both) / len(both))


def test_pairs_of_few_columns_of_odd_tables(spark):
    df = spark.createDataFrame([(1, None, 2.0), (1, 3.0, None)], "part int, x double, y double")
    assert [(r["n"], r["covariance"], r["variance1"]) for r in pair_moments(df, ["x", "y"], {}, ["part"]).collect()] == [(0, None, None)]
    assert pair_moments(df.limit(0), ["x", "y"], {}).collect() == []
    assert pair_moments(df, ["x"], {}).collect() == []


def test_measured_gains_are_computed_once(spark, sf, monkeypatch):
    monkeypatch.setattr(lineage, "shared_checkpoints", lambda _: True)
    gains = learn.measured_gains(spark, sf)
    assert "orders.parquet" not in executed(gains) and "Aggregate" not in executed(gains)
    assert gains.count() > 0 and gains.where(F.col("f1_improvement").isNull()).count() == 0


def test_fits_do_not_carry_the_plan_of_the_folds(spark, monkeypatch):
    """Counters of the plan that dealt the folds would come back from every task of every fit."""
    monkeypatch.setattr(lineage, "shared_checkpoints", lambda _: True)
    seen, build = [], models.build_model

    class Watched:
        def __init__(self, model):
            self.model = model

        def fit(self, df):
            seen.append(executed(df))
            return self.model.fit(df)

    monkeypatch.setattr(models, "build_model", lambda *args, **size: Watched(build(*args, **size)))
    df = spark.range(400).select(F.col("id").alias("_key0"), (F.col("id") % 2).cast("double").alias("label"), (F.col("id") % 7).cast("double").alias("x"))
    ready = VectorAssembler(inputCols=["x"], outputCol="features").transform(df)
    found = models.cross_validate(ready, ["lr"], folds=2, iterations=3).collect()
    assert found[0]["failed_folds"] == 0 and len(seen) == 2
    assert all("Window" not in plan and "Range" not in plan for plan in seen)


def test_partitions_of_fits():
    assert [models.fit_partitions(n, 12) for n in (0, 30_000, 1_000_000, 54_000_000)] == [1, 2, 24, 270]


def test_clean_table_is_measured_once(spark, monkeypatch):
    base = spark.range(240).select("id", (F.col("id") % 20).cast("double").alias("x"), F.when(F.col("id") % 20 > 9, "yes").otherwise("no").alias("y"))
    options = {"exclude": ["id"], "folds": 2, "trees": 2, "depth": 2}
    alone = [impact.issue_impact(base, i, "y", ["id"], **options) for i in ("missing_values", "outliers")]
    want = {r["dataset"]: r["improvement"] for t in alone for r in t.collect() if r["metric"] == "f1"}
    runs, validate = [], impact.cross_validate
    monkeypatch.setattr(impact, "cross_validate", lambda *args, **size: runs.append(1) or validate(*args, **size))
    ranked = impact.rank_issues(base, "y", ["id"], ("missing_values", "outliers"), **options).collect()
    assert len(runs) == 3
    assert {r["issue"]: r["f1_cost"] for r in ranked} == pytest.approx(want)
