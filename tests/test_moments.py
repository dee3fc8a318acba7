"""Pair moments and joint quantiles of wide tables against numpy, and how often they read the table."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from tablewright.operators import profile as P
from tablewright.operators import quantiles as Q
from tablewright.operators.flat import segment_profiles
from tablewright.operators.moments import pair_moments


@pytest.fixture(scope="module")
def wide(spark):
    """19 columns: complete and with gaps, large offsets, constants, constants where the partner is present, no values."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, 19)) + rng.normal(size=(400, 1))
    x[:, 1] += 1e9
    x[:, 2] = 0.1
    x[:, 3] = x[:, 0] * -2 + 7
    x[rng.random((400, 19)) < 0.2 * (np.arange(19) % 3 == 1)] = np.nan
    x[:, 5] = np.where(np.isnan(x[:, 4]), x[:, 5], 0.3)  # constant wherever column 4 has a value
    x[:, 6] = np.nan
    rows = [[None if np.isnan(v) else float(v) for v in r] for r in x]
    df = spark.createDataFrame([(i % 3, *r) for i, r in enumerate(rows)], "part int, " + ", ".join(f"c{i} double" for i in range(19)))
    return x, df.repartition(5)


def absolute(x, y):
    both = ~np.isnan(x) & ~np.isnan(y)
    x, y = x[both], y[both]
    if len(x) == 0 or x.min() == x.max() or y.min() == y.max():
        return None
    return abs(np.corrcoef(x, y)[0, 1])


def close(a, b):
    return a is b is None or (a is not None and b is not None and a == pytest.approx(b, abs=1e-6))


def test_all_pairs(wide):
    x, df = wide
    found = {(r["feature1"], r["feature2"]): r["abs_corr"] for r in P.correlation_pairs(df.drop("part")).collect()}
    assert list(sorted(found)) == sorted((f"c{i}", f"c{j}") for i, j in itertools.combinations(range(19), 2))
    for (a, b), r in found.items():
        assert close(r, absolute(x[:, int(a[1:])], x[:, int(b[1:])])), (a, b)


def test_pairs_by_group(wide):
    x, df = wide
    names = [f"c{i}" for i in range(8)]
    for r in pair_moments(df, names, {"c1": 1e9}, ["part"]).collect():
        a, b = (x[:, int(r[f][1:])] for f in ("feature1", "feature2"))
        mine = np.arange(400) % 3 == r["part"]
        both = mine & ~np.isnan(a) & ~np.isnan(b)
        assert r["n"] == both.sum()
        if r["n"]:
            assert r["covariance"] == pytest.approx(np.cov(a[both], b[both], bias=True)[0, 1], abs=1e-6)
            assert r["variance1"] == pytest.approx(a[both].var(), abs=1e-6) and r["variance2"] == pytest.approx(b[both].var(), abs=1e-6)


def jobs(spark, name, action):
    spark.sparkContext.setJobGroup(name, name)
    action()
    spark.sparkContext.setJobGroup("other", "other")
    return len(spark.sparkContext.statusTracker().getJobIdsForGroup(name))


def scans(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Range (")


def test_scans_do_not_grow_with_the_width(spark):
    table = lambda width: spark.range(3000).select(*[(F.col("id") * (i + 1) % 997 / 3).alias(f"c{i}") for i in range(width)])
    assert scans(P.correlation_pairs(table(40))) == scans(P.correlation_pairs(table(4))) == 1
    few = jobs(spark, "few", lambda: Q.quantiles(table(3), ["c0", "c1", "c2"], (0.25, 0.75), small_bytes=0))
    many = table(30)
    assert jobs(spark, "many", lambda: Q.quantiles(many, many.columns, (0.25, 0.75), small_bytes=0)) <= few + 1


def test_joint_quantiles(wide, monkeypatch):
    x, df = wide
    monkeypatch.setattr(Q, "SORTABLE", 20)
    monkeypatch.setattr(Q, "GRID", 20)
    monkeypatch.setattr(Q, "SKETCH_ACCURACY", 50)
    names, wanted = [f"c{i}" for i in range(19)], (0.1, 0.25, 0.5, 0.75)
    for small in (None, 0):
        found = Q.quantiles(df, names, wanted, small_bytes=small)
        for i, name in enumerate(names):
            values = x[~np.isnan(x[:, i]), i]
            assert found[name] == ([None] * 4 if not len(values) else pytest.approx(list(np.quantile(values, wanted)), rel=1e-12))


def test_segments_flag_the_same_pairs(spark):
    rows = [(s, float(i), float(i * (1 if s == "a" else -1) + (i % 2)), float(i * 7 % 11)) for s in "ab" for i in range(50)]
    df = spark.createDataFrame(rows, "s string, x double, y double, z double")
    found = {r["s"]: r["high_correlation_pct"] for r in segment_profiles(df, "s", "z").collect()}
    assert found == {"a": pytest.approx(100 / 3), "b": pytest.approx(100 / 3)}
