"""Linear fits from sums of products against numpy on the rows."""

import numpy as np
import pytest

from tablewright.operators.linear import cross_fit_linear, fit_linear

FEATURES = ["a", "b", "c"]


@pytest.fixture(scope="module")
def points():
    draw = np.random.default_rng(4)
    x = draw.normal(size=(300, 3)) * [1.0, 50.0, 0.1] + [1e6, -3.0, 0.0]
    y = x @ [0.5, -0.2, 4.0] + draw.normal(size=300) + 7.0
    return np.column_stack([x, y, np.arange(300) % 4])


def frame(spark, points):
    return spark.createDataFrame([tuple(float(v) for v in r) for r in points], "a double, b double, c double, y double, fold double")


def plane(x, y):
    x = np.column_stack([np.ones(len(x)), x - x.mean(axis=0)])
    return np.linalg.lstsq(x, y, rcond=None)[0]


def test_fit_equals_least_squares(spark, points):
    got = fit_linear(frame(spark, points), FEATURES, "y")
    want = plane(points[:, :3], points[:, 3])
    assert got.rows == 300 and got.coefficients == pytest.approx(want[1:], rel=1e-6)
    df = frame(spark, points)
    guessed = np.array([r[0] for r in df.select(got.predicted()).collect()])
    wanted = want[0] + (points[:, :3] - points[:, :3].mean(axis=0)) @ want[1:]
    assert sorted(guessed) == pytest.approx(sorted(wanted), abs=1e-5)


def test_folds_equal_fits_without_them(spark, points):
    _, table = cross_fit_linear(frame(spark, points), FEATURES, "y", "fold")
    got = {r["fold"]: r for r in table.collect()}
    for fold in range(4):
        out = points[:, 4] == fold
        x, y = points[:, :3], points[:, 3]
        want = plane(x[~out], y[~out])
        error = y[out] - want[0] - (x[out] - x[~out].mean(axis=0)) @ want[1:]
        assert got[fold]["rows"] == out.sum() and got[fold]["rmse"] == pytest.approx(np.sqrt(np.mean(error**2)), rel=1e-6)
        assert got[fold]["r2"] == pytest.approx(1 - np.sum(error**2) / np.sum((y[out] - y[out].mean()) ** 2), rel=1e-6)


def test_constant_and_repeated_features(spark):
    rows = [(float(i), 5.0, float(2 * i), 3.0 * i + 1, float(i % 2)) for i in range(40)]
    df = spark.createDataFrame(rows, "a double, b double, c double, y double, fold double")
    got, table = cross_fit_linear(df, FEATURES, "y", "fold")
    assert got.coefficients[1] == 0.0 and got.r2 == pytest.approx(1.0)
    assert [r["r2"] for r in table.collect()] == pytest.approx([1.0, 1.0])


def test_gaps_constant_labels_and_nothing(spark):
    df = spark.createDataFrame([(1.0, 2.0, 0), (None, 9.0, 0), (3.0, 2.0, 0), (4.0, None, 0)], "a double, y double, fold int")
    got, table = cross_fit_linear(df, ["a"], "y", "fold")
    assert got.rows == 2 and got.coefficients == [0.0] and got.r2 is None and table.count() == 0
    with pytest.raises(ValueError):
        fit_linear(df.limit(0), ["a"], "y")


def test_many_features(spark):
    draw = np.random.default_rng(1)
    x = draw.normal(size=(200, 20))
    w = draw.normal(size=20)
    names = [f"x{i}" for i in range(20)]
    df = spark.createDataFrame([(*map(float, r), float(r @ w + 2)) for r in x], ", ".join(f"{n} double" for n in [*names, "y"]))
    got = fit_linear(df, names, "y")
    assert got.coefficients == pytest.approx(w) and got.intercept == pytest.approx(2.0)
