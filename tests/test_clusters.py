"""The silhouette against all pairs in numpy."""

import numpy as np
import pytest

from tablewright.operators import clusters as C


def plainly(x, c):
    values = []
    for i in range(len(x)):
        d = np.sqrt(((x - x[i]) ** 2).sum(axis=1))
        own = c == c[i]
        if own.sum() == 1:
            values.append(0.0)
            continue
        a = d[own].sum() / (own.sum() - 1)
        b = min(d[c == k].mean() for k in set(c) - {c[i]})
        values.append((b - a) / max(a, b) if max(a, b) > 0 else 0.0)
    return np.array(values)


@pytest.fixture(scope="module")
def data():
    draw = np.random.default_rng(9)
    x = np.round(draw.normal(size=(400, 3)) + draw.integers(0, 3, 400)[:, None] * 2, 1)
    x[100:200] = x[0]  # copies of one point
    return x, np.append(draw.integers(0, 3, 399), 7)  # and a point alone in its cluster


def frame(spark, data):
    return spark.createDataFrame([(*map(float, r), int(k)) for r, k in zip(*data)], "a double, b double, c double, cluster int").repartition(3)


@pytest.mark.parametrize("block", [50, 2000])
def test_silhouette_equals_all_pairs(spark, data, monkeypatch, block):
    monkeypatch.setattr(C, "BLOCK", block)
    got = C.silhouette(frame(spark, data), ["a", "b", "c"]).first()
    assert got["points"] == 400 and got["silhouette"] == pytest.approx(plainly(*data).mean())


def test_sampled_points_meet_all_rows(spark, data):
    got = C.silhouette(frame(spark, data), ["a", "b", "c"], evaluated=150).first()
    assert 150 <= got["points"] < 400 and got["silhouette"] == pytest.approx(plainly(*data).mean(), abs=0.1)


def test_one_cluster_gaps_and_nothing(spark):
    df = spark.createDataFrame([(1.0, 0), (2.0, 0), (None, 1), (3.0, None)], "a double, cluster int")
    assert C.silhouette(df, ["a"]).first()["silhouette"] is None
    assert C.silhouette(df.limit(0), ["a"]).first()["points"] == 0
    same = spark.createDataFrame([(1.0, 0), (1.0, 0), (1.0, 1), (1.0, 1)], "a double, cluster int")
    assert C.silhouette(same, ["a"]).first()["silhouette"] == 0.0
