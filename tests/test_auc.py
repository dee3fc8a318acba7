"""The area under the ROC curve against all pairs."""

import random

import pytest

from tablewright.operators.auc import class_auc, rank_sum_auc
from tablewright.operators.sequence import totals_before

LOWEST = float("-inf")


def by_pairs(rows):
    yes = [LOWEST if s is None else s for s, p in rows if p]
    no = [LOWEST if s is None else s for s, p in rows if not p]
    won = sum((a > b) + (a == b) / 2 for a in yes for b in no)
    return won / (len(yes) * len(no)) if yes and no else None


@pytest.fixture(scope="module")
def scored():
    draw = random.Random(11)
    rows = [(f, draw.choice([None, draw.randrange(6) / 4, draw.random()]), draw.choice([True, False, False, None])) for f in (0, 1, None) for _ in range(200)]
    return rows + [(7, 0.5, True), (7, 0.1, True)]


@pytest.mark.parametrize("blocks", [None, 1, 5, 400])
def test_rank_sum_equals_pairs(spark, scored, blocks):
    df = spark.createDataFrame(scored, "fold int, score double, positive boolean").repartition(3)
    got = {r["fold"]: r for r in rank_sum_auc(df, ["fold"], blocks=blocks).collect()}
    for fold in (0, 1, None, 7):
        rows = [(s, bool(p)) for f, s, p in scored if f == fold]
        assert got[fold]["rows"] == len(rows) and got[fold]["positives"] == sum(p for _, p in rows)
        assert got[fold]["auc"] == (None if fold == 7 else pytest.approx(by_pairs(rows)))


def test_two_classes_use_the_second(spark):
    df = spark.createDataFrame([(1.0, [0.2, 0.8]), (0.0, [0.6, 0.4]), (1.0, [0.6, 0.4])], "label double, scores array<double>")
    assert class_auc(df, [0.0, 1.0]).first()["roc_auc"] == pytest.approx(0.75)


def test_many_classes_are_weighted_and_an_absent_one_adds_nothing(spark):
    draw = random.Random(2)
    rows = [(float(draw.choice([0, 0, 1, 3])), [draw.randrange(9) / 8 for _ in range(4)]) for _ in range(150)]
    df = spark.createDataFrame(rows, "label double, scores array<double>")
    want = sum(
        by_pairs([(s[c], y == c) for y, s in rows]) * sum(y == c for y, _ in rows) / len(rows) for c in (0, 1, 3)
    )
    assert class_auc(df, [0.0, 1.0, 2.0, 3.0]).first()["roc_auc"] == pytest.approx(want)


def test_nothing_to_measure(spark):
    assert rank_sum_auc(spark.createDataFrame([], "fold int, score double, positive boolean"), ["fold"]).count() == 0


@pytest.mark.parametrize("blocks", [1, 3, 300])
def test_totals_before(spark, blocks):
    df = spark.createDataFrame([(i * i % 1009, i % 2, i) for i in range(500)], "o int, k int, n int").dropDuplicates(["o", "k"])
    rows = df.collect()
    for r in totals_before(df, "o", ["n"], ["k"], blocks).collect():
        assert r["n_before"] == sum(x["n"] for x in rows if x["k"] == r["k"] and x["o"] < r["o"])
