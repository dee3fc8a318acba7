"""Grouped folds: no group in two folds, classes balanced within the largest group."""

import random
from collections import Counter, defaultdict

import pytest

from tablewright.operators.encode import Size, apply_codes, code_table, encode_categoricals
from tablewright.operators.groups import grouped_folds, grouped_split


@pytest.fixture(scope="module")
def copied(spark):
    draw = random.Random(8)
    rows = []
    for i in range(250):
        size = 300 if i == 0 else draw.choice([1, 1, 1, 2, 5])
        rows += [(i, f"t{i}" if i % 9 else None, draw.choice("ab") if i < 200 else "a")] * size
    draw.shuffle(rows)
    return spark.createDataFrame(rows, "id int, s string, y string").repartition(4)


def check(rows, group, largest, k):
    folds = defaultdict(set)
    per = defaultdict(Counter)
    for r in rows:
        folds[group(r)].add(r["fold"])
        per[r["y"]][r["fold"]] += 1
    assert all(len(f) == 1 for f in folds.values())
    for label, counts in per.items():
        assert set(counts) <= set(range(k))
        assert max(counts.values()) - min(counts[f] for f in range(k)) <= largest[label]


@pytest.mark.parametrize("blocks", [1, 100])
@pytest.mark.parametrize("k", [2, 5])
def test_copies_share_a_fold(copied, k, blocks):
    rows = grouped_folds(copied, "y", k, blocks=blocks).collect()
    assert len(rows) == copied.count()
    sizes = Counter((r["id"], r["s"], r["y"]) for r in rows)
    largest = {y: max(n for (_, _, label), n in sizes.items() if label == y) for y in "ab"}
    check(rows, lambda r: (r["id"], r["s"], r["y"]), largest, k)


def test_named_columns_make_groups_of_several_classes(spark):
    df = spark.range(400).selectExpr("id", "id % 37 AS g", "IF(id % 5 = 0, 'a', 'b') AS y")
    rows = grouped_folds(df, "y", 4, ["g"]).collect()
    folds = defaultdict(set)
    for r in rows:
        folds[r["g"]].add(r["fold"])
    assert len(rows) == 400 and len(folds) == 37 and all(len(f) == 1 for f in folds.values())


def test_rows_without_a_group_value_stay_together(spark):
    df = spark.range(60).selectExpr("IF(id < 20, NULL, id) AS g", "'a' AS y", "map('k', id) AS m")
    rows = grouped_folds(df, "y", 3, ["g"]).collect()
    assert len({r["fold"] for r in rows if r["g"] is None}) == 1 and len(rows) == 60
    assert grouped_folds(df, "y", 3).count() == 60


def test_split_and_nothing(spark, copied):
    test = grouped_split(copied.filter("id > 0"), "y").collect()
    share = sum(r["is_test"] for r in test) / len(test)
    assert 0.15 < share < 0.25
    assert grouped_folds(copied.limit(0), "y", 3).count() == 0


def test_long_values_are_not_broadcast(spark):
    df = spark.createDataFrame([("MISSING",)] * 90 + [("word " * 20_000 + str(i),) for i in range(10)], "s string")
    codes = code_table(df, column="s")
    joined = apply_codes(df, "s", codes, Size(11, 10**9))
    assert "strategy=broadcast" not in joined._jdf.queryExecution().optimizedPlan().toString()
    assert "strategy=broadcast" in apply_codes(df, "s", codes, Size(11, 100))._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(r["s"] for r in joined.collect()) == [0] * 90 + list(range(1, 11))
    _, fitted = encode_categoricals(df, ["s"])
    assert fitted["s"][1].rows == 11 and fitted["s"][1].text_bytes > 10**6
