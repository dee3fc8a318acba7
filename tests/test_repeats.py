"""Repeated rows are counted exactly, also where different rows share a digest."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tablewright.operators import profile as P
from tablewright.operators import repeats as R
from tablewright.operators.flat import segment_profiles

ONE = lambda values: [F.lit(0).cast("long"), F.lit(0).cast("long")]
FEW = lambda values: [F.pmod(F.xxhash64(*values), F.lit(7)), F.lit(0).cast("long")]
DIGESTS = [R.two_hashes, ONE, FEW]


@pytest.fixture(scope="module")
def wide(spark):
    draw = random.Random(5)
    data = [
        (draw.choice(["s", "t", None]), draw.choice(["x " * 50, "y", "", None]), draw.randrange(4), draw.choice([0.0, -0.0, None]), i if i % 2 else 0)
        for i in range(600)
    ]
    return spark.createDataFrame(data, "seg string, t string, n int, d double, i int").repartition(4).cache()


def beyond_first(rows):
    return sum(n - 1 for n in Counter(rows).values())


@pytest.mark.parametrize("digest", DIGESTS)
@pytest.mark.parametrize("limit", [R.BROADCAST_DIGESTS, 0])
def test_count_repeats(spark, wide, monkeypatch, digest, limit):
    monkeypatch.setattr(R, "BROADCAST_DIGESTS", limit)
    want = beyond_first(tuple(r) for r in wide.collect())
    assert R.count_repeats(wide, digest=digest).first()["repeats"] == want > 100
    assert R.count_repeats(wide, exact=True).first()["repeats"] == want


@pytest.mark.parametrize("digest", DIGESTS)
def test_count_repeats_by_segment(wide, digest):
    per = {}
    for r in wide.collect():
        per.setdefault(r["seg"], []).append(tuple(r))
    got = {r["seg"]: r["repeats"] for r in R.count_repeats(wide, ["seg"], digest=digest).collect()}
    assert got == {s: beyond_first(rows) for s, rows in per.items()}


@pytest.mark.parametrize("digest", DIGESTS)
@pytest.mark.parametrize("look", [2, R.FIRST_LOOK])
def test_all_different(spark, monkeypatch, digest, look):
    monkeypatch.setattr(R, "FIRST_LOOK", look)
    alone = spark.range(300).selectExpr("concat('text ', id) AS t")
    assert R.all_different(alone, digest)
    assert not R.all_different(alone.union(alone.filter("t = 'text 7'")), digest)


def test_nothing_and_no_repeats(spark):
    empty = spark.createDataFrame([], "a string, b string, c string, d string, e string")
    assert R.count_repeats(empty).first()["repeats"] == 0 and R.all_different(empty)
    assert P.duplicate_summary(empty).first()["rows"] == 0
    single = spark.range(50).selectExpr("string(id) AS a", "id", "id AS c", "id AS d", "id AS e")
    assert R.count_repeats(single).first()["repeats"] == 0
    segments = segment_profiles(single.withColumn("seg", F.col("id") % 2), "seg", "a").collect()
    assert [r["duplicates"] for r in segments] == [0.0, 0.0]


def test_only_digests_of_single_rows_are_shuffled(spark):
    rows = spark.range(100).selectExpr("repeat(string(id), 100) AS t", "id AS a", "id AS b", "id AS c", "id AS d")
    marked, digests = R._digested(rows, R.two_hashes)
    exchanges = [line for line in digests._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange" in line]
    assert exchanges and all("_d0" in line and "t#" not in line for line in exchanges)
