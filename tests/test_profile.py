import math

import pytest
from pyspark.sql import functions as F

from tablewright.functions.columns import null_nan
from tablewright.operators import profile as P
from tablewright.operators import quantiles as Q
from tablewright.operators.flat import flat_profile, segment_profiles


@pytest.fixture(scope="module")
def small(spark):
    rows = [
        (1, 1.0, "a", "x"),
        (2, None, "b", "x"),
        (3, float("nan"), "c", "x"),
        (4, 4.0, None, "y"),
        (4, 4.0, None, "y"),
        (6, 1000.0, "e", None),
    ]
    return null_nan(spark.createDataFrame(rows, "k int, v double, s string, t string"))


def test_nan_counts_as_missing(small):
    found = {r["column"]: r["missing"] for r in P.missing_counts(small).collect()}
    assert found == {"k": 0, "v": 2, "s": 2, "t": 1}


def test_missing_summary(small):
    row = P.missing_summary(small).first()
    assert row["overall_missing_pct"] == pytest.approx(100 * 5 / 24)
    assert row["severity"] == "critical"


@pytest.mark.parametrize("exact", [False, True])
def test_duplicates_treat_null_as_equal(small, exact):
    row = P.duplicate_summary(small, exact).first()
    assert (row["rows"], row["duplicate_rows"], row["severity"]) == (6, 1, "high")


def test_swapped_nulls_are_no_duplicates(spark):
    df = spark.createDataFrame([(1, None, "a", None, None), (None, 1, None, "a", None)], "a int, b int, c string, d string, e string")
    assert P.duplicate_summary(df).first()["duplicate_rows"] == 0


def test_duplicates_with_maps(spark):
    df = spark.sql("SELECT map('a', 1, 'b', 2) AS m, 'x' AS s UNION ALL SELECT map('b', 2, 'a', 1), 'x'")
    assert P.duplicate_summary(df).first()["duplicate_rows"] == 1
    assert P.duplicate_summary(df, exact=True).first()["duplicate_rows"] == 1


def test_id_like_needs_every_row_different(small, spark):
    assert P.id_like_columns(small).count() == 0
    df = spark.range(500).select(F.col("id").cast("string").alias("u"), F.lit("c").alias("c"))
    assert [tuple(r) for r in P.id_like_columns(df).collect()] == [("u", 500)]


def test_outliers_ignore_null_and_are_strict(spark):
    df = spark.createDataFrame([(float(x),) for x in [1, 2, 3, 4, 100]] + [(None,)], "v double")
    rows = P.outlier_counts(df).collect()
    assert rows[0]["outliers"] == 1 and rows[0]["outlier_pct"] == pytest.approx(100 / 6)
    edge = spark.createDataFrame([(0.0,), (1.0,), (2.0,), (3.0,), (5.5,)], "v double")
    # quartiles 1 and 3, upper fence 6: 5.5 is inside
    assert P.outlier_counts(edge).first()["outliers"] == 0


def test_constant_and_empty_columns(spark):
    df = spark.createDataFrame([(1.0, None, 3), (1.0, None, 4)], "c double, e double, x int")
    assert P.outlier_summary(df).first()["total_outliers"] == 0
    assert [r["abs_corr"] for r in P.correlation_pairs(df).collect()] == [None, None, None]


def test_empty_table(spark):
    df = spark.createDataFrame([], "a int, b string")
    row = P.score_table(df).first()
    assert row["missing_pct"] is None and row["quality_score"] is None
    assert P.profile(df).count() > 0


def test_class_balance(small):
    row = P.class_balance(small, "t").first()
    assert row["imbalance_ratio"] == 1.5 and row["severity"] == "low"
    many = small.sparkSession.range(100).select(F.col("id"))
    assert P.class_balance(many, "id").first()["eligible"] is False
    assert P.class_balance(many.select((F.col("id") % 19).alias("c"))).first()["eligible"] is True
    assert P.class_balance(many.select((F.col("id") % 20).alias("c"))).first()["eligible"] is False


def test_correlation_is_pairwise_complete(spark):
    df = spark.createDataFrame([(1.0, 2.0, None), (2.0, 4.0, 1.0), (3.0, 6.0, 5.0), (None, 1.0, 2.0)], "a double, b double, c double")
    found = {(r["feature1"], r["feature2"]): r["abs_corr"] for r in P.correlation_pairs(df).collect()}
    assert found[("a", "b")] == pytest.approx(1.0)
    assert found[("a", "c")] == pytest.approx(1.0)


def test_correlation_survives_large_offsets(spark):
    df = spark.range(1000).select((F.col("id") + 10**12).alias("a"), (F.col("id") * 2 - 10**12).alias("b"))
    assert P.correlation_pairs(df).first()["abs_corr"] == pytest.approx(1.0, abs=1e-9)


@pytest.mark.parametrize(
    ("missing", "dup", "outliers", "ratio", "pairs", "score"),
    [
        (0.0, 0.075, 0, 0.76 / 0.24, 0, 89.85),
        (0.0, 0.0, 5, 1.6, 0, 90.0),
        (0.0, 0.0, 5, 499.0, 0, 75.0),
        (90.0, 50.0, 1, 9.0, 9, 25.0),
        (0.0, 0.0, 0, 1.0, 3, 100.0),
    ],
)
def test_score_goldens(spark, missing, dup, outliers, ratio, pairs, score):
    from tablewright.functions.scoring import quality_score

    found = spark.range(1).select(quality_score(*[F.lit(x) for x in (missing, dup, outliers, ratio, pairs)])).first()[0]
    assert found == pytest.approx(score)


def test_flat_profile_agrees_with_detectors(small):
    flat, score = flat_profile(small, "t").first(), P.score_table(small, "t").first()
    assert flat["missing_values"] == pytest.approx(score["missing_pct"])
    assert flat["duplicates"] == pytest.approx(score["duplicate_pct"])
    assert flat["quality_score"] == pytest.approx(score["quality_score"])
    assert flat["numeric_pct"] == 50.0 and flat["n_features"] == 4.0


def test_segments_add_up(spark, sf):
    orders = spark.read.parquet(f"{sf}/orders.parquet")
    parts = segment_profiles(orders, "o_orderstatus", "o_orderpriority")
    assert parts.agg(F.sum("dataset_size")).first()[0] == orders.count()


@pytest.mark.parametrize("sortable", [3, 200, 50_000])
def test_refined_quantiles_equal_sorted_ones(spark, monkeypatch, sortable):
    monkeypatch.setattr(Q, "SORTABLE", sortable)
    monkeypatch.setattr(Q, "GRID", 20)
    monkeypatch.setattr(Q, "SKETCH_ACCURACY", 50)
    df = spark.range(4000).select(
        F.when(F.col("id") % 3 == 0, 7.0).otherwise(F.pmod(F.hash("id"), F.lit(1000)) / 7.0).alias("hot"),
        F.when(F.col("id") % 5 > 0, F.col("id")).alias("gaps"),
        F.lit(None).cast("double").alias("none"),
        F.when(F.col("id") % 10 == 0, float("inf")).otherwise(F.col("id") * 1.0).alias("infinite"),
    )
    wanted = (0.0, 0.25, 0.5, 0.75, 0.999, 1.0)
    exact = Q.quantiles(df, df.columns, wanted)
    assert Q.quantiles(df, df.columns, wanted, small_bytes=0) == exact
    assert exact["none"] == [None] * 6
    values = sorted(r[0] for r in df.select("gaps").filter("gaps is not null").collect())
    place = 0.25 * (len(values) - 1)
    low = math.floor(place)
    assert exact["gaps"][1] == pytest.approx(values[low] + (place - low) * (values[low + 1] - values[low]))
