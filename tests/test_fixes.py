import pandas as pd
import pytest
from pyspark.sql import functions as F

from tablewright.operators import fixes as X
from tablewright.operators import ranking as R
from tablewright.operators import sequence as S
from tablewright.operators.encode import align, apply_codes, code_table, encode_categoricals, fill_mode


@pytest.fixture(scope="module")
def skewed(spark):
    """One class holds nearly all rows."""
    cls = F.when(F.col("id") % 40 == 0, "rare").when(F.col("id") % 40 == 1, "other").otherwise("common")
    return spark.range(2000).select("id", cls.alias("cls"))


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_mean_and_median(spark):
    df = spark.createDataFrame([(1, "a"), (2, None), (None, "b"), (9, "c")], "v int, s string")
    assert [r["v"] for r in X.fill_mean(df).collect()] == [1.0, 2.0, 4.0, 9.0]
    assert [r["v"] for r in X.fill_median(df).collect()] == [1.0, 2.0, 2.0, 9.0]
    assert X.drop_missing(df).count() == 2


@pytest.mark.parametrize("blocks", [1, 2, 7])
@pytest.mark.parametrize("keys", [[], ["g"]])
def test_ordered_fill_equals_pandas(spark, blocks, keys):
    data = pd.DataFrame({"o": range(60)})
    data["g"] = data["o"] % 2
    data["v"] = [float(i) if i % 7 in (3, 5) else None for i in range(60)]
    data["s"] = [f"s{i}" if i > 20 and i % 11 == 0 else None for i in range(60)]
    df = spark.createDataFrame(data.astype(object).where(data.notna(), None).values.tolist(), "o int, g int, v double, s string")
    got = S.fill_in_order(df, "o", keys, blocks).toPandas().sort_values("o").reset_index(drop=True)
    grouped = data.groupby("g")[["v", "s"]] if keys else None
    want = data.copy()
    want[["v", "s"]] = grouped.ffill() if keys else data[["v", "s"]].ffill()
    want[["v", "s"]] = want.groupby("g")[["v", "s"]].bfill() if keys else want[["v", "s"]].bfill()
    assert got["v"].tolist() == want["v"].tolist()
    assert got["s"].tolist() == want["s"].tolist()


def test_forward_fill_needs_order(spark):
    with pytest.raises(ValueError):
        X.fix_missing(spark.range(3).toDF("a"), "forward_fill")


def test_remove_duplicates(spark):
    df = spark.createDataFrame([(1, None), (1, None), (2, "a")], "a int, b string")
    assert rows(X.remove_duplicates(df)) == [(1, None), (2, "a")]
    assert rows(X.remove_duplicates(df, keep=False)) == [(2, "a")]


def test_iqr_filter_drops_null_and_uses_input_bounds(spark):
    df = spark.createDataFrame([(float(v), 1.0) for v in [1, 2, 3, 4, 5, 1000]] + [(None, 1.0)], "v double, w double")
    kept = X.remove_outliers(df, "iqr", 3.0)
    assert [r["v"] for r in kept.collect()] == [1, 2, 3, 4, 5]
    assert X.remove_outliers(df, "iqr", 3.0, exclude=["v"]).count() == 7


def test_whole_number_fences_decide_like_exact_ones_and_reach_the_scan(spark, sf):
    lineitem = spark.read.parquet(f"{sf}/lineitem.parquet").select("l_linenumber", "l_partkey")
    kept = X.remove_outliers(lineitem, "iqr", 0.1)
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(l_linenumber,2)" in plan
    exact = X.remove_outliers(lineitem.select(*[F.col(c).cast("double").alias(c) for c in lineitem.columns]), "iqr", 0.1)
    assert 0 < kept.count() == exact.count() < lineitem.count()


def test_zscore_counts_filled_rows_and_skips_constants(spark):
    df = spark.createDataFrame([(0.0, 5), (0.0, 5), (0.0, 5), (10.0, 5), (None, 5)], "v double, c int")
    # mean 2.5; squares 75 over all five rows: deviation 3.873, z of 10 is 1.936
    assert X.remove_outliers(df, "zscore", 1.93).count() == 4
    assert X.remove_outliers(df, "zscore", 1.94).count() == 5


def test_flags_mark_what_the_filter_removes(spark, sf):
    parts = spark.read.parquet(f"{sf}/lineitem.parquet").select("l_quantity", "l_extendedprice")
    flagged = X.flag_outliers(parts, "zscore", 1.5)
    assert flagged.filter("not is_outlier").count() == X.remove_outliers(parts, "zscore", 1.5).count()
    with pytest.raises(ValueError):
        X.flag_outliers(parts, "isolation_forest")


def test_undersample_counts(skewed):
    got = {r["cls"]: r["count"] for r in X.undersample(skewed, "cls", ["id"]).groupBy("cls").count().collect()}
    assert got == {"rare": 50, "other": 50, "common": 150}


def test_gate_closed_and_null_classes(spark):
    df = spark.createDataFrame([(i, "a" if i % 2 else None) for i in range(40)], "id int, cls string")
    assert X.undersample(df, "cls", ["id"]).count() == 40


def test_oversample_keeps_every_original(skewed):
    grown = X.oversample(skewed, "cls", ["id"])
    counts = {r["cls"]: r["count"] for r in grown.groupBy("cls").count().collect()}
    assert counts == {"rare": 950, "other": 950, "common": 1900}
    assert grown.select("id").distinct().count() == 2000


def test_oversample_spreads_many_copies(skewed, monkeypatch):
    monkeypatch.setattr(X, "COPIES_PER_TASK_ROW", 4)
    counts = {r["cls"]: r["count"] for r in X.oversample(skewed, "cls", ["id"]).groupBy("cls").count().collect()}
    assert counts == {"rare": 950, "other": 950, "common": 1900}


@pytest.mark.parametrize("digits", [0, 1, 2])
@pytest.mark.parametrize("quota", [0, 1, 37, 50, 10_000])
def test_bucketed_quota_equals_plain_ranking(skewed, digits, quota):
    quotas = skewed.select("cls").distinct().withColumn("quota", F.lit(quota).cast("long"))
    got = R.flag_quota(skewed, quotas, ["cls"], ["id"], 42, digits, 3)
    plain = R.hash_rank(skewed, ["cls"], ["id"], 42, 0).withColumn("selected", F.col("rank") <= quota).drop("rank")
    assert rows(got) == rows(plain)


@pytest.mark.parametrize("digits", [1, 2])
def test_bucketed_rank_equals_plain_rank(skewed, digits):
    assert rows(R.hash_rank(skewed, ["cls"], ["id"], 7, digits)) == rows(R.hash_rank(skewed, ["cls"], ["id"], 7, 0))


@pytest.mark.parametrize("bucket_rows", [10, 150, 5000])
def test_global_sample_by_quota(skewed, monkeypatch, bucket_rows):
    few = rows(R.sample_exact(skewed, 300, ["id"]))
    monkeypatch.setattr(R, "TOP_N_LIMIT", 10)
    monkeypatch.setattr(R, "ROWS_PER_BUCKET", bucket_rows)
    assert rows(R.sample_exact(skewed, 300, ["id"])) == few
    assert R.sample_exact(skewed, 9999, ["id"]).count() == 2000


def test_folds_differ_by_at_most_one(skewed):
    sizes = R.stratified_folds(skewed, "cls", 5, ["id"]).groupBy("cls", "fold").count()
    spread = sizes.groupBy("cls").agg((F.max("count") - F.min("count")).alias("d"))
    assert all(r["d"] <= 1 for r in spread.collect())
    by_hash = R.stratified_folds(skewed, "cls", 5, ["id"], exact=False)
    assert by_hash.select("fold").distinct().count() == 5


def test_split_shares(skewed):
    flagged = R.stratified_split(skewed, "cls", ["id"])
    got = {r["cls"]: r["n"] for r in flagged.groupBy("cls").agg(F.count_if("is_test").alias("n")).collect()}
    assert got == {"rare": 10, "other": 10, "common": 380}
    assert flagged.count() == 2000


def test_scaling(spark):
    df = spark.createDataFrame([(1.0, 5, 1), (3.0, 5, 0), (None, 5, 1)], "v double, c int, y int")
    got = X.scale_features(df, "y").collect()
    assert [r["v"] for r in got] == [-1.0, 1.0, None]
    assert [r["c"] for r in got] == [0.0, 0.0, 0.0] and [r["y"] for r in got] == [1, 0, 1]


def test_ordered_fixes_are_idempotent(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (2, None), (3, "b")], "a int, b string")
    once = X.apply_fixes(df)
    assert rows(once) == [(1, "a"), (3, "b")] and rows(X.apply_fixes(once)) == rows(once)
    summary = X.fix_summary(df).collect()
    assert [(r["step"], r["rows_before"], r["rows_after"]) for r in summary] == [("missing_values", 4, 3), ("duplicates", 3, 2)]


@pytest.mark.parametrize("blocks", [1, 3])
def test_time_gaps_cross_blocks(spark, blocks):
    df = spark.sql("SELECT timestamp'2024-01-01' + make_dt_interval(id * (1 + id % 3)) AS ts, id % 2 AS k FROM range(30)")
    got = S.time_gaps(df, "ts", 1.0, blocks=blocks).toPandas()
    days = sorted((r["ts"] - pd.Timestamp("2024-01-01")).days for r in df.collect())
    assert sorted(got["gap_days"]) == sorted(float(b - a) for a, b in zip(days, days[1:]) if b - a > 1)


@pytest.mark.parametrize("blocks", [1, 4])
def test_ordinal_codes(spark, blocks):
    values = spark.createDataFrame([(f"v{i:03d}",) for i in range(50)], "v string")
    got = {r["value"]: r["code"] for r in S.ordinal_codes(values, "v", blocks).collect()}
    assert got == {f"v{i:03d}": i for i in range(50)}


def test_encoding(spark):
    train = spark.createDataFrame([("b",), ("a",), (None,)], "s string")
    test = spark.createDataFrame([("a",), ("zebra",), (None,)], "s string")
    coded, fitted = encode_categoricals(train, ["s"])
    assert sorted(r["s"] for r in coded.collect()) == [0, 1, 2]
    later, _ = encode_categoricals(test, ["s"], fitted)
    # MISSING sorts before a and b; the unseen value takes the next free code
    assert sorted(r["s"] for r in later.collect()) == [0, 1, 3]
    codes = code_table(train, column="s")
    assert sorted(r["s"] is None for r in apply_codes(train, "s", codes).collect()) == [False, False, True]


def test_mode_and_alignment(spark):
    df = spark.createDataFrame([("b",), ("a",), (None,)], "y string")
    assert [r["y"] for r in fill_mode(df, "y").collect()] == ["b", "a", "a"]
    a, b = align(spark.createDataFrame([(1, 2)], "z int, a int"), spark.createDataFrame([(3,)], "m int"))
    assert a.columns == b.columns == ["a", "m", "z"] and tuple(b.first()) == (0, 3, 0)


@pytest.mark.parametrize("digits", [0, 1, 2])
def test_quota_and_rank_keep_rows_without_a_key(spark, digits):
    from tablewright.operators.ranking import flag_quota, hash_rank

    df = spark.createDataFrame([(i if i % 10 else None, "x", i) for i in range(200)], "id int, cls string, n int")
    quotas = spark.createDataFrame([("x", 50)], "cls string, quota long")
    flagged = flag_quota(df, quotas, ["cls"], ["id", "n"], 42, digits, 1)
    assert flagged.count() == 200 and flagged.filter("selected").count() == 50
    alone = flag_quota(df, quotas, ["cls"], ["id"], 42, digits, 1)
    assert alone.count() == 200 and alone.filter("selected").count() == 50
    ranked = hash_rank(df, ["cls"], ["id"], 42, digits, "r")
    assert sorted(r["r"] for r in ranked.collect()) == list(range(1, 201))


@pytest.mark.parametrize("blocks", [1, 3, 64])
def test_fill_with_missing_order_values(spark, blocks):
    from tablewright.operators.sequence import fill_in_order

    df = spark.createDataFrame([(1, None), (2, "b"), (None, "z"), (4, None), (None, None)], "o int, v string")
    got = sorted(((r["o"], r["v"]) for r in fill_in_order(df, "o", (), blocks).collect()), key=repr)
    assert got == [(1, "b"), (2, "b"), (4, "b"), (None, "b"), (None, "z")]


def test_duplicates_with_maps(spark):
    from tablewright.operators.fixes import remove_duplicates

    df = spark.sql("SELECT map('a', 1, 'b', 2) AS m, 1 AS k UNION ALL SELECT map('b', 2, 'a', 1), 1 UNION ALL SELECT map('c', 3), 2")
    assert remove_duplicates(df).count() == 2 and remove_duplicates(df, keep=False).count() == 1
    assert remove_duplicates(df).schema == df.schema or remove_duplicates(df).columns == df.columns
