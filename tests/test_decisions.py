import pytest
from pyspark.sql import functions as F

from tablewright.operators import gain as G
from tablewright.operators import history as H
from tablewright.operators import outcomes as O
from tablewright.operators import rules as R
from tablewright.sources import files as S


@pytest.fixture(scope="module")
def rules(spark):
    return R.built_in_rules(spark)


def test_rules_goldens(spark, rules):
    profile = spark.createDataFrame(
        [(0.05, 0.3, 2.5, 5.0, 10.0)],
        "missing_values double, duplicates double, outliers double, imbalance_ratio double, high_correlation_pct double",
    )
    found = {r["domain"]: r for r in R.judge(R.for_domains(profile, list(R.BUILT_IN_RULES)), rules).collect()}
    assert {d: r["severity_level"] for d, r in found.items()} == {
        "finance": "PASS",
        "ecommerce": "PASS",
        "healthcare": "CRITICAL",
        "credit_scoring": "CRITICAL",
        "sentiment": "PASS",
        "iot": "PASS",
    }
    assert found["healthcare"]["violations"] == ["duplicates 0.30% above limit 0.10%"]


def test_severity_levels(spark, rules):
    rows = [(0.0, 0.0, 0.0, 200.0, 0.0), (0.0, 0.0, 11.0, 1.0, 0.0), (0.0, 0.0, 0.0, 1.0, 21.0)]
    profiles = spark.createDataFrame(
        rows, "missing_values double, duplicates double, outliers double, imbalance_ratio double, high_correlation_pct double"
    )
    judged = R.judge(R.for_domains(profiles, ["Finance"]), rules).collect()
    assert sorted(r["severity_level"] for r in judged) == ["HIGH", "LOW", "LOW"]


def test_rules_lookup_and_registration(spark, rules):
    assert R.get_rules(rules, "FINANCE")["max_missing_pct"] == 0.1
    with pytest.raises(ValueError, match="healthcare"):
        R.get_rules(rules, "nowhere")
    wider = R.register_rules(rules, R.custom_rules(spark, "Finance", max_missing_pct=9.0))
    assert wider.count() == 6 and R.get_rules(wider, "finance")["max_missing_pct"] == 9.0
    with pytest.raises(ValueError):
        R.custom_rules(spark, "x", no_such_field=1)


def test_rules_round_trip_fills_defaults(spark, rules, tmp_path):
    path = str(tmp_path / "rules")
    S.write_rules(rules.withColumn("max_correlation", F.lit(None).cast("double")), path)
    back = {r["domain"]: r for r in S.read_rules(spark, path).collect()}
    assert back["finance"]["max_correlation"] == 0.95
    assert back["healthcare"]["medical_validity_rules"]["glucose_max"] == 600.0
    assert back["iot"]["max_timestamp_gap_days"] == 0.0 and back["iot"]["medical_validity_rules"] == {}


def test_value_ranges(spark, rules):
    limits = R.get_rules(rules, "healthcare")["medical_validity_rules"]
    people = spark.createDataFrame([(30, 10.0), (200, 10.0), (None, 4.0)], "age int, hemoglobin double")
    bad = sorted(tuple(r["invalid_columns"]) for r in R.invalid_rows(people, limits).collect())
    assert bad == [("age",), ("hemoglobin",)]


def test_csv_null_token(spark, tmp_path):
    path = tmp_path / "a.csv"
    path.write_text("39, ?, x\n 40, Private, ?\n")
    rows = S.read_headerless_csv(spark, str(path), "age int, work string, s string").collect()
    assert [tuple(r) for r in rows] == [(39, None, "x"), (40, "Private", None)]


def test_effectiveness_goldens(spark):
    got = {(r["fix_name"], r["data_type"]): r for r in H.analyze_effectiveness(H.default_history(spark)).collect()}
    want = {
        ("handle_imbalance", "numeric"): (2.75, "RECOMMENDED"),
        ("scale_features", "numeric"): (1.0, "TRY"),
        ("remove_duplicates", "text"): (1.4, "TRY"),
        ("remove_duplicates", "categorical"): (0.55, "TRY"),
        ("remove_duplicates", "numeric"): (0.05, "SKIP"),
        ("scale_features", "categorical"): (0.0, "SKIP"),
        ("drop_missing", "numeric"): (-0.05, "SKIP"),
        ("drop_missing", "categorical"): (-0.8, "SKIP"),
        ("drop_missing", "datetime"): (-2.0, "SKIP"),
        ("remove_outliers", "numeric"): (-1.6, "SKIP"),
    }
    assert {k: (round(r["avg_effectiveness"], 9), r["recommendation"]) for k, r in got.items()} == want
    assert got[("handle_imbalance", "numeric")]["std_effectiveness"] == pytest.approx(0.75)
    assert got[("remove_outliers", "numeric")]["std_effectiveness"] == pytest.approx(1.4)


def test_best_fixes_and_recommendations(spark):
    history = H.default_history(spark)
    finance = [(r["fix_name"], round(r["effectiveness"], 6)) for r in H.best_fixes(history, ["numeric"], "finance").orderBy("rank").collect()]
    assert finance == [("handle_imbalance", 3.5), ("scale_features", 1.0), ("remove_duplicates", 0.05)]
    assert H.best_fixes(history, ["datetime"]).count() == 0
    numbers, mixed = spark.createDataFrame([(1.0,)], "a double"), spark.createDataFrame([(1.0, "x")], "a double, b string")
    assert H.expected_gain(H.recommend_fixes(numbers, history)).first()[0] == pytest.approx(0.0126667, abs=1e-6)
    assert H.expected_gain(H.recommend_fixes(mixed, history, "finance")).first()[0] == pytest.approx(0.01275)
    assert H.expected_gain(H.recommend_fixes(spark.createDataFrame([(True,)], "a boolean"), history)).first()[0] == 0.0


def registry(spark):
    issues = ["missing_values", "duplicates", "outliers", "imbalance_ratio"]
    rows = [("banking_001", issues, 1), ("retail_001", issues, 1), ("medical_001", [], 1), ("medical_001", issues, 2)]
    return spark.createDataFrame(rows, "dataset_id string, quality_issues array<string>, t int").select(
        "dataset_id", "quality_issues", F.timestamp_seconds("t").alias("registered_at")
    )


def test_outcome_goldens(spark):
    outcomes = spark.createDataFrame(
        [("banking_001", 0.012, 0.018), ("retail_001", 0.008, 0.009), ("medical_001", 0.010, -0.004)], "dataset_id string, lab double, actual double"
    )
    found = O.validate(outcomes, registry(spark))
    rows = {r["dataset_id"]: r for r in found.collect()}
    assert {k: r["error"] for k, r in rows.items()} == {"banking_001": 0.006, "retail_001": 0.001, "medical_001": 0.014}
    assert all(r["quality_score"] == 80.0 and r["action_level"] == "ACTIVE" and r["matches"] for r in rows.values())
    assert rows["medical_001"]["verdict"] == "failure_mode" and rows["banking_001"]["verdict"] == "accurate"
    assert [rows[k]["fix_benefit"] for k in ("banking_001", "retail_001", "medical_001")] == ["significant", "minimal", "negligible"]
    summary = O.validation_summary(found).first()
    assert summary["avg_gain"] == pytest.approx(0.0076667, abs=1e-6) and summary["match_count"] == 3
    assert summary["lab_accurate"] and summary["marginal"]
    stray = spark.createDataFrame([("nobody", 0.0, 0.0)], "dataset_id string, lab double, actual double")
    with pytest.raises(ValueError, match="nobody"):
        O.validate(stray, registry(spark))


def test_feature_defaults(spark):
    row = G.quality_features(spark.createDataFrame([(2.5,)], "missing_values double")).first()
    assert tuple(row)[:7] == (2.5, 0.0, 0.0, 1.0, 0.0, 0.0, 50.0)
    assert row["log_dataset_size"] == pytest.approx(6.908755, abs=1e-6)


def test_verdicts(spark):
    p = spark.createDataFrame([(-0.02,), (0.007,), (0.005,)], "predicted_f1_improvement double")
    assert [r["verdict"] for r in G.with_verdict(p, "lr").collect()] == ["worth fixing", "maybe fix", "skip"]
    assert G.with_verdict(p, "lr").first()["interval_low"] == pytest.approx(-0.07)


def test_gain_model_learns_saves_and_loads(spark, tmp_path):
    history = spark.range(120).select(
        (F.col("id") % 10).cast("double").alias("missing_values"),
        (F.col("id") % 7).cast("double").alias("duplicates"),
        (F.col("id") % 10 * 0.004).alias("f1_improvement"),
    )
    model = G.GainModel("lr")
    with pytest.raises(RuntimeError):
        model.predict(history)
    with pytest.raises(RuntimeError):
        model.save(str(tmp_path / "no"))
    report = model.train(history, folds=3).first()
    assert report["train_r2"] > 0.99 and report["cv_r2_mean"] > 0.99
    path = str(tmp_path / "model")
    model.save(path)
    again = G.GainModel.load(path).predict(history)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, model.predict(history).collect()))
    with pytest.raises(ValueError):
        G.GainModel("lr").train(history.limit(0))
    forest = G.GainModel("rf", trees=5, depth=4)
    forest.train(history, folds=2)
    assert forest.importances(5).first()["feature"] == "missing_values"


def test_a_later_rule_and_a_tied_registration_give_one_row(spark):
    from tablewright.operators.outcomes import latest_registrations
    from tablewright.operators.rules import built_in_rules, custom_rules, get_rules, register_rules

    added = custom_rules(spark, "Mine", max_imbalance_ratio=1.0).union(custom_rules(spark, "mine", max_imbalance_ratio=9.0))
    rules = register_rules(built_in_rules(spark), added.coalesce(1))
    assert rules.filter("lower(domain) = 'mine'").count() == 1 and get_rules(rules, "mine")["max_imbalance_ratio"] == 9.0
    registry = spark.sql("SELECT 'd' AS dataset_id, timestamp'2024-01-01' AS registered_at, x AS notes FROM VALUES ('a'), ('b') AS t(x)")
    assert latest_registrations(registry).first()["notes"] == "b"


def test_the_gain_models_are_trained_whole(spark, monkeypatch):
    from catalog import QUERIES, learn

    trained = []

    def train(model, history, folds=5):
        learner = model._pipeline().getStages()[-1]
        size = {p.name: learner.getOrDefault(p) for p in learner.params if p.name in ("numTrees", "maxIter", "maxDepth") and learner.isDefined(p)}
        trained.append((model.kind, history.count(), folds, size))
        return spark.createDataFrame([(model.kind,)], "kind string")

    monkeypatch.setattr(learn, "measured_gains", lambda spark, sf: spark.range(7))
    monkeypatch.setattr(G.GainModel, "train", train)
    assert [r["kind"] for r in QUERIES["pm03_train_gain_model"](spark, "").collect()] == ["rf", "gb", "lr"]
    sizes = {kind: (rows, folds, size) for kind, rows, folds, size in trained}
    assert sizes["rf"] == (7, 5, {"numTrees": 100, "maxDepth": 30})  # the deepest trees that Spark grows
    assert sizes["gb"] == (7, 5, {"maxIter": 100, "maxDepth": 3})
    assert sizes["lr"][:2] == (7, 5)
