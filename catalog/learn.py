"""Fix history, gain model, validation of outcomes."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import sql
from catalog.judge import PROFILE_CTES, profiles
from catalog.registry import query, rounded
from catalog.views import dirty_orders
from tablewright.functions.lineage import cut
from tablewright.functions.together import together
from tablewright.operators import effect_states as ES
from tablewright.operators import gain as G
from tablewright.operators import history as H
from tablewright.operators import outcomes as O
from tablewright.operators.flat import segment_profiles
from tablewright.operators.linear import cross_fit_linear, fit_linear
from tablewright.sources import files as S

# ---- fix history: the default effects and the effects repairs have on each customer's orders -----------------------


def effects(spark, sf):
    """Per customer: what dropping incomplete rows and removing copies would cost and give."""
    orders = dirty_orders(spark, sf)
    rows = F.count(F.lit(1)).cast("double")
    lost = (F.count_if(F.col("o_totalprice").isNull()) * 100.0 / rows).alias("price_lost")
    blank = (F.count_if(F.col("o_orderpriority").isNull()) * 100.0 / rows).alias("priority_lost")
    per = orders.groupBy("o_custkey").agg(rows.alias("n"), lost, blank)
    domain = F.when(F.col("o_custkey") % 3 == 0, "finance").when(F.col("o_custkey") % 3 == 1, "general").otherwise("retail")

    def effect(fix, kind, gain, loss):
        return per.select(
            F.lit(fix).alias("fix_name"),
            F.lit(kind).alias("data_type"),
            domain.alias("domain"),
            gain.alias("f1_improvement"),
            (gain * 0.5).alias("precision_change"),
            (gain * 1.5).alias("recall_change"),
            loss.alias("data_loss_pct"),
            F.col("n").cast("long").alias("dataset_size"),
            F.lit("orders").alias("notes"),
        )

    return (
        effect("drop_missing", "numeric", F.col("price_lost") * 0.006, F.col("price_lost"))
        .unionByName(effect("drop_missing", "categorical", F.col("priority_lost") * 0.004, F.col("priority_lost")))
        .unionByName(effect("scale_features", "numeric", F.lit(0.03) / F.col("n"), F.lit(0.0)))
    )


def history(spark, sf):
    return H.record_effects(H.default_history(spark), effects(spark, sf))


_DEFAULT_ROWS = ", ".join(
    "(" + ", ".join(f"'{v}'" if isinstance(v, str) else f"{v}::DOUBLE" for v in e[:7]) + f", {e[7]}::BIGINT)" for e in H.DEFAULT_EFFECTS
)
_HISTORY = [
    (
        "per",
        "SELECT o_custkey, count(*)::DOUBLE AS n, count(*) FILTER (WHERE o_totalprice IS NULL) * 100.0::DOUBLE / count(*) AS pl, "
        "count(*) FILTER (WHERE o_orderpriority IS NULL) * 100.0::DOUBLE / count(*) AS ol, "
        "CASE o_custkey % 3 WHEN 0 THEN 'finance' WHEN 1 THEN 'general' ELSE 'retail' END AS domain FROM dirty_orders GROUP BY o_custkey",
    ),
    (
        "effects",
        "SELECT 'drop_missing' AS fix_name, 'numeric' AS data_type, domain, pl * 0.006::DOUBLE AS f1_improvement, pl AS data_loss_pct, n::BIGINT AS dataset_size FROM per "
        "UNION ALL SELECT 'drop_missing', 'categorical', domain, ol * 0.004::DOUBLE, ol, n::BIGINT FROM per "
        "UNION ALL SELECT 'scale_features', 'numeric', domain, 0.03::DOUBLE / n, 0.0::DOUBLE, n::BIGINT FROM per",
    ),
    (
        "history",
        "SELECT fix_name, data_type, domain, f1_improvement, data_loss_pct, dataset_size, f1_improvement * 100.0::DOUBLE - data_loss_pct * 0.5::DOUBLE AS effectiveness FROM ("
        f"SELECT fix_name, data_type, domain, f1_improvement, data_loss_pct, dataset_size FROM (VALUES {_DEFAULT_ROWS}) "
        "t(fix_name, data_type, domain, f1_improvement, p, r, data_loss_pct, dataset_size) UNION ALL SELECT * FROM effects)",
    ),
]


def _history_sql(final: str, *ctes: tuple[str, str]) -> str:
    return sql.with_ctes(final, ["dirty_orders"], *_HISTORY, *ctes)


@query(
    "a01_record_effects",
    _history_sql("SELECT fix_name, data_type, domain, round(f1_improvement, 6) AS f1_improvement, dataset_size FROM history"),
)
def a01(spark, sf):
    path = S.shared_folder(spark, "history")
    S.append_table(H.default_history(spark).drop("dataset_characteristics"), path)
    S.append_table(effects(spark, sf), path)
    stored = spark.read.parquet(path)
    return rounded(stored.select("fix_name", "data_type", "domain", "f1_improvement", "dataset_size"), "f1_improvement")


@query(
    "a02_effectiveness_score",
    _history_sql("SELECT fix_name, data_type, domain, dataset_size, round(effectiveness, 6) AS effectiveness FROM history"),
)
def a02(spark, sf):
    scored = H.score_effects(history(spark, sf))
    return rounded(scored.select("fix_name", "data_type", "domain", "dataset_size", "effectiveness"), "effectiveness")


_ANALYSIS = (
    "analysis",
    "SELECT fix_name, data_type, avg(effectiveness) AS avg_effectiveness, stddev_pop(effectiveness) AS std_effectiveness, "
    "avg(f1_improvement) AS avg_f1_improvement, avg(data_loss_pct) AS avg_data_loss, count(*) AS num_trials, "
    "CASE WHEN avg(effectiveness) > 2.0 THEN 'RECOMMENDED' WHEN avg(effectiveness) > 0.5 THEN 'TRY' ELSE 'SKIP' END AS recommendation "
    "FROM history GROUP BY fix_name, data_type",
)
_MEANS = ("avg_effectiveness", "std_effectiveness", "avg_f1_improvement", "avg_data_loss")
_ANALYSIS_COLUMNS = "fix_name, data_type, num_trials, recommendation, " + ", ".join(f"round({m}, 6) AS {m}" for m in _MEANS)


@query("a03_analyze_effectiveness", _history_sql(f"SELECT {_ANALYSIS_COLUMNS} FROM analysis", _ANALYSIS))
def a03(spark, sf):
    return rounded(H.analyze_effectiveness(history(spark, sf)), *_MEANS)


def _best(domain: str | None) -> tuple[str, str]:
    own = f"coalesce(avg(effectiveness) FILTER (WHERE domain = '{domain}'), avg(effectiveness))" if domain else "avg(effectiveness)"
    return (
        "best",
        f"SELECT *, (row_number() OVER (PARTITION BY data_type ORDER BY effectiveness DESC, fix_name))::INTEGER AS rank FROM "
        f"(SELECT data_type, fix_name, {own} AS effectiveness FROM history GROUP BY data_type, fix_name) WHERE effectiveness > 0",
    )


@query("a04_best_fixes_finance", _history_sql("SELECT data_type, fix_name, round(effectiveness, 6) AS effectiveness, rank FROM best", _best("finance")))
def a04(spark, sf):
    return rounded(H.best_fixes(history(spark, sf), domain="finance"), "effectiveness")


_RECOMMENDED = _history_sql(
    "SELECT data_type, fix_name, round(effectiveness, 6) AS effectiveness, rank, column_count, round(avg(effectiveness) OVER () / 100.0::DOUBLE, 6) AS expected_gain "
    "FROM best JOIN (VALUES ('numeric', 3), ('categorical', 2)) k(data_type, column_count) USING (data_type) WHERE rank <= 3",
    _best("finance"),
)


@query("a05_recommend_fixes", _RECOMMENDED)
def a05(spark, sf):
    found = H.recommend_fixes(dirty_orders(spark, sf), history(spark, sf), "finance")
    return rounded(found, "effectiveness", "expected_gain")


def stored_states(spark, sf):
    """The same history as recorded batches of states; the second run of a batch replaces the first."""
    path = S.shared_folder(spark, "effect-states")
    S.append_table(ES.effect_states(H.default_history(spark)), path, "defaults")
    odd = F.col("dataset_size") % 2 == 1
    for batch, some in (("odd", odd), ("even", ~odd), ("odd", odd)):
        S.append_table(ES.effect_states(effects(spark, sf).filter(some)), path, batch)
    return S.read_batches(spark, path, ES.STATE_SCHEMA)


@query("a03_analyze_stored_states", _history_sql(f"SELECT {_ANALYSIS_COLUMNS} FROM analysis", _ANALYSIS))
def a03_states(spark, sf):
    return rounded(ES.analyze_states(stored_states(spark, sf)), *_MEANS)


@query(
    "a04_best_fixes_stored_states",
    _history_sql("SELECT data_type, fix_name, round(effectiveness, 6) AS effectiveness, rank FROM best", _best("finance")),
)
def a04_states(spark, sf):
    return rounded(ES.best_fixes_of_states(stored_states(spark, sf), domain="finance"), "effectiveness")


@query("a05_recommend_stored_states", _RECOMMENDED)
def a05_states(spark, sf):
    best = ES.best_fixes_of_states(stored_states(spark, sf), domain="finance")
    return rounded(H.recommend_ranked(dirty_orders(spark, sf), best), "effectiveness", "expected_gain")


@query(
    "a06_default_history",
    _history_sql(
        "SELECT h.fix_name, h.data_type, h.domain, round(h.effectiveness, 6) AS effectiveness, count(e.fix_name) AS measured FROM (SELECT fix_name, data_type, domain, "
        "f1_improvement * 100.0::DOUBLE - data_loss_pct * 0.5::DOUBLE AS effectiveness FROM "
        f"(VALUES {_DEFAULT_ROWS}) t(fix_name, data_type, domain, f1_improvement, p, r, data_loss_pct, dataset_size)) h "
        "LEFT JOIN effects e ON e.fix_name = h.fix_name AND e.data_type = h.data_type AND e.domain = h.domain "
        "GROUP BY h.fix_name, h.data_type, h.domain, h.effectiveness"
    ),
)
def a06(spark, sf):
    keys = ["fix_name", "data_type", "domain"]
    measured = effects(spark, sf).groupBy(*keys).agg(F.count(F.lit(1)).alias("measured"))
    seeds = H.score_effects(H.default_history(spark)).select(*keys, "effectiveness")
    return rounded(seeds.join(measured, keys, "left").fillna(0, ["measured"]), "effectiveness")


@query(
    "a07_apply_recommended",
    sql.with_ctes(
        "SELECT o_custkey, o_orderstatus, o_orderpriority, round((o_totalprice - a) / s, 6) AS o_totalprice FROM once, "
        "(SELECT avg(o_totalprice) AS a, stddev_pop(o_totalprice) AS s FROM once)",
        ["dirty_orders"],
        ("once", "SELECT DISTINCT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority FROM dirty_orders"),
    ),
)
def a07(spark, sf):
    orders = dirty_orders(spark, sf).drop("o_orderdate")
    fixed = H.apply_recommended(orders, H.default_history(spark), "o_orderpriority", ["o_orderkey", "o_custkey"])
    return rounded(fixed.select("o_custkey", "o_orderstatus", "o_orderpriority", "o_totalprice"), "o_totalprice")


@query("w01_top_fixes_per_class", _history_sql("SELECT data_type, fix_name, rank FROM best WHERE rank <= 3", _best(None)))
def w01(spark, sf):
    return H.best_fixes(history(spark, sf)).filter("rank <= 3").select("data_type", "fix_name", "rank")


@query(
    "w02_top_effects",
    _history_sql(
        "SELECT fix_name, data_type, round(avg_effectiveness, 6) AS avg_effectiveness FROM analysis "
        "ORDER BY analysis.avg_effectiveness DESC, fix_name, data_type LIMIT 5",
        _ANALYSIS,
    ),
)
def w02(spark, sf):
    return rounded(H.top_effects(history(spark, sf)).select("fix_name", "data_type", "avg_effectiveness"), "avg_effectiveness")


# ---- gain model: profiles of customers' orders, gain = what the default repairs add to the score -------------------


def customer_profiles(spark, sf):
    """Profiles of the customers' orders, computed once for all that is derived from them."""
    return cut(segment_profiles(dirty_orders(spark, sf), "o_custkey", "o_orderpriority"))


def measured_gains(spark, sf, before=None):
    """Profiles with the score gained by dropping incomplete rows and copies, on the scale of an F1 gain.

    The repaired orders feed several scans and the gains several fits: each is computed once.
    """
    before = customer_profiles(spark, sf) if before is None else before
    fixed = cut(dirty_orders(spark, sf).na.drop("any").distinct())
    after = segment_profiles(fixed, "o_custkey", "o_orderpriority").select("o_custkey", F.col("quality_score").alias("_after"))
    gain = (F.col("_after") - F.col("quality_score")) / 1000.0
    return cut(before.join(after, "o_custkey").withColumn("f1_improvement", gain).drop("_after"))


_GAIN_CTES = [
    *sql.segments("po", "dirty_orders", "dirty_orders", "o_custkey", "o_orderpriority"),
    ("fixed", "SELECT DISTINCT * FROM dirty_orders WHERE o_totalprice IS NOT NULL AND o_orderpriority IS NOT NULL"),
    *sql.segments("pf", "fixed", "dirty_orders", "o_custkey", "o_orderpriority"),
    ("gains", "SELECT po.*, (pf.quality_score - po.quality_score) / 1000.0::DOUBLE AS f1_improvement FROM po JOIN pf USING (seg)"),
]
_MODEL_FEATURES = ", ".join(
    "ln(1 + dataset_size) AS log_dataset_size" if c == "dataset_size" else f"{c}::DOUBLE AS {c}" for c in G.FEATURE_DEFAULTS
)


@query(
    "pm01_quality_features",
    sql.with_ctes(
        "SELECT profile_id, " + ", ".join(f"round({f}, 6) AS {f}" for f in G.FEATURES) + f" FROM (SELECT profile_id, {_MODEL_FEATURES} FROM profiles)",
        ["dirty_orders", "dirty_events"],
        *PROFILE_CTES,
    ),
)
def pm01(spark, sf):
    return rounded(G.quality_features(profiles(spark, sf), ["profile_id"]), *G.FEATURES)


@query(
    "pm02_standardised_features",
    sql.with_ctes(
        "SELECT profile_id, " + ", ".join(f"round(({f} - avg({f}) OVER ()) / stddev_pop({f}) OVER (), 5) AS {f}" for f in ("missing_values", "outliers", "log_dataset_size"))
        + f" FROM (SELECT profile_id, {_MODEL_FEATURES} FROM profiles)",
        ["dirty_orders", "dirty_events"],
        *PROFILE_CTES,
    ),
)
def pm02(spark, sf):
    names = ("missing_values", "outliers", "log_dataset_size")
    scaled = G.standardised_features(G.quality_features(profiles(spark, sf), ["profile_id"]))
    return scaled.select("profile_id", *[F.round(n, 5).alias(n) for n in names])


def _trained(spark, sf):
    """A small forest, for the queries that use a model."""
    model = G.GainModel("rf", trees=5, depth=4)
    report = model.train(measured_gains(spark, sf), folds=2)
    return model, report


@query("pm03_train_gain_model")
def pm03(spark, sf):
    gains = measured_gains(spark, sf)
    # The whole job: 100 trees of full depth or 100 rounds, and five folds.
    reports = together(spark, [lambda k=kind: G.GainModel(k).train(gains) for kind in ("rf", "gb", "lr")])
    return reports[0].unionByName(reports[1]).unionByName(reports[2])


@query("pm04_cross_validated_r2")
def pm04(spark, sf):
    return G.GainModel("lr").train(measured_gains(spark, sf), folds=5).select("kind", "n_samples", "train_r2", "cv_r2_mean", "cv_r2_std")


@query("pm05_batch_prediction")
def pm05(spark, sf):
    model, _ = _trained(spark, sf)
    return model.predict(profiles(spark, sf), ["profile_id"])


# The gain from the missing share alone, so that SQL's regression functions can tell it.
_ONE_FEATURE = ("g", "SELECT seg AS o_custkey, seg % 5 AS fold, missing_values AS x, f1_improvement AS y FROM gains")


@query(
    "pm03_linear_fit",
    sql.with_ctes(
        "SELECT count(*) AS rows, round(regr_slope(y, x), 6) AS slope, round(regr_intercept(y, x), 6) AS intercept, round(regr_r2(y, x), 6) AS r2 FROM g",
        ["dirty_orders"],
        *_GAIN_CTES,
        _ONE_FEATURE,
    ),
)
def pm03_linear(spark, sf):
    fit = fit_linear(measured_gains(spark, sf), ["missing_values"], "f1_improvement")
    found = [(fit.rows, fit.coefficients[0], fit.intercept, fit.r2)]
    return rounded(spark.createDataFrame(found, "rows bigint, slope double, intercept double, r2 double"), "slope", "intercept", "r2")


@query(
    "pm04_linear_folds",
    sql.with_ctes(
        "SELECT fold, count(*) AS rows, round(sqrt(avg(e * e)), 6) AS rmse, round(1 - avg(e * e) / var_pop(y), 6) AS r2 FROM "
        "(SELECT g.fold, y, y - b - a * x AS e FROM g JOIN fits USING (fold)) GROUP BY fold",
        ["dirty_orders"],
        *_GAIN_CTES,
        _ONE_FEATURE,
        ("fits", "SELECT f.fold, regr_slope(y, x) AS a, regr_intercept(y, x) AS b FROM (SELECT DISTINCT fold FROM g) f JOIN g ON g.fold <> f.fold GROUP BY f.fold"),
    ),
)
def pm04_linear(spark, sf):
    gains = measured_gains(spark, sf).withColumn("fold", F.col("o_custkey") % 5)
    return rounded(cross_fit_linear(gains, ["missing_values"], "f1_improvement", "fold")[1], "rmse", "r2")


@query(
    "pm05_linear_prediction",
    sql.with_ctes(
        "SELECT o_custkey, round(b + a * x, 6) AS predicted_f1_improvement FROM g, (SELECT regr_slope(y, x) AS a, regr_intercept(y, x) AS b FROM g)",
        ["dirty_orders"],
        *_GAIN_CTES,
        _ONE_FEATURE,
    ),
)
def pm05_linear(spark, sf):
    gains = measured_gains(spark, sf)
    fit = fit_linear(gains, ["missing_values"], "f1_improvement")
    return rounded(gains.select("o_custkey", fit.predicted().alias("predicted_f1_improvement")), "predicted_f1_improvement")


_PREDICTED = "SELECT seg AS o_custkey, f1_improvement AS p FROM gains"


@query(
    "pm06_prediction_interval",
    sql.with_ctes(
        "SELECT o_custkey, round(p, 6) AS predicted_f1_improvement, round(p * 100, 6) AS predicted_improvement_pct, "
        f"round(p - 0.02::DOUBLE, 6) AS interval_low, round(p + 0.02::DOUBLE, 6) AS interval_high FROM ({_PREDICTED})",
        ["dirty_orders"],
        *_GAIN_CTES,
    ),
)
def pm06(spark, sf):
    gains = measured_gains(spark, sf).select("o_custkey", F.col("f1_improvement").alias("predicted_f1_improvement"))
    found = G.with_verdict(gains, "rf").drop("verdict", "severity")
    return rounded(found, "predicted_f1_improvement", "predicted_improvement_pct", "interval_low", "interval_high")


@query(
    "pm07_fix_verdict",
    sql.with_ctes(
        "SELECT o_custkey, CASE WHEN round(abs(p), 9) > 0.01 THEN 'worth fixing' WHEN round(abs(p), 9) > 0.005 THEN 'maybe fix' ELSE 'skip' END AS verdict, "
        f"CASE WHEN round(abs(p), 9) > 0.01 THEN 'HIGH' WHEN round(abs(p), 9) > 0.005 THEN 'MEDIUM' ELSE 'LOW' END AS severity FROM ({_PREDICTED})",
        ["dirty_orders"],
        *_GAIN_CTES,
    ),
)
def pm07(spark, sf):
    # Rounded, so that a gain of exactly one threshold is judged alike however its digits were summed.
    gains = measured_gains(spark, sf).select("o_custkey", F.round("f1_improvement", 9).alias("predicted_f1_improvement"))
    return G.with_verdict(gains, "rf").select("o_custkey", "verdict", "severity")


@query("pm08_feature_importances")
def pm08(spark, sf):
    return _trained(spark, sf)[0].importances(5)


@query("s09_model_saved_and_loaded")
def s09(spark, sf):
    model, _ = _trained(spark, sf)
    path = S.shared_folder(spark, "model")
    model.save(path)
    return G.GainModel.load(path).predict(profiles(spark, sf), ["profile_id"])


# ---- outcomes: every customer is a registered dataset, lab = predicted by a rule, actual = measured ----------------


def registry_rows(spark, sf, before=None):
    before = segment_profiles(dirty_orders(spark, sf), "o_custkey", "o_orderpriority") if before is None else before
    issues = F.array_compact(
        F.array(
            F.when(F.col("missing_values") > 0, "missing_values"),
            F.when(F.col("duplicates") > 0, "duplicates"),
            F.when(F.col("outliers") > 0, "outliers"),
            F.when(F.col("imbalance_ratio") > 2, "imbalance_ratio"),
        )
    )
    return before.select(
        F.concat(F.lit("cust_"), "o_custkey").alias("dataset_id"),
        F.lit("orders").alias("source"),
        F.col("dataset_size").cast("long").alias("size"),
        F.col("n_features").cast("int").alias("n_features"),
        F.create_map(F.lit("numeric"), F.lit(2), F.lit("categorical"), F.lit(2)).alias("data_types"),
        issues.alias("quality_issues"),
        F.lit("first").alias("notes"),
        F.lit(False).alias("has_pii"),
        F.lit(True).alias("anonymized"),
        F.lit("2024-01-01").cast("timestamp").alias("registered_at"),
    )


def outcome_rows(spark, sf, before=None):
    gains = measured_gains(spark, sf, before)
    return gains.select(
        F.concat(F.lit("cust_"), "o_custkey").alias("dataset_id"),
        F.round(F.col("missing_values") * 0.001, 6).alias("lab"),
        F.round("f1_improvement", 6).alias("actual"),
    )


_OUTCOME_CTES = [
    *_GAIN_CTES,
    (
        "registry",
        "SELECT concat('cust_', seg) AS dataset_id, dataset_size::BIGINT AS size, (missing_values > 0)::INTEGER + (duplicates > 0)::INTEGER + "
        "(outliers > 0)::INTEGER + (imbalance_ratio > 2)::INTEGER AS issues FROM po",
    ),
    ("outcomes", "SELECT concat('cust_', seg) AS dataset_id, round(missing_values * 0.001::DOUBLE, 6) AS lab, round(f1_improvement, 6) AS actual FROM gains"),
    (
        "validated",
        "SELECT dataset_id, greatest(30, least(100, 100 - issues * 5))::DOUBLE AS quality_score, lab, actual, abs(lab - actual) AS error, "
        "abs(lab - actual) < 0.015 AS matches FROM outcomes JOIN registry USING (dataset_id)",
    ),
]


def _outcome_sql(final: str) -> str:
    return sql.with_ctes(final, ["dirty_orders"], *_OUTCOME_CTES)


def _validation(spark, sf):
    before = customer_profiles(spark, sf)
    return O.validate(outcome_rows(spark, sf, before), registry_rows(spark, sf, before), strict=False)


@query(
    "s07_dataset_registry",
    _outcome_sql("SELECT dataset_id, size, 'second' AS notes FROM registry"),
)
def s07(spark, sf):
    path = S.shared_folder(spark, "registry")
    rows = registry_rows(spark, sf).drop("registered_at")
    S.register_datasets(rows, path)
    S.register_datasets(rows.withColumn("notes", F.lit("second")), path)
    return S.read_registry(spark, path).select("dataset_id", "size", "notes")


@query("s08_validation_sink", _outcome_sql("SELECT dataset_id, quality_score, matches FROM validated"))
def s08(spark, sf):
    path = S.shared_folder(spark, "validation")
    S.append_table(_validation(spark, sf), path)
    return spark.read.parquet(path).select("dataset_id", "quality_score", "matches")


@query("v01_issue_score", _outcome_sql("SELECT dataset_id, greatest(30, least(100, 100 - issues * 5))::DOUBLE AS quality_score FROM registry"))
def v01(spark, sf):
    return registry_rows(spark, sf).select("dataset_id", O.issue_score(F.col("quality_issues")).alias("quality_score"))


@query(
    "v02_prediction_error",
    _outcome_sql("SELECT dataset_id, round(lab, 4) AS lab, round(actual, 4) AS actual, round(error, 4) AS error, matches FROM validated"),
)
def v02(spark, sf):
    return _validation(spark, sf).select("dataset_id", "lab", "actual", "error", "matches")


@query(
    "v02_unregistered_outcomes",
    _outcome_sql("SELECT dataset_id FROM outcomes WHERE dataset_id NOT IN (SELECT dataset_id FROM registry WHERE size > 10)"),
)
def v02_stray(spark, sf):
    before = customer_profiles(spark, sf)
    return O.unregistered(outcome_rows(spark, sf, before), registry_rows(spark, sf, before).filter("size > 10")).select("dataset_id")


@query(
    "v03_action_level",
    _outcome_sql(
        "SELECT dataset_id, CASE WHEN quality_score > 80 THEN 'PASSIVE' WHEN quality_score > 50 THEN 'ACTIVE' ELSE 'URGENT' END AS action_level FROM validated"
    ),
)
def v03(spark, sf):
    return _validation(spark, sf).select("dataset_id", "action_level")


@query(
    "v04_fix_benefit",
    _outcome_sql(
        "SELECT dataset_id, CASE WHEN actual > 0.01 THEN 'significant' WHEN actual > 0.005 THEN 'minimal' ELSE 'negligible' END AS fix_benefit FROM validated"
    ),
)
def v04(spark, sf):
    return _validation(spark, sf).select("dataset_id", "fix_benefit")


@query(
    "v05_outcome_verdict",
    _outcome_sql(
        "SELECT dataset_id, CASE WHEN lab > 0 AND actual < 0 THEN 'failure_mode' WHEN abs(lab - actual) > 0.02 THEN 'mismatch' ELSE 'accurate' END AS verdict FROM validated"
    ),
)
def v05(spark, sf):
    return _validation(spark, sf).select("dataset_id", "verdict")


@query(
    "v06_validation_summary",
    _outcome_sql(
        "SELECT count(*) AS datasets, round(avg(quality_score), 6) AS avg_quality_score, round(avg(round(actual, 4)), 6) AS avg_gain, "
        "count(*) FILTER (WHERE matches) AS match_count, round(100.0::DOUBLE * count(*) FILTER (WHERE matches) / count(*), 6) AS match_rate_pct, "
        "count(*) FILTER (WHERE matches)::DOUBLE / count(*) > 0.8 AS lab_accurate, abs(avg(actual)) < 0.02 AS marginal FROM validated"
    ),
)
def v06(spark, sf):
    return rounded(O.validation_summary(_validation(spark, sf)), "avg_quality_score", "avg_gain", "match_rate_pct")
