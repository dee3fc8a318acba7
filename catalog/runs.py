"""Experiments over one table or many, roll-ups, and the complete decision flow."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import sql
from catalog.learn import measured_gains
from catalog.measure import FEATURES, FIXED, IMPACT_CTE, KEYS, LABELLED, RULE_CTES, SIZE, labelled_orders, rule_impact
from catalog.registry import query, r6, rounded
from catalog.views import dirty_events, dirty_orders, doc_labels
from tablewright.operators.fixes import apply_fixes
from tablewright.operators.flat import segment_profiles
from tablewright.operators.gain import GainModel
from tablewright.operators.history import default_history
from tablewright.operators.rules import built_in_rules
from tablewright.plans import experiment as X


def _orders_experiment(spark, sf):
    options = {"models": ("rf", "lr"), "folds": 2, **SIZE}
    return X.Experiment("orders", lambda: labelled_orders(spark, sf), "cls", KEYS, KEYS, options)


@query("x01_experiment")
def x01(spark, sf):
    return X.run_experiment(_orders_experiment(spark, sf))


@query("x02_many_experiments")
def x02(spark, sf):
    options = {"models": ("lr",), "folds": 2, **SIZE}
    events = X.Experiment("events", lambda: dirty_events(spark, sf).drop("ts", "props"), "cls", ["event_id"], ["event_id"], options)
    orders = _orders_experiment(spark, sf)
    orders.options["models"] = ("lr",)
    absent = X.Experiment("absent", lambda: labelled_orders(spark, sf), "no_such_column", KEYS)
    return X.run_experiments(spark, [orders, absent, events])


def _rule_results(spark, sf):
    """Experiment rows of the price rules, one dataset per order status."""
    orders = labelled_orders(spark, sf)
    fixed = apply_fixes(orders, target="cls", keys=KEYS)
    scores = segment_profiles(orders, "o_orderstatus", "cls").select(F.col("o_orderstatus").alias("dataset"), "quality_score")
    before = orders.groupBy(F.col("o_orderstatus").alias("dataset")).agg(F.count(F.lit(1)).alias("rows_original"))
    after = fixed.groupBy(F.col("o_orderstatus").alias("dataset")).agg(F.count(F.lit(1)).alias("rows_fixed"))
    shapes = scores.join(before, "dataset").join(after, "dataset")
    return (
        rule_impact(spark, sf)
        .join(shapes, "dataset")
        .withColumns({"columns_original": F.lit(len(orders.columns)), "columns_fixed": F.lit(len(fixed.columns))})
    )


_LABELLED_COLUMNS = {
    "numeric": ["o_orderkey", "o_custkey", "o_totalprice"],
    "strings": ["o_orderstatus", "o_orderpriority", "cls"],
    "all": ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority", "cls"],
}


def _summary_ctes():
    sql.COLUMNS["labelled"] = _LABELLED_COLUMNS
    return [*RULE_CTES, IMPACT_CTE, *sql.segments("st", "labelled", "labelled", "o_orderstatus", "cls")]


@query(
    "x03_experiment_summary",
    sql.with_ctes(
        "SELECT dataset, round(max(quality_score), 6) AS quality_score, (SELECT count(*) FROM labelled l WHERE l.o_orderstatus = dataset) AS rows_original, "
        "6 AS columns_original, (SELECT count(*) FROM fixed f WHERE f.o_orderstatus = dataset) AS rows_fixed, 6 AS columns_fixed, "
        "round(avg(fixed - original), 6) AS avg_f1_improvement FROM impact JOIN st ON seg = dataset GROUP BY dataset",
        ["dirty_orders"],
        *_summary_ctes(),
    ),
)
def x03(spark, sf):
    return rounded(X.experiment_summary(_rule_results(spark, sf)), "quality_score", "avg_f1_improvement")


@query(
    "x04_data_reduction",
    sql.with_ctes(
        "SELECT dataset, original, retained, original - retained AS removed, round((original - retained) * 100.0::DOUBLE / original, 6) AS removed_pct FROM ("
        "SELECT 'orders' AS dataset, (SELECT count(*) FROM labelled) AS original, (SELECT count(*) FROM fixed) AS retained "
        "UNION ALL SELECT 'docs', (SELECT count(*) FROM doc_labels), (SELECT count(*) FROM (SELECT DISTINCT * FROM doc_labels WHERE quality IS NOT NULL AND toxic IS NOT NULL)))",
        ["dirty_orders", "doc_labels"],
        LABELLED,
        FIXED,
    ),
)
def x04(spark, sf):
    orders, docs = labelled_orders(spark, sf), doc_labels(spark, sf)
    pairs = {"orders": (orders, apply_fixes(orders, target="cls")), "docs": (docs, apply_fixes(docs))}
    return rounded(X.data_reduction(pairs), "removed_pct")


@query(
    "x05_improvement_matrix",
    sql.with_ctes(
        "SELECT dataset, round(max(fixed - original) FILTER (WHERE model = 'rule150'), 6) AS rule150, "
        "round(max(fixed - original) FILTER (WHERE model = 'rule200'), 6) AS rule200 FROM impact GROUP BY dataset",
        ["dirty_orders"],
        *RULE_CTES,
        IMPACT_CTE,
    ),
)
def x05(spark, sf):
    return rounded(X.improvement_matrix(rule_impact(spark, sf), ["rule150", "rule200"]), "rule150", "rule200")


@query(
    "x06_score_classes",
    sql.with_ctes(
        "SELECT seg AS o_custkey, round(quality_score, 6) AS quality_score, CASE WHEN quality_score > 75 THEN 'good' ELSE 'attention' END AS score_class FROM po",
        ["dirty_orders"],
        *sql.segments("po", "dirty_orders", "dirty_orders", "o_custkey", "o_orderpriority"),
    ),
)
def x06(spark, sf):
    scores = segment_profiles(dirty_orders(spark, sf), "o_custkey", "o_orderpriority").select("o_custkey", r6("quality_score").alias("quality_score"))
    return X.score_classes(scores)


def _decision(spark, sf, task):
    model = GainModel("lr")
    model.train(measured_gains(spark, sf), folds=2)
    orders = labelled_orders(spark, sf).withColumn("cls", (F.col("cls") == "high").cast("int"))
    return X.decide(
        orders, "cls", KEYS, built_in_rules(spark), model, default_history(spark), FEATURES, "finance", task, models=("lr",), exclude=KEYS, folds=2, **SIZE
    )


@query("x07_complete_decision")
def x07(spark, sf):
    return _decision(spark, sf, "classification")


@query("pm09_gated_fix")
def pm09(spark, sf):
    return _decision(spark, sf, "clustering").select("predicted_gain", "verdict", "actual_gain", "prediction_error")
