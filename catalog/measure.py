"""Model evaluation, repair impact, generalization and task metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import sql
from catalog.registry import query, rounded
from catalog.views import dirty_orders, table
from tablewright.functions import metrics as M
from tablewright.operators import impact as I
from tablewright.operators import tasks as K
from tablewright.operators.auc import class_auc, rank_sum_auc
from tablewright.operators.clusters import silhouette
from tablewright.operators.fixes import apply_fixes
from tablewright.operators.models import cross_validate, every_fold
from tablewright.operators.ranking import stratified_split

# Small models: what is registered here is the evaluation, the sizes are parameters.
SIZE = {"trees": 5, "depth": 4, "iterations": 20, "rounds": 3, "boost_depth": 3}
KEYS = ["o_orderkey"]
FEATURES = ["o_custkey", "o_totalprice"]


def labelled_orders(spark, sf):
    """Dirty orders with a class that depends on the price, one in seven labels flipped."""
    orders = dirty_orders(spark, sf).drop("o_orderdate")
    dear = F.coalesce(F.col("o_totalprice"), F.lit(0.0)) > 150000
    flipped = F.when(F.col("o_orderkey") % 7 == 0, ~dear).otherwise(dear)
    return orders.withColumn("cls", F.when(flipped, "high").otherwise("low"))


def _vectors(spark, sf, target="cls"):
    return I.prepare_table(labelled_orders(spark, sf), target, KEYS, KEYS)


@query("m01_random_forest")
def m01(spark, sf):
    return cross_validate(_vectors(spark, sf), ["rf"], folds=2, **SIZE)


@query("m02_logistic_regression")
def m02(spark, sf):
    return cross_validate(_vectors(spark, sf), ["lr"], folds=2, **SIZE)


@query("m03_boosted_trees")
def m03(spark, sf):
    return cross_validate(_vectors(spark, sf), ["xgb"], folds=2, **SIZE)


@query("m03_boosted_trees_multiclass")
def m03_multi(spark, sf):
    return cross_validate(_vectors(spark, sf, "o_orderstatus"), ["xgb"], folds=2, **SIZE)


@query("m06_cv_accuracy")
def m06(spark, sf):
    return every_fold(cross_validate(_vectors(spark, sf), ["lr"], folds=3, **SIZE)).select("model", "accuracy")


@query("m07_cv_weighted_f1")
def m07(spark, sf):
    return every_fold(cross_validate(_vectors(spark, sf), ["lr"], folds=3, **SIZE)).select("model", "f1")


@query("m08_cv_roc_auc_binary")
def m08(spark, sf):
    return every_fold(cross_validate(_vectors(spark, sf), ["lr"], folds=3, **SIZE)).select("model", "roc_auc")


@query("m09_cv_roc_auc_multiclass")
def m09(spark, sf):
    return every_fold(cross_validate(_vectors(spark, sf, "o_orderstatus"), ["lr"], folds=2, **SIZE)).select("model", "roc_auc")


# Prices in steps of 500, so that scores tie; a missing price has no score, which ranks lowest.
_STEPPED = "floor(o_totalprice / 500)"


@query(
    "m08_rank_sum_auc",
    sql.with_ctes(
        "SELECT fold, count(*) AS rows, sum(y)::BIGINT AS positives, round((sum(r) FILTER (WHERE y = 1) - sum(y) * (sum(y) + 1) / 2::DOUBLE) "
        "/ (sum(y) * (count(*) - sum(y))), 6) AS auc FROM (SELECT fold, y, rank() OVER (PARTITION BY fold ORDER BY score NULLS FIRST) + "
        "(count(*) OVER (PARTITION BY fold, score) - 1) / 2::DOUBLE AS r FROM scored) GROUP BY fold",
        ["dirty_orders"],
        ("scored", f"SELECT o_orderkey % 3 AS fold, {_STEPPED} AS score, (o_totalprice IS NOT NULL AND (o_totalprice > 150000) <> (o_orderkey % 7 = 0))::INT AS y FROM dirty_orders"),
    ),
)
def m08_rank_sum(spark, sf):
    """Prices as a score of the noisy class, per fold."""
    orders = labelled_orders(spark, sf)
    high = F.col("o_totalprice").isNotNull() & (F.col("cls") == "high")
    scored = orders.select((F.col("o_orderkey") % 3).alias("fold"), F.expr(_STEPPED).alias("score"), high.alias("positive"))
    return rounded(rank_sum_auc(scored, ["fold"]), "auc")


# One score per order status, in the order of the codes.
_STATUS_SCORES = ("floor(o_totalprice / 500)", "-floor(o_totalprice / 500)", "o_custkey % 50")
_STATUS = ("F", "O", "P")


@query(
    "m09_one_vs_rest_auc",
    sql.with_ctes(
        "SELECT fold, round(sum(coalesce((pos_ranks - p * (p + 1) / 2::DOUBLE) / nullif(p * (n - p), 0), 0) * p / n), 6) AS roc_auc FROM ("
        "SELECT fold, c, count(*) AS n, count(*) FILTER (WHERE y = c) AS p, coalesce(sum(r) FILTER (WHERE y = c), 0) AS pos_ranks FROM ("
        "SELECT fold, c, y, rank() OVER (PARTITION BY fold, c ORDER BY score NULLS FIRST) + (count(*) OVER (PARTITION BY fold, c, score) - 1) / 2::DOUBLE AS r "
        "FROM scored) GROUP BY fold, c) GROUP BY fold",
        ["dirty_orders"],
        (
            "scored",
            " UNION ALL ".join(
                f"SELECT o_orderkey % 2 AS fold, '{c}' AS c, o_orderstatus AS y, ({s})::DOUBLE AS score FROM dirty_orders WHERE o_orderstatus IS NOT NULL"
                for c, s in zip(_STATUS, _STATUS_SCORES)
            ),
        ),
    ),
)
def m09_one_vs_rest(spark, sf):
    """Three scores, one for each order status, against the rest and weighted by the share of the status."""
    orders = labelled_orders(spark, sf).filter("o_orderstatus IS NOT NULL")
    codes = F.when(F.col("o_orderstatus") == "F", 0.0).when(F.col("o_orderstatus") == "O", 1.0).otherwise(2.0)
    scores = F.array(*[F.expr(s).cast("double") for s in _STATUS_SCORES])
    scored = orders.select((F.col("o_orderkey") % 2).alias("fold"), codes.alias("label"), scores.alias("scores"))
    return rounded(class_auc(scored, [0.0, 1.0, 2.0], ["fold"]), "roc_auc")


# ---- metrics over a table of rule predictions ---------------------------------------------------------------------


def rule_predictions(spark, sf):
    """Two price rules as models, on the dirty orders and on the repaired ones, per order status."""
    orders = labelled_orders(spark, sf)
    sides = {"original": orders, "fixed": apply_fixes(orders, target="cls", keys=KEYS)}
    parts = []
    for side, t in sides.items():
        for model, limit in (("rule150", 150000), ("rule200", 200000)):
            guess = F.coalesce(F.col("o_totalprice"), F.lit(0.0)) > limit
            parts.append(
                t.select(
                    F.lit(side).alias("side"),
                    F.col("o_orderstatus").alias("dataset"),
                    F.lit(model).alias("model"),
                    (F.col("cls") == "high").cast("double").alias("label"),
                    guess.cast("double").alias("prediction"),
                )
            )
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


LABELLED = (
    "labelled",
    "SELECT * EXCLUDE (o_orderdate), CASE WHEN (coalesce(o_totalprice, 0) > 150000) <> (o_orderkey % 7 = 0) THEN 'high' ELSE 'low' END AS cls FROM dirty_orders",
)
FIXED = ("fixed", "SELECT DISTINCT * FROM labelled WHERE o_totalprice IS NOT NULL AND o_orderpriority IS NOT NULL")
_PREDICTIONS = (
    "predictions",
    " UNION ALL ".join(
        f"SELECT '{side}' AS side, o_orderstatus AS dataset, 'rule{limit}' AS model, (cls = 'high')::DOUBLE AS label, "
        f"(coalesce(o_totalprice, 0) > {limit}000)::DOUBLE AS prediction FROM {source}"
        for side, source in (("original", "labelled"), ("fixed", "fixed"))
        for limit in (150, 200)
    ),
)
_PER_CLASS = (
    "per_class",
    "SELECT side, dataset, model, c AS class, count(*) FILTER (WHERE label = c) AS support, count(*) FILTER (WHERE prediction = c) AS predicted, "
    "count(*) FILTER (WHERE label = c AND prediction = c) AS hits FROM predictions, (VALUES (0.0::DOUBLE), (1.0::DOUBLE)) k(c) GROUP BY ALL",
)
_SCORES = (
    "rule_scores",
    "SELECT side, dataset, model, sum(support)::BIGINT AS rows, sum(hits)::DOUBLE / sum(support) AS accuracy, "
    "sum(support * coalesce(hits::DOUBLE / nullif(predicted, 0), 0)) / sum(support) AS weighted_precision, "
    "sum(support * coalesce(hits::DOUBLE / nullif(support, 0), 0)) / sum(support) AS weighted_recall, "
    "sum(support * coalesce(hits * 2.0::DOUBLE / nullif(support + predicted, 0), 0)) / sum(support) AS weighted_f1 "
    "FROM per_class GROUP BY side, dataset, model",
)
RULE_CTES = [LABELLED, FIXED, _PREDICTIONS, _PER_CLASS, _SCORES]
_BY = ["side", "dataset", "model"]
_RATES = ("accuracy", "weighted_precision", "weighted_recall", "weighted_f1")


@query(
    "m10_classification_metrics",
    sql.with_ctes(
        "SELECT side, dataset, model, rows, " + ", ".join(f"round({r}, 6) AS {r}" for r in _RATES) + " FROM rule_scores",
        ["dirty_orders"],
        *RULE_CTES,
    ),
)
def m10(spark, sf):
    return rounded(M.classification_metrics(rule_predictions(spark, sf), _BY), *_RATES)


@query(
    "m10_class_metrics",
    sql.with_ctes(
        "SELECT side, dataset, model, class, support, predicted, hits, round(coalesce(hits::DOUBLE / nullif(predicted, 0), 0), 6) AS precision, "
        "round(coalesce(hits::DOUBLE / nullif(support, 0), 0), 6) AS recall FROM per_class",
        ["dirty_orders"],
        *RULE_CTES,
    ),
)
def m10_class(spark, sf):
    return rounded(M.class_metrics(rule_predictions(spark, sf), _BY).drop("f1"), "precision", "recall")


def rule_impact(spark, sf):
    """Impact rows of the two rules: weighted F1 before and after the default repairs."""
    scored = M.classification_metrics(rule_predictions(spark, sf), _BY)
    pick = lambda side: F.max(F.when(F.col("side") == side, F.col("weighted_f1")))
    sides = scored.groupBy("dataset", "model").agg(pick("original").alias("original"), pick("fixed").alias("fixed"))
    return I.with_improvement(sides.select("dataset", "model", F.lit("f1").alias("metric"), "original", "fixed"))


IMPACT_CTE = (
    "impact",
    "SELECT dataset, model, max(weighted_f1) FILTER (WHERE side = 'original') AS original, max(weighted_f1) FILTER (WHERE side = 'fixed') AS fixed "
    "FROM rule_scores GROUP BY dataset, model",
)


@query(
    "m12_impact_report",
    sql.with_ctes(
        "SELECT dataset, model, (SELECT count(*) FROM labelled) AS rows_original, 6 AS columns_original, (SELECT count(*) FROM fixed) AS rows_fixed, 6 AS columns_fixed, "
        "(SELECT count(*) FROM labelled) - (SELECT count(*) FROM fixed) AS rows_removed, round(original, 6) AS f1_original, round(fixed, 6) AS f1_fixed, "
        "round(fixed - original, 6) AS f1_improvement, round((fixed - original) * 100 / original, 6) AS f1_improvement_pct FROM impact",
        ["dirty_orders"],
        *RULE_CTES,
        IMPACT_CTE,
    ),
)
def m12(spark, sf):
    orders = labelled_orders(spark, sf)
    report = I.impact_report(rule_impact(spark, sf), orders, apply_fixes(orders, target="cls", keys=KEYS))
    report = report.withColumns({c: F.col(c).cast("long") for c in ("rows_original", "rows_fixed", "rows_removed")})
    return rounded(report, "f1_original", "f1_fixed", "f1_improvement", "f1_improvement_pct")


@query("m11_repair_impact")
def m11(spark, sf):
    orders = labelled_orders(spark, sf)
    return I.analyze_impact(orders, apply_fixes(orders, target="cls", keys=KEYS), "cls", KEYS, exclude=KEYS, folds=2, **SIZE)


@query("m16_issue_impact")
def m16(spark, sf):
    return I.issue_impact(labelled_orders(spark, sf).na.drop("any"), "missing_values", "cls", KEYS, exclude=KEYS, folds=2, **SIZE)


@query("m17_rank_issues")
def m17(spark, sf):
    clean = labelled_orders(spark, sf).na.drop("any")
    return I.rank_issues(clean, "cls", KEYS, models=("lr",), exclude=KEYS, folds=2, **SIZE)


@query("m18_cleaning_arms")
def m18(spark, sf):
    return I.compare_arms(labelled_orders(spark, sf), "cls", KEYS, models=("lr",), exclude=KEYS, folds=2, **SIZE)


SPLIT_CTES = [
    ("base", "SELECT DISTINCT * FROM labelled"),
    (
        "flagged",
        "SELECT * EXCLUDE (n, rn), rn <= round(n * 0.2::DOUBLE) AS is_test FROM (SELECT *, count(*) OVER (PARTITION BY cls) AS n, "
        "row_number() OVER (PARTITION BY cls ORDER BY " + sql.hash_key("o_orderkey") + ", o_orderkey) AS rn FROM base)",
    ),
]

# ---- generalization -----------------------------------------------------------------------------------------------


@query(
    "g02_split_and_fix",
    sql.with_ctes(
        "SELECT part, count(*) AS rows, count(o_totalprice) AS priced FROM (SELECT 'train' AS part, o_totalprice FROM flagged WHERE NOT is_test "
        "UNION ALL SELECT 'test', o_totalprice FROM flagged WHERE is_test "
        "UNION ALL SELECT 'train_fixed', o_totalprice FROM (SELECT DISTINCT * FROM flagged WHERE NOT is_test AND o_totalprice IS NOT NULL AND o_orderpriority IS NOT NULL) "
        "UNION ALL SELECT 'test_fixed', o_totalprice FROM (SELECT DISTINCT * FROM flagged WHERE is_test AND o_totalprice IS NOT NULL AND o_orderpriority IS NOT NULL)) GROUP BY part",
        ["dirty_orders"],
        LABELLED,
        *SPLIT_CTES,
    ),
)
def g02(spark, sf):
    parts = I.split_and_fix(labelled_orders(spark, sf).distinct(), "cls", KEYS)
    rows = [
        t.agg(F.lit(n).alias("part"), F.count(F.lit(1)).alias("rows"), F.count("o_totalprice").alias("priced"))
        for n, t in zip(("train", "test", "train_fixed", "test_fixed"), parts)
    ]
    return rows[0].unionByName(rows[1]).unionByName(rows[2]).unionByName(rows[3])


def _generalization(spark, sf):
    return I.generalization(labelled_orders(spark, sf), "cls", KEYS, exclude=KEYS, dataset="orders", **SIZE)


@query("g03_generalization")
def g03(spark, sf):
    return _generalization(spark, sf)


@query("g04_generalization_summary")
def g04(spark, sf):
    return I.generalization_summary(_generalization(spark, sf))


# ---- tasks --------------------------------------------------------------------------------------------------------


def _split(spark, sf):
    """Train part, test part and the repaired test part of the dirty orders; rows without a price have no regression target."""
    flagged = stratified_split(labelled_orders(spark, sf).distinct(), "cls", KEYS)
    train, test = (flagged.filter(F.col("is_test") == part).drop("is_test") for part in (False, True))
    return train, test, apply_fixes(test, target="cls", keys=KEYS)


def _coded(*tables):
    return [t.withColumn("cls", (F.col("cls") == "high").cast("int")) for t in tables]


@query("k01_classification_impact")
def k01(spark, sf):
    train, test, fixed = _coded(*_split(spark, sf))
    return K.task_impact("classification", train, test, fixed, FEATURES, "cls", **SIZE)


@query("k02_regression_impact")
def k02(spark, sf):
    train, test, fixed = (t.filter("o_totalprice IS NOT NULL") for t in _coded(*_split(spark, sf)))
    return K.task_impact("regression", train, test, fixed, ["o_custkey", "cls"], "o_totalprice", trees=5, depth=4)


_FIXED_TEST = "SELECT DISTINCT o_orderkey, y, x FROM flagged_y WHERE is_test AND o_orderpriority IS NOT NULL"
_SIDES = {"original": "SELECT o_orderkey, y, x FROM flagged_y WHERE is_test", "fixed": _FIXED_TEST}


@query(
    "k02_linear_impact",
    sql.with_ctes(
        "SELECT 'regression' AS task, 'lr' AS model, metric, round(original, 6) AS original, round(fixed, 6) AS fixed, "
        "round(CASE WHEN original > 0 THEN CASE WHEN metric = 'r2' THEN fixed - original ELSE original - fixed END / original * 100 ELSE 0 END, 6) AS improvement_pct FROM ("
        + " UNION ALL ".join(
            f"SELECT '{m}' AS metric, max({m}) FILTER (WHERE side = 'original') AS original, max({m}) FILTER (WHERE side = 'fixed') AS fixed FROM measured"
            for m in ("rmse", "mae", "r2")
        )
        + ")",
        ["dirty_orders"],
        LABELLED,
        *SPLIT_CTES,
        ("flagged_y", "SELECT *, o_totalprice AS y, (cls = 'high')::INT::DOUBLE AS x FROM flagged WHERE o_totalprice IS NOT NULL"),
        ("plane", "SELECT regr_slope(y, x) AS a, regr_intercept(y, x) AS b FROM flagged_y WHERE NOT is_test"),
        ("errors", " UNION ALL ".join(f"SELECT '{side}' AS side, y, y - b - a * x AS e FROM ({rows}), plane" for side, rows in _SIDES.items())),
        ("measured", "SELECT side, sqrt(avg(e * e)) AS rmse, avg(abs(e)) AS mae, 1 - avg(e * e) / var_pop(y) AS r2 FROM errors GROUP BY side"),
    ),
)
def k02_linear(spark, sf):
    train, test, fixed = (t.filter("o_totalprice IS NOT NULL") for t in _coded(*_split(spark, sf)))
    impact = K.task_impact("regression", train, test, fixed, ["cls"], "o_totalprice", models=("lr",))
    return rounded(impact, "original", "fixed", "improvement_pct")


@query(
    "k02_regression_metrics",
    "SELECT p_brand, count(*) AS rows, round(sqrt(avg(e * e)), 6) AS rmse, round(avg(abs(e)), 6) AS mae, "
    "round(CASE WHEN var_pop(y) > 0 THEN 1 - avg(e * e) / var_pop(y) END, 6) AS r2 FROM "
    "(SELECT p_brand, p_retailprice AS y, p_retailprice - (900 + p_partkey % 100 * 0.9::DOUBLE + p_size * 0.1::DOUBLE) AS e FROM part) GROUP BY p_brand",
)
def k02_metrics(spark, sf):
    guess = F.lit(900) + F.col("p_partkey") % 100 * 0.9 + F.col("p_size") * 0.1
    predictions = table(spark, sf, "part").select("p_brand", F.col("p_retailprice").alias("label"), guess.alias("prediction"))
    return rounded(M.regression_metrics(predictions, ["p_brand"]), "rmse", "mae", "r2")


@query("k03_clustering_impact")
def k03(spark, sf):
    _, test, fixed = _split(spark, sf)
    return K.task_impact("clustering", test, test, fixed, FEATURES, "cls")


@query(
    "k03_davies_bouldin",
    sql.with_ctes(
        "SELECT round(avg(worst), 6) AS davies_bouldin FROM (SELECT a.c, max((a.s + b.s) / sqrt((a.x - b.x) ^ 2 + (a.y - b.y) ^ 2)) AS worst "
        "FROM scatter a, scatter b WHERE a.c <> b.c GROUP BY a.c)",
        [],
        ("points", "SELECT p_size::DOUBLE AS px, p_retailprice AS py, p_size // 20 AS c FROM part"),
        ("centre", "SELECT c, avg(px) AS x, avg(py) AS y FROM points GROUP BY c"),
        ("scatter", "SELECT c, x, y, avg(sqrt((px - x) ^ 2 + (py - y) ^ 2)) AS s FROM points JOIN centre USING (c) GROUP BY c, x, y"),
    ),
)
def k03_dbi(spark, sf):
    points = table(spark, sf, "part").withColumn("cluster", F.floor(F.col("p_size") / 20).cast("int"))
    return rounded(M.davies_bouldin(points, ["p_size", "p_retailprice"]), "davies_bouldin")


@query(
    "k03_silhouette",
    sql.with_ctes(
        "SELECT count(*) AS points, round(avg(CASE WHEN greatest(a, b) > 0 THEN (b - a) / greatest(a, b) ELSE 0 END), 6) AS silhouette FROM "
        "(SELECT id, max(d) FILTER (WHERE c = other) AS a, min(d) FILTER (WHERE c <> other) AS b FROM means GROUP BY id)",
        [],
        ("points", "SELECT p_partkey AS id, p_size::DOUBLE AS px, p_retailprice AS py, p_size // 20 AS c FROM part"),
        (
            "means",
            "SELECT p.id, p.c, q.c AS other, sum(sqrt((p.px - q.px) ^ 2 + (p.py - q.py) ^ 2)) / (count(*) - (p.c = q.c)::INT) AS d "
            "FROM points p, points q GROUP BY p.id, p.c, q.c",
        ),
    ),
)
def k03_silhouette(spark, sf):
    """All points against all points, in blocks."""
    points = table(spark, sf, "part").withColumn("cluster", F.floor(F.col("p_size") / 20).cast("int"))
    return rounded(silhouette(points, ["p_size", "p_retailprice"]), "silhouette")
