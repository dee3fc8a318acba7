"""Fixes, set operations and sampling."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import sql
from catalog.registry import query, r6, rounded
from catalog.views import COLUMNS, dirty_events, dirty_orders, doc_labels, table
from tablewright.operators import fixes as X
from tablewright.operators.ranking import sample_exact
from tablewright.operators.sequence import fill_in_order

ORDERS = ", ".join(COLUMNS["dirty_orders"]["all"])
NOT_NULL = "o_totalprice IS NOT NULL AND o_orderpriority IS NOT NULL"


@query("f01_drop_missing", sql.with_ctes(f"SELECT {ORDERS} FROM dirty_orders WHERE {NOT_NULL}", ["dirty_orders"]))
def f01(spark, sf):
    return X.fix_missing(dirty_orders(spark, sf), "drop")


def _filled_sql(aggregate: str) -> str:
    return sql.with_ctes(
        "SELECT o_orderkey, o_custkey::DOUBLE AS o_custkey, o_orderpriority, round(coalesce(o_totalprice, v), 6) AS o_totalprice "
        "FROM dirty_orders, fit",
        ["dirty_orders"],
        ("fit", f"SELECT {aggregate} AS v FROM dirty_orders"),
    )


@query("f02_fill_mean", _filled_sql("avg(o_totalprice)"))
def f02(spark, sf):
    filled = X.fix_missing(dirty_orders(spark, sf), "mean")
    return filled.select(F.col("o_orderkey").cast("long"), "o_custkey", "o_orderpriority", r6("o_totalprice").alias("o_totalprice"))


@query("f03_fill_median", _filled_sql("quantile_cont(o_totalprice, 0.5)"))
def f03(spark, sf):
    filled = X.fix_missing(dirty_orders(spark, sf), "median")
    return filled.select(F.col("o_orderkey").cast("long"), "o_custkey", "o_orderpriority", r6("o_totalprice").alias("o_totalprice"))


def _ordered_fill_sql(over: str) -> str:
    def fill(c: str) -> str:
        return (
            f"coalesce(last_value({c} IGNORE NULLS) OVER ({over} ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), "
            f"first_value({c} IGNORE NULLS) OVER ({over} ORDER BY o_orderkey ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS {c}"
        )

    return sql.with_ctes(
        f"SELECT o_orderkey, o_custkey, {fill('o_totalprice')}, {fill('o_orderpriority')} FROM one",
        ["dirty_orders"],
        ("one", "SELECT DISTINCT * FROM dirty_orders"),
    )


@query("f04_forward_fill", _ordered_fill_sql(""))
def f04(spark, sf):
    one = dirty_orders(spark, sf).distinct()
    filled = X.fix_missing(one, "forward_fill", order_by="o_orderkey")
    return filled.select("o_orderkey", "o_custkey", "o_totalprice", "o_orderpriority")


@query("f04_forward_fill_by_customer", _ordered_fill_sql("PARTITION BY o_custkey"))
def f04_by(spark, sf):
    filled = fill_in_order(dirty_orders(spark, sf).distinct(), "o_orderkey", ["o_custkey"], blocks=4)
    return filled.select("o_orderkey", "o_custkey", "o_totalprice", "o_orderpriority")


_EVENT_NUM = COLUMNS["dirty_events"]["numeric"]


@query(
    "f05_iqr_filter",
    sql.with_ctes(
        "SELECT event_id, value FROM dirty_events, fence WHERE "
        + " AND ".join(f"{c} >= lo_{c} AND {c} <= hi_{c}" for c in _EVENT_NUM),
        ["dirty_events"],
        ("fence", sql.fences("dirty_events", _EVENT_NUM, 3.0)),
    ),
)
def f05(spark, sf):
    return X.remove_outliers(dirty_events(spark, sf), "iqr").select("event_id", "value")


@query(
    "f06_zscore_filter",
    sql.with_ctes(
        "SELECT o_orderkey, o_totalprice FROM dirty_orders, fit WHERE "
        + " AND ".join(f"abs(coalesce({c}, m_{c}) - m_{c}) / s_{c} < 1.5" for c in COLUMNS["dirty_orders"]["numeric"]),
        ["dirty_orders"],
        (
            "fit",
            "SELECT "
            + ", ".join(
                f"avg({c}) AS m_{c}, sqrt(var_pop({c}) * count({c}) / count(*)) AS s_{c}"
                for c in COLUMNS["dirty_orders"]["numeric"]
            )
            + " FROM dirty_orders",
        ),
    ),
)
def f06(spark, sf):
    return X.remove_outliers(dirty_orders(spark, sf), "zscore", 1.5).select("o_orderkey", "o_totalprice")


@query("f07_distinct_rows", sql.with_ctes(f"SELECT DISTINCT {ORDERS} FROM dirty_orders", ["dirty_orders"]))
def f07(spark, sf):
    return X.remove_duplicates(dirty_orders(spark, sf))


@query(
    "f07_drop_all_copies",
    sql.with_ctes(f"SELECT {ORDERS} FROM dirty_orders GROUP BY ALL HAVING count(*) = 1", ["dirty_orders"]),
)
def f07_none(spark, sf):
    return X.remove_duplicates(dirty_orders(spark, sf), keep=False)


_UNDER = (
    "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY cls ORDER BY "
    + sql.hash_key("event_id")
    + ", event_id) AS rn FROM dirty_events), ext WHERE rn <= cap OR closed"
)
_EXT = (
    "ext",
    "SELECT least(3 * min(n), max(n)) AS cap, max(n) <= 10 * min(n) AS closed FROM c",
)


@query(
    "f08_undersample",
    sql.with_ctes(f"SELECT event_id, cls FROM ({_UNDER})", ["dirty_events"], ("c", sql.classes("dirty_events", "cls")), _EXT),
)
def f08(spark, sf):
    return X.undersample(dirty_events(spark, sf), "cls", ["event_id"]).select("event_id", "cls")


@query(
    "f08_undersample_gate_closed",
    sql.with_ctes("SELECT doc_id, lang FROM doc_labels", ["doc_labels"]),
)
def f08_closed(spark, sf):
    return X.rebalance(doc_labels(spark, sf), "lang", ["doc_id"]).select("doc_id", "lang")


@query(
    "f09_oversample",
    sql.with_ctes(
        "SELECT event_id, cls, copies FROM (SELECT event_id, cls, CASE WHEN n >= top * 0.5 THEN 1 "
        "ELSE goal // n + CASE WHEN rn <= goal % n THEN 1 ELSE 0 END END AS copies FROM "
        "(SELECT event_id, cls, n, (SELECT max(n) FROM c) AS top, (SELECT CAST(floor(max(n) * 0.5) AS BIGINT) FROM c) AS goal, "
        "row_number() OVER (PARTITION BY cls ORDER BY "
        + sql.hash_key("event_id")
        + ", event_id) AS rn FROM dirty_events JOIN c ON c.class = dirty_events.cls))",
        ["dirty_events"],
        ("c", sql.classes("dirty_events", "cls")),
    ),
)
def f09(spark, sf):
    grown = X.rebalance(dirty_events(spark, sf), "cls", ["event_id"], "oversample")
    return grown.groupBy("event_id", "cls").agg(F.count(F.lit(1)).alias("copies"))


@query(
    "f10_scale_features",
    sql.with_ctes(
        "SELECT o_orderstatus, round((o_orderkey - ak) / sk, 6) AS o_orderkey, round((o_custkey - ac) / sc, 6) AS o_custkey, "
        "round((o_totalprice - ap) / sp, 6) AS o_totalprice FROM dirty_orders, fit",
        ["dirty_orders"],
        (
            "fit",
            "SELECT avg(o_orderkey) AS ak, stddev_pop(o_orderkey) AS sk, avg(o_custkey) AS ac, stddev_pop(o_custkey) AS sc, "
            "avg(o_totalprice) AS ap, stddev_pop(o_totalprice) AS sp FROM dirty_orders",
        ),
    ),
)
def f10(spark, sf):
    scaled = X.scale_features(dirty_orders(spark, sf), "o_orderpriority")
    names = ("o_orderkey", "o_custkey", "o_totalprice")
    return rounded(scaled.select("o_orderstatus", *names), *names)


_ALL_FIXES = {"missing_values": "drop", "duplicates": True, "outliers": True, "imbalance": True, "scale": True}


def _cases(spark, sf):
    """Dirty orders with a rare class as the last column, so that every repair has something to do."""
    rare = F.when(F.col("o_orderkey") % 40 == 1, "rare").otherwise("common")
    return dirty_orders(spark, sf).select("o_orderkey", "o_custkey", (F.pow(F.col("o_totalprice"), 4) / 1e15).alias("amount"), rare.alias("cls"))


_STAGES = [
    (
        "cases",
        "SELECT o_orderkey, o_custkey, pow(o_totalprice, 4) / 1e15 AS amount, "
        "CASE WHEN o_orderkey % 40 = 1 THEN 'rare' ELSE 'common' END AS cls FROM dirty_orders",
    ),
    ("full_rows", "SELECT * FROM cases WHERE amount IS NOT NULL"),
    ("once", "SELECT DISTINCT * FROM full_rows"),
    (
        "fence",
        "SELECT "
        + ", ".join(
            f"quantile_cont({c}, 0.25) - 3.0::DOUBLE * (quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)) AS lo_{c}, "
            f"quantile_cont({c}, 0.75) + 3.0::DOUBLE * (quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)) AS hi_{c}"
            for c in ("o_orderkey", "o_custkey", "amount")
        )
        + " FROM once",
    ),
    (
        "inside",
        "SELECT once.* FROM once, fence WHERE "
        + " AND ".join(f"{c} >= lo_{c} AND {c} <= hi_{c}" for c in ("o_orderkey", "o_custkey", "amount")),
    ),
    ("c", "SELECT cls AS class, count(*) AS n FROM inside GROUP BY cls"),
    (
        "even",
        "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY cls ORDER BY "
        + sql.hash_key("o_orderkey")
        + ", o_orderkey) AS rn FROM inside), (SELECT least(3 * min(n), max(n)) AS cap, max(n) <= 10 * min(n) AS closed FROM c) "
        "WHERE rn <= cap OR closed",
    ),
]


@query(
    "f11_ordered_fixes",
    sql.with_ctes(
        "SELECT cls, round((o_orderkey - ak) / sk, 6) AS o_orderkey, round((o_custkey - ac) / sc, 6) AS o_custkey, "
        "round((amount - ap) / sp, 6) AS amount FROM even, (SELECT avg(o_orderkey) AS ak, stddev_pop(o_orderkey) AS sk, "
        "avg(o_custkey) AS ac, stddev_pop(o_custkey) AS sc, avg(amount) AS ap, stddev_pop(amount) AS sp FROM even)",
        ["dirty_orders"],
        *_STAGES,
    ),
)
def f11(spark, sf):
    fixed = X.apply_fixes(_cases(spark, sf), _ALL_FIXES, "cls", ["o_orderkey"])
    return rounded(fixed, "o_orderkey", "o_custkey", "amount")


@query(
    "f12_fix_summary",
    sql.with_ctes(
        "SELECT 1 AS position, 'missing_values' AS step, 'drop' AS strategy, (SELECT count(*) FROM cases) AS rows_before, (SELECT count(*) FROM full_rows) AS rows_after "
        "UNION ALL SELECT 2, 'duplicates', 'first', (SELECT count(*) FROM full_rows), (SELECT count(*) FROM once) "
        "UNION ALL SELECT 3, 'outliers', 'iqr', (SELECT count(*) FROM once), (SELECT count(*) FROM inside) "
        "UNION ALL SELECT 4, 'imbalance', 'undersample', (SELECT count(*) FROM inside), (SELECT count(*) FROM even) "
        "UNION ALL SELECT 5, 'scaling', 'standard', (SELECT count(*) FROM even), (SELECT count(*) FROM even)",
        ["dirty_orders"],
        *_STAGES,
    ),
)
def f12(spark, sf):
    return X.fix_summary(_cases(spark, sf), _ALL_FIXES, "cls", ["o_orderkey"]).drop("rows_removed")


@query(
    "u01_union_of_classes",
    sql.with_ctes(
        "SELECT event_id, cls FROM dirty_events WHERE cls = 'fraud' UNION ALL SELECT event_id, cls FROM dirty_events WHERE cls = 'ok' "
        "UNION ALL SELECT event_id, cls FROM dirty_events WHERE cls = 'fraud'",
        ["dirty_events"],
    ),
)
def u01(spark, sf):
    events = dirty_events(spark, sf).select("event_id", "cls")
    fraud = events.filter("cls = 'fraud'")
    return fraud.unionByName(events.filter("cls = 'ok'")).unionByName(fraud)


@query(
    "s03_exact_sample",
    f"SELECT o_orderkey, o_totalprice FROM orders ORDER BY {sql.hash_key('o_orderkey')}, o_orderkey LIMIT 500",
)
def s03(spark, sf):
    return sample_exact(table(spark, sf, "orders"), 500, ["o_orderkey"]).select("o_orderkey", "o_totalprice")
