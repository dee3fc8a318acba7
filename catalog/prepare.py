"""Projections, feature preparation, fault injection, splits."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from catalog import sql
from catalog.registry import query, rounded
from catalog.views import COLUMNS, dirty_events, dirty_orders, doc_labels, table
from tablewright.functions.columns import column_classes, hex_share
from tablewright.operators import corrupt as C
from tablewright.operators import encode as E
from tablewright.operators.fixes import fill_mean
from tablewright.operators.models import fold_count_column
from tablewright.operators.profile import missing_counts
from tablewright.operators.groups import grouped_folds, grouped_split
from tablewright.operators.ranking import stratified_folds, stratified_split

_CLASS_OF = {
    c: "numeric" if c in COLUMNS["dirty_orders"]["numeric"] else "categorical" if c in COLUMNS["dirty_orders"]["strings"] else "other"
    for c in COLUMNS["dirty_orders"]["all"]
}


@query(
    "p01_column_classes",
    sql.with_ctes(
        'SELECT m."column", k.class, m.n AS rows, m.missing FROM m JOIN (VALUES '
        + ", ".join(f"('{c}', '{k}')" for c, k in _CLASS_OF.items())
        + ') k("column", class) ON m."column" = k."column"',
        ["dirty_orders"],
        ("m", sql.missing("dirty_orders")),
    ),
)
def p01(spark, sf):
    orders = dirty_orders(spark, sf)
    kinds = column_classes(orders).select("column", "class")
    return missing_counts(orders).join(F.broadcast(kinds), "column").select("column", "class", "rows", "missing")


@query(
    "p02_split_features_target",
    sql.with_ctes(
        "SELECT 'features' AS part, count(*) AS rows, count(o_totalprice) AS present FROM dirty_orders "
        "UNION ALL SELECT 'target', count(*), count(o_orderpriority) FROM dirty_orders",
        ["dirty_orders"],
    ),
)
def p02(spark, sf):
    features, target = E.split_target(dirty_orders(spark, sf))
    return features.agg(F.lit("features").alias("part"), F.count(F.lit(1)).alias("rows"), F.count("o_totalprice").alias("present")).unionByName(
        target.agg(F.lit("target").alias("part"), F.count(F.lit(1)).alias("rows"), F.count("o_orderpriority").alias("present"))
    )


@query(
    "p03_align_columns",
    "SELECT 0 AS p_partkey, 0 AS p_size, s_acctbal, s_suppkey FROM supplier UNION ALL "
    "SELECT p_partkey, p_size, 0, 0 FROM part",
)
def p03(spark, sf):
    left, right = E.align(
        table(spark, sf, "supplier").select("s_suppkey", "s_acctbal"), table(spark, sf, "part").select("p_size", "p_partkey")
    )
    return left.union(right)


@query("p04_mask_filter", sql.with_ctes("SELECT event_id, value FROM dirty_events WHERE cls = 'fraud' AND value > 10", ["dirty_events"]))
def p04(spark, sf):
    return dirty_events(spark, sf).filter((F.col("cls") == "fraud") & (F.col("value") > 10)).select("event_id", "value")


@query(
    "e01_encode_target",
    sql.with_ctes(
        "SELECT o_orderkey, code AS o_orderpriority FROM dirty_orders LEFT JOIN codes ON v = o_orderpriority",
        ["dirty_orders"],
        (
            "codes",
            "SELECT v, dense_rank() OVER (ORDER BY v) - 1 AS code FROM (SELECT DISTINCT o_orderpriority AS v FROM dirty_orders "
            "WHERE o_orderpriority IS NOT NULL)",
        ),
    ),
)
def e01(spark, sf):
    return E.encode_target(dirty_orders(spark, sf), "o_orderpriority").select("o_orderkey", "o_orderpriority")


@query(
    "e02_fill_feature_means",
    sql.with_ctes(
        "SELECT doc_id, round(coalesce(toxic, m), 6) AS toxic FROM doc_labels, (SELECT avg(toxic) AS m FROM doc_labels)", ["doc_labels"]
    ),
)
def e02(spark, sf):
    docs = doc_labels(spark, sf).select("doc_id", "toxic")
    return rounded(fill_mean(docs, ["toxic"]), "toxic")


@query(
    "e03_encode_categoricals",
    sql.with_ctes(
        "SELECT o_orderkey, (SELECT count(DISTINCT coalesce(b.o_orderpriority, 'MISSING')) FROM dirty_orders b "
        "WHERE coalesce(b.o_orderpriority, 'MISSING') < k) AS o_orderpriority, s.code AS o_orderstatus FROM "
        "(SELECT *, coalesce(o_orderpriority, 'MISSING') AS k FROM dirty_orders) JOIN "
        "(SELECT o_orderstatus AS st, dense_rank() OVER (ORDER BY o_orderstatus) - 1 AS code FROM "
        "(SELECT DISTINCT o_orderstatus FROM dirty_orders)) s ON st = o_orderstatus",
        ["dirty_orders"],
    ),
)
def e03(spark, sf):
    coded, _ = E.encode_categoricals(dirty_orders(spark, sf), ["o_orderpriority", "o_orderstatus"])
    return coded.select("o_orderkey", "o_orderpriority", "o_orderstatus")


@query(
    "e03_encode_high_cardinality",
    "SELECT event_id, dense_rank() OVER (ORDER BY props) - 1 AS props FROM events",
)
def e03_props(spark, sf):
    events = table(spark, sf, "events")
    values = events.select("props").distinct()
    codes = E.ordinal_codes(values, "props", blocks=4)
    return E.apply_codes(events, "props", codes).select("event_id", "props")


@query(
    "e04_shared_target_codes",
    sql.with_ctes(
        "SELECT side, k, code FROM sides JOIN (SELECT v, dense_rank() OVER (ORDER BY v) - 1 AS code FROM (SELECT DISTINCT v FROM sides)) USING (v)",
        [],
        (
            "sides",
            "SELECT 'customer' AS side, c_custkey AS k, c_mktsegment AS v FROM customer UNION ALL "
            "SELECT 'part', p_partkey, p_type FROM part",
        ),
    ),
)
def e04(spark, sf):
    left = table(spark, sf, "customer").select(F.lit("customer").alias("side"), F.col("c_custkey").alias("k"), F.col("c_mktsegment").alias("code"))
    right = table(spark, sf, "part").select(F.lit("part").alias("side"), F.col("p_partkey").alias("k"), F.col("p_type").alias("code"))
    a, b, _ = E.shared_target_codes(left, right, "code")
    return a.unionByName(b)


@query(
    "e05_fill_label_mode",
    sql.with_ctes(
        "SELECT doc_id, coalesce(quality, m) AS quality FROM doc_labels, (SELECT quality AS m FROM doc_labels WHERE quality IS NOT NULL "
        "GROUP BY quality ORDER BY count(*) DESC, quality LIMIT 1)",
        ["doc_labels"],
    ),
)
def e05(spark, sf):
    return E.fill_mode(doc_labels(spark, sf), "quality").select("doc_id", "quality")


def _hit(column: str, share: float) -> str:
    return f"{sql.hash_key('event_id', f'{column}-42')} < '{hex_share(share)}'"


@query(
    "m13_inject_missing",
    "SELECT event_id, value, user_id FROM (SELECT event_id, "
    f"CASE WHEN NOT {_hit('value', 0.1)} THEN value END AS value, CASE WHEN NOT {_hit('user_id', 0.1)} THEN user_id END AS user_id "
    "FROM events) WHERE value IS NOT NULL AND user_id IS NOT NULL",
)
def m13(spark, sf):
    return C.corrupt(table(spark, sf, "events").select("event_id", "value", "user_id"), "missing_values", ["event_id"])


@query(
    "m14_inject_outliers",
    f"SELECT event_id, round(CASE WHEN {_hit('value', 0.05)} THEN value * 5 ELSE value END, 6) AS value, "
    f"round(CASE WHEN {_hit('user_id', 0.05)} THEN user_id * 5.0::DOUBLE ELSE user_id::DOUBLE END, 6) AS user_id FROM events",
)
def m14(spark, sf):
    hit = C.corrupt(table(spark, sf, "events").select("event_id", "value", "user_id"), "outliers", ["event_id"])
    return rounded(hit, "value", "user_id")


@query(
    "m15_inject_duplicates",
    "SELECT event_id, value FROM events UNION ALL SELECT event_id, value FROM (SELECT event_id, value, row_number() OVER (ORDER BY "
    + sql.hash_key("event_id")
    + ", event_id) AS rn FROM events) WHERE rn <= (SELECT CAST(floor(0.05 * count(*)) AS BIGINT) FROM events)",
)
def m15(spark, sf):
    return C.corrupt(table(spark, sf, "events").select("event_id", "value"), "duplicates", ["event_id"])


def _unit(column: str, start: int) -> str:
    return f"((('0x' || substr({sql.hash_key('event_id', f'{column}-42')}, {start}, 8))::BIGINT + 0.5::DOUBLE) / 4294967296.0::DOUBLE)"


@query(
    "k04_inject_noise",
    "SELECT event_id, round(value * 0.95::DOUBLE + 0.01::DOUBLE * sqrt(-2.0::DOUBLE * ln("
    + _unit("value", 1)
    + f")) * cos({_unit('value', 9)} * {2 * math.pi!r}::DOUBLE), 6) AS value FROM events",
)
def k04(spark, sf):
    return rounded(C.inject_noise(table(spark, sf, "events").select("event_id", "value"), ["event_id"]), "value")


@query(
    "m04_fold_count",
    "SELECT event_type, count(*) AS rows, least(5, greatest(2, count(*) // 100))::INTEGER AS folds FROM events GROUP BY event_type",
)
def m04(spark, sf):
    n = F.count(F.lit(1))
    return table(spark, sf, "events").groupBy("event_type").agg(n.alias("rows"), fold_count_column(n).alias("folds"))


@query(
    "m05_stratified_folds",
    sql.with_ctes(
        "SELECT event_id, ((row_number() OVER (PARTITION BY cls ORDER BY "
        + sql.hash_key("event_id")
        + ", event_id) - 1) % 5)::INTEGER AS fold FROM dirty_events",
        ["dirty_events"],
    ),
)
def m05(spark, sf):
    events = dirty_events(spark, sf)
    largest = events.groupBy("cls").count().agg(F.max("count")).first()[0]
    return stratified_folds(events, "cls", 5, ["event_id"], largest_class=largest).select("event_id", "fold")


@query(
    "g01_stratified_split",
    sql.with_ctes(
        "SELECT event_id, rn <= round(n * 0.2::DOUBLE) AS is_test FROM (SELECT event_id, count(*) OVER (PARTITION BY cls) AS n, "
        "row_number() OVER (PARTITION BY cls ORDER BY "
        + sql.hash_key("event_id")
        + ", event_id) AS rn FROM dirty_events)",
        ["dirty_events"],
    ),
)
def g01(spark, sf):
    return stratified_split(dirty_events(spark, sf), "cls", ["event_id"]).select("event_id", "is_test")


def _grouped(key: str, k: int) -> list[tuple[str, str]]:
    """Folds of whole groups of orders: by falling size and the md5 of the key, back and forth over k folds."""
    return [
        ("cells", f"SELECT {key} AS g, o_orderstatus AS c, count(*) AS n FROM dirty_orders GROUP BY ALL"),
        ("sized", "SELECT g, c, sum(n) OVER (PARTITION BY g) AS rows, row_number() OVER (PARTITION BY g ORDER BY n DESC, c) AS r FROM cells"),
        (
            "placed",
            "SELECT g, rows::BIGINT AS rows, row_number() OVER (PARTITION BY c ORDER BY rows DESC, md5('false:{\"v\":' || g || '}|42')) - 1 AS p FROM sized WHERE r = 1",
        ),
        ("folds", f"SELECT g, rows, (CASE WHEN p // {k} % 2 = 0 THEN p % {k} ELSE {k - 1} - p % {k} END)::INTEGER AS fold FROM placed"),
    ]


@query("m05_folds_keep_copies", sql.with_ctes("SELECT g AS o_orderkey, fold, rows FROM folds", ["dirty_orders"], *_grouped("o_orderkey", 5)))
def m05_copies(spark, sf):
    """Copies of an order are in one fold: one row per order."""
    folds = grouped_folds(dirty_orders(spark, sf), "o_orderstatus", 5, ["o_orderkey"])
    return folds.groupBy("o_orderkey", "fold").agg(F.count(F.lit(1)).alias("rows"))


@query("g01_split_by_customer", sql.with_ctes("SELECT g AS o_custkey, fold = 0 AS is_test, rows FROM folds", ["dirty_orders"], *_grouped("o_custkey", 5)))
def g01_customer(spark, sf):
    """All orders of a customer are in one part."""
    parts = grouped_split(dirty_orders(spark, sf), "o_orderstatus", 0.2, ["o_custkey"])
    return parts.groupBy("o_custkey", "is_test").agg(F.count(F.lit(1)).alias("rows"))
