"""Sources and sinks: written to a new shared folder and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import sql
from catalog.registry import query, rounded
from catalog.views import dirty_events, dirty_orders, table
from tablewright.operators.profile import score_table
from tablewright.sources import files as S


@query(
    "s01_headerless_csv",
    "SELECT c_custkey, c_name, CASE WHEN c_custkey % 7 <> 0 THEN c_acctbal END AS c_acctbal, c_mktsegment FROM customer",
)
def s01(spark, sf):
    path = S.shared_folder(spark, "headerless")
    customer = table(spark, sf, "customer")
    token = F.when(F.col("c_custkey") % 7 == 0, "?").otherwise(F.col("c_acctbal").cast("string"))
    padded = customer.select(
        *[F.concat(F.lit(" "), c.cast("string")) for c in (F.col("c_custkey"), F.col("c_name"), token, F.col("c_mktsegment"))]
    )
    padded.write.option("ignoreLeadingWhiteSpace", False).csv(path)
    return S.read_headerless_csv(spark, path, "c_custkey bigint, c_name string, c_acctbal double, c_mktsegment string")


@query("s02_csv_projection", "SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders")
def s02(spark, sf):
    path = S.shared_folder(spark, "header")
    table(spark, sf, "orders").write.option("header", True).csv(path)
    schema = "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, o_orderdate string, o_orderpriority string"
    return S.read_csv(spark, path, schema, ["o_orderkey", "o_orderstatus", "o_totalprice"])


_SCORES = "dataset string, rows bigint, columns int, quality_score double"


def _scores(spark, sf):
    parts = []
    for name, t, target in (("orders", dirty_orders(spark, sf), "o_orderpriority"), ("events", dirty_events(spark, sf), "cls")):
        score = score_table(t, target).select("quality_score").first()[0]
        parts.append(
            t.agg(F.count(F.lit(1)).alias("rows")).select(
                F.lit(name).alias("dataset"), "rows", F.lit(len(t.columns)).alias("columns"), F.lit(score).alias("quality_score")
            )
        )
    return parts[0].unionByName(parts[1])


def _scores_sql() -> str:
    return sql.with_ctes(
        "SELECT 'orders' AS dataset, (SELECT count(*) FROM dirty_orders) AS rows, 6 AS columns, round(quality_score, 6) AS quality_score FROM o_scored "
        "UNION ALL SELECT 'events', (SELECT count(*) FROM dirty_events), 7, round(quality_score, 6) FROM e_scored",
        ["dirty_orders", "dirty_events"],
        *sql.score_ctes("dirty_orders", "o_orderpriority", "o_"),
        *sql.score_ctes("dirty_events", "cls", "e_"),
    )


@query("s04_result_sink_json", _scores_sql())
def s04(spark, sf):
    path = S.shared_folder(spark, "results")
    S.write_results(_scores(spark, sf), path)
    return rounded(S.read_results(spark, path, _SCORES), "quality_score")


@query("s05_result_source_parquet", _scores_sql())
def s05(spark, sf):
    path = S.shared_folder(spark, "results")
    S.write_results(_scores(spark, sf), path, "parquet")
    return rounded(S.read_results(spark, path, _SCORES, "parquet"), "quality_score")
