"""Dirty views over the given tables, built by the same expressions in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewright.sources.files import read_table


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return read_table(spark, f"{sf}/{name}.parquet")


def dirty_orders(spark: SparkSession, sf: str) -> DataFrame:
    """Missing prices and priorities, and some rows twice."""
    orders = table(spark, sf, "orders")
    key = F.col("o_orderkey")
    blanked = orders.withColumns(
        {
            "o_totalprice": F.when(key % 20 != 0, F.col("o_totalprice")),
            "o_orderpriority": F.when(key % 33 != 0, F.col("o_orderpriority")),
        }
    )
    return blanked.unionByName(blanked.filter(key % 25 == 7))


def dirty_events(spark: SparkSession, sf: str) -> DataFrame:
    """Inflated values and a rare class."""
    events = table(spark, sf, "events")
    return events.withColumns(
        {
            "value": F.when(F.col("event_id") % 20 == 3, F.col("value") * 5).otherwise(F.col("value")),
            "cls": F.when(F.col("event_id") % 50 == 0, "fraud").otherwise("ok"),
        }
    )


def collinear_part(spark: SparkSession, sf: str) -> DataFrame:
    """Columns that are linear in each other, and a constant one."""
    part, price = table(spark, sf, "part"), F.col("p_retailprice")
    return part.select(
        "p_partkey",
        "p_size",
        "p_retailprice",
        (price * 2 + 1).alias("twice"),
        (price - 5).alias("less"),
        (F.lit(0) - price).alias("negated"),
        F.lit(1).alias("constant"),
    )


def doc_labels(spark: SparkSession, sf: str) -> DataFrame:
    """Documents with the labels some of them have."""
    labels = table(spark, sf, "labels")
    return table(spark, sf, "documents").join(labels, "doc_id", "left").select(
        "doc_id", "lang", "source", "n_chars", "toxic", "quality"
    )


def mixed_cust(spark: SparkSession, sf: str) -> DataFrame:
    """A code column mixing numbers and text."""
    return table(spark, sf, "customer").withColumn(
        "code", F.when(F.col("c_custkey") % 10 == 0, "n/a").otherwise(F.col("c_custkey").cast("string"))
    )


VIEW_SQL = {
    "dirty_orders": """
      SELECT o_orderkey, o_custkey, o_orderstatus,
             CASE WHEN o_orderkey % 20 <> 0 THEN o_totalprice END AS o_totalprice, o_orderdate,
             CASE WHEN o_orderkey % 33 <> 0 THEN o_orderpriority END AS o_orderpriority FROM orders
      UNION ALL
      SELECT o_orderkey, o_custkey, o_orderstatus,
             CASE WHEN o_orderkey % 20 <> 0 THEN o_totalprice END, o_orderdate,
             CASE WHEN o_orderkey % 33 <> 0 THEN o_orderpriority END FROM orders WHERE o_orderkey % 25 = 7""",
    "dirty_events": """
      SELECT event_id, ts, user_id, event_type,
             CASE WHEN event_id % 20 = 3 THEN value * 5 ELSE value END AS value, props,
             CASE WHEN event_id % 50 = 0 THEN 'fraud' ELSE 'ok' END AS cls FROM events""",
    "collinear_part": """
      SELECT p_partkey, p_size, p_retailprice, p_retailprice * 2 + 1 AS twice, p_retailprice - 5 AS less,
             0 - p_retailprice AS negated, 1 AS constant FROM part""",
    "doc_labels": """
      SELECT d.doc_id, d.lang, d.source, d.n_chars, l.toxic, l.quality
      FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""",
    "mixed_cust": """
      SELECT *, CASE WHEN c_custkey % 10 = 0 THEN 'n/a' ELSE CAST(c_custkey AS VARCHAR) END AS code FROM customer""",
}

# Column names by class: what the SQL generators need to know of a view.
COLUMNS = {
    "dirty_orders": {
        "numeric": ["o_orderkey", "o_custkey", "o_totalprice"],
        "strings": ["o_orderstatus", "o_orderpriority"],
        "all": ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"],
    },
    "dirty_events": {
        "numeric": ["event_id", "user_id", "value"],
        "strings": ["event_type", "props", "cls"],
        "all": ["event_id", "ts", "user_id", "event_type", "value", "props", "cls"],
    },
    "collinear_part": {
        "numeric": ["p_partkey", "p_size", "p_retailprice", "twice", "less", "negated", "constant"],
        "strings": [],
        "all": ["p_partkey", "p_size", "p_retailprice", "twice", "less", "negated", "constant"],
    },
    "doc_labels": {
        "numeric": ["doc_id", "n_chars", "toxic", "quality"],
        "strings": ["lang", "source"],
        "all": ["doc_id", "lang", "source", "n_chars", "toxic", "quality"],
    },
    "mixed_cust": {
        "numeric": ["c_custkey", "c_nationkey", "c_acctbal"],
        "strings": ["c_name", "c_mktsegment", "code"],
        "all": ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment", "code"],
    },
}
