"""Time the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import DataFrame, SparkSession

from catalog import QUERIES
from catalog.views import table
from tablewright.operators.flat import flat_profile
from tablewright.operators.profile import profile

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")

HEADLINE = (
    "d01_missing_by_column",
    "d04_duplicate_rows",
    "d07_iqr_outliers",
    "d11_correlation_matrix",
    "d13_quality_score",
    "d15_full_report",
    "d16_segment_profiles",
    "f02_fill_mean",
    "f04_forward_fill",
    "f05_iqr_filter",
    "f07_distinct_rows",
    "f08_undersample",
    "f11_ordered_fixes",
    "e03_encode_categoricals",
    "m05_stratified_folds",
    "m10_classification_metrics",
    "r08_domain_verdict",
    "a03_analyze_effectiveness",
    "v06_validation_summary",
    "m02_logistic_regression",
)


def lineitem_profile(spark: SparkSession, sf: str) -> DataFrame:
    return profile(table(spark, sf, "lineitem"), "l_linestatus")


def lineitem_flat(spark: SparkSession, sf: str) -> DataFrame:
    return flat_profile(table(spark, sf, "lineitem"), "l_linestatus")


def main() -> None:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    table(spark, SF_DIR, "region").count()
    runs = {name: QUERIES[name] for name in HEADLINE}
    runs |= {"lineitem_full_report": lineitem_profile, "lineitem_flat_profile": lineitem_flat}
    seconds = {}
    for name, run in runs.items():
        start = time.perf_counter()
        run(spark, SF_DIR).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    total = round(sum(seconds.values()), 3)
    print(json.dumps({"metric": "total_query_seconds", "value": total, "unit": "sec", "queries": seconds, "sf": SF_DIR}))
    spark.stop()


if __name__ == "__main__":
    main()
