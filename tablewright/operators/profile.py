"""Detectors: completeness, duplicates, validity, outliers, class balance, correlation, and their report.

Every detector is a few column-pruned aggregations.  What reaches the driver is one small row per column (counts, quartiles);
everything that can be as large as the table (distinct rows, class tables) stays distributed.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.functions import scoring
from tablewright.functions.columns import (
    col,
    numeric_columns,
    percent,
    read_number,
    resolve_target,
    string_columns,
)
from tablewright.functions.together import together
from tablewright.operators.moments import all_pair_moments
from tablewright.operators.quantiles import quantiles
from tablewright.operators.repeats import all_different, count_repeats

CLASS_LIMIT = 20
# A distinct count estimated below this share of the rows is five sketch deviations away from "all different".
SURELY_REPEATED = 0.75
HIGH_CORRELATION = 0.9

PROFILE_SCHEMA = "check string, column string, metric string, value double, severity string"


# ---- completeness -------------------------------------------------------------------------------------------------


def missing_counts(df: DataFrame) -> DataFrame:
    """One row per column: rows, missing cells and missing percent, from a single scan."""
    counted = df.agg(
        F.count(F.lit(1)).alias("rows"),
        F.array(
            *[
                F.struct(F.lit(c).alias("column"), F.count_if(col(c).isNull()).alias("missing"))
                for c in df.columns
            ]
        ).alias("cells"),
    )
    return counted.select("rows", F.explode("cells").alias("cell")).select(
        "cell.column", "rows", "cell.missing", percent(F.col("cell.missing"), F.col("rows")).alias("missing_pct")
    )


def missing_by_column(df: DataFrame) -> DataFrame:
    """Missing percent of the columns that miss anything."""
    return missing_counts(df).filter("missing > 0").select("column", "missing_pct")


def missing_summary(df: DataFrame) -> DataFrame:
    """Overall missing percent of all cells and the completeness severity, in one row."""
    worst = F.max("missing_pct")
    return missing_counts(df).agg(
        percent(F.sum("missing"), F.sum("rows")).alias("overall_missing_pct"),
        scoring.completeness_severity(worst).alias("severity"),
    )


# ---- duplicates ---------------------------------------------------------------------------------------------------


def duplicate_summary(df: DataFrame, exact: bool = False) -> DataFrame:
    """Rows beyond the first of each group of equal rows (NULL equals NULL), their share and severity, in one row.

    Both ways are exact; ``exact=True`` shuffles the values at once instead of digests first.
    """
    nothing = F.lit(0).cast("long")
    counted = df.agg(F.count(F.lit(1)).alias("rows"), nothing.alias("duplicate_rows")).unionByName(
        count_repeats(df, exact=exact).select(nothing.alias("rows"), F.col("repeats").alias("duplicate_rows"))
    )
    total = counted.agg(F.sum("rows").alias("rows"), F.sum("duplicate_rows").alias("duplicate_rows"))
    pct = percent(F.col("duplicate_rows"), F.col("rows"))
    return total.select(
        "rows",
        "duplicate_rows",
        pct.alias("duplicate_pct"),
        percent(F.col("rows") - F.col("duplicate_rows"), F.col("rows")).alias("unique_rows_pct"),
        scoring.duplicate_severity(pct).alias("severity"),
    )


# ---- validity -----------------------------------------------------------------------------------------------------


def id_like_columns(df: DataFrame) -> DataFrame:
    """String columns in which every row holds a different, non-missing value.

    A bounded sketch (one scan, all columns) rules out almost every column; only survivors are counted, each on its own, so
    no aggregate expands the table.  They are counted by two 64-bit hashes, so long texts are not shuffled; values of
    equal hashes are compared.
    """
    spark, names = df.sparkSession, string_columns(df)
    if not names:
        return spark.createDataFrame([], "column string, distinct_values bigint")
    screen = df.agg(
        F.count(F.lit(1)).alias("rows"),
        *[F.count(col(c)).alias(f"n{i}") for i, c in enumerate(names)],
        *[F.approx_count_distinct(col(c)).alias(f"d{i}") for i, c in enumerate(names)],
    ).first()
    survivors = [
        c for i, c in enumerate(names) if screen[f"n{i}"] == screen["rows"] and screen[f"d{i}"] >= SURELY_REPEATED * screen["rows"]
    ]
    different = together(spark, [lambda c=c: all_different(df.select(col(c))) for c in survivors])
    found = [(c, screen["rows"]) for c, alone in zip(survivors, different) if alone]
    return spark.createDataFrame(found, "column string, distinct_values bigint")


# ---- outliers -----------------------------------------------------------------------------------------------------


def iqr_bounds(
    df: DataFrame, columns: Sequence[str], k: float, small_bytes: int | None = None
) -> dict[str, tuple[float, float]]:
    """Fences k interquartile ranges beyond the quartiles; columns without values are left out."""
    fences = {}
    for name, (q1, q3) in quantiles(df, columns, (0.25, 0.75), small_bytes).items():
        if q1 is not None:
            fences[name] = (q1 - k * (q3 - q1), q3 + k * (q3 - q1))
    return fences


def fence_literals(df: DataFrame, name: str, fence: tuple[float, float]) -> tuple[Column, Column]:
    """The fences as literals of the column's own kind.

    For whole numbers the next whole number inside the fence decides alike, needs no cast, and so the range reaches the scan.
    """
    low, high = fence
    whole = isinstance(df.schema[name].dataType, T.IntegralType)
    if whole and all(math.isfinite(x) and abs(x) < 2**62 for x in fence):
        return F.lit(math.ceil(low)).cast("long"), F.lit(math.floor(high)).cast("long")
    return F.lit(low), F.lit(high)


def outside(df: DataFrame, name: str, fence: tuple[float, float]) -> Column:
    low, high = fence_literals(df, name, fence)
    return (col(name) < low) | (col(name) > high)


def outlier_counts(df: DataFrame, k: float = 1.5, columns: Sequence[str] | None = None) -> DataFrame:
    """Rows and values strictly outside the fences, for every numeric column (one row each)."""
    names = numeric_columns(df) if columns is None else list(columns)
    fences = iqr_bounds(df, names, k)
    schema = "column string, outliers bigint, outlier_pct double"
    if not names:
        return df.sparkSession.createDataFrame([], schema)
    counted = df.agg(
        F.count(F.lit(1)).alias("rows"),
        F.array(
            *[
                F.struct(
                    F.lit(c).alias("column"),
                    (F.count_if(outside(df, c, fences[c])) if c in fences else F.lit(0).cast("long")).alias("outliers"),
                )
                for c in names
            ]
        ).alias("cells"),
    )
    return counted.select("rows", F.explode("cells").alias("cell")).select(
        "cell.column", "cell.outliers", percent(F.col("cell.outliers"), F.col("rows")).alias("outlier_pct")
    )


def outlier_columns(df: DataFrame, k: float = 1.5) -> DataFrame:
    return outlier_counts(df, k).filter("outliers > 0")


def outlier_summary(df: DataFrame, k: float = 1.5) -> DataFrame:
    """Total outlier values over all columns (may exceed the rows) and the severity."""
    return outlier_counts(df, k).agg(
        F.coalesce(F.sum("outliers"), F.lit(0)).alias("total_outliers"),
        scoring.outlier_severity(F.max("outlier_pct")).alias("severity"),
    )


# ---- class balance ------------------------------------------------------------------------------------------------


def class_counts(df: DataFrame, target: str) -> DataFrame:
    """Rows per non-missing class; partial counts combine before the shuffle, so a dominant class is no hot key."""
    return df.filter(col(target).isNotNull()).groupBy(col(target).alias("class")).agg(F.count(F.lit(1)).alias("n"))


def is_class_like(df: DataFrame, target: str) -> bool:
    """Strings always count as classes; other types only with fewer than 20 distinct values."""
    if isinstance(df.schema[target].dataType, T.StringType):
        return True
    # A clearly continuous column is ruled out by a bounded sketch before anything is grouped.
    if df.agg(F.approx_count_distinct(col(target))).first()[0] > 2 * CLASS_LIMIT:
        return False
    return class_counts(df, target).count() < CLASS_LIMIT


def class_distribution(df: DataFrame, target: str | None = None) -> DataFrame:
    """Share of every class among the non-missing targets."""
    counts = class_counts(df, resolve_target(df, target))
    total = df.select(col(resolve_target(df, target)).alias("t")).agg(F.count("t")).first()[0]
    return counts.select(
        F.col("class").cast("string").alias("class"), "n", (F.col("n") / F.lit(float(max(total, 1)))).alias("share")
    )


def class_balance(df: DataFrame, target: str | None = None) -> DataFrame:
    """Eligibility, ratio of the largest to the smallest class, and severity, in one row."""
    name = resolve_target(df, target)
    if not is_class_like(df, name):
        return df.sparkSession.createDataFrame(
            [(False, 1.0, "low")], "eligible boolean, imbalance_ratio double, severity string"
        )
    ratio = F.try_divide(F.max("n").cast("double"), F.min("n").cast("double"))
    return class_counts(df, name).agg(
        F.lit(True).alias("eligible"),
        ratio.alias("imbalance_ratio"),
        scoring.imbalance_severity(ratio).alias("severity"),
    )


# ---- correlation --------------------------------------------------------------------------------------------------


def correlation_pairs(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Absolute Pearson correlation of every pair of numeric columns over the rows where both are present.

    NULL where either side is constant.  At most three scans of the table, whatever its
    width: moments of the columns, then pairs of complete columns and pairs that miss values.
    """
    names = numeric_columns(df) if columns is None else list(columns)
    if len(names) < 2:
        return df.sparkSession.createDataFrame([], "feature1 string, feature2 string, abs_corr double")
    return all_pair_moments(df, names).select("feature1", "feature2", pearson("covariance", "variance1", "variance2").alias("abs_corr"))


def pearson(covariance: str, left: str, right: str) -> Column:
    """|r| from population moments, NULL for a constant side."""
    spread = F.col(left) * F.col(right)
    return F.when(spread > 0, F.least(F.abs(F.try_divide(F.col(covariance), F.sqrt(spread))), F.lit(1.0)))


def high_correlations(df: DataFrame, threshold: float = HIGH_CORRELATION) -> DataFrame:
    return correlation_pairs(df).filter(F.col("abs_corr") > threshold)


# ---- type consistency ---------------------------------------------------------------------------------------------


def type_mix(df: DataFrame) -> DataFrame:
    """Per string column: values that read as numbers and values that do not; both present means a mixed column."""
    names = string_columns(df)
    schema = "column string, castable bigint, other bigint, mixed boolean"
    if not names:
        return df.sparkSession.createDataFrame([], schema)
    cells = [
        F.struct(
            F.lit(c).alias("column"),
            F.count(read_number(c)).alias("castable"),
            (F.count(col(c)) - F.count(read_number(c))).alias("other"),
        )
        for c in names
    ]
    return (
        df.agg(F.array(*cells).alias("cells"))
        .select(F.explode("cells").alias("cell"))
        .select("cell.*", ((F.col("cell.castable") > 0) & (F.col("cell.other") > 0)).alias("mixed"))
    )


# ---- reports ------------------------------------------------------------------------------------------------------


def score_table(df: DataFrame, target: str | None = None) -> DataFrame:
    """One row: the five score inputs, the 0-100 score and its band."""
    name = resolve_target(df, target)
    missing, duplicates, outliers, balance, pairs = together(
        df.sparkSession,
        [
            lambda: missing_summary(df).first(),
            lambda: duplicate_summary(df).first(),
            lambda: outlier_summary(df).first(),
            lambda: class_balance(df, name).first(),
            lambda: high_correlations(df).count(),
        ],
    )
    inputs = df.sparkSession.createDataFrame(
        [
            (
                missing["overall_missing_pct"],
                duplicates["duplicate_pct"],
                outliers["total_outliers"],
                balance["imbalance_ratio"],
                pairs,
            )
        ],
        "missing_pct double, duplicate_pct double, total_outliers bigint, imbalance_ratio double, high_pairs bigint",
    )
    score = scoring.quality_score(
        F.col("missing_pct"),
        F.col("duplicate_pct"),
        F.col("total_outliers"),
        F.coalesce("imbalance_ratio", F.lit(1.0)),
        F.col("high_pairs"),
    )
    return inputs.withColumn("quality_score", score).withColumn("band", scoring.score_band(score))


def profile(df: DataFrame, target: str | None = None) -> DataFrame:
    """The full report of all seven checks in long form (see PROFILE_SCHEMA), with the overall score."""
    spark, name = df.sparkSession, resolve_target(df, target)
    cells, duplicates, ids, outliers, balance, pairs = together(
        spark,
        [
            lambda: missing_counts(df).collect(),
            lambda: duplicate_summary(df).first(),
            lambda: id_like_columns(df).collect(),
            lambda: outlier_counts(df).collect(),
            lambda: class_balance(df, name).first(),
            lambda: high_correlations(df).collect(),
        ],
    )

    rows_total = cells[0]["rows"]
    cell_total = rows_total * len(df.columns)
    missing_total = sum(c["missing"] for c in cells)
    overall = 100.0 * missing_total / cell_total if cell_total else None
    complete = "critical" if any((c["missing_pct"] or 0) > 30 for c in cells) else "medium"
    extreme = "high" if any((o["outlier_pct"] or 0) > 10 for o in outliers) else "medium"
    found = [o for o in outliers if o["outliers"] > 0]
    total_outliers = sum(o["outliers"] for o in found)

    report: list[tuple] = [("completeness", None, "overall_missing_pct", overall, complete)]
    report += [("completeness", c["column"], "missing_pct", c["missing_pct"], complete) for c in cells if c["missing"] > 0]
    for metric, field in (("count", "duplicate_rows"), ("percentage", "duplicate_pct")):
        report.append(("consistency", None, metric, _number(duplicates[field]), duplicates["severity"]))
    validity = "medium" if ids else "low"
    report.append(("validity", None, "id_like_columns", float(len(ids)), validity))
    report += [("validity", r["column"], "distinct_values", float(r["distinct_values"]), validity) for r in ids]
    for field in ("duplicate_rows", "unique_rows_pct"):
        report.append(("uniqueness", None, field, _number(duplicates[field]), None))
    report.append(("outliers", None, "total_outlier_records", float(total_outliers), extreme))
    for o in found:
        report.append(("outliers", o["column"], "count", float(o["outliers"]), extreme))
        report.append(("outliers", o["column"], "percentage", o["outlier_pct"], extreme))
    report.append(("imbalance", name, "imbalance_ratio", balance["imbalance_ratio"], balance["severity"]))
    report.append(("correlation", None, "high_corr_pairs", float(len(pairs)), None))
    report += [
        ("correlation", f"{p['feature1']}|{p['feature2']}", "correlation", p["abs_corr"], None) for p in pairs
    ]

    score = scoring.quality_score(
        F.lit(overall).cast("double"),
        F.lit(duplicates["duplicate_pct"]).cast("double"),
        F.lit(total_outliers),
        F.lit(balance["imbalance_ratio"] or 1.0),
        F.lit(len(pairs)),
    )
    long = spark.createDataFrame(report, PROFILE_SCHEMA).unionByName(
        spark.range(1).select(
            F.lit("score").alias("check"),
            F.lit(None).cast("string").alias("column"),
            F.lit("quality_score").alias("metric"),
            score.alias("value"),
            scoring.score_band(score).alias("severity"),
        )
    )
    if balance["eligible"]:
        long = long.unionByName(
            class_distribution(df, name).select(
                F.lit("imbalance").alias("check"),
                F.concat(F.lit(f"{name}="), "class").alias("column"),
                F.lit("share").alias("metric"),
                F.col("share").alias("value"),
                F.lit(balance["severity"]).alias("severity"),
            )
        )
    return long


def _number(value: float | int | None) -> float | None:
    return None if value is None else float(value)
