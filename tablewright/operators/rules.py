"""Domain rules as a table, judgement of flat profiles by it, and the data contracts the rules declare."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.functions.columns import broadcast_if, col
from tablewright.operators.fixes import flag_outliers
from tablewright.operators.profile import class_counts, correlation_pairs

RULES_SCHEMA = T.StructType(
    [
        T.StructField("domain", T.StringType()),
        T.StructField("domain_name", T.StringType()),
        T.StructField("description", T.StringType()),
        T.StructField("max_missing_pct", T.DoubleType()),
        T.StructField("critical_missing_columns", T.ArrayType(T.StringType())),
        T.StructField("max_duplicates_pct", T.DoubleType()),
        T.StructField("allow_exact_duplicates", T.BooleanType()),
        T.StructField("outlier_detection_method", T.StringType()),
        T.StructField("outlier_threshold_iqr", T.DoubleType()),
        T.StructField("outlier_threshold_zscore", T.DoubleType()),
        T.StructField("flag_but_dont_remove", T.BooleanType()),
        T.StructField("max_imbalance_ratio", T.DoubleType()),
        T.StructField("critical_minority_size", T.LongType()),
        T.StructField("max_correlation", T.DoubleType()),
        T.StructField("allow_multicollinearity", T.BooleanType()),
        T.StructField("strict_type_checking", T.BooleanType()),
        T.StructField("allow_timestamp_gaps", T.BooleanType()),
        T.StructField("max_timestamp_gap_days", T.DoubleType()),
        T.StructField("medical_validity_rules", T.MapType(T.StringType(), T.DoubleType())),
    ]
)

# What a rule is when a domain does not say otherwise.
DEFAULT_RULE = {
    "max_missing_pct": 5.0,
    "critical_missing_columns": [],
    "max_duplicates_pct": 2.0,
    "allow_exact_duplicates": False,
    "outlier_detection_method": "iqr",
    "outlier_threshold_iqr": 3.0,
    "outlier_threshold_zscore": 3.5,
    "flag_but_dont_remove": False,
    "max_imbalance_ratio": 10.0,
    "critical_minority_size": 50,
    "max_correlation": 0.95,
    "allow_multicollinearity": False,
    "strict_type_checking": False,
    "allow_timestamp_gaps": False,
    "max_timestamp_gap_days": None,
    "medical_validity_rules": {},
}

# The six built-in domains, as differences from the default rule.
BUILT_IN_RULES = {
    "finance": {
        "domain_name": "Finance",
        "description": "Strict rules for financial data (regulatory compliance, risk management)",
        "max_missing_pct": 0.1,
        "critical_missing_columns": ["transaction_amount", "account_id", "date", "institution_code"],
        "max_duplicates_pct": 0.5,
        "outlier_detection_method": "zscore",
        "outlier_threshold_zscore": 4.0,
        "flag_but_dont_remove": True,
        "max_imbalance_ratio": 100.0,
        "critical_minority_size": 10,
        "max_correlation": 0.90,
        "strict_type_checking": True,
    },
    "healthcare": {
        "domain_name": "Healthcare",
        "description": "Strict rules for healthcare data (patient safety, medical validity)",
        "max_missing_pct": 1.0,
        "critical_missing_columns": ["patient_id", "diagnosis", "treatment_date"],
        "max_duplicates_pct": 0.1,
        "outlier_detection_method": "isolation_forest",
        "flag_but_dont_remove": True,
        "max_imbalance_ratio": 20.0,
        "strict_type_checking": True,
        "medical_validity_rules": {
            "age_min": 0.0,
            "age_max": 150.0,
            "hemoglobin_min": 5.0,
            "hemoglobin_max": 20.0,
            "blood_pressure_systolic_min": 40.0,
            "blood_pressure_systolic_max": 250.0,
            "glucose_min": 40.0,
            "glucose_max": 600.0,
        },
    },
    "ecommerce": {
        "domain_name": "E-commerce",
        "description": "Looser rules for e-commerce (allows rare expensive items, edge cases)",
        "max_missing_pct": 3.0,
        "critical_missing_columns": ["product_id", "price", "purchase_date"],
        "max_duplicates_pct": 1.0,
        "allow_exact_duplicates": True,
        "outlier_threshold_iqr": 1.5,
        "max_imbalance_ratio": 50.0,
        "critical_minority_size": 20,
    },
    "sentiment": {
        "domain_name": "Sentiment Analysis",
        "description": "Rules for NLP/sentiment data (text classification)",
        "max_missing_pct": 2.0,
        "critical_missing_columns": ["text", "label"],
        "max_duplicates_pct": 5.0,
        "allow_exact_duplicates": True,
        "outlier_detection_method": "isolation_forest",
        "flag_but_dont_remove": True,
        "critical_minority_size": 100,
    },
    "iot": {
        "domain_name": "IoT Sensors",
        "description": "Rules for time-series sensor data (temperature, pressure, etc)",
        "critical_missing_columns": ["timestamp", "sensor_id", "measurement"],
        "max_duplicates_pct": 0.5,
        "outlier_detection_method": "zscore",
        "outlier_threshold_zscore": 3.0,
        "max_timestamp_gap_days": 0.0,
        "max_correlation": 0.90,
    },
    "credit_scoring": {
        "domain_name": "Credit Scoring",
        "description": "Rules for credit/financial risk scoring (regulatory + risk management)",
        "max_missing_pct": 0.5,
        "critical_missing_columns": ["applicant_id", "credit_history", "income", "debt"],
        "max_duplicates_pct": 0.1,
        "outlier_detection_method": "zscore",
        "flag_but_dont_remove": True,
        "max_imbalance_ratio": 5.0,
        "critical_minority_size": 100,
        "strict_type_checking": True,
    },
}

OUTLIER_REVIEW_PCT = 10
CORRELATION_WARN_PCT = 20


# ---- the rules table ----------------------------------------------------------------------------------------------


def custom_rules(spark: SparkSession, domain: str, **fields) -> DataFrame:
    """One rules row: the defaults, changed by the given fields."""
    unknown = set(fields) - set(RULES_SCHEMA.names)
    if unknown:
        raise ValueError(f"unknown rule fields {sorted(unknown)}")
    row = {"domain_name": domain, "description": f"Custom rules for {domain}", **DEFAULT_RULE, **fields}
    row["domain"] = domain.lower()
    return spark.createDataFrame([tuple(row[n] for n in RULES_SCHEMA.names)], RULES_SCHEMA)


def built_in_rules(spark: SparkSession) -> DataFrame:
    rows = [{**DEFAULT_RULE, **fields, "domain": domain} for domain, fields in BUILT_IN_RULES.items()]
    return spark.createDataFrame([tuple(r[n] for n in RULES_SCHEMA.names) for r in rows], RULES_SCHEMA)


def register_rules(rules: DataFrame, added: DataFrame) -> DataFrame:
    """Add rules; a domain registered again replaces the earlier row, also within the added ones (in their row order)."""
    record = F.struct(*[F.col(c) for c in added.columns])
    numbered = added.select(F.lower("domain").alias("_d"), record.alias("_r"), F.monotonically_increasing_id().alias("_o"))
    added = numbered.groupBy("_d").agg(F.max_by("_r", "_o").alias("_r")).select("_r.*")
    kept = rules.join(added.select(F.lower("domain").alias("_d")), F.lower(rules["domain"]) == F.col("_d"), "left_anti")
    return kept.unionByName(added)


def get_rules(rules: DataFrame, domain: str) -> Row:
    """The rules of one domain, whatever its case; an unknown domain is an error that lists the known ones."""
    row = rules.filter(F.lower("domain") == domain.lower()).first()
    if row is None:
        known = ", ".join(r["domain"] for r in rules.select("domain").orderBy("domain").limit(100).collect())
        raise ValueError(f"unknown domain {domain!r}; known: {known}")
    return row


def list_domains(rules: DataFrame) -> DataFrame:
    return rules.select("domain", "description")


# ---- judging profiles ---------------------------------------------------------------------------------------------


def for_domains(profiles: DataFrame, domains: Sequence[str]) -> DataFrame:
    """Every profile once per named domain (no join)."""
    return profiles.withColumn("domain", F.explode(F.array(*[F.lit(d.lower()) for d in domains])))


def _two(x: Column, digits: int) -> Column:
    return F.format_string(f"%.{digits}f", x.cast("double"))


def judge(profiles: DataFrame, rules: DataFrame, honour_exact_duplicates: bool = False) -> DataFrame:
    """Judge flat profiles by the rules of their ``domain``: violations, warnings, pass, severity.

    Profiles may be a table of any size; the rules table is counted and broadcast while small.
    """
    counted = rules.count()
    rule = broadcast_if(rules.withColumnRenamed("domain", "_domain"), counted)
    joined = profiles.join(rule, F.lower(F.col("domain")) == F.col("_domain"))

    def value(name: str, default: float) -> Column:
        return F.coalesce(F.col(name), F.lit(default)) if name in profiles.columns else F.lit(default)

    missing, duplicates, outliers = value("missing_values", 0.0), value("duplicates", 0.0), value("outliers", 0.0)
    ratio, correlated = value("imbalance_ratio", 1.0), value("high_correlation_pct", 0.0)
    too_many_copies = duplicates > F.col("max_duplicates_pct")
    if honour_exact_duplicates:
        too_many_copies = too_many_copies & ~F.col("allow_exact_duplicates")
    flags = joined.withColumns(
        {
            "missing_violation": missing > F.col("max_missing_pct"),
            "duplicate_violation": too_many_copies,
            "outlier_warning": F.col("flag_but_dont_remove") & (outliers > OUTLIER_REVIEW_PCT),
            "imbalance_violation": ratio > F.col("max_imbalance_ratio"),
            "correlation_warning": (correlated > CORRELATION_WARN_PCT) & ~F.col("allow_multicollinearity"),
        }
    )
    violations = F.array_compact(
        F.array(
            F.when(
                F.col("missing_violation"),
                F.concat(F.lit("missing values "), _two(missing, 2), F.lit("% above limit "), _two(F.col("max_missing_pct"), 2), F.lit("%")),
            ),
            F.when(
                F.col("duplicate_violation"),
                F.concat(F.lit("duplicates "), _two(duplicates, 2), F.lit("% above limit "), _two(F.col("max_duplicates_pct"), 2), F.lit("%")),
            ),
            F.when(
                F.col("imbalance_violation"),
                F.concat(F.lit("imbalance "), _two(ratio, 1), F.lit(":1 above limit "), _two(F.col("max_imbalance_ratio"), 1), F.lit(":1")),
            ),
        )
    )
    warnings = F.array_compact(
        F.array(
            F.when(F.col("outlier_warning"), F.concat(F.lit("review outliers "), _two(outliers, 2), F.lit("%"))),
            F.when(F.col("correlation_warning"), F.concat(F.lit("correlated features "), _two(correlated, 1), F.lit("%"))),
        )
    )
    severity = (
        F.when(F.col("missing_violation") | F.col("duplicate_violation"), "CRITICAL")
        .when(F.col("imbalance_violation"), "HIGH")
        .when(F.col("outlier_warning") | F.col("correlation_warning"), "LOW")
        .otherwise("PASS")
    )
    return flags.select(
        *[col(c) for c in profiles.columns],
        "missing_violation",
        "duplicate_violation",
        "outlier_warning",
        "imbalance_violation",
        "correlation_warning",
        violations.alias("violations"),
        warnings.alias("warnings"),
        (~(F.col("missing_violation") | F.col("duplicate_violation") | F.col("imbalance_violation"))).alias("passes_checks"),
        severity.alias("severity_level"),
    )


# ---- declared contracts -------------------------------------------------------------------------------------------


def critical_columns(df: DataFrame, required: Sequence[str]) -> DataFrame:
    """Per required column: is it there, how many cells does it miss, is the contract kept."""
    spark = df.sparkSession
    schema = "column string, present boolean, missing bigint, ok boolean"
    absent = [(c, False, None, False) for c in required if c not in df.columns]
    here = [c for c in required if c in df.columns]
    result = spark.createDataFrame(absent, schema)
    if here:
        cells = [F.struct(F.lit(c).alias("column"), F.count_if(col(c).isNull()).alias("missing")) for c in here]
        found = df.agg(F.array(*cells).alias("cells")).select(F.explode("cells").alias("c"))
        result = result.unionByName(
            found.select(
                F.col("c.column").alias("column"),
                F.lit(True).alias("present"),
                F.col("c.missing").alias("missing"),
                (F.col("c.missing") == 0).alias("ok"),
            )
        )
    return result


def flag_by_rule(df: DataFrame, rule: Row, exclude: Sequence[str] = ()) -> DataFrame:
    """Mark outliers by the domain's own method and threshold; methods Spark does not offer are an error."""
    method = rule["outlier_detection_method"]
    threshold = rule["outlier_threshold_zscore"] if method == "zscore" else rule["outlier_threshold_iqr"]
    return flag_outliers(df, method, threshold, exclude)


def minority_size(df: DataFrame, target: str, required: int) -> DataFrame:
    return class_counts(df, target).agg(F.min("n").alias("smallest_class")).select(
        "smallest_class", F.lit(required).cast("long").alias("required"), (F.col("smallest_class") >= required).alias("ok")
    )


def correlation_breaches(df: DataFrame, max_correlation: float) -> DataFrame:
    return correlation_pairs(df).filter(F.col("abs_corr") > max_correlation)


def value_limits(limits: dict[str, float]) -> dict[str, tuple[float | None, float | None]]:
    """``x_min`` and ``x_max`` entries as one (low, high) pair per column."""
    names = {k.rsplit("_", 1)[0] for k in limits if k.endswith(("_min", "_max"))}
    return {n: (limits.get(f"{n}_min"), limits.get(f"{n}_max")) for n in sorted(names)}


def invalid_rows(df: DataFrame, limits: dict[str, float]) -> DataFrame:
    """Rows with a value outside its range, with the offending columns; NULL offends nothing."""
    checks = []
    for name, (low, high) in value_limits(limits).items():
        if name in df.columns:
            bad = F.lit(False)
            if low is not None:
                bad = bad | (col(name) < low)
            if high is not None:
                bad = bad | (col(name) > high)
            checks.append(F.when(bad, F.lit(name)))
    if not checks:
        return df.withColumn("invalid_columns", F.array().cast("array<string>")).filter(F.lit(False))
    # The range tests themselves form the filter, so they reach the scan.
    return df.filter(reduce(lambda a, b: a | b, [c.isNotNull() for c in checks])).withColumn(
        "invalid_columns", F.array_compact(F.array(*checks))
    )
