"""Detectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import sql
from catalog.registry import query, r6, rounded
from catalog.views import COLUMNS, collinear_part, dirty_events, dirty_orders, doc_labels, mixed_cust, table
from tablewright.operators import profile as P
from tablewright.operators.flat import flat_profile
from tablewright.operators.rules import (
    built_in_rules,
    correlation_breaches,
    critical_columns,
    flag_by_rule,
    get_rules,
    invalid_rows,
    judge,
    minority_size,
)
from tablewright.operators.sequence import time_gaps


@query(
    "d01_missing_by_column",
    sql.with_ctes(
        'SELECT "column", round(100.0::DOUBLE * missing / n, 6) AS missing_pct FROM m WHERE missing > 0',
        ["dirty_orders"],
        ("m", sql.missing("dirty_orders")),
    ),
)
def d01(spark, sf):
    return rounded(P.missing_by_column(dirty_orders(spark, sf)), "missing_pct")


@query(
    "d02_overall_missing",
    sql.with_ctes(
        "SELECT round(100.0::DOUBLE * sum(missing) / sum(n), 6) AS overall_missing_pct FROM m",
        ["doc_labels"],
        ("m", sql.missing("doc_labels")),
    ),
)
def d02(spark, sf):
    return P.missing_summary(doc_labels(spark, sf)).select(r6("overall_missing_pct").alias("overall_missing_pct"))


@query(
    "d03_completeness_severity",
    sql.with_ctes(
        "SELECT 'orders' AS name, CASE WHEN max(100.0 * missing / n) > 30 THEN 'critical' ELSE 'medium' END AS severity FROM m "
        "UNION ALL SELECT 'docs', CASE WHEN max(100.0 * missing / n) > 30 THEN 'critical' ELSE 'medium' END FROM d",
        ["dirty_orders", "doc_labels"],
        ("m", sql.missing("dirty_orders")),
        ("d", sql.missing("doc_labels")),
    ),
)
def d03(spark, sf):
    parts = {"orders": dirty_orders(spark, sf), "docs": doc_labels(spark, sf)}
    rows = [P.missing_summary(t).select(F.lit(n).alias("name"), "severity") for n, t in parts.items()]
    return rows[0].unionByName(rows[1])


@query(
    "d04_duplicate_rows",
    sql.with_ctes(
        "SELECT dup AS duplicate_rows, round(100.0::DOUBLE * dup / n, 6) AS duplicate_pct, "
        "CASE WHEN 100.0 * dup / n > 5 THEN 'high' ELSE 'low' END AS severity FROM d",
        ["dirty_orders"],
        ("d", sql.duplicates("dirty_orders")),
    ),
)
def d04(spark, sf):
    found = P.duplicate_summary(dirty_orders(spark, sf)).select("duplicate_rows", "duplicate_pct", "severity")
    return rounded(found, "duplicate_pct")


@query(
    "d05_row_uniqueness",
    sql.with_ctes(
        "SELECT dup AS duplicate_rows, round(100.0::DOUBLE * (n - dup) / n, 6) AS unique_rows_pct FROM d",
        ["dirty_orders"],
        ("d", sql.duplicates("dirty_orders")),
    ),
)
def d05(spark, sf):
    found = P.duplicate_summary(dirty_orders(spark, sf), exact=True).select("duplicate_rows", "unique_rows_pct")
    return rounded(found, "unique_rows_pct")


@query(
    "d06_id_like_columns",
    sql.with_ctes(
        'SELECT "column", d AS distinct_values FROM ('
        + " UNION ALL ".join(
            f"SELECT '{c}' AS \"column\", count(DISTINCT {c}) AS d, count(*) AS n FROM mixed_cust"
            for c in COLUMNS["mixed_cust"]["strings"]
        )
        + ") WHERE d = n",
        ["mixed_cust"],
    ),
)
def d06(spark, sf):
    return P.id_like_columns(mixed_cust(spark, sf))


def _outlier_sql(final: str, k: float = 1.5) -> str:
    numeric = COLUMNS["dirty_events"]["numeric"]
    return sql.with_ctes(
        final,
        ["dirty_events"],
        ("fence", sql.fences("dirty_events", numeric, k)),
        ("o", sql.outliers("dirty_events", numeric)),
    )


@query(
    "d07_iqr_outliers",
    _outlier_sql('SELECT "column", outliers, round(100.0::DOUBLE * outliers / n, 6) AS outlier_pct FROM o WHERE outliers > 0'),
)
def d07(spark, sf):
    return rounded(P.outlier_columns(dirty_events(spark, sf)), "outlier_pct")


@query(
    "d08_outlier_severity",
    _outlier_sql(
        "SELECT sum(outliers)::BIGINT AS total_outliers, "
        "CASE WHEN max(100.0 * outliers / n) > 10 THEN 'high' ELSE 'medium' END AS severity FROM o"
    ),
)
def d08(spark, sf):
    return P.outlier_summary(dirty_events(spark, sf))


@query(
    "d09_imbalance_eligibility",
    sql.with_ctes(
        "SELECT 'events.cls' AS target, true AS eligible, (SELECT max(n)::DOUBLE / min(n) FROM e) AS imbalance_ratio "
        "UNION ALL SELECT 'docs.quality', (SELECT count(*) < 20 FROM q), round((SELECT max(n)::DOUBLE / min(n) FROM q), 6) "
        "UNION ALL SELECT 'docs.n_chars', (SELECT count(*) < 20 FROM c), 1.0",
        ["dirty_events", "doc_labels"],
        ("e", sql.classes("dirty_events", "cls")),
        ("q", sql.classes("doc_labels", "quality")),
        ("c", sql.classes("doc_labels", "n_chars")),
    ),
)
def d09(spark, sf):
    docs = doc_labels(spark, sf)
    cases = [("events.cls", dirty_events(spark, sf), "cls"), ("docs.quality", docs, "quality"), ("docs.n_chars", docs, "n_chars")]
    rows = [
        P.class_balance(t, c).select(F.lit(n).alias("target"), "eligible", r6("imbalance_ratio").alias("imbalance_ratio"))
        for n, t, c in cases
    ]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


@query(
    "d10_class_distribution",
    sql.with_ctes(
        "SELECT CAST(class AS VARCHAR) AS class, n, round(n::DOUBLE / sum(n) OVER (), 6) AS share FROM c",
        ["doc_labels"],
        ("c", sql.classes("doc_labels", "quality")),
    ),
)
def d10(spark, sf):
    return rounded(P.class_distribution(doc_labels(spark, sf), "quality"), "share")


_CORR = ("c", sql.correlation("collinear_part", COLUMNS["collinear_part"]["numeric"]))


@query(
    "d11_correlation_matrix",
    sql.with_ctes("SELECT feature1, feature2, round(CASE WHEN abs_corr > 1 THEN 1.0 ELSE abs_corr END, 6) AS abs_corr FROM c", ["collinear_part"], _CORR),
)
def d11(spark, sf):
    return rounded(P.correlation_pairs(collinear_part(spark, sf)), "abs_corr")


@query(
    "d12_high_correlation_pairs",
    sql.with_ctes(
        "SELECT feature1, feature2, round(CASE WHEN abs_corr > 1 THEN 1.0 ELSE abs_corr END, 6) AS abs_corr FROM c WHERE abs_corr > 0.9", ["collinear_part"], _CORR
    ),
)
def d12(spark, sf):
    return rounded(P.high_correlations(collinear_part(spark, sf)), "abs_corr")


@query(
    "d13_quality_score",
    sql.with_ctes(
        "SELECT round(missing_pct, 6) AS missing_pct, round(duplicate_pct, 6) AS duplicate_pct, total_outliers, "
        "round(imbalance_ratio, 6) AS imbalance_ratio, high_pairs, round(quality_score, 6) AS quality_score FROM scored",
        ["dirty_orders"],
        *sql.score_ctes("dirty_orders", "o_orderpriority"),
    ),
)
def d13(spark, sf):
    scored = P.score_table(dirty_orders(spark, sf), "o_orderpriority").drop("band")
    return rounded(scored, "missing_pct", "duplicate_pct", "imbalance_ratio", "quality_score")


@query(
    "d14_score_band",
    sql.with_ctes(
        f"SELECT round(quality_score, 6) AS quality_score, {sql.BAND.format('quality_score')} AS band FROM scored",
        ["dirty_events"],
        *sql.score_ctes("dirty_events", "cls"),
    ),
)
def d14(spark, sf):
    return rounded(P.score_table(dirty_events(spark, sf), "cls").select("quality_score", "band"), "quality_score")


def _profile_sql(view: str, target: str) -> str:
    ids = " UNION ALL ".join(
        f"SELECT '{c}' AS c, count(DISTINCT {c}) AS d, count(*) AS n FROM {view}" for c in COLUMNS[view]["strings"]
    )
    complete = "(SELECT CASE WHEN max(100.0 * missing / n) > 30 THEN 'critical' ELSE 'medium' END FROM miss)"
    dup = "(SELECT CASE WHEN 100.0 * dup / n > 5 THEN 'high' ELSE 'low' END FROM dups)"
    valid = "(SELECT CASE WHEN count(*) > 0 THEN 'medium' ELSE 'low' END FROM ids WHERE d = n)"
    out = "(SELECT CASE WHEN max(100.0 * outliers / n) > 10 THEN 'high' ELSE 'medium' END FROM outl)"
    ratio = "(SELECT CASE WHEN imbalance_ratio > 5 THEN 'high' WHEN imbalance_ratio > 2 THEN 'medium' ELSE 'low' END FROM inputs)"
    rows = [
        f"SELECT 'completeness', NULL, 'overall_missing_pct', missing_pct, {complete} FROM inputs",
        f"SELECT 'completeness', \"column\", 'missing_pct', 100.0::DOUBLE * missing / n, {complete} FROM miss WHERE missing > 0",
        f"SELECT 'consistency', NULL, 'count', dup::DOUBLE, {dup} FROM dups",
        f"SELECT 'consistency', NULL, 'percentage', 100.0::DOUBLE * dup / n, {dup} FROM dups",
        f"SELECT 'validity', NULL, 'id_like_columns', (SELECT count(*) FROM ids WHERE d = n)::DOUBLE, {valid}",
        f"SELECT 'validity', c, 'distinct_values', d::DOUBLE, {valid} FROM ids WHERE d = n",
        "SELECT 'uniqueness', NULL, 'duplicate_rows', dup::DOUBLE, NULL FROM dups",
        "SELECT 'uniqueness', NULL, 'unique_rows_pct', 100.0::DOUBLE * (n - dup) / n, NULL FROM dups",
        f"SELECT 'outliers', NULL, 'total_outlier_records', total_outliers::DOUBLE, {out} FROM inputs",
        f"SELECT 'outliers', \"column\", 'count', outliers::DOUBLE, {out} FROM outl WHERE outliers > 0",
        f"SELECT 'outliers', \"column\", 'percentage', 100.0::DOUBLE * outliers / n, {out} FROM outl WHERE outliers > 0",
        f"SELECT 'imbalance', '{target}', 'imbalance_ratio', imbalance_ratio, {ratio} FROM inputs",
        f"SELECT 'imbalance', concat('{target}=', class), 'share', n::DOUBLE / (SELECT sum(n) FROM cls), {ratio} FROM cls",
        "SELECT 'correlation', NULL, 'high_corr_pairs', high_pairs::DOUBLE, NULL FROM inputs",
        "SELECT 'correlation', concat(feature1, '|', feature2), 'correlation', least(abs_corr, 1.0), NULL FROM corr WHERE abs_corr > 0.9",
        f"SELECT 'score', NULL, 'quality_score', quality_score, {sql.BAND.format('quality_score')} FROM scored",
    ]
    ctes = [
        *sql.score_ctes(view, target),
        ("ids", ids),
        ("report", 'SELECT * FROM (SELECT NULL, NULL, NULL, NULL, NULL LIMIT 0) t("check", "column", metric, value, severity) UNION ALL ' + " UNION ALL ".join(rows)),
    ]
    return sql.with_ctes('SELECT "check", "column", metric, round(value, 6) AS value, severity FROM report', [view], *ctes)


@query("d15_full_report", _profile_sql("dirty_orders", "o_orderpriority"))
def d15(spark, sf):
    return rounded(P.profile(dirty_orders(spark, sf), "o_orderpriority"), "value")


@query("d15_full_report_events", _profile_sql("dirty_events", "cls"))
def d15_events(spark, sf):
    return rounded(P.profile(dirty_events(spark, sf)), "value")


_FLAT = (
    "missing_values duplicates outliers imbalance_ratio high_correlation_pct type_inconsistencies "
    "quality_score dataset_size n_features categorical_pct numeric_pct"
).split()


@query(
    "d16_flat_profile",
    sql.with_ctes(
        "SELECT " + ", ".join(f"round({c}, 6) AS {c}" for c in _FLAT) + " FROM flat",
        ["dirty_events"],
        *sql.segments("flat", "dirty_events", "dirty_events", None, "cls"),
    ),
)
def d16(spark, sf):
    return rounded(flat_profile(dirty_events(spark, sf), "cls"), *_FLAT)


# ---- declared contracts -------------------------------------------------------------------------------------------


@query(
    "dc01_critical_columns",
    sql.with_ctes(
        "SELECT 'o_orderkey' AS \"column\", true AS present, count(*) - count(o_orderkey) AS missing, count(*) = count(o_orderkey) AS ok FROM dirty_orders "
        "UNION ALL SELECT 'o_totalprice', true, count(*) - count(o_totalprice), count(*) = count(o_totalprice) FROM dirty_orders "
        "UNION ALL SELECT 'account_id', false, NULL, false",
        ["dirty_orders"],
    ),
)
def dc01(spark, sf):
    return critical_columns(dirty_orders(spark, sf), ["o_orderkey", "o_totalprice", "account_id"])


@query(
    "dc02_exact_duplicates_waived",
    sql.with_ctes(
        "SELECT domain, allowed AND over AS waived, over AND NOT allowed AS duplicate_violation FROM "
        "(SELECT domain, allowed, round(100.0::DOUBLE * dup / n, 6) > top AS over FROM dups, "
        "(VALUES ('finance', false, 0.5), ('healthcare', false, 0.1), ('ecommerce', true, 1.0), "
        "('sentiment', true, 5.0), ('iot', false, 0.5), ('credit_scoring', false, 0.1)) r(domain, allowed, top))",
        ["dirty_orders"],
        ("dups", sql.duplicates("dirty_orders")),
    ),
)
def dc02(spark, sf):
    rules = built_in_rules(spark)
    dups = P.duplicate_summary(dirty_orders(spark, sf)).select(F.round("duplicate_pct", 6).alias("duplicates"))
    profiles = dups.withColumn("domain", F.explode(F.array(*[F.lit(r["domain"]) for r in rules.collect()])))
    strict = judge(profiles, rules).select("domain", F.col("duplicate_violation").alias("over"))
    waived = judge(profiles, rules, honour_exact_duplicates=True).select("domain", "duplicate_violation")
    return strict.join(waived, "domain").select(
        "domain", (F.col("over") & ~F.col("duplicate_violation")).alias("waived"), "duplicate_violation"
    )


@query(
    "dc03_domain_outlier_flags",
    sql.with_ctes(
        "SELECT event_id, NOT coalesce(abs((value - m) / s) < 4.0, false) AS is_outlier FROM dirty_events, st",
        ["dirty_events"],
        ("st", "SELECT avg(value) AS m, sqrt(var_pop(value)) AS s FROM dirty_events"),
    ),
)
def dc03(spark, sf):
    rule = get_rules(built_in_rules(spark), "Finance")
    return flag_by_rule(dirty_events(spark, sf), rule, exclude=["event_id", "user_id"]).select("event_id", "is_outlier")


@query(
    "dc04_minority_size",
    sql.with_ctes(
        "SELECT min(n) AS smallest_class, 100::BIGINT AS required, min(n) >= 100 AS ok FROM c",
        ["dirty_events"],
        ("c", sql.classes("dirty_events", "cls")),
    ),
)
def dc04(spark, sf):
    rule = get_rules(built_in_rules(spark), "credit_scoring")
    return minority_size(dirty_events(spark, sf), "cls", rule["critical_minority_size"])


@query(
    "dc05_correlation_breaches",
    sql.with_ctes(
        "SELECT feature1, feature2, round(CASE WHEN abs_corr > 1 THEN 1.0 ELSE abs_corr END, 6) AS abs_corr FROM c WHERE abs_corr > 0.95", ["collinear_part"], _CORR
    ),
)
def dc05(spark, sf):
    rule = get_rules(built_in_rules(spark), "ecommerce")
    return rounded(correlation_breaches(collinear_part(spark, sf), rule["max_correlation"]), "abs_corr")


@query(
    "dc06_timestamp_gaps",
    "SELECT event_id, round(gap_days, 6) AS gap_days FROM (SELECT event_id, "
    "(epoch_us(ts) - epoch_us(lag(ts) OVER (ORDER BY ts, event_id))) / 86400000000.0::DOUBLE AS gap_days FROM events) "
    "WHERE gap_days > 0.01",
)
def dc06(spark, sf):
    return rounded(time_gaps(table(spark, sf, "events"), "ts", 0.01).select("event_id", "gap_days"), "gap_days")


@query(
    "dc06_timestamp_gaps_by_user",
    "SELECT event_id, user_id, round(gap_days, 6) AS gap_days FROM (SELECT event_id, user_id, "
    "(epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id))) / 86400000000.0::DOUBLE AS gap_days "
    "FROM events) WHERE gap_days > 1",
)
def dc06_user(spark, sf):
    gaps = time_gaps(table(spark, sf, "events"), "ts", 1, ["user_id"], blocks=4)
    return rounded(gaps.select("event_id", "user_id", "gap_days"), "gap_days")


@query(
    "dc07_value_ranges",
    "SELECT p_partkey, concat_ws(',', CASE WHEN p_retailprice < 902 OR p_retailprice > 1000 THEN 'p_retailprice' END, "
    "CASE WHEN p_size > 45 THEN 'p_size' END) AS invalid FROM part "
    "WHERE p_retailprice < 902 OR p_retailprice > 1000 OR p_size > 45",
)
def dc07(spark, sf):
    limits = {"p_retailprice_min": 902.0, "p_retailprice_max": 1000.0, "p_size_max": 45.0}
    bad = invalid_rows(table(spark, sf, "part"), limits)
    return bad.select("p_partkey", F.concat_ws(",", "invalid_columns").alias("invalid"))


@query(
    "dc08_type_consistency",
    sql.with_ctes(
        'SELECT "column", castable, total - castable AS other, castable > 0 AND total > castable AS mixed FROM ('
        + " UNION ALL ".join(
            f"SELECT '{c}' AS \"column\", count(try_cast({c} AS DOUBLE)) AS castable, count({c}) AS total FROM mixed_cust"
            for c in COLUMNS["mixed_cust"]["strings"]
        )
        + ")",
        ["mixed_cust"],
    ),
)
def dc08(spark, sf):
    return P.type_mix(mixed_cust(spark, sf))
