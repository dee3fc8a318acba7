"""Domain rules over a table of profiles: one flat profile per customer's orders and per user's events."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import sql
from catalog.registry import query, rounded
from catalog.views import dirty_events, dirty_orders
from tablewright.operators.flat import FLAT_COLUMNS, segment_profiles
from tablewright.operators.rules import (
    BUILT_IN_RULES,
    built_in_rules,
    custom_rules,
    for_domains,
    get_rules,
    judge,
    list_domains,
    register_rules,
)
from tablewright.sources import files as S

DOMAINS = tuple(BUILT_IN_RULES)


def profiles(spark, sf):
    orders = segment_profiles(dirty_orders(spark, sf), "o_custkey", "o_orderpriority")
    events = segment_profiles(dirty_events(spark, sf), "user_id", "cls")
    return orders.select(F.concat(F.lit("orders-"), "o_custkey").alias("profile_id"), *FLAT_COLUMNS).unionByName(
        events.select(F.concat(F.lit("events-"), "user_id").alias("profile_id"), *FLAT_COLUMNS)
    )


PROFILE_CTES = [
    *sql.segments("po", "dirty_orders", "dirty_orders", "o_custkey", "o_orderpriority"),
    *sql.segments("pe", "dirty_events", "dirty_events", "user_id", "cls"),
    (
        "profiles",
        "SELECT concat('orders-', seg) AS profile_id, * EXCLUDE (seg) FROM po UNION ALL BY NAME "
        "SELECT concat('events-', seg) AS profile_id, * EXCLUDE (seg) FROM pe",
    ),
]
# domain, missing, duplicates, exact duplicates allowed, flag only, ratio
_LIMITS = (
    "('finance', 0.1, 0.5, true, 100.0), ('healthcare', 1.0, 0.1, true, 20.0), ('ecommerce', 3.0, 1.0, false, 50.0), "
    "('sentiment', 2.0, 5.0, true, 10.0), ('iot', 5.0, 0.5, false, 10.0), ('credit_scoring', 0.5, 0.1, true, 5.0)"
)
_RULES = ("rules", f"SELECT * FROM (VALUES {_LIMITS}) t(domain, max_missing, max_dup, flag_only, max_ratio)")
_JUDGED = (
    "judged",
    "SELECT *, missing_values > max_missing AS missing_violation, duplicates > max_dup AS duplicate_violation, "
    "flag_only AND outliers > 10 AS outlier_warning, imbalance_ratio > max_ratio AS imbalance_violation, "
    "high_correlation_pct > 20 AS correlation_warning FROM profiles, rules",
)


def judged_sql(columns: str, where: str = "true") -> str:
    return sql.with_ctes(
        f"SELECT profile_id, domain, {columns} FROM judged WHERE {where}", ["dirty_orders", "dirty_events"], *PROFILE_CTES, _RULES, _JUDGED
    )


def judged(spark, sf, rules=None):
    rules = built_in_rules(spark) if rules is None else rules
    return judge(for_domains(profiles(spark, sf), DOMAINS), rules)


@query(
    "d16_segment_profiles",
    sql.with_ctes(
        "SELECT profile_id, " + ", ".join(f"round({c}, 6) AS {c}" for c in FLAT_COLUMNS) + " FROM profiles",
        ["dirty_orders", "dirty_events"],
        *PROFILE_CTES,
    ),
)
def d16_segments(spark, sf):
    return rounded(profiles(spark, sf), *FLAT_COLUMNS)


@query(
    "r01_builtin_rules",
    sql.with_ctes(
        "SELECT domain, max_missing AS max_missing_pct, max_dup AS max_duplicates_pct, max_ratio AS max_imbalance_ratio, flag_only AS flag_but_dont_remove, "
        "count(*) FILTER (WHERE missing_violation OR duplicate_violation OR imbalance_violation) AS violating_profiles "
        "FROM (SELECT * REPLACE (max_missing::DOUBLE AS max_missing, max_dup::DOUBLE AS max_dup, max_ratio::DOUBLE AS max_ratio) FROM judged) GROUP BY ALL",
        ["dirty_orders", "dirty_events"],
        *PROFILE_CTES,
        _RULES,
        _JUDGED,
    ),
)
def r01(spark, sf):
    rules = built_in_rules(spark).select("domain", "max_missing_pct", "max_duplicates_pct", "max_imbalance_ratio", "flag_but_dont_remove")
    violating = judged(spark, sf).groupBy("domain").agg(F.count_if(~F.col("passes_checks")).alias("violating_profiles"))
    return violating.join(F.broadcast(rules), "domain")


@query(
    "r02_custom_domain",
    sql.with_ctes(
        "SELECT profile_id, domain, missing_values > top AS missing_violation, duplicates > 2.0 AS duplicate_violation, "
        "imbalance_ratio > 10 AS imbalance_violation FROM profiles, (VALUES ('retail', 20.0), ('iot', 0.0)) r(domain, top)",
        ["dirty_orders", "dirty_events"],
        *PROFILE_CTES,
    ),
)
def r02(spark, sf):
    added = custom_rules(spark, "Retail", max_missing_pct=20.0).unionByName(custom_rules(spark, "IoT", max_missing_pct=0.0))
    rules = register_rules(built_in_rules(spark), added)
    get_rules(rules, "RETAIL")
    names = [r["domain"] for r in list_domains(rules).collect() if r["domain"] in ("retail", "iot")]
    found = judge(for_domains(profiles(spark, sf), names), rules)
    return found.select("profile_id", "domain", "missing_violation", "duplicate_violation", "imbalance_violation")


@query("r03_missing_violation", judged_sql("round(missing_values, 6) AS missing_values", "missing_violation"))
def r03(spark, sf):
    return rounded(judged(spark, sf).filter("missing_violation").select("profile_id", "domain", "missing_values"), "missing_values")


@query("r04_duplicate_violation", judged_sql("round(duplicates, 6) AS duplicates", "duplicate_violation"))
def r04(spark, sf):
    return rounded(judged(spark, sf).filter("duplicate_violation").select("profile_id", "domain", "duplicates"), "duplicates")


@query("r05_outlier_warning", judged_sql("round(outliers, 6) AS outliers", "outlier_warning"))
def r05(spark, sf):
    return rounded(judged(spark, sf).filter("outlier_warning").select("profile_id", "domain", "outliers"), "outliers")


# Prices with a long tail: many customers have more than a tenth of their numbers beyond the fences.
_STEEP = "power(o_totalprice / 1000, 6)"


@query(
    "r05_outlier_warning_long_tail",
    sql.with_ctes(
        "SELECT profile_id, domain, round(outliers, 6) AS outliers FROM judged WHERE outlier_warning",
        ["dirty_orders"],
        ("steep", f"SELECT * REPLACE ({_STEEP} AS o_totalprice) FROM dirty_orders"),
        *sql.segments("ps", "steep", "dirty_orders", "o_custkey", "o_orderpriority"),
        ("profiles", "SELECT concat('orders-', seg) AS profile_id, * EXCLUDE (seg) FROM ps"),
        _RULES,
        _JUDGED,
    ),
)
def r05_long_tail(spark, sf):
    steep = dirty_orders(spark, sf).withColumn("o_totalprice", F.expr(_STEEP))
    found = segment_profiles(steep, "o_custkey", "o_orderpriority")
    named = found.select(F.concat(F.lit("orders-"), "o_custkey").alias("profile_id"), *FLAT_COLUMNS)
    warned = judge(for_domains(named, DOMAINS), built_in_rules(spark)).filter("outlier_warning")
    return rounded(warned.select("profile_id", "domain", "outliers"), "outliers")


@query("r06_imbalance_violation", judged_sql("round(imbalance_ratio, 6) AS imbalance_ratio", "imbalance_violation"))
def r06(spark, sf):
    return rounded(judged(spark, sf).filter("imbalance_violation").select("profile_id", "domain", "imbalance_ratio"), "imbalance_ratio")


@query("r07_correlation_warning", judged_sql("round(high_correlation_pct, 6) AS high_correlation_pct", "correlation_warning"))
def r07(spark, sf):
    found = judged(spark, sf).filter("correlation_warning")
    return rounded(found.select("profile_id", "domain", "high_correlation_pct"), "high_correlation_pct")


_VERDICT = (
    "NOT (missing_violation OR duplicate_violation OR imbalance_violation) AS passes_checks, "
    "CASE WHEN missing_violation OR duplicate_violation THEN 'CRITICAL' WHEN imbalance_violation THEN 'HIGH' "
    "WHEN outlier_warning OR correlation_warning THEN 'LOW' ELSE 'PASS' END AS severity_level, "
    "(missing_violation::INTEGER + duplicate_violation::INTEGER + imbalance_violation::INTEGER) AS violations, "
    "(outlier_warning::INTEGER + correlation_warning::INTEGER) AS warnings"
)


def _verdicts(found):
    return found.select(
        "profile_id",
        "domain",
        "passes_checks",
        "severity_level",
        F.size("violations").alias("violations"),
        F.size("warnings").alias("warnings"),
    )


@query("r08_domain_verdict", judged_sql(_VERDICT))
def r08(spark, sf):
    return _verdicts(judged(spark, sf))


@query("s06_rules_saved_and_loaded", judged_sql(_VERDICT))
def s06(spark, sf):
    path = S.shared_folder(spark, "rules")
    S.write_rules(built_in_rules(spark), path)
    return _verdicts(judged(spark, sf, S.read_rules(spark, path)))
