"""Generators of the comparison SQL (run by DuckDB over the same tables)."""

from __future__ import annotations

from catalog.views import COLUMNS, VIEW_SQL

SEED = 42


def with_ctes(final: str, views: tuple[str, ...] | list[str] = (), *ctes: tuple[str, str]) -> str:
    """A statement over dirty views and further named sub-queries."""
    parts = [f"{v} AS ({VIEW_SQL[v]})" for v in views] + [f"{name} AS ({body})" for name, body in ctes]
    return f"WITH {', '.join(parts)} {final}" if parts else final


def missing(view: str) -> str:
    return " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", count(*) AS n, count(*) - count({c}) AS missing FROM {view}"
        for c in COLUMNS[view]["all"]
    )


def fences(view: str, columns: list[str], k: float) -> str:
    """One row: lower and upper fence of every column."""
    quartiles = ", ".join(
        f"quantile_cont({c}, 0.25) - {k}::DOUBLE * (quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)) AS lo_{c}, "
        f"quantile_cont({c}, 0.75) + {k}::DOUBLE * (quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)) AS hi_{c}"
        for c in columns
    )
    return f"SELECT {quartiles} FROM {view}"


def outliers(view: str, columns: list[str], fence: str = "fence") -> str:
    """Needs a CTE from :func:`fences`."""
    return " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", count(*) AS n, "
        f"count(*) FILTER (WHERE {c} < lo_{c} OR {c} > hi_{c}) AS outliers FROM {view}, {fence}"
        for c in columns
    )


def correlation(view: str, columns: list[str]) -> str:
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    return " UNION ALL ".join(
        f"SELECT '{a}' AS feature1, '{b}' AS feature2, "
        f"CASE WHEN var_pop(CASE WHEN {b} IS NOT NULL THEN {a} END) > 0 AND var_pop(CASE WHEN {a} IS NOT NULL THEN {b} END) > 0 "
        f"THEN abs(covar_pop({a}, {b}) / sqrt(var_pop(CASE WHEN {b} IS NOT NULL THEN {a} END) * "
        f"var_pop(CASE WHEN {a} IS NOT NULL THEN {b} END))) END AS abs_corr FROM {view}"
        for a, b in pairs
    )


def duplicates(view: str) -> str:
    return (
        "SELECT sum(k)::BIGINT AS n, sum(k - 1)::BIGINT AS dup FROM "
        f"(SELECT count(*) AS k FROM {view} GROUP BY {', '.join(COLUMNS[view]['all'])})"
    )


def classes(view: str, target: str) -> str:
    return f"SELECT {target} AS class, count(*) AS n FROM {view} WHERE {target} IS NOT NULL GROUP BY {target}"


def score_ctes(view: str, target: str, tag: str = "") -> list[tuple[str, str]]:
    """CTEs ending in ``scored``: the five score inputs and the score of one view."""
    return [
        (f"{tag}miss", missing(view)),
        (f"{tag}fence", fences(view, COLUMNS[view]["numeric"], 1.5)),
        (f"{tag}outl", outliers(view, COLUMNS[view]["numeric"], f"{tag}fence")),
        (f"{tag}corr", correlation(view, COLUMNS[view]["numeric"])),
        (f"{tag}dups", duplicates(view)),
        (f"{tag}cls", classes(view, target)),
        (
            f"{tag}inputs",
            f"SELECT (SELECT 100.0::DOUBLE * sum(missing) / sum(n) FROM {tag}miss) AS missing_pct, "
            f"(SELECT 100.0::DOUBLE * dup / n FROM {tag}dups) AS duplicate_pct, "
            f"(SELECT sum(outliers)::BIGINT FROM {tag}outl) AS total_outliers, "
            f"(SELECT max(n)::DOUBLE / min(n) FROM {tag}cls) AS imbalance_ratio, "
            f"(SELECT count(*) FROM {tag}corr WHERE abs_corr > 0.9) AS high_pairs",
        ),
        (
            f"{tag}scored",
            "SELECT *, greatest(0.0::DOUBLE, 100.0::DOUBLE - least(missing_pct * 0.5::DOUBLE, 25.0::DOUBLE) "
            "- least(duplicate_pct * 2.0::DOUBLE, 15.0::DOUBLE) - CASE WHEN total_outliers > 0 THEN 10 ELSE 0 END "
            "- CASE WHEN imbalance_ratio > 5 THEN 15 WHEN imbalance_ratio > 2 THEN 10 ELSE 0 END "
            f"- CASE WHEN high_pairs > 3 THEN 10 ELSE 0 END) AS quality_score FROM {tag}inputs",
        ),
    ]


BAND = (
    "CASE WHEN {0} >= 90 THEN 'excellent' WHEN {0} >= 70 THEN 'good' WHEN {0} >= 50 THEN 'fair' "
    "WHEN {0} IS NOT NULL THEN 'poor' END"
)


def segments(name: str, source: str, view: str, by: str | None, target: str) -> list[tuple[str, str]]:
    """CTEs ending in ``name``: a flat profile per segment of ``source``, a sub-query with the columns of ``view``."""
    cols = {k: [c for c in v if c != by] for k, v in COLUMNS[view].items()}
    seg = by if by else "0"
    width, numeric, strings = len(cols["all"]), cols["numeric"], cols["strings"]
    pairs = [(a, b) for i, a in enumerate(numeric) for b in numeric[i + 1 :]]
    nulls = " + ".join(f"count(*) - count({c})" for c in cols["all"])
    beyond = " + ".join(f"count(*) FILTER (WHERE {c} < lo_{c} OR {c} > hi_{c})" for c in numeric) or "0"
    mixed = " + ".join(
        f"CASE WHEN count(try_cast({c} AS DOUBLE)) > 0 AND count({c}) - count(try_cast({c} AS DOUBLE)) > 0 THEN 1 ELSE 0 END"
        for c in strings
    ) or "0"

    def high(a: str, b: str) -> str:
        x, y = f"CASE WHEN {b} IS NOT NULL THEN {a} END", f"CASE WHEN {a} IS NOT NULL THEN {b} END"
        return (
            f"CASE WHEN coalesce(var_pop({x}) * var_pop({y}), 0) > 0 THEN CASE WHEN abs(covar_pop({a}, {b}) / "
            f"sqrt(var_pop({x}) * var_pop({y}))) > 0.9 THEN 1 ELSE 0 END ELSE 0 END"
        )

    flagged = " + ".join(high(a, b) for a, b in pairs) or "0"
    n = name
    return [
        (f"{n}_fence", fences(source, numeric, 1.5)),
        (
            f"{n}_cells",
            f"SELECT {seg} AS seg, count(*) AS rows_n, ({nulls}) AS nulls, ({beyond}) AS beyond, ({mixed}) AS mixed, "
            f"({flagged}) AS flagged FROM {source}, {n}_fence GROUP BY 1",
        ),
        (
            f"{n}_dups",
            f"SELECT seg, sum(k - 1) AS dup FROM (SELECT {seg} AS seg, count(*) AS k FROM {source} "
            f"GROUP BY {', '.join([seg, *cols['all']] if by else cols['all'])}) GROUP BY seg",
        ),
        (
            f"{n}_ratio",
            f"SELECT seg, max(k)::DOUBLE / min(k) AS ratio FROM (SELECT {seg} AS seg, {target} AS c, count(*) AS k "
            f"FROM {source} WHERE {target} IS NOT NULL GROUP BY 1, 2) GROUP BY seg",
        ),
        (
            f"{n}_flat",
            f"SELECT seg, 100.0::DOUBLE * nulls / (rows_n * {width}) AS missing_values, 100.0::DOUBLE * dup / rows_n AS duplicates, "
            f"100.0::DOUBLE * beyond / (rows_n * {max(len(numeric), 1)}) AS outliers, coalesce(ratio, 1.0)::DOUBLE AS imbalance_ratio, "
            f"flagged * 100.0::DOUBLE / {max(len(pairs), 1)} AS high_correlation_pct, mixed::DOUBLE AS type_inconsistencies, "
            f"rows_n::DOUBLE AS dataset_size, {width}::DOUBLE AS n_features, {len(strings)} * 100.0::DOUBLE / {width} AS categorical_pct, "
            f"{len(numeric)} * 100.0::DOUBLE / {width} AS numeric_pct, beyond, flagged "
            f"FROM {n}_cells JOIN {n}_dups USING (seg) LEFT JOIN {n}_ratio USING (seg)",
        ),
        (
            n,
            f"SELECT * EXCLUDE (beyond, flagged), greatest(0.0::DOUBLE, 100.0::DOUBLE - least(missing_values * 0.5::DOUBLE, 25.0::DOUBLE) "
            f"- least(duplicates * 2.0::DOUBLE, 15.0::DOUBLE) - CASE WHEN beyond > 0 THEN 10 ELSE 0 END "
            f"- CASE WHEN imbalance_ratio > 5 THEN 15 WHEN imbalance_ratio > 2 THEN 10 ELSE 0 END "
            f"- CASE WHEN flagged > 3 THEN 10 ELSE 0 END) AS quality_score FROM {n}_flat",
        ),
    ]


def hash_key(expr: str, seed: int | str = SEED) -> str:
    return f"md5(concat(CAST({expr} AS VARCHAR), '-{seed}'))"
