"""Every registered query with SQL gives the SQL's rows in DuckDB; names and contract hold."""

from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as contract
from catalog import ORACLES, QUERIES
from check import compare


@pytest.fixture(scope="module")
def con(sf):
    con = duckdb.connect()
    for path in sorted(Path(sf).glob("*.parquet")):
        con.sql(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con


def test_contract(spark):
    assert set(contract.oracle_sql()) <= set(contract.queries())
    assert contract.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, con, sf, name):
    verdict = compare(spark, con, name, sf)
    assert verdict.startswith("match"), verdict
    assert "types differ" not in verdict, verdict


@pytest.mark.parametrize("name", ["m02_logistic_regression", "g04_generalization_summary", "pm08_feature_importances", "x02_many_experiments"])
def test_learning_query_runs(spark, sf, name):
    assert name in QUERIES and QUERIES[name](spark, sf).count() > 0
