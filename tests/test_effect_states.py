"""States of the fix history: merging equals one pass over all effects."""

import random
from functools import reduce

import pytest
from pyspark.sql import DataFrame

from tablewright.operators import effect_states as ES
from tablewright.operators import history as H
from tablewright.sources import files as S


def drawn(spark, n, shift=0.0):
    r = random.Random(n)
    rows = [
        (r.choice("ab"), r.choice(["numeric", "text", None]), r.choice(["x", "y", None]), None if r.random() < 0.1 else shift + r.gauss(0, 1), r.random())
        for _ in range(n)
    ]
    return spark.createDataFrame(rows, "fix_name string, data_type string, domain string, f1_improvement double, data_loss_pct double")


def table(df, *columns):
    def plain(v):
        return round(v, 6) if isinstance(v, float) else v

    return sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)


COLUMNS = (
    "fix_name", "data_type", "avg_effectiveness", "std_effectiveness", "avg_f1_improvement", "avg_data_loss", "num_trials", "recommendation",
)


@pytest.mark.parametrize("shift", [0.0, 1e6])
def test_merged_batches_equal_all_effects(spark, shift):
    effects = drawn(spark, 400, shift).repartition(3).cache()
    batches = [b for b in effects.randomSplit([5.0, 1.0, 1.0, 0.001], 3)]
    states = reduce(DataFrame.union, [ES.effect_states(b) for b in batches])
    once = ES.merge_states(states)
    for some in (states, once, ES.effect_states(effects)):
        got = table(ES.analyze_states(some).drop("std_effectiveness"), *[c for c in COLUMNS if c != "std_effectiveness"])
        assert got == table(H.analyze_effectiveness(effects), *[c for c in COLUMNS if c != "std_effectiveness"])
        deviations = {(r[0], r[1]): r[2] for r in ES.analyze_states(some).select("fix_name", "data_type", "std_effectiveness").collect()}
        for r in H.analyze_effectiveness(effects).collect():
            assert deviations[r["fix_name"], r["data_type"]] == pytest.approx(r["std_effectiveness"], rel=1e-6)
        for domain in (None, "x", "unknown"):
            want = table(H.best_fixes(effects, ["numeric", "text"], domain), "data_type", "fix_name", "effectiveness", "rank")
            assert table(ES.best_fixes_of_states(some, ["numeric", "text"], domain), "data_type", "fix_name", "effectiveness", "rank") == want


def test_measures_that_are_all_null(spark):
    nothing = spark.createDataFrame([("a", "text", "x", None, 1.0)] * 2, "fix_name string, data_type string, domain string, f1_improvement double, data_loss_pct double")
    assert table(ES.analyze_states(ES.effect_states(nothing)), *COLUMNS) == table(H.analyze_effectiveness(nothing), *COLUMNS)
    assert ES.analyze_states(ES.effect_states(nothing.limit(0))).count() == 0


def test_a_batch_written_again_counts_once(spark, tmp_path):
    path, effects = str(tmp_path / "states"), drawn(spark, 60)
    for batch in ("monday", "tuesday", "monday"):
        S.append_table(ES.effect_states(effects), path, batch)
    stored = S.read_batches(spark, path, ES.STATE_SCHEMA)
    assert ES.merge_states(stored).agg({"num_trials": "sum"}).first()[0] == 120
    assert table(ES.analyze_states(stored), *COLUMNS) == table(H.analyze_effectiveness(effects.union(effects)), *COLUMNS)
    # What is recorded is bounded by the keys, whatever the number of effects.
    assert stored.count() == 2 * effects.select("fix_name", "data_type", "domain").distinct().count()
    with pytest.raises(ValueError):
        S.append_table(effects, path, "a/b")


def test_registrations_by_batch(spark, tmp_path):
    path = str(tmp_path / "registry")
    rows = spark.createDataFrame([("d1", "finance"), ("d2", "iot")], "dataset_id string, domain string")
    S.register_datasets(rows, path, "r1")
    S.register_datasets(rows, path, "r1")
    assert spark.read.parquet(path).count() == 2
    assert "batch" not in S.read_registry(spark, path).columns
