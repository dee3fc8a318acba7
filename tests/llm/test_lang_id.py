"""All labelled rows teach the language model, not the rows of its start alone."""

import pytest
from pyspark.sql import functions as F

from tablewright.llm import lang_id

ENDS = {"aa": ("ark", "ast", "aff"), "bb": ("oum", "ouv", "oux"), "cc": ("iqi", "izi", "ihi")}


@pytest.fixture(scope="module")
def labelled(spark):
    rows = [
        (i, " ".join(f"{chr(98 + (i * 7 + j * 5) % 20)}{ends[(i + j) % 3]}" for j in range(12)), lang)
        for lang, ends in ENDS.items() for i in range(200)
    ]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3, "doc_id")


def test_rows_beyond_the_start_are_learned(spark, labelled, monkeypatch):
    monkeypatch.setattr(lang_id, "MOST_ROWS", 1)
    model = lang_id.learn(labelled)
    assert model.labels == ["aa", "bb", "cc"]
    said = labelled.select("lang", lang_id.identify(model, F.col("text"), spark).alias("a"))
    assert said.agg(F.avg((F.col("a.language") == F.col("lang")).cast("double"))).first()[0] > 0.95


def test_calibration_counts_all_rows_held_out(spark, labelled):
    key = F.xxhash64("text", F.col("lang").alias("label"))
    rows = labelled.select(F.col("lang").alias("label"), "text", key.alias("key"))
    place = {"aa": 0, "bb": 1, "cc": 2}

    def count(batches):
        import numpy as np

        parts = [len(y) for _, y in lang_id.gathered(batches, place, True)]
        return np.array([float(sum(parts))])

    held = [r for r in rows.collect() if r["key"] // 1_000_003 % 5 == 0]
    want = sum(len(lang_id.pieces(r["text"], r["key"] & 0xFFFFFFFF)) for r in held)
    assert lang_id.added(rows, count)[0] == want > 0
