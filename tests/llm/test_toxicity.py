import random

import numpy as np
from pyspark.sql import functions as F

from tablewright.llm import lang_id, toxicity


def test_unseen_forms_of_a_stem_are_found():
    draw = random.Random(7)
    syllables = ["ba", "de", "ki", "lo", "mu", "ra", "se", "ti", "no", "pu"]
    word = lambda: "".join(draw.choices(syllables, k=3))
    texts, y = [], np.arange(600) % 2
    for kind in y:
        words = [word() for _ in range(40)]
        if kind:
            words[draw.randrange(40)] = "vragh" + "".join(draw.choices("abcdefghijklmnopqrstuvwxyz", k=6))
        texts.append(toxicity.buckets(" ".join(words)))
    z = toxicity.fit(texts[:400], y[:400]).logits(texts[400:])
    assert (z[y[400:] == 1] > np.quantile(z[y[400:] == 0], 0.99)).mean() > 0.95


def test_only_texts_that_may_have_a_label_are_judged(spark):
    texts = [toxicity.buckets(t) for t in ("a bad word", "a good word")]
    network = toxicity.fit(texts * 4, np.array([1, 0] * 4))
    languages = lang_id.Model(["en"], np.zeros((lang_id.BUCKETS, 1)), np.zeros(1), 1.0, np.zeros(1))
    docs = spark.createDataFrame([(i, "a bad word" if i % 2 else "a good word") for i in [*range(1000), None] if i], "doc_id long, text string")
    docs = docs.union(spark.createDataFrame([(None, "a word")], docs.schema)).coalesce(3)
    bits = toxicity.marks(docs.where("doc_id % 10 = 0").select(F.col("doc_id").cast("int")))
    judged = toxicity.judge(spark.sparkContext.broadcast((network, languages, bits)), F.col("text"), toxicity.spot(F.col("doc_id")))
    found = {r["doc_id"]: (r["j"]["spoken"], r["j"]["step"]) for r in docs.select("doc_id", judged.alias("j")).collect()}
    step = int(np.rint(network.logits([texts[1]])[0] / toxicity.STEP))
    assert all(found[i] == ("en", step) for i in range(10, 1000, 10))
    assert sum(step is not None for _, step in found.values()) < 110


def test_scores_do_not_depend_on_the_next_text():
    network = toxicity.fit([toxicity.buckets(t) for t in ("a bad word", "a good word")] * 4, np.array([1, 0] * 4))
    alone = {t: network.logits([toxicity.buckets(t)])[0] for t in ("x", "a bad word", "")}
    for batch in (["x", "a bad word"], ["x", ""], ["", "", "a bad word", "x"]):
        assert np.allclose(network.logits([toxicity.buckets(t) for t in batch]), [alone[t] for t in batch], atol=1e-5)
    assert abs(alone[""] - network.bias[0]) < 1e-6
