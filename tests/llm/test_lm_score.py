import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tablewright.llm import lm_score


def whole_tree(texts):
    """The tree of all texts from plain counts, and a function that scores a text with it."""
    ends = [[None, *t, None] for t in texts]
    n = Counter(w for t in ends for w in t[1:])
    words = sorted((w for w in n if w is not None), key=lambda w: np.uint64(lm_score.xxh3_64_intdigest(w)).astype(np.int64))
    number = {None: 0} | {w: i + 1 for i, w in enumerate(words)}
    count = lambda k: Counter(tuple(number[w] for w in t[i : i + k]) for t in ends for i in range(len(t) - k + 1))
    key = lambda a, b: (a << lm_score.BITS) | b
    pairs = {key(*p): c for p, c in count(2).items() if c >= lm_score.LEAST}
    pair_keys = np.array(sorted(pairs), np.int64)
    place = {k: i for i, k in enumerate(pair_keys.tolist())}
    triples = sorted((key(place[key(a, b)], c), k) for (a, b, c), k in count(3).items() if k >= lm_score.LEAST)
    hashes = np.array([np.uint64(lm_score.xxh3_64_intdigest(w)).astype(np.int64) for w in words], np.int64)
    whole = sum(n.values()) + 0.5 * (len(n) + 1)
    tree = lm_score.Tree(
        lm_score.Strings(hashes, pair_keys), np.array([n[None], *[n[w] for w in words]]), np.array([pairs[k] for k in pair_keys.tolist()], np.int64),
        np.array([t[0] for t in triples], np.int64), np.array([t[1] for t in triples], np.int64), whole,
    )

    def score(text):
        chain = [None, *text, None]
        ids = np.array([number.get(w, -1) for w in chain])
        log = np.log10((np.array([n.get(w, 0) for w in chain]) + 0.5) / whole)
        log[0] = 0
        logs = tree.score(ids, log, np.array([0]))
        return log.sum(), logs.sum(), int((logs != log).sum())

    return tree, score


@pytest.mark.parametrize("block_chars", [700, 1 << 24])
def test_scores_of_blocks_equal_those_of_the_whole_tree(spark, monkeypatch, block_chars):
    monkeypatch.setattr(lm_score, "BLOCK_CHARS", block_chars)
    monkeypatch.setattr(lm_score, "SHARD_BYTES", block_chars)
    draw = random.Random(3)
    rare = [f"rare{i}" for i in range(40)]
    texts = [" ".join(draw.choice("abcdef") if draw.random() < 0.8 else draw.choice(rare) for _ in range(draw.randrange(0, 40))) for _ in range(150)]
    texts += [" ".join(rare[i : i + 12]) for i in range(20)] + ["A b  a b\n" * 30, *["p q r s q t " * 20] * 3, "never seen words", "", None]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    split = [(t or "").lower().encode().split() for t in texts]
    tree, score = whole_tree([t for i, t in enumerate(split) if i % 5])
    assert tree.keep1.any() and tree.keep2.any()
    found = {r["doc_id"]: r for r in lm_score.lm_scores(docs, F.col("doc_id") % 5 != 0).collect()}
    assert len(found) == len(texts)
    for i, words in enumerate(split):
        base, all_, longer = score(words)
        assert found[i]["base_score"] == pytest.approx(base, abs=1e-9)
        assert found[i]["score"] == pytest.approx(all_, abs=1e-4)
        assert found[i]["ctx_tokens"] == longer


def test_rare_contexts_stay_in_a_large_corpus(spark):
    passage = " ".join(f"unusual{i}" for i in range(60))
    docs = spark.createDataFrame([(1, passage), (2, passage), (3, "common " * 3_000_000)], "doc_id long, text string")
    found = {r["doc_id"]: r for r in lm_score.lm_scores(docs, F.lit(True)).collect()}
    assert found[1]["ctx_tokens"] >= 59
    assert found[1]["score"] > 0.2 * found[1]["base_score"]
    assert math.isclose(found[1]["score"], found[2]["score"])
