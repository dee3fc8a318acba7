"""Decontamination against a plain search for all windows."""

import hashlib
import random
import re

import pytest

from tablewright.llm import decontaminate

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(UPPER))


def expected(docs, items):
    windows = {}
    for item, text in items:
        w = words(text)
        m = min(len(w), 10)
        for i in range(len(w) - m + 1 if m else 0):
            windows.setdefault(tuple(w[i : i + m]), set()).add("" if item is None else str(item))
    sizes = {len(w) for w in windows}
    out = []
    for doc_id, text in docs:
        w = words(text)
        found = [(i, i + m, tuple(w[i : i + m])) for m in sizes for i in range(len(w) - m + 1) if tuple(w[i : i + m]) in windows]
        hit = {j for a, b, _ in found for j in range(a, b)}
        ids = sorted(set().union(*(windows[x] for _, _, x in found)))
        out.append((doc_id, len(w), len(hit), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr)


def check(spark, docs, items):
    d = spark.createDataFrame([(i, t, "k", 1, "r") for i, t in docs], "doc_id long, text string, key string, pos int, run string").repartition(3)
    b = spark.createDataFrame([(i, t, "s") for i, t in items], "item_id long, text string, spot string")
    got = sorted((tuple(r) for r in decontaminate.decontaminate(d, b).collect()), key=repr)
    assert got == expected(docs, items)
    return got


def corpus(seed, letters, sizes):
    """Few distinct words, so that runs repeat and windows tie; items and documents share stretches of all lengths."""
    rng = random.Random(seed)
    some = lambda n: [rng.choice(letters) for _ in range(n)]
    items = [(i, some(rng.choice(sizes))) for i in range(25)]
    docs = []
    for i in range(80):
        parts = some(rng.randint(0, 40))
        for _ in range(rng.randint(0, 3)):
            item = rng.choice(items)[1]
            a = rng.randint(0, max(0, len(item) - 4))
            parts += item[a : a + rng.randint(3, 25)] + some(rng.randint(0, 12))
        docs.append((i, parts))
    spell = lambda parts: "".join(p.upper() + rng.choice([" ", "-", "\n", "/", " . "]) for p in parts)
    return [(i, spell(p)) for i, p in docs], [(i, " ".join(p)) for i, p in items]


@pytest.mark.parametrize(
    ("seed", "letters", "sizes"),
    [(1, ["a", "b"], [10, 11, 14, 40]), (2, ["a"], [9, 10, 30]), (3, list("abcdefgh"), [1, 2, 5, 8, 9, 10, 12, 60]), (4, list("abcdefghijklmnop"), [3, 20, 90])],
)
def test_against_all_windows(spark, seed, letters, sizes):
    docs, items = corpus(seed, letters, sizes)
    assert any(r[-1] for r in check(spark, docs, items))


def test_odd_rows(spark):
    passage = "Der Ärger über Ünïcode 3x ÉCLAIR kommt immer wieder vor sagte sie"
    long = " ".join(f"w{i * 7919 % 9973}" for i in range(30_000))
    items = [(1, passage), (1, "another text of the same item that is long enough here"), (2, passage), (None, passage.lower()), (3, None), (4, " .. "),
             (5, long), (2**60 + 1, "rare word"), (7, "x " * 12)]
    docs = [
        (1, passage), (1, passage), (None, f"so: {passage}!"), (2, passage.replace("Ä", "ä")), (3, None), (4, ""), (5, "--"), (6, long), (6, f"{long} x"),
        (7, "a rare_word"), (8, "rareword"), (9, "x " * 70), (10, "x " * 9), (11, passage[: passage.index(" sagte")]),
        (12, " ".join(passage.split()[1:])), (2**60 + 3, "and\x00rare\x7fword"),
    ] + [(100 + i, passage) for i in range(50)]
    got = check(spark, docs, items)
    assert (11, 10, 10, 2) in {r[:4] for r in got}


def test_empty(spark):
    check(spark, [(1, "some words here"), (2, None)], [])
    check(spark, [(1, "some words here")], [(1, None), (2, "")])
    check(spark, [], [(1, "some words that are here")])


def test_joined_by_shuffle(spark):
    """The same rows where kept runs are too large to broadcast."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        check(spark, *corpus(5, list("abcdefgh"), [1, 4, 9, 10, 12, 60]))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
