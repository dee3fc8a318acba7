"""Phrase mining against a plain count."""

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tablewright.llm import phrases

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def counted(rows):
    n, f = Counter(), Counter()
    for lang, text in rows:
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(UPPER)):
            words = re.findall(r"[^ \t]+", piece)
            n[lang or "und"] += len(words)
            f.update((lang or "und", *words[i : i + k]) for k in range(1, 6) for i in range(len(words) - k + 1))
    return n, f


def best(rows, least, top):
    n, f = counted(rows)
    frequent = {p: c for p, c in f.items() if c >= least}
    out = {}
    for (lang, *words), a in frequent.items():
        if len(words) < 2:
            continue
        inside = any(
            q[0] == lang and len(q) > len(words) + 1 and c >= a and any(list(q[i : i + len(words)]) == words for i in range(1, len(q)))
            for q, c in frequent.items()
        )
        if inside:
            continue
        cuts = [(f[(lang, *words[:k])], f[(lang, *words[k:])]) for k in range(1, len(words))]
        score, _, l, r = min((1000 * a * n[lang] // (l * r), k, l, r) for k, (l, r) in enumerate(cuts))
        out.setdefault(lang, []).append((-score, -a, " ".join(words).encode(), l, r))
    return sorted(
        (lang, i + 1, p.decode(), -a, l, r, n[lang], -score)
        for lang, found in out.items() for i, (score, a, p, l, r) in enumerate(sorted(found)[:top])
    )


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    words = ["Red", "fish", "über", "ÄB", "of", "THE", "sea", "a\x00b", "x", "|"]
    rows = []
    for i in range(300):
        lang = rng.choice(["en", "en", "en", "de", None, "und"])
        text = " ".join(rng.choices(words, weights=[9, 8, 3, 3, 20, 30, 5, 1, 1, 1], k=rng.randint(0, 40)))
        text = re.sub(" ", lambda _: rng.choice([" ", " ", " ", "  ", "\t", ". ", "\n", ",", " ; ", "\x0b"]), text)
        rows.append((lang, text + (" new york city hall" if i % 9 == 0 else "")))
    return rows + [("en", None), ("en", ""), (None, " . \n"), ("fr", "le chat " * 20), ("fr", "le chat " * 20)]


@pytest.mark.parametrize(("least", "size", "parts"), [(3, 40, 9), (5, 300, 3), (2, 100_000, 1), (20, 25, 30)])
def test_against_plain_count(spark, monkeypatch, texts, least, size, parts):
    monkeypatch.setattr(phrases, "_SLICE", 16)  # cut texts between their pieces
    df = spark.createDataFrame([(i, lang, t, "x", 1) for i, (lang, t) in enumerate(texts)], "doc_id long, lang string, text string, phrase string, n int")
    got = phrases.collocations(df.repartition(parts), least=least, top=30, shard_words=size)
    assert sorted(tuple(r) for r in got.collect()) == best(texts, least, 30)


def test_small_filter_and_few_known_languages(spark, monkeypatch, texts):
    """A filter too small to tell phrases apart and unknown totals cost rows, never counts."""
    monkeypatch.setattr(phrases, "FILTER_BITS", 128)
    monkeypatch.setattr(phrases, "LANGUAGES", 1)
    df = spark.createDataFrame(texts, "lang string, text string")
    got = phrases.collocations(df.repartition(4), least=4, top=1000, shard_words=200)
    assert sorted(tuple(r) for r in got.collect()) == best(texts, 4, 1000)


def test_products_beyond_64_bits(spark):
    big = 4_000_000_000_000
    assert 1000 * big * big > 2**64
    expr = "(CAST(1000 * a AS DECIMAL(38, 0)) * CAST(a AS DECIMAL(38, 0))) DIV (CAST(a AS DECIMAL(38, 0)) * CAST(7 AS DECIMAL(38, 0)))"
    assert spark.createDataFrame([(big,)], "a long").select(F.expr(expr)).first()[0] == 1000 * big // 7


def test_nothing(spark):
    assert phrases.collocations(spark.createDataFrame([], "lang string, text string")).count() == 0
    assert phrases.collocations(spark.createDataFrame([("en", None), (None, "")], "lang string, text string")).count() == 0


def test_a_phrase_gives_a_row_for_each_task_that_counts(spark, monkeypatch):
    given, plain = spark.sparkContext.accumulator(0), phrases.counter

    def watched(marks, size):
        run = plain(marks, size)

        def tally(batches):
            for batch in run(batches):
                given.add(batch.num_rows)
                yield batch

        return tally

    monkeypatch.setattr(phrases, "counter", watched)
    docs = spark.createDataFrame([("en", "the cat sat here")] * 200, "lang string, text string").repartition(100)
    counts, _ = phrases.phrase_counts(docs, least=100, shard_words=8)
    assert sorted((r["phrase"], r["words"], r["n"]) for r in counts.collect() if r["words"] > 2) == [
        ("cat sat here", 3, 200), ("the cat sat", 3, 200), ("the cat sat here", 4, 200)
    ]
    assert counts.count() == 10 and 10 <= given.value <= 10 * phrases.WAVES * spark.sparkContext.defaultParallelism


def test_rare_phrases_of_many_shards_are_not_handed_on(spark, monkeypatch):
    """In more shards than the support no shard can tell by itself what is rare; the rows kept must not grow with it."""
    kept, plain = {}, phrases.stored

    def watched(df, what="table"):
        table = plain(df, what)
        kept[what] = table.count()
        return table

    monkeypatch.setattr(phrases, "stored", watched)
    texts = [("en", f"the cat sat . a{i} b{i} c{i} d{i} e{i} f{i}") for i in range(300)]
    docs = spark.createDataFrame(texts, "lang string, text string").repartition(60)
    counts, totals = phrases.phrase_counts(docs, least=50, shard_words=30)
    assert {r["phrase"]: r["n"] for r in counts.collect()} == dict.fromkeys(["the", "cat", "sat", "the cat", "cat sat", "the cat sat"], 300)
    assert totals.first()["n"] == 2700 and sum(kept.values()) < 100


def test_lengths_read_one_after_the_other_give_the_same_counts(spark, monkeypatch, texts):
    """Cells too few for all lengths at once, and counts beyond a byte."""
    rows = texts * 8
    df = spark.createDataFrame(rows, "lang string, text string").repartition(5)
    want = {(lang, " ".join(words)): n for (lang, *words), n in counted(rows)[1].items() if n >= 300}
    marks, read = phrases.sketcher, []
    monkeypatch.setattr(phrases, "sketcher", lambda known, cells, low, high, least, size: read.append((low, high)) or marks(known, cells, low, high, least, size))
    monkeypatch.setattr(phrases, "FILTER_BITS", 256)
    got, _ = phrases.phrase_counts(df, least=300, shard_words=5000)
    assert {(r["lang"], r["phrase"]): r["n"] for r in got.collect()} == want and any(n > 255 for n in want.values())
    assert len(read) > 1 and [low for low, _ in read[1:]] == [high + 1 for _, high in read[:-1]]
