"""The training-data operators against brute-force versions, on odd rows and on the small tables."""

import hashlib
import itertools
import math
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from sentencepiece import SentencePieceProcessor

import __spark_entry__ as contract
import corpus_pipeline
from tablewright.llm import chat_format, exact_dedup, lang_id, licenses, lm_score, near_dedup, packing, pieces, quality, queries, toxicity
from tablewright.llm.common import table

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
PIECE_MODEL = public_tokenizers.path("piece_bpe_32k.model")


def rows(df, *names):
    return sorted((tuple(r[n] for n in names) for r in df.collect()), key=repr)


def texts_of(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


def test_registered():
    names = contract.queries()
    assert set(queries.QUERIES) | {"pipeline"} <= set(names)
    assert set(queries.ORACLES) <= set(contract.oracle_sql())


# --- language-model score


def test_lm_base_score_and_counts(odd):
    found = lm_score.lm_scores(odd, F.lit(True)).collect()
    texts = texts_of(odd)
    tokens = Counter(w for _, t in texts for w in [*(t or "").encode().lower().split(), None])
    n, v = sum(tokens.values()), len(tokens)
    expected = sorted(
        (repr(i), len((t or "").encode().lower().split()) + 1,
         round(sum(math.log10((tokens[w] + 0.5) / (n + 0.5 * (v + 1))) for w in [*(t or "").encode().lower().split(), None]), 4))
        for i, t in texts
    )
    got = sorted((repr(r["doc_id"] if r["doc_id"] is None else int(r["doc_id"])), r["n_tokens"], round(r["base_score"], 4)) for r in found)
    assert got == expected
    assert all(r["train_tokens"] == n and r["n_known"] == r["n_tokens"] for r in found)


def test_lm_distributions_sum_to_one():
    texts = [[b"a", b"b", b"c"]] * 30 + [[b"a", b"x"]] * 5 + [[b"b", b"y", b"a"]] * 4
    words = sorted({w for t in texts for w in t}, key=lambda w: np.uint64(lm_score.xxh3_64_intdigest(w)).astype(np.int64))
    flat = [w for t in texts for w in [*t, None]]
    n = Counter(flat)
    number = {None: 0} | {w: i + 1 for i, w in enumerate(words)}
    pairs, triples = Counter(), Counter()
    for t in texts:
        ids = [0, *[number[w] for w in t], 0]
        pairs.update(zip(ids, ids[1:]))
        triples.update(zip(ids, ids[1:], ids[2:]))
    key = lambda a, b: (a << lm_score.BITS) | b
    pair_keys = np.array(sorted(key(*p) for p in pairs))
    place = {k: i for i, k in enumerate(pair_keys.tolist())}
    triple = sorted((key(place[key(a, b)], c), k) for (a, b, c), k in triples.items())
    hashes = np.array([np.uint64(lm_score.xxh3_64_intdigest(w)).astype(np.int64) for w in words])
    strings = lm_score.Strings(hashes, pair_keys)
    whole = len(flat) + 0.5 * (len(n) + 1)
    tree = lm_score.Tree(
        strings, np.array([n[None], *[n[w] for w in words]]),
        np.array([pairs[k >> lm_score.BITS, k & ((1 << lm_score.BITS) - 1)] for k in pair_keys.tolist()]),
        np.array([t[0] for t in triple]), np.array([t[1] for t in triple]), whole,
    )
    assert tree.keep1.any()
    for before in itertools.product([None, *words], repeat=2):
        total = 0.0
        for following in [None, *words, b"unknown"]:
            chain = [*before, following]
            ids = np.array([0, *[number.get(w, -1) for w in chain]])
            log = np.log10((np.array([n.get(w, 0) for w in [None, *chain]]) + 0.5) / whole)
            total += 10 ** tree.score(ids, log, np.array([0]))[-1]
        assert total == pytest.approx(1, abs=1e-6)


def test_lm_beats_unigrams_on_held_out(spark):
    p = queries.op1_lm_score(spark, "/root/testdata/sf0.01").toPandas()
    held = p[p["held_out"]]
    assert held["score"].sum() > held["base_score"].sum()


def test_lm_empty(nothing):
    assert lm_score.lm_scores(nothing, F.lit(True)).count() == 0


# --- quality rules


def test_cascade_verdict_is_that_of_all_rules(odd):
    got = odd.select("text", quality.cascade(odd, measure_all=True).alias("v")).select("text", "v.*").collect()
    for r in got:
        measured = quality.Measured(r["text"])
        assert r["kept"] == (not any(measured.rejected(rule) for rule in quality.RULES))
        words = [w for w in (r["text"] or "").translate(quality.TO_SPACE).split(" ") if w]
        windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
        often = Counter(windows)
        assert r["n_repeat_words"] == len({i + j for i, w in enumerate(windows) if often[w] > 1 for j in range(8)})


def test_cascade_stops_early(odd):
    got = odd.select(quality.cascade(odd).alias("v")).select("v.*").where("NOT kept").collect()
    assert any(r["rules_run"] < len(quality.RULES) for r in got)
    assert any(r["n_repeat_words"] is None or r["n_shouted"] is None for r in got)


def test_rules_are_ordered_by_rejection_per_cost():
    a, b, c = quality.RULES[:3]
    assert quality.ordered([(a, 1.0, 0.1), (b, 0.1, 0.1), (c, 0.5, 0.0)]) == [b, a, c]


def test_cascade_empty(nothing):
    assert nothing.where(quality.cascade(nothing)["kept"]).count() == 0


# --- chat formatting


def test_chat_round_trip_and_order(spark):
    data = [
        (1, 0, "system", "[INST] be <kind> \\"), (1, 1, "user", "</s>[INST] ok [/INST]"), (1, 2, "assistant", "</s>\\[ "), (2, 0, "assistant", None),
        (2, 1, None, "x"), (3, 0, "tool]", "y ] z"), (3, 0, "tool]", "y ] z"), (None, 1, "user", "q"), (None, None, "user", "first"), (4, 0, "user", "a"),
    ]
    df = spark.createDataFrame([(*d, "extra") for d in data], "conv_id long, turn int, role string, text string, part string")
    got = {r["conv_id"]: r for r in chat_format.conversation_digests(chat_format.format_chat(df)).collect()}
    by = {}
    for d in sorted(data, key=lambda d: (d[0] is not None, d[0] or 0, d[1] is not None, d[1] or 0, d[2] or "", d[3] or "")):
        by.setdefault(d[0], []).append((d[2] or "", d[3] or ""))
    for conv, turns in by.items():
        assert got[conv]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
        under = "".join(t for r, t in turns if r == "assistant")
        assert got[conv]["loss_sha256"] == hashlib.sha256(under.encode()).hexdigest() and got[conv]["loss_chars"] == len(under)
    assert [got[k]["bad_turn"] for k in (1, 2, 3, 4, None)] == [None, 0, 0, 1, 1]
    segments = chat_format.format_chat(df).where("part = 1").collect()
    controls = [m.opening.strip() for m in chat_format.TEMPLATE.values()] + [m.closing.strip() for m in chat_format.TEMPLATE.values()]
    assert not any(c in s["segment"] for s in segments for c in controls)
    assert chat_format.conversation_digests(chat_format.format_chat(df.where("false"))).count() == 0


# --- language identification


def test_language_on_held_out(spark):
    p = queries.op4_language_id(spark, "/root/testdata/sf0.01").toPandas().merge(table(spark, "/root/testdata/sf0.01", "documents").select("doc_id", "lang").toPandas())
    held = p[p["held_out"]]
    assert (held["lang_pred"] == held["lang"]).mean() > 0.97 and p["score"].between(0, 1).all()


def test_language_odd_rows(spark, odd, nothing):
    model = lang_id.learn(odd.where("text LIKE 'w%'"))
    got = {r["text"]: r["a"] for r in odd.select("text", lang_id.identify(model, F.col("text"), spark).alias("a")).collect()}
    assert got[None]["language"] == got[""]["language"] == got["1 2 3"]["language"] == "und"
    assert got["one two"]["language"] == "en"
    unlearned = lang_id.learn(nothing)
    assert {r[0] for r in odd.select(lang_id.identify(unlearned, F.col("text"), spark)["language"]).collect()} == {"und"}


# --- packing


@pytest.mark.parametrize("window", [64, 4096])
def test_packing_is_gapless_and_exact(odd, window):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(WORD_BPE)
    got = packing.pack(odd, WORD_BPE, window).collect()
    sequences, docs = {}, {}
    for r in got:
        assert r["length"] > 0
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        docs.setdefault(r["doc_id"], []).append((r["doc_tokens"], r["start"], np.frombuffer(r["ids"], "<u4").tolist()))
    for placed in sequences.values():
        at = 0
        for offset, length in sorted(placed):
            assert offset == at
            at += length
        assert at <= window
    assert sum(length for s in sequences.values() for _, length in s) > (len(sequences) - 1) * window
    expected, found = Counter(), Counter()
    for doc_id, text in texts_of(odd):
        expected.update((doc_id, i) for i in [*tokenizer.encode(text or "", add_special_tokens=False).ids, packing.CLOSING])
    for doc_id, parts in docs.items():
        found.update((doc_id, i) for _, _, ids in parts for i in ids)
    assert found == expected


def test_packing_prefers_lexical_neighbours():
    texts = [np.array(x, np.uint32) for x in ([5, 6, 7, 8], [90, 91, 92], [5, 6, 7, 9], [93, 94])]
    idf = np.ones(100)
    assert packing.Index(texts, idf, 3.0).neighbours(0, np.array([False, True, True, True])).tolist() == [2]
    order = [p[0] for p in packing.fill(texts, packing.Index(texts, idf, 3.0), 8)]
    assert order[:2] == [0, 2]


def test_word_memory_forgets_without_changing_ids(monkeypatch):
    from tokenizers import Tokenizer

    monkeypatch.setattr(packing, "MEMORY", 4)
    tokens, plain = packing.WordTokens(WORD_BPE), Tokenizer.from_file(WORD_BPE)
    for text in ["The cat, sat's on", "a mat 123 the cat", "Été ça ÉTÉ — “x”", "İstanbul ΣΑΣ a b <|endoftext|>", "the cat the mat", ""]:
        assert tokens.encode([text])[0].tolist() == plain.encode(text, add_special_tokens=False).ids


def test_packing_tokenises_words_without_their_marks(monkeypatch):
    """What is given to the tokenizer's rules does not grow with the marks around words; the ids are the tokenizer's."""
    from tokenizers import Tokenizer

    tokens, plain = packing.WordTokens(WORD_BPE), Tokenizer.from_file(WORD_BPE)

    class Counted:
        given = 0

        def encode_batch_fast(self, texts, **how):
            self.given += len(texts)
            return plain.encode_batch_fast(texts, **how)

    tokens.tokenizer = Counted()
    words = ["".join(chr(97 + i // 26**k % 26) for k in range(4)) + end for i in range(500) for end in ("", "ß", "É")]
    texts = [" ".join(w + mark for w in words) for mark in ("", ",", ".%%%", " 12")] + ["(it's) they'll 'S Ǆ ½x a_b <|x\u00a0y", "", " \t"]
    assert [i.tolist() for i in tokens.encode(texts)] == [plain.encode(t, add_special_tokens=False).ids for t in texts]
    assert tokens.tokenizer.given < 20


def test_packing_empty(nothing):
    assert packing.pack(nothing, WORD_BPE).count() == 0


# --- toxicity


def test_toxicity_on_held_out(spark):
    p = queries.op6_toxicity(spark, "/root/testdata/sf0.1").toPandas().merge(table(spark, "/root/testdata/sf0.1", "labels").toPandas())
    held = p[p["held_out"]]
    clean, toxic = held[held["toxic"] == 0]["predicted"].mean(), held[held["toxic"] == 1]["predicted"].mean()
    assert clean < 0.03 and toxic > 0.5 and p["score"].between(0, 1).all()


def test_toxicity_without_labels(spark, odd, nothing):
    labels = spark.createDataFrame([(1, 0), (None, 1), (2, None)], "doc_id long, toxic int")
    model = toxicity.learn(odd, labels, F.lit(True))
    assert {r[0] for r in odd.select(toxicity.toxicity(model, F.col("text"), spark)).collect()} == {0.0}
    assert nothing.select(toxicity.toxicity(toxicity.learn(nothing, labels, F.lit(True)), F.col("text"), spark)).count() == 0


def test_toxicity_cuts_come_from_all_labelled_texts_not_fitted_on(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "MOST_TOXIC", 60)
    monkeypatch.setattr(toxicity, "MOST_CLEAN", 120)
    monkeypatch.setattr(toxicity, "LONGEST", 400)
    fitted = []
    monkeypatch.setattr(toxicity, "fit", lambda texts, y, fit=toxicity.fit: (fitted.append(len(y)), fit(texts, y))[1])
    docs, labels = (table(spark, "/root/testdata/sf0.1", name) for name in ("documents", "labels"))
    report = toxicity.learn(docs, labels, F.lit(True)).report
    assert report["toxic"].sum() + report["clean"].sum() + fitted[0] == docs.join(labels.where("toxic IS NOT NULL"), "doc_id").count()
    assert report["own_cut"].all() and (report["false_alarms"] < 0.02).all()


def test_one_odd_clean_text_does_not_decide_the_cut():
    z, y = np.r_[np.linspace(-5, -1, 59), 9.0, np.linspace(1, 4, 20)], np.r_[np.zeros(60), np.ones(20)].astype(np.int64)
    assert -1 < toxicity.best_cut(z, y, np.ones(80, np.int64)) < 1


def test_network_gradients_lower_the_loss():
    random = np.random.default_rng(0)
    texts = [random.integers(10, 500, 30).astype(np.int32) for _ in range(200)]
    y = np.arange(200) % 2
    for i in np.flatnonzero(y):
        texts[i][5:7] = (7, 8)
    network = toxicity.Network.started(np.zeros(toxicity.BUCKETS), 0.5)
    for _ in range(30):
        network.train(texts, y.astype(np.float32), 0.02)
    z = network.logits(texts)
    assert z[y == 1].min() > z[y == 0].max()


# --- exact deduplication


@pytest.mark.parametrize("digest_bytes", [32, 1])
def test_exact_dedup_brute_force(spark, odd, tmp_path, digest_bytes):
    path = str(tmp_path / "docs")
    odd.repartition(4).write.parquet(path)
    got = exact_dedup.dedup(spark, path, digest_bytes=digest_bytes, batch_bytes=1)
    groups = {}
    for doc_id, text in texts_of(odd):
        groups.setdefault(text or "", []).append(doc_id)
    expected = sorted(
        ((i, max((x for x in ids if x is not None), default=None), len(ids), hashlib.sha256(t.encode()).hexdigest()) for t, ids in groups.items() for i in ids), key=repr
    )
    assert rows(got, "doc_id", "keep_id", "group_size", "text_sha256") == expected
    kept = got.where("kept").collect()
    assert len(kept) == len(groups) and all(r["doc_id"] == r["keep_id"] for r in kept)


def test_exact_dedup_goes_on_from_its_state(spark, odd, tmp_path):
    path, state = str(tmp_path / "docs"), str(tmp_path / "state")
    odd.where("doc_id = 1").write.parquet(path)
    assert exact_dedup.dedup(spark, path, checkpoint=state).collect()[0]["keep_id"] == 1
    odd.where("doc_id = 2").write.mode("append").parquet(path)
    assert rows(exact_dedup.dedup(spark, path, checkpoint=state), "doc_id", "keep_id", "group_size") == [(1, 2, 2), (2, 2, 2)]


def test_exact_dedup_keeps_columns(odd, nothing):
    out = exact_dedup.drop_copies(odd)
    assert out.columns == odd.columns and out.count() == len({t or "" for _, t in texts_of(odd)})
    assert exact_dedup.drop_copies(nothing).count() == 0


# --- piece encoding


def best_total(vocabulary, word):
    best = [0.0] + [-math.inf] * len(word)
    for i in range(len(word)):
        best[i + 1] = max(best[i + 1], best[i] + vocabulary.fallback) if word[i] not in vocabulary.pieces else best[i + 1]
        for j in range(i + 1, min(len(word), i + vocabulary.longest) + 1):
            if word[i:j] in vocabulary.pieces:
                best[j] = max(best[j], best[i] + vocabulary.pieces[word[i:j]][0])
    return best[-1]


def test_pieces_are_optimal_and_share_prefixes():
    vocabulary = pieces.Vocabulary(PIECE_MODEL, "unigram")
    words = sorted([" the", " there", " thereof", " tok", " tokens", "ünï", " ", "\n", " 漢字か", " ▁x", "aaaaaaaaaaaaaaaaaaaaaaa"])
    byte = set(vocabulary.byte_ids)
    score_of = {i: s for s, i in vocabulary.pieces.values()}
    for word, ids in zip(words, pieces.encode_words(vocabulary, words)):
        assert next(pieces.encode_words(vocabulary, [word])) == ids
        assert b"".join(vocabulary.bytes_of[i] for i in ids).decode() == word
        foreign = sum(1 for c in word if c not in vocabulary.pieces)
        total = sum(score_of[i] for i in ids if i not in byte) + foreign * vocabulary.fallback
        assert total == pytest.approx(best_total(vocabulary, word))


def test_pieces_equal_the_library(spark, monkeypatch):
    model = SentencePieceProcessor(model_file=PIECE_MODEL)
    monkeypatch.setattr(pieces, "PAIRS", 500)  # forgotten pairs are tried again
    monkeypatch.setattr(pieces, "MEMORY", 10_000)
    texts = [r["text"] for r in table(spark, "/root/testdata/sf0.001", "documents").select("text").collect()]
    texts += [
        "", " ", "   ", "a  b", "  a ", " " * 40 + "ﬁ" + " " * 17 + "x", "a" * 1000, "ab" * 5000, "é́ ﬁ ²\t\r\n x \n\n", "<0x0A><s> <unk>", "　x y", "nul\0l",
        "漢字かな交じり文 벨 執", "\n a\n", None, "a  b",
    ]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: r for r in pieces.encode_texts(df, PIECE_MODEL).collect()}
    assert len(got) == len(texts)
    for i, text in enumerate(texts):
        ids = got[i]["ids"] and np.frombuffer(got[i]["ids"], "<u4").tolist()
        assert ids == (None if text is None else model.encode(text)) or (text == "" and not ids), text
        assert got[i]["round_trip"]


@given(st.text(st.sampled_from("aehinrst  \nüß漢#1"), max_size=40))
@settings(max_examples=300, deadline=None)
def test_pieces_of_any_text_equal_the_library(text):
    vocabulary = pieces.vocabulary_of(PIECE_MODEL, "merges")
    model = SentencePieceProcessor(model_file=PIECE_MODEL)
    words = pieces.marked_words(text)
    ids = dict(zip(sorted(set(words)), pieces.encode_words(vocabulary, sorted(set(words)))))
    found = [i for w in words for i in ids[w]]
    assert found == model.encode(text)
    assert pieces.decode(vocabulary, found) == text


def test_pieces_keep_the_mark_itself(spark):
    df = spark.createDataFrame([(1, "a ▁b▁")], "doc_id long, text string")
    encoded = pieces.encode_texts(df, PIECE_MODEL)
    assert [r["text"] for r in pieces.decode_texts(encoded, PIECE_MODEL).collect()] == ["a ▁b▁"]
    with pytest.raises(ValueError):
        pieces.Vocabulary(PIECE_MODEL, "words")


def test_pieces_round_trip(odd, nothing):
    encoded = pieces.encode_texts(odd, PIECE_MODEL)
    assert encoded.where("round_trip").count() == odd.count()
    assert rows(pieces.decode_texts(encoded, PIECE_MODEL), "doc_id", "text") == rows(odd, "doc_id", "text")
    assert pieces.encode_texts(nothing, PIECE_MODEL).count() == 0


# --- license scan

GPL3 = "This work is licensed under the GNU General Public License, version 3."


def test_licenses_of_statements_and_directories(spark):
    data = [
        ("a/LICENSE", "This work is licensed under the MIT License."), ("a/x.txt", "nothing here"), ("a/b/c/y.txt", "still nothing"),
        ("a/b/own.txt", f"some words\n{GPL3}\nmore words"), ("a/d/COPYING", GPL3), ("a/d/e/z.txt", ""), ("top.txt", None), ("f/g.txt", "license"),
        (None, GPL3), ("a/x.txt", "nothing here"),
    ]
    df = spark.createDataFrame([(*d, "c") for d in data], "path string, text string, key string")
    got = rows(licenses.license_scan(df), "path", "license", "origin", "origin_path")
    assert got == sorted(
        [
            ("a/LICENSE", "MIT", "own", None), ("a/x.txt", "MIT", "inherited", "a"), ("a/x.txt", "MIT", "inherited", "a"), ("a/b/c/y.txt", "MIT", "inherited", "a"),
            ("a/b/own.txt", "GPL-3.0", "own", None), ("a/d/COPYING", "GPL-3.0", "own", None), ("a/d/e/z.txt", "GPL-3.0", "inherited", "a/d"),
            ("top.txt", None, None, None), ("f/g.txt", None, None, None), (None, "GPL-3.0", "own", None),
        ],
        key=repr,
    )
    assert licenses.license_scan(df.where("false")).count() == 0


def test_license_cosines_match_brute_force(spark):
    texts = [GPL3, f"{GPL3} And so on", "the general public", "Permission is hereby granted, free of charge, to any person", "version 2 of the license"]
    df = spark.createDataFrame(list(enumerate(texts)), "key long, text string")
    words = [licenses.template_words(t) for t in texts]
    idf = lambda w: math.log((len(texts) + 1) / (sum(w in ws for ws in words) + 1)) + 1
    vector = lambda ws, known: {w: ws.count(w) * (idf(w) if w in known else math.log(len(texts) + 1) + 1) for w in ws}
    known = {w for _, t in licenses.TEMPLATES for w in licenses.template_words(t)}
    norm = lambda v: math.sqrt(sum(x * x for x in v.values()))
    expected = {}
    for i, ws in enumerate(words):
        x = vector(ws, known)
        for name, t in licenses.TEMPLATES:
            y = vector(licenses.template_words(t), known)
            s = round(sum(x[w] * y.get(w, 0) for w in x) / norm(x) / norm(y), 6)
            if s >= licenses.THRESHOLD and s > expected.get(i, ("", 0))[1]:
                expected[i] = (name, s)
    got = {r["key"]: (r["license"], r["score"]) for r in licenses.own_licenses(df).collect()}
    assert {k: v[0] for k, v in got.items()} == {k: v[0] for k, v in expected.items()}
    assert all(got[k][1] == pytest.approx(expected[k][1], abs=2e-6) for k in got)


def test_license_declarations_are_found_and_told_apart(spark):
    known = {
        "Released under the MIT License.": "MIT", "Licensed under the Apache License, Version 2.0.": "Apache-2.0", "Licensed under CC BY-NC 4.0.": "CC-BY-NC-4.0",
        "Released under CC BY-NC-SA 3.0": "CC-BY-NC-SA-3.0", "# SPDX-License-Identifier: MPL-2.0": "MPL-2.0", "// SPDX-License-Identifier: GPL-3.0-or-later": "GPL-3.0",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.": "CC-BY-NC-4.0", GPL3: "GPL-3.0",
        "Licensed under the GNU Lesser General Public License, version 2.1": "LGPL-2.1", "Released under the GPLv2": "GPL-2.0",
        "Released under the Foo License.": None, "SPDX-License-Identifier: Foo-1.0": None, "This work is licensed under the Foo License.": None,
    }
    text = "word " * 50 + "\n%s\n" + "other " * 50
    df = spark.createDataFrame([(i, text % line) for i, line in enumerate(known)], "key long, text string")
    got = {r["key"]: r["license"] for r in licenses.own_licenses(df).collect()}
    assert [got.get(i) for i in range(len(known))] == list(known.values())


def test_license_lines_of_the_tables_are_all_found(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents").select(F.col("doc_id").alias("key"), "text")
    lines = docs.select("key", F.explode(F.split("text", "\n")).alias("line")).where(r"lower(line) rlike 'licen[cs]e|spdx|\\bcc by|copyright'")
    stated = {r["key"] for r in lines.collect()}
    assert stated and {r["key"] for r in licenses.own_licenses(docs).collect()} == stated


# --- near deduplication


def brute_components(texts):
    sets = []
    for _, text in texts:
        w = (text or "").encode().lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))} if w else set())
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(range(len(texts)), 2):
        common = len(sets[i] & sets[j])
        if common and 100 * common >= 75 * (len(sets[i]) + len(sets[j]) - common):
            root[max(find(i), find(j))] = min(find(i), find(j))
    groups = {}
    for i in range(len(texts)):
        groups.setdefault(find(i), []).append(texts[i][0])
    out = []
    for i, (doc_id, _) in enumerate(texts):
        known = [x for x in groups[find(i)] if x is not None]
        out.append((doc_id, len(sets[i]), min(known) if known and sets[i] else doc_id))
    return sorted(out, key=repr)


def test_near_dedup_brute_force(odd, nothing):
    assert rows(near_dedup.near_duplicates(odd), "doc_id", "n_shingles", "component_id") == brute_components(texts_of(odd))
    assert near_dedup.near_duplicates(nothing).count() == 0


def test_near_dedup_chains_in_one_bucket(spark):
    """Each text is near its neighbours only; stars alone would not join the chain."""
    words = [f"v{i}" for i in range(400)]
    data = [(k, " ".join(words[6 * k : 6 * k + 110])) for k in range(30)] + [(100 + k, " ".join(words[::-1][:60]) + f" z{k}") for k in range(20)]
    df = spark.createDataFrame(data, "doc_id long, text string")
    assert rows(near_dedup.near_duplicates(df), "doc_id", "n_shingles", "component_id") == brute_components(data)


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (103, 101)], "a int, b int")
    got = dict(rows(near_dedup.components(links), "node", "root"))
    assert got == {i: 0 for i in range(61)} | {100: 100, 101: 100, 103: 100}


# --- pipeline


def test_pipeline_stages_brute_force(spark, odd):
    sf = "/root/testdata/sf0.001"
    docs = table(spark, sf, "documents")
    extra = docs.withColumn("at", F.lit(1)).withColumn("score", F.lit("s"))
    assert len(corpus_pipeline.STAGES) == 5
    toxic = corpus_pipeline.toxicity_stage(spark, extra, sf)
    assert toxic.columns == extra.columns and toxic.count() > 0.8 * docs.count()
    good = corpus_pipeline.quality_stage(spark, odd, sf)
    assert good.columns == odd.columns
    assert {r["text"] for r in good.collect()} == {t for _, t in texts_of(odd) if not any(quality.Measured(t).rejected(x) for x in quality.RULES)}
    near = corpus_pipeline.near_dedup_stage(spark, docs, sf)
    assert near.columns == docs.columns
    expected = {i for i, _, c in brute_components(texts_of(docs)) if i == c}
    assert {r["doc_id"] for r in near.collect()} == expected
    assert corpus_pipeline.run(spark, sf).select("doc_id").distinct().count() > 0


def test_near_dedup_stage_drops_rows_not_ids(spark):
    a, b, c = (" ".join(f"{k}{i}" for i in range(60)) for k in "abc")
    data = [(1, a), (2, a + " tail"), (2, b), (None, c), (None, c + " tail"), (4, b + " more"), (5, None), (5, None)]
    df = spark.createDataFrame(data, "doc_id long, text string")
    assert rows(corpus_pipeline.near_dedup_stage(spark, df, ""), "doc_id", "text")[:2] == [(1, a), (2, b)]
    left = [(r["doc_id"], (r["text"] or "-")[0]) for r in corpus_pipeline.near_dedup_stage(spark, df, "").collect()]
    assert sorted(left, key=repr) == sorted([(1, "a"), (2, "b"), (None, "c"), (5, "-"), (5, "-")], key=repr)


def test_pipeline_on_nothing(spark, nothing):
    docs = nothing
    for _, stage in corpus_pipeline.STAGES[1:]:
        out = stage(spark, docs, "/root/testdata/sf0.001")
        assert out.count() == 0
        docs = out if "text" in out.columns else docs
