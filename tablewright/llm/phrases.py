"""Collocations: phrases of two to five words that stand together more often than their parts would by chance.

Filtered counting. A first reading adds the count of every phrase to a cell of an array of bounded size, told by the phrase's
hash; a task has one array for all that it reads, and the arrays of the tasks are added up. A cell holds no less than each of
its phrases occurs, so phrases of a cell below the support are struck out. The second reading counts what is left, by words:
counts are exact, and a phrase let through for the others in its cell only costs a row. A phrase is let through only where the
shorter ones at its start and its end are. Cells are in proportion to the words of the table; beyond ``FILTER_BITS`` of them
the first reading takes fewer lengths at a time, one after the other, and leaves out phrases whose parts were struck out.

Texts have A-Z lowered and are cut at ``. , ; : ! ?`` and line ends into pieces, those at blanks and tabs into words. A phrase
does not reach over pieces. NULL and empty texts hold no words; a NULL language is ``und``; repeated rows count each time;
ties in the ranking go by count, then by the bytes of the phrase; an empty table has no phrases; other columns are ignored. A
very long text is read piece by piece, so one piece must fit into a task's memory, a text need not.

All lengths are read at once up to 2 billion words at a support of 100, one at a time from 5 billion; beyond 10 billion
(``FILTER_BITS`` * least * 3 / 4) cells fill up with rare phrases, and more and more are counted that turn out rare.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Callable, Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from tablewright.llm.common import own_names, prepare, stored

LONGEST = 5
#: Words in a shard, on average; small splits are joined up to it, and half as many again end a shard (memory of a task).
SHARD_WORDS = 3_000_000
#: Phrases a task adds up before it hands them on.
HELD = 1_000_000
#: Tasks for each core in the readings that add up and count.
WAVES = 2
#: Languages of which a task holds the word totals before it hands them on.
LANGUAGES = 10_000
#: Phrases handed on at once.
GIVEN = 100_000
#: Cells of the filter over phrases that may be frequent, at most; a task holds a count in each, of one byte up to a support of 255.
FILTER_BITS = 1 << 27
#: Cells handed on at once.
BLOCK = 1 << 16

BREAK = b"."  # stands between pieces; no word holds it
_CUT = bytes.maketrans(b",;:!?\x0a\x0b\x0c\x0d\t", b"......... ")
_BLANK = bytes.maketrans(b".,;:!?\x0a\x0b\x0c\x0d\t", b" " * 11)
_SLICE = 1 << 20  # bytes of a text cut at once


WORDS = {"lang": pa.string(), "n": pa.int64()}
SKETCHED = {"block": pa.int32(), "cells": pa.binary()}
MARKED = {"block": pa.int32(), "bits": pa.binary()}
COUNTED = {"lang": pa.string(), "phrase": pa.string(), "words": pa.int32(), "n": pa.int64()}


def of(columns: dict[str, pa.DataType], *values) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, columns.values())], names=list(columns))


def slices(text: str) -> Iterator[bytes]:
    """The text in lower case with one mark between pieces, a very long one in parts that end with a piece."""
    data = text.encode().lower().translate(_CUT)
    start = 0
    while start < len(data):
        end = data.find(BREAK, start + _SLICE)
        end = len(data) if end < 0 else end
        yield data[start:end]
        start = end


class Shard:
    """The words of a number of texts, as numbers; 0 is the end of a piece."""

    def __init__(self) -> None:
        self.size = 0
        self.number: dict[str, defaultdict[bytes, int]] = {}
        self.parts: dict[str, list[np.ndarray]] = {}

    def add(self, lang: str, text: str) -> None:
        if lang not in self.number:
            self.number[lang] = defaultdict(count(1).__next__, {BREAK: 0})
            self.parts[lang] = []
        for data in slices(text):
            words = data.replace(BREAK, b" . ").split()
            self.parts[lang].append(np.fromiter(map(self.number[lang].__getitem__, words), np.int32, len(words)))
            self.parts[lang].append(np.zeros(1, np.int32))
            self.size += len(words)

    def languages(self) -> Iterator[tuple[str, list[bytes], np.ndarray]]:
        for lang in list(self.number):
            words = list(self.number.pop(lang))
            yield lang, words, np.concatenate(self.parts.pop(lang) or [np.zeros(0, np.int32)])


def shards(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[Shard]:
    shard = Shard()
    for batch in batches:
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
            shard.add(lang, text)
            if 2 * shard.size >= 3 * size:
                yield shard
                shard = Shard()
    yield shard


def lengths(
    codes: np.ndarray, hashes: np.ndarray, lang: str, cells: int, marks: np.ndarray, known: int
) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For 1, 2, ... words: whether a phrase that may be frequent begins at each place, and the cells of those that do.

    The marks tell phrases of up to ``known`` words; a longer one may be frequent where both parts of one word less may be.
    """
    single, mask = hashes[codes], np.uint64(cells - 1)
    h, ok = np.full(len(codes), np.uint64(xxh3_64_intdigest(lang.encode()))), codes > 0
    for k in range(1, LONGEST + 1):
        if k > 1:
            h, ok = h[:-1], ok[:-1] & ok[1:]
        h = (h ^ single[k - 1 :]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
        at = (h[ok] & mask).astype(np.uint32)
        if k <= known:
            through = (marks[at >> 3] >> (at & 7).astype(np.uint8)) & 1 > 0
            ok[ok] = through
            at = at[through]
        if not len(at):
            return
        yield k, ok, at


def phrases_of(places: Iterator[tuple[int, np.ndarray, np.ndarray]], codes: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Phrases of 1, 2, ... words that begin at the given places as (words, a place of each, its count)."""
    held, size = codes.astype(np.int64), 0
    for k, ok, _ in places:
        at = np.flatnonzero(ok)
        _, first, inverse, counts = np.unique(
            held[at] if k == 1 else held[at] * size + held[at + 1], return_index=True, return_inverse=True, return_counts=True
        )
        yield k, at[first], counts
        held[at], size = inverse, len(first)


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxh3_64_intdigest, words), np.uint64, len(words))


def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    totals: dict[str, int] = defaultdict(int)
    for batch in batches:
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
            totals[lang] += sum(len(data.translate(_BLANK).split()) for data in slices(text))
        if len(totals) > LANGUAGES:
            yield of(WORDS, list(totals), list(totals.values()))
            totals.clear()
    yield of(WORDS, list(totals), list(totals.values()))


def sketcher(marks: Broadcast, cells: int, low: int, high: int, least: int, size: int) -> Callable:
    """Occurrences of phrases of ``low`` to ``high`` words in every cell, ``least`` at most, in blocks."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(cells, np.min_scalar_type(least))
        for shard in shards(batches, size):
            for lang, words, codes in shard.languages():
                for k, _, at in lengths(codes, word_hashes(words), lang, cells, marks.value, low - 1):
                    if k >= low:
                        at.sort()
                        first = np.flatnonzero(np.diff(at, prepend=~at[:1]))
                        counts = np.diff(first, append=len(at))
                        held[at[first]] = np.minimum(held[at[first]] + counts, least)
                    if k == high:
                        break
        for i in range(0, cells, BLOCK):
            part = held[i : i + BLOCK]
            if part.any():
                yield of(SKETCHED, [i // BLOCK], [part.tobytes()])

    return sketch


def summed(least: int) -> Callable:
    """The cells of a block that reach the support, added up over the tasks, as bits."""

    def add(blocks: pa.Table) -> pa.Table:
        parts = [np.frombuffer(c.as_buffer(), np.min_scalar_type(least)) for c in blocks.column("cells")]
        total = np.zeros(len(parts[0]), np.int64)
        for part in parts:
            total += part
        bits = np.packbits(total >= least, bitorder="little")
        return pa.Table.from_batches([of(MARKED, [blocks.column("block")[0].as_py()], [bits.tobytes()])])

    return add


def counter(marks: Broadcast, size: int) -> Callable:
    """Counts of the phrases in the filter, by their words."""

    def given(held: dict[str, dict[bytes, int]]) -> Iterator[pa.RecordBatch]:
        for lang in list(held):
            found = held.pop(lang)
            phrases = list(found)
            for i in range(0, len(phrases), GIVEN):
                part = phrases[i : i + GIVEN]
                yield of(COUNTED, [lang] * len(part), [p.decode() for p in part], [p.count(b" ") + 1 for p in part], [found[p] for p in part])

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, dict[bytes, int]] = defaultdict(lambda: defaultdict(int))
        for shard in shards(batches, size):
            for lang, words, codes in shard.languages():
                own = held[lang]
                places = lengths(codes, word_hashes(words), lang, 8 * len(marks.value), marks.value, LONGEST)
                for k, first, counts in phrases_of(places, codes):
                    for p, n in zip(first.tolist(), counts.tolist()):
                        own[b" ".join([words[c] for c in codes[p : p + k].tolist()])] += n
                if sum(map(len, held.values())) >= HELD:
                    yield from given(held)
        yield from given(held)

    return tally


def marked(texts: DataFrame, total: int, least: int, size: int) -> np.ndarray:
    """A bit for each cell that the phrases of the texts, of ``total`` words, bring to the support."""
    spark = texts.sparkSession
    cells = min(FILTER_BITS, 1 << max(10, math.ceil(math.log2(4 * LONGEST * total / least + 1))))
    at_once = max(1, min(LONGEST, 3 * cells * least // (4 * max(total, 1))))  # below the support in a cell on average
    marks = np.zeros(cells // 8, np.uint8)
    for low in range(1, LONGEST + 1, at_once):
        known = spark.sparkContext.broadcast(marks.copy())
        cut = sketcher(known, cells, low, min(low + at_once - 1, LONGEST), least, size)
        sketched = texts.mapInArrow(cut, "block int, cells binary")
        for block, bits in sketched.groupBy("block").applyInArrow(summed(least), "block int, bits binary").collect():
            start = block * BLOCK // 8
            marks[start : start + len(bits)] |= np.frombuffer(bits, np.uint8)
    return marks


def phrase_counts(docs: DataFrame, least: int = 100, shard_words: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, words, n) of all phrases of one to five words found ``least`` times, and (lang, n) of all words."""
    spark = docs.sparkSession
    prepare(spark)
    size = shard_words or SHARD_WORDS
    texts = own_names(docs, lang="lang", text="text").where("text IS NOT NULL")
    texts = texts.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), "text")
    totals = texts.mapInArrow(count_words, "lang string, n long").groupBy("lang").agg(F.sum("n").alias("n"))
    totals = stored(totals.where("n > 0"), "phrase-words")
    total = totals.agg(F.sum("n")).first()[0] or 0
    # Small splits join into one shard, without a shuffle. A task adds up the shards that it reads one after the other, so that
    # a phrase gives a row for each task, not for each shard.
    few = texts.coalesce(max(1, min(math.ceil(total / size), WAVES * spark.sparkContext.defaultParallelism)))
    marks = spark.sparkContext.broadcast(marked(few, total, least, size))
    tallied = few.mapInArrow(counter(marks, size), "lang string, phrase string, words int, n long")
    counts = tallied.groupBy("lang", "phrase", "words").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    return stored(counts, "phrase-counts"), totals


def collocations(
    docs: DataFrame, least: int = 100, within: int = 100, top: int = 2000, shard_words: int | None = None, spread: int = 64
) -> DataFrame:
    """The best ``top`` phrases of each language: lang, rank, phrase, a, l, r, n, score.

    The score of a phrase is that of its worst cut into two parts, floor(1000 * a * n / (l * r)). A phrase goes if one longer phrase
    holds ``within`` of a hundred of its occurrences, whether that one stays or not.
    """
    counts, totals = phrase_counts(docs, least, shard_words)
    longer = counts.where("words >= 2").withColumn("cut", F.split("phrase", " "))
    piece = lambda start, length: F.array_join(F.slice("cut", start, length), " ")
    k = F.col("words")
    cuts = longer.select("lang", "phrase", F.col("n").alias("a"), "words", "cut", F.explode(F.sequence(F.lit(1), k - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", piece(F.lit(1), F.col("k")).alias("first"), piece(F.col("k") + 1, k).alias("rest"))
    part = lambda name, size: counts.select("lang", F.col("phrase").alias(name), F.col("n").alias(size))
    cuts = cuts.join(part("first", "l"), ["lang", "first"]).join(part("rest", "r"), ["lang", "rest"]).join(totals, "lang")
    score = F.expr("(CAST(1000 * a AS DECIMAL(38, 0)) * CAST(n AS DECIMAL(38, 0))) DIV (CAST(l AS DECIMAL(38, 0)) * CAST(r AS DECIMAL(38, 0)))")
    worst = cuts.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("w"))
    # What lies in a longer phrase often enough also lies in one that is longer by a single word.
    ends = longer.where("words >= 3").select(
        "lang", F.col("n").alias("longer"), F.explode(F.array(piece(F.lit(1), k - 1), piece(F.lit(2), k - 1))).alias("phrase")
    )
    held = ends.groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    free = worst.join(held, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (100 * F.col("longer") < within * F.col("a")))
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    found = free.select("lang", "phrase", "a", "w.l", "w.r", "n", "w.score").withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(spread)))
    best = found.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).where(F.col("rank") <= top)
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long"))
    return ranked.where(F.col("rank") <= top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
