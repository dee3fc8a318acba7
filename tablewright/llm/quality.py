"""Quality rules as a short-circuit cascade.

Each rule reads some measures of a text and rejects on them. On a bounded sample the cost of computing each rule's
measures and its selectivity are estimated; rules then run by rejection per cost, and a text that one rule rejects is
never given to the next. The order changes the time, never the verdict, which is that of all rules together.

Words are runs of other characters than ASCII white space, in the text as it stands. Cases: NULL and empty texts have
no words and are rejected by the length rule; repeated rows get the same verdict; an empty table gives an empty table;
other columns stay untouched (only the text reaches Python).
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.llm.common import prepare

SAMPLE_ROWS = 1000
WINDOW = 8
SYMBOLS = str.maketrans("", "", "#*$%&|<>")
ASCII_SPACE = " \t\n\x0b\x0c\r"
TO_SPACE = str.maketrans({c: " " for c in ASCII_SPACE})
MULTIPLIERS = np.array([pow(0x9E3779B97F4A7C15, i + 1, 1 << 64) for i in range(WINDOW)], np.uint64)


class Text:
    """A text with its words, cut once when first asked for."""

    def __init__(self, text: str | None):
        self.text = text or ""
        self._words: list[str] | None = None

    @property
    def words(self) -> list[str]:
        if self._words is None:
            self._words = [w for w in self.text.translate(TO_SPACE).split(" ") if w]
        return self._words


def word_count(t: Text) -> int:
    return len(t.words)


def word_chars(t: Text) -> int:
    return sum(map(len, t.words))


def symbol_count(t: Text) -> int:
    return len(t.text) - len(t.text.translate(SYMBOLS))


def duplicate_lines(t: Text) -> int:
    """Lines with a word that equal an earlier line."""
    lines = [x for x in t.text.split("\n") if x.strip(ASCII_SPACE)]
    return len(lines) - len(set(lines))


def repeated_words(t: Text) -> int:
    """Words inside windows of WINDOW words that occur twice or more in the text."""
    words = t.words
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    place: dict[str, int] = {}
    number = np.array([place.setdefault(w, len(place)) for w in words], np.uint64) + np.uint64(1)
    key = np.zeros(n, np.uint64)
    for j in range(WINDOW):
        key += number[j : j + n] * MULTIPLIERS[j]
        key ^= key >> np.uint64(29)
    order = np.argsort(key, kind="stable")
    ranked = key[order]
    same = ranked[1:] == ranked[:-1]
    twice = np.zeros(n, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    edge = np.zeros(len(words) + 1, np.int64)
    at = np.flatnonzero(twice)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + WINDOW, -1)
    return int((np.cumsum(edge[:-1]) > 0).sum())


def line_count(t: Text) -> int:
    return sum(1 for x in t.text.split("\n") if x.strip(ASCII_SPACE))


def shouted_words(t: Text) -> int:
    """Words of two letters or more without a small letter."""
    return sum(1 for w in t.words if w.isupper() and len(w) > 1)


MEASURES: dict[str, Callable[[Text], int]] = {
    "n_words": word_count,
    "word_chars": word_chars,
    "n_symbols": symbol_count,
    "n_dup_lines": duplicate_lines,
    "n_repeat_words": repeated_words,
    "n_lines": line_count,
    "n_shouted": shouted_words,
}


@dataclass(frozen=True)
class Rule:
    """``rejects`` gets the named measures in their order."""

    name: str
    needs: tuple[str, ...]
    rejects: Callable[..., bool]


#: Fixed values of the production rules.
RULES = (
    Rule("too_short", ("n_words",), lambda n: n < 20),
    Rule("repetitive", ("n_words", "n_repeat_words"), lambda n, r: 100 * r > 30 * n),
    Rule("symbols", ("n_words", "n_symbols"), lambda n, s: 2 * s > n),
    Rule("duplicate_lines", ("n_lines", "n_dup_lines"), lambda n, d: 100 * d > 40 * n),
    Rule("word_length", ("n_words", "word_chars"), lambda n, c: c < 2 * n or c > 20 * n),
    Rule("shouting", ("n_words", "n_shouted"), lambda n, u: 100 * u > 60 * n),
)


class Measured:
    """Measures of one text, each computed at most once."""

    def __init__(self, text: str | None):
        self.text = Text(text)
        self.values: dict[str, int] = {}

    def get(self, name: str) -> int:
        if name not in self.values:
            self.values[name] = MEASURES[name](self.text)
        return self.values[name]

    def rejected(self, rule: Rule) -> bool:
        return bool(rule.rejects(*[self.get(m) for m in rule.needs]))


def estimate(texts: Sequence[str | None], rules: Sequence[Rule]) -> list[tuple[Rule, float, float]]:
    """(rule, seconds per text with nothing shared, share rejected) from a sample."""
    found = []
    for rule in rules:
        started = time.perf_counter()
        hits = sum(Measured(t).rejected(rule) for t in texts)
        found.append((rule, max((time.perf_counter() - started) / max(len(texts), 1), 1e-9), hits / max(len(texts), 1)))
    return found


def ordered(estimates: Sequence[tuple[Rule, float, float]]) -> list[Rule]:
    """Rules by rejection per cost, the cheaper first where nothing is rejected."""
    return [e[0] for e in sorted(estimates, key=lambda e: (-e[2] / e[1], e[1]))]


def sample_texts(docs: DataFrame, text: str, rows: int) -> list[str | None]:
    """About ``rows`` texts chosen by hash, at most twice as many."""
    texts = docs.select(F.col(f"`{text}`").alias("text"))
    share = int(rows / max(texts.count(), rows) * 1_000_003)
    return [r["text"] for r in texts.where(F.pmod(F.xxhash64("text"), F.lit(1_000_003)) <= share).limit(2 * rows).collect()]


VERDICT = T.StructType(
    [
        T.StructField("kept", T.BooleanType()),
        T.StructField("rejected_by", T.StringType()),
        T.StructField("rules_run", T.LongType()),
        *[T.StructField(m, T.LongType()) for m in MEASURES],
    ]
)


def cascade(docs: DataFrame, text: str = "text", rules: Sequence[Rule] = RULES, measure_all: bool = False, sample: int = SAMPLE_ROWS) -> Column:
    """A struct column: kept, the rule that rejected, rules run, and the measures computed on the way.

    ``measure_all`` fills in, after the verdict, the measures that the short circuit left out (NULL otherwise).
    """
    prepare(docs.sparkSession)
    order = ordered(estimate(sample_texts(docs, text, sample), rules))

    @F.pandas_udf(VERDICT)
    def judge(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for value in batch:
                measured, by, run = Measured(value), None, 0
                for rule in order:
                    run += 1
                    if measured.rejected(rule):
                        by = rule.name
                        break
                if measure_all:
                    for name in MEASURES:
                        measured.get(name)
                rows.append((by is None, by, run, *[measured.values.get(m) for m in MEASURES]))
            frame = pd.DataFrame(rows, columns=VERDICT.fieldNames())
            yield frame.astype({m: "Int64" for m in MEASURES})

    return judge(F.col(f"`{text}`"))
