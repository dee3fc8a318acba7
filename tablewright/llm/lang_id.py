"""Language identification: averaged hashed subword embeddings and a linear softmax, trained with numpy.

A text becomes the shares of its hashed byte 1- to 4-grams (lower case); their average embedding goes through a linear
softmax. Training is plain stochastic gradient descent with per-weight step sizes, on each text as a whole and on short
pieces of it. It starts on a bounded sample (about ``PER_LANGUAGE`` documents of each language and ``MOST_ROWS`` in all,
those with the smallest hashes) and goes on over all labelled rows: in each of ``ROUNDS`` every task descends over its rows
from the shared weights and step sizes, and the outcomes are averaged by the number of pieces. A fifth of all rows, chosen by
hash, calibrates instead: counts of it give one temperature for the scores, and for each language the score below which a
prediction is rejected because fewer than ``PRECISION`` of those above would be right (in steps of 1 / ``STEPS``).
Every language that a row is labelled with is learned.

Cases: a text that is NULL or holds no letter is "und" with score 0 and rejected; with no labelled row every text is;
repeated rows get the same answer; labels of one language only give that language; other columns stay untouched.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.llm.common import own_names, prepare

PER_LANGUAGE = 300
MOST_ROWS = 2000
BITS = 11
BUCKETS = 1 << BITS
GRAMS = (1, 2, 3, 4)
DIMENSIONS = 16
EPOCHS = 12
PIECES = (12, 40, 150)  # characters of the short pieces
PRECISION = 0.99
ROUNDS = 2  # over all rows, after the start
HELD = 1024  # pieces of a task worked on at once
TEMPERATURES = np.geomspace(0.2, 5, 30)
STEPS = 1000  # of a score
MERGED = 16  # tasks that add up what others found
UNKNOWN = "und"

ANSWER = "language string, score double, accepted boolean"


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def grams(text: str) -> np.ndarray:
    """Shares of the hashed byte n-grams of a text."""
    data = np.frombuffer(f" {' '.join(text.lower().split())} ".encode(), np.uint8).astype(np.uint32)
    places = np.empty(sum(max(len(data) - n + 1, 0) for n in GRAMS), np.int64)
    key, at = np.zeros(len(data), np.uint32), 0
    for n in GRAMS:
        if len(data) < n:
            break
        key = key[: len(data) - n + 1] * np.uint32(0x01000193)
        key ^= data[n - 1 :]
        place = key + np.uint32(n)
        place *= np.uint32(2654435761)
        place >>= np.uint32(32 - BITS)
        places[at : at + len(place)] = place
        at += len(place)
    counts = np.bincount(places, minlength=BUCKETS).astype(np.float32)  # one dense vector of BUCKETS numbers per text, whatever its length
    return counts / max(counts.sum(), 1)


def pieces(text: str, seed: int) -> list[str]:
    random = np.random.default_rng(seed)
    cut = [text]
    for size in PIECES:
        if len(text) > 2 * size:
            start = int(random.integers(0, len(text) - size))
            cut.append(text[start : start + size])
    return [c for c in cut if has_letter(c)]


def featured(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for label, text, key in zip(batch["label"], batch["text"], batch["key"]):
            rows += [(label, int(key), grams(p).tobytes()) for p in pieces(text, int(key) & 0xFFFFFFFF)]
        yield pd.DataFrame(rows, columns=["label", "key", "x"])


@dataclass
class Model:
    labels: list[str]
    table: np.ndarray  # log odds per bucket: embedding times softmax weights
    bias: np.ndarray
    temperature: float
    least: np.ndarray

    def logits(self, x: np.ndarray) -> np.ndarray:
        return (x @ self.table + self.bias) / self.temperature

    def predict(self, texts: list[str | None]) -> list[tuple[str, float, bool]]:
        out = []
        for text in texts:
            if text is None or not self.labels or not has_letter(text):
                out.append((UNKNOWN, 0.0, False))
                continue
            p = softmax(self.logits(grams(text)[None]))[0]
            i = int(p.argmax())
            out.append((self.labels[i], float(p[i]), bool(p[i] >= self.least[i])))
        return out


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


@dataclass
class Weights:
    """What is descended: embeddings, softmax weights and bias, each with the sums of its squared steps."""

    parts: list[np.ndarray]

    @classmethod
    def fresh(cls, languages: int) -> Weights:
        random = np.random.default_rng(7)
        embed = random.normal(0, 0.1, (BUCKETS, DIMENSIONS)).astype(np.float32)
        weight = random.normal(0, 0.1, (DIMENSIONS, languages)).astype(np.float32)
        values = [embed, weight, np.zeros(languages, np.float32)]
        return cls([*values, *[np.full_like(p, 1e-8) for p in values]])

    def copy(self) -> Weights:
        return Weights([p.copy() for p in self.parts])

    def descend(self, x: np.ndarray, y: np.ndarray, random: np.random.Generator) -> None:
        """One pass over the rows, in random order."""
        embed, weight, bias = self.parts[:3]
        target = np.eye(len(bias), dtype=np.float32)
        for part in np.array_split(random.permutation(len(y)), max(1, len(y) // 64)):
            hidden = x[part] @ embed
            wrong = (softmax(hidden @ weight + bias) - target[y[part]]) / len(part)
            steps = (x[part].T @ (wrong @ weight.T), hidden.T @ wrong, wrong.sum(axis=0))
            for p, g, s in zip(self.parts[:3], steps, self.parts[3:]):
                s += g * g
                p -= 0.3 * g / np.sqrt(s)

    def flat(self) -> np.ndarray:
        return np.concatenate([p.ravel() for p in self.parts]).astype(np.float64)

    def like(self, flat: np.ndarray) -> Weights:
        ends = np.cumsum([p.size for p in self.parts])[:-1]
        return Weights([f.reshape(p.shape).astype(np.float32) for f, p in zip(np.split(flat, ends), self.parts)])


def held_out(key: np.ndarray) -> np.ndarray:
    return key // 1_000_003 % 5 == 0


def gathered(batches: Iterator[pd.DataFrame], place: dict[str, int], calibration: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Features and label numbers of the pieces of a task's rows, at least HELD pieces at once but for the last."""
    x, y = [], []
    for batch in batches:
        for label, text, key in zip(batch["label"], batch["text"], batch["key"]):
            if (int(key) // 1_000_003 % 5 == 0) == calibration:
                cut = pieces(text, int(key) & 0xFFFFFFFF)
                x += map(grams, cut)
                y += [place[label]] * len(cut)
            if len(y) >= HELD:
                yield np.stack(x), np.array(y)
                x, y = [], []
    if y:
        yield np.stack(x), np.array(y)


def added(rows: DataFrame, work: Callable[[Iterator[pd.DataFrame]], np.ndarray | None]) -> np.ndarray | None:
    """The sum over all tasks of the array that each makes of its rows; a few tasks add up before the driver does."""

    def one(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found = work(batches)
        if found is not None:
            yield pd.DataFrame({"sum": [found.astype(np.float64).tobytes()]})

    def several(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = None
        for batch in batches:
            for data in batch["sum"]:
                total = np.frombuffer(data) + (0 if total is None else total)
        if total is not None:
            yield pd.DataFrame({"sum": [total.tobytes()]})

    sums = rows.mapInPandas(one, "sum binary").repartition(MERGED).mapInPandas(several, "sum binary")
    found = [np.frombuffer(r["sum"]) for r in sums.collect()]
    return sum(found[1:], found[0]) if found else None


def refined(rows: DataFrame, start: Weights, place: dict[str, int], number: int) -> Weights:
    """A pass over all rows: each task descends from the same start, and the outcomes are averaged by their pieces."""
    shared = rows.sparkSession.sparkContext.broadcast(start)

    def work(batches: Iterator[pd.DataFrame]) -> np.ndarray | None:
        own, random, n = shared.value.copy(), np.random.default_rng(number), 0
        for x, y in gathered(batches, place, False):
            own.descend(x, y, random)
            n += len(y)
        return np.append(own.flat() * n, n) if n else None

    total = added(rows, work)
    return start if total is None else start.like(total[:-1] / total[-1])


def calibrated(rows: DataFrame, model: Model, place: dict[str, int]) -> Model:
    """Temperature from the loss over all rows held out, then least scores from counts over them: per language and step of
    the score how often it was said and how often that was right."""
    context, languages = rows.sparkSession.sparkContext, len(model.labels)
    shared = context.broadcast(model)

    def losses(batches: Iterator[pd.DataFrame]) -> np.ndarray | None:
        loss, seen = np.zeros(len(TEMPERATURES)), False
        for x, y in gathered(batches, place, True):
            seen, raw = True, shared.value.logits(x)
            loss -= [np.log(softmax(raw / t)[np.arange(len(y)), y] + 1e-12).sum() for t in TEMPERATURES]
        return loss if seen else None

    loss = added(rows, losses)
    if loss is None:
        return model
    model.temperature = float(TEMPERATURES[int(np.argmin(loss))])
    tempered = context.broadcast(model)

    def answers(batches: Iterator[pd.DataFrame]) -> np.ndarray:
        counts = np.zeros((2, languages, STEPS + 1))
        for x, y in gathered(batches, place, True):
            p = softmax(tempered.value.logits(x))
            said, step = p.argmax(axis=1), np.floor(p.max(axis=1) * STEPS).astype(int)
            np.add.at(counts[0], (said, step), 1)
            np.add.at(counts[1], (said, step), said == y)
        return counts.ravel()

    said, right = added(rows, answers).reshape(2, languages, STEPS + 1)
    for i in range(languages):
        n, good = np.cumsum(said[i][::-1])[::-1], np.cumsum(right[i][::-1])[::-1]
        reached = np.flatnonzero((said[i] > 0) & (good >= PRECISION * n))
        model.least[i] = reached[0] / STEPS if len(reached) else 0.0
    return model


def learn(training: DataFrame, text: str = "text", lang: str = "lang") -> Model:
    """A model from the labelled rows of a table."""
    prepare(training.sparkSession)
    rows = own_names(training, text=text, label=lang).where("text IS NOT NULL AND label IS NOT NULL")
    key = F.xxhash64("text", "label")
    found = rows.groupBy("label").count().collect()
    if not found:
        return Model([], np.zeros((BUCKETS, 0)), np.zeros(0), 1.0, np.zeros(0))
    share = F.create_map(*[e for r in found for e in (F.lit(r["label"]), F.lit(min(1.0, PER_LANGUAGE / r["count"])))])
    part = F.pmod(key, F.lit(1_000_003)) / F.lit(1_000_003.0)
    keyed = rows.select("label", "text", key.alias("key"))
    first = keyed.where(part < share[F.col("label")]).orderBy("key", "label").limit(MOST_ROWS)
    data = first.mapInPandas(featured, "label string, key long, x binary").toPandas().sort_values(["key", "label"])
    labels = sorted(r["label"] for r in found)
    place = {label: i for i, label in enumerate(labels)}
    weights = Weights.fresh(len(labels))
    fitted = data[~held_out(data["key"].to_numpy(np.int64))]
    if len(fitted):
        x = np.frombuffer(b"".join(fitted["x"]), np.float32).reshape(-1, BUCKETS)
        y, random = fitted["label"].map(place).to_numpy(), np.random.default_rng(11)
        for _ in range(EPOCHS):
            weights.descend(x, y, random)
    for number in range(ROUNDS):
        weights = refined(keyed, weights, place, number)
    embed, weight, bias = weights.parts[:3]
    return calibrated(keyed, Model(labels, embed @ weight, bias, 1.0, np.zeros(len(labels))), place)


def identify(model: Model, text: Column, spark) -> Column:
    """A struct column (language, score, accepted) from the text alone."""
    prepare(spark)
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf(ANSWER)
    def answer(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame(shared.value.predict(list(batch)), columns=["language", "score", "accepted"])

    return answer(text)
