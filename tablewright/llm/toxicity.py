"""Toxicity: a convolutional text classifier in numpy with thresholds calibrated by language.

Lower-cased words are hashed to embeddings, each the sum of that of the word and that of its first ``STEM`` letters, which
inflected forms share; filters of one, two and three words slide over the whole text, each filter keeps its largest
response, and a linear layer gives the logit. The first embedding dimension starts as the smoothed
log odds of a bucket between the classes, so that rare tell-tale words are seen from the start; everything is then
trained by stochastic gradient descent (Adam). Weights are fitted on a bounded sample chosen by hash: four fifths of
about ``MOST_TOXIC`` and ``MOST_CLEAN`` labelled texts of at most ``LONGEST`` words. All other labelled texts of the
training rows, of any length, calibrate: they are scored in tasks and only counts by language, label and logit (in steps
of ``STEP``) are collected. They give a logistic map of the logit, and for each language the cut that separates best
while hardly any clean text exceeds it, which is moved to ``CUT``. ``Model.report`` has the texts, recall and false
alarms of every language. The language is predicted from the text. Scoring always reads whole texts.

Cases: NULL and empty texts are scored from the bias alone; conflicting labels of one id count as toxic; without labels
of both classes every score is the share of toxic labels (0 without any), kept below the cut where it is 0; repeated
rows get equal scores; an empty table gives an empty table; other columns stay untouched.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.llm import lang_id
from tablewright.llm.common import own_names, prepare, stored

MOST_TOXIC, MOST_CLEAN = 1500, 3000
LONGEST = 4000
BITS = 16
BUCKETS = 1 << BITS
#: Letters that stand for a word and its inflected forms.
STEM = 4
#: Words whose buckets a task remembers.
MEMORY = 200_000
STEMS = zlib.crc32(b"stem ")
#: Bits of the filter by which texts without a label are passed over, a power of two.
FILTER = 1 << 25
DIMENSIONS = 8
FILTERS = 6
WIDTHS = (1, 2, 3)
EPOCHS = 4
BATCH = 32
CUT = 0.7
#: Share of clean calibration texts that may exceed the cut; one text always may, so that none decides alone.
FALSE_ALARMS = 0.005
#: Logits are counted in steps of this size, up to FARTHEST steps from zero.
STEP, FARTHEST = 0.01, 10_000
#: Toxic and clean texts that a calibration needs at least.
ENOUGH = 20
#: Words scored at once.
CHUNK = 200_000
PAD = max(WIDTHS) - 1


class Buckets(dict):
    """The bucket of each word and, BITS higher, of its stem: the letters inside count, marks around it do not."""

    def __missing__(self, word: str) -> int:
        w = word if word.isalnum() else word.strip("!?.,;:\"'()[]{}*#$%&|<>-_")
        data = w.encode()
        whole, stem = zlib.crc32(data), zlib.crc32(data[:STEM] if len(data) == len(w) else w[:STEM].encode(), STEMS)
        code = whole % (BUCKETS - 1) + 1 | (stem % (BUCKETS - 1) + 1) << BITS
        if len(self) < MEMORY:
            self[word] = code
        return code


remembered = Buckets()


def buckets(text: str | None) -> np.ndarray:
    """Buckets of the words and their stems. Bucket 0 is the padding."""
    words = [] if text is None else text.lower().split()
    return np.fromiter(map(remembered.__getitem__, words), np.uint32, len(words))


def parts(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of words and of stems."""
    return ids & (BUCKETS - 1), ids >> BITS


def laid_out(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Texts one after the other, each followed by padding and the last by twice as much, and where they begin."""
    gap = np.zeros(PAD, np.uint32)
    lengths = np.array([len(t) + PAD for t in texts], np.int64)
    return np.concatenate([*(x for t in texts for x in (t, gap)), gap]), np.cumsum(lengths) - lengths


@dataclass
class Network:
    embed: np.ndarray
    filters: list[np.ndarray]  # one (width, DIMENSIONS, FILTERS) array per width
    shift: list[np.ndarray]
    weight: np.ndarray
    bias: np.ndarray
    moments: dict = field(default_factory=dict)
    steps: int = 0

    @classmethod
    def started(cls, odds: np.ndarray, share: float) -> Network:
        random = np.random.default_rng(11)
        embed = random.normal(0, 0.05, (BUCKETS, DIMENSIONS)).astype(np.float32)
        embed[:, 0] = odds
        embed[0] = 0
        filters = [random.normal(0, 0.1, (w, DIMENSIONS, FILTERS)).astype(np.float32) for w in WIDTHS]
        for f in filters:
            f[:, 0, : FILTERS // 2] = 0.5
        weight = np.concatenate([np.r_[np.full(FILTERS // 2, 0.3), np.zeros(FILTERS - FILTERS // 2)] for _ in WIDTHS])
        return cls(embed, filters, [np.zeros(FILTERS, np.float32) for _ in WIDTHS], weight.astype(np.float32), np.full(1, np.log(share / (1 - share)) - 1, np.float32))

    def responses(self, ids: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """Embeddings, and the responses of the filters from each word on; what begins in the padding belongs to no text."""
        padding = np.flatnonzero(ids == 0)
        x = sum(self.embed[part] for part in parts(ids))
        out = []
        for kernel, shift in zip(self.filters, self.shift):
            n = len(ids) - len(kernel) + 1
            out.append(sum(x[j : j + n] @ kernel[j] for j in range(len(kernel))) + shift)
            out[-1][padding[padding < n]] = -np.inf
        return x, out

    def logits(self, texts: list[np.ndarray]) -> np.ndarray:
        """Logits of any number of texts; chunks of whole texts are laid out together."""
        result, waiting, words = [], [], 0
        for text in texts:
            waiting.append(text)
            words += len(text) + PAD
            if words > CHUNK:
                result.append(self._logits(waiting))
                waiting, words = [], 0
        if waiting:
            result.append(self._logits(waiting))
        return np.concatenate(result) if result else np.zeros(0)

    def _logits(self, texts: list[np.ndarray]) -> np.ndarray:
        ids, starts = laid_out(texts)
        _, responses = self.responses(ids)
        pooled = [np.maximum(np.maximum.reduceat(r, starts, axis=0), 0) for r in responses]
        return np.concatenate(pooled, axis=1).astype(np.float64) @ self.weight + self.bias[0]

    def train(self, texts: list[np.ndarray], y: np.ndarray, rate: float) -> None:
        ids, starts = laid_out(texts)
        x, responses = self.responses(ids)
        ends = np.append(starts[1:], len(ids))
        at = [np.stack([r[a : min(b, len(r))].argmax(axis=0) + a for a, b in zip(starts, ends)]) for r in responses]
        top = [np.maximum(r[p, np.arange(FILTERS)], 0) for r, p in zip(responses, at)]
        pooled = np.concatenate(top, axis=1)
        wrong = ((1 / (1 + np.exp(-(pooled @ self.weight + self.bias[0]))) - y) / len(y)).astype(np.float32)
        d_embed = np.zeros_like(self.embed)
        d_pooled = wrong[:, None] * self.weight[None]
        grads = {"weight": pooled.T @ wrong, "bias": wrong.sum(keepdims=True)}
        for k, (kernel, p) in enumerate(zip(self.filters, at)):
            g = d_pooled[:, k * FILTERS : (k + 1) * FILTERS] * (top[k] > 0)
            d_kernel = np.zeros_like(kernel)
            for j in range(len(kernel)):
                d_kernel[j] = np.einsum("bf,bfd->df", g, x[p + j])
                for part in parts(ids[p + j].ravel()):
                    np.add.at(d_embed, part, (g[:, :, None] * kernel[j].T[None]).reshape(-1, DIMENSIONS))
            grads[f"filter{k}"], grads[f"shift{k}"] = d_kernel, g.sum(axis=0)
        d_embed[0] = 0
        grads["embed"] = d_embed
        targets = {"weight": self.weight, "bias": self.bias, "embed": self.embed}
        targets |= {f"filter{k}": f for k, f in enumerate(self.filters)} | {f"shift{k}": s for k, s in enumerate(self.shift)}
        self.steps += 1
        for name, g in grads.items():
            m, v = self.moments.setdefault(name, (np.zeros_like(g), np.zeros_like(g)))
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            targets[name] -= rate * (m / (1 - 0.9**self.steps)) / (np.sqrt(v / (1 - 0.99**self.steps)) + 1e-6)


@dataclass
class Model:
    network: Network | None
    share: float
    slope: float = 1.0
    offset: float = 0.0
    cuts: dict[str, float] = field(default_factory=dict)  # by language, of the calibrated logit; "" holds for all others
    languages: lang_id.Model | None = None
    report: pd.DataFrame | None = None  # calibration texts, recall and false alarms by language

    def predict(self, texts: list[str | None]) -> np.ndarray:
        if self.network is None:
            return np.full(len(texts), self.share)
        z = self.slope * self.network.logits([buckets(t) for t in texts]) + self.offset
        spoken = [a[0] for a in self.languages.predict(texts)]
        cut = np.array([self.cuts.get(s, self.cuts[""]) for s in spoken])
        return sigmoid(z - cut + np.log(CUT / (1 - CUT)))


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def platt(z: np.ndarray, y: np.ndarray, n: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the logistic map of logits that occur ``n`` times, slightly regularised, by Newton steps."""
    toxic, clean = (n * y).sum(), (n * (1 - y)).sum()
    target = np.where(y == 1, (toxic + 1) / (toxic + 2), 1 / (clean + 2))
    a, b = 1.0, 0.0
    for _ in range(30):
        p = sigmoid(a * z + b)
        w = n * (p * (1 - p) + 1e-6)
        g = np.array([(n * (p - target) * z).sum() + 1e-2 * (a - 1), (n * (p - target)).sum()])
        h = np.array([[(w * z * z).sum() + 1e-2, (w * z).sum()], [(w * z).sum(), w.sum() + 1e-6]])
        da, db = np.linalg.solve(h, g)
        a, b = a - np.clip(da, -2, 2), b - np.clip(db, -5, 5)
    return max(a, 0.1), b


def best_cut(z: np.ndarray, y: np.ndarray, n: np.ndarray) -> float:
    """The middle of the gap with the best F1 among the cuts that at most FALSE_ALARMS of the clean texts, or one, exceed."""
    order = np.argsort(-z, kind="stable")
    ranked = np.r_[z[order][0] + 1, z[order], z[order][-1] - 1]
    hits, alarms = (np.r_[0, np.cumsum(v[order])] for v in (n * y, n * (1 - y)))
    f1 = 2 * hits / np.maximum(hits + alarms + hits[-1], 1)
    f1[(alarms > max(1, FALSE_ALARMS * alarms[-1])) | (ranked[:-1] == ranked[1:])] = -1
    i = int(np.argmax(f1))  # the first i logits are above the cut
    return float((ranked[i] + ranked[i + 1]) / 2)


def fit(texts: list[np.ndarray], y: np.ndarray) -> Network:
    """A network trained on texts of both classes."""
    toxic, clean = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for text, kind in zip(texts, y):
        (toxic if kind else clean)[np.unique(np.concatenate(parts(text)))] += 1
    n_toxic = y.sum()
    odds = np.log((toxic + 0.5) / (n_toxic + 1)) - np.log((clean + 0.5) / (len(y) - n_toxic + 1))
    network = Network.started(np.where(toxic + clean > 0, odds * (toxic + clean) / (toxic + clean + 4), 0), float(y.mean()))
    random = np.random.default_rng(5)
    for epoch in range(EPOCHS):
        for part in np.array_split(random.permutation(len(y)), max(1, len(y) // BATCH)):
            network.train([texts[i] for i in part], y[part].astype(np.float32), 0.01 / (1 + epoch))
    network.moments = {}
    return network


def calibrate(network: Network, share: float, counts: pd.DataFrame, languages: lang_id.Model) -> Model:
    """The model whose logistic map and cuts come from counts ``n`` by spoken, toxic and logit ``z``."""
    z, y, n = counts["z"].to_numpy(float), counts["toxic"].to_numpy(np.int64), counts["n"].to_numpy(np.int64)
    slope, offset = platt(z, y, n)
    z = slope * z + offset
    cuts = {"": best_cut(z, y, n)}
    report = []
    for language in sorted(set(counts["spoken"])):
        own = (counts["spoken"] == language).to_numpy()
        toxic, clean = own & (y == 1), own & (y == 0)
        if min(n[toxic].sum(), n[clean].sum()) >= ENOUGH:
            cuts[language] = best_cut(z[own], y[own], n[own])
        above = z >= cuts.get(language, cuts[""])
        rate = lambda rows: float(n[rows & above].sum() / n[rows].sum()) if n[rows].sum() else None
        report.append((language, int(n[toxic].sum()), int(n[clean].sum()), language in cuts, rate(toxic), rate(clean)))
    report = pd.DataFrame(report, columns=["spoken", "toxic", "clean", "own_cut", "recall", "false_alarms"])
    return Model(network, share, slope, offset, cuts, languages, report)


def coder(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        yield pd.DataFrame({"doc_id": batch["doc_id"], "toxic": batch["toxic"], "ids": [buckets(t).tobytes() for t in batch["text"]]})


def spot(doc_id: Column) -> Column:
    """The bit of an id in the filter; equal ids of any type have the same."""
    return F.pmod(F.xxhash64(F.coalesce(doc_id.try_cast("long"), F.lit(0))), F.lit(FILTER))


def marks(ids: DataFrame) -> np.ndarray:
    """The filter of a table's ids, added up in tasks: FILTER bits, whatever the number of ids."""
    at = ids.select(spot(F.col("doc_id")).alias("at")).select(F.expr("at >> 6").alias("word"), F.expr("shiftleft(1L, cast(at & 63 AS INT))").alias("bit"))
    found = at.groupBy("word").agg(F.bit_or("bit").alias("bits")).toPandas()
    bits = np.zeros(FILTER >> 6, np.int64)
    bits[found["word"].to_numpy(np.int64)] = found["bits"]
    return bits


def judge(shared, text: Column, at: Column) -> Column:
    """Language and logit, in steps, of each text whose bit the filter has; NULLs for the others."""

    @F.pandas_udf("spoken string, step long")
    def judged(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        network, languages, bits = shared.value
        for batch, spots in batches:
            places = spots.to_numpy(np.int64)
            wanted = np.flatnonzero(bits[places >> 6] >> (places & 63) & 1)
            texts = batch.iloc[wanted].tolist()
            spoken, step = np.full(len(batch), None, object), np.full(len(batch), np.nan)
            spoken[wanted] = [a[0] for a in languages.predict(texts)]
            step[wanted] = np.clip(np.rint(network.logits([buckets(t) for t in texts]) / STEP), -FARTHEST, FARTHEST)
            yield pd.DataFrame({"spoken": pd.Series(spoken, dtype=object), "step": step})

    return judged(text, at)


def learn(docs: DataFrame, labels: DataFrame, training: Column, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", toxic: str = "toxic") -> Model:
    """A model from the rows of ``labels`` whose id ``training`` (by doc_id) marks, and their texts."""
    spark = docs.sparkSession
    prepare(spark)
    marked = own_names(labels, doc_id="doc_id", toxic=toxic).where("doc_id IS NOT NULL AND toxic IS NOT NULL").where(training)
    marked = marked.groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    totals = {r["toxic"]: r["count"] for r in marked.groupBy("toxic").count().collect()}
    key = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_003))
    chance = lambda most, kind: F.lit(most / max(totals.get(kind, 0), most) * 1_000_003)
    chosen = key < F.when(F.col("toxic") == 1, chance(MOST_TOXIC, 1)).otherwise(chance(MOST_CLEAN, 0))
    known = own_names(docs, doc_id=doc_id, text=text, lang=lang).where(training)
    short = F.size(F.split("text", r"\s+")) <= LONGEST
    held = F.crc32(F.concat(F.lit("calibration "), F.col("doc_id").cast("string")).cast("binary")) % 5 == 0
    texts = known.where("text IS NOT NULL").select("doc_id", "text")
    sample = texts.join(F.broadcast(marked.where(chosen)), "doc_id").where(short)  # bounded by the sample's size
    data = sample.select("doc_id", "toxic", "text").mapInPandas(coder, "doc_id long, toxic int, ids binary").toPandas().sort_values(["doc_id", "ids"])
    y = data["toxic"].to_numpy(np.int64)
    share = float(y.mean()) if len(y) else 0.0
    if not 0 < y.sum() < len(y):
        return Model(None, share)
    fitted = np.array([zlib.crc32(b"calibration %d" % i) % 5 != 0 for i in data["doc_id"]], bool)
    fitted_rows = chosen & F.col("short") & ~held
    if not 0 < y[fitted].sum() < fitted.sum():
        fitted, fitted_rows = np.ones(len(y), bool), chosen & F.col("short")
    network = fit([np.frombuffer(b, np.uint32) for b in data["ids"][fitted]], y[fitted])
    languages = lang_id.learn(known)
    # Texts that may have a label are judged in the scan; what meets the labels is a few bytes a text.
    judged = judge(spark.sparkContext.broadcast((network, languages, marks(marked))), F.col("text"), spot(F.col("doc_id")))
    judged = texts.select("doc_id", F.coalesce(short, F.lit(False)).alias("short"), judged.alias("j"))
    labelled = stored(judged.join(marked, "doc_id").select("doc_id", "toxic", "short", "j.spoken", "j.step"), "toxicity-judged")

    def counted(rows: DataFrame) -> pd.DataFrame:
        found = rows.groupBy("spoken", "toxic", "step").agg(F.count(F.lit(1)).alias("n")).toPandas()  # bounded by languages and steps
        return found.assign(z=found["step"] * STEP)

    counts = counted(labelled.where(~fitted_rows))
    if min(counts.loc[counts["toxic"] == kind, "n"].sum() for kind in (0, 1)) < ENOUGH:
        counts = counted(labelled)
    return calibrate(network, share, counts, languages)


def toxicity(model: Model, text: Column, spark) -> Column:
    """The score of a text column, from the text alone."""
    prepare(spark)
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series(shared.value.predict(list(batch)))

    return score(text)
