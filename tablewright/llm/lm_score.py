"""Language-model score by a probabilistic suffix tree over words.

A text is its lower-cased words and one end token, which also stands before the first word. The root of the tree is
the smoothed unigram distribution over all words of the training texts, with exact counts. Longer contexts, of one and
of two tokens, are states when what follows them diverges from what follows the context one token shorter. A state's
distribution is smoothed with that of the shorter context, and what it has not listed backs off to it, renormalised, so
every distribution sums to one. Each token is scored by the longest state that is a suffix of what precedes.

All training texts are counted. A string of tokens is listed from ``LEAST`` occurrences on, whatever the size of the
corpus; longer strings are counted only where their parts are listed, which loses none. Nothing of the tree is collected
or broadcast: texts are cut into blocks, each block asks for its own strings, packed by ranges of their hashes, and what
its tasks are told (counts, then which contexts are states) goes back to the blocks that asked. One of the blocks that
hold a string adds it to the sums of its context, so a frequent context is one number a block, not a hot group. Words are
counted by themselves, pairs and triples by 64-bit hashes.

Cases: NULL and empty texts hold only the end token; a NULL id is hashed as empty text; repeated rows are counted and
scored each; without training texts every token has the chance of an unknown one; other columns are ignored.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from tablewright.llm.common import as_kind, as_text, ascii_words, fresh_path, own_names, prepare, stored

#: Occurrences from which a string of tokens is listed.
LEAST = 2
#: A context is a state from this log likelihood ratio (nats) on, plus one for each of its followers.
MIN_DIVERGENCE = 10.0
#: Weight of the parent's distribution, in observations.
PRIOR = 1.0
#: Text characters handled as one block.
BLOCK_CHARS = 6 << 20
#: Text bytes whose strings are counted as one shard.
SHARD_BYTES = 16 << 20

BITS = 31  # numbers of words and of pairs of a block stay below 2 ** BITS
END = 0  # number of the end token
WORDS, PAIRS, TRIPLES, SHORT, LONG = range(5)  # what is asked for: counts of strings, then contexts of one and two tokens

empty = lambda: np.zeros(0, np.int64)


def find(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Positions of the wanted keys in the sorted ones, -1 where absent."""
    if not len(keys):
        return np.full(len(wanted), -1, np.int64)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, at, -1)


@dataclass
class Strings:
    """Listed strings: sorted word hashes, then pairs and triples as (number of the string before, word) keys."""

    words: np.ndarray = field(default_factory=empty)
    pairs: np.ndarray = field(default_factory=empty)

    def number(self, words: list[bytes]) -> np.ndarray:
        """Numbers of words from 1, -1 for a word that is not listed."""
        hashes = np.fromiter(map(xxh3_64_intdigest, words), np.uint64, len(words)).view(np.int64)
        at = find(self.words, hashes)
        return np.where(at >= 0, at + 1, -1)

    def pair(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """Numbers of pairs, -1 where one is not listed."""
        return np.where((first >= 0) & (second >= 0), find(self.pairs, (first << BITS) | second), -1)


def mixed(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Hashes of strings from the hashes of what they begin with and of their last words."""
    x = first * np.uint64(0x9E3779B97F4A7C15) + (second ^ (second >> np.uint64(32))) * np.uint64(0xC2B2AE3D27D4EB4F)
    for shift, factor in ((33, 0xFF51AFD7ED558CCD), (29, 0xC4CEB9FE1A85EC53)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x ^ (x >> np.uint64(32))


def packed(values: np.ndarray) -> bytes:
    """Numbers compressed, bytes of equal weight side by side; before them their size."""
    if not len(values):
        return b""
    planes = np.ascontiguousarray(np.ascontiguousarray(values).view(np.uint8).reshape(len(values), -1).T)
    return planes.size.to_bytes(8, "little") + pa.compress(planes, "zstd", asbytes=True)


def unpacked(data: bytes, kind: str) -> np.ndarray:
    kind = np.dtype(kind)
    planes = pa.decompress(data[8:], int.from_bytes(data[:8], "little"), "zstd") if data else b""
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(kind.itemsize, -1).T).view(kind).ravel()


def follower_sums(context: np.ndarray, n: np.ndarray, expected: np.ndarray, total: np.ndarray):
    """Chance of each listed follower; by context the followers, their count, chance, expected chance and divergence."""
    size, whole = len(total), np.maximum(total, 1).astype(float)
    chance = (n + PRIOR * expected) / (whole[context] + PRIOR)
    divergence = n * np.log(n / whole[context] / expected)
    weights = [None, n, chance, expected, divergence]
    return chance, [np.bincount(context, w, size) for w in weights]


def settled(total: np.ndarray, followers, listed, given, before, divergence) -> tuple[np.ndarray, np.ndarray]:
    """Which contexts are states; log10 of the factor for followers that are not listed."""
    total = np.maximum(total, 1).astype(float)
    rest, rest_before = np.maximum(1 - given, 1e-12), np.maximum(1 - before, 1e-12)
    other = np.maximum(total - listed, 0)
    ratio = divergence + np.where(other > 0, other * np.log(np.maximum(other, 1) / total / rest_before), 0)
    return (followers > 0) & (ratio >= MIN_DIVERGENCE + followers), np.log10(rest / rest_before)


class Tree:
    """States and their distributions over the listed strings of a corpus, or of a block of it."""

    def __init__(self, strings: Strings, word_n: np.ndarray, pair_n: np.ndarray, triples: np.ndarray, triple_n: np.ndarray, whole: float):
        """The whole tree from all counts; ``word_n`` begins with the end token; ``whole``: the denominator of the unigram distribution."""
        self.lay(strings, word_n, pair_n, triples, triple_n, whole)
        self.keep1, self.back1 = settled(word_n, *self.sums1)
        self.keep2, self.back2 = settled(pair_n, *self.sums2)

    def lay(self, strings: Strings, word_n, pair_n, triples, triple_n, whole: float, own1=slice(None), own2=slice(None)) -> None:
        """Distributions from counts, and the sums of their contexts over the given pairs and triples."""
        self.strings, self.triples = strings, triples
        mask = (1 << BITS) - 1
        first, second = strings.pairs >> BITS, strings.pairs & mask
        expected = ((word_n + 0.5) / whole)[second]
        chance, _ = follower_sums(first, pair_n, expected, word_n)
        self.pair_log = np.log10(chance)
        _, self.sums1 = follower_sums(first[own1], pair_n[own1], expected[own1], word_n)
        context, last = triples >> BITS, triples & mask
        expected = chance[strings.pair(second[context], last)]
        chance, _ = follower_sums(context, triple_n, expected, pair_n)
        self.triple_log = np.log10(chance)
        _, self.sums2 = follower_sums(context[own2], triple_n[own2], expected[own2], pair_n)

    def score(self, numbers: np.ndarray, log: np.ndarray, starts: np.ndarray, pair: np.ndarray | None = None, triple: np.ndarray | None = None) -> np.ndarray:
        """log10 probability of each token of laid-out texts; ``log`` is the root's. The leading ends count nothing.

        ``pair`` and ``triple``: numbers of the listed strings that end at each token, where they are known.
        """
        here = log.copy()
        inside = np.ones(len(numbers), bool)
        inside[starts] = False
        if pair is None:
            pair = np.r_[-1, self.strings.pair(numbers[:-1], numbers[1:])]
            pair[starts] = -1
        if triple is None:
            triple = np.r_[-1, np.where((pair[:-1] >= 0) & (numbers[1:] >= 0), find(self.triples, (pair[:-1] << BITS) | numbers[1:]), -1)]
        longer = np.flatnonzero((pair[:-1] >= 0) & self.keep2[pair[:-1]] & inside[1:]) + 1 if len(self.keep2) else empty()
        short = (numbers[:-1] >= 0) & self.keep1[numbers[:-1]]
        short[longer - 1] = True  # what a longer state backs off to
        known = np.flatnonzero(short) + 1
        listed = pair[known]
        here[known] = np.where(listed >= 0, self.pair_log[listed], log[known] + self.back1[numbers[known - 1]]) if len(self.pair_log) else log[known]
        if len(longer):
            listed, unlisted = triple[longer], here[longer] + self.back2[pair[longer - 1]]
            here[longer] = np.where(listed >= 0, self.triple_log[listed], unlisted) if len(self.triples) else unlisted
        here[starts] = 0
        return here


def blocked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Blocks of texts: ids, lengths, training marks, words as positions among the distinct ones of the block."""
    made = TaskContext.get().partitionId() << 32
    ids, marks, texts, place, size = [], [], [], {}, 0

    def row() -> pd.DataFrame:
        tokens = np.concatenate(texts) if texts else np.zeros(0, np.int32)
        return pd.DataFrame(
            {"block": [made], "ids": [ids], "lengths": [packed(np.array([len(t) for t in texts], np.int64))], "training": [packed(np.array(marks, bool))],
             "tokens": [packed(tokens)], "words": [b"\n".join(place)], "ends": [sum(marks)]}
        )

    for batch in batches:
        for doc, text, mark in zip(batch["doc_id"], batch["text"], batch["training"]):
            words = ascii_words(text)
            ids.append(doc)
            marks.append(bool(mark))
            texts.append(np.array([place.setdefault(w, len(place)) for w in words], np.int32))
            size += len(text or "")
            if size >= BLOCK_CHARS:
                yield row()
                made += 1
                ids, marks, texts, place, size = [], [], [], {}, 0
    if ids:
        yield row()


class Block:
    """A block with what it has been told so far."""

    def __init__(self, row, told: pd.DataFrame, ends: int):
        self.number, self.ids = row["block"], row["ids"]
        lengths = unpacked(row["lengths"], "i8") + 2
        self.training = np.repeat(unpacked(row["training"], "?"), lengths)
        self.starts = np.cumsum(lengths) - lengths
        self.inside = np.ones(int(lengths.sum()), bool)
        self.inside[self.starts] = False
        word = self.inside.copy()
        word[self.starts + lengths - 1] = False
        self.numbers = np.full(len(word), END, np.int64)
        self.numbers[word] = unpacked(row["tokens"], "i4") + 1
        self.words = row["words"].split(b"\n") if row["words"] else []
        told = told.sort_values("shard")
        self.told = {kind: part for kind, part in told.groupby("kind")}
        self.hashes = np.fromiter(map(xxh3_64_intdigest, [b"\n", *self.words]), np.uint64, len(self.words) + 1)
        self.word_n = np.zeros(len(self.words) + 1, np.int64)
        self.word_n[END] = ends
        if WORDS in self.told:
            self.word_n[1 + np.argsort(self.hashes[1:], kind="stable")] = self.answer(WORDS)

    def answer(self, kind: int, form: str = "i8", at: int = 0) -> np.ndarray:
        return np.concatenate([unpacked(c[at], form) for c in self.told[kind]["columns"]]) if kind in self.told else np.zeros(0, form)

    def listed(self, kind: int, codes: np.ndarray, places: np.ndarray, keys_of):
        """Strings that are listed: they, their hashes, counts, whether this block adds them up; which ends at each token."""
        strings, _, at = ranked(codes)
        keys = keys_of(strings)
        found = np.zeros(len(strings), np.int64)
        found[np.argsort(keys)] = self.answer(kind)
        some = found > 0
        ending = np.full(len(self.numbers), -1, np.int64)
        ending[places] = np.where(some, np.cumsum(some) - 1, -1)[at]
        return strings[some], keys[some], found[some] >> 1, (found[some] & 1).astype(bool), ending

    def pair_codes(self) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of listed words, and the places of their last words."""
        often = (self.word_n >= LEAST)[self.numbers]
        places = np.flatnonzero(self.inside[1:] & often[:-1] & often[1:]) + 1
        return (self.numbers[places - 1] << BITS) | self.numbers[places], places

    def know_pairs(self) -> None:
        self.pairs, self.pair_keys, self.pair_n, self.pair_own, self.pair = self.listed(PAIRS, *self.pair_codes(), self.keys_of_pairs)
        self.strings = Strings(empty(), self.pairs)

    def keys_of_pairs(self, pairs: np.ndarray) -> np.ndarray:
        return mixed(self.hashes[pairs >> BITS], self.hashes[pairs & ((1 << BITS) - 1)])

    def triple_codes(self) -> tuple[np.ndarray, np.ndarray]:
        """Triples of listed pairs, and the places of their last words."""
        places = np.flatnonzero((self.pair[:-1] >= 0) & (self.pair[1:] >= 0)) + 1
        return (self.pair[places - 1] << BITS) | self.numbers[places], places

    def keys_of_triples(self, triples: np.ndarray) -> np.ndarray:
        return mixed(self.pair_keys[triples >> BITS], self.hashes[triples & ((1 << BITS) - 1)])

    def tree(self, whole: float) -> Tree:
        """The tree of the listed strings of the block, without its states."""
        self.know_pairs()
        triples, _, n, own, self.triple = self.listed(TRIPLES, *self.triple_codes(), self.keys_of_triples)
        tree = Tree.__new__(Tree)
        tree.lay(self.strings, self.word_n, self.pair_n, triples, n, whole, self.pair_own, own)
        return tree

    def asked(self, kind: int, keys: np.ndarray, columns: list[np.ndarray], shards: int, names: list[bytes] | None = None) -> list[tuple]:
        """Rows for the shards: hashes (as differences, or the words themselves) in order, with numbers for each."""
        order = np.argsort(keys, kind="stable" if names else None)
        keys, columns = keys[order], [c[order] for c in columns]
        edges = np.r_[0, np.searchsorted(keys, np.array([(i << 64) // shards for i in range(1, shards)], np.uint64)), len(keys)]
        rows = []
        for shard, (a, b) in enumerate(zip(edges[:-1].tolist(), edges[1:].tolist())):
            if a < b:
                steps = packed(np.frombuffer(b"\n".join([names[i] for i in order[a:b].tolist()]), np.uint8)) if names else packed(np.r_[keys[a], keys[a + 1 : b] - keys[a : b - 1]])
                rows.append((shard, self.number, kind, steps, [packed(c[a:b]) for c in columns]))
        return rows

    def asked_of_pairs(self, columns: list[np.ndarray]) -> list[tuple]:
        """Rows for the shards that count the listed pairs, by the places of these there."""
        order, a, rows = np.argsort(self.pair_keys), 0, []
        columns = [c[order] for c in columns]
        for shard, (_, places) in zip(self.told[PAIRS]["shard"], self.told[PAIRS]["columns"]) if PAIRS in self.told else []:
            b = a + len(unpacked(places, "i4"))
            if a < b:
                rows.append((shard, self.number, LONG, places, [packed(c[a:b]) for c in columns]))
            a = b
        return rows


ASKED = "shard int, block long, kind int, keys binary, columns array<binary>"
TOLD = "block long, kind int, shard int, columns array<binary>, strings long, tokens long"


def ranked(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct codes, a place of each, and which of them stands at each place (``np.unique`` takes longer)."""
    order = np.argsort(codes)
    new = np.ones(len(codes), bool)
    new[1:] = codes[order[1:]] != codes[order[:-1]]
    at = np.empty(len(codes), np.int64)
    at[order] = np.cumsum(new) - 1
    return codes[order[new]], order[new], at


def counted(codes: np.ndarray, training: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct strings, and how often each is in training texts."""
    strings, _, at = ranked(codes)
    return strings, np.bincount(at, training, len(strings)).astype(np.int64)


def tell_words(group: pd.DataFrame) -> pd.DataFrame:
    """Counts of words for the blocks that asked; the shard's words and their occurrences stand in the first row."""
    counts: dict[bytes, int] = {}
    asked = [(unpacked(words, "u1").tobytes().split(b"\n"), unpacked(columns[0], "i8").tolist()) for words, columns in zip(group["keys"], group["columns"])]
    for words, n in asked:
        for w, k in zip(words, n):
            counts[w] = counts.get(w, 0) + k
    columns = [[packed(np.array([counts[w] for w in words], np.int64))] for words, _ in asked]
    none = [0] * (len(columns) - 1)
    return pd.DataFrame(
        {"block": group["block"], "kind": WORDS, "shard": group["shard"], "columns": columns,
         "strings": [sum(n > 0 for n in counts.values()), *none], "tokens": [sum(counts.values()), *none]}
    )


def laid_together(part: pd.DataFrame) -> tuple[list[int], np.ndarray, np.ndarray]:
    """Ends of the rows, a place of each distinct hash, and which hash stands at each place."""
    keys = [np.cumsum(unpacked(k, "u8"), dtype=np.uint64) for k in part["keys"]]
    cuts = np.cumsum([len(k) for k in keys])[:-1].tolist()
    return cuts, *ranked(np.concatenate(keys))[1:]


def column(part: pd.DataFrame, i: int, form: str) -> np.ndarray:
    return np.concatenate([unpacked(c[i], form) for c in part["columns"]])


def tell_strings(group: pd.DataFrame) -> pd.DataFrame:
    """Twice the count of each listed string, 0 for all others, plus one for the one block that adds it up.

    Of listed pairs also their places among those of the shard, as differences: by these they are asked for as contexts.
    """
    cuts, first, at = laid_together(group)
    n = np.bincount(at, column(group, 0, "i8"), len(first)).astype(np.int64)
    n[n < LEAST] = 0
    values = 2 * n[at]
    values[first] += n > 0
    place = np.cumsum(n > 0) - 1
    columns = []
    for told, strings in zip(np.split(values, cuts), np.split(at, cuts)):
        places = place[strings[told > 0]]
        columns.append([packed(told), packed(np.diff(places, prepend=0).astype(np.int32)) if group["kind"].iloc[0] == PAIRS else b""])
    return pd.DataFrame({"block": group["block"], "kind": group["kind"], "shard": group["shard"], "columns": columns, "strings": 0, "tokens": 0})


def tell_contexts(group: pd.DataFrame) -> pd.DataFrame:
    """Which contexts are states, and their factors; those of long contexts that are no states are not needed."""
    parts = []
    for kind, part in group.sort_values("block").groupby("kind"):
        if kind == LONG:
            places = [np.cumsum(unpacked(k, "i4"), dtype=np.int64) for k in part["keys"]]
            cuts, at = np.cumsum([len(p) for p in places])[:-1].tolist(), np.concatenate(places)
        else:
            cuts, _, at = laid_together(part)
        size = int(at.max()) + 1
        n, total = column(part, 0, "i8"), np.zeros(size, np.int64)
        total[at[n > 0]] = n[n > 0]
        sums = [np.bincount(at, column(part, i, form), size) for i, form in enumerate(("i8", "i8", "f4", "f4", "f4"), 1)]
        keep, back = settled(total, *sums)
        if kind == LONG:
            back[~keep] = 0
        columns = [[packed(b), packed(k)] for b, k in zip(np.split(back.astype("f4")[at], cuts), np.split(keep[at], cuts))]
        parts.append(pd.DataFrame({"block": part["block"], "kind": kind, "shard": part["shard"], "columns": columns, "strings": 0, "tokens": 0}))
    return pd.concat(parts)


def lm_scores(docs: DataFrame, training: Column, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Score every row of ``docs``; ``training`` marks (by the columns doc_id and text) the rows to learn from.

    Gives doc_id, n_tokens, n_known, train_tokens, base_score (unigram), score, and ctx_tokens: tokens that a state
    longer than the root scored.
    """
    spark = docs.sparkSession
    prepare(spark)
    docs = own_names(docs, doc_id=doc_id, text=text)
    kind = docs.schema["doc_id"].dataType.simpleString()
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(1, math.ceil(size / SHARD_BYTES))
    marked = as_text(docs.withColumn("training", F.coalesce(training, F.lit(False))))
    blocks = dealt(marked.mapInPandas(blocked, "block long, ids array<string>, lengths binary, training binary, tokens binary, words binary, ends long"), math.ceil(size / BLOCK_CHARS))
    ends = blocks.agg(F.sum("ends")).first()[0] or 0

    def told(step: Callable[[Block], list[tuple]], before: list[DataFrame], tell) -> DataFrame:
        """What blocks that know the answers before are told when they ask."""

        def ask(rows: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
            asked = [r for row in rows.to_dict("records") for r in step(Block(row, known, ends))]
            return pd.DataFrame(asked, columns=["shard", "block", "kind", "keys", "columns"])

        return stored(met(blocks, before, ask, ASKED).groupBy("shard").applyInPandas(tell, TOLD), "told")

    def ask_words(b: Block) -> list[tuple]:
        n = np.bincount(b.numbers, b.training, len(b.words) + 1).astype(np.int64)[1:]
        return b.asked(WORDS, b.hashes[1:], [n], shards, b.words)

    def ask_pairs(b: Block) -> list[tuple]:
        codes, places = b.pair_codes()
        pairs, n = counted(codes, b.training[places])
        return b.asked(PAIRS, b.keys_of_pairs(pairs), [n], shards)

    words = told(ask_words, [], tell_words)
    vocabulary, tokens = words.agg(F.sum("strings"), F.sum("tokens")).first()
    vocabulary, tokens = (vocabulary or 0) + (ends > 0), (tokens or 0) + ends
    whole = tokens + 0.5 * (vocabulary + 1)

    def ask_triples(b: Block) -> list[tuple]:
        b.know_pairs()
        codes, places = b.triple_codes()
        triples, n = counted(codes, b.training[places])
        return b.asked(TRIPLES, b.keys_of_triples(triples), [n], shards)

    def ask_contexts(b: Block) -> list[tuple]:
        tree = b.tree(whole)
        form = lambda total, sums: [total, *[s.astype("i8") for s in sums[:2]], *[s.astype("f4") for s in sums[2:]]]
        often = b.word_n >= LEAST
        short = [c[often] for c in form(b.word_n, tree.sums1)]
        return b.asked(SHORT, b.hashes[often], short, shards) + b.asked_of_pairs(form(b.pair_n * b.pair_own, tree.sums2))

    def score(rows: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        return pd.concat([scored(Block(row, known, ends)) for row in rows.to_dict("records")])

    def scored(b: Block) -> pd.DataFrame:
        tree = b.tree(whole)
        for name, kind, keys, asked in (("1", SHORT, b.hashes, b.word_n >= LEAST), ("2", LONG, b.pair_keys, b.pair_n > 0)):
            keep, back = np.zeros(len(keys), bool), np.zeros(len(keys))
            order = np.flatnonzero(asked)[np.argsort(keys[asked])]
            keep[order], back[order] = b.answer(kind, "?", 1), b.answer(kind, "f4")
            setattr(tree, f"keep{name}", keep)
            setattr(tree, f"back{name}", back)
        log = (np.log10(b.word_n + 0.5) - math.log10(whole))[b.numbers]
        seen = (b.word_n > 0).astype(np.int64)[b.numbers]
        log[b.starts], seen[b.starts] = 0, 0
        logs = tree.score(b.numbers, log, b.starts, b.pair, b.triple)
        return pd.DataFrame(
            {
                "doc_id": list(b.ids),
                "n_tokens": np.diff(np.append(b.starts, len(b.numbers))) - 1,
                "n_known": np.add.reduceat(seen, b.starts),
                "base_score": np.add.reduceat(log, b.starts),
                "score": np.add.reduceat(logs, b.starts),
                "ctx_tokens": np.add.reduceat((logs != log).astype(np.int64), b.starts),
            }
        )

    known = [words]
    for step, tell in ((ask_pairs, tell_strings), (ask_triples, tell_strings), (ask_contexts, tell_contexts)):
        known.append(told(step, known, tell))
    found = met(blocks, known, score, "doc_id string, n_tokens long, n_known long, base_score double, score double, ctx_tokens long")
    return as_kind(found, kind).withColumn("train_tokens", F.lit(tokens).cast("long"))


def dealt(blocks: DataFrame, buckets: int) -> DataFrame:
    """The blocks written once in buckets, so that answers are brought to them and they themselves stay where they are."""
    spark = blocks.sparkSession
    name = f"lm_blocks_{uuid.uuid4().hex}"
    buckets = min(max(buckets, int(spark.conf.get("spark.sql.shuffle.partitions"))), 10_000)
    blocks.write.bucketBy(buckets, "block").option("compression", "zstd").option("path", fresh_path(spark, "blocks")).format("parquet").saveAsTable(name)
    return spark.table(name)


def met(blocks: DataFrame, known: list[DataFrame], step, schema: str) -> DataFrame:
    """The step for each block, with all that it has been told."""
    answers = blocks.sparkSession.range(0).selectExpr("id AS block", "0 AS kind", "0 AS shard", "CAST(NULL AS array<binary>) AS columns")
    for part in known:
        answers = answers.union(part.select("block", "kind", "shard", "columns"))
    return blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInPandas(step, schema)
