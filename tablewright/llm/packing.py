"""Packing of documents into fixed windows by lexical retrieval.

Documents are tokenised once and written as token ids. They are dealt into shards of about ``SHARD_TOKENS`` by range of
a lexical signature (the smallest hash of their neighbouring ids), so that like documents meet. Every shard builds a
BM25 inverted index over the token ids of all its documents, with document frequencies of the whole corpus; these are
bounded by the tokenizer's vocabulary. A window begins with a seed document; the index returns its unused neighbours,
best first, which fill the window greedily. The document that no longer fits is cut there, and its rest is the seed of
the next window, so only the last window of a shard is not full.

Cases: NULL and empty texts are one closing id; texts longer than a window fill several; repeated rows are packed each;
NULL ids are carried; documents without neighbours are followed by the next unused one in order; an empty table gives
no pieces; other columns are ignored.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.llm.common import as_kind, as_text, own_names, prepare, stored

WINDOW = 4096
CLOSING = 2
SHARD_TOKENS = 2_000_000
QUERY_TERMS = 16
K1, B = 1.2, 0.75
#: Places for the ids of words that a task remembers, a power of two, and ids that a place holds.
MEMORY, HELD = 1 << 18, 8
#: Bytes of texts that are worked on at once; longer texts go to the tokenizer whole.
LETTERS = 1 << 18
#: Words that the tokenizer gets at once as one text.
JOINED = 50

#: Texts of these characters can be cut at white space before tokenising; all others go to the tokenizer whole.
PLAIN = re.compile("[\t\n\r\x20-\x7e\xa1-\xac\xae-įĲ-ɏ–—‘-”…]*")
#: In texts without apostrophes, whose only characters beyond ASCII are letters, runs of letters can be cut from their marks too.
SIMPLE = re.compile("[\t\n\r\x20-\x26\x28-\x7eÀ-ÖØ-öø-įĲ-ɏ]*")

BLANK, LETTER, MARK = 0, 1, 2
#: Kinds of the bytes of texts that are cut at white space only, and of simple ones.
KINDS = np.full((2, 256), LETTER, np.uint8)
KINDS[:, [9, 10, 13, 32]] = BLANK
KINDS[1, [c for c in range(33, 127) if not chr(c).isalpha()]] = MARK
#: For two hashes of words: a number for each byte, the powers of an odd number, and those of its inverse.
VALUES = np.random.default_rng(5).integers(1, 1 << 63, (2, 256), np.uint64)
BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def byte_letters() -> np.ndarray:
    """The letter by which a byte-level vocabulary writes each byte; blanks stay."""
    letters = np.arange(256, dtype="<u4")
    odd = [b for b in range(256) if not (33 <= b < 127 or 161 <= b < 173 or b >= 174)]
    letters[odd] = 256 + np.arange(len(odd))
    letters[32] = 32
    return letters


class WordTokens:
    """Token ids of texts, by way of the ids of their words, each of which is tokenised once while it is remembered.

    The tokenizer drops white space and never joins characters across it, nor letters and marks, so words can be tokenised one by
    one. Words are named by 128 bits; each has one place in a table of fixed size, where a later word takes the place of an
    earlier one. What the table lacks is tokenised: runs of letters, which the tokenizer's rules leave whole, by its
    model alone, many in one text. A tokenizer that does not keep to this gets all texts whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks are what runs side by side
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import WhitespaceSplit

        self.tokenizer = Tokenizer.from_file(path)
        self.model = Tokenizer(self.tokenizer.model)
        self.model.pre_tokenizer = WhitespaceSplit()
        vocabulary = self.tokenizer.get_vocab()
        self.closes = np.zeros(max(vocabulary.values(), default=0) + 1, bool)
        self.closes[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.letters = byte_letters()
        self.names = np.zeros((2, MEMORY), np.uint64)
        self.size = np.zeros(MEMORY, np.int64)  # 0: free
        self.pool = np.zeros(MEMORY * HELD + LETTERS, np.uint32)  # HELD ids a place, then those of the words just tokenised
        n = LETTERS + 2
        self.forth = [powers(b, n) for b in BASES]
        self.back = [powers(pow(b, -1, 1 << 64), n) for b in BASES]
        self.cuts = True
        probe = ["Größe, word12. (Être)\tO'Neil's"] * 2
        self.cuts = all(a.tolist() == e.ids for a, e in zip(self.encode(probe), self.tokenizer.encode_batch_fast(probe, add_special_tokens=False)))

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        found: list[np.ndarray | None] = [None] * len(texts)
        waiting: tuple[list, list] = ([], [])
        whole = []
        for i, text in enumerate(texts):
            if not self.cuts or "<|" in text or not PLAIN.fullmatch(text):
                whole.append(i)
            else:
                data = text.lower().encode()
                if len(data) > LETTERS:
                    whole.append(i)
                else:
                    waiting[SIMPLE.fullmatch(text) is not None].append((i, data))
        for i, e in zip(whole, self.tokenizer.encode_batch_fast([texts[i] for i in whole], add_special_tokens=False)):
            found[i] = np.array(e.ids, np.uint32)
        for kinds, group in zip(KINDS, waiting):
            part, letters = [], 0
            for i, data in group:
                if part and letters + len(data) + 1 > LETTERS:
                    self._encode(kinds, part, found)
                    part, letters = [], 0
                part.append((i, data))
                letters += len(data) + 1
            if part:
                self._encode(kinds, part, found)
        return found

    def _encode(self, kinds: np.ndarray, part: list[tuple[int, bytes]], found: list) -> None:
        """The ids of texts of one sort."""
        joined = b"\n".join(data for _, data in part) + b"\n"
        data = np.frombuffer(joined, np.uint8)
        kind = kinds[data]
        edge = np.flatnonzero(kind[1:] != kind[:-1]) + 1
        if kind[0] != BLANK:
            edge = np.r_[0, edge]
        start, end = edge[kind[edge] != BLANK], edge[(edge > 0) & (kind[edge - 1] != BLANK)]
        one, other = (self._names(data, start, end, k) for k in (0, 1))
        place = (one >> np.uint64(64 - MEMORY.bit_length() + 1)).astype(np.int64)
        known = (self.names[0][place] == one) & (self.names[1][place] == other) & (self.size[place] > 0)
        size, at = self.size[place], place * HELD
        missing = np.flatnonzero(~known)
        if len(missing):
            order = missing[np.lexsort((other[missing], one[missing]))]
            fresh = np.r_[True, (one[order][1:] != one[order][:-1]) | (other[order][1:] != other[order][:-1])]
            first = order[fresh]
            ids, sizes = self._tokenised([joined[a:b] for a, b in zip(start[first].tolist(), end[first].tolist())])
            begin = np.cumsum(sizes) - sizes
            which = np.cumsum(fresh) - 1
            size[order], at[order] = sizes[which], MEMORY * HELD + begin[which]
            if MEMORY * HELD + len(ids) > len(self.pool):
                self.pool = np.append(self.pool[: MEMORY * HELD], np.zeros(2 * len(ids), np.uint32))
            self.pool[MEMORY * HELD : MEMORY * HELD + len(ids)] = ids
        total = np.cumsum(size)
        flat = self.pool[np.repeat(at - total + size, size) + np.arange(int(total[-1]) if len(total) else 0)]
        if len(missing):  # remembered for later, where they fit
            fits = np.flatnonzero((sizes > 0) & (sizes <= HELD))
            _, last = np.unique(place[first[fits]], return_index=True)  # of words for one place the first
            fits = fits[last]
            spot = place[first[fits]]
            self.names[0][spot], self.names[1][spot], self.size[spot] = one[first[fits]], other[first[fits]], sizes[fits]
            column = np.arange(HELD)
            self.pool[(spot * HELD)[:, None] + column] = ids[np.minimum(begin[fits][:, None] + column, len(ids) - 1)]
        lengths = np.array([len(d) + 1 for _, d in part], np.int64)
        words = np.searchsorted(start, np.cumsum(lengths))
        edges = np.r_[0, np.r_[0, total][words]]
        for k, (i, _) in enumerate(part):
            found[i] = flat[edges[k] : edges[k + 1]]

    def _names(self, data: np.ndarray, start: np.ndarray, end: np.ndarray, k: int) -> np.ndarray:
        """A 64-bit hash of each word."""
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(VALUES[k][data] * self.forth[k][: len(data)], out=sums[1:])
        name = (sums[end] - sums[start]) * self.back[k][start]
        name = (name ^ (name >> np.uint64(31)) ^ (end - start).astype(np.uint64)) * np.uint64(0xBF58476D1CE4E5B9)
        return (name ^ (name >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)

    def _written(self, words: bytes) -> str:
        return words.decode() if words.isascii() else self.letters[np.frombuffer(words, np.uint8)].tobytes().decode("utf-32-le")

    def _tokenised(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of words one after the other, and how many each has."""
        sizes = np.zeros(len(words), np.int64)
        texts = [w.decode() for w in words]
        pure = np.fromiter(map(str.isalpha, texts), bool, len(texts))
        runs, rest = np.flatnonzero(pure), np.flatnonzero(~pure)
        written = [words[i] for i in runs.tolist()]
        chunks = [self._written(b" ".join(written[i : i + JOINED])) for i in range(0, len(written), JOINED)]
        found = [np.array(e.ids, np.uint32) for e in self.model.encode_batch_fast(chunks, add_special_tokens=False)]
        ids = np.concatenate([np.zeros(0, np.uint32), *found])
        closing = np.flatnonzero(self.closes[ids])
        if len(closing) != len(runs):  # not a vocabulary that marks the ends of words
            runs, rest, ids, closing = runs[:0], np.arange(len(words)), ids[:0], closing[:0]
        sizes[runs] = np.diff(np.r_[-1, closing])
        others = [e.ids for e in self.tokenizer.encode_batch_fast([texts[i] for i in rest.tolist()], add_special_tokens=False)]
        sizes[rest] = [len(e) for e in others]
        ids = np.concatenate([ids, np.array([i for e in others for i in e], np.uint32)])
        order = np.r_[runs, rest]
        begin = np.zeros(len(words), np.int64)
        begin[order] = np.cumsum(sizes[order]) - sizes[order]
        goes = np.cumsum(sizes) - sizes
        return ids[np.repeat(begin - goes, sizes) + np.arange(int(sizes.sum()))], sizes


def lexical_signature(ids: np.ndarray) -> int:
    both = (ids[:-1].astype(np.uint64) << np.uint64(32)) | ids[1:]
    key = (both ^ (both >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return int((key ^ (key >> np.uint64(29))).min() >> np.uint64(1)) if len(key) else 0


def tokenised(path: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tokens = WordTokens(path)
        for batch in batches:
            ids = [np.append(i, np.uint32(CLOSING)) for i in tokens.encode([t or "" for t in batch["text"]])]
            yield pd.DataFrame(
                {"doc_id": batch["doc_id"], "ids": [i.astype("<u2" if i.max() < 65536 else "<u4").tobytes() for i in ids],
                 "n": [len(i) for i in ids], "sig": [lexical_signature(i) for i in ids]}
            )

    return run


def unpacked(ids: bytes, n: int) -> np.ndarray:
    return np.frombuffer(ids, "<u2" if len(ids) == 2 * n else "<u4").astype(np.uint32)


def token_documents(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    seen, place = np.zeros(0, np.int64), np.zeros(0, np.int32)
    for batch in batches:
        for data, n in zip(batch["ids"], batch["n"]):
            ids = unpacked(data, n)
            if (top := int(ids.max()) + 1) > len(seen):
                seen, place = (np.append(x, np.zeros(top - len(seen), x.dtype)) for x in (seen, place))
            at = np.arange(len(ids), dtype=np.int32)
            place[ids] = at  # one place of each token stays
            seen[ids[place[ids] == at]] += 1
    token = np.flatnonzero(seen)
    yield pd.DataFrame({"token": token, "docs": seen[token]})


class Index:
    """BM25 postings of one shard: for each token the documents that hold it and their weights."""

    def __init__(self, texts: list[np.ndarray], idf: np.ndarray, average: float):
        terms, docs, weights = [], [], []
        self.queries = []
        for i, ids in enumerate(texts):
            term, tf = np.unique(ids, return_counts=True)
            weight = idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(ids) / average))
            best = np.argsort(-weight, kind="stable")[:QUERY_TERMS]
            self.queries.append(term[best])
            terms.append(term)
            docs.append(np.full(len(term), i, np.int32))
            weights.append(weight.astype(np.float32))
        term = np.concatenate(terms)
        order = np.argsort(term, kind="stable")
        self.docs, self.weights = np.concatenate(docs)[order], np.concatenate(weights)[order]
        self.edge = np.searchsorted(term[order], np.arange(len(idf) + 1))

    def neighbours(self, seed: int, unused: np.ndarray) -> np.ndarray:
        """Unused documents that share a query term with the seed, best first."""
        score = np.zeros(len(unused), np.float32)
        for t in self.queries[seed]:
            a, b = self.edge[t], self.edge[t + 1]
            score[self.docs[a:b]] += self.weights[a:b]
        found = np.flatnonzero((score > 0) & unused)
        return found[np.argsort(-score[found], kind="stable")]


def fill(texts: list[np.ndarray], index: Index, window: int) -> Iterator[tuple[int, int, int, int, int]]:
    """(document, start, length, window number, offset) of every piece."""
    unused = np.ones(len(texts), bool)
    number, room, following = 0, window, 0

    def place(doc: int, start: int) -> Iterator[tuple[int, int, int, int, int]]:
        nonlocal number, room
        while start < len(texts[doc]):
            length = min(room, len(texts[doc]) - start)
            yield doc, start, length, number, window - room
            start, room = start + length, room - length
            if room == 0:
                number, room = number + 1, window

    while True:
        while following < len(texts) and not unused[following]:
            following += 1
        if following == len(texts):
            return
        seed = following
        unused[seed] = False
        yield from place(seed, 0)
        while seed is not None:
            before, chosen, seed = number, index.neighbours(seed, unused), None
            for doc in chosen.tolist():
                unused[doc] = False
                yield from place(doc, 0)
                if number != before:
                    seed = doc  # what was cut begins the next window
                    break


def packed_shard(idf: np.ndarray, average: float, window: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names, texts = [], []
        for batch in batches:
            names += batch["doc_id"].tolist()
            texts += [unpacked(i, n) for i, n in zip(batch["ids"], batch["n"])]
        if not texts:
            return
        first = TaskContext.get().partitionId() << 36
        columns = ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"]
        rows = []
        for doc, start, length, number, offset in fill(texts, Index(texts, idf, average), window):
            ids = texts[doc][start : start + length].astype("<u4").tobytes()
            rows.append((names[doc], start, length, len(texts[doc]), first + number, offset, ids))
            if len(rows) == 200:
                yield pd.DataFrame(rows, columns=columns)
                rows = []
        yield pd.DataFrame(rows, columns=columns)

    return run


def pack(docs: DataFrame, tokenizer: str, window: int = WINDOW, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Pieces (doc_id, start, length, doc_tokens, sequence_id, offset, ids as little-endian 32-bit numbers).

    ``tokenizer``: path of a tokenizer file that drops white space, found at the same place on every machine.
    """
    prepare(docs.sparkSession)
    docs = own_names(docs, doc_id=doc_id, text=text)
    kind = docs.schema["doc_id"].dataType.simpleString()
    tokens = as_text(docs).mapInPandas(tokenised(tokenizer), "doc_id string, ids binary, n long, sig long")
    tokens = stored(as_kind(tokens, kind), "tokens")
    count, total = tokens.agg(F.count(F.lit(1)), F.sum("n")).first()
    seen = tokens.select("ids", "n").mapInPandas(token_documents, "token long, docs long").groupBy("token").agg(F.sum("docs").alias("docs")).toPandas()
    known = np.zeros(int(seen["token"].max()) + 1 if len(seen) else 1)
    known[seen["token"].to_numpy(np.int64)] = seen["docs"]
    idf = np.log1p((count - known + 0.5) / (known + 0.5))
    shards = max(1, round((total or 0) / SHARD_TOKENS))
    dealt = tokens.repartitionByRange(shards, "sig", "doc_id").sortWithinPartitions("sig", "doc_id")
    schema = "doc_id string, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"
    packed = packed_shard(idf, max((total or 0) / max(count, 1), 1.0), window)
    return as_kind(as_text(dealt.select("doc_id", "ids", "n")).mapInPandas(packed, schema), kind)
