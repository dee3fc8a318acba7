"""SentencePiece encoding and decoding by a shared-prefix Viterbi search.

Texts are cut into marked words: a word with the spaces before it (every text but the empty one gets one in front), a run of
spaces that no word follows, or a line feed. No piece of the vocabulary reaches over such a cut, so the segmentation of a text is that
of its words. Each task sorts the distinct words of a buffer of texts, which is the depth-first order of their trie; the search keeps
the forward states of the path from the root, so a prefix that words share is searched once. Encoded words are remembered
within bounds, and texts are put together where they were read: nothing is shuffled.

The forward state of a prefix depends on the kind of the model. ``unigram``: the largest sum of piece scores; of equal sums the one with
the longest last piece wins. ``merges``: a BPE model's scores are ranks of merges, not log-probabilities, and a largest sum of them is
not what such a model means. There a prefix has exactly one last piece: the one whose merges do not meddle with the last
piece of the prefix before it. The ids equal those of the SentencePiece library, except in texts that hold the mark
(U+2581) itself: it becomes byte pieces here, so that it comes back, and a space there.

Characters outside the vocabulary become byte pieces, so decoding gives every text back.

Cases: a NULL text has no ids and decodes to NULL; the empty text has zero ids; texts of any length and words without
any space are handled in linear time; repeated rows are encoded each; an empty table gives an empty table; other columns
are ignored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from tablewright.llm.common import as_kind, as_text, own_names, prepare

MARK = "▁"
#: Characters of text that a task gathers before it sorts their new words.
BUFFER = 8 << 20
#: Remembered words of a task, as characters and a flat cost for each; beyond it the task starts a new memory.
MEMORY, WORD_COST = 48 << 20, 64
#: Remembered pairs of pieces.
PAIRS = 2_000_000
WORDS = re.compile(" *[^ \n]+| +|\n")


class Vocabulary:
    """Pieces with their ids and scores; a leading mark is written as a space."""

    def __init__(self, path: str, kind: str = "merges"):
        from sentencepiece import SentencePieceProcessor

        if kind not in ("merges", "unigram"):
            raise ValueError(f"unknown kind of model {kind!r}")
        model = SentencePieceProcessor(model_file=path)
        self.kind = kind
        self.pieces: dict[str, tuple[float, int]] = {}
        self.byte_ids = [0] * 256
        self.bytes_of: list[bytes] = [b""] * model.vocab_size()
        for i in range(model.vocab_size()):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.byte_ids[int(piece[3:5], 16)] = i
                self.bytes_of[i] = bytes([int(piece[3:5], 16)])
            elif not (model.is_control(i) or model.is_unknown(i)):
                written = piece.replace(MARK, " ")
                self.pieces[written] = (model.get_score(i), i)
                self.bytes_of[i] = written.encode()
        self.longest = max(map(len, self.pieces))
        self.fallback = min(s for s, _ in self.pieces.values() if s > -1e8) - 10.0
        # Only pieces that merging their own characters gives can end a prefix.
        self.whole = {p for p in self.pieces if len(p) == 1 or self.merged(p) == [p]}
        self.reach: dict[str, int] = {}
        for piece in self.whole:
            self.reach[piece[-2:]] = max(len(piece), self.reach.get(piece[-2:], 0))
        self.pairs: dict[tuple[str, str], bool] = {}

    def merged(self, text: str) -> list[str]:
        """A short text by the rule itself: of all neighbours that form a piece the best score merges, leftmost first."""
        parts = list(text)
        while True:
            found = [(-self.pieces[a + b][0], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in self.pieces]
            if not found:
                return parts
            _, i = min(found)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]

    def side_by_side(self, left: str, right: str) -> bool:
        """Whether the two pieces stay apart when their characters are merged."""
        stay = self.pairs.get((left, right))
        if stay is None:
            if len(self.pairs) >= PAIRS:
                self.pairs.clear()
            stay = self.pairs[left, right] = self.merged(left + right) == [left, right]
        return stay


@lru_cache(maxsize=4)
def vocabulary_of(path: str, kind: str) -> Vocabulary:
    """The vocabulary, read once by a Python worker for all its tasks."""
    return Vocabulary(path, kind)


def marked_words(text: str | None) -> list[str]:
    return WORDS.findall(" " + text) if text else []


def last_by_score(vocabulary: Vocabulary, word: str, best: list, back: list[int], end: int) -> None:
    """Adds the state of word[:end]: the largest sum of scores and where its last piece starts."""
    pieces = vocabulary.pieces
    top, at = -math.inf, end - 1
    for start in range(max(0, end - vocabulary.longest), end):
        found = pieces.get(word[start:end])
        if found is not None and best[start] + found[0] > top:
            top, at = best[start] + found[0], start
    if word[end - 1 : end] not in pieces and best[end - 1] + vocabulary.fallback > top:
        top, at = best[end - 1] + vocabulary.fallback, end - 1
    best.append(top)
    back.append(at)


def last_by_merges(vocabulary: Vocabulary, word: str, best: list, back: list[int], end: int) -> None:
    """Adds the state of word[:end]: its last piece and where that starts."""
    # No piece with these two characters at its end is longer than this reach.
    for start in range(max(0, end - vocabulary.reach.get(word[max(0, end - 2) : end], 1)), end - 1):
        piece = word[start:end]
        if piece in vocabulary.whole:
            stay = not start or vocabulary.pairs.get((best[start], piece))
            if stay or stay is None and vocabulary.side_by_side(best[start], piece):
                best.append(piece)
                back.append(start)
                return
    best.append(word[end - 1])
    back.append(end - 1)


def encode_words(vocabulary: Vocabulary, words: Iterable[str]) -> Iterator[list[int]]:
    """Ids of each word. In sorted order the words walk their trie depth-first and reuse the path's forward states."""
    pieces, add = vocabulary.pieces, last_by_merges if vocabulary.kind == "merges" else last_by_score
    best, back, last = [0.0], [0], ""
    for word in words:
        shared, most = 0, min(len(word), len(last))
        while shared < most and word[shared] == last[shared]:
            shared += 1
        del best[shared + 1 :], back[shared + 1 :]
        for end in range(shared + 1, len(word) + 1):
            add(vocabulary, word, best, back, end)
        last = word
        ids: list[int] = []
        end = len(word)
        while end:
            start = back[end]
            found = pieces.get(word[start:end])
            ids += [found[1]] if found else [vocabulary.byte_ids[b] for b in reversed(word[start:end].encode())]
            end = start
        yield ids[::-1]


def decode(vocabulary: Vocabulary, ids: Iterable[int]) -> str:
    """The text of whole-text ids: pieces in a row without the first mark."""
    return b"".join(map(vocabulary.bytes_of.__getitem__, ids)).decode()[1:]


def buffers(batches: Iterator[pd.DataFrame], size: int) -> Iterator[tuple[list, list]]:
    """Ids and texts of some ``size`` characters at a time; a longer text stands alone or ends its buffer."""
    names, texts, held = [], [], 0
    for batch in batches:
        for name, text in zip(batch["doc_id"], batch["text"]):
            names.append(name)
            texts.append(text)
            held += len(text or "")
            if held >= size:
                yield names, texts
                names, texts, held = [], [], 0
    if names:
        yield names, texts


def encode_texts(docs: DataFrame, model: str, doc_id: str = "doc_id", text: str = "text", kind: str = "merges") -> DataFrame:
    """One row per row: doc_id, ids (little-endian 32-bit numbers, NULL for a NULL text), and whether decoding gives the text back.

    ``model``: path of a SentencePiece model, found at the same place on every machine; ``kind``: ``merges`` for BPE, ``unigram``.
    """
    prepare(docs.sparkSession)
    docs = own_names(docs, doc_id=doc_id, text=text)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        vocabulary = vocabulary_of(model, kind)
        known: dict[str, bytes] = {}
        held = 0
        for names, texts in buffers(batches, BUFFER):
            if held > MEMORY:
                known, held = {}, 0
            new = sorted(set().union(*map(marked_words, texts)).difference(known))
            for word, ids in zip(new, encode_words(vocabulary, new)):
                known[word] = np.array(ids, "<u4").tobytes()
                held += len(word) + WORD_COST
            found = [None if t is None else b"".join(map(known.__getitem__, marked_words(t))) for t in texts]
            same = [t is None or decode(vocabulary, np.frombuffer(i, "<u4").tolist()) == t for t, i in zip(texts, found)]
            yield pd.DataFrame({"doc_id": names, "ids": found, "round_trip": same}, dtype=object)

    encoded = as_text(docs).mapInPandas(run, "doc_id string, ids binary, round_trip boolean")
    return as_kind(encoded, docs.schema["doc_id"].dataType.simpleString())


def decode_texts(encoded: DataFrame, model: str) -> DataFrame:
    """Texts of a table (doc_id, ids)."""
    id_kind = encoded.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        vocabulary = vocabulary_of(model, "merges")
        for batch in batches:
            texts = [None if i is None else decode(vocabulary, np.frombuffer(i, "<u4").tolist()) for i in batch["ids"]]
            yield pd.DataFrame({"doc_id": batch["doc_id"], "text": texts})

    return as_kind(as_text(encoded.select("doc_id", "ids")).mapInPandas(run, "doc_id string, text string"), id_kind)
