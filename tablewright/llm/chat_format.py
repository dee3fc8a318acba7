"""Chat formatting: a finite-state machine over roles and a declarative template, emitted as text segments.

Every turn becomes three segments: opening mark, text, closing mark. The loss flag of a text segment is that of its
role in the template; marks carry none. Inside texts the characters that begin a mark, and the escape character, are
followed by the escape character, so no control string can occur there and the text is recovered exactly.

The state machine reads the roles in turn order: an optional system turn, then user and assistant in turn, beginning
with the user and ending with the assistant. A conversation that breaks the order is formatted like any other and its
first offending turn is reported.

Cases: a NULL text counts as empty, a NULL role as the empty role; roles outside the template get a generic mark that
names them; turns with the same number follow by role and text; NULL turn numbers come first; rows with NULL
conversation ids form one conversation; repeated rows are turns of their own; an empty table gives no segments; other
columns are ignored. A conversation of any length is streamed through its task, never gathered.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.llm.common import as_kind, as_text, own_names, prepare

ESCAPE = "\\"


@dataclass(frozen=True)
class Mark:
    opening: str
    closing: str
    loss: bool = False


#: The template. Every mark begins with "[" or "<", directly or after one space.
TEMPLATE = {
    "system": Mark("<<SYS>> ", " <</SYS>>"),
    "user": Mark("[INST] ", " [/INST]"),
    "assistant": Mark("<s> ", "</s>", loss=True),
}
OTHER = Mark("[ROLE {}] ", " [/ROLE]")

#: State -> role -> next state. "start" and "answered" accept the end.
MACHINE = {
    "start": {"system": "told", "user": "asked"},
    "told": {"user": "asked"},
    "asked": {"assistant": "answered"},
    "answered": {"user": "asked"},
}
FINAL = ("answered",)

SEGMENTS = "conv_id {kind}, turn_no long, part int, role string, segment string, loss boolean, bad_turn long"


def escape(text: str) -> str:
    return re.sub(r"[\\\[<\]]", lambda m: m[0] + ESCAPE, text)


def unescape(text: str) -> str:
    return re.sub(r"([\\\[<\]])\\", r"\1", text)


def marks(role: str) -> tuple[str, str, bool]:
    mark = TEMPLATE.get(role)
    if mark is None:
        return OTHER.opening.format(escape(role)), OTHER.closing, False
    return mark.opening, mark.closing, mark.loss


def format_turns(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Turns of whole conversations in order to segments; a last part 3 closes each conversation with its verdict."""
    conv, state, bad, number, begun = None, "start", None, 0, False

    def close() -> tuple:
        verdict = bad if bad is not None else (None if state in FINAL else number)
        return (conv, number, 3, "", "", False, verdict)

    for batch in batches:
        rows = []
        for conv_id, role, text in zip(batch["conv_id"], batch["role"], batch["text"]):
            conv_id, role, text = (None if pd.isna(conv_id) else conv_id), role or "", text or ""
            if not begun or conv_id != conv:
                if begun:
                    rows.append(close())
                conv, state, bad, number, begun = conv_id, "start", None, 0, True
            following = MACHINE.get(state, {}).get(role)
            if following is None and bad is None:
                bad = number
            state = following or "broken"
            opening, closing, loss = marks(role)
            rows += [
                (conv, number, 0, role, opening, False, None),
                (conv, number, 1, role, escape(text), loss, None),
                (conv, number, 2, role, closing, False, None),
            ]
            number += 1
        yield frame(rows)
    if begun:
        yield frame([close()])


def frame(rows: list[tuple]) -> pd.DataFrame:
    columns = ["conv_id", "turn_no", "part", "role", "segment", "loss", "bad_turn"]
    return pd.DataFrame(rows, columns=columns).astype({"bad_turn": "Int64"})


def format_chat(conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Segments (conv_id, turn_no, part, role, segment, loss, bad_turn), each conversation in order in one partition.

    Part 0 is the opening mark, 1 the text, 2 the closing mark; part 3 ends a conversation and holds the first turn
    that broke the order (the number of turns where the end came too early, NULL where all is well).
    """
    prepare(conversations.sparkSession)
    turns = own_names(conversations, conv_id=conv_id, turn=turn, role=role, text=text)
    kind = turns.schema["conv_id"].dataType.simpleString()
    placed = turns.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    spelled = as_text(placed.select("conv_id", "role", "text"), "conv_id")
    return as_kind(spelled.mapInPandas(format_turns, SEGMENTS.format(kind="string")), kind, "conv_id")


_OPEN = re.compile(r"(<<SYS>> |\[INST\] |<s> |\[ROLE ((?:[^\]]|\]\\)*)\] )")
_ROLES = {m.opening: r for r, m in TEMPLATE.items()}


def read_back(parts: Iterator[tuple[str, bool]]) -> Iterator[tuple[str, str, str]]:
    """(role, text, text under the loss mask) of each turn, parsed from the emitted segments alone."""
    role, text, masked, inside = "", [], [], False
    closing = {m.closing for m in TEMPLATE.values()} | {OTHER.closing}
    for segment, loss in parts:
        if not inside:
            opened = _OPEN.fullmatch(segment)
            if not opened:
                raise ValueError(f"no opening mark: {segment[:40]!r}")
            role = _ROLES.get(opened[1]) if opened[2] is None else unescape(opened[2])
            text, masked, inside = [], [], True
        elif segment in closing:
            yield role, unescape("".join(text)), unescape("".join(masked))
            inside = False
        else:
            text.append(segment)
            if loss:
                masked.append(segment)


def digests(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One row per conversation, read back from its segments."""
    turns, masked = hashlib.sha256(), hashlib.sha256()
    n = loss_chars = chars = 0
    open_turn: list[tuple[str, bool]] = []
    for batch in batches:
        rows = []
        for conv_id, part, segment, loss, bad in zip(batch["conv_id"], batch["part"], batch["segment"], batch["loss"], batch["bad_turn"]):
            if part == 3:
                rows.append((conv_id, n, turns.hexdigest(), loss_chars, masked.hexdigest(), chars, None if pd.isna(bad) else int(bad)))
                turns, masked = hashlib.sha256(), hashlib.sha256()
                n = loss_chars = chars = 0
                continue
            chars += len(segment)
            open_turn.append((segment, loss))
            if part == 2:
                for role, text, under in read_back(iter(open_turn)):
                    turns.update(f"{role}\n{text}\n".encode())
                    masked.update(under.encode())
                    loss_chars += len(under)
                    n += 1
                open_turn = []
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "bad_turn"]
        yield pd.DataFrame(rows, columns=names).astype({"bad_turn": "Int64"})


def conversation_digests(segments: DataFrame) -> DataFrame:
    """Digests of :func:`format_chat`'s segments, read in the partitions and the order in which it gives them."""
    kind = segments.schema["conv_id"].dataType.simpleString()
    schema = "conv_id string, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, bad_turn long"
    return as_kind(as_text(segments, "conv_id").mapInPandas(digests, schema), kind, "conv_id")
