"""Chat formatting: final messages from an event log, rendered with control marks."""

from __future__ import annotations

import bisect
import re
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldlark.llm.common import returns

START, END = "<|im_start|>", "<|im_end|>"
TRAINED_ROLE = "assistant"
#: Kinds after which nothing of the text before is left.
RESETS = ("message", "edit", "regenerate")
STREAMED = 4


def escape(text: str) -> str:
    """No control mark survives: `<`, backslashes, `|` gets one more backslash."""
    return re.sub(r"<(\\*)\|", r"<\\\1|", text)


def unescape(text: str) -> str:
    return re.sub(r"<\\(\\*)\|", r"<\1|", text)


def _escape_role(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def _unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


class Chat(NamedTuple):
    text: str
    loss: list[tuple[int, int]]  # code point spans of ``text`` that are trained on


def render(turns: list[tuple[str, str]]) -> Chat:
    """One block per turn: START role newline text END newline; assistant texts are masked in."""
    parts, loss, at = [], [], 0
    for role, text in turns:
        head, body = f"{START}{_escape_role(role)}\n", escape(text)
        if role == TRAINED_ROLE:
            loss.append((at + len(head), at + len(head) + len(body)))
        parts += [head, body, f"{END}\n"]
        at += len(head) + len(body) + len(END) + 1
    return Chat("".join(parts), loss)


def parse(text: str) -> list[tuple[str, str]]:
    """The turns of a rendered conversation."""
    turns = []
    for block in text.split(START)[1:]:
        head, _, body = block.partition("\n")
        turns.append((_unescape_role(head), unescape(body[: -len(END) - 1])))
    return turns


class _Message:
    __slots__ = ("turn", "role", "parts")

    def __init__(self, turn: tuple):
        self.turn, self.role, self.parts = turn, None, []


def fold(events: list[dict]) -> list[tuple[str, str]]:
    """Events of one conversation, in order -> its final turns (role, text).

    ``message`` gives a message its whole text, ``delta`` appends a streamed piece, ``edit``
    replaces the text so far and takes back all messages of later turns, ``regenerate``
    empties the text for the deltas that follow.  The first role given to a message stays.
    Turns are in order of their number; messages that tie in it in order of role and text.
    """
    live: dict = {}
    order: list[tuple] = []  # (turn, message) of the live messages, sorted by turn
    for e in events:
        turn = (e["turn"] is not None, e["turn"] or 0)
        m = live.get(e["message"])
        if m is None:
            m = live[e["message"]] = _Message(turn)
            bisect.insort(order, (turn, e["message"]), key=lambda x: x[0])
        if m.role is None:
            m.role = e["role"]
        if e["kind"] in RESETS:
            m.parts.clear()
        if e["kind"] != "regenerate" and e["text"]:
            m.parts.append(e["text"])
        if e["kind"] == "edit":
            while order[-1][0] > m.turn:
                del live[order.pop()[1]]
    done = sorted((m.turn, m.role or "", "".join(m.parts)) for m in live.values())
    return [(role, text) for _, role, text in done]


def _render_batches(batches):
    for b in batches:
        turns, texts, losses = [], [], []
        for k in range(b.num_rows):
            final = fold(b.column(1)[k].as_py())
            chat = render(final)
            turns.append(len(final))
            texts.append(chat.text)
            losses.append([{"start": a, "end": z} for a, z in chat.loss])
        span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(turns, pa.int64()), pa.array(texts, pa.string()), pa.array(losses, span)], names=["conv", "n_turns", "formatted", "loss"])


def format_chats(events: DataFrame) -> DataFrame:
    """Fold an event log into conversations and render each one.

    Columns: conv, seq (any ordered type), turn (a whole number), kind, role, text and, where
    a turn can have several messages, message (its name within the conversation).
    Returns (conv, ``n_turns``, ``formatted``, ``loss``: code point spans of assistant texts).

    Plan: one shuffle, by conversation; the log of a conversation is gathered with map-side
    aggregation, sorted by sequence and folded where it is, for its result is one row too.

    Edge cases: a null text is empty, a null role is the empty role, a null
    conversation is a conversation of its own, a null turn comes first; events that tie in
    ``seq`` are ordered by turn, message, text, kind and role; control marks, newlines in
    roles and texts of any length round-trip; unknown kinds append like a delta; an empty
    log gives an empty table; other columns are ignored.
    """
    message = "message" if "message" in events.columns else "turn"
    row = F.struct("seq", F.col("turn").cast("bigint").alias("turn"), F.col(message).alias("message"), "text", "kind", "role")
    gathered = events.groupBy("conv").agg(F.array_sort(F.collect_list(row)).alias("log"))
    log = F.transform("log", lambda e: F.struct(e["turn"].alias("turn"), e["message"].alias("message"), e["text"].alias("text"), e["kind"].alias("kind"), e["role"].alias("role")))
    gathered = gathered.select("conv", log.alias("log"))
    return gathered.mapInArrow(_render_batches, returns("n_turns bigint, formatted string, loss array<struct<start:bigint,end:bigint>>", conv=gathered.schema["conv"].dataType))


def rows_as_events(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """A table of finished turns as the log of a session that ends with them.

    An assistant's text is begun, regenerated and streamed in up to STREAMED deltas; any other
    is sent as a draft and edited.  Rows that tie in their turn are messages of their own.
    """
    r = rows.select(
        F.col(conv).alias("conv"), F.col(turn).cast("bigint").alias("turn"), F.coalesce(role, F.lit("")).alias("role"), F.coalesce(text, F.lit("")).alias("text"), F.monotonically_increasing_id().alias("message")
    )
    event = lambda kind, said: F.struct(F.lit(kind).alias("kind"), said.alias("text"))
    length = F.greatest(F.char_length("text"), F.lit(1))
    piece = F.ceil(length / STREAMED).cast("int")
    pieces = F.transform(F.sequence(F.lit(1), length, piece), lambda at: event("delta", F.substring("text", at, piece)))
    draft = F.substring("text", 1, 16)
    streamed = F.concat(F.array(event("delta", draft), event("regenerate", F.lit(None).cast("string"))), pieces)
    log = F.when(F.col("role") == TRAINED_ROLE, streamed).otherwise(F.array(event("message", draft), event("edit", F.col("text"))))
    each = r.select("conv", "turn", "message", "role", F.posexplode(log).alias("k", "e"))
    return each.select("conv", F.struct("turn", "k").alias("seq"), "turn", "message", "e.kind", "role", "e.text")
