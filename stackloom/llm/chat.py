"""Chat formatting: a finite-state machine over roles checks the order of turns and emits segments with loss flags.

A template is declared, not coded: the text before and after each turn, the roles whose texts are learnt, and the order of
roles as a table of transitions.  Control strings inside roles and texts are escaped, so that the formatted text can be
read back without loss: ``ESCAPE`` itself is doubled, and a control string gets one in front.

Conversations are dealt by id and sorted by turn; a task reads turn by turn, so even a conversation of any length is
never held as a whole.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stackloom.llm.words import tidy

ESCAPE = "\\"
START, END = "<start>", "<end>"


@dataclass(frozen=True)
class Template:
    """``{role}`` in ``before`` is the turn's role.

    ``opening``, ``role_end`` and ``closing`` are the control strings that are escaped in roles and texts: what begins a
    turn, ends its role (and ``before``) and is part of ``after``.  No two of them may overlap where template and texts meet.
    """

    before: str = "### {role}:\n"
    after: str = " </turn>\n"
    opening: str = "###"
    role_end: str = ":\n"
    closing: str = "</turn>"
    learnt: frozenset[str] = frozenset({"assistant"})
    allowed: dict[str, tuple[str, ...]] = field(
        default_factory=lambda: {
            START: ("system", "user"),
            "system": ("user",),
            "user": ("assistant",),
            "assistant": ("user", END),
        }
    )

    def escape(self, text: str) -> str:
        return self._controls().sub(lambda m: ESCAPE + m.group(), text)

    def _controls(self) -> re.Pattern:
        # looked ahead, so that control strings that overlap are all escaped
        return re.compile(re.escape(ESCAPE) + "|" + "|".join(f"(?={re.escape(c)})" for c in (self.opening, self.role_end, self.closing)))

    def unescape(self, text: str) -> str:
        return re.sub(re.escape(ESCAPE) + r"(.)", r"\1", text, flags=re.S)


class Order:
    """The state machine: feed roles, and ``problem`` is the first step that the table does not allow."""

    def __init__(self, template: Template):
        self.allowed, self.state, self.problem = template.allowed, START, None

    def feed(self, role: str) -> None:
        if self.problem is None and role not in self.allowed.get(self.state, ()):
            self.problem = f"{self.state} -> {role}"
        self.state = role


def segments_of(template: Template, role: str, text: str) -> list[tuple[str, bool]]:
    """(formatted text, is it learnt) of a turn."""
    head, _, tail = template.before.partition("{role}")
    out = [(head + template.escape(role) + tail, False), (template.escape(text), role in template.learnt), (template.after, False)]
    return [s for s in out if s[0]]


class Reader:
    """Reads formatted text back, segment by segment, into (role, text, learnt text) of each turn.

    It looks for unescaped control strings only and knows nothing of where segments begin, but for the loss mask.
    """

    def __init__(self, template: Template):
        self.template = template
        self.head = template.before.partition("{role}")[0]
        marks = "|".join(re.escape(c) for c in (template.role_end, template.closing))
        self.mark = re.compile(re.escape(ESCAPE) + f".|({marks})", re.S)
        self.buffer, self.learnt = "", ""

    def feed(self, text: str, loss: bool) -> Iterator[tuple[str, str, str]]:
        self.buffer += text
        if loss:
            self.learnt += text
        if self.buffer.endswith(self.template.after):
            role, whole = self._turn(self.buffer)
            learnt, self.buffer, self.learnt = self.template.unescape(self.learnt), "", ""
            yield role, whole, learnt

    def _turn(self, raw: str) -> tuple[str, str]:
        t = self.template
        found = [m for m in self.mark.finditer(raw) if m.group(1)]
        colon = next(m for m in found if m.group(1) == t.role_end)
        close = next(m for m in found if m.group(1) == t.closing)
        end = close.start() - t.after.index(t.closing)
        return t.unescape(raw[len(self.head) : colon.start()]), t.unescape(raw[colon.end() : end])


def _turns(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(batch.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text")), strict=True)


def format_turns(turns: Iterable[tuple], template: Template) -> Iterator[tuple]:
    """(conv_id, place, text, loss, problem) of sorted turns; ``problem`` comes with a closing row of no text."""
    conv, order, place = None, None, 0
    for conv_id, _, role, text in turns:
        if order is None or conv_id != conv:
            if order is not None:
                order.feed(END)
                yield conv, place, "", False, order.problem or ""
            conv, order, place = conv_id, Order(template), 0
        order.feed(role)
        for part, loss in segments_of(template, role, text):
            yield conv, place, part, loss, None
            place += 1
    if order is not None:
        order.feed(END)
        yield conv, place, "", False, order.problem or ""


def _sorted(conversations: DataFrame) -> DataFrame:
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")


def _batched(rows: Iterable[tuple], kinds: dict, size: int = 2048) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) >= size:
            yield _batch(held, kinds)
            held = []
    if held:
        yield _batch(held, kinds)


def _batch(rows: list[tuple], kinds: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds.values(), strict=True)], names=list(kinds))


def format_chat(conversations: DataFrame, template: Template | None = None) -> DataFrame:
    """Segments of all conversations: conv_id, place (from 0), text, loss, problem.

    The texts of a conversation in order of place are its formatted form; loss says which of them are learnt.  Each
    conversation has one more row, of no text, whose problem is the first step its roles may not take, or empty.

    Defined results: turns go by (turn, role, text), nulls first; null roles and texts are empty ones; repeated rows are
    turns of their own; rows without a conversation are one conversation; other columns are ignored.
    """
    template = template or Template()
    kinds = {"conv_id": pa.int64(), "place": pa.int64(), "text": pa.string(), "loss": pa.bool_(), "problem": pa.string()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _batched(format_turns(_turns(batches), template), kinds)

    return _sorted(conversations).mapInArrow(tidy(run), "conv_id long, place long, text string, loss boolean, problem string")


def _digests(segments: Iterable[tuple], template: Template) -> Iterator[tuple]:
    reader = Reader(template)
    turns = all_turns = learnt = None
    n = loss_chars = chars = 0
    for conv, place, text, loss, problem in segments:
        if place == 0 or all_turns is None:
            reader, all_turns, learnt, n, loss_chars, chars = Reader(template), hashlib.sha256(), hashlib.sha256(), 0, 0, 0
        chars += len(text)
        for role, whole, part in reader.feed(text, loss):
            n += 1
            all_turns.update(f"{role}\n{whole}\n".encode("utf-8", "surrogatepass"))
            learnt.update(part.encode("utf-8", "surrogatepass"))
            loss_chars += len(part)
        if problem is not None:
            yield conv, n, all_turns.hexdigest(), loss_chars, learnt.hexdigest(), chars, problem == "", problem
            all_turns = None


def chat_digest(conversations: DataFrame, template: Template | None = None) -> DataFrame:
    """Formats every conversation and reads it back: digests of its turns and of what is learnt, valid, problem."""
    template = template or Template()
    kinds = {
        "conv_id": pa.int64(),
        "n_turns": pa.int64(),
        "turns_sha256": pa.string(),
        "loss_chars": pa.int64(),
        "loss_sha256": pa.string(),
        "formatted_chars": pa.int64(),
        "valid": pa.bool_(),
        "problem": pa.string(),
    }

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _batched(_digests(format_turns(_turns(batches), template), template), kinds)

    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, valid boolean, problem string"
    return _sorted(conversations).mapInArrow(tidy(run), schema)
