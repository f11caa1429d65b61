"""Chat formatting by incremental black-box rendering.

A template is only called: with the turns so far, and with one turn more. What the longer output adds is the new turn's
span; the same turn rendered with an empty text and with a mark shows where its text lies inside. A template whose longer output does
not continue the shorter one rewrites history, which is reported and not trusted. Every prefix is rendered whole, so a
task holds one conversation. A template that declares itself append-only needs no more than the last turns as history,
which bounds a task's memory and time; the declaration is checked at every turn, and breaking it is an error.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import ship

#: Turns that stay as history of a turn under an append-only template.
HISTORY_TURNS = 64
Turn = tuple[str, str]
Render = Callable[[list[Turn]], str]


@dataclass(frozen=True)
class Template:
    """Turns as ``<turn>role<text>text</turn>`` lines; a backslash guards backslashes and ``<`` inside roles and texts.

    ``append_only`` declares that a turn adds the same output behind any history.
    """

    append_only = True
    begin: str = "<turn>"
    middle: str = "<text>"
    end: str = "</turn>\n"

    @staticmethod
    def escape(value: str) -> str:
        return value.replace("\\", "\\\\").replace("<", "\\<")

    @staticmethod
    def unescape(value: str) -> str:
        out, at = [], 0
        while (cut := value.find("\\", at)) >= 0:
            out += [value[at:cut], value[cut + 1 : cut + 2]]
            at = cut + 2
        return "".join([*out, value[at:]])

    def __call__(self, turns: list[Turn]) -> str:
        return "".join(f"{self.begin}{self.escape(role)}{self.middle}{self.escape(text)}{self.end}" for role, text in turns)

    def role_of(self, head: str) -> str:
        """The role in what stands before a turn's text."""
        return self.unescape(head.removeprefix(self.begin).removesuffix(self.middle))


def common_prefix(a: str, b: str) -> int:
    """Length of the longest common prefix, by halving."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        mid = (low + high + 1) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid - 1
    return low


#: A text that marks a place; no template is expected to put it behind a text.
PROBE = "\ue000"


def text_span(added: str, empty: str, probed: str) -> tuple[int, int]:
    """Where a turn's text lies in what the turn adds, given the same turn with an empty text and with PROBE."""
    start = common_prefix(empty, probed)
    return start, len(added) - (len(empty) - start)


@dataclass(frozen=True)
class Placed:
    """A turn in the output: what it adds, and the text's place in that; ``rewrites`` when history did not stay."""

    fragment: str
    start: int
    end: int
    rewrites: bool


def place_turn(render: Render, history: list[Turn], before: str, turn: Turn) -> tuple[Placed, str]:
    """The turn behind ``history`` (whose output is ``before``), and the output with it.

    An ending that moves behind the new turn (what ``before`` has after the common prefix) is no rewriting.
    """
    after = render([*history, turn])
    kept = common_prefix(before, after)
    moved = before[kept:]
    rewrites = not after.endswith(moved) or len(after) < len(before)
    added = after[kept:]
    start, end = text_span(added, *(render([*history, (turn[0], text)])[kept:] for text in ("", PROBE)))
    return Placed(added, start, end, rewrites), after


def rewrites_history(render: Render, turns: list[Turn]) -> bool:
    """Whether any successive prefix of the turns changes what a shorter one rendered."""
    before = render([])
    for i, turn in enumerate(turns):
        placed, before = place_turn(render, turns[:i], before, turn)
        if placed.rewrites:
            return True
    return False


def sorted_turns(conversations: DataFrame) -> DataFrame:
    """Rows of one conversation in one partition, by turn, role and text (so ties have an order); nulls first and as empty."""
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")


class _Digest:
    """Running values of one conversation, all read back from the rendered output."""

    def __init__(self, conv_id: int | None, template: Render, windowed: bool):
        self.conv_id, self.template, self.windowed = conv_id, template, windowed
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()
        self.n = self.loss_chars = 0
        self.rewrites = False
        self.history: list[Turn] = []
        self.blank = self.before = template([])
        self.passed = 0  # characters of the output that the window has left behind

    @property
    def chars(self) -> int:
        return self.passed + len(self.before)

    def add(self, role: str, text: str) -> Placed:
        if self.windowed and len(self.history) >= HISTORY_TURNS:
            whole = len(self.before)
            self.history = self.history[-HISTORY_TURNS // 2 :]
            self.before = self.template(self.history)
            self.passed += whole - len(self.before)
        placed, self.before = place_turn(self.template, self.history, self.before, (role, text))
        if self.windowed and (placed.rewrites or self.blank + placed.fragment != self.template([(role, text)])):
            raise ValueError("the template declares itself append-only, but a turn's output depends on its history")
        self.history.append((role, text))
        read_role = self.template.role_of(placed.fragment[: placed.start])
        read_text = self.template.unescape(placed.fragment[placed.start : placed.end])
        self.n += 1
        self.rewrites |= placed.rewrites
        self.turns.update(f"{read_role}\n{read_text}\n".encode("utf-8", "surrogatepass"))
        if read_role == "assistant":
            self.loss.update(read_text.encode("utf-8", "surrogatepass"))
            self.loss_chars += len(read_text)
        return placed

    def row(self) -> dict:
        return {"conv_id": self.conv_id, "n_turns": self.n, "turns_sha256": self.turns.hexdigest(), "loss_chars": self.loss_chars, "loss_sha256": self.loss.hexdigest(), "formatted_chars": self.chars, "rewrites_history": self.rewrites}


_DIGEST = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()), ("rewrites_history", pa.bool_())])
_TURN = pa.schema([("conv_id", pa.int64()), ("position", pa.int64()), ("offset", pa.int64()), ("fragment", pa.string()), ("text_start", pa.int64()), ("text_end", pa.int64()), ("in_loss", pa.bool_()), ("rewrites_history", pa.bool_())])


def _walk(conversations: DataFrame, template: Template, by_turn: bool) -> DataFrame:
    ship(conversations.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: _Digest | None = None
        for batch in batches:
            out = []
            for conv_id, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text")), strict=True):
                if now is None or now.conv_id != conv_id:
                    if now is not None and not by_turn:
                        out.append(now.row())
                    now = _Digest(conv_id, template, getattr(template, "append_only", False))
                position = now.n
                placed = now.add(role, text)
                offset = now.chars - len(placed.fragment)
                if by_turn:
                    out.append({"conv_id": conv_id, "position": position, "offset": offset, "fragment": placed.fragment, "text_start": offset + placed.start, "text_end": offset + placed.end, "in_loss": role == "assistant", "rewrites_history": placed.rewrites})
            if out:
                yield pa.RecordBatch.from_pylist(out, _TURN if by_turn else _DIGEST)
        if now is not None and not by_turn:
            yield pa.RecordBatch.from_pylist([now.row()], _DIGEST)

    kind = (
        "conv_id long, position long, offset long, fragment string, text_start long, text_end long, in_loss boolean, rewrites_history boolean"
        if by_turn
        else "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, rewrites_history boolean"
    )
    return sorted_turns(conversations).mapInArrow(run, kind)


def format_turns(conversations: DataFrame, template: Template | None = None) -> DataFrame:
    """One row a turn: what it adds to the conversation's output, where its text lies there, and whether it is learned."""
    return _walk(conversations, template or Template(), True)


def digests(conversations: DataFrame, template: Template | None = None) -> DataFrame:
    """One row a conversation with what is read back from its output. Rows of a null conv_id are one conversation.

    Null roles and texts are empty; repeated turns stay, in order of role and text; texts of any length are rendered
    whole; an empty table gives an empty table; other columns are not looked at, whatever their names. formatted_chars
    is the length of the whole conversation's rendering, rewrites_history whether any longer prefix changed a shorter
    one's output. All turns of a conversation pass through one task in order, as its digests ask for.
    """
    return _walk(conversations, template or Template(), False)
