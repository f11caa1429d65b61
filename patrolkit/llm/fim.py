"""Fill-in-middle transformation by an event scan: one automaton finds break characters and sentinels, gaps are arithmetic.

A text is cut into units: runs that end with a break character (lines, unless told otherwise), and, with a width, pieces
of at most that many code points of a run. One Aho-Corasick automaton finds the break characters, which are the only ones
that end a run, and the sentinels, which make a text plain. Between two events nothing ends but by counting, so a run's
length alone tells how many units it holds; the running sum of these counts over the events is what a unit's number is
looked up in. A digest of the seed and the document's id draws the two cuts and the form.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._shared import free_name, utf8, with_batches

SEED = 7
#: Of a hundred documents so many are transformed, and of a hundred transformed ones so many in the form spm.
RATE, SPM = 100, 50


@dataclass(frozen=True)
class Units:
    """What ends a unit: a character of ``breaks``, which belongs to it, or ``width`` code points (None: any number)."""

    breaks: str = "\n"
    width: int | None = None

    def __post_init__(self):
        if not self.breaks.isascii() or (self.width is not None and self.width < 1):
            raise ValueError("breaks are ASCII characters and a width is at least 1")


@dataclass(frozen=True)
class Sentinels:
    """The marks of prefix, suffix and middle: three different strings of the shape ``<`` letters ``>``, so that a mark
    never begins inside another one or reaches from a part into the mark behind it."""

    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"

    def __post_init__(self):
        marks = (self.prefix, self.suffix, self.middle)
        if len(set(marks)) < 3 or not all(m[:1] == "<" and m[-1:] == ">" and m[1:-1].isalpha() for m in marks):
            raise ValueError("sentinels are three different strings like <P>")


@dataclass(frozen=True)
class Events:
    """Sparse events of a text: where runs end, the units up to each end, and the sentinels found."""

    ends: np.ndarray
    upto: np.ndarray
    marks: list[tuple[int, int]]
    width: int | None

    @property
    def units(self) -> int:
        return int(self.upto[-1]) if len(self.upto) else 0

    def offset(self, rank: int) -> int:
        """The code-point offset at which the first ``rank`` units end."""
        if rank == 0:
            return 0
        run = int(np.searchsorted(self.upto, rank))
        if self.width is None:
            return int(self.ends[run])
        before, start = (int(self.upto[run - 1]), int(self.ends[run - 1])) if run else (0, 0)
        return min(start + (rank - before) * self.width, int(self.ends[run]))


class Scanner:
    """The automaton of the break characters and sentinels."""

    def __init__(self, units: Units, sentinels: Sentinels):
        self.width, self.sentinels = units.width, sentinels
        self.automaton = ahocorasick.Automaton()
        for c in units.breaks:
            self.automaton.add_word(c, 0)
        for number, mark in enumerate((sentinels.prefix, sentinels.suffix, sentinels.middle), 1):
            self.automaton.add_word(mark, number)
        self.automaton.make_automaton()

    def __call__(self, text: str) -> Events:
        ends, marks = [], []
        for last, what in self.automaton.iter(text):
            if what:
                marks.append((last + 1 - len(self.mark(what)), what))
            else:
                ends.append(last + 1)
        if text and (not ends or ends[-1] < len(text)):
            ends.append(len(text))
        at = np.array(ends, np.int64)
        counts = np.ones(len(at), np.int64) if self.width is None else -(-np.diff(at, prepend=0) // self.width)
        return Events(at, np.cumsum(counts), marks, self.width)

    def mark(self, number: int) -> str:
        return (self.sentinels.prefix, self.sentinels.suffix, self.sentinels.middle)[number - 1]

    def restored(self, output: str, form: str) -> str:
        """The text that ``output`` was made from: its parts lie between the three sentinels, in the form's order."""
        if form == "plain":
            return output
        places = {what: at for at, what in self(output).marks}
        part = {}
        for number in (1, 2, 3):
            begin = places[number] + len(self.mark(number))
            part[number] = output[begin : min([at for at in places.values() if at > places[number]], default=len(output))]
        return part[1] + part[3] + part[2]


@dataclass(frozen=True)
class Transformed:
    units: int
    form: str
    prefix: int | None
    middle: int | None
    output: str


def draws(seed: int, doc_id: str) -> list[int]:
    """Four numbers from the digest of ``seed:doc_id``."""
    digest = hashlib.sha256(f"{seed}:{doc_id}".encode()).hexdigest()
    return [int(digest[i : i + 8], 16) for i in range(0, 32, 8)]


def transform_text(text: str, drawn: list[int], scan: Scanner, rate: int = RATE, spm: int = SPM) -> Transformed:
    found, marks = scan(text), scan.sentinels
    n = found.units
    if not text or found.marks or drawn[2] % 100 >= rate:
        return Transformed(n, "plain", None, None, text)
    low, high = (found.offset(rank) for rank in sorted((drawn[0] % (n + 1), drawn[1] % (n + 1))))
    prefix, middle, suffix = text[:low], text[low:high], text[high:]
    if drawn[3] % 100 < spm:
        output, form = f"{marks.suffix}{suffix}{marks.prefix}{prefix}{marks.middle}{middle}", "spm"
    else:
        output, form = f"{marks.prefix}{prefix}{marks.suffix}{suffix}{marks.middle}{middle}", "psm"
    return Transformed(n, form, low, high - low, output)


def _digest(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8", "surrogateescape")).hexdigest()


def _with(docs: DataFrame, fields: list[T.StructField], columns: Callable[[list[Transformed], Scanner], list[pa.Array]], text: str, doc_id: str, options: dict, keep_text: bool) -> DataFrame:
    units, sentinels = options.get("units") or Units(), options.get("sentinels") or Sentinels()
    seed, rate, spm = options.get("seed", SEED), options.get("rate", RATE), options.get("spm", SPM)
    name = free_name(docs.columns, "drawn_text")
    given = docs.withColumn(name, F.struct(F.col(f"`{text}`").alias("text"), F.col(f"`{doc_id}`").cast("string").alias("doc_id")))
    given = given.select(*[F.col(f"`{c}`") for c in docs.columns if keep_text or c != text], name)

    def make():
        scan = Scanner(units, sentinels)

        def work(column: pa.Array) -> list[pa.Array]:
            ids = column.field(1).to_pylist()
            texts = [(t or b"").decode("utf-8", "surrogateescape") for t in utf8(column.field(0))]
            return columns([transform_text(t, draws(seed, i or ""), scan, rate, spm) for t, i in zip(texts, ids, strict=True)], scan)

        return work

    return with_batches(given, name, fields, make, drop_source=True)


_COUNTS = [T.StructField("n", T.LongType()), T.StructField("form", T.StringType()), T.StructField("prefix_chars", T.LongType()), T.StructField("middle_chars", T.LongType())]


def _counts(made: list[Transformed]) -> list[pa.Array]:
    return [pa.array([m.units for m in made], pa.int64()), pa.array([m.form for m in made], pa.string()), pa.array([m.prefix for m in made], pa.int64()), pa.array([m.middle for m in made], pa.int64())]


def transform(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", *, keep_text: bool = True, **options) -> DataFrame:
    """``docs`` with n (units), form, prefix_chars, middle_chars and output, the text in its new order.

    ``options`` are units, sentinels, seed, rate and spm. Every row stays one row: repeated rows get equal results, a null
    id counts as an empty one. A null or empty text is plain and its output empty; texts of any length are scanned whole,
    one at a time when long; an empty table gives an empty table; columns that have the new names stay, and the new ones
    get underscores in front.
    """

    def columns(made: list[Transformed], _: Scanner) -> list[pa.Array]:
        return [*_counts(made), pa.array([m.output.encode("utf-8", "surrogateescape") for m in made], pa.binary()).view(pa.string())]

    return _with(docs, [*_COUNTS, T.StructField("output", T.StringType())], columns, text, doc_id, options, keep_text)


def digests(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", **options) -> DataFrame:
    """As :func:`transform`, but with the digests of the output and of the text rebuilt from it, in place of both texts."""

    def columns(made: list[Transformed], scan: Scanner) -> list[pa.Array]:
        restored = [_digest(scan.restored(m.output, m.form)) for m in made]
        return [*_counts(made), pa.array([_digest(m.output) for m in made], pa.string()), pa.array(restored, pa.string())]

    fields = [*_COUNTS, T.StructField("output_sha256", T.StringType()), T.StructField("restored_sha256", T.StringType())]
    return _with(docs, fields, columns, text, doc_id, options, False)
