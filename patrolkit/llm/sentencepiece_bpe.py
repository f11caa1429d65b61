"""Encoding and decoding with merge-type SentencePiece vocabularies by a score-ordered agenda of adjacent symbol pairs.

Texts are normalised by the library and cut where no piece of the vocabulary can cross: before a run of the space mark,
and between letters and other characters when no piece holds such a neighbourhood (checked for each model). Segments are
therefore independent; each distinct one is merged once per worker process and remembered in a bounded table. The agenda is a
heap of (score, place) over a linked list of symbols. In every Arrow batch the library encodes the segments that the
batch brought anew, between marks that no piece holds; where the two differ, the library's ids stand and the rows say
so. Ids are decoded by the library.
"""

from __future__ import annotations

import hashlib
import heapq
import re
import struct
import sys
from array import array

import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ._shared import with_batches

SPACE = "▁"
#: Segments and words remembered in one worker process: at most twice as many, those last met.
MAX_SEGMENTS = 500_000
MAX_WORDS = 100_000
#: Letters that may be counted among the other characters to keep the cut exact; with more, only spaces cut.
_MAX_ODD_LETTERS = 200


class Agenda:
    """Encoder and decoder of one model."""

    def __init__(self, model: bytes):
        self.library = sentencepiece.SentencePieceProcessor(model_proto=model)
        lib = self.library
        every = range(lib.get_piece_size())
        self.pieces = [lib.id_to_piece(i) for i in every]
        plain = [i for i in every if not (lib.is_byte(i) or lib.is_control(i) or lib.is_unknown(i))]
        self.rank = {self.pieces[i]: (-lib.get_score(i), i) for i in plain}
        self.unused = {self.pieces[i] for i in plain if lib.is_unused(i)}
        self.bytes = {int(self.pieces[i][1:-1], 16): i for i in every if lib.is_byte(i)}
        self.unknown = lib.unk_id()
        self.cut = re.compile(self._cut(plain))
        self.known = _Recent(self._new_segment, MAX_SEGMENTS)
        self.words = _Recent(lambda word: self.segments(SPACE + word), MAX_WORDS)
        self.fresh: list[str] = []
        self.differing: set[str] = set()
        self.unmarked: set[str] = set()
        merged = {c for i in plain if len(self.pieces[i]) > 1 for c in self.pieces[i]}
        self.marks = [c for c in map(chr, range(1, 32)) if c not in merged and (c in self.rank or self.bytes) and c in lib.normalize(c)]

    def _cut(self, plain: list[int]) -> str:
        letter = re.compile(r"[^\W\d_]")
        near = {(a, b) for i in plain for a, b in zip(self.pieces[i], self.pieces[i][1:], strict=False)}
        self.by_words = not any(a != SPACE and b == SPACE for a, b in near)
        if not self.by_words:
            return r"(?s).+"  # spaces inside pieces: the whole text is one segment
        odd: set[str] = set()
        is_letter = lambda c: bool(letter.match(c)) and c not in odd
        while len(odd) <= _MAX_ODD_LETTERS:
            crossing = {a if is_letter(a) else b for a, b in near if SPACE not in (a, b) and is_letter(a) != is_letter(b)}
            if not crossing:
                inside = re.escape("".join(sorted(odd)))
                letters = rf"[^\W\d_{inside}]"
                others = rf"(?:(?!{letters})[^{SPACE}])" if odd else rf"[\W\d_](?<!{SPACE})"
                return rf"(?s){SPACE}*{letters}+|{SPACE}*{others}+|{SPACE}+"
            odd |= crossing
        return rf"(?s){SPACE}*[^{SPACE}]+|{SPACE}+"

    def merge(self, segment: str) -> list[int]:
        """Ids of one segment: the adjacent pair of best score (leftmost of equal ones) is merged until none is a piece."""
        rank, unused = self.rank, self.unused
        symbols = list(segment)
        n = len(symbols)
        agenda = []
        for i in range(n - 1):
            got = rank.get(symbols[i] + symbols[i + 1])
            if got is not None:
                agenda.append((got[0], i, i + 1, 2))
        halves: dict[str, tuple[str, str]] = {}
        if agenda:
            before, after = list(range(-1, n - 1)), [*range(1, n), -1]
            heapq.heapify(agenda)
            pop, push = heapq.heappop, heapq.heappush
            while agenda:
                _, left, right, size = pop(agenda)
                a, b = symbols[left], symbols[right]
                if not a or not b or len(a) + len(b) != size:
                    continue  # one of the two was merged meanwhile
                joined = symbols[left] = a + b
                symbols[right] = ""
                if joined in unused:
                    halves[joined] = (a, b)
                behind, ahead = after[right], before[left]
                after[left] = behind
                if behind >= 0:
                    before[behind] = left
                    more = joined + symbols[behind]
                    got = rank.get(more)
                    if got is not None:
                        push(agenda, (got[0], left, behind, len(more)))
                if ahead >= 0:
                    more = symbols[ahead] + joined
                    got = rank.get(more)
                    if got is not None:
                        push(agenda, (got[0], ahead, left, len(more)))
        ids: list[int] = []
        for symbol in symbols:
            if symbol:
                got = rank.get(symbol)
                if got is not None and symbol not in halves:
                    ids.append(got[1])
                else:
                    self._emit(symbol, halves, ids)
        return ids

    def _emit(self, symbol: str, halves: dict[str, tuple[str, str]], ids: list[int]) -> None:
        if symbol in halves:
            for half in halves[symbol]:
                self._emit(half, halves, ids)
        elif symbol in self.rank:
            ids.append(self.rank[symbol][1])
        elif self.bytes:
            ids.extend(self.bytes[b] for b in symbol.encode())
        else:
            ids.append(self.unknown)

    def segments(self, text: str) -> bytes:
        """Ids of a stretch that starts and ends where no piece can cross."""
        return b"".join(map(self.known.__getitem__, self.cut.findall(text)))

    def _new_segment(self, segment: str) -> bytes:
        self.fresh.append(segment)
        return little_endian(self.merge(segment))

    def encode(self, normalised: str) -> bytes:
        """Ids of a normalised text as little-endian unsigned 32-bit integers, without begin and end."""
        if self.by_words and normalised.startswith(SPACE) and SPACE + SPACE not in normalised and len(normalised) > 1 and not normalised.endswith(SPACE):
            return b"".join(map(self.words.__getitem__, normalised[1:].split(SPACE)))
        return self.segments(normalised)

    def check(self) -> bool:
        """Encodes the segments met since the last call with the library; corrects and remembers those that differ.

        Segments are checked together between marks that none of them holds. One that holds a mark is checked with
        others that lack the same one; one that holds every mark goes to ``unmarked``, and its texts are the library's.
        """
        fresh, self.fresh = self.fresh, []
        by_mark: dict[str, list[str]] = {}
        common = next((m for m in self.marks if not any(m in s for s in fresh)), None)
        for segment in fresh:
            mark = common or next((m for m in self.marks if m not in segment), None)
            if mark is None:
                self.unmarked.add(segment)
            else:
                by_mark.setdefault(mark, []).append(segment)
        fits = all([self._check_between(mark, some) for mark, some in by_mark.items()])
        self.fresh = []
        if not fits:
            self.words.clear()
        return fits

    def forget_unmarked(self) -> None:
        """Lets the segments that cannot be checked be met anew."""
        for segment in self.unmarked:
            self.known.pop(segment, None)
            self.known.old.pop(segment, None)
        self.unmarked.clear()
        self.words.clear()

    def _check_between(self, mark: str, segments: list[str]) -> bool:
        lib = self.library
        code = self.rank[mark][1] if mark in self.rank else self.bytes[ord(mark)]
        ids = lib.encode(mark + mark.join(s.replace(SPACE, " ") for s in segments) + mark)
        cuts = [i for i, v in enumerate(ids) if v == code]
        own = [self.known[s] for s in segments]
        if len(cuts) == len(segments) + 1 and b"".join(little_endian(ids[a + 1 : b]) for a, b in zip(cuts, cuts[1:], strict=False)) == b"".join(own):
            return True
        fits = True
        for segment, was in zip(segments, own, strict=True):
            alone = lib.encode(mark + segment.replace(SPACE, " ") + mark)
            inner = little_endian(alone[alone.index(code) + 1 : -1])
            if inner != was:
                self.known[segment] = inner
                self.differing.add(segment)
                fits = False
        return fits

    def decode(self, ids: list[int]) -> str:
        """The text of ids: bytes are gathered into characters, begin and end say nothing, the first space mark goes."""
        out, run = [], bytearray()
        lib, first = self.library, True
        for i in ids:
            if lib.is_byte(i):
                run.append(int(self.pieces[i][1:-1], 16))
                first = False
                continue
            if run:
                out.append(run.decode("utf-8", "replace"))
                run.clear()
            if lib.is_control(i):
                continue
            piece = " ⁇ " if lib.is_unknown(i) else self.pieces[i]
            out.append(piece.removeprefix(SPACE) if first else piece)
            first = False
        out.append(run.decode("utf-8", "replace"))
        return "".join(out).replace(SPACE, " ")


class _Recent(dict):
    """Values that ``make`` gives, kept in two generations: a full young one becomes the old one, and what is met there
    comes back."""

    def __init__(self, make, limit: int):
        super().__init__()
        self.make, self.limit, self.old = make, limit, {}

    def __missing__(self, key: str) -> bytes:
        got = self.old.get(key)
        if got is None:
            got = self.make(key)
        if len(self) >= self.limit:
            self.old = dict(self)
            dict.clear(self)
        self[key] = got
        return got

    def clear(self) -> None:
        super().clear()
        self.old = {}


def little_endian(ids: list[int]) -> bytes:
    made = array("I", ids)
    if made.itemsize != 4:
        return b"".join(i.to_bytes(4, "little") for i in ids)
    if sys.byteorder == "big":
        made.byteswap()
    return made.tobytes()


_kept: dict[str, Agenda] = {}


def agenda_for(model: bytes) -> Agenda:
    """The agenda of a model, kept with its segments while the worker process serves further tasks; one model at a time."""
    key = hashlib.sha256(model).hexdigest()
    if key not in _kept:
        _kept.clear()
        _kept[key] = Agenda(model)
    return _kept[key]


def tokens(docs: DataFrame, model_path: str, text: str = "text", *, keep_text: bool = True, keep_ids: bool = True) -> DataFrame:
    """``docs`` with n_tokens, ids_sha256, decoded_sha256, agrees and, on demand, token_ids of every row's whole text.

    Null counts as the empty text, whose ids are begin and end. ``agrees`` is false where the library's ids
    differed from the agenda's for a segment of the row; the library's are returned there. A text with a segment that
    holds every mark is encoded by the library as a whole and compared. Very long texts are slices of their own. Rows,
    repeated ones too, and other columns stay; an empty table gives an empty table; columns that have the new names
    stay, and the new ones get underscores in front.
    """
    with open(model_path, "rb") as file:
        shared = docs.sparkSession.sparkContext.broadcast(file.read())  # one model file

    def make():
        agenda = agenda_for(shared.value)
        lib = agenda.library
        native = sys.byteorder == "little" and array("I").itemsize == 4
        begin, end = little_endian([lib.bos_id()]), little_endian([lib.eos_id()])

        def work(column: pa.Array) -> list[pa.Array]:
            texts = [v or "" for v in column.to_pylist()]
            normalised = lib.normalize(texts) if texts else []
            coded = [agenda.encode(t) for t in normalised]
            fits = agenda.check()
            if not fits:
                coded = [agenda.encode(t) for t in normalised]
            wrong, unsure = agenda.differing, agenda.unmarked
            same = [not wrong or wrong.isdisjoint(agenda.cut.findall(t)) for t in normalised]
            if unsure:
                for i, t in enumerate(normalised):
                    if not unsure.isdisjoint(agenda.cut.findall(t)):
                        given = little_endian(lib.encode(texts[i]))
                        same[i], coded[i] = same[i] and given == coded[i], given
                agenda.forget_unmarked()
            coded = [begin + c + end for c in coded]
            kept = [array("I", c).tolist() if native else [i[0] for i in struct.iter_unpack("<I", c)] for c in coded]
            decoded = lib.decode(kept, num_threads=1) if texts else []
            n = [len(ids) for ids in kept]
            digests = [hashlib.sha256(c).hexdigest() for c in coded]
            texts_sha = [hashlib.sha256(d.encode("utf-8", "surrogatepass")).hexdigest() for d in decoded]
            out = [pa.array(n, pa.int64()), pa.array(digests, pa.string()), pa.array(texts_sha, pa.string()), pa.array(same, pa.bool_())]
            return [*out, pa.array(kept, pa.list_(pa.int32()))] if keep_ids else out

        return work

    fields = [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType()), T.StructField("agrees", T.BooleanType())]
    if keep_ids:
        fields.append(T.StructField("token_ids", T.ArrayType(T.IntegerType())))
    return with_batches(docs, text, fields, make, drop_source=not keep_text)
