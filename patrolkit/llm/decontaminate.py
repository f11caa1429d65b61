"""Benchmark decontamination: one Aho-Corasick automaton over the items' word windows, one scan of each text.

Texts and items are normalised byte by byte (A-Z lowered, other ASCII than letters and digits to spaces), so words are
the runs between spaces and every other byte stays. Each distinct word of the items becomes two symbols, digits of its
number of which the first and the second never look alike, so nodes have few children and only whole words match; all
other words share a pair that no window holds. The automaton holds every second half-window of an item, a tenth of the
nodes that whole windows take; each window contains one of them, so where one is found the windows around it are looked
up by a hash and compared word by word. Hit words keep their place among the words of the text, which gives their offsets in the original.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._shared import free_name, ship, utf8, with_batches, written

WINDOW_WORDS = 10
#: UTF-8 bytes of items that one automaton may be built from (about 30 MB of memory a MB); larger benchmarks take several.
AUTOMATON_BYTES = 8 << 20
#: Windows in a piece of an item: pieces, which overlap by a window less a word, are what is dealt to the automata.
PIECE_WINDOWS = 2_000
_TABLE = bytes(
    c + 32 if 65 <= c <= 90 else c if c >= 0x80 or 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A else 0x20 for c in range(256)
)
_RUN = re.compile(rb"[^ ]+")

#: Hit words as runs: first word, end word (exclusive), and their code-point offsets in the original text.
RUNS = T.ArrayType(T.StructType([T.StructField("first_word", T.LongType()), T.StructField("end_word", T.LongType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
_RUNS_ARROW = pa.list_(pa.struct([("first_word", pa.int64()), ("end_word", pa.int64()), ("start", pa.int64()), ("end", pa.int64())]))


@dataclass(frozen=True)
class Windows:
    """The windows of the items, as arrays of word numbers.

    ``blocks`` are the automaton's patterns, two symbols a word: every second half-window of an item, of which each window
    holds one, and whole items of fewer words than a window (with their place in ``short``, else -1; True for blocks).
    ``hashes`` are the windows' hashes in order, ``where`` the place of each in ``words``, and the owners of window i are
    ``owners[first[i]:first[i + 1]]``.
    """

    size: int
    alphabet: dict[bytes, int]
    codes: list[str]
    blocks: dict[str, tuple[bool, int]]
    short: list[tuple[str, ...]]
    words: np.ndarray
    mix: int
    hashes: np.ndarray
    where: np.ndarray
    first: np.ndarray
    owners: np.ndarray
    names: list[str | None]

    def automaton(self) -> ahocorasick.Automaton:
        made = ahocorasick.Automaton()
        for pattern, what in self.blocks.items():
            made.add_word(pattern, (len(pattern) // 2, *what))
        made.make_automaton()
        return made

    def found(self, numbers: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, set[str]]:
        """Those of the ``starts`` where a window stands, and the windows' owners; hashes are checked word by word."""
        if not len(starts) or not len(self.hashes):
            return starts[:0], set()
        hashes = _hashes(numbers, starts, self.size, self.mix)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        step = np.arange(self.size)
        same = (self.hashes[at] == hashes) & (numbers[starts[:, None] + step] == self.words[self.where[at][:, None] + step]).all(axis=1)
        ids = {self.names[j] for i in np.unique(at[same]).tolist() for j in self.owners[self.first[i] : self.first[i + 1]].tolist()}
        return starts[same], ids - {None}


#: The symbols of a word that no item holds.
_OTHER = "\x00\x00"
#: Windows that are hashed at once.
_HASHED = 200_000


def _symbols(words: int) -> list[str]:
    """Two digits for each word number from 1 on, to about the root of their number as base; number 0 is any other word."""
    base = math.isqrt(words) + 1
    digit = lambda n: chr(n if n < 0xD800 else n + 0x800)  # noqa: E731  no surrogates
    return [_OTHER, *(digit(1 + i // base) + digit(base + 2 + i % base) for i in range(words))]


def _hashes(numbers: np.ndarray, starts: np.ndarray, size: int, mix: int) -> np.ndarray:
    """64-bit hashes of the ``size`` numbers from each start on."""
    out = np.empty(len(starts), np.uint64)
    for low in range(0, len(starts), _HASHED):
        some, got = starts[low : low + _HASHED], np.uint64(mix)
        for j in range(size):
            got = (got + numbers[some + j].astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
            got = got ^ (got >> np.uint64(31))
        out[low : low + _HASHED] = got
    return out


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_TABLE).split()


def windows(items: list[tuple[object, str | None]], size: int = WINDOW_WORDS) -> Windows:
    """The windows of the items. An item without words has none; windows of a null id count for hits only."""
    alphabet: dict[bytes, int] = {}
    split, names = [], []
    for item_id, text in items:
        words = words_of((text or "").encode())
        if words:
            split.append(np.fromiter((alphabet.setdefault(w, len(alphabet) + 1) for w in words), np.int32, len(words)))
            names.append(None if item_id is None else str(item_id))
    codes = _symbols(len(alphabet))
    half = (size + 1) // 2
    blocks: dict[str, tuple[bool, int]] = {}
    short: list[set[str]] = []
    starts, owners, at = [np.empty(0, np.int64)], [np.empty(0, np.int32)], 0
    for i, numbers in enumerate(split):
        coded = "".join([codes[n] for n in numbers.tolist()])
        if len(numbers) < size:
            known = blocks.get(coded, (False, -1))
            if known[1] < 0:
                known = (known[0], len(short))
                short.append(set())
            blocks[coded] = known
            short[known[1]].update(() if names[i] is None else (names[i],))
        else:
            for low in range(0, len(coded) - 2 * half + 1, 2 * half):
                block = coded[low : low + 2 * half]
                blocks[block] = (True, blocks.get(block, (False, -1))[1])
            starts.append(np.arange(at, at + len(numbers) - size + 1))
            owners.append(np.full(len(starts[-1]), i, np.int32))
        at += len(numbers)
    words, begin, own = np.concatenate([*split, np.empty(0, np.int32)]), np.concatenate(starts), np.concatenate(owners)
    for mix in range(1, 100):  # until no two different windows have one hash
        hashes = _hashes(words, begin, size, mix)
        order = np.lexsort((own, hashes))
        new = np.append(True, hashes[order][1:] != hashes[order][:-1])[: len(order)]
        leader = order[np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))] if len(order) else order
        if all((words[begin[order] + j] == words[begin[leader] + j]).all() for j in range(size)):
            break
    once = new | np.append(True, own[order][1:] != own[order][:-1])[: len(order)]
    order, new = order[once], new[once]
    first = np.append(np.flatnonzero(new), len(order))
    return Windows(size, alphabet, codes, blocks, [tuple(sorted(s)) for s in short], words, mix, hashes[order[new]], begin[order[new]], first, own[order], names)


def scan(text: bytes, made: ahocorasick.Automaton, found: Windows) -> tuple[int, np.ndarray | None, set[str]]:
    """``(words, hit flags or None, item ids)`` of one text: the automaton runs over it once; half-windows that it finds
    tell where windows may stand."""
    words = words_of(text)
    if not words or not found.blocks:
        return len(words), None, set()
    get, codes = found.alphabet.get, found.codes
    numbers = [get(w, 0) for w in words]
    matches = list(made.iter("".join([codes[n] for n in numbers])))
    if not matches:
        return len(words), None, set()
    edge = np.zeros(len(words) + 1, np.int64)
    ids: set[str] = set()
    near: set[int] = set()
    for last, (many, block, short) in matches:
        end = last // 2 + 1
        if short >= 0:
            edge[end - many] += 1
            edge[end] -= 1
            ids.update(found.short[short])
        if block:
            near.update(range(max(0, end - found.size), min(end - many, len(words) - found.size) + 1))
    starts, more = found.found(np.array(numbers, np.int32), np.array(sorted(near), np.int64))
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + found.size, -1)
    hit = np.cumsum(edge[:-1]) > 0
    return len(words), hit if hit.any() else None, ids | more


def runs_of(text: bytes, hit: np.ndarray) -> list[dict[str, int]]:
    """Runs of hit words with code-point offsets in ``text``."""
    change = np.flatnonzero(np.diff(np.concatenate([[0], hit.astype(np.int8), [0]])))
    places = [m.span() for m in _RUN.finditer(text.translate(_TABLE))]
    out, at, passed = [], 0, 0
    for first, end in zip(change[::2].tolist(), change[1::2].tolist(), strict=True):
        begin, stop = places[first][0], places[end - 1][1]
        passed += len(text[at:begin].decode("utf-8", "replace"))
        size = len(text[begin:stop].decode("utf-8", "replace"))
        out.append({"first_word": first, "end_word": end, "start": passed, "end": passed + size})
        at, passed = stop, passed + size
    return out


def pieces(benchmark: DataFrame, size: int = WINDOW_WORDS, piece: int = PIECE_WINDOWS) -> DataFrame:
    """``(item_id, text)``: the normalised words of each item in pieces that together hold the item's windows."""
    ship(benchmark.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = [], []
            for item_id, text in zip(batch.column("item_id").to_pylist(), utf8(batch.column("text")), strict=True):
                words = words_of(text or b"")
                for at in range(0, max(1, len(words) - size + 1) if words else 0, piece):
                    ids.append(item_id)
                    texts.append(b" ".join(words[at : at + piece + size - 1]).decode())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(texts, pa.string())], names=["item_id", "text"])

    return benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text").mapInArrow(run, "item_id string, text string").distinct()


def contamination(docs: DataFrame, benchmark: DataFrame, text: str = "text", *, size: int = WINDOW_WORDS, limit: int = AUTOMATON_BYTES, keep_text: bool = True) -> DataFrame:
    """``docs`` with n_words, n_hit, n_items, items_sha256, contaminated, items and runs.

    Every row stays one row, repeated ones too. A null text has no words; a text of any length is scanned whole. Equal
    item ids (of any type, as text) count once; an item of fewer words than a window is one window; an empty benchmark hits nothing. Columns
    that have the new names stay, and the new ones get underscores in front. One automaton of at most about ``limit``
    bytes of items is sent to the tasks; a larger benchmark is dealt to several by hash, whose scans leave the hit words
    of the rows that they hit in the shared folder, one automaton at a time.
    """
    rows = pieces(benchmark, size, PIECE_WINDOWS)
    held = rows.agg(F.coalesce(F.sum(F.octet_length("text") + 32), F.lit(0)).alias("n")).first()["n"]
    if held <= limit:
        return _one_round(docs, windows([(r["item_id"], r["text"]) for r in rows.collect()], size), text, keep_text)
    return _rounds(docs, written(rows, "pieces"), -(-2 * held // limit), text, size, keep_text)


def _fields() -> list[T.StructField]:
    return [
        T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()), T.StructField("n_items", T.LongType()),
        T.StructField("items_sha256", T.StringType()), T.StructField("contaminated", T.BooleanType()),
        T.StructField("items", T.ArrayType(T.StringType())), T.StructField("runs", RUNS),
    ]


def _columns(results: list[tuple[bytes, int, np.ndarray | None, set[str]]]) -> list[pa.Array]:
    n, hits, items, digest, flags, ids, runs = [], [], [], [], [], [], []
    for text, words, hit, found in results:
        named = sorted(found)
        n.append(words)
        hits.append(0 if hit is None else int(hit.sum()))
        items.append(len(named))
        digest.append(hashlib.sha256(",".join(named).encode()).hexdigest())
        flags.append(hits[-1] > 0)
        ids.append(named)
        runs.append([] if hit is None else runs_of(text, hit))
    return [pa.array(n, pa.int64()), pa.array(hits, pa.int64()), pa.array(items, pa.int64()), pa.array(digest, pa.string()), pa.array(flags, pa.bool_()), pa.array(ids, pa.list_(pa.string())), pa.array(runs, _RUNS_ARROW)]


_built: dict[int, tuple[Windows, ahocorasick.Automaton]] = {}


def _automaton_of(shared) -> tuple[Windows, ahocorasick.Automaton | None]:
    """The automaton of a broadcast, built once in a worker process; one at a time."""
    found = shared.value
    if not found.blocks:
        return found, None
    if _built.get(id(found), (None,))[0] is not found:
        _built.clear()
        _built[id(found)] = (found, found.automaton())
    return _built[id(found)]


def _one_round(docs: DataFrame, found: Windows, text: str, keep_text: bool) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(found)  # of at most AUTOMATON_BYTES of items

    def make():
        windows_, made = _automaton_of(shared)

        def work(column: pa.Array) -> list[pa.Array]:
            return _columns([(x or b"", *scan(x or b"", made, windows_)) for x in utf8(column)])

        return work

    return with_batches(docs, text, _fields(), make, drop_source=not keep_text)


def _rounds(docs: DataFrame, rows: DataFrame, cuts: int, text: str, size: int, keep_text: bool) -> DataFrame:
    """One scan for each hashed part of the pieces; the flags and items of hit rows are joined by a row number."""
    context = docs.sparkSession.sparkContext
    row = free_name(docs.columns, "scanned_row")
    numbered = written(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
    left: DataFrame | None = None
    for cut in range(cuts):
        items = [(r["item_id"], r["text"]) for r in rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(cuts)) == cut).collect()]
        if not items:
            continue
        shared = context.broadcast(windows(items, size))

        def make(shared=shared):
            found, made = _automaton_of(shared)

            def work(column: pa.Array) -> list[pa.Array]:
                got = [scan(x or b"", made, found) for x in utf8(column)]
                flags = [None if hit is None else np.packbits(hit).tobytes() for _, hit, _ in got]
                return [pa.array(flags, pa.binary()), pa.array([sorted(ids) for *_, ids in got], pa.list_(pa.string()))]

            return work

        fields = [T.StructField("flags", T.BinaryType()), T.StructField("ids", T.ArrayType(T.StringType()))]
        hit = with_batches(numbered.select(F.col(f"`{row}`").alias("row"), F.col(f"`{text}`").alias("text")), "text", fields, make, drop_source=True)
        hit = written(hit.where("flags is not null"), "hit_rows")
        shared.destroy()
        left = hit if left is None else left.union(hit)
    name = free_name([*docs.columns, row], "scanned")
    given = numbered.withColumn(name, F.struct(F.col(f"`{text}`").alias("text"), F.array().cast("array<struct<flags:binary,ids:array<string>>>").alias("hits")))
    if left is not None:
        per_row = left.groupBy(F.col("row").alias("hit_row")).agg(F.collect_list(F.struct("flags", "ids")).alias("hits"))  # one entry an automaton
        given = numbered.join(per_row, numbered[row] == per_row["hit_row"], "left").withColumn(name, F.struct(F.col(f"`{text}`").alias("text"), "hits"))
    given = given.select(*[F.col(f"`{c}`") for c in docs.columns if keep_text or c != text], name)

    def finish():
        def work(column: pa.Array) -> list[pa.Array]:
            out = []
            for entry in column.to_pylist():
                value = (entry["text"] or "").encode()
                n, hit, ids = len(words_of(value)), None, set()
                for part in entry["hits"] or ():
                    flags = np.unpackbits(np.frombuffer(part["flags"], np.uint8))[:n].astype(bool)
                    hit = flags if hit is None else hit | flags
                    ids.update(part["ids"])
                out.append((value, n, hit, ids))
            return _columns(out)

        return work

    return with_batches(given, name, _fields(), finish, drop_source=True)
