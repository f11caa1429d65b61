"""SimHash near copies through an inverted index on byte positions with count filtering.

Two 64-bit fingerprints that differ in at most four bits agree in at least four of their eight positional bytes. A
posting list of one positional byte would hold 1/256 of the corpus, so each positional byte is refined by two others: a
posting is kept for each of 20 triples of positions, chosen so that any four positions hold one of them. For the pairs
of a posting the shared positional bytes are tallied, pairs under the guaranteed four are dropped, and the bits of the
rest are compared. Of a posting of many near copies only a spanning forest of its links is kept, so a group of n copies
leaves about n links and not n squared; long postings are cut into blocks, whose pairs are separate units of work.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from patrolkit.operators.components import components

from ._shared import join_hot, scratch, ship, small, utf8, with_batches, written

SHINGLE_WORDS = 4
SEED = 42
MAX_BITS = 4
BYTES = 8
#: Fingerprints of a posting that meet as a matrix of pairs; longer postings are cut into blocks of about as many.
BLOCK = 4096
#: Postings of at most so many give all their links, by whole columns of pairs.
SHORT = 16
#: A fingerprint of more than one in so many rows is joined by broadcast.
HOT_SHARE = 256
_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def position_triples() -> list[tuple[int, int, int]]:
    """Triples of byte positions such that every four positions contain one.

    Positions fall into three classes by remainder. A triple is kept when it lies in one class, or has two positions in
    a class and one in the next. Four positions in three classes always hold such a triple.
    """
    kept = []
    for triple in combinations(range(BYTES), 3):
        count = [sum(p % 3 == c for p in triple) for c in range(3)]
        if any(count[c] == 3 or (count[c] == 2 and count[(c + 1) % 3] == 1) for c in range(3)):
            kept.append(triple)
    return kept


TRIPLES = position_triples()


def fingerprint(text: bytes, width: int = SHINGLE_WORDS) -> int:
    """The 64-bit majority fingerprint of one text; zero without words."""
    words = text.translate(_LOWER).split()
    if not words:
        return 0
    joined, n, digest = b" ".join(words), len(words), xxhash.xxh64_intdigest
    if n <= width:
        return digest(joined, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    total, shingles = np.zeros(64, np.int64), n - width + 1
    for at in range(0, shingles, 4096):
        to = min(at + 4096, shingles)
        hashes = [digest(joined[a:b], SEED) for a, b in zip(starts[at:to].tolist(), ends[at + width - 1 : to + width - 1].tolist(), strict=True)]
        bits = np.unpackbits(np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        total += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(total * 2 > shingles, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, text: str = "text", name: str = "fp") -> DataFrame:
    """``docs`` without ``text``, with the fingerprint as a signed long. Null texts have no words, so zero."""

    def make():
        def work(column: pa.Array) -> list[pa.Array]:
            values = np.array([fingerprint(x) if x is not None else 0 for x in utf8(column)], dtype=np.uint64)
            return [pa.array(values.view(np.int64))]

        return work

    return with_batches(docs, text, [T.StructField(name, T.LongType())], make, drop_source=True)


def _byte(column, position: int):
    return F.shiftrightunsigned(column, 8 * position).bitwiseAND(F.lit(255))


def postings(distinct: DataFrame, fp: str = "fp") -> DataFrame:
    """``(key, fp)``: one posting for each triple of positions; its key holds the triple's number and bytes."""
    keys = []
    for number, places in enumerate(TRIPLES):
        packed = F.lit(number).cast("long")
        for p in places:
            packed = packed * 256 + _byte(F.col(fp), p)
        keys.append(packed)
    return distinct.where(F.col(fp).isNotNull()).select(F.explode(F.array(*keys)).alias("key"), F.col(fp).alias("fp"))


def tally(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many positional bytes the fingerprints share, pair by pair."""
    return (np.bitwise_xor(a, b)[..., None].view(np.uint8) == 0).sum(axis=-1, dtype=np.uint8)


def linked(a: np.ndarray, b: np.ndarray, max_bits: int) -> np.ndarray:
    """Which pairs differ in at most ``max_bits`` bits: the count filter first, then the bits of what it leaves."""
    kept = tally(a, b) >= BYTES - max_bits
    kept[kept] = np.bitwise_count(np.bitwise_xor(a, b)[kept]) <= max_bits
    return kept


def forest(left: np.ndarray, right: np.ndarray | None, max_bits: int, rows: int = 256) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect what the links within ``left`` (or between ``left`` and ``right``) connect: a spanning forest."""
    other = left if right is None else right
    close = np.empty((len(left), len(other)), bool)
    for at in range(0, len(left), rows):
        some = left[at : at + rows]
        close[at : at + rows] = linked(*np.broadcast_arrays(some[:, None], other[None]), max_bits)
    every = left if right is None else np.concatenate([left, right])
    open_ = np.ones(len(every), bool)
    src, dst = [], []
    n = len(left)
    for start in range(len(every)):
        if not open_[start]:
            continue
        open_[start] = False
        todo = [start]
        while todo:
            i = todo.pop()
            if right is None:
                found = np.flatnonzero(close[i] & open_)
            else:
                found = np.flatnonzero(close[i] & open_[n:]) + n if i < n else np.flatnonzero(close[:, i - n] & open_[:n])
            open_[found] = False
            src.append(np.full(len(found), every[i]))
            dst.append(every[found])
            todo += found.tolist()
    return (np.concatenate(src), np.concatenate(dst)) if src else (every[:0], every[:0])


def linked_fingerprints(distinct: DataFrame, fp: str = "fp", max_bits: int = MAX_BITS, block: int = BLOCK, short: int = SHORT) -> DataFrame:
    """``(src, dst)``: links of distinct fingerprints that differ in at most ``max_bits`` (four at most) bits.

    The links connect what all such pairs connect; a posting of at most ``short`` fingerprints gives all its pairs, a
    longer one a spanning forest. A posting of more than ``block`` is dealt to blocks by hash, and each pair of blocks is
    a unit of its own, so no task holds more than two blocks at once.
    """
    if not 0 <= max_bits <= MAX_BITS:
        raise ValueError(f"max_bits must be 0 to {MAX_BITS}")
    ship(distinct.sparkSession)
    index = postings(distinct, fp)
    long_ones = index.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > block)
    long_ones = written(long_ones.select(F.col("key").alias("long_key"), F.ceil(F.col("n") / block).cast("int").alias("blocks")), "long_postings")
    if long_ones.limit(1).count():
        marked = index.join(small(long_ones), F.col("key") == F.col("long_key"), "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
        own = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
        met = marked.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        units = met.select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), (F.col("own") > F.col("other")).cast("int").alias("side"), "fp")
    else:
        units = index.select("key", F.lit(0).alias("i"), F.lit(0).alias("j"), F.lit(0).alias("side"), "fp")
    order = ["key", "i", "j"]
    dealt = units.repartition(*order).sortWithinPartitions(*order, "side", "fp")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] | None = None
        for batch in batches:
            columns = [batch.column(c).to_numpy(zero_copy_only=False) for c in (*order, "side", "fp")]
            if held is not None:
                columns = [np.concatenate(pair) for pair in zip(held, columns, strict=True)]
            size = len(columns[0])
            if not size:
                continue
            fresh = np.flatnonzero(np.any([c[1:] != c[:-1] for c in columns[:3]], axis=0)) + 1
            last = int(fresh[-1]) if len(fresh) else 0
            held = [c[last:] for c in columns]
            if last:
                yield from found([c[:last] for c in columns], np.append(fresh[:-1], last))
        if held is not None:
            yield from found(held, np.array([len(held[0])]))

    def found(columns: list[np.ndarray], ends: np.ndarray) -> Iterator[pa.RecordBatch]:
        starts = np.append(0, ends[:-1])
        sizes = ends - starts
        prints, side = columns[4].view(np.uint64), columns[3]
        brief = np.repeat((sizes <= short) & (columns[1] == columns[2])[starts], sizes)
        unit = np.repeat(np.arange(len(sizes)), sizes)
        src, dst = [], []
        for apart in range(1, min(short, int(sizes.max()))):
            at = np.flatnonzero((unit[apart:] == unit[:-apart]) & brief[apart:])
            a, b = prints[at], prints[at + apart]
            kept = linked(a, b, max_bits)
            src.append(a[kept])
            dst.append(b[kept])
        for k in np.flatnonzero((sizes > 1) & ~brief[starts]).tolist():
            rows = slice(starts[k], ends[k])
            of = side[rows] == 0
            pair = columns[1][starts[k]] != columns[2][starts[k]]
            a, b = forest(prints[rows][of], prints[rows][~of] if pair else None, max_bits)
            src.append(a)
            dst.append(b)
        if src:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).view(np.int64)) for x in (src, dst)], names=["src", "dst"])

    return dealt.mapInArrow(run, "src long, dst long")


def near_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, fp, component_id, component_fp)``, one row for each row of ``docs``.

    component_id is the smallest doc_id reachable over links of at most four differing bits, itself included; null only
    where no row of the component has an id; component_fp, the component's smallest fingerprint, names it in any case. Equal fingerprints are folded first, so copies cost no pairs; an empty
    table gives an empty table; other columns are not looked at.
    """
    with scratch():
        pairs = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
        base = written(fingerprints(pairs), "fingerprints", keep=True)
        distinct = written(base.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("copies")), "distinct")
        total = distinct.agg(F.coalesce(F.sum("copies"), F.lit(0)).alias("n")).first()["n"]
        hot = [r["fp"] for r in distinct.where(F.col("copies") * HOT_SHARE > total).select("fp").collect()]  # under HOT_SHARE
        labels = components(linked_fingerprints(distinct))
        known = labels.join(distinct, labels.node == distinct.fp)
        lowest = known.groupBy("label").agg(F.min("least").alias("component_id"))
        linked = known.join(lowest, "label").select(F.col("fp").alias("linked_fp"), "component_id", F.col("label").alias("component_fp"))
        joined = distinct.join(linked, distinct.fp == linked.linked_fp, "left")
        classes = written(joined.select(F.col("fp").alias("class_fp"), F.coalesce("component_id", "least").alias("component_id"), F.coalesce("component_fp", "fp").alias("component_fp")), "classes", keep=True)
    return join_hot(base, "fp", classes, "class_fp", hot).select("doc_id", "fp", "component_id", "component_fp")


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` with one document of each component: the one of the smallest id.

    Of rows that repeat its id in one component the smallest row stays; rows of one id in several components are
    documents of their own. A component whose documents all lack an id keeps its smallest row. Columns stay; only rows
    that repeat an id, or lack one, are shuffled with their texts, pre-aggregated.
    """
    groups = written(near_copies(docs), "groups")
    repeated = written(docs.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select(F.col("doc_id").alias("repeated_id")), "repeated")
    nameless = docs.where("doc_id is null")
    twice, unnamed = bool(repeated.limit(1).count()), bool(nameless.limit(1).count())
    kept = groups.where("doc_id = component_id").select(F.col("doc_id").alias("kept_id")).distinct()
    stay = docs.join(kept, docs["doc_id"] == kept["kept_id"], "left_semi")
    if twice:
        stay = stay.join(repeated, stay["doc_id"] == repeated["repeated_id"], "left_anti")
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])

    def smallest(rows: DataFrame, best: DataFrame) -> DataFrame:
        """The smallest of the rows of each component, among those whose id and fingerprint ``best`` lists."""
        marked = fingerprints(rows.withColumn("text_to_mark", F.col("text")), "text_to_mark", "fp_to_mark")
        mark = F.col(f"`{marked.columns[-1]}`")
        keyed = marked.select(mark.alias("marked_fp"), F.col("doc_id").alias("marked_id"), whole.alias("marked_row"))
        match = (F.col("marked_fp") == F.col("best_fp")) & F.col("marked_id").eqNullSafe(F.col("best_id"))
        return keyed.join(best, match).groupBy("best_class").agg(F.min("marked_row").alias("row")).select("row.*")

    columns = [F.col("fp").alias("best_fp"), F.col("doc_id").alias("best_id"), F.col("component_fp").alias("best_class")]
    if twice:
        again = docs.join(repeated, docs["doc_id"] == repeated["repeated_id"], "left_semi")
        best = groups.where("doc_id = component_id").join(repeated, F.col("doc_id") == F.col("repeated_id"), "left_semi")
        stay = stay.unionByName(smallest(again, best.select(*columns).distinct()))
    if unnamed:
        stay = stay.unionByName(smallest(nameless, groups.where("component_id is null").select(*columns).distinct()))
    return stay.select(*[F.col(f"`{c}`") for c in docs.columns])
