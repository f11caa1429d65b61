"""Mixing sources to target weights by the cube method: balanced sampling under constraints on documents and words.

A source's target over its size is how often each of its documents is wanted. The whole part is certain; the fraction is
an inclusion probability. Probabilities then move in steps through the null space of the constraints (the documents' and
the words' total stay what is expected) until each is 0 or 1. A step needs three undecided documents, so a block of a
source is left with two at most, and what blocks leave meets in fewer blocks of the next round. A source's last block
keeps a small reserve of all lengths back; what the flight leaves is landed with it: the documents' total is let go, the
words still balance, long documents first, and at last one short document is drawn; the best of a few landings counts. A
source misses its words by less than that document and its documents by a few of the reserve.

Rows that agree in source, id, size and text are one unit with a number of copies: the copies' expected number is certain
up to its fraction. Blocks are dealt by hash of units and hold about ``BLOCK`` of them, so no source fills a task.
"""

from __future__ import annotations

import random
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._shared import parts_for, scratch, ship, small, written

#: Weights of the sources by code point, repeated; the share of all words that is mixed; the most that a source and a
#: document are taken.
WEIGHTS, SHARE, MOST = (5, 2, 1), 1.0, 3
#: Units of a source that move together, and those of the last block, a few of each length, that the landing gets.
BLOCK, RESERVE = 4_096, 256
#: Landings of a source that are tried.
TRIES = 32
#: Probabilities nearer than this to 0 or 1 are decided; rows of a unit that one task writes at once.
NEAR, RUN = 1e-9, 65_536
WORD = r"[^\x20\x09-\x0D]+"


def words(text: Column) -> Column:
    """The number of words, from a copy of the text in which each is one letter."""
    marked = F.regexp_replace(text, WORD, "x")
    return F.coalesce(F.length(F.translate(marked, " \t\n\x0b\f\r", "")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """``(source, source_size, target, full)`` of the table ``(source, source_size)``, one row a source.

    Sources take the weights in turn, by code point, null last. Targets share ``share`` of all words by weight; one over
    ``most`` times its source stops there (``full``) and the excess goes to the others by weight, until none is over.
    """
    ranged = written(sizes.repartitionByRange(parts_for(sizes.count(), 1, 100_000), F.col("source").asc_nulls_last()).withColumn("part", F.spark_partition_id()), "sources")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = ranged.groupBy("part").agg(F.count("*").alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))  # a row for 100,000 sources
    inside = F.row_number().over(Window.partitionBy("part").orderBy(F.col("source").asc_nulls_last())) - 1
    at = ((F.col("base") + F.col("place")) % len(weights)).cast("int")
    ranked = ranged.withColumn("place", inside).join(F.broadcast(starts), "part")
    weighed = written(ranked.select("source", "source_size", F.get(F.array(*[F.lit(float(w)) for w in weights]), at).alias("weight")), "weighed")
    cap = F.col("source_size") * F.lit(float(most))
    level, found = None, weighed.agg(F.coalesce(F.sum("source_size"), F.lit(0)).alias("size"), F.coalesce(F.sum("weight"), F.lit(0.0)).alias("weight")).first()
    total = float(found["size"]) * share
    rest, weight = total, found["weight"]
    while weight > 0 and rest / weight != level:  # every pass stops at least one source more
        level = rest / weight
        over = F.col("weight") * F.lit(level) > cap
        found = weighed.agg(F.coalesce(F.sum(F.when(over, cap)), F.lit(0.0)).alias("stopped"), F.coalesce(F.sum(F.when(~over, F.col("weight"))), F.lit(0.0)).alias("weight")).first()
        rest, weight = total - found["stopped"], found["weight"]
    full = F.col("weight") * F.lit(level or 0.0) > cap
    return weighed.select("source", "source_size", F.when(full, cap).otherwise(F.col("weight") * F.lit(level or 0.0)).alias("target"), full.alias("full"))


def flight(units: list[tuple[float, float]], draw: random.Random) -> list[float]:
    """The probabilities of ``(size, probability)`` units after their moves; at most two stay between 0 and 1.

    Three undecided units always have a direction that changes neither their number nor their words in expectation; two
    of equal size have one too. The way along it is drawn so that every probability keeps its mean.
    """
    p = [q for _, q in units]
    sizes = [s for s, _ in units]
    active: list[int] = []
    for new in range(len(units)):
        if NEAR < p[new] < 1 - NEAR:
            active.append(new)
        while len(active) >= 2:
            moves = direction([sizes[i] for i in active])
            if moves is None:
                break
            active = step(p, active, moves, draw)
    return [0.0 if q <= NEAR else 1.0 if q >= 1 - NEAR else q for q in p]


def direction(sizes: list[float]) -> list[float] | None:
    """A vector without a sum and without words; None for two units of different sizes."""
    if len(sizes) == 2:
        return [1.0, -1.0] if sizes[0] == sizes[1] else None
    a, b, c = sizes
    return [b - c, c - a, a - b] if a != b or b != c else [1.0, -1.0, 0.0]


def step(p: list[float], active: list[int], moves: list[float], draw: random.Random) -> list[int]:
    """Moves the probabilities as far as they go, one way or the other, and returns those still undecided."""
    ahead = min(((1 - p[i]) if m > 0 else p[i]) / abs(m) for i, m in zip(active, moves, strict=True) if m)
    back = min((p[i] if m > 0 else (1 - p[i])) / abs(m) for i, m in zip(active, moves, strict=True) if m)
    way = ahead if draw.random() * (ahead + back) < back else -back
    for i, m in zip(active, moves, strict=True):
        p[i] += way * m
    return [i for i in active if NEAR < p[i] < 1 - NEAR]


def land(units: list[tuple[float, float]], p: list[float], draw: random.Random) -> list[float]:
    """Decides what is undecided: the number of documents is let go, the words still balance, long documents first, and
    the last one is drawn."""
    p, active = list(p), []
    for new in sorted((i for i, q in enumerate(p) if NEAR < q < 1 - NEAR), key=lambda i: -units[i][0]):
        active.append(new)
        if len(active) == 2:
            a, b = (units[i][0] for i in active)
            active = step(p, active, [b, -a] if a or b else [1.0, -1.0], draw)
    for i in active:
        p[i] = float(draw.random() < p[i])
    return [float(q > 0.5) for q in p]


def decide(units: list[tuple[float, float]], draw: random.Random, tries: int = TRIES) -> list[float]:
    """Zeros and ones for the last block of a source: a flight of all but a reserve of all lengths, then the landing of
    what it leaves with the reserve, whose short documents even out the words. Of ``tries`` landings the one that misses
    the words least is taken, so few documents are near their words too; a single try keeps each document's mean."""
    order = sorted(range(len(units)), key=lambda i: units[i][0])
    size = min(RESERVE, len(units) // 2)
    reserve = set(order[:: max(1, len(units) // size)] if size else ())
    flown = [i for i in range(len(units)) if i not in reserve]
    p = [q for _, q in units]
    for i, q in zip(flown, flight([units[i] for i in flown], draw), strict=True):
        p[i] = q
    miss = lambda got: abs(sum((g - q) * s for g, (s, q) in zip(got, units, strict=True)))
    return min((land(units, p, draw) for _ in range(tries)), key=miss)


_UNIT = ["source", "doc_id", "size", "text_key", "source_size", "target", "copies", "certain", "p"]


def _round(undecided: DataFrame, number: int, block: int) -> DataFrame:
    """The units with their probabilities after one round; the only block of a source lands too."""
    ship(undecided.sparkSession)
    counts = undecided.groupBy(F.col("source").alias("of")).agg(F.ceil(F.count("*") / F.lit(block)).cast("long").alias("blocks"))
    dealt = F.pmod(F.xxhash64("doc_id", "size", "text_key", F.lit(number)), F.col("blocks"))
    rows = undecided.join(small(counts), F.col("source").eqNullSafe(F.col("of"))).withColumn("block", dealt)
    kept = [*undecided.columns, "blocks", "block"]
    schema = rows.select(*kept).schema
    ordered = rows.select(*kept).repartition("source", "block").sortWithinPartitions("source", "block", F.xxhash64("doc_id", "size", "text_key", F.lit(-1)), "doc_id", "text_key")

    def settle(held: pa.Table) -> pa.RecordBatch:
        first = held.slice(0, 1).to_pylist()[0]
        draw = random.Random(f"{first['source']}/{first['block']}/{number}")
        sizes = held.column("size").to_pylist()
        units = list(zip(sizes, held.column("p").to_pylist(), strict=True))
        p = decide(units, draw) if first["blocks"] == 1 else flight(units, draw)
        held = held.set_column(held.column_names.index("p"), "p", pa.array(p, pa.float64()))
        return held.combine_chunks().to_batches()[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        now = None
        for batch in batches:
            keys = list(zip(batch.column("source").to_pylist(), batch.column("block").to_pylist(), strict=True))
            start = 0
            for at in range(1, len(keys) + 1):
                if at == len(keys) or keys[at] != keys[start]:
                    if held and now != keys[start]:
                        yield settle(pa.Table.from_batches(held))
                        held = []
                    now = keys[start]
                    held.append(batch.slice(start, at - start))
                    start = at
        if held:
            yield settle(pa.Table.from_batches(held))

    return ordered.mapInArrow(run, schema).drop("blocks", "block")


def units(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", source: str = "source") -> DataFrame:
    """``(source, doc_id, size, text_key, copies)``: rows that agree in all of these are one unit."""
    rows = docs.select(F.col(f"`{source}`").alias("source"), F.col(f"`{doc_id}`").alias("doc_id"), words(F.col(f"`{text}`")).alias("size"), F.xxhash64(F.col(f"`{text}`")).alias("text_key"))
    return rows.groupBy("source", "doc_id", "size", "text_key").agg(F.count("*").alias("copies"))


def chosen(docs: DataFrame, *, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST, block: int = BLOCK, **columns: str) -> DataFrame:
    """``(source, doc_id, size, text_key, source_size, target, copies, certain, extra)``: a unit's ``copies`` rows are
    taken ``certain`` times each, ``extra`` of them once more. The mix of :func:`plan` and :func:`mixture`."""
    with scratch():
        every = written(units(docs, **columns), "units")
        sizes = every.groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("source_size"))
        aims = targets(written(sizes, "sizes"), weights, share, most).withColumnRenamed("source", "of")
        wanted = F.when(F.col("full"), F.lit(float(most))).when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(most)))).otherwise(F.lit(0.0))
        joined = every.join(small(aims), F.col("source").eqNullSafe(F.col("of"))).withColumn("wanted", wanted)
        whole = joined.withColumn("certain", F.floor("wanted").cast("long"))
        more = whole.withColumn("more", F.col("copies") * (F.col("wanted") - F.col("certain")))
        state = written(more.withColumn("sure", F.floor(F.col("more") + NEAR).cast("long")).select(*_UNIT[:-1], "sure", F.greatest(F.lit(0.0), F.col("more") - F.col("sure")).alias("p")), "state")
        decided, left = state.where(F.col("p") <= NEAR), state.where(F.col("p") > NEAR)
        done, number = [decided.withColumn("p", F.lit(0.0))], 0
        while not left.isEmpty():
            moved = written(_round(left, number, block), f"round{number}")
            between = (F.col("p") > NEAR) & (F.col("p") < 1 - NEAR)
            done.append(moved.where(~between))
            left, number = moved.where(between), number + 1
        out = done[0]
        for part in done[1:]:
            out = out.unionByName(part)
        return written(out.select(*_UNIT[:-1], (F.col("sure") + F.round("p").cast("long")).alias("extra")), "chosen", keep=True)


def _repeated(rows: DataFrame, times: str) -> DataFrame:
    """Each row ``times`` times; numbers over RUN are cut into runs that several tasks write."""
    runs = F.ceil(F.col(times) / F.lit(RUN)).cast("long")
    few = rows.where(F.col(times).between(1, RUN)).withColumn("run", F.col(times))
    many = rows.where(F.col(times) > RUN).withColumn("at", F.explode(F.sequence(F.lit(0).cast("long"), runs - 1)))
    many = many.withColumn("run", F.least(F.lit(RUN).cast("long"), F.col(times) - F.col("at") * RUN)).repartition(*[F.col(f"`{c}`") for c in ("doc_id", "text_key", "at")]).drop("at")
    return few.unionByName(many).withColumn("again", F.explode(F.sequence(F.lit(1).cast("long"), F.col("run")))).drop("run", "again")


def plan(docs: DataFrame, **options) -> DataFrame:
    """``(doc_id, source, size, source_size, target, times, taken)``, one row for each row of ``docs``.

    ``times`` is how often the mix takes the row and ``taken`` the words this makes. Repeated rows stay apart and may be
    taken differently; null ids and sources are values like others; a null or empty text has no words, and is taken as
    documents of its source are; texts of any length are counted whole; a source without words has the target 0 and is
    not taken; an empty table gives an empty table; other columns are not looked at, whatever their names.
    """
    base = chosen(docs, **options)
    usual = base.select(*base.columns, F.col("certain").alias("times"), (F.col("copies") - F.col("extra")).alias("rows"))
    more = base.select(*base.columns, (F.col("certain") + 1).alias("times"), F.col("extra").alias("rows"))
    rows = _repeated(usual.unionByName(more), "rows")
    return rows.select("doc_id", "source", "size", "source_size", "target", "times", (F.col("times") * F.col("size")).alias("taken"))


def mixture(docs: DataFrame, text: str = "text", **options) -> DataFrame:
    """``(doc_id, source, text)``: the mixed texts, each as often as the mix takes it. Handles odd rows as :func:`plan`."""
    base = chosen(docs, text=text, **options)
    names = {"doc_id": "doc_id", "source": "source"} | {k: v for k, v in options.items() if k in ("doc_id", "source")}
    counted = base.select(*[F.col(c).alias(f"{c}__of") for c in ("doc_id", "source", "text_key")], "copies", (F.col("copies") * F.col("certain") + F.col("extra")).alias("times"))
    rows = docs.select(*[F.col(f"`{v}`").alias(k) for k, v in names.items()], F.col(f"`{text}`").alias("text"), F.xxhash64(F.col(f"`{text}`")).alias("text_key"))
    match = [F.col(c).eqNullSafe(F.col(f"{c}__of")) for c in ("doc_id", "source", "text_key")]
    single = rows.join(counted.where("copies = 1"), match).select("doc_id", "source", "text", "text_key", "times")
    several = rows.join(counted.where("copies > 1"), match, "left_semi").groupBy("doc_id", "source", "text_key").agg(F.min("text").alias("text"))
    several = several.join(counted, match).select("doc_id", "source", "text", "text_key", "times")
    return _repeated(single.unionByName(several), "times").select("doc_id", "source", "text")
