"""Sharding by balanced label propagation: linked documents move to their neighbours' shards under byte quotas.

Documents with equal texts are linked, so a group of links is a text with its copies. Large texts, of which there can only
be few, are laid into the shards first, each whole where a place exists and else in as few shards as the rooms allow. The
documents of all smaller groups get labels by hash, in proportion to the rooms left. In every round the copies of a text
that lie outside the shard that holds most of them ask to move there; moves between two shards are swapped, and what is
left goes as far as rooms are free. Copies that meet move on as one, so the cut edges fall from round to round. When no
move is granted any more, the texts that are still split fill the rooms left, each as a whole. Documents without a link
then fill what is left of each shard, long ones first, by running totals over hashed parts of the table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._shared import gapless, join_hot, parts_for, running_total, scratch, written

SHARDS = 40
#: Bytes that each document counts besides its text.
OVERHEAD = 16
#: A document without a link is long when it exceeds this share of a shard and the mean document; long ones are placed
#: before the others, which then even out what the long ones left.
LONG_SHARE = 1 / 2000
#: A text is large when its copies exceed this share of a shard; there are at most shards / LARGE_SHARE of them.
LARGE_SHARE = 1 / 256
#: Parts of the quota windows, running totals and slots at least; more rows mean more parts of about a million rows.
PARTS = 256
#: Rows are told apart by these columns, in this order, and dealt to parts by these: by content, but for null ids.
ORDER = ("doc_id", "text_crc32", "row")
DEAL = ("doc_id", "text_crc32", "tie")
#: Rounds of label propagation at most; they end earlier when no move is granted.
ROUNDS = 8
#: Rows that ask to move from one shard to another and are dealt with by one window.
PART_ROWS = 100_000


def documents(docs: DataFrame) -> DataFrame:
    """``(doc_id, size, text_crc32, text_key, row, tie)`` for each row; a null text has no bytes, no checksum and no link."""
    return docs.select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + F.lit(OVERHEAD)).cast("long").alias("size"),
        F.crc32(F.col("text").cast("binary")).alias("text_crc32"),
        F.md5(F.col("text").cast("binary")).alias("text_key"),
        F.monotonically_increasing_id().alias("row"),
        F.when(F.col("doc_id").isNull(), F.monotonically_increasing_id()).alias("tie"),
    )


def _ranges(at: Column, bounds: list[float]) -> Column:
    """The number of inner bounds at or under ``at``."""
    out = F.lit(0)
    for bound in bounds[:-1]:
        out = out + F.when(at >= F.lit(float(bound)), 1).otherwise(0)
    return out


def _fill(rows: DataFrame, room: list[float], parts: int, order: tuple[str, ...] = ORDER, deal: tuple[str, ...] = DEAL) -> DataFrame:
    """``rows`` with ``shard``: their running total, stretched over the rooms laid end to end."""
    whole = float(rows.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("n")).first()["n"])
    free = sum(room) or 1.0
    bounds, reached = [], 0.0
    for r in room:
        reached += r
        bounds.append(reached)
    middle = (F.col("before") + F.col("size") / 2) * F.lit(free / whole if whole else 0.0)
    return running_total(rows, "size", list(order), "before", parts, list(deal)).withColumn("shard", _ranges(middle, bounds)).drop("before")


def _loads(rows: DataFrame, shards: int, weight: Column) -> list[float]:
    got = {r["shard"]: float(r["n"]) for r in rows.groupBy("shard").agg(F.sum(weight).alias("n")).collect()}
    return [got.get(k, 0.0) for k in range(shards)]


def pack(texts: list[tuple[str, int, int]], room: list[float]) -> list[tuple[str, int, int, int]]:
    """``(text_key, shard, low, high)``: the shards of the copies ``low`` to ``high`` of each ``(text_key, copies, size)``.

    Texts of most bytes come first. One that fits into a shard takes the fullest such shard, or the emptiest one if it is
    at most one copy too long for that; another one fills the emptiest shards until its remainder fits. A copy that fits
    nowhere goes to the emptiest shard. ``room`` is what is left.
    """
    out = []
    for key, copies, size in sorted(texts, key=lambda t: (-t[1] * t[2], t[0])):
        low = 0
        while low < copies:
            fits = [k for k, r in enumerate(room) if r >= (copies - low) * size]
            k = min(fits, key=lambda k: (room[k], k)) if fits else max(range(len(room)), key=lambda k: (room[k], -k))
            n = copies - low
            if not fits and n * size > room[k] + size:
                n = max(1, int(room[k] // size))
            out.append((key, k, low, low + n))
            room[k] -= n * size
            low += n
    return out


def quotas(asked: dict[tuple[int, int], float], free: list[float]) -> tuple[dict[tuple[int, int], float], list[float]]:
    """Bytes granted from shard to shard under the bytes asked for, and the rooms after that.

    Opposite requests are swapped; what is left moves into free rooms, largest first, and frees rooms for others. A swap
    leaves both loads as they are, so every shard stays under its room.
    """
    given = {(i, j): min(n, asked.get((j, i), 0.0)) for (i, j), n in asked.items()}
    free, moved = list(free), True
    while moved:
        moved = False
        for (i, j), n in sorted(asked.items(), key=lambda t: (-t[1], t[0])):
            more = min(n - given[i, j], max(0.0, free[j]))
            if more > 1.0:
                given[i, j] += more
                free[j] -= more
                free[i] += more
                moved = True
    return given, free


def _wishes(state: DataFrame) -> DataFrame:
    """``state`` with the shard that holds most copies of a row's text (a hash decides between equal ones, so that moves
    go both ways), and the row's bytes."""
    most = F.max(F.struct("n", F.xxhash64("text_key", "shard").alias("tie"), "shard")).over(Window.partitionBy("text_key"))  # a row a shard at most
    return state.select("*", most.alias("most")).select("text_key", "shard", "n", "size", F.col("most.shard").alias("wish"), (F.col("n") * F.col("size")).alias("bytes"))


def one_round(state: DataFrame, free: list[float]) -> tuple[DataFrame, int]:
    """The state after the moves that one round grants, and how many rows moved.

    Rows whose text has more copies elsewhere ask to join these. Of the bytes from one shard to another a share is
    granted: in each hashed part (of about PART_ROWS rows) by running totals, short of the share by less than a row, so
    no window spans a shard, and a swap leaves both loads as they are but for such rows.
    """
    told = written(_wishes(state), "wishes")
    sums = told.where("shard <> wish").groupBy("shard", "wish").agg(F.sum("bytes").alias("n"), F.count("*").alias("rows")).collect()  # shards squared at most
    asked = {(r["shard"], r["wish"]): float(r["n"]) for r in sums}
    parts = max([1, *(-(-r["rows"] // PART_ROWS) for r in sums)])
    given, _ = quotas(asked, free)
    shares = [(i, j, n / asked[i, j]) for (i, j), n in given.items() if n > 0]
    if not shares:
        return state, 0
    table = F.broadcast(state.sparkSession.createDataFrame(shares, "shard int, wish int, share double"))
    keys = Window.partitionBy("shard", "wish", F.pmod(F.xxhash64("text_key"), F.lit(parts)))
    upto = F.sum("bytes").over(keys.orderBy("bytes", "text_key").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    granted = (F.col("shard") != F.col("wish")) & (upto <= F.col("share") * F.sum("bytes").over(keys) + F.lit(1e-6))
    asking = told.where("shard <> wish").join(table, ["shard", "wish"], "left").withColumn("granted", F.coalesce(granted, F.lit(False)))
    rows = asking.select("text_key", F.when(F.col("granted"), F.col("wish")).otherwise(F.col("shard")).alias("shard"), "n", "size", "granted")
    rows = written(rows.unionByName(told.where("shard = wish").select("text_key", "shard", "n", "size", F.lit(False).alias("granted"))), "moved")
    after = rows.groupBy("text_key", "shard").agg(F.sum("n").alias("n"), F.max("size").alias("size"))
    return written(after, "labels", keep=True), rows.where("granted").count()


def cut_of(state: DataFrame) -> int:
    """Pairs of copies in two shards."""
    per = state.groupBy("text_key").agg(F.sum("n").alias("all"), F.sum(F.col("n") * F.col("n")).alias("square"))
    return int(per.agg(F.coalesce(F.sum((F.col("all") * F.col("all") - F.col("square")) / 2), F.lit(0.0)).alias("cut")).first()["cut"])


def propagate(state: DataFrame, room: list[float], parts: int = PARTS, rounds: int = ROUNDS, report: list[int] | None = None) -> DataFrame:
    """``(text_key, shard)``: one shard for each text of the state ``(text_key, shard, n, size)``, under the rooms.

    Rounds of moves towards the shards that hold most copies go on until none is granted or ``rounds`` were made;
    ``report`` gets the cut edges before each and after the last. The texts that are still split then fill what is left
    by running totals, long ones first, each as a whole: a shard may end half a text over its room.
    """
    shards = len(room)
    state = written(state.select("text_key", F.col("shard").cast("int").alias("shard"), "n", "size"), "labels")
    loads = lambda: _loads(state, shards, F.col("n") * F.col("size"))
    for _ in range(rounds):
        if report is not None:
            report.append(cut_of(state))
        with scratch():
            state, moved = one_round(state, [r - n for r, n in zip(room, loads(), strict=True)])
        if not moved:
            break
    if report is not None:
        report.append(cut_of(state))
    per = state.groupBy("text_key").agg(F.min("shard").alias("shard"), F.max("shard").alias("other"), F.sum(F.col("n") * F.col("size")).alias("size"))
    per = written(per, "told")
    columns = ["text_key", "size", "shard"]
    every, split = per.where("shard = other").select(*columns), per.where("shard <> other").select("text_key", "size")
    room = [r - m for r, m in zip(room, _loads(every, shards, F.col("size")), strict=True)]
    limit = sum(max(0.0, r) for r in room) / shards * LONG_SHARE
    for name, some in (("long_texts", split.where(F.col("size") > limit)), ("short_texts", split.where(F.col("size") <= limit))):
        filled = written(_fill(some, [max(0.0, r) for r in room], parts, ("text_key",), ("text_key",)).select(*columns), name)
        room = [r - m for r, m in zip(room, _loads(filled, shards, F.col("size")), strict=True)]
        every = every.union(filled)
    return every.select("text_key", "shard")


def cut_edges(placed: DataFrame, text: str = "text", shard: str = "shard") -> DataFrame:
    """One row ``(edges, cut)``: pairs of rows of equal texts, and those of them in two shards, from counts alone."""
    pairs = lambda n: n * (n - 1) / 2
    held = placed.where(F.col(text).isNotNull()).groupBy(F.md5(F.col(text).cast("binary")).alias("key"), F.col(shard).alias("at")).agg(F.count("*").alias("n"))
    per_text = held.groupBy("key").agg(pairs(F.sum("n")).alias("edges"), F.sum(pairs(F.col("n"))).alias("whole"))
    return per_text.select(F.coalesce(F.sum("edges"), F.lit(0)).cast("long").alias("edges"), F.coalesce(F.sum(F.col("edges") - F.col("whole")), F.lit(0)).cast("long").alias("cut"))


def shard(docs: DataFrame, shards: int = SHARDS, report: list[int] | None = None) -> DataFrame:
    """``(doc_id, size, text_crc32, law, shard, slot, grown_shard)``, one row for each row, by the law of even bytes.

    Repeated rows and ids stay apart (each row has its own slot); null ids and texts are rows like others; an empty
    table gives an empty table; other columns are not looked at, whatever their names. A document longer than a shard's
    share leaves its shard that much larger. ``report`` gets the cut edges of small groups by round. The result follows from the rows' contents, except that rows without an id
    are told apart by their place in the files.
    """
    with scratch():
        base = written(documents(docs), "documents")
        sums = base.agg(F.count("*").alias("rows"), F.coalesce(F.sum("size"), F.lit(0)).alias("n"), F.coalesce(F.avg("size"), F.lit(0.0)).alias("mean")).first()
        total = float(sums["n"])
        capacity, parts = total / shards, parts_for(sums["rows"], PARTS)
        copies = written(base.where("text_key is not null").groupBy(F.col("text_key").alias("copied")).agg(F.count("*").alias("copies"), F.max("size").alias("one")).where("copies > 1"), "copies")
        hot = [r["copied"] for r in copies.where(F.col("copies") * PARTS > sums["rows"]).select("copied").collect()]  # under PARTS texts
        marks = copies.select("copied")
        linked = written(join_hot(base.where("text_key is not null"), "text_key", marks, "copied", hot).drop("copied"), "with_copies")
        known = F.broadcast(docs.sparkSession.createDataFrame([(key,) for key in hot], "hot_text string"))
        lone = base.where("text_key is not null").join(known, F.col("text_key") == F.col("hot_text"), "left_anti")
        alone = written(lone.join(marks, lone.text_key == marks.copied, "left_anti").union(base.where("text_key is null")), "without_copies")

        columns = ["doc_id", "size", "text_crc32", "row", "tie", "shard"]
        cut = float(capacity * LARGE_SHARE)
        large = copies.where(F.col("copies") * F.col("one") > F.lit(cut)).collect()  # shards / LARGE_SHARE at most
        large = [(r["copied"], r["copies"], r["one"]) for r in large]
        room = [capacity] * shards
        pieces = docs.sparkSession.createDataFrame(pack(large, room), "span_key string, shard int, low long, high long")
        names = F.broadcast(docs.sparkSession.createDataFrame([(key,) for key, _, _ in large], "large_key string"))
        ranked = gapless(linked.join(names, linked.text_key == names.large_key, "left_semi"), ["text_key"], list(ORDER), "place", parts, list(DEAL))
        placed = ranked.join(F.broadcast(pieces), (ranked.text_key == pieces.span_key) & (F.col("place") >= F.col("low")) & (F.col("place") < F.col("high")))
        placed = placed.select(*columns)

        small = written(linked.join(names, linked.text_key == names.large_key, "left_anti"), "small")
        bounds, reached = [], 0.0
        for r in room:
            reached += max(0.0, r)
            bounds.append(reached)
        spread = 1 << 30
        drawn = F.pmod(F.xxhash64(*DEAL), F.lit(spread)) * F.lit(reached / spread)  # a shard by its room
        dealt = small.withColumn("shard", _ranges(drawn, bounds).cast("int"))
        state = dealt.groupBy("text_key", "shard").agg(F.count("*").alias("n"), F.max("size").alias("size"))
        told = written(propagate(state, room, parts, report=report).select(F.col("text_key").alias("told_key"), "shard"), "told_texts")
        gathered = join_hot(small, "text_key", told, "told_key", hot).select(*columns)
        placed = written(placed.union(gathered), "linked")

        room = [max(0.0, capacity - x) for x in _loads(placed, shards, F.col("size"))]
        limit = max(capacity * LONG_SHARE, float(sums["mean"]))
        long_ones = written(_fill(alone.where(F.col("size") > limit), room, parts).select(*columns), "long")
        more = _loads(long_ones, shards, F.col("size"))
        room = [max(0.0, r - m) for r, m in zip(room, more, strict=True)]
        short_ones = _fill(alone.where(F.col("size") <= limit), room, parts).select(*columns)
        every = written(placed.union(long_ones).union(short_ones), "placed", keep=True)
    slotted = gapless(every, ["shard"], list(ORDER), "slot", parts, list(DEAL))
    return slotted.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"), "slot", F.lit(None).cast("int").alias("grown_shard"))
