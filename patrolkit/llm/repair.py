"""Conversation structure repair by bucket-queue shortest paths, with the edits that lead there as an audit.

A conversation's rows are letters, its legal forms ``(s?(ua)+)?`` an automaton of four states, and a node is a place
between rows with a state. Keeping, rerolling, deleting and inserting are arcs with costs of 0 to 3, so the distance of
every node to the end comes from buckets, one for each cost (Dial's queue). A walk from the start then takes at each node
the least letter among the arcs that the distances make tight, which gives the least of the cheapest audits.

Two passes stream a conversation in order. The first sees one byte a row and leaves counts, cost and audit; the second
sees the texts behind their audit and applies it. Long conversations are taken in blocks from the end, which keep four
distances each, so no pass holds more of a conversation than a byte a row, its audit and one block.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._shared import ship

#: A place between rows: nothing yet, behind the system row, behind a user row, behind an assistant row.
START, SYSTEM, USER, ASSISTANT = range(4)
#: The state behind a row with the initial s, u or a (numbers 0, 1, 2) at each state, or None.
STEP = ((SYSTEM, USER, None), (None, USER, None), (None, None, ASSISTANT), (None, USER, None))
ENDS = (START, ASSISTANT)
#: What an inserted or rerolled row is at each state; the forms leave no choice.
EXPECTED = ("user", "user", "assistant", "user")
#: Costs of the edits, and what an undeleted truncated row adds.
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
#: Codes of a row: its initial (3: another one) and four times its first fault.
OTHER = 3
SOUND, BLANK, DUPLICATE, CUT = range(4)
#: Rows whose distances are held at once, and the longest conversation whose result is remembered by its codes.
BLOCK, REMEMBERED = 4_096, 64
FAR = 1 << 60
WHITE = r"\x20\x09-\x0D"


def damage(conversations: DataFrame) -> DataFrame:
    """``(conv_id, turn, role, text)`` after the damage that crc32 of ``conv_id:turn`` modulo 20 deals out.

    0 drops a row, 1 empties its text, 2 removes its full stops, exclamation and question marks, 3 repeats it, 4 makes
    its role user. A null role or text, and a null in the dealt string, is one space.
    """
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    dealt = F.pmod(F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn"))), F.lit(20))
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), space("role").alias("role"), space("text").alias("text"), dealt.alias("dealt"))
    text = F.when(F.col("dealt") == 1, "").when(F.col("dealt") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    copies = F.when(F.col("dealt") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    changed = rows.where("dealt <> 0").select("conv_id", "turn", F.when(F.col("dealt") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.explode(copies).alias("copy"))
    return changed.drop("copy")


def _reached(p: int, initial: int) -> int | None:
    return STEP[p][initial] if initial != OTHER else None


def _wanted(p: int) -> int:
    """The state behind an inserted or rerolled row."""
    return ASSISTANT if p == USER else USER


def distances(codes: bytes, ends: tuple[int, ...]) -> list[int]:
    """The least cost from each node (4 times the place, plus the state) to the end, given the states' costs there."""
    n = len(codes)
    far = [FAR] * (4 * (n + 1))
    buckets: list[list[int]] = [[] for _ in range(max(c for c in ends if c < FAR) + 1)]
    for state, cost in enumerate(ends):
        if cost < FAR:
            far[4 * n + state] = cost
            buckets[cost].append(4 * n + state)

    def relax(node: int, cost: int) -> None:
        if cost < far[node]:
            far[node] = cost
            while len(buckets) <= cost:
                buckets.append([])
            buckets[cost].append(node)

    now = 0
    while now < len(buckets):
        for node in buckets[now]:  # grows while rows are kept at no cost
            if far[node] != now:
                continue
            place, q = node >> 2, node & 3
            for p in range(4):
                if _wanted(p) == q:
                    relax(4 * place + p, now + INSERT)
            if not place:
                continue
            fault, initial = divmod(codes[place - 1], 4)
            relax(node - 4, now + DELETE)
            if fault in (BLANK, DUPLICATE):
                continue
            more = now + (TRUNCATED if fault == CUT else 0)
            for p in range(4):
                if _reached(p, initial) == q:
                    relax(4 * (place - 1) + p, more)
                if _wanted(p) == q:
                    relax(4 * (place - 1) + p, more + REROLE)
        buckets[now] = []
        now += 1
    return far


def walk(codes: bytes, far: list[int], state: int, last: bool) -> tuple[str, int]:
    """The least letters along tight arcs from the first place at ``state`` to the block's end, and the state there."""
    letters, place, n = [], 0, len(codes)
    while place < n or (last and not (far[4 * n + state] == 0 and state in ENDS)):
        here = far[4 * place + state]
        fault, initial = divmod(codes[place], 4) if place < n else (BLANK, OTHER)
        more = TRUNCATED if fault == CUT else 0
        kept, wanted = _reached(state, initial), _wanted(state)
        if place < n and far[4 * (place + 1) + state] + DELETE == here:
            letters.append("D")
            place += 1
        elif far[4 * place + wanted] + INSERT == here:
            letters.append("I")
            state = wanted
        elif fault in (SOUND, CUT) and kept is not None and far[4 * (place + 1) + kept] + more == here:
            letters.append("K")
            place, state = place + 1, kept
        else:
            letters.append("R")
            place, state = place + 1, wanted
    return "".join(letters), state


def _solve(codes: bytes, block: int) -> tuple[int, str]:
    ends: tuple[int, ...] = tuple(0 if q in ENDS else FAR for q in range(4))
    starts = list(range(0, len(codes), block)) or [0]
    behind = [ends]
    for at in reversed(starts[1:]):
        behind.append(tuple(distances(codes[at : at + block], behind[-1])[:4]))
    letters, state, cost = [], START, 0
    for at, ends in zip(starts, reversed(behind), strict=True):
        far = distances(codes[at : at + block], ends)
        cost = far[START] if at == 0 else cost
        more, state = walk(codes[at : at + block], far, state, at == starts[-1])
        letters.append(more)
    return cost, "".join(letters)


_remembered = lru_cache(1 << 16)(_solve)


def solve(codes: bytes, block: int = BLOCK) -> tuple[int, str]:
    """``(cost, audit)`` of a conversation's row codes."""
    return (_remembered if len(codes) <= REMEMBERED else _solve)(codes, block)


class _Told:
    """What the first pass gathers of one conversation."""

    def __init__(self, conv_id: int | None):
        self.conv_id, self.codes = conv_id, bytearray()
        self.least = self.most = None
        self.turns = self.illegal = 0
        self.faults = [0, 0, 0, 0]

    def add(self, turn: int | None, code: int) -> None:
        if self.codes and (self.codes[-1] & 3, code & 3) not in ((0, 1), (1, 2), (2, 1)):
            self.illegal += 1
        self.codes.append(code)
        self.faults[code >> 2] += 1
        if turn is not None and turn != self.most:  # turns come in order
            self.least = turn if self.least is None else self.least
            self.most = turn
            self.turns += 1

    def row(self) -> dict:
        cost, audit = solve(bytes(self.codes))
        gaps = 0 if self.least is None else self.most - self.least + 1 - self.turns
        return {"conv_id": self.conv_id, "counts": [gaps, *self.faults[1:], self.illegal, cost], "audit": audit}


_PLAN = pa.schema([("conv_id", pa.int64()), ("counts", pa.list_(pa.int64())), ("audit", pa.string())])
COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def _plain(conversations: DataFrame) -> DataFrame:
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    return conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), space("role"), space("text"))


def plans(conversations: DataFrame) -> DataFrame:
    """``(conv_id, counts, audit)`` for each conversation; counts are named by COUNTS.

    Rows come by turn (nulls first), role and text. A row's first fault counts: blank, duplicate (of a row that came
    before), truncated.
    """
    ship(conversations.sparkSession)
    rows = _plain(conversations).repartition("conv_id")
    seen = F.row_number().over(Window.partitionBy("conv_id", "role", "text").orderBy(F.col("turn").asc_nulls_first()))
    fault = F.when(~F.col("text").rlike(f"[^{WHITE}]"), BLANK).when(F.col("copy") > 1, DUPLICATE).when(~F.col("text").rlike(f"[.!?][{WHITE}]*\\z"), CUT).otherwise(SOUND)
    letter = F.substring("role", 1, 1)
    initial = F.when(letter == "s", 0).when(letter == "u", 1).when(letter == "a", 2).otherwise(OTHER)
    coded = rows.withColumn("copy", seen).withColumn("code", (fault * 4 + initial).cast("int"))
    ordered = coded.sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "role", "text", "copy").select("conv_id", "turn", "code")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: _Told | None = None
        for batch in batches:
            out = []
            for conv_id, turn, code in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if now is None or now.conv_id != conv_id:
                    if now is not None:
                        out.append(now.row())
                    now = _Told(conv_id)
                now.add(turn, code)
            if out:
                yield pa.RecordBatch.from_pylist(out, _PLAN)
        if now is not None:
            yield pa.RecordBatch.from_pylist([now.row()], _PLAN)

    return ordered.mapInArrow(run, "conv_id long, counts array<long>, audit string")


class _Mended:
    """A conversation's rows as they pass, edited by its audit."""

    def __init__(self, conv_id: int | None, counts: list[int], audit: str):
        self.conv_id, self.counts, self.audit = conv_id, counts, audit
        self.at, self.state, self.rows = 0, START, 0
        self.digest = hashlib.sha256()

    def _put(self, role: str, text: str, edit: str) -> dict:
        self.digest.update((("\n" if self.rows else "") + f"{role}:{text}").encode("utf-8", "surrogatepass"))
        self.rows += 1
        return {"conv_id": self.conv_id, "position": self.rows - 1, "role": role, "text": text, "edit": edit}

    def inserted(self) -> Iterator[dict]:
        while self.audit[self.at : self.at + 1] == "I":
            yield self._put(EXPECTED[self.state], "", "I")
            self.at, self.state = self.at + 1, _wanted(self.state)

    def add(self, role: str, text: str) -> Iterator[dict]:
        yield from self.inserted()
        edit = self.audit[self.at]
        self.at += 1
        if edit == "R":
            yield self._put(EXPECTED[self.state], text, edit)
            self.state = _wanted(self.state)
        elif edit == "K":
            yield self._put(role, text, edit)
            self.state = STEP[self.state]["sua".index(role[0])]

    def row(self) -> dict:
        return {"conv_id": self.conv_id, **dict(zip(COUNTS, self.counts, strict=True)), "audit": self.audit, "repaired_sha256": self.digest.hexdigest()}


_TURNS = pa.schema([("conv_id", pa.int64()), ("position", pa.int64()), ("role", pa.string()), ("text", pa.string()), ("edit", pa.string())])
_DIGESTS = pa.schema([("conv_id", pa.int64()), *((c, pa.int64()) for c in COUNTS), ("audit", pa.string()), ("repaired_sha256", pa.string())])


def _mend(conversations: DataFrame, by_turn: bool) -> DataFrame:
    told = plans(conversations).select("conv_id", F.lit(None).cast("long").alias("turn"), F.lit(None).cast("string").alias("role"), F.col("audit").alias("text"), "counts")
    rows = _plain(conversations).withColumn("counts", F.lit(None).cast("array<long>"))
    both = told.unionByName(rows).repartition("conv_id").sortWithinPartitions("conv_id", F.col("counts").isNull(), F.col("turn").asc_nulls_first(), "role", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: _Mended | None = None
        for batch in batches:
            turns, ended = [], []
            for conv_id, role, text, counts in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text", "counts")), strict=True):
                if counts is not None:
                    if now is not None:
                        turns += now.inserted()
                        ended.append(now.row())
                    now = _Mended(conv_id, counts, text)
                else:
                    turns += now.add(role, text)
            if out := turns if by_turn else ended:
                yield pa.RecordBatch.from_pylist(out, _TURNS if by_turn else _DIGESTS)
        if now is not None:
            turns = list(now.inserted())
            if out := turns if by_turn else [now.row()]:
                yield pa.RecordBatch.from_pylist(out, _TURNS if by_turn else _DIGESTS)

    kind = "conv_id long, position long, role string, text string, edit string" if by_turn else "conv_id long, " + ", ".join(f"{c} long" for c in COUNTS) + ", audit string, repaired_sha256 string"
    return both.mapInArrow(run, kind)


def repair(conversations: DataFrame) -> DataFrame:
    """``(conv_id, position, role, text, edit)``: the rows of the repaired conversations; edit is K, R or I.

    Rows of a null conv_id are one conversation; null roles and texts are one space; a role that begins with none of
    s, u and a is never kept; rows of one turn come by role and text, and null turns first; equal rows are duplicates;
    other columns are not looked at, whatever their names; an empty table gives an empty table. A conversation passes
    through one task in order, as its digest asks for, however long its texts.
    """
    return _mend(conversations, True)


def digests(conversations: DataFrame, originals: DataFrame | None = None) -> DataFrame:
    """One row a conversation: the counts of COUNTS, the audit, and the digest of the repaired rows as ``role:text`` lines.

    Conversations of ``originals`` (a table with conv_id) that have no row get zeros, no audit and the empty digest.
    Handles odd rows as :func:`repair` does.
    """
    found = _mend(conversations, False)
    if originals is None:
        return found
    every = originals.select(F.col("conv_id").cast("long").alias("original_id")).distinct()
    joined = every.join(found, F.col("original_id").eqNullSafe(F.col("conv_id")), "left")
    empty = hashlib.sha256(b"").hexdigest()
    return joined.select(F.col("original_id").alias("conv_id"), *[F.coalesce(c, F.lit(0)).alias(c) for c in COUNTS], F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(empty)).alias("repaired_sha256"))
