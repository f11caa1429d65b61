"""Largest inner products by vantage-point trees, one for each shard of the vectors.

Inner products become distances by one more component: a vector gets sqrt(M^2 - |x|^2), M being the largest norm, a query
gets 0; then |q - x|^2 = |q|^2 + M^2 - 2 q.x, and the triangle inequality bounds what a shard or a subtree can hold.
Shards are metric: each vector lies in the shard of its nearest pivot, with the shard's least and largest distance to it.
A query searches the shard of its nearest pivot first; its k-th best score there then leaves out every shard, and every
subtree of the others, whose bound, times ``factor``, exceeds the distance of that score: one is exact, more leaves out
more. A block of queries walks a tree together, each node with the queries that still need it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._shared import ship, written

#: Vectors in a shard (about; one pivot each, so the driver holds one vector in that many), queries in a block of
#: queries, and points in a leaf.
SHARD_ROWS = 8192
BLOCK_QUERIES = 65_536
LEAF = 64
NEIGHBOURS = 20
#: Measured recall of the 20 nearest on 10,256 vectors of 64 components: 1.0 at factor 1, over 0.99 up to 4, 0.88 at 8.
FACTOR = 1.5
#: Rounding that the bounds allow for.
_SLACK = 1e-9


class VantageTree:
    """A tree over the rows of ``vectors`` (double)."""

    def __init__(self, vectors: np.ndarray, leaf: int = LEAF, seed: int = 3):
        norms = (vectors * vectors).sum(axis=1)
        self.top = float(norms.max()) if len(norms) else 0.0
        self.visited = 0  # pairs of a query and a point that were compared
        self.points = np.hstack([vectors, np.sqrt(np.maximum(0.0, self.top - norms))[:, None]])
        self.nodes: list[tuple] = []  # ("leaf", rows) or ("split", vantage row, near child, its range, far child, its range)
        draw = np.random.default_rng(seed)
        order = np.arange(len(vectors))
        todo = [(order, -1, 0)]
        while todo:
            rows, parent, side = todo.pop()
            at = len(self.nodes)
            if parent >= 0:
                self.nodes[parent][2 + 2 * side] = at
            if len(rows) <= leaf:
                self.nodes.append(["leaf", rows])
                continue
            pick = int(draw.integers(len(rows)))
            vantage, rest = rows[pick], np.delete(rows, pick)
            d = self._distance(self.points[vantage][None], self.points[rest])[0]
            middle = np.argpartition(d, len(d) // 2)
            near, far = middle[: len(d) // 2], middle[len(d) // 2 :]
            self.nodes.append(["split", vantage, -1, (d[near].min(), d[near].max()), -1, (d[far].min(), d[far].max())])
            todo += [(rest[far], at, 1), (rest[near], at, 0)]

    @staticmethod
    def _distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        square = (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None] - 2 * a @ b.T
        return np.sqrt(np.maximum(square, 0.0))

    def candidates(self, queries: np.ndarray, k: int, factor: float, floor: np.ndarray | None = None) -> list[np.ndarray]:
        """For each query the rows found that may be among its k nearest; with factor one none of those is missing.

        ``floor`` is the score that the query's k-th best has elsewhere; less is not asked for.
        """
        asked = np.hstack([queries, np.zeros((len(queries), 1))])
        best = np.full((len(asked), k), np.inf)  # the k least distances met so far
        if floor is not None:
            best[:] = np.sqrt(np.maximum(0.0, (queries * queries).sum(axis=1) + self.top - 2 * floor))[:, None] + _SLACK * (1 + self.top)
        found: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in asked]

        def meet(who: np.ndarray, rows: np.ndarray) -> None:
            d = self._distance(asked[who], self.points[rows])
            self.visited += d.size
            both = np.hstack([best[who], d])
            best[who] = np.partition(both, k - 1, axis=1)[:, :k] if both.shape[1] > k else both
            keep = d <= best[who].max(axis=1)[:, None] + _SLACK * (1 + self.top)
            for i in np.flatnonzero(keep.any(axis=1)):
                found[who[i]].append((rows[keep[i]], d[i, keep[i]]))

        # the likeliest leaf of each query first, so that the bounds are tight from the start
        first = np.full(len(asked), -1)
        todo = [(0, np.arange(len(asked)))] if self.nodes else []
        while todo:
            at, who = todo.pop()
            node = self.nodes[at]
            if node[0] == "leaf":
                first[who] = at
                if len(node[1]):
                    meet(who, node[1])
                continue
            d = self._distance(asked[who], self.points[node[1]][None])[:, 0]
            inside = d <= (node[3][1] + node[5][0]) / 2
            todo += [(child, part) for child, part in ((node[4], who[~inside]), (node[2], who[inside])) if len(part)]
        todo = [(0, np.arange(len(asked)))] if self.nodes else []
        while todo:
            at, who = todo.pop()
            node = self.nodes[at]
            if node[0] == "leaf":
                rest = who[first[who] != at]
                if len(rest) and len(node[1]):
                    meet(rest, node[1])
                continue
            meet(who, np.array([node[1]]))
            d = self._distance(asked[who], self.points[node[1]][None])[:, 0]
            worst = best[who].max(axis=1) + _SLACK * (1 + self.top)
            for child, (low, high) in ((node[4], node[5]), (node[2], node[3])):
                bound = np.maximum(np.maximum(low - d, d - high), 0.0)
                need = who[bound * factor <= worst]
                if len(need):
                    todo.append((child, need))
        out = []
        for i, parts in enumerate(found):
            if not parts:
                out.append(np.empty(0, np.int64))
                continue
            rows, d = (np.concatenate([p[j] for p in parts]) for j in (0, 1))
            out.append(rows[d <= best[i].max() + _SLACK * (1 + self.top)])
        return out


class Shard:
    """The distinct vectors of one shard with, for each, the k + 1 least ids that hold it.

    No more copies of one vector can be among a query's k nearest: they share a score, and smaller ids come first.
    """

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int):
        order = np.lexsort((ids,))
        ids, vectors = ids[order], vectors[order]
        lone = np.concatenate([[True], ids[1:] != ids[:-1]]) if len(ids) else np.zeros(0, bool)
        ids, vectors = ids[lone], vectors[lone]
        groups: dict[bytes, list[int]] = {}
        for i, row in enumerate(vectors):
            groups.setdefault((row + 0.0).tobytes(), []).append(i)
        self.k = k
        self.owners = [ids[rows[: k + 1]] for rows in groups.values()]
        self.vectors = vectors[[rows[0] for rows in groups.values()]] if groups else vectors
        self.tree = VantageTree(self.vectors)

    def nearest(self, query_ids: np.ndarray, queries: np.ndarray, factor: float, floor: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each query ``(ids, scores)``, best first, its own id left out."""
        for i, rows in enumerate(self.tree.candidates(queries, self.k + 1, factor, floor)):
            scores = (self.vectors[rows] * queries[i]).sum(axis=1)  # one sum a pair, so that copies score alike anywhere
            ids = [self.owners[r] for r in rows]
            score = np.repeat(scores, [len(x) for x in ids])
            every = np.concatenate(ids) if ids else np.empty(0, np.int64)
            other = every != query_ids[i]
            every, score = every[other], score[other]
            order = np.lexsort((every, -score))[: self.k]
            yield every[order], score[order]


def usable(vector: Column) -> Column:
    """True for vectors without null or non-finite components that are not zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


class Pivots:
    """Pivots in the space of one more component, ``top`` being the largest squared norm of all vectors."""

    def __init__(self, vectors: np.ndarray, top: float):
        self.top = top
        self.points = self.lifted(vectors)

    def lifted(self, vectors: np.ndarray) -> np.ndarray:
        return np.hstack([vectors, np.sqrt(np.maximum(0.0, self.top - (vectors * vectors).sum(axis=1)))[:, None]])

    def distances(self, points: np.ndarray) -> np.ndarray:
        return VantageTree._distance(points, self.points)

    def visits(self, queries: np.ndarray, floor: np.ndarray, first: np.ndarray, low: np.ndarray, high: np.ndarray, factor: float) -> list[np.ndarray]:
        """For each query the shards besides ``first`` that may hold a score of ``floor``; shards without rows have low over high."""
        d = self.distances(np.hstack([queries, np.zeros((len(queries), 1))]))
        worst = np.sqrt(np.maximum(0.0, (queries * queries).sum(axis=1) + self.top - 2 * floor)) + _SLACK * (1 + self.top)
        bound = np.maximum(np.maximum(low[None] - d, d - high[None]), 0.0)
        need = (bound * factor <= worst[:, None]) & (low <= high)[None]
        need[np.arange(len(queries)), first] = False
        return [np.flatnonzero(row) for row in need]


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


#: Rows whose distances to all pivots are laid out at once.
_ROWS = 512


def _one_row_each(clean: DataFrame) -> DataFrame:
    """``clean`` with the smallest vector of each repeated id; only rows that repeat an id are shuffled."""
    again = written(clean.groupBy("vec_id").agg(F.count("*").alias("n")).where("n > 1").select(F.col("vec_id").alias("again")), "repeated_ids")
    if not again.limit(1).count():
        return clean
    lone = clean.join(again, clean.vec_id == again.again, "left_anti")
    few = clean.join(again, clean.vec_id == again.again, "left_semi").groupBy("vec_id").agg(F.min("v").alias("v"), F.max("asks").alias("asks"))
    return lone.unionByName(few.select("vec_id", "v", "asks"))


def search(vectors: DataFrame, queries: Column, *, vec_id: str = "vec_id", embedding: str = "embedding", k: int = NEIGHBOURS, factor: float = FACTOR, shard_rows: int = SHARD_ROWS, block: int = BLOCK_QUERIES) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the k largest inner products found for the rows where ``queries`` holds.

    Candidates are all usable rows of another id; score is the inner product in double precision; equal scores go to the
    smaller id. Rows with a null id take no part; of rows with one id the smallest vector counts. Vectors of another length than
    the commonest take no part. An empty table gives an empty table. Other columns are not looked at, whatever their
    names. A task holds one shard and works through a block's queries as they come; a shard that many vectors share, as
    copies do, is cut by a hash of the id into parts of about ``shard_rows``.
    """
    session = vectors.sparkSession
    ship(session)
    clean = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast("array<double>").alias("v"), F.coalesce(queries, F.lit(False)).alias("asks"))
    clean = clean.where(F.col("vec_id").isNotNull() & usable(F.col("v")))
    square = F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)
    sizes = clean.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n"), F.max(square).alias("top")).orderBy(F.desc("n"), "d").limit(1).collect()
    if not sizes:
        return session.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    d, n, top = sizes[0]["d"], sizes[0]["n"], float(sizes[0]["top"])
    clean = _one_row_each(clean.where(F.size("v") == d))

    wanted = -(-n // shard_rows)
    draw = F.pmod(F.xxhash64("vec_id", F.lit(7)), F.lit(n))
    chosen = clean.where(draw < 4 * wanted + 16).orderBy(F.xxhash64("vec_id", F.lit(7)), "vec_id").limit(wanted).select("v").collect()  # one a shard
    given = sorted({tuple(r["v"]) for r in chosen}) or [tuple([0.0] * d)]
    pivots = session.sparkContext.broadcast(Pivots(np.array(given, float), top))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = pivots.value
        for whole in batches:
            for start in range(0, whole.num_rows, _ROWS):
                batch = whole.slice(start, _ROWS)
                x = _matrix(batch.column("v"), d)
                own = held.distances(held.lifted(x))
                asked = held.distances(np.hstack([x, np.zeros((len(x), 1))]))
                shard = own.argmin(axis=1)
                more = [pa.array(shard.astype(np.int32)), pa.array(own[np.arange(len(x)), shard]), pa.array(asked.argmin(axis=1).astype(np.int32))]
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("vec_id", "v", "asks")), *more], names=["vec_id", "v", "asks", "shard", "away", "near"])

    placed = written(clean.mapInArrow(assign, "vec_id long, v array<double>, asks boolean, shard int, away double, near int"), "placed")
    held = {r["shard"]: r for r in placed.groupBy("shard").agg(F.count("*").alias("n"), F.min("away").alias("low"), F.max("away").alias("high")).collect()}  # a row a pivot
    low, high = np.full(len(given), np.inf), np.full(len(given), -np.inf)
    for s, r in held.items():
        low[s], high[s] = r["low"], r["high"]
    parts = {s: max(1, -(-2 * r["n"] // (3 * shard_rows))) for s, r in held.items()}
    no_floor = F.lit(None).cast("double").alias("floor")
    walk = lambda asked: _walk(session, placed, asked, parts, d, k, factor, block)
    first = written(walk(placed.where("asks").select("vec_id", "v", no_floor, F.array("near").alias("visits"))), "first_found")
    found = first
    if len(held) > 1 or not set(range(len(given))) <= set(held):
        floors = first.groupBy("query_id").agg(F.when(F.count("*") >= k, F.min("score")).alias("floor"))
        asking = placed.where("asks").select("vec_id", "v", "near").join(floors, F.col("vec_id") == F.col("query_id"), "left").drop("query_id")

        def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held = pivots.value
            for whole in batches:
                for start in range(0, whole.num_rows, _ROWS):
                    batch = whole.slice(start, _ROWS)
                    floor = batch.column("floor").to_numpy(zero_copy_only=False).astype(float)
                    least = np.where(np.isnan(floor), -np.inf, floor)
                    which = held.visits(_matrix(batch.column("v"), d), least, batch.column("near").to_numpy(zero_copy_only=False), low, high, factor)
                    yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("vec_id", "v", "floor")), pa.array([w.astype(np.int32) for w in which], pa.list_(pa.int32()))], names=["vec_id", "v", "floor", "visits"])

        found = first.union(walk(written(asking.mapInArrow(choose, "vec_id long, v array<double>, floor double, visits array<int>"), "visits")))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _walk(session, placed: DataFrame, asked: DataFrame, parts: dict[int, int], d: int, k: int, factor: float, block: int) -> DataFrame:
    """``(query_id, vec_id, score)``: what each query of ``asked`` finds in the shards that its ``visits`` lists."""
    counts = {r["visit"]: r["n"] for r in asked.select(F.explode("visits").alias("visit")).groupBy("visit").agg(F.count("*").alias("n")).collect()}
    plan = [(s, parts[s], max(1, -(-n // block))) for s, n in counts.items() if s in parts]
    units = sum(p * b for _, p, b in plan)
    table = F.broadcast(session.createDataFrame(plan, "visit int, parts int, blocks int"))  # a row a pivot
    spread = lambda salt, size: F.pmod(F.xxhash64("vec_id", F.lit(salt)), F.col(size)).cast("int")
    upto = lambda size: F.explode(F.sequence(F.lit(0), F.col(size) - 1))
    points = placed.select("vec_id", "v", F.col("shard").alias("visit")).join(table, "visit")
    points = points.select("visit", spread(1, "parts").alias("part"), upto("blocks").alias("block"), F.lit(0).alias("asks"), "vec_id", "v", F.lit(None).cast("double").alias("floor"))
    asks = asked.select("vec_id", "v", "floor", F.explode("visits").alias("visit")).join(table, "visit")
    asks = asks.select("visit", upto("parts").alias("part"), spread(2, "blocks").alias("block"), F.lit(1).alias("asks"), "vec_id", "v", "floor")
    order = ["visit", "part", "block", "asks"]
    dealt = points.union(asks).repartition(max(1, min(units, 20_000)), *order[:3]).sortWithinPartitions(*order, "vec_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ids, rows, shard = None, [], [], None
        for batch in batches:
            flat = _matrix(batch.column("v"), d)
            own = batch.column("vec_id").to_numpy(zero_copy_only=False)
            floor = batch.column("floor").to_numpy(zero_copy_only=False).astype(float)
            floor = np.where(np.isnan(floor), -np.inf, floor)
            keys = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in order], axis=1)
            cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), len(keys)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if a == b:
                    continue
                if tuple(keys[a, :3]) != key:
                    key, ids, rows, shard = tuple(keys[a, :3]), [], [], None
                if not keys[a, 3]:
                    ids.append(own[a:b])
                    rows.append(flat[a:b])
                    continue
                if shard is None:
                    if not ids:
                        continue
                    shard = Shard(np.concatenate(ids), np.concatenate(rows), k)
                for start in range(a, b, 512):
                    part = slice(start, min(b, start + 512))
                    got = list(shard.nearest(own[part], flat[part], factor, floor[part]))
                    who = np.repeat(own[part], [len(g[0]) for g in got])
                    yield pa.RecordBatch.from_arrays([pa.array(who, pa.int64()), pa.array(np.concatenate([g[0] for g in got]), pa.int64()), pa.array(np.concatenate([g[1] for g in got]), pa.float64())], names=["query_id", "vec_id", "score"])

    return dealt.mapInArrow(run, "query_id long, vec_id long, score double")
