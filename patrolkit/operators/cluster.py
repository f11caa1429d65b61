"""Density clustering: exact DBSCAN (in tiles, on cells, and one period in a kernel), adaptive parameters, hashed variants."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from patrolkit.functions.geo import METRES_PER_DEGREE
from patrolkit.plans.shared_tables import BROADCAST_ROWS, scratch, ship, small, written

from .components import components
from .spatial import neighbour_counts


#: Cells have sides of eps / sqrt(2), so points of one cell are neighbours; a neighbour lies at most two cells away.
_REACH = [(dx, dy) for dx in range(-2, 3) for dy in range(-2, 3) if abs(dx) + abs(dy) < 4]


def _celled(points: DataFrame, eps: float, by: list[str]) -> DataFrame:
    """Distinct positions with weight, smallest id, and cell (nudged down, so that no rounding widens a cell)."""
    side = eps / np.sqrt(2.0) * (1 - 1e-12)
    at = points.groupBy(*by, "lon", "lat").agg(F.count("*").alias("weight"), F.min("event_id").alias("place_id"))
    return at.withColumns({"cx": F.floor(F.col("lon") / F.lit(side)), "cy": F.floor(F.col("lat") / F.lit(side))})


def _to_neighbours(rows: DataFrame, offsets: list[tuple[int, int]] = _REACH) -> DataFrame:
    """One row for each cell of a row's neighbourhood, as near_x, near_y."""
    cells = F.array(*[F.struct((F.col("cx") + dx).alias("x"), (F.col("cy") + dy).alias("y")) for dx, dy in offsets])
    return rows.withColumn("near__", F.explode(cells)).withColumns({"near_x": F.col("near__.x"), "near_y": F.col("near__.y")}).drop("near__")


def _counted(points: DataFrame, eps: float, min_samples: int | str, by: list[str]) -> DataFrame:
    """Positions with ``is_core``. All of a cell with ``min_samples`` points are cores; the points of other cells, under
    ``min_samples`` in each, are compared with their neighbourhood, so no dense cell meets itself or another one."""
    at = written(_celled(points, eps, by), "celled")
    cell_keys = [*by, "cx", "cy"]
    wanted = F.col(min_samples) if isinstance(min_samples, str) else F.lit(min_samples)
    dense = at.groupBy(*cell_keys).agg(F.sum("weight").alias("held")).where(F.col("held") >= wanted).select(*cell_keys)
    sure = at.join(dense, cell_keys, "left_semi").withColumn("is_core", F.lit(True))
    rest = at.join(dense, cell_keys, "left_anti")
    found = _near(rest, at.select(*by, "cx", "cy", F.col("lon").alias("lon2"), F.col("lat").alias("lat2"), F.col("weight").alias("weight2")), eps, by)
    counts = found.groupBy("place_id", *by).agg(F.sum("weight2").alias("n")).where(F.col("n") >= wanted).select("place_id", F.lit(True).alias("is_core"))
    decided = rest.join(counts, "place_id", "left").withColumn("is_core", F.coalesce("is_core", F.lit(False)))
    return written(sure.unionByName(decided), "counted")


def _near(left: DataFrame, right: DataFrame, eps: float, by: list[str]) -> DataFrame:
    """Rows of ``left`` with those of ``right`` (lon2, lat2, in cells) at most ``eps`` away."""
    wide = _to_neighbours(left.select(*by, "place_id", "lon", "lat", "cx", "cy")).drop("cx", "cy").withColumnsRenamed({"near_x": "cx", "near_y": "cy"})
    dx, dy = F.col("lon") - F.col("lon2"), F.col("lat") - F.col("lat2")
    return wide.join(right, [*by, "cx", "cy"]).where(dx * dx + dy * dy <= F.lit(eps) * F.lit(eps))


def _cell_links(core: DataFrame, eps: float, by: list[str]) -> DataFrame:
    """``(src, dst)``: neighbouring cells, by their leading cores, with two cores at most ``eps`` apart.

    The outermost cores of a cell in eight directions are tried first; only pairs of cells that those do not link have
    all their cores compared.
    """
    keys = [*by, "cx", "cy"]
    spot = F.struct("lon", "lat")
    ways = [F.col("lon"), -F.col("lon"), F.col("lat"), -F.col("lat"), F.col("lon") + F.col("lat"), -F.col("lon") - F.col("lat"), F.col("lon") - F.col("lat"), F.col("lat") - F.col("lon")]
    outer = core.groupBy(*keys).agg(F.min("place_id").alias("lead"), F.array_distinct(F.array(*[F.max_by(spot, F.struct(w, "place_id")) for w in ways])).alias("rim"))
    outer = written(outer, "cells")
    half = [o for o in _REACH if o > (0, 0)]
    left = _to_neighbours(outer, half).select(*by, F.col("lead").alias("src"), F.col("rim").alias("rim1"), F.col("near_x").alias("cx"), F.col("near_y").alias("cy"))
    met = left.join(outer.select(*keys, F.col("lead").alias("dst"), F.col("rim").alias("rim2")), keys)
    close = lambda p, q: (p["lon"] - q["lon"]) * (p["lon"] - q["lon"]) + (p["lat"] - q["lat"]) * (p["lat"] - q["lat"]) <= F.lit(eps) * F.lit(eps)
    tried = written(met.select("src", "dst", F.exists("rim1", lambda p: F.exists("rim2", lambda q: close(p, q))).alias("linked")), "tried")
    lead = core.join(outer.select(*keys, "lead"), keys).select("lead", spot.alias("p"))
    open_ = tried.where("not linked").select("src", "dst")
    compared = open_.join(lead.select(F.col("lead").alias("src"), "p"), "src").join(lead.select(F.col("lead").alias("dst"), F.col("p").alias("q")), "dst").where(close(F.col("p"), F.col("q")))
    return tried.where("linked").select("src", "dst").union(compared.select("src", "dst").distinct())


#: Cells along a side of the smallest tile, and the rings of cells around a tile that its task sees: neighbours of the
#: cores lie in two rings, and the neighbours that make those cores in two more.
BLOCK_CELLS, CORE_RING, SEEN_RING = 16, 2, 4
#: A tile grows while it holds at most TILE_ROWS points, up to TILE_LEVELS doublings of its side.
TILE_ROWS, TILE_LEVELS = 8_192, 12
#: Points of a smallest tile up to which tasks take tiles (about 200 bytes a point, of nine blocks at most). Where more
#: points lie within a few eps, no tile is small, and the table goes through joins on cells instead.
DENSE_ROWS = 100_000


def _celled_points(points: DataFrame, eps: float, by: list[str], least: int | str) -> DataFrame:
    more = [least] if isinstance(least, str) and least not in by else []
    side = eps / np.sqrt(2.0) * (1 - 1e-12)
    return points.select(*by, *more, "event_id", "lon", "lat", F.floor(F.col("lon") / F.lit(side)).alias("cx"), F.floor(F.col("lat") / F.lit(side)).alias("cy"))


def _tiles(points: DataFrame, eps: float, by: list[str], least: int | str) -> tuple[DataFrame, DataFrame]:
    """``(points in blocks, blocks)``: points with their cell and block, and the tile of each block that holds points.

    A block is BLOCK_CELLS by BLOCK_CELLS cells. Its tile is the largest square of blocks around it, aligned by powers of
    two, that holds at most TILE_ROWS points; at least the block itself.
    """
    block = lambda c: F.floor(F.col(c) / BLOCK_CELLS)
    at = _celled_points(points, eps, by, least).withColumns({"bx": block("cx"), "by__": block("cy")})
    blocks = at.groupBy(*by, "bx", "by__").agg(F.count("*").alias("held"))
    up = lambda c: F.expr(f"shiftright({c}, level)")
    levels = blocks.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(TILE_LEVELS))))
    within = F.sum("held").over(Window.partitionBy(*by, "level", up("bx"), up("by__")))
    fits = levels.withColumn("within", within).where((F.col("level") == 0) | (F.col("within") <= TILE_ROWS))
    return at, written(fits.groupBy(*by, "bx", "by__").agg(F.max("level").alias("level"), F.max("held").alias("held")), "blocks")


def _tile_clusters(points: DataFrame, eps: float, min_samples: int | str, by: list[str]) -> DataFrame | None:
    """What the tiles' tasks find, as a written table; None where a block holds over DENSE_ROWS points.

    ``(by, event_id, is_core, labels)``: a tile's own points with the local clusters that they belong to or border on, named
    by their smallest core ids; and rows without ``is_core`` that link a cell's smallest core id near the tile's edge with
    its local cluster.
    """
    at, blocks = _tiles(points, eps, by, min_samples)
    sums = blocks.agg(F.coalesce(F.max("held"), F.lit(0)).alias("most"), F.count("*").alias("n")).first()
    if sums["most"] > DENSE_ROWS:
        return None
    few = F.broadcast(blocks) if sums["n"] <= BROADCAST_ROWS else blocks
    inside = lambda c, b: F.col(c) - F.col(b) * BLOCK_CELLS

    def steps(o: Column) -> Column:
        """To the blocks that see a cell at the offset ``o`` of its own block: itself, the one before, the one behind."""
        before, behind = o < SEEN_RING, o >= BLOCK_CELLS - SEEN_RING
        return F.when(before & behind, F.array(F.lit(0), F.lit(-1), F.lit(1))).when(before, F.array(F.lit(0), F.lit(-1))).when(behind, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))

    rings = lambda o, step: F.when(step == 0, F.lit(0)).when(step < 0, o + 1).otherwise(BLOCK_CELLS - o)
    ox, oy = inside("cx", "bx"), inside("cy", "by__")
    spread = at.withColumn("dx", F.explode(steps(ox))).withColumn("dy", F.explode(steps(oy)))
    spread = spread.withColumn("ring", F.greatest(rings(ox, F.col("dx")), rings(oy, F.col("dy"))))
    spread = spread.withColumns({"bx": F.col("bx") + F.col("dx"), "by__": F.col("by__") + F.col("dy")}).drop("dx", "dy")
    tile = {"tx": F.expr("shiftright(bx, level)"), "ty": F.expr("shiftright(by__, level)")}
    tiled = spread.join(few.drop("held"), [*by, "bx", "by__"]).withColumns(tile).drop("bx", "by__")
    return written(_in_tiles(tiled, eps, min_samples, by), "tile_clusters", keep=True)


def _in_tiles(tiled: DataFrame, eps: float, min_samples: int | str, by: list[str]) -> DataFrame:
    """A task for each tile of ``tiled`` (by, level, tx, ty, ring, event_id, lon, lat, cx, cy); level -1: the tile is all."""
    ship(tiled.sparkSession)
    kinds = dict(tiled.dtypes)
    keys = [*by, "level", "tx", "ty"]
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in by), "event_id long, is_core boolean, labels array<long>"])

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        ids, ring = rows.column("event_id").to_numpy(), rows.column("ring").to_numpy()
        order = np.lexsort((ring, ids))
        order = order[np.append(True, np.diff(ids[order]) != 0)]  # a point may be near several blocks of a tile
        ids, ring = ids[order], ring[order]
        xy, cells = (np.column_stack([rows.column(c).to_numpy()[order] for c in names]) for names in (("lon", "lat"), ("cx", "cy")))
        least = rows.column(min_samples)[0].as_py() if isinstance(min_samples, str) else min_samples
        found = clustered(xy, eps, least, ring <= CORE_RING, cells)
        level, tx, ty = (k.as_py() for k in key[-3:])
        own, edge = ring == 0, np.zeros(len(ids), bool)
        if level >= 0:
            side = BLOCK_CELLS << level
            low = np.array([tx * side, ty * side])
            edge = ((cells < low + CORE_RING) | (cells >= low + side - CORE_RING)).any(axis=1)
        mine = np.flatnonzero(own)
        # the smallest core of each cell near the edge, here and in the tiles around, which see the same cells whole
        shared = np.flatnonzero(found.core & (edge | ~own))
        _, first = np.unique(cells[shared], axis=0, return_index=True)
        shared = shared[first]
        of, many = found.labels_of(mine)
        offsets = np.concatenate([[0], np.cumsum(many), many.sum() + np.arange(1, len(shared) + 1)])
        labels = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids[np.concatenate([of, found.top[shared]])], pa.int64()))
        core = pa.array(np.concatenate([found.core[mine], np.ones(len(shared), bool)]), pa.bool_(), mask=np.arange(len(mine) + len(shared)) >= len(mine))
        out = [pa.array(ids[np.concatenate([mine, shared])], pa.int64()), core, labels]
        same = [pa.repeat(k, len(out[0])) for k in key[: len(by)]]
        return pa.Table.from_arrays([*same, *out], names=[*by, "event_id", "is_core", "labels"])

    return tiled.groupBy(*keys).applyInArrow(run, schema)


def _largest(points: DataFrame, by: list[str]) -> int:
    sizes = points.groupBy(*by).agg(F.count("*").alias("n"))
    return sizes.agg(F.coalesce(F.max("n"), F.lit(0)).alias("n")).first()["n"]


def _joined_tiles(found: DataFrame, by: list[str]) -> DataFrame:
    """Labels of all points from the tiles' local clusters and the links between them."""
    links = found.where("is_core is null").select(F.col("event_id").alias("src"), F.get("labels", F.lit(0)).alias("dst"))
    names = small(written(components(links).where("node <> label"), "names", keep=True))
    mine = found.where("is_core is not null").select(*by, "event_id", "is_core", "labels")
    single = mine.where(F.size("labels") <= 1).withColumn("local", F.get("labels", F.lit(0))).drop("labels")
    single = single.join(names, F.col("local") == F.col("node"), "left").select(*by, "event_id", "is_core", F.coalesce("label", "local").alias("label"))
    several = mine.where(F.size("labels") > 1).withColumn("local", F.explode("labels")).join(names, F.col("local") == F.col("node"), "left")
    several = several.groupBy(*by, "event_id", "is_core").agg(F.min(F.coalesce("label", "local")).alias("label"))
    return single.unionByName(several).select(*by, "event_id", "is_core", F.coalesce(F.col("label") + 1, F.lit(0)).alias("label"))


def dbscan(points: DataFrame, eps: float, min_samples: int | str, by: list[str] | None = None) -> DataFrame:
    """``(by, event_id, is_core, label, is_noise)``: label is 1 + the smallest core id of the cluster, 0 for noise.

    Ids are unique; with ``by`` every group is clustered on its own; ``min_samples`` may name a column of ``by``. Works on distinct positions with their numbers of
    points, in cells whose cores are one cluster by construction; clusters are connected components of cells. A border
    point takes the neighbouring cluster whose smallest core id is lowest. Nothing written grows faster than the points.

    Tiles of about TILE_ROWS points, with the points around that decide about theirs, are clustered by one task each; the
    cells that two tiles see link their clusters. Groups that fit a tile are one each. Where over DENSE_ROWS points lie in one smallest tile, joins on cells
    take the same steps for the whole table.
    """
    by = by or []
    noise = (F.col("label") == 0).alias("is_noise")
    if by and _largest(points, by) <= min(TILE_ROWS, DENSE_ROWS):
        whole = {"level": F.lit(-1), "tx": F.lit(0), "ty": F.lit(0), "ring": F.lit(0)}
        alone = _in_tiles(_celled_points(points, eps, by, min_samples).withColumns(whole), eps, min_samples, by)
        return alone.select(*by, "event_id", "is_core", F.coalesce(F.array_min("labels") + 1, F.lit(0)).alias("label")).select("*", noise)
    with scratch():
        found = _tile_clusters(points, eps, min_samples, by)
        if found is not None:
            return _joined_tiles(found, by).select("*", noise)
        counted = _counted(points, eps, min_samples, by)
        core = counted.where("is_core")
        found = components(_cell_links(core, eps, by))
        keys = [*by, "cx", "cy"]
        lead = core.groupBy(*keys).agg(F.min("place_id").alias("lead"))
        labels = written(lead.join(found, lead.lead == found.node, "left").select(*keys, F.coalesce("label", "lead").alias("label")), "labels")
        at_cores = core.join(labels, keys).select(*keys, F.col("lon").alias("lon2"), F.col("lat").alias("lat2"), "label")
        border = _near(counted.where("not is_core"), at_cores, eps, by).groupBy("place_id").agg(F.min("label").alias("border"))
        own = counted.where("is_core").join(labels, keys).select(*by, "lon", "lat", "is_core", (F.col("label") + 1).alias("label"))
        other = counted.where("not is_core").join(border, "place_id", "left").select(*by, "lon", "lat", "is_core", (F.coalesce("border", F.lit(-1)) + 1).alias("label"))
        decided = written(own.unionByName(other), "decided", keep=True)
    joined = points.select(*by, "event_id", "lon", "lat").join(decided, [*by, "lon", "lat"])
    return joined.select(*by, "event_id", "is_core", F.col("label").cast("long").alias("label"), (F.col("label") == 0).alias("is_noise"))


def core_points(points: DataFrame, eps: float, min_samples: int) -> DataFrame:
    """``(event_id, neighbours, is_core)``."""
    counted = neighbour_counts(points, eps)
    return points.join(counted.select("lon", "lat", "neighbours"), ["lon", "lat"]).select("event_id", "neighbours", (F.col("neighbours") >= min_samples).alias("is_core"))


#: Pairs of points that the kernel lays out at once.
_PAIRS = 4_000_000


def _pairs_of_cells(start: np.ndarray, size: np.ndarray, a: np.ndarray, b: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All (row of cell a, row of cell b) for aligned lists of cells, a bounded number of pairs at a time."""
    many = size[a] * size[b]
    ends = np.cumsum(many)
    low = 0
    while low < len(a):
        high = max(low + 1, int(np.searchsorted(ends, (ends[low - 1] if low else 0) + _PAIRS, "right")))
        n = many[low:high]
        which = np.repeat(np.arange(low, high), n)
        inside = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        wide = size[b[which]]
        yield start[a[which]] + inside // wide, start[b[which]] + inside % wide
        low = high


def _folded(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``label`` (each node's own number) after the nodes that links a-b connect took their least number."""
    while True:
        low, high = np.minimum(label[a], label[b]), np.maximum(label[a], label[b])
        if (low == high).all():
            return label
        np.minimum.at(label, high, low)
        while (label[label] != label).any():
            label = label[label]


@dataclass(frozen=True)
class Clustered:
    """Cores of a bounded group of rows, the smallest core row of each core's cluster (-1 for other rows), and the
    distinct pairs of a row that is no core and the ``top`` of a cluster that it borders on, by row and top."""

    core: np.ndarray
    top: np.ndarray
    border: np.ndarray
    beside: np.ndarray

    def labels_of(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The tops of ``rows`` (rising) one after the other, and how many each row has: a core its own, others all that
        they border on."""
        who = np.concatenate([np.flatnonzero(self.core), self.border])
        what = np.concatenate([self.top[self.core], self.beside])
        asked = np.zeros(len(self.core), bool)
        asked[rows] = True
        who, what = who[asked[who]], what[asked[who]]
        order = np.lexsort((what, who))
        return what[order], np.bincount(who, minlength=len(self.core))[rows]


def clustered(x: np.ndarray, eps: float, min_samples: int, trusted: np.ndarray | None = None, cells: np.ndarray | None = None) -> Clustered:
    """Clusters of rows of two coordinates, by the steps of :func:`dbscan` on arrays: cells of side eps / sqrt(2); only
    points of cells with under ``min_samples`` count their neighbours; cells are linked by their outermost cores or,
    failing these, by all. Rows that are not ``trusted`` (whole cells) count as neighbours, but are no cores.
    """
    n = len(x)
    trusted = np.ones(n, bool) if trusted is None else trusted
    cells = np.floor(x / (eps / np.sqrt(2.0) * (1 - 1e-12))).astype(np.int64) if cells is None else cells
    if not n:
        return Clustered(np.empty(0, bool), *(np.empty(0, np.int64) for _ in range(3)))
    cells = cells - (cells.min(axis=0) - 2)
    width = int(cells[:, 1].max()) + 3
    key = cells[:, 0] * width + cells[:, 1]
    order = np.argsort(key, kind="stable")
    at, rows = x[order], order
    names, start, size = np.unique(key[order], return_index=True, return_counts=True)

    def beside(offset: tuple[int, int], mine: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        wanted = names[mine] + offset[0] * width + offset[1]
        place = np.minimum(np.searchsorted(names, wanted), len(names) - 1)
        there = names[place] == wanted
        return mine[there], place[there]

    def close(p: np.ndarray, q: np.ndarray) -> np.ndarray:
        gap = at[p] - at[q]
        return gap[:, 0] * gap[:, 0] + gap[:, 1] * gap[:, 1] <= eps * eps

    dense = size >= min_samples
    certain = trusted[rows]
    sparse = np.flatnonzero(~dense & certain[start])
    near = np.zeros(n, np.int64)
    for offset in _REACH:
        for p, q in _pairs_of_cells(start, size, *beside(offset, sparse)):
            near += np.bincount(p[close(p, q)], minlength=n)
    core = (np.repeat(dense, size) | (near >= min_samples)) & certain
    if not core.any():
        return Clustered(core, np.full(n, -1), np.empty(0, np.int64), np.empty(0, np.int64))
    # the core points alone, cell by cell
    kept = np.flatnonzero(core)
    cell_of = np.repeat(np.arange(len(names)), size)[kept]
    held = np.unique(cell_of)
    first = np.searchsorted(cell_of, held)
    amount = np.diff(np.append(first, len(cell_of)))
    number = np.full(len(names), -1)
    number[held] = np.arange(len(held))
    ways = np.array([[1, 0], [-1, 0], [0, 1], [0, -1], [1, 1], [-1, -1], [1, -1], [-1, 1]], float)
    rim = np.empty((len(held), len(ways)), np.int64)
    for w, way in enumerate(ways):
        rim[:, w] = kept[np.lexsort((at[kept] @ way, cell_of))[np.cumsum(amount) - 1]]
    label = np.arange(len(held))
    rest_a, rest_b = [], []
    for offset in (o for o in _REACH if o > (0, 0)):
        a, b = (number[c] for c in beside(offset, held))
        a, b = a[b >= 0], b[b >= 0]
        linked = np.zeros(len(a), bool)
        for i, j in np.ndindex(len(ways), len(ways)):
            open_ = np.flatnonzero(~linked)
            linked[open_] = close(rim[a[open_], i], rim[b[open_], j])
        label = _folded(label, a[linked], b[linked])
        rest_a.append(a[~linked])
        rest_b.append(b[~linked])
    a, b = np.concatenate(rest_a), np.concatenate(rest_b)
    apart = label[a] != label[b]
    a, b = a[apart], b[apart]
    for p, q in _pairs_of_cells(first, amount, a, b):
        hit = close(kept[p], kept[q])
        cell = number[cell_of]
        label = _folded(label, cell[p[hit]], cell[q[hit]])
    least = np.full(len(held), n)
    np.minimum.at(least, label[number[cell_of]], rows[kept])
    top = np.full(n, n)
    top[kept] = least[label[number[cell_of]]]
    lone, whose = [], []
    for offset in _REACH:
        for p, q in _pairs_of_cells(start, size, *beside(offset, sparse)):
            hit = core[q] & ~core[p]
            p, q = p[hit], q[hit]
            hit = close(p, q)
            met = np.unique(rows[p[hit]] * n + top[q[hit]])
            lone.append(met // n)
            whose.append(met % n)
    met = np.unique(np.concatenate(lone) * n + np.concatenate(whose)) if lone else np.empty(0, np.int64)
    out, is_core = np.empty(n, np.int64), np.empty(n, bool)
    out[rows], is_core[rows] = np.where(core, top, -1), core
    return Clustered(is_core, out, met // n, met % n)


def cell_dbscan(x: np.ndarray, eps: float, min_samples: int) -> tuple[np.ndarray, np.ndarray]:
    """``(smallest core row of each row's cluster, is it a core)``, -1 for noise, for one bounded group of rows."""
    found = clustered(x, eps, min_samples)
    top, n = found.top.copy(), len(x)
    least = np.full(n, n)
    np.minimum.at(least, found.border, found.beside)
    return np.where(found.core, top, np.where(least < n, least, -1)), found.core


def grid_dbscan(x: np.ndarray, eps: float, min_samples: int) -> np.ndarray:
    """Labels of one group of points: 0.. by the cluster's smallest core row, -1 for noise."""
    top, _ = cell_dbscan(x, eps, min_samples)
    real = np.unique(top[top >= 0])
    return np.where(top >= 0, np.searchsorted(real, top), -1)


def dbscan_by_period(points: DataFrame, period: str, eps: float, min_samples: int) -> DataFrame:
    """``(period, event_id, lon, lat, label)`` with one kernel call for each period; -1 is noise.

    For periods that fit a task (the sampled hours of the pipeline); whole tables go through :func:`dbscan`.
    """
    kind = dict(points.dtypes)[period]
    ship(points.sparkSession)

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("event_id", kind="stable")
        label = grid_dbscan(rows[["lon", "lat"]].to_numpy(float), eps, min_samples)
        return pd.DataFrame({period: rows[period], "event_id": rows["event_id"], "lon": rows["lon"], "lat": rows["lat"], "label": label.astype("int64")})

    return points.select(period, "event_id", "lon", "lat").groupBy(period).applyInPandas(run, f"{period} {kind}, event_id long, lon double, lat double, label long")


def centroids(labelled: DataFrame, by: list[str], noise: int = -1) -> DataFrame:
    """Mean position and size of each cluster."""
    return labelled.where(F.col("label") != noise).groupBy(*by, "label").agg(F.avg("lon").alias("lon"), F.avg("lat").alias("lat"), F.count("*").alias("sampled_count"))


#: Constant, slope and bounds of the neighbours of a core and of the hash functions about 10,000 points, and
#: the quantile and bounds of the regional radius.
CORE_RULE, HASH_RULE, REGION_RULE = (6.4, 0.2, 5.0, 12.0), (10.0, 20.0), (0.7, 2e-4, 1e-2)


def min_samples_for(n: Column) -> Column:
    """Neighbours that a core needs: 6.4 + 0.2 ln(n / 10000), between 5 and 12, cut to whole numbers."""
    constant, slope, least, most = map(F.lit, CORE_RULE)
    return F.floor(F.least(most, F.greatest(least, constant + slope * F.ln(n / F.lit(10_000.0))))).cast("int")


def hashes_for(n: Column, least: int = 1) -> Column:
    """Hash functions: 10 + log2(n / 10000), at most 20, cut towards zero, at least ``least``."""
    plain, most = map(F.lit, HASH_RULE)
    raw = F.least(most, plain + F.ln(n / F.lit(10_000.0)) / F.ln(F.lit(2.0)))
    return F.greatest(F.lit(least), raw.cast("int"))


#: Fixed values of the older strategies: radius, neighbours and hashes about 10,000 points, and their limits; the radius
#: range of few and of many dimensions, and where and how steeply one passes into the other.
MILD = {"eps": 0.75, "least_eps": 0.4, "k": 10, "most_k": 30, "hashes": 10, "most_hashes": 20, "fall": 0.03, "rise": 0.6}
LOW_RANGE, HIGH_RANGE, MIDDLE, STEEPNESS = (0.2, 0.3), (0.7, 0.75), 15.0, 0.15
PULL_MIDDLE, PULL_WIDTH, PULL, PULL_STRENGTH = 6.5, 8.0, 0.3, 0.4


def mild_parameters(n: Column) -> tuple[Column, Column, Column]:
    """``(eps, min_samples, hashes)`` that move slowly with the logarithm of the number of points."""
    grown = F.ln(n.cast("double")) - F.ln(F.lit(10_000.0))
    eps = F.greatest(F.lit(MILD["least_eps"]), F.lit(MILD["eps"]) / (1 + F.lit(MILD["fall"]) * grown))
    k = F.least(MILD["k"] + MILD["rise"] * grown, F.lit(float(MILD["most_k"]))).cast("int")
    hashes = F.least(MILD["hashes"] + grown / F.ln(F.lit(2.0)), F.lit(float(MILD["most_hashes"]))).cast("int")
    return F.bround(eps, 4), k, hashes


def dimension_radius(d: Column, raw: Column, least: Column, most: Column) -> Column:
    """A radius for ``d`` dimensions: ``raw`` is moved from the range of the k-distances (least, most) into a range that a
    sigmoid of d chooses, pulled low for few and high for many dimensions, and held inside 0.01..1 by another sigmoid."""
    share = 1 / (1 + F.exp(-F.lit(STEEPNESS) * (d - F.lit(MIDDLE))))
    low, high = (F.lit(a) + F.lit(b - a) * share for a, b in zip(LOW_RANGE, HIGH_RANGE, strict=True))
    scaled = F.when(most - least < 1e-6, (low + high) / 2).otherwise(low + (raw - least) / (most - least) * (high - low))
    bend = F.tanh((d - F.lit(PULL_MIDDLE)) / F.lit(PULL_WIDTH))
    place, strength = (scaled - low) / (high - low), F.lit(PULL_STRENGTH) * F.abs(bend)
    moved = low + (place * (1 - strength) + (0.5 + F.lit(PULL) * bend) * strength) * (high - low)
    return F.bround(0.01 + 0.99 / (1 + F.exp(-10 * (moved - 0.5))), 4)


def knee(rows: DataFrame, by: str, value: str, quantile: float = 0.9) -> DataFrame:
    """``(by, raw, least, most)`` of a group's k-distances: their quantile, or its mean with the steepest point of their
    sorted curve where the two differ by over half. Slopes come from neighbours in the order of distinct values."""
    line = Window.partitionBy(by).orderBy(value)
    per = rows.groupBy(by, value).agg(F.count("*").alias("c"))
    near = per.withColumns({"before": F.lag(value).over(line), "behind": F.lead(value).over(line)})
    alone = F.col("c") == 1
    inner = (F.coalesce("behind", value) - F.coalesce("before", value)) / F.when(F.col("before").isNull() | F.col("behind").isNull(), 1.0).otherwise(2.0)
    up, down = F.coalesce(F.col("behind") - F.col(value), F.lit(0.0)) / 2, F.coalesce(F.col(value) - F.col("before"), F.lit(0.0)) / 2
    slope = F.when(alone, inner).otherwise(F.greatest(up, down))
    steep = near.groupBy(by).agg(F.max_by(value, F.struct(F.round(slope, 12), -F.col(value))).alias("elbow"))
    q = rows.groupBy(by).agg(F.expr(f"percentile({value}, {quantile})").alias("q"), F.min(value).alias("least"), F.max(value).alias("most"))
    gap = F.abs(F.col("q") - F.col("elbow")) / F.greatest("q", F.lit(1e-6))
    return q.join(steep, by).select(by, F.when(gap > 0.5, (F.col("q") + F.col("elbow")) / 2).otherwise(F.col("q")).alias("raw"), "least", "most")


def region_parameters(k_dist: DataFrame, period: str, points: DataFrame) -> DataFrame:
    """``(period, n, eps, min_samples, hashes)`` by the 70 % quantile of the k-distances, held to 0.0002..0.01."""
    n = points.groupBy(period).agg(F.count("*").cast("double").alias("n"))
    share, least, most = REGION_RULE
    q = k_dist.groupBy(period).agg(F.expr(f"percentile(k_dist, {share})").alias("typical"))
    eps = F.least(F.lit(most), F.greatest(F.lit(least), F.col("typical")))
    return n.join(q, period).select(period, F.col("n").cast("long").alias("n"), eps.alias("eps"), min_samples_for(F.col("n")).alias("min_samples"), hashes_for(F.col("n"), 6).alias("hashes"))


#: Fixed values of the density rules: the nearest distance's factor, what the density and the size add to the least and
#: the largest radius, these radii's own bounds, the quantiles of few and of over 50,000 points, the median's factor, the
#: third quantile, and the share of the range that is used.
DENSITY = {"base": 1.5, "low": 0.5, "low_fall": 0.1, "high": 3.0, "high_rise": 0.2, "least": 0.001, "most": 0.5, "few": 0.6, "many": 0.7, "median": 1.2, "third": 0.75, "used": 0.8}


def density_radii(k_dist: DataFrame, first_dist: DataFrame, points: DataFrame, period: str) -> DataFrame:
    """``(period, n, eps, eps_min, eps_max)`` by the scale- and density-adaptive rules, as columns over period statistics.

    ``first_dist`` holds each point's distance to its nearest other point (``k_dist`` with k = 2). The radius is the middle
    of three typical k-distances, moved from the k-distances' range into the radii's.
    """
    n, at = F.col("n"), DENSITY
    stats = points.groupBy(period).agg(F.count("*").cast("double").alias("n"), ((F.max("lon") - F.min("lon")) * (F.max("lat") - F.min("lat"))).alias("area"))
    nearest = first_dist.groupBy(period).agg(F.avg("k_dist").alias("nearest"))
    quantile = lambda p, name: F.expr(f"percentile(k_dist, {p})").alias(name)
    q = k_dist.groupBy(period).agg(quantile(0.5, "half"), quantile(at["few"], "few"), quantile(at["many"], "many"), quantile(at["third"], "third"), F.min("k_dist").alias("low"), F.max("k_dist").alias("high"))
    joined = stats.join(nearest, period).join(q, period)
    density = F.log10(F.greatest(F.lit(1.0), n / F.greatest(F.col("area"), F.lit(1e-12))))
    size = F.when(n > 1000, F.log10(n / 1000)).otherwise(0.0)
    base = F.col("nearest") * at["base"]
    joined = joined.withColumns({"eps_min": F.greatest(F.lit(at["least"]), base * (at["low"] - at["low_fall"] * density)), "widest": F.least(F.lit(at["most"]), base * (at["high"] + at["high_rise"] * size))})
    joined = joined.withColumn("eps_max", F.when(F.col("widest") <= F.col("eps_min"), F.col("eps_min") * 2).otherwise(F.col("widest")))
    three = F.array_sort(F.array(F.when(n > 50_000, F.col("many")).otherwise(F.col("few")), F.col("half") * at["median"], F.col("third")))
    spread = F.col("high") - F.col("low")
    moved = F.col("eps_min") + (F.element_at(three, 2) - F.col("low")) / spread * (F.col("eps_max") - F.col("eps_min")) * at["used"]
    eps = F.when(spread > 1e-6, moved).otherwise((F.col("eps_min") + F.col("eps_max")) / 2)
    return joined.select(period, "n", F.least("eps_max", F.greatest("eps_min", eps)).alias("eps"), "eps_min", "eps_max")


def density_parameters(k_dist: DataFrame, first_dist: DataFrame, points: DataFrame, period: str) -> DataFrame:
    """``(period, n, eps, min_samples, hashes)`` with the radii of :func:`density_radii`."""
    n = F.col("n")
    radii = density_radii(k_dist, first_dist, points, period)
    return radii.select(period, n.cast("long").alias("n"), F.bround("eps", 6).alias("eps"), min_samples_for(n).alias("min_samples"), hashes_for(n).alias("hashes"))


def eps_in_metres(eps: Column) -> Column:
    return eps * F.lit(METRES_PER_DEGREE)


def shifts(count: int, eps: float, seed: int = 42) -> list[float]:
    """The shift of each hash function, in 0..2 eps, from an arithmetic generator (the same in any engine)."""
    out, state = [], seed
    for _ in range(count):
        state = (state * 1103515245 + 12345) % 2147483648
        out.append(2 * eps * state / 2147483648)
    return out


def buckets(points: DataFrame, eps: float, etas: list[float]) -> DataFrame:
    """One row for each point and hash function: ``(event_id, j, cx, cy)``."""
    cells = F.array(*[F.struct(F.lit(j).alias("j"), F.floor((F.col("lon") + F.lit(e)) / F.lit(2 * eps)).alias("cx"), F.floor((F.col("lat") + F.lit(e)) / F.lit(2 * eps)).alias("cy")) for j, e in enumerate(etas)])
    return points.select("event_id", F.explode(cells).alias("b")).select("event_id", "b.j", "b.cx", "b.cy")


def hashed_dbscan(points: DataFrame, eps: float, min_samples: int, etas: list[float], *, core_by: str = "plain cell") -> DataFrame:
    """``(event_id, is_core, label)``: cores that share a bucket are connected; label is 1 + the smallest member, 0 for noise.

    core_by ``plain cell``: a core's unshifted cell holds ``min_samples`` points; ``any bucket``: one of its shifted
    buckets does. A point that is no core joins the first bucket (by hash function) that holds a core.
    """
    hashed = written(buckets(points, eps, etas), "buckets")
    counting = buckets(points, eps, [0.0]) if core_by == "plain cell" else hashed
    full = counting.groupBy("j", "cx", "cy").agg(F.count("*").alias("n")).where(F.col("n") >= min_samples)
    cores = written(counting.join(full, ["j", "cx", "cy"]).select("event_id").distinct(), "cores")
    core_bucket = hashed.join(cores, "event_id")
    lead = written(core_bucket.groupBy("j", "cx", "cy").agg(F.min("event_id").alias("lead")), "lead")
    star = core_bucket.join(lead, ["j", "cx", "cy"]).select(F.col("event_id").alias("src"), F.col("lead").alias("dst"))
    rest = hashed.join(cores, "event_id", "left_anti").join(lead, ["j", "cx", "cy"])
    border = rest.groupBy("event_id").agg(F.min(F.struct("j", "lead")).alias("first")).select(F.col("event_id").alias("src"), F.col("first.lead").alias("dst"))
    found = components(star.union(border))
    joined = points.select("event_id").join(found, points.event_id == found.node, "left").join(cores.withColumn("is_core", F.lit(True)), "event_id", "left")
    alone = F.when(F.col("is_core"), F.col("event_id"))  # a core whose buckets hold no other point is a cluster of one
    label = F.coalesce(F.col("label"), alone) + 1 if core_by == "any bucket" else F.col("label") + 1
    return joined.select("event_id", F.coalesce("is_core", F.lit(False)).alias("is_core"), F.coalesce(label, F.lit(0)).cast("long").alias("label"))


def frozen_labels(points: DataFrame, known: DataFrame, eps: float, etas: list[float]) -> DataFrame:
    """Labels of new points from frozen cores: the label of a core in the first bucket that holds one, else 0."""
    cores = buckets(known.where("is_core"), eps, etas).join(known.select("event_id", "label"), "event_id").groupBy("j", "cx", "cy").agg(F.min("label").alias("label"))
    met = buckets(points, eps, etas).join(cores, ["j", "cx", "cy"]).groupBy("event_id").agg(F.min(F.struct("j", "label")).alias("first"))
    return points.select("event_id").join(met, "event_id", "left").select("event_id", F.coalesce("first.label", F.lit(0)).alias("label"))
