"""Spatial joins as equi-joins on grid cells: nearest node, range self join, k nearest, spacing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from patrolkit.functions.geo import cell, degree_steps, haversine_m
from patrolkit.plans.shared_tables import BROADCAST_ROWS, ship, small, written


def _around(column: str, reach: int = 1):
    return F.explode(F.sequence(F.col(column) - reach, F.col(column) + reach))


def nearest_node(points: DataFrame, nodes: DataFrame, radius_m: float, *, max_abs_lat: float = 60.0) -> DataFrame:
    """``points`` with node_id and dist_m of the nearest node within ``radius_m`` (null beyond); ties to the lowest id.

    Each grid cell gets one row with the nodes of its neighbourhood, so a point meets one row of a hash join and no
    shuffle of the points is needed; the nodes are broadcast while they are few. Of nodes at one position only the lowest
    id can be nearest, so the others are left out first. Where a neighbourhood has one node, its distance is a plain
    expression, which is compiled; functions over arrays are not.
    """
    step_lon, step_lat = degree_steps(radius_m, max_abs_lat)
    lowest = nodes.groupBy("lon", "lat").agg(F.min("node_id").alias("node_id"))
    spread = lowest.select(F.struct("node_id", "lon", "lat").alias("node"), cell(F.col("lon"), step_lon).alias("cx"), cell(F.col("lat"), step_lat).alias("cy"))
    spread = spread.select("node", _around("cx").alias("cell_x"), "cy").select("node", "cell_x", _around("cy").alias("cell_y"))
    by_cell = small(spread.groupBy("cell_x", "cell_y").agg(F.collect_list("node").alias("near")))
    keyed = points.withColumns({"cell_x": cell(F.col("lon"), step_lon), "cell_y": cell(F.col("lat"), step_lat)})
    met = lambda n: F.struct(haversine_m(F.col("lon"), F.col("lat"), n["lon"], n["lat"]).alias("dist_m"), n["node_id"].alias("node_id"))
    only = met(F.col("near")[0])
    nearest = F.array_min(F.filter(F.transform("near", met), lambda r: r["dist_m"] <= radius_m))
    best = F.when(F.size("near") == 1, F.when(only["dist_m"] <= radius_m, only)).when(F.size("near") > 1, nearest)
    joined = keyed.join(by_cell, ["cell_x", "cell_y"], "left").withColumn("best", best)
    return joined.select(*points.columns, F.col("best.node_id").alias("node_id"), F.col("best.dist_m").alias("dist_m"))


def places(points: DataFrame, by: list[str]) -> DataFrame:
    """Distinct positions of a group with their number of points, so that repeated positions cost no pairs."""
    return points.groupBy(*by, "lon", "lat").agg(F.count("*").alias("weight"))


def range_pairs(left: DataFrame, eps: float, by: list[str]) -> DataFrame:
    """Pairs of positions of a group at most ``eps`` apart (Euclidean, itself included), by an equi-join on cells.

    Returns by, lon, lat, weight and the same with ``_other``.
    """
    keyed = left.withColumns({"cell_x": cell(F.col("lon"), eps), "cell_y": cell(F.col("lat"), eps)})
    other = keyed.select(*[F.col(c).alias(f"{c}_other") for c in [*by, "lon", "lat", "weight"]], _around("cell_x").alias("near_x"), F.col("cell_y"))
    other = other.select(*[c for c in other.columns if c != "cell_y"], _around("cell_y").alias("near_y"))
    dx, dy = F.col("lon") - F.col("lon_other"), F.col("lat") - F.col("lat_other")
    same = (F.col("cell_x") == F.col("near_x")) & (F.col("cell_y") == F.col("near_y"))
    for c in by:
        same = same & (F.col(c) == F.col(f"{c}_other"))
    close = dx * dx + dy * dy <= F.lit(eps) * F.lit(eps)
    return keyed.join(other, same & close).select(*by, "lon", "lat", "weight", "lon_other", "lat_other", "weight_other")


def neighbour_counts(points: DataFrame, eps: float, by: list[str] | None = None) -> DataFrame:
    """Positions of each group with ``neighbours``: points at most ``eps`` away, themselves included."""
    by = by or []
    return range_pairs(places(points, by), eps, by).groupBy(*by, "lon", "lat").agg(F.sum("weight_other").alias("neighbours"), F.first("weight").alias("weight"))


def kth_distance(points: pd.DataFrame, k: int, block: int = 512) -> np.ndarray:
    """Distance of each row's k-th nearest row, the row itself counted, in blocks of rows."""
    x = points[["lon", "lat"]].to_numpy(float)
    out = np.empty(len(x))
    for at in range(0, len(x), block):
        dx, dy = (x[at : at + block, None, i] - x[None, :, i] for i in (0, 1))
        square = dx * dx + dy * dy
        kth = min(k, len(x)) - 1
        out[at : at + block] = np.sqrt(np.partition(square, kth, axis=1)[:, kth])
    return out


#: Points of a period up to which one task compares them all, a block at a time.
COMPARED_ROWS = 8_192
#: Distinct positions that a tile of the k-distance search holds at most (eight times k, if that is more), and the levels
#: of halvings of a period's extent that are counted together; finer ones are counted where a cell still holds more.
TILE_POSITIONS = 512
LEVELS = (10, 18, 26)


def k_distances(points: DataFrame, period: str, k: int | str) -> DataFrame:
    """``(period, event_id, k_dist)``: the distance to the k-th nearest point of the period, the point itself counted.

    ``k`` may name a column that is constant within a period; with fewer points the farthest counts. Exact: a period's
    extent is halved into tiles of at most TILE_POSITIONS positions, and a task compares a tile with itself and a ring of
    a quarter of its side. A distance that does not reach beyond what the task saw is final. The few others are looked for
    in the nine cells around and then in nine cells of four times the side, which hold k points close enough, as the cell
    that was halved last holds more than a tile may. Where no period has more than COMPARED_ROWS points, a task compares
    those of a period.
    """
    keys = [period, "lon", "lat"]
    largest = points.groupBy(period).agg(F.count("*").alias("n")).agg(F.coalesce(F.max("n"), F.lit(0)).alias("n")).first()["n"]
    if largest <= COMPARED_ROWS:
        return _compared(points, period, k)
    wanted = F.col(k) if isinstance(k, str) else F.lit(k)
    own = points.select(*keys, "event_id", wanted.cast("long").alias("k__"))
    at = own.groupBy(*keys).agg(F.count("*").alias("weight"), F.max("k__").alias("k__"))
    extent = own.groupBy(F.col(period).alias("of")).agg(F.min("lon").alias("lon0"), F.min("lat").alias("lat0"), F.greatest(F.max("lon") - F.min("lon"), F.max("lat") - F.min("lat"), F.lit(1e-9)).alias("side"))
    at = written(at.join(small(extent), F.col(period) == F.col("of")).drop("of").withColumn("side", F.col("side") * (1 + 1e-9)), "positions")
    tiles = _k_tiles(at, period, max(TILE_POSITIONS, 8 * (at.agg(F.max("k__")).first()[0] or 1)))
    found = written(_k_search(_beside_tiles(at, tiles, period), period), "k_found")
    done = [found.where("final")]
    for up in (0, 2):
        open_ = found.where("not final")
        if not open_.limit(1).count():
            break
        found = written(_k_search(_around_tiles(at, open_, period, up), period, up), "k_found")
        done.append(found.where("final"))
    every = done[0]
    for part in done[1:]:
        every = every.unionByName(part)
    return own.join(every.select(*keys, "k_dist"), keys).select(period, "event_id", "k_dist")


def _cell_of(c: str, level: Column | int) -> Column:
    """The number of the cell that holds a position after ``level`` halvings of its period's extent."""
    return F.floor((F.col(c) - F.col(f"{c}0")) / F.col("side") * F.pow(F.lit(2.0), level if isinstance(level, Column) else F.lit(level)))


def _k_tiles(at: DataFrame, period: str, most: int) -> DataFrame:
    """``(period, level, tx, ty)``: the largest cells of at most ``most`` positions; cells of the last level as they are."""
    keys = [period, "level", "tx", "ty"]
    rows, low, out = at, 0, None
    for high in LEVELS:
        blocks = rows.groupBy(period, _cell_of("lon", high).alias("bx"), _cell_of("lat", high).alias("by")).agg(F.count("*").alias("held"))
        cells = blocks.withColumn("level", F.explode(F.sequence(F.lit(low), F.lit(high))))
        up = lambda c: F.expr(f"shiftright({c}, {high} - level)")  # noqa: B023, E731
        sums = written(cells.groupBy(period, "level", up("bx").alias("tx"), up("by").alias("ty")).agg(F.sum("held").alias("held")), "k_cells")
        full = sums.where(F.col("held") > most).select(*keys)
        halved = full.select(F.col(period).alias("p2"), (F.col("level") + 1).alias("l2"), F.col("tx").alias("x2"), F.col("ty").alias("y2"))
        of = (F.col(period) == F.col("p2")) & (F.col("level") == F.col("l2")) & (F.expr("shiftright(tx, 1)") == F.col("x2")) & (F.expr("shiftright(ty, 1)") == F.col("y2"))
        fits = sums.where(F.col("held") <= most) if high < LEVELS[-1] else sums.where((F.col("held") <= most) | (F.col("level") == high))
        first = fits.where(F.col("level") == low).select(*keys)
        made = first.unionByName(fits.where(F.col("level") > low).join(halved, of, "left_semi").select(*keys))
        out = made if out is None else out.unionByName(made)
        last = full.where(F.col("level") == high)
        if high == LEVELS[-1] or not last.limit(1).count():
            break
        rows = at.withColumns({"tx": _cell_of("lon", high), "ty": _cell_of("lat", high)}).join(small(last.drop("level")), [period, "tx", "ty"], "left_semi").drop("tx", "ty")
        low = high + 1
    return written(out, "k_tiles")


def _levels(tiles: DataFrame) -> Column:
    return F.array(*[F.lit(r["level"]) for r in tiles.select("level").distinct().collect()] or [F.lit(0)])  # some 27 at most


def _beside_tiles(at: DataFrame, tiles: DataFrame, period: str) -> DataFrame:
    """``at`` with each tile that holds a position (``asks``) or has it within a quarter of its side."""
    rows = at.withColumn("level", F.explode(_levels(tiles)))
    for c, name in (("lon", "tx"), ("lat", "ty")):
        place = (F.col(c) - F.col(f"{c}0")) / F.col("side") * F.pow(F.lit(2.0), F.col("level"))
        rest = place - F.floor(place)
        step = F.when(rest < 0.25, F.array(F.lit(0), F.lit(-1))).when(rest >= 0.75, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
        rows = rows.withColumns({name: F.floor(place), f"step_{name}": step}).withColumn(f"step_{name}", F.explode(f"step_{name}")).withColumn(name, F.col(name) + F.col(f"step_{name}"))
    rows = rows.withColumn("asks", (F.col("step_tx") == 0) & (F.col("step_ty") == 0)).drop("step_tx", "step_ty")
    return rows.join(small(tiles), [period, "level", "tx", "ty"]).withColumn("seen", F.lit(True))


def _around_tiles(at: DataFrame, open_: DataFrame, period: str, up: int) -> DataFrame:
    """The open positions of tiles (``asks``) with all positions of the nine cells around, ``up`` levels higher."""
    keys = [period, "level", "tx", "ty"]
    asked = written(open_.select(*keys).distinct(), "k_asked")
    wide = asked.withColumn("at_level", F.greatest(F.col("level") - up, F.lit(0)))
    for c in ("tx", "ty"):
        wide = wide.withColumn(f"c{c}", F.explode(F.array(*[F.expr(f"shiftright({c}, level - at_level)") + o for o in (-1, 0, 1)])))
    seen = at.withColumn("at_level", F.explode(_levels(wide.select(F.col("at_level").alias("level")))))
    seen = seen.withColumns({"ctx": _cell_of("lon", F.col("at_level")), "cty": _cell_of("lat", F.col("at_level"))})
    columns = [*keys, "lon", "lat", "weight", "k__", "lon0", "lat0", "side"]
    seen = seen.join(small(wide), [period, "at_level", "ctx", "cty"]).select(*columns, F.lit(False).alias("asks"), F.lit(True).alias("seen"))
    return seen.unionByName(open_.select(*columns, F.lit(True).alias("asks"), F.lit(False).alias("seen")))


def nearest_by_weight(asks: np.ndarray, x: np.ndarray, weight: np.ndarray, k: np.ndarray, pairs: int = 2_000_000) -> tuple[np.ndarray, np.ndarray]:
    """For each asking position the distance at which the weights of the nearest rows of ``x`` reach ``k``, and whether they
    do; else the farthest row's."""
    out, enough = np.empty(len(asks)), np.empty(len(asks), bool)
    take = min(int(k.max()), len(x)) if len(asks) else 0
    step = max(1, pairs // max(1, len(x)))
    for a in range(0, len(asks), step):
        dx, dy = (asks[a : a + step, None, i] - x[None, :, i] for i in (0, 1))
        square = dx * dx + dy * dy
        near = np.argpartition(square, take - 1, axis=1)[:, :take]  # every row weighs one at least
        d = np.take_along_axis(square, near, axis=1)
        order = np.argsort(d, axis=1)
        met = np.cumsum(weight[np.take_along_axis(near, order, axis=1)], axis=1)
        enough[a : a + step] = met[:, -1] >= k[a : a + step]
        at = np.minimum((met < k[a : a + step, None]).sum(axis=1), take - 1)
        out[a : a + step] = np.sqrt(np.take_along_axis(np.take_along_axis(d, order, axis=1), at[:, None], axis=1)[:, 0])
    return out, enough


def _span(tile: int, up: int | None) -> tuple[float, float]:
    """Where the rows that a tile's task sees end, in sides of the tile."""
    return (tile - 0.25, tile + 1.25) if up is None else (((tile >> up) - 1) << up, ((tile >> up) + 2) << up)


def _k_search(rows: DataFrame, period: str, up: int | None = None) -> DataFrame:
    """Each tile's asking positions with ``k_dist`` among the tile's rows, and whether it is ``final``: whether no unseen
    position can be nearer.

    The rows are those of the tile and a quarter of its side around, or with ``up`` of nine cells that many levels higher.
    Rows that are not ``seen`` only ask; their positions are among the others.
    """
    ship(rows.sparkSession)
    kinds = dict(rows.dtypes)
    keys = [period, "level", "tx", "ty"]
    rest = ["lon", "lat", "weight", "k__", "lon0", "lat0", "side"]
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in [*keys, *rest]), "k_dist double, final boolean"])

    def run(key: tuple, part: pa.Table) -> pa.Table:
        asks = np.flatnonzero(part.column("asks").to_numpy())
        x = np.column_stack([part.column(c).to_numpy() for c in ("lon", "lat")])
        weight = part.column("weight").to_numpy().copy()
        level, *tile = (v.as_py() for v in key[-3:])
        side, start = part.column("side")[0].as_py(), np.array([part.column(c)[0].as_py() for c in ("lon0", "lat0")])
        one = side / 2.0**level
        inside = np.inf * np.ones(len(asks))
        for axis in (0, 1):
            low, high = (v * one for v in _span(tile[axis], up))
            place = x[asks, axis] - start[axis]
            if low > 0:
                inside = np.minimum(inside, place - low)
            if high < side:
                inside = np.minimum(inside, high - place)
        seen = np.flatnonzero(part.column("seen").to_numpy())
        dist, enough = nearest_by_weight(x[asks], x[seen], weight[seen], part.column("k__").to_numpy()[asks])
        final = np.isinf(inside) | (enough & (dist <= inside - 1e-9 * one - 1e-14 * side))
        out = part.select([*keys, *rest]).take(pa.array(asks))
        return out.append_column("k_dist", pa.array(dist)).append_column("final", pa.array(final))

    return rows.groupBy(*keys).applyInArrow(run, schema)


def _compared(points: DataFrame, period: str, k: int | str) -> DataFrame:
    ship(points.sparkSession)
    kind = dict(points.dtypes)[period]
    more = [k] if isinstance(k, str) else []

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        wanted = int(rows[k].iloc[0]) if isinstance(k, str) else k
        return pd.DataFrame({period: rows[period], "event_id": rows["event_id"], "k_dist": kth_distance(rows, wanted)})

    return points.select(period, "event_id", "lon", "lat", *more).groupBy(period).applyInPandas(run, f"`{period}` {kind}, event_id long, k_dist double")


def spaced(nodes: DataFrame, score: str | Column, spacing_m: float, *, max_abs_lat: float = 60.0) -> DataFrame:
    """The nodes that a greedy pass by falling score (or a rising order column) accepts, each at least ``spacing_m`` from
    all accepted before.

    The pass is sequential only between nodes that are close: in rounds, a node is accepted once no undecided better
    one is close, and turned down once an accepted one is. The result is that of the sequential pass. Only the first node
    of each position takes part: what turns it down turns down the others there, and so does it where it is accepted.
    """
    order = F.struct((-F.col(score) if isinstance(score, str) else score).alias("s"), F.col("node_id").alias("n"))
    ranked = nodes.select("node_id", "lon", "lat", order.alias("rank"))
    if spacing_m > 0:
        ranked = ranked.groupBy("lon", "lat").agg(F.min("rank").alias("rank")).select(F.col("rank.n").alias("node_id"), "lon", "lat", "rank")
    ranked = written(ranked, "ranked")
    step_lon, step_lat = degree_steps(spacing_m, max_abs_lat)
    keyed = ranked.withColumns({"cell_x": cell(F.col("lon"), step_lon), "cell_y": cell(F.col("lat"), step_lat)})
    other = keyed.select(F.col("node_id").alias("better"), F.col("lon").alias("lon2"), F.col("lat").alias("lat2"), F.col("rank").alias("rank2"), _around("cell_x").alias("x2"), "cell_y")
    other = other.select("better", "lon2", "lat2", "rank2", "x2", _around("cell_y").alias("y2"))
    close = (F.col("cell_x") == F.col("x2")) & (F.col("cell_y") == F.col("y2")) & (F.col("rank2") < F.col("rank"))
    near = keyed.join(other, close & (haversine_m(F.col("lon"), F.col("lat"), F.col("lon2"), F.col("lat2")) < spacing_m))
    near = written(near.select("node_id", "better"), "near")
    state = written(ranked.select("node_id", F.lit(0).alias("state")), "state")  # 0 open, 1 accepted, 2 turned down
    while state.where("state = 0").limit(1).count():
        met = near.join(state.select(F.col("node_id").alias("better"), F.col("state").alias("other")), "better")
        seen = met.groupBy("node_id").agg(F.max((F.col("other") == 1).cast("int")).alias("beaten"), F.max((F.col("other") == 0).cast("int")).alias("waits"))
        turn = F.when(F.col("state") != 0, F.col("state")).when(F.coalesce("beaten", F.lit(0)) == 1, 2).when(F.coalesce("waits", F.lit(0)) == 1, 0).otherwise(1)
        state = written(state.join(seen, "node_id", "left").select("node_id", turn.alias("state")), "state")
    return nodes.join(state.where("state = 1").select("node_id"), "node_id", "left_semi")


#: Nodes of one side of a tile of the distance matrix; below the 4,096 rows that a merge join holds without spilling.
TILE_NODES = 2_048


def distance_matrix(nodes: DataFrame, by: list[str] | None = None) -> DataFrame:
    """All ordered pairs of one instance's nodes with their distance, by definition as many as the square of its nodes.

    Pairs are made in tiles of about ``TILE_NODES`` nodes on each side, dealt over all tasks whatever the instances' sizes.
    """
    by = by or []
    parts = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sizes = nodes.groupBy(*by).agg(F.ceil(F.count("*") / TILE_NODES).alias("tiles")).where("tiles > 0")
    sized = nodes.join(sizes, by) if by else nodes.crossJoin(F.broadcast(sizes))
    own, each = F.pmod(F.xxhash64("node_id"), F.col("tiles")), F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1))
    keys = [*by, "tile", "other_tile"]
    a = sized.select(*by, "node_id", "x", "y", own.alias("tile"), each.alias("other_tile")).repartition(parts, *keys)
    b = sized.select(*by, F.col("node_id").alias("other_id"), F.col("x").alias("x2"), F.col("y").alias("y2"), own.alias("other_tile"), each.alias("tile")).repartition(parts, *keys)
    dx, dy = F.col("x") - F.col("x2"), F.col("y") - F.col("y2")
    return a.join(b.hint("merge"), keys).select(*by, "node_id", "other_id", (F.sqrt(dx * dx + dy * dy) * 100.0).alias("distance"))


def with_depot(nodes: DataFrame, by: list[str] | None = None) -> DataFrame:
    """``nodes`` (by, node_id, x, y) with the depot of each instance as node -1 at (0, 0)."""
    by = by or []
    keys = nodes.select(*by).distinct() if by else nodes.sparkSession.range(1).drop("id")
    depot = keys.select(*by, F.lit(-1).cast("long").alias("node_id"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))
    return nodes.select(*by, "node_id", "x", "y").unionByName(depot)


def first_positions(points: DataFrame, order: str) -> DataFrame:
    """The first row by ``order`` of each position."""
    rest = F.struct(F.col(order), F.struct(*[F.col(c) for c in points.columns]).alias("row"))
    return points.groupBy("lon", "lat").agg(F.min(rest).alias("first")).select("first.row.*")


def symmetric_neighbours(points: DataFrame, k: int) -> DataFrame:
    """Edges (src, dst, w) of the k-nearest graph plus its transpose, for data sets of the experiment harness.

    The points are counted first; more than BROADCAST_ROWS are an error.
    """
    cols = [c for c in points.columns if c != "id"]
    if points.limit(BROADCAST_ROWS + 1).count() > BROADCAST_ROWS:
        raise ValueError(f"over {BROADCAST_ROWS} points; use range joins on cells instead")
    whole = points.toPandas()  # counted above
    session = points.sparkSession
    shared = session.sparkContext.broadcast((whole[cols].to_numpy(float), whole["id"].to_numpy()))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        x, ids = shared.value
        for part in batches:
            d = ((part[cols].to_numpy(float)[:, None] - x[None]) ** 2).sum(axis=2)
            near = np.argsort(d, axis=1, kind="stable")[:, :k]
            yield pd.DataFrame({"src": np.repeat(part["id"].to_numpy(), k), "dst": ids[near].ravel()})

    ship(session)
    one = session.createDataFrame(whole).mapInPandas(run, "src long, dst long")
    both = one.union(one.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    return both.groupBy("src", "dst").agg(F.count("*").cast("double").alias("w"))
