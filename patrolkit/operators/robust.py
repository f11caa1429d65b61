"""Penalties of a selection: nominal, worst-case box, and distributionally robust over a Wasserstein ball."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from patrolkit.plans.shared_tables import ship, small, written

PENALTY = 4000.0


def missed(prizes: DataFrame, visited: DataFrame, period: str = "day", by: list[str] | None = None) -> DataFrame:
    """``(by, period, missed, collected, total, room, unvisited)`` for every selection and period.

    ``visited`` holds (by, node_id); ``room`` is 1 minus the largest unvisited prize. Selections without any node must
    be given by a row with a null node_id.
    """
    by = by or []
    marks = visited.where("node_id is not null").select(*by, "node_id", F.lit(True).alias("seen"))
    if by:
        grid = prizes.crossJoin(small(visited.select(*by).distinct()))  # few selections, each over all prizes
        joined = grid.join(small(marks), [*by, "node_id"], "left")
    else:
        joined = prizes.join(small(marks), "node_id", "left")
    open_ = F.col("seen").isNull()
    return joined.groupBy(*by, period).agg(
        F.sum(F.when(open_, F.col("prize")).otherwise(0.0)).alias("missed"), F.sum(F.when(open_, 0.0).otherwise(F.col("prize"))).alias("collected"),
        F.sum("prize").alias("total"), (1 - F.max(F.when(open_, F.col("prize")))).alias("room"), F.sum(open_.cast("int")).alias("unvisited"),
    )


def nominal(misses: DataFrame, scale: float = PENALTY, by: list[str] | None = None) -> DataFrame:
    """scale times the mean missed prize."""
    return misses.groupBy(*(by or [])).agg((F.lit(scale) * F.avg("missed")).alias("penalty"), F.max("unvisited").alias("unvisited"))


def box(misses: DataFrame, scale: float = PENALTY, by: list[str] | None = None) -> DataFrame:
    """scale for every unvisited node."""
    return misses.groupBy(*(by or [])).agg((F.lit(scale) * F.max("unvisited")).alias("penalty"))


def robust_bound(misses: DataFrame, radii: DataFrame, scale: float = PENALTY, by: list[str] | None = None) -> DataFrame:
    """``(by, epsilon, penalty, certified)``: scale * (epsilon * sqrt(m) + mean missed).

    That is the exact robust penalty when epsilon <= sqrt(m) * mean room (``certified``), else an upper bound: the dual
    is convex in s with slope epsilon - sqrt(m) * mean room at its right end s = sqrt(m), where the excess vanishes.
    """
    by = by or []
    stats = misses.groupBy(*by).agg(F.avg("missed").alias("mean_missed"), F.avg(F.coalesce("room", F.lit(0.0))).alias("mean_room"), F.max("unvisited").alias("m"))
    root = F.sqrt(F.col("m").cast("double"))
    value = F.when(F.col("m") == 0, 0.0).otherwise(F.lit(scale) * (F.col("epsilon") * root + F.col("mean_missed")))
    sure = (F.col("m") == 0) | (F.col("epsilon") <= root * F.col("mean_room"))
    return stats.crossJoin(F.broadcast(radii.select("epsilon"))).select(*by, "epsilon", value.alias("penalty"), sure.alias("certified"))


def common_level(room: np.ndarray, s: float) -> np.ndarray:
    """For each row of sorted rooms the maximiser of sum(d) - s * |d| over 0 <= d <= room, by its common level.

    The small rooms are filled, the others share one level c with c^2 * (s^2 - others) = sum of the filled squares. The
    first count of filled rooms whose level fits between its neighbours is the answer; none: all rooms are filled.
    """
    periods, m = room.shape
    if s <= 0:
        return room.copy()
    if s >= np.sqrt(m):
        return np.zeros_like(room)
    squares = np.concatenate([np.zeros((periods, 1)), np.cumsum(room**2, axis=1)], axis=1)
    filled = np.arange(m)
    rest = s * s - (m - filled)
    with np.errstate(divide="ignore", invalid="ignore"):
        level = np.sqrt(squares[:, :m] / rest)
    level[:, rest <= 0] = np.inf
    fits = level <= room + 1e-12  # the first count whose level no longer passes the next room
    at = np.where(fits.any(axis=1), fits.argmax(axis=1), m)
    chosen = np.where(at < m, np.take_along_axis(level, np.minimum(at, m - 1)[:, None], axis=1)[:, 0], np.inf)
    return np.minimum(room, chosen[:, None])


def robust_value(samples: np.ndarray, unvisited: np.ndarray, epsilon: float, scale: float = PENALTY, rounds: int = 100) -> tuple[float, float]:
    """``(penalty, lambda)`` of the exact one-dimensional dual, by bisection on its slope.

    With g(s) the mean norm of the maximisers, the dual's slope is epsilon - g(s), and g falls in s.
    """
    n, m = samples.shape[1], int(unvisited.sum())
    if m == 0:
        return 0.0, float(np.sqrt(n))
    seen = samples[:, unvisited]
    base, room = seen.sum(axis=1), np.sort(1.0 - seen, axis=1)

    def at(s: float) -> tuple[float, float]:
        d = common_level(room, s)
        norm = np.sqrt((d**2).sum(axis=1))
        return epsilon * s + float(np.mean(base + np.maximum(0.0, d.sum(axis=1) - s * norm))), epsilon - float(norm.mean())

    return _least(at, m, scale, rounds)


def _least(at: Callable[[float], tuple[float, float]], m: int, scale: float, rounds: int) -> tuple[float, float]:
    """``(penalty, lambda)`` of the least value of a convex dual; ``at`` gives its value and slope."""
    low, high = 0.0, float(np.sqrt(m))
    if at(high * (1 - 1e-9))[1] <= 0:
        return scale * at(high)[0], scale * high
    for _ in range(rounds):
        mid = (low + high) / 2
        low, high = (mid, high) if at(mid)[1] < 0 else (low, mid)
    best = min(((at(s)[0], s) for s in (0.0, low, high, float(np.sqrt(m)))), key=lambda v: v[0])
    return scale * best[0], scale * best[1]


def level_sums(room: np.ndarray, weight: np.ndarray) -> Callable[[float], tuple[np.ndarray, np.ndarray]]:
    """Of :func:`common_level`'s maximisers at s the sums and norms by row, where ``weight`` nodes have each rising room.

    Nodes of one room are filled together or not at all, so the level is looked for between the different rooms only.
    Weights of 0 fill up shorter rows.
    """
    before = lambda v: np.cumsum(v, axis=1) - v
    nodes, held, first, second = weight.sum(axis=1), before(weight), before(weight * room), before(weight * room**2)
    whole = (weight * room).sum(axis=1), np.sqrt((weight * room**2).sum(axis=1))
    open_ = nodes[:, None] - held

    def at(s: float) -> tuple[np.ndarray, np.ndarray]:
        if s <= 0:
            return whole
        rest = s * s - open_
        with np.errstate(divide="ignore", invalid="ignore"):
            level = np.sqrt(second / rest)
        level[rest <= 0] = np.inf
        fits = (level <= room + 1e-12) & (weight > 0)
        pick = lambda v: np.take_along_axis(v, fits.argmax(axis=1)[:, None], axis=1)[:, 0]
        with np.errstate(invalid="ignore"):
            c, more = pick(level), pick(open_)
            total, norm = pick(first) + c * more, np.sqrt(pick(second) + c * c * more)
        shared, none = fits.any(axis=1), s >= np.sqrt(nodes)
        return tuple(np.where(none, 0.0, np.where(shared, a, b)) for a, b in zip((total, norm), whole, strict=True))

    return at


def counted_value(missed: np.ndarray, room: np.ndarray, weight: np.ndarray, epsilon: float, scale: float = PENALTY, rounds: int = 100) -> tuple[float, float]:
    """What :func:`robust_value` gives, from each period's missed prize, its different rooms and their numbers of nodes."""
    sums = level_sums(room, weight)

    def at(s: float) -> tuple[float, float]:
        total, norm = sums(s)
        return epsilon * s + float(np.mean(missed + np.maximum(0.0, total - s * norm))), epsilon - float(norm.mean())

    return _least(at, int(weight.sum(axis=1).max()), scale, rounds)


#: Rooms of all selections and periods, equal ones counted once, up to which one task evaluates the periods of a selection;
#: of more, a task sees one period at a time.
MATRIX_CELLS = 2_000_000


def robust(prizes: DataFrame, selections: DataFrame, period: str = "day", scale: float = PENALTY, cells: int = MATRIX_CELLS, grid: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """``(selection, epsilon, penalty, multiplier)`` of the exact dual for every row ``(selection, epsilon, nodes)``.

    The dual depends on a period's unvisited prizes and how many nodes have each, so these are counted first
    (:func:`open_rooms`), and equal selections are evaluated once for each radius. With ``grid``, the nodes and the
    periods, ``prizes`` may leave out prizes of 0.
    """
    prizes = written(prizes.select(period, "node_id", "prize"), "robust_prizes")  # read three times
    grid = grid and (grid[0], grid[1].select(period).distinct())
    keyed = _keyed(selections, ["epsilon"])
    made = _dual(rooms_of(prizes, selections, period, grid), keyed.select("set", "epsilon").distinct(), ["epsilon"], period, scale, cells)
    root = float(np.sqrt((grid[0] if grid else prizes).select("node_id").distinct().count()))  # where nothing is unvisited
    return keyed.join(made, ["set", "epsilon"], "left").select("selection", "epsilon", F.coalesce("penalty", F.lit(0.0)).alias("penalty"), F.coalesce("multiplier", F.lit(root)).alias("multiplier"))


def robust_over_spans(prizes: DataFrame, index: str, tasks: DataFrame, scale: float = PENALTY, cells: int = MATRIX_CELLS, rooms: DataFrame | None = None) -> DataFrame:
    """``(case, model, epsilon, selection, penalty)`` for every task (case, model, epsilon, first, last, selection, nodes).

    A task sees the periods whose number ``index`` lies in first..last. SP has radius 0; RO costs ``scale`` for every
    unvisited node. The rooms are counted once for all cases, unless :func:`rooms_of` the selections has them already.
    """
    rooms = rooms_of(prizes, tasks, index) if rooms is None else rooms
    keyed = _keyed(tasks, ["case", "model", "epsilon", "first", "last"]).withColumn("radius", F.when(F.col("model") == "SP", 0.0).otherwise(F.col("epsilon")))
    of = ["radius", "first", "last"]
    dual = _dual(rooms, keyed.where("model != 'RO'").select("set", *of).distinct(), of, index, scale, cells)
    worst = rooms.groupBy("set", index).agg(F.sum("n").alias("n")).groupBy("set").agg((F.lit(scale) * F.max("n")).alias("worst"))
    value = F.coalesce(F.when(F.col("model") == "RO", F.col("worst")).otherwise(F.col("penalty")), F.lit(0.0))
    return keyed.join(dual, ["set", *of], "left").join(worst, "set", "left").select("case", "model", "epsilon", "selection", value.alias("penalty"))


def _named(selections: DataFrame) -> DataFrame:
    """``selections`` with their nodes, each once and rising, and ``set``: the name that equal node sets share."""
    each = F.array_except(F.coalesce("nodes", F.expr("array()").cast("array<long>")), F.expr("array(cast(null as long))"))  # distinct too
    nodes = F.sort_array(each)  # by no comparator: array_sort interprets one for every two nodes
    return selections.withColumn("nodes", nodes).withColumn("set", F.sha2(F.array_join("nodes", ","), 256))


def _keyed(selections: DataFrame, keys: list[str]) -> DataFrame:
    return written(_named(selections).select("set", "selection", *keys), "robust_tasks")


def _sets(selections: DataFrame) -> DataFrame:
    return _named(selections).groupBy("set").agg(F.first("nodes").alias("nodes"))


def rooms_of(prizes: DataFrame, selections: DataFrame, period: str, grid: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """:func:`open_rooms` of selections given as rows with an array ``nodes``, equal ones once."""
    return open_rooms(prizes, _sets(selections), period, grid)


def open_rooms(prizes: DataFrame, sets: DataFrame, period: str, grid: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """``(set, period, prize, n)``: how many nodes that a set leaves unvisited have each prize in a period.

    Those of all nodes less those of the set's nodes, so that no table of selections by periods by nodes is made. Prizes
    are counts over the period's largest: of p pings a period has at most sqrt(2 p) + 1 different ones.

    With ``grid``, (nodes, periods), every node has a prize in each row of periods, 0 where ``prizes`` has no row. The
    zeros are not made: they are the unvisited nodes less those with another prize.
    """
    sets = written(sets, "node_sets")
    if grid:
        prizes = prizes.where("prize != 0")
    every = prizes.groupBy(period, "prize").agg(F.count("*").alias("held")).crossJoin(small(sets.select("set")))
    marks = sets.select("set", F.explode("nodes").alias("node_id"))
    taken = prizes.join(small(marks), "node_id").groupBy("set", period, "prize").agg(F.count("*").alias("taken"))
    left = every.join(taken, ["set", period, "prize"], "left").withColumn("n", F.col("held") - F.coalesce("taken", F.lit(0)))
    left = left.where("n > 0").select("set", period, "prize", "n")
    if grid:
        left = written(left, "prize_rooms")  # read twice
        left = left.unionByName(_zero_rooms(left, sets, marks, period, *grid))
    return written(left, "rooms")


def _zero_rooms(rooms: DataFrame, sets: DataFrame, marks: DataFrame, period: str, nodes: DataFrame, periods: DataFrame) -> DataFrame:
    """The rows that ``rooms`` of other prizes lack: how many unvisited nodes have a prize of 0 in each period."""
    nodes = nodes.select("node_id").distinct()
    visited = marks.join(nodes, "node_id").groupBy("set").agg(F.count("*").alias("visited"))
    open_ = sets.select("set").join(visited, "set", "left").select("set", (F.lit(nodes.count()) - F.coalesce("visited", F.lit(0))).alias("open"))
    every = periods.select(period).dropna().groupBy(period).agg(F.count("*").alias("times")).crossJoin(F.broadcast(open_))  # few sets
    paid = rooms.groupBy("set", period).agg(F.sum("n").alias("paid"))
    zero = every.join(paid, ["set", period], "left").withColumn("n", F.col("open") * F.col("times") - F.coalesce("paid", F.lit(0)))
    return zero.where("n > 0").select("set", period, F.lit(0.0).alias("prize"), "n")


def _dual(rooms: DataFrame, tasks: DataFrame, keys: list[str], period: str, scale: float, cells: int) -> DataFrame:
    """``(set, keys, penalty, multiplier)`` of the dual for every task (set, keys) whose set leaves nodes unvisited.

    The first key is the radius; with two more, a task sees the periods from one to the other. Up to ``cells`` rooms a
    task evaluates the periods of its set; more go through :func:`robust_by_rows`.
    """
    if rooms.count() > cells:
        return robust_by_rows(rooms, tasks, keys, period, scale)
    ship(rooms.sparkSession)
    kinds = dict(tasks.dtypes)

    def run(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["period__", "prize"], ascending=[True, False])
        row = part.groupby("period__").ngroup().to_numpy()
        place = part.groupby("period__").cumcount().to_numpy()
        room, weight = (np.zeros((row.max() + 1, place.max() + 1)) for _ in range(2))
        room[row, place], weight[row, place] = 1.0 - part["prize"].to_numpy(), part["n"].to_numpy()
        missed_ = np.bincount(row, part["prize"].to_numpy() * part["n"].to_numpy())
        return pd.DataFrame([(*key, *counted_value(missed_, room, weight, float(key[1]), scale))], columns=["set", *keys, "penalty", "multiplier"])

    met = rooms.withColumnRenamed(period, "period__").join(small(tasks), "set")
    if len(keys) > 1:
        met = met.where(F.col("period__").between(F.col(keys[1]), F.col(keys[2])))
    schema = ", ".join(["set string", *(f"{k} {kinds[k]}" for k in keys), "penalty double, multiplier double"])
    return met.groupBy("set", *keys).applyInPandas(run, schema)


#: Points of the dual's range that one pass over the periods evaluates, and passes; each narrows the range to two steps.
POINTS, PASSES = 33, 12


def robust_by_rows(rooms: DataFrame, tasks: DataFrame, keys: list[str], period: str, scale: float = PENALTY) -> DataFrame:
    """What :func:`_dual` gives, with one row a set and period: its missed prize, its different rooms and their counts.

    The dual is convex in s, so the least of POINTS values and its neighbours bound the minimum. A pass evaluates all
    points of all tasks over the rows and adds them up by groups; only the points go to the tasks.
    """
    spark = rooms.sparkSession
    ship(spark)
    kinds = dict(tasks.dtypes)
    grid = [tuple(r) for r in tasks.select("set", *keys).collect()]  # the tasks
    pairs = F.array_sort(F.collect_list(F.struct((1.0 - F.col("prize")).alias("room"), "n")))
    rows = rooms.groupBy("set", F.col(period).alias("period__")).agg(F.sum(F.col("prize") * F.col("n")).alias("missed"), F.sum("n").alias("m"), pairs.alias("pairs"))
    rows = rows.select("set", "period__", "missed", "m", F.col("pairs.room").alias("room"), F.col("pairs.n").alias("n")).repartition(2 * spark.sparkContext.defaultParallelism)
    rows = written(rows, "room_rows")
    sizes: dict[str, int] = {r["set"]: r["m"] for r in rows.groupBy("set").agg(F.max("m").alias("m")).collect()}
    bounds = {key: (0.0, float(np.sqrt(sizes[key[0]]))) for key in grid if key[0] in sizes}
    best: dict[tuple, tuple[float, float]] = {}
    for _ in range(PASSES):
        points = {key: np.linspace(*ends, POINTS) for key, ends in bounds.items()}

        def evaluate(batches: Iterator[pd.DataFrame], points=points) -> Iterator[pd.DataFrame]:
            numbered = list(points.items())
            for part in batches:
                out = []
                for name, at, missed_, room, n in zip(part["set"], part["period__"], part["missed"], part["room"], part["n"], strict=True):
                    sums = level_sums(np.asarray(room, float)[None], np.asarray(n, float)[None])
                    for task, (key, some) in enumerate(numbered):
                        if key[0] == name and (len(key) == 2 or key[2] <= at <= key[3]):
                            for i, s in enumerate(some):
                                total, norm = sums(float(s))
                                out.append((task, i, key[1] * s + missed_ + max(0.0, float(total[0] - s * norm[0]))))
                yield pd.DataFrame(out, columns=["task", "point", "value"])

        made = rows.mapInPandas(evaluate, "task int, point int, value double")
        table: dict[tuple, np.ndarray] = {}
        numbered = list(points)
        for r in made.groupBy("task", "point").agg(F.avg("value").alias("value")).collect():  # POINTS a task
            table.setdefault(numbered[r["task"]], np.full(POINTS, np.inf))[r["point"]] = r["value"]
        for key, values in table.items():
            i = int(values.argmin())
            best[key] = (float(values[i]), float(points[key][i]))
            bounds[key] = (float(points[key][max(0, i - 1)]), float(points[key][min(POINTS - 1, i + 1)]))
    schema = ", ".join(["set string", *(f"{k} {kinds[k]}" for k in keys), "penalty double, multiplier double"])
    return spark.createDataFrame([(*key, *(scale * v for v in value)) for key, value in best.items()], schema)
