"""Capacitated routes: start plans, a light seeded improvement, its augmented variants, and feasibility as columns."""

from __future__ import annotations

import json

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from patrolkit.plans.shared_tables import ship

#: Rounds without a gain that end a search; the reach of reversals; routes and customers looked at in a move.
PATIENCE = 3
REACH = 5
SAMPLED = 9
GAIN = 1e-6


def distances(xy: np.ndarray, rounded: bool = False) -> np.ndarray:
    """All leg lengths; row 0 is the depot. ``rounded``: half to even, as the benchmark format counts."""
    gap = xy[:, None] - xy[None]
    d = np.sqrt((gap**2).sum(axis=2))
    return np.rint(d) if rounded else d


def length(d: np.ndarray, route: list[int]) -> float:
    path = [0, *route, 0]
    return float(d[path[:-1], path[1:]].sum())


def sweep(xy: np.ndarray, demand: np.ndarray, capacity: float) -> list[list[int]]:
    """Customers by angle about the depot, a new route whenever the load would exceed the capacity."""
    order = np.argsort(np.arctan2(xy[1:, 1] - xy[0, 1], xy[1:, 0] - xy[0, 0]), kind="stable") + 1
    routes, load = [[]], 0.0
    for c in order.tolist():
        if routes[-1] and load + demand[c] > capacity + 1e-9:
            routes.append([])
            load = 0.0
        routes[-1].append(c)
        load += demand[c]
    return routes if routes[0] else []


def reversed_stretch(d: np.ndarray, route: list[int]) -> list[int]:
    """The route with its best reversal of up to REACH stops."""
    path = [0, *route, 0]
    best, at = GAIN, None
    for i in range(1, len(path) - 2):
        for j in range(i + 1, min(i + REACH, len(path) - 1)):
            gain = d[path[i - 1], path[i]] + d[path[j], path[j + 1]] - d[path[i - 1], path[j]] - d[path[i], path[j + 1]]
            if gain > best:
                best, at = gain, (i, j)
    if at is None:
        return route
    i, j = at
    return (path[:i] + path[i : j + 1][::-1] + path[j + 1 :])[1:-1]


def moved_stop(d: np.ndarray, route: list[int]) -> list[int]:
    """The route with the first stop that is better off at its start, middle or end."""
    now = length(d, route)
    for i, stop in enumerate(route):
        rest = route[:i] + route[i + 1 :]
        for j in {0, len(rest) // 2, len(rest)}:
            made = rest[:j] + [stop] + rest[j:]
            if length(d, made) < now - GAIN:
                return made
    return route


def relocated(d: np.ndarray, routes: list[list[int]], demand: np.ndarray, capacity: float, draw: np.random.Generator) -> bool:
    """Moves one of a few sampled customers to its cheapest place in another route with room, if that pays."""
    where = [(r, i) for r, route in enumerate(routes) for i in range(len(route))]
    for r, i in (where[j] for j in draw.permutation(len(where))[:SAMPLED]):
        stop, source = routes[r][i], [0, *routes[r], 0]
        saved = d[source[i], stop] + d[stop, source[i + 2]] - d[source[i], source[i + 2]]
        for t, target in enumerate(routes):
            if t == r or demand[target].sum() + demand[stop] > capacity + 1e-9:
                continue
            path = np.array([0, *target, 0])
            added = d[path[:-1], stop] + d[stop, path[1:]] - d[path[:-1], path[1:]]
            p = int(added.argmin())
            if added[p] < saved - GAIN:
                routes[r].pop(i)
                target.insert(p, stop)
                return True
    return False


def exchanged(d: np.ndarray, routes: list[list[int]], demand: np.ndarray, capacity: float, draw: np.random.Generator, tries: int = 5) -> bool:
    """The first of ``tries`` drawn swaps of two customers of different routes that fits and shortens; in place."""
    full = [k for k, r in enumerate(routes) if r]
    if len(full) < 2:
        return False
    for _ in range(tries):
        a, b = draw.permutation(full)[:2].tolist()
        i, j = int(draw.integers(len(routes[a]))), int(draw.integers(len(routes[b])))
        one, two = list(routes[a]), list(routes[b])
        one[i], two[j] = two[j], one[i]
        fits = max(demand[one].sum(), demand[two].sum()) <= capacity + 1e-9
        if fits and length(d, one) + length(d, two) < length(d, routes[a]) + length(d, routes[b]) - GAIN:
            routes[a], routes[b] = one, two
            return True
    return False


def batched_two_opt(d: np.ndarray, tours: np.ndarray, rounds: int) -> np.ndarray:
    """Closed tours (a row each) over the leg lengths of each (batch x n x n) after up to ``rounds`` best reversals at once."""
    tours, batch = tours.copy(), np.arange(len(tours))[:, None]
    n = tours.shape[1]
    i, j = np.triu_indices(n, 2)
    keep = ~((i == 0) & (j == n - 1))
    i, j = i[keep], j[keep]
    for _ in range(rounds):
        legs = lambda x, y: d[batch, x, y]
        a, b, c, e = tours[:, i], tours[:, i + 1], tours[:, j], tours[:, (j + 1) % n]
        gain = legs(a, b) + legs(c, e) - legs(a, c) - legs(b, e)
        best = gain.argmax(axis=1) if gain.shape[1] else np.zeros(len(tours), int)
        better = np.flatnonzero(gain[np.arange(len(tours)), best] > GAIN) if gain.shape[1] else np.empty(0, int)
        if not len(better):
            break
        for t in better.tolist():
            low, high = i[best[t]] + 1, j[best[t]] + 1
            tours[t, low:high] = tours[t, low:high][::-1]
    return tours


def improve(d: np.ndarray, routes: list[list[int]], demand: np.ndarray, capacity: float, rounds: int, seed: int, patience: int | None = PATIENCE) -> tuple[list[list[int]], list[float]]:
    """Routes after light local search, and the best length after each round; ends after ``patience`` rounds without a gain
    (None: only after all rounds)."""
    draw = np.random.default_rng(seed)
    routes = [list(r) for r in routes]
    track, idle = [sum(length(d, r) for r in routes)], 0
    for _ in range(rounds):
        routes = [moved_stop(d, reversed_stretch(d, r)) for r in routes]
        exchanged(d, routes, demand, capacity, draw)
        relocated(d, routes, demand, capacity, draw)
        routes = [r for r in routes if r]
        now = sum(length(d, r) for r in routes)
        idle = 0 if now < track[-1] - GAIN else idle + 1
        track.append(min(now, track[-1]))
        if patience is not None and idle >= patience:
            break
    return routes, track


RECORD = "instance long, n long, augment int, start_cost double, cost double, rounds int, routes string, track string"


def best_at_rounds(plans: DataFrame, rounds: list[int]) -> DataFrame:
    """``(instance, round, best_cost)``: the best cost that each plan's search had after the given rounds."""
    track = plans.select("instance", F.from_json("track", "array<double>").alias("track"))
    at = track.withColumn("round", F.explode(F.array(*[F.lit(r) for r in rounds])))
    return at.select("instance", "round", F.element_at("track", F.least(F.col("round") + 1, F.size("track"))).alias("best_cost"))


def search(stops: DataFrame, capacity: float, rounds: int = 50, seed: int = 1, augment: int = 8, patience: int | None = PATIENCE) -> DataFrame:
    """Best routes of each instance over start plans from the eight turned and mirrored maps.

    ``stops`` holds (instance, node, x, y, demand); node 0 is the depot. One instance is a task; instances are bounded.
    """
    ship(stops.sparkSession)

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("node")
        xy, demand = rows[["x", "y"]].to_numpy(float), rows["demand"].to_numpy(float)
        d, names = distances(xy), rows["node"].tolist()
        best = None
        for turn in range(augment):
            seen = xy * np.array([1 - 2 * (turn & 1), 1 - (turn & 2)]) if turn < 4 else xy[:, ::-1] * np.array([1 - 2 * (turn & 1), 1 - (turn & 2)])
            start = sweep(seen, demand, capacity)
            routes, track = improve(d, start, demand, capacity, rounds, seed + turn, patience)
            if best is None or track[-1] < best[1][-1]:
                best = (routes, track, turn)
        routes, track, turn = best
        return pd.DataFrame({"instance": [int(rows["instance"].iloc[0])], "n": [len(rows) - 1], "augment": [turn], "start_cost": [track[0]], "cost": [sum(length(d, r) for r in routes)], "rounds": [len(track) - 1], "routes": [json.dumps([[int(names[i]) for i in r] for r in routes])], "track": [json.dumps(track)]})

    return stops.select("instance", "node", "x", "y", "demand").groupBy("instance").applyInPandas(run, RECORD)


def feasibility(plans: DataFrame, stops: DataFrame, capacity: float) -> DataFrame:
    """``(instance, missed, repeated, largest_load, feasible)`` of plans ``(instance, routes)`` with JSON routes."""
    visits = plans.select("instance", F.posexplode(F.from_json("routes", "array<array<bigint>>")).alias("vehicle", "route")).select("instance", "vehicle", F.explode("route").alias("node"))
    customers = stops.where("node <> 0").select("instance", "node", "demand")
    seen = visits.groupBy("instance", "node").agg(F.count("*").alias("times"))
    each = customers.join(seen, ["instance", "node"], "left").groupBy("instance").agg(F.count_if(F.col("times").isNull()).alias("missed"), F.count_if(F.col("times") > 1).alias("repeated"))
    load = visits.join(customers, ["instance", "node"]).groupBy("instance", "vehicle").agg(F.sum("demand").alias("load")).groupBy("instance").agg(F.max("load").alias("largest_load"))
    joined = each.join(load, "instance", "left")
    ok = (F.col("missed") == 0) & (F.col("repeated") == 0) & (F.coalesce("largest_load", F.lit(0.0)) <= capacity + 1e-9)
    return joined.select("instance", "missed", "repeated", "largest_load", ok.alias("feasible"))
