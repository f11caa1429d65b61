"""Routes: costs and feasibility as columns, and a seeded search for selections and routes inside Arrow tasks."""

from __future__ import annotations

import json
import math
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace
from functools import cached_property

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from patrolkit.functions.geo import COST_PER_KM, local_km, polar_angle
from patrolkit.plans.shared_tables import ship

from .robust import robust_value

#: Fixed values of the search: tolerances of the budget and of a gain, the share of good insertions drawn from, the share
#: of nodes ruined, the chance to accept a worse plan, nodes on each side of an exchange, the largest share of nodes that a
#: weighted removal takes, the rewards (new best, better, accepted, refused), their weight, and the cooling.
TOLERANCE = 1e-7
GAIN = 1e-8
CANDIDATE_SHARE = 0.2
RUIN_SHARE = 0.08
ACCEPT_WORSE = 0.1
EXCHANGED = 12
#: Nodes of an instance whose distances are held as a table; of more, legs are measured as they are asked for. Stops of a
#: route up to which single legs are compared, and how many are compared at once beyond.
TABLE_NODES = 1_000
SHORT_ROUTE, LEG_BLOCK = 50, 4_096
#: Fixed values of the learned removals: the largest share of the nodes that goes, the rewards of a plan that is the best
#: so far, better, taken and turned down, how fast weights follow them, and how fast and from where the heat falls.
REMOVAL_SHARE = 0.15
REWARDS = {"best": 5.0, "better": 2.0, "taken": 1.0, "turned down": 0.0}
REACTION = 0.2
COOLING, FIRST_HEAT = 0.995, 0.01
#: What ``solve`` knows: seeded random starts; ruin and repair from a greedy start; weighted removals with cooling; angular
#: sectors cut to the budget, as they are, with two-opt, and with ruin and repair; and a greedy start with ruin and repair.
METHODS = ("grasp", "ils", "alns", "cut", "cut two-opt", "warm", "greedy")


# ---- relational part -------------------------------------------------------------------------------------------------


def sector_routes(nodes: DataFrame, vehicles: int, by: str | None = None) -> DataFrame:
    """``(vehicle, pos, node_id, x, y)``: nodes by polar angle about the depot, in near-equal sectors.

    With ``by``, each value has routes of its own. One instance is ranked in one task: instances are bounded.
    """
    x, y = local_km(F.col("lon"), F.col("lat"))
    keys = [by] if by else []
    placed = nodes.withColumns({"x": x, "y": y})
    order = Window.partitionBy(*keys).orderBy(F.round(polar_angle(F.col("x"), F.col("y")), 9), "node_id")
    cut = placed.withColumn("vehicle", F.ntile(vehicles).over(order)).withColumn("turn", F.row_number().over(order))
    pos = F.row_number().over(Window.partitionBy(*keys, "vehicle").orderBy("turn"))
    return cut.select(*keys, F.col("vehicle").cast("long").alias("vehicle"), pos.cast("long").alias("pos"), "node_id", "x", "y")


def route_costs(routes: DataFrame, by: list[str] | None = None) -> DataFrame:
    """``(by, vehicle, stops, cost)``: legs between stops and from and to the depot (0, 0), in cost units."""
    keys = [*(by or []), "vehicle"]
    order = Window.partitionBy(*keys).orderBy("pos")
    legs = routes.withColumns({"px": F.coalesce(F.lag("x").over(order), F.lit(0.0)), "py": F.coalesce(F.lag("y").over(order), F.lit(0.0)), "last": F.lead("pos").over(order).isNull()})
    leg = F.sqrt((F.col("x") - F.col("px")) ** 2 + (F.col("y") - F.col("py")) ** 2)
    home = F.when(F.col("last"), F.sqrt(F.col("x") ** 2 + F.col("y") ** 2)).otherwise(0.0)
    return legs.groupBy(*keys).agg(F.count("*").alias("stops"), (F.sum(leg + home) * COST_PER_KM).alias("cost"))


def feasibility(routes: DataFrame, nodes: DataFrame, vehicles: int, budget: float) -> DataFrame:
    """One row: duplicates, unknown nodes, surplus vehicles, the longest route, and whether all is well."""
    costs = route_costs(routes).agg(F.count("*").alias("used"), F.max("cost").alias("longest"))
    twice = routes.groupBy("node_id").agg(F.count("*").alias("n")).agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicates"))
    unknown = routes.join(nodes.select("node_id"), "node_id", "left_anti").agg(F.count("*").alias("unknown"))
    every = costs.crossJoin(twice).crossJoin(unknown)  # one row each
    ok = (F.col("duplicates") == 0) & (F.col("unknown") == 0) & (F.col("used") <= vehicles) & (F.coalesce("longest", F.lit(0.0)) <= budget + TOLERANCE)
    return every.select("used", "longest", "duplicates", "unknown", ok.alias("feasible"))


# ---- search kernels --------------------------------------------------------------------------------------------------


def between(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Costs of the legs between places, the last axis holding their coordinates."""
    dx, dy = a[..., 0] - b[..., 0], a[..., 1] - b[..., 1]
    return np.sqrt(dx * dx + dy * dy) * COST_PER_KM


@dataclass
class Instance:
    """``xy`` in kilometres about the depot, prize ``samples`` (periods x nodes), and the search's limits."""

    xy: np.ndarray
    samples: np.ndarray
    vehicles: int
    budget: float
    epsilon: float
    scale: float
    evaluator: Callable[[Instance, np.ndarray], float] | None = None  # of the unvisited nodes; the robust penalty unless given
    known: dict[bytes, float] = field(default_factory=dict)

    def __post_init__(self):
        self.places = np.vstack([np.zeros((1, 2)), self.xy])  # the depot first
        self.means = self.samples.mean(axis=0)

    @cached_property
    def distance(self) -> np.ndarray:
        """All pairs of places; not used by full routes of more than ``TABLE_NODES`` nodes."""
        return between(self.places[:, None], self.places[None])

    @property
    def n(self) -> int:
        return len(self.xy)

    def cost(self, route: list[int]) -> float:
        if not route:
            return 0.0
        path = [0, *(i + 1 for i in route), 0]
        if self.n > TABLE_NODES:
            return float(between(self.places[path[:-1]], self.places[path[1:]]).sum())
        return float(self.distance[path[:-1], path[1:]].sum())

    def penalty(self, visited) -> float:
        open_ = np.ones(self.n, bool)
        open_[list(visited)] = False
        key = open_.tobytes()
        if key not in self.known:
            value = self.evaluator(self, open_) if self.evaluator else robust_value(self.samples, open_, self.epsilon, self.scale, rounds=50)[0]
            self.known[key] = float(value)
        return self.known[key]

    def value(self, routes: list[list[int]]) -> float:
        return sum(map(self.cost, routes)) + self.penalty({i for r in routes for i in r})


def box_penalty(inst: Instance, open_: np.ndarray) -> float:
    """The evaluator of the box model: the scale for every unvisited node."""
    return inst.scale * float(open_.sum())


def nearest_first(inst: Instance, nodes: list[int]) -> list[int]:
    """The nodes by repeated nearest neighbour from the depot; of equally near ones the smallest."""
    ids = np.unique(np.asarray(nodes, dtype=int))
    order = np.empty(len(ids), int)
    left = np.arange(len(ids))
    here = inst.places[0]
    rest, met = inst.places[ids + 1], np.zeros(len(ids), bool)
    for turn in range(len(ids)):
        far = between(rest, here)
        far[met] = np.inf
        row = int(far.argmin())
        order[turn], here, met[row] = left[row], rest[row].copy(), True
        if 2 * (len(left) - (len(ids) - turn - 1)) > len(left):  # half of the rest was met
            left, rest, met = left[~met], rest[~met], met[~met]
    return ids[order].tolist()


def two_opt(inst: Instance, route: list[int]) -> list[int]:
    """Reverses stretches, first improvement, until none shortens the route; gains are read from four legs."""
    if len(route) > SHORT_ROUTE or inst.n > TABLE_NODES:
        return _two_opt_long(inst, route)
    path = [0, *(i + 1 for i in route), 0]
    d, again = inst.distance, len(route) > 2
    while again:
        again = False
        for i in range(1, len(path) - 2):
            for j in range(i + 1, len(path) - 1):
                gain = d[path[i - 1], path[i]] + d[path[j], path[j + 1]] - d[path[i - 1], path[j]] - d[path[i], path[j + 1]]
                if gain > GAIN:
                    path[i : j + 1] = path[i : j + 1][::-1]
                    again = True
    return [i - 1 for i in path[1:-1]]


def _two_opt_long(inst: Instance, route: list[int]) -> list[int]:
    """The same moves in the same order, without a table of distances: the ends of a stretch are looked for in blocks.

    A stop that shares its place with the one before moves with it: by the triangle inequality a leg of no length gains
    nothing, so neither end of a reversed stretch lies between the two.
    """
    path = np.array([0, *(i + 1 for i in route), 0])
    new = np.ones(len(path), bool)
    new[2:-1] = (inst.places[path[2:-1]] != inst.places[path[1:-2]]).any(axis=1)
    stops = np.split(path, np.flatnonzero(new)[1:])
    turn = np.arange(len(stops))
    back = np.zeros(len(stops), bool)
    at = inst.places[path[new]]
    leg = between(at[:-1], at[1:])
    last = len(stops) - 1
    again = True
    while again:
        again = False
        for i in range(1, last - 1):
            j = i + 1
            while j < last:
                end = min(j + LEG_BLOCK, last)
                gain = leg[i - 1] + leg[j:end] - between(at[i - 1], at[j:end]) - between(at[i], at[j + 1 : end + 1])
                k = int((gain > GAIN).argmax())
                if not gain[k] > GAIN:
                    j = end
                    continue
                j += k
                turn[i : j + 1], back[i : j + 1], at[i : j + 1] = turn[i : j + 1][::-1].copy(), ~back[i : j + 1][::-1], at[i : j + 1][::-1].copy()
                leg[i:j] = leg[i:j][::-1].copy()
                leg[i - 1], leg[j] = between(at[i - 1], at[i]), between(at[j], at[j + 1])
                again = True
                j += 1
    return [int(n) - 1 for r, b in zip(turn[1:-1], back[1:-1], strict=True) for n in (stops[r][::-1] if b else stops[r])]


def full_routes(inst: Instance) -> list[list[int]]:
    """All nodes in near-equal angular sectors, each by nearest neighbour and two-opt."""
    x, y = inst.xy.T
    sector = np.empty(inst.n, int)
    sector[np.lexsort((np.arange(inst.n), np.arctan2(y, x)))] = _sectors(inst.n, inst.vehicles)
    return [two_opt(inst, nearest_first(inst, np.flatnonzero(sector == v).tolist())) for v in range(inst.vehicles)]


def _sectors(n: int, parts: int) -> np.ndarray:
    """The number of the near-equal part of each of ``n`` places; the first parts hold one more."""
    sizes = np.full(parts, n // parts) + (np.arange(parts) < n % parts)
    return np.repeat(np.arange(parts), sizes)


def cheapest_place(inst: Instance, routes: list[list[int]], node: int) -> tuple[float, int, int] | None:
    """``(added cost, route, position)`` of the best place within the budget."""
    best = None
    d = inst.distance
    for r, route in enumerate(routes):
        path = np.array([0, *(i + 1 for i in route), 0])
        added = d[path[:-1], node + 1] + d[node + 1, path[1:]] - d[path[:-1], path[1:]]
        p = int(added.argmin())
        if inst.cost(route) + added[p] <= inst.budget + TOLERANCE and (best is None or added[p] < best[0]):
            best = (float(added[p]), r, p)
    return best


def extend(inst: Instance, routes: list[list[int]], draw: np.random.Generator | None) -> list[list[int]]:
    """Adds nodes while one pays; the best one, or one of the best fifth when ``draw`` is given."""
    routes = [list(r) for r in routes]
    left = set(range(inst.n)) - {i for r in routes for i in r}
    while left:
        visited = {i for r in routes for i in r}
        now = inst.penalty(visited)
        moves = []
        for node in sorted(left):
            place = cheapest_place(inst, routes, node)
            if place is not None:
                change = place[0] + inst.penalty(visited | {node}) - now
                if change < -GAIN:
                    moves.append((change, node, place[1], place[2]))
        if not moves:
            break
        moves.sort()
        pick = 0 if draw is None else int(draw.integers(math.ceil(CANDIDATE_SHARE * len(moves))))
        _, node, r, p = moves[pick]
        routes[r].insert(p, node)
        left.remove(node)
    return routes


def extend_in_order(inst: Instance, routes: list[list[int]], order: list[int]) -> list[list[int]]:
    """Adds the nodes of ``order`` one by one at their cheapest place, each only if it pays then."""
    routes = [list(r) for r in routes]
    for node in order:
        visited = {i for r in routes for i in r}
        place = None if node in visited else cheapest_place(inst, routes, node)
        if place is not None and place[0] + inst.penalty(visited | {node}) - inst.penalty(visited) < -GAIN:
            routes[place[1]].insert(place[2], node)
    return routes


def order_descent(inst: Instance, routes: list[list[int]]) -> list[list[int]]:
    """Two-opt within routes and the first relocation that shortens, until neither helps; the visited nodes stay."""
    routes = [two_opt(inst, r) for r in routes]
    while True:
        moved = None
        for r, route in enumerate(routes):
            for node in route:
                without = [[i for i in x if i != node] for x in routes]
                place = cheapest_place(inst, without, node)
                if place is not None and inst.cost(route) - inst.cost(without[r]) - place[0] > GAIN:
                    moved = _put(without, node, place)
                    break
            if moved:
                break
        if moved is None:
            return routes
        routes = [two_opt(inst, r) for r in moved]


def improve(inst: Instance, routes: list[list[int]], exchange: bool = True) -> list[list[int]]:
    """Descends over orders, relocations, and single additions, removals and exchanges until none helps."""
    routes = [two_opt(inst, r) for r in routes]
    best = inst.value(routes)
    while True:
        found = None
        for candidate in _neighbours(inst, routes, exchange):
            value = inst.value(candidate)
            if value < best - GAIN:
                best, found = value, candidate
        if found is None:
            return routes
        routes = [two_opt(inst, r) for r in found]
        best = inst.value(routes)


def _neighbours(inst: Instance, routes: list[list[int]], exchange: bool) -> Iterator[list[list[int]]]:
    visited = {i for r in routes for i in r}
    rest = sorted(set(range(inst.n)) - visited)
    for node in sorted(visited):
        without = [[i for i in r if i != node] for r in routes]
        yield without
        place = cheapest_place(inst, without, node)
        if place is not None:
            yield _put(without, node, place)
    for node in rest:
        place = cheapest_place(inst, routes, node)
        if place is not None:
            yield _put(routes, node, place)
    if exchange:
        low = sorted(visited, key=lambda i: inst.means[i])[:EXCHANGED]
        high = sorted(rest, key=lambda i: -inst.means[i])[:EXCHANGED]
        for old in low:
            without = [[i for i in r if i != old] for r in routes]
            for new in high:
                place = cheapest_place(inst, without, new)
                if place is not None:
                    yield _put(without, new, place)


def _put(routes: list[list[int]], node: int, place: tuple[float, int, int]) -> list[list[int]]:
    out = [list(r) for r in routes]
    out[place[1]].insert(place[2], node)
    return out


def solve(inst: Instance, method: str, seed: int, rounds: int) -> list[list[int]]:
    """Routes by one of METHODS. Rounds, not seconds, so results repeat."""
    if method not in METHODS:
        raise ValueError(f"unknown method {method!r}; known are {', '.join(METHODS)}")
    draw = np.random.default_rng(seed)
    empty: list[list[int]] = [[] for _ in range(inst.vehicles)]
    if method == "grasp":
        tries = [improve(inst, extend(inst, empty, draw), exchange=False) for _ in range(max(1, rounds))]
        return min(tries, key=inst.value)
    if method in ("cut", "cut two-opt"):
        cut = trimmed(inst, full_routes(inst))
        return order_descent(inst, cut) if method == "cut two-opt" else cut
    start = trimmed(inst, full_routes(inst)) if method == "warm" else extend(inst, empty, None)
    if method == "greedy":
        return ruin_and_repair(inst, start, draw, rounds)
    if method == "alns":
        return learned_ruin_and_repair(inst, improve(inst, start, exchange=False), draw, rounds)
    return ruin_and_repair(inst, improve(inst, start), draw, rounds)


Plan = list[list[int]]
#: The order in which nodes of a plan go: by chance, small prizes first, or those first that cost most for their prize.
RANKINGS: dict[str, Callable[[Instance, Plan, list[int], np.random.Generator], np.ndarray]] = {
    "chance": lambda inst, plan, nodes, draw: draw.random(len(nodes)),
    "prize": lambda inst, plan, nodes, draw: inst.means[nodes],
    "cost": lambda inst, plan, nodes, draw: -_saved(inst, plan, nodes) / np.maximum(inst.means[nodes], TOLERANCE),
}


def _saved(inst: Instance, plan: Plan, nodes: list[int]) -> np.ndarray:
    """What each node's route gets shorter without it."""
    route_of = {i: route for route in plan for i in route}
    return np.array([inst.cost(route_of[i]) - inst.cost([j for j in route_of[i] if j != i]) for i in nodes])


class Removals:
    """Chooses what leaves a plan: each ranking has a weight, which follows the rewards of the plans that came of it."""

    def __init__(self, inst: Instance, draw: np.random.Generator):
        self.inst, self.draw = inst, draw
        self.weights = dict.fromkeys(RANKINGS, 1.0)
        self.last = next(iter(RANKINGS))

    def __call__(self, plan: Plan) -> set[int]:
        names = list(self.weights)
        self.last = names[int(np.searchsorted(np.cumsum([self.weights[n] for n in names]), self.draw.random() * sum(self.weights.values()), "right"))]
        nodes = sorted(i for route in plan for i in route)
        if not nodes:
            return set()
        most = max(1, int(REMOVAL_SHARE * self.inst.n))
        first = np.argsort(RANKINGS[self.last](self.inst, plan, nodes, self.draw), kind="stable")
        return {nodes[i] for i in first[: 1 + int(most * self.draw.random())]}

    def learn(self, outcome: str) -> None:
        self.weights[self.last] += REACTION * (REWARDS[outcome] - self.weights[self.last])
        self.weights[self.last] = max(TOLERANCE, self.weights[self.last])  # no ranking is lost for good


def _without(plan: Plan, gone: set[int]) -> Plan:
    return [[i for i in route if i not in gone] for route in plan]


def ruin_and_repair(inst: Instance, start: Plan, draw: np.random.Generator, rounds: int) -> Plan:
    """The best plan met while a random share of the nodes goes and returns; worse plans are kept by a fixed chance."""
    now = best = start
    for _ in range(rounds):
        visited = [i for route in now for i in route]
        gone = set(draw.permutation(visited)[: max(1, round(RUIN_SHARE * inst.n))].tolist())
        candidate = improve(inst, extend(inst, _without(now, gone), draw))
        if inst.value(candidate) < inst.value(best):
            best = candidate
        if inst.value(candidate) < inst.value(now) or draw.random() < ACCEPT_WORSE:
            now = candidate
    return best


def learned_ruin_and_repair(inst: Instance, start: Plan, draw: np.random.Generator, rounds: int) -> Plan:
    """The best plan met while learned removals ruin plans and insertions repair them; worse plans are kept by a chance
    that falls with their loss over the heat, which cools every round."""
    plans = {"now": start, "best": start}
    values = {name: inst.value(plan) for name, plan in plans.items()}
    removals = Removals(inst, draw)
    for round_ in range(rounds):
        heat = max(1.0, FIRST_HEAT * inst.value(start)) * COOLING**round_
        candidate = improve(inst, extend(inst, _without(plans["now"], removals(plans["now"])), draw), exchange=False)
        value = inst.value(candidate)
        loss = value - values["now"]
        lucky = draw.random() < math.exp(-min(700.0, max(0.0, loss) / heat))
        outcome = "best" if value < values["best"] else "better" if loss < -TOLERANCE else "taken" if lucky else "turned down"
        removals.learn(outcome)
        for name, change in (("best", outcome == "best"), ("now", outcome != "turned down")):
            if change:
                plans[name], values[name] = candidate, value
    return plans["best"]


def trimmed(inst: Instance, routes: list[list[int]]) -> list[list[int]]:
    """Drops the node whose loss is smallest for what it saves until every route keeps the budget."""
    out = []
    for route in routes:
        route, gone = list(route), 0
        while inst.cost(route) > inst.budget + TOLERANCE:
            step = inst.epsilon * (math.sqrt(gone + 1) - math.sqrt(gone))
            saved = {i: inst.cost(route) - inst.cost([j for j in route if j != i]) for i in route}
            route.remove(min(route, key=lambda i: ((inst.means[i] + step) / max(saved[i], 1e-9), i)))
            gone += 1
        out.append(two_opt(inst, route))
    return out


RECORD = (
    "instance string, n int, vehicles int, route_budget double, method string, seed int, optimization_epsilon double, reporting_epsilon double, optimized_objective double, "
    "nominal_objective double, objective double, travel double, robust_penalty double, visited int, visit_rate_pct double, runtime double, routes string"
)


def record(name: str, inst: Instance, method: str, seed: int, rounds: int, epsilon: float | None = None) -> tuple:
    """One run's record. The search sees the radius ``epsilon`` (the instance's unless given); the objective is reported
    under the instance's radius, and under none as nominal. Routes that break a rule are an error."""
    began = time.perf_counter()
    seen = inst if epsilon is None else replace(inst, epsilon=epsilon, known={})
    routes = solve(seen, method, seed, rounds)
    runtime = time.perf_counter() - began
    visited = [i for r in routes for i in r]
    if len(set(visited)) != len(visited) or len(routes) != inst.vehicles or any(inst.cost(r) > inst.budget + TOLERANCE for r in routes):
        raise ValueError(f"routes of {name} by {method} break a rule")
    travel, penalty = sum(map(inst.cost, routes)), inst.penalty(visited)
    open_ = np.ones(inst.n, bool)
    open_[visited] = False
    plain = robust_value(inst.samples, open_, 0.0, inst.scale)[0]
    title = method if epsilon is None else f"{method}-nominal" if epsilon == 0 else f"{method}-{epsilon:g}"
    return (
        name, inst.n, inst.vehicles, inst.budget, title, seed, float(seen.epsilon), inst.epsilon, seen.value(routes), travel + plain, travel + penalty, travel, penalty,
        len(visited), 100 * len(visited) / max(1, inst.n), runtime, json.dumps(routes),
    )


def solve_grid(tasks: DataFrame, instances: dict[str, Instance]) -> DataFrame:
    """Records of a task grid ``(instance, method, seed, rounds)`` and, on demand, ``optimization_epsilon``; every task is
    one row and runs where it lands. Instances are bounded case studies and go to the tasks whole."""
    shared = tasks.sparkSession.sparkContext.broadcast(instances)
    count = tasks.count()
    ship(tasks.sparkSession)
    if "optimization_epsilon" not in tasks.columns:
        tasks = tasks.withColumn("optimization_epsilon", F.lit(None).cast("double"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            columns = (part[c] for c in ("instance", "method", "seed", "rounds", "optimization_epsilon"))
            rows = [record(name, shared.value[name], method, int(seed), int(rounds), None if math.isnan(e) else float(e)) for name, method, seed, rounds, e in zip(*columns, strict=True)]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in RECORD.split(", ")])

    return tasks.repartition(max(1, count), "instance", "method", "seed").mapInPandas(run, RECORD)
