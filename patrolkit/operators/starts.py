"""Searches from many starts: pools of plans, diverse ranked starts, restarts from warm templates."""

from __future__ import annotations

import numpy as np

from .routing import GAIN, Instance, extend, full_routes, improve, ruin_and_repair, trimmed

Plan = list[list[int]]


def turned_plans(inst: Instance, count: int) -> list[Plan]:
    """Plans of all nodes by angular sectors that start at ``count`` different angles."""
    out = []
    for turn in range(count):
        angle = 2 * np.pi * turn / max(1, count)
        spin = np.array([[np.cos(angle), -np.sin(angle)], [np.sin(angle), np.cos(angle)]])
        out.append(full_routes(Instance(inst.xy @ spin.T, inst.samples, inst.vehicles, np.inf, inst.epsilon, inst.scale)))
    return out


def pooled(plans: list[Plan]) -> list[Plan]:
    """The different plans, in the order of their first appearance."""
    return [[list(r) for r in p] for p in dict.fromkeys(tuple(map(tuple, p)) for p in plans)]


def ranked_starts(inst: Instance, plans: list[Plan], keep: int) -> list[Plan]:
    """Plans cut to the budget, the best of each set of visited nodes, by objective; at most ``keep``."""
    best: dict[frozenset, tuple[float, Plan]] = {}
    for plan in plans:
        cut = trimmed(inst, plan)
        key, value = frozenset(i for r in cut for i in r), inst.value(cut)
        if key not in best or value < best[key][0]:
            best[key] = (value, cut)
    return [plan for _, plan in sorted(best.values(), key=lambda v: v[0])[:keep]]


def multistart(inst: Instance, plans: list[Plan], seed: int, *, ranked: int = 3, random: int = 3) -> tuple[Plan, list[dict]]:
    """``(best plan, a row a start)``: descents from ``ranked`` plans of the pool and ``random`` seeded constructions; the
    empty plan stays where nothing beats it."""
    empty: Plan = [[] for _ in range(inst.vehicles)]
    starts = [("ranked", p) for p in ranked_starts(inst, plans, ranked)]
    starts += [("random", extend(inst, empty, np.random.default_rng(seed + i))) for i in range(random)]
    best, rows = empty, []
    for number, (kind, start) in enumerate(starts, 1):
        found = improve(inst, start)
        rows.append({"start_index": number, "start_type": kind, "initial_objective": inst.value(start), "objective": inst.value(found), "visited_nodes": sum(map(len, found))})
        best = found if inst.value(found) < inst.value(best) - GAIN else best
    return best, rows


def diverse_search(inst: Instance, plans: list[Plan], seed: int, rounds: int, *, keep: int = 6) -> tuple[Plan, list[dict]]:
    """``(best plan, a row a start)``: ruin and repair from up to ``keep`` starts that visit different nodes."""
    best: Plan = [[] for _ in range(inst.vehicles)]
    rows = []
    for number, start in enumerate(ranked_starts(inst, plans, keep), 1):
        found = ruin_and_repair(inst, improve(inst, start), np.random.default_rng(seed + number - 1), rounds)
        rows.append({"start": number, "initial_objective": inst.value(start), "final_objective": inst.value(found), "visited_nodes": sum(map(len, found))})
        best = found if inst.value(found) < inst.value(best) - GAIN else best
    return best, rows


def templates_by_level(inst: Instance, templates: list[Plan], scale: float) -> list[Plan]:
    """Templates by travel + scale * unit penalty, for another penalty scale than the instance's."""
    unit = lambda p: inst.penalty({i for r in p for i in r}) / inst.scale if inst.scale else 0.0
    return sorted(templates, key=lambda p: sum(map(inst.cost, p)) + scale * unit(p))


def restarted(inst: Instance, template: Plan, seed: int, rounds: int) -> Plan:
    """Ruin and repair from a warm template; the empty plan where it is better, and always under a scale of zero."""
    empty: Plan = [[] for _ in range(inst.vehicles)]
    if not inst.scale:
        return empty
    found = ruin_and_repair(inst, improve(inst, template), np.random.default_rng(seed), rounds)
    return empty if inst.value(empty) < inst.value(found) else found
