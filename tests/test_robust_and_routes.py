import itertools
import json

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from patrolkit.operators import robust, routing


def dual(samples, open_, epsilon, scale, s):
    room = 1 - samples[:, open_]
    best = []
    for b in room:
        options = [np.zeros_like(b), b]
        for c in np.linspace(0, 1, 2001):
            options.append(np.minimum(b, c))
        best.append(max(o.sum() - s * np.linalg.norm(o) for o in options))
    return scale * (epsilon * s + np.mean(samples[:, open_].sum(1) + np.array(best)))


@settings(max_examples=40, deadline=None)
@given(st.integers(1, 6), st.integers(1, 5), st.floats(0, 1.5), st.integers(0, 10_000))
def test_general_penalty_is_the_least_dual_value(n, periods, epsilon, seed):
    draw = np.random.default_rng(seed)
    samples = draw.random((periods, n))
    open_ = draw.random(n) < 0.7
    open_[0] = True
    value, s = robust.robust_value(samples, open_, epsilon, 1.0)
    m = open_.sum()
    assert 0 <= s <= np.sqrt(m) + 1e-9
    grid = min(dual(samples, open_, epsilon, 1.0, x) for x in np.linspace(0, np.sqrt(m), 60))
    assert value <= grid + 1e-6
    base = samples[:, open_].sum(1).mean()
    assert base - 1e-9 <= value <= base + epsilon * np.sqrt(m) + 1e-9
    room = (1 - samples[:, open_].max(1)).mean()
    if epsilon <= np.sqrt(m) * room:
        assert value == pytest.approx(base + epsilon * np.sqrt(m), abs=1e-6)


def test_penalty_grows_with_the_radius_and_falls_with_visits():
    draw = np.random.default_rng(1)
    samples = draw.random((4, 6))
    open_ = np.ones(6, bool)
    values = [robust.robust_value(samples, open_, e, 1.0)[0] for e in np.linspace(0, 2, 15)]
    assert all(b >= a - 1e-9 for a, b in itertools.pairwise(values))
    less = open_.copy()
    less[2] = False
    assert robust.robust_value(samples, less, 0.3, 1.0)[0] <= robust.robust_value(samples, open_, 0.3, 1.0)[0] + 1e-9


def test_nothing_unvisited():
    assert robust.robust_value(np.ones((2, 9)) * 0.5, np.zeros(9, bool), 0.1) == (0.0, 3.0)


def test_robust_minus_nominal_golden():
    # an objective of a retained record: 36 of 40 nodes visited, radius 0.1, scale 25000
    nominal = 32165.289104915737
    assert nominal + 0.1 * 25000 * np.sqrt(4) == pytest.approx(37165.28910491574)


def test_columns_agree_with_the_kernel(spark):
    draw = np.random.default_rng(2)
    table = spark.createDataFrame([(d, n, float(draw.random() * 0.5)) for d in range(3) for n in range(8)], "day int, node_id long, prize double")
    chosen = spark.createDataFrame([(0,), (3,)], "node_id long")
    radii = spark.createDataFrame([(0.05,), (0.2,)], "epsilon double")
    fast = {r["epsilon"]: r for r in robust.robust_bound(robust.missed(table, chosen), radii).collect()}
    tasks = spark.createDataFrame([("a", 0.05, [0, 3]), ("a", 0.2, [0, 3]), ("a", 0.2, [3, 0])], "selection string, epsilon double, nodes array<long>")
    for row in robust.robust(table, tasks).collect():
        assert fast[row["epsilon"]]["certified"]
        assert row["penalty"] == pytest.approx(fast[row["epsilon"]]["penalty"], rel=1e-6)


def small_instance(seed=0, n=6):
    draw = np.random.default_rng(seed)
    inst = routing.Instance(draw.normal(size=(n, 2)) * 5, draw.random((4, n)), 2, np.inf, 0.1, 3000.0)
    inst.budget = 0.6 * max(map(inst.cost, routing.full_routes(inst)))
    return inst


def optimum(inst):
    """Over all selections, orders and splits into two routes."""
    best = inst.value([[], []])
    for size in range(1, inst.n + 1):
        for chosen in itertools.permutations(range(inst.n), size):
            for cut in range(size // 2 + 1):
                routes = [list(chosen[:cut]), list(chosen[cut:])]
                if all(inst.cost(r) <= inst.budget for r in routes):
                    best = min(best, inst.value(routes))
    return best


@pytest.mark.parametrize("method", ["grasp", "ils", "alns", "warm"])
def test_search_keeps_the_rules_and_never_beats_enumeration(method):
    inst = small_instance()
    routes = routing.solve(inst, method, 1, 2)
    flat = [i for r in routes for i in r]
    assert len(set(flat)) == len(flat) and len(routes) == 2
    assert all(inst.cost(r) <= inst.budget + 1e-7 for r in routes)
    assert inst.value(routes) >= optimum(inst) - 1e-6
    assert inst.value(routes) <= inst.value([[], []])
    assert routing.solve(inst, method, 1, 2) == routes


def test_two_opt_untangles():
    inst = routing.Instance(np.array([[0, 1], [1, 1], [1, 0]], float), np.zeros((1, 3)), 1, np.inf, 0.0, 0.0)
    assert inst.cost(routing.two_opt(inst, [1, 0, 2])) == pytest.approx(400.0)
    assert routing.two_opt(inst, []) == []


def test_grid_of_tasks(spark):
    tasks = spark.createDataFrame([("s", m, s, 1) for m in ("ils", "warm") for s in (1, 2)], "instance string, method string, seed int, rounds int")
    rows = routing.solve_grid(tasks, {"s": small_instance()}).collect()
    assert len(rows) == 4
    for r in rows:
        assert r["objective"] == pytest.approx(r["travel"] + r["robust_penalty"])
        assert sum(map(len, json.loads(r["routes"]))) == r["visited"]


def test_route_columns(spark):
    rows = spark.createDataFrame([(1, 1, 5, 3.0, 4.0), (1, 2, 6, 3.0, 0.0), (2, 1, 7, 0.0, 2.0)], "vehicle long, pos long, node_id long, x double, y double")
    got = {r["vehicle"]: r["cost"] for r in routing.route_costs(rows).collect()}
    assert got == {1: pytest.approx(1200.0), 2: pytest.approx(400.0)}
    nodes = spark.createDataFrame([(5,), (6,), (7,)], "node_id long")
    assert routing.feasibility(rows, nodes, 2, 1200.0).first()["feasible"]
    assert not routing.feasibility(rows, nodes, 2, 1199.0).first()["feasible"]
    assert not routing.feasibility(rows.union(rows.where("node_id = 7").withColumn("vehicle", F.lit(1))), nodes, 2, 5000.0).first()["feasible"]


def test_realised_cost_golden(spark):
    from patrolkit.operators.statistics import realized

    misses = spark.createDataFrame([(5.1206896551724155, 1.0, 0.0)], "missed double, collected double, total double")
    row = realized(misses, 57257.688501551376, 4000.0).first()
    assert row["cost"] == pytest.approx(77740.44712224104)
    assert row["coverage_pct"] == 100.0


def test_robust_penalties_over_rows_equal_the_kernel(spark):
    draw = np.random.default_rng(3)
    rows = [(t, i, float(v)) for t in range(7) for i, v in enumerate(draw.uniform(0, 1, 9))]
    prizes = spark.createDataFrame(rows, "day int, node_id long, prize double")
    tasks = spark.createDataFrame([(name, e, nodes) for name, nodes in (("some", [0, 3, 4]), ("none", [None]), ("all", list(range(9)))) for e in (0.0, 0.1, 0.4, 1.0)], "selection string, epsilon double, nodes array<long>")
    by_matrix, by_rows = ({(r["selection"], r["epsilon"]): (r["penalty"], r["multiplier"]) for r in robust.robust(prizes, tasks, cells=c).collect()} for c in (10**6, 10))
    assert by_matrix.keys() == by_rows.keys() and len(by_rows) == 12
    for key, (value, _) in by_matrix.items():
        assert by_rows[key][0] == pytest.approx(value, abs=1e-4)
    assert by_rows["all", 0.1] == (0.0, 3.0)


def test_subset_programme_is_the_optimum_and_bounds_the_searches(spark):
    """Tours of all subsets and best selections by trying everything; no search is below."""
    import itertools

    from patrolkit.operators import subsets

    draw = np.random.default_rng(3)
    sizes, xy, loss = {1: 6, 2: 1, 3: 7}, {}, {}
    for k, n in sizes.items():
        xy[k], loss[k] = draw.normal(size=(n, 2)), draw.uniform(50, 400, n)
    rows = [(k, 10 * k + i, float(a), float(b), float(w)) for k, n in sizes.items() for i, ((a, b), w) in enumerate(zip(xy[k], loss[k], strict=True))]
    table = spark.createDataFrame(rows, "k long, node_id long, x double, y double, loss double")
    got = {(r["k"], r["mask"]): (r["n"], r["cost"]) for r in subsets.subset_tours(table, ["k"]).collect()}
    best = {r["k"]: r for r in subsets.best_selections(table, ["k"], 500.0).collect()}
    assert len(got) == sum(2**n - 1 for n in sizes.values())
    for k, n in sizes.items():
        inst = routing.Instance(xy[k], np.zeros((1, n)), 1, np.inf, 0.0, 0.0)
        values = {0: (float(loss[k].sum()), 0.0)}
        for mask in range(1, 2**n):
            some = [i for i in range(n) if mask >> i & 1]
            cost = min(inst.cost(list(order)) for order in itertools.permutations(some))
            assert got[k, mask] == (len(some), pytest.approx(cost))
            if cost <= 500.0:
                values[mask] = (cost + float(sum(loss[k][i] for i in range(n) if not mask >> i & 1)), cost)
        assert best[k]["objective"] == pytest.approx(min(values.values())[0]) and values[best[k]["mask"]][0] == pytest.approx(best[k]["objective"])
        assert sum(map(inst.cost, routing.full_routes(inst))) >= got[k, 2**n - 1][1] - 1e-9
    with pytest.raises(Exception, match="over 12 nodes"):
        subsets.subset_tours(spark.createDataFrame([(1, i, 0.0, float(i)) for i in range(13)], "k long, node_id long, x double, y double"), ["k"]).count()
    assert subsets.subset_tours(table.limit(0), ["k"]).count() == 0
