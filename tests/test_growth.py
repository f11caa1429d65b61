"""Steps whose intermediate tables must not grow faster than their input: repeated positions and series count once."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from patrolkit.operators import evaluation, prizes, robust, routing, spatial, statistics, summaries


def _sizes(monkeypatch, module, name):
    """Row counts of the tables that ``module`` passes through ``name`` (small or written), and the tables."""
    seen = []
    plain = getattr(module, name)

    def spy(df, *args, **kwargs):
        out = plain(df, *args, **kwargs)
        seen.append((args[0] if args else "", df.count(), out))
        return out

    monkeypatch.setattr(module, name, spy)
    return seen


def test_nearest_node_meets_each_position_once(spark, monkeypatch):
    seen = _sizes(monkeypatch, spatial, "small")
    nodes = spark.createDataFrame([(i, 104.0 + 0.001 * (i % 2), 30.5) for i in range(3, 203)], "node_id long, lon double, lat double")
    points = spark.createDataFrame([(0, 104.0, 30.5), (1, 104.0011, 30.5), (2, 104.1, 30.5)], "event_id long, lon double, lat double")
    got = {r["event_id"]: r["node_id"] for r in spatial.nearest_node(points, nodes, 600.0, max_abs_lat=35.0).collect()}
    assert got == {0: 4, 1: 3, 2: None}  # ties to the lowest id
    assert seen[0][2].agg(F.max(F.size("near"))).first()[0] == 2


def test_spacing_pairs_positions_not_nodes(spark, monkeypatch):
    seen = _sizes(monkeypatch, spatial, "written")
    rows = [(i, 104.0 + 0.1 * (i % 3), 30.5, float(i * 37 % 101)) for i in range(90)]
    nodes = spark.createDataFrame(rows, "node_id long, lon double, lat double, weight double")
    kept = {r["node_id"] for r in spatial.spaced(nodes, "weight", 15_000.0, max_abs_lat=35.0).collect()}
    best, order = [], sorted(rows, key=lambda r: (-r[3], r[0]))
    for r in order:  # 0.1 degrees are 9.6 km here, 0.2 are 19.2 km
        if all(abs(r[1] - b[1]) > 0.15 for b in best):
            best.append(r)
    assert kept == {r[0] for r in best}
    assert [n for name, n, _ in seen if name == "ranked"] == [3]


def test_silhouette_meets_positions_and_equals_all_pairs(spark, monkeypatch):
    seen = _sizes(monkeypatch, evaluation, "small")
    rows = [(i, i % 3, float(i % 4), float(i % 5 // 2)) for i in range(120)] + [(500, 7, 9.0, 9.0), (501, -1, 0.0, 0.0)]
    got = evaluation.silhouette(spark.createDataFrame(rows, "id long, label int, x double, y double"), "label", ["x", "y"]).first()["silhouette"]
    kept = [r for r in rows if r[1] >= 0]
    x, label = np.array([r[2:] for r in kept]), np.array([r[1] for r in kept])
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    values = []
    for i, own in enumerate(label):
        mean = {c: d[i][(label == c) & (np.arange(len(label)) != i)] for c in set(label)}
        if not len(mean[own]):
            values.append(0.0)
            continue
        a, b = mean.pop(own).mean(), min(v.mean() for v in mean.values())
        values.append((b - a) / max(a, b))
    assert abs(got - np.mean(values)) < 1e-12
    assert seen[0][1] == len({r[1:] for r in kept})


def test_bootstrap_resamples_equal_series_once(spark, monkeypatch):
    seen = _sizes(monkeypatch, statistics, "written")
    rows = [(day, node, float(node % 4 * (day + 1) % 5), float(node % 4)) for node in range(40) for day in range(6)]
    panel = spark.createDataFrame(rows, "day int, node_id long, prize double, t double")
    got = {r["replicate"]: r["rho"] for r in statistics.spearman_bootstrap(panel, "day", "t", block=2, reps=5, seed=3).collect()}
    x = np.array([[rows[node * 6 + day][2] for day in range(6)] for node in range(40)])
    rank = lambda v: np.array([(v < a).sum() + ((v == a).sum() + 1) / 2 for a in v])
    train = rank(np.arange(40) % 4)
    for rep, places in enumerate(statistics.resampled(6, 2, np.arange(5), 3)):
        assert abs(got[rep] - np.corrcoef(train, rank(np.round(x[:, places].mean(axis=1), 9)))[0, 1]) < 1e-12
    assert [n for name, n, _ in seen if name == "means"][0] <= 5 * 4


@pytest.mark.parametrize("most", [2, 512])
def test_k_distances_write_each_position_a_few_times(spark, monkeypatch, most):
    monkeypatch.setattr(spatial, "COMPARED_ROWS", 0)
    monkeypatch.setattr(spatial, "TILE_POSITIONS", most)
    seen = _sizes(monkeypatch, spatial, "written")
    draw = np.random.default_rng(5)
    x = np.vstack([np.round(draw.normal(size=(900, 2)) * 0.01, 3), draw.normal(size=(900, 2)) * 1e-7 + 2.0, draw.uniform(-3, 3, (100, 2)), [[90.0, -40.0]]])
    table = spark.createDataFrame([(0, i, float(a), float(b)) for i, (a, b) in enumerate(x)], "day int, event_id long, lon double, lat double")
    d = np.sort(np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1)), axis=1)
    for k in (1, 5, 12):
        got = {r["event_id"]: r["k_dist"] for r in spatial.k_distances(table, "day", k).collect()}
        assert np.array_equal([got[i] for i in range(len(x))], d[:, k - 1])
    places = len({tuple(p) for p in x})
    assert max(n for _, n, _ in seen) <= 2 * places


def test_day_counts_find_the_near_points_once(spark, monkeypatch):
    seen = _sizes(monkeypatch, prizes, "written")
    draw = np.random.default_rng(2)
    rows = [(day, 100 * day + i, 104.0 + float(a), 30.5 + float(b)) for day in range(2) for i, (a, b) in enumerate(draw.normal(size=(60, 2)) * 0.001)]
    points = spark.createDataFrame([*rows, (0, 999, 110.0, 30.5)], "day int, event_id long, lon double, lat double")
    nodes = spark.createDataFrame([(1, 104.0, 30.5)], "node_id long, lon double, lat double")
    counted, summary = prizes.day_counts(points, nodes, "day", max_abs_lat=35.0)
    got = {r["day"]: r for r in summary.collect()}
    assert [got[d]["nearby_points"] for d in (0, 1)] == [60, 60]
    assert {r["day"]: r["cnt"] for r in counted.collect()} == {d: got[d]["assigned_points"] for d in (0, 1)}
    assert [(name, n) for name, n, _ in seen] == [("near_nodes", 120), ("parameters", 2)]


def test_counted_rooms_give_the_kernels_value():
    draw = np.random.default_rng(8)
    for turn in range(60):
        samples = draw.integers(0, 1 + turn % 7, (4, 30)) / max(1, turn % 7)
        open_ = draw.random(30) < 0.6
        room, weight = (np.zeros((4, 30)) for _ in range(2))
        for t, row in enumerate(1.0 - samples[:, open_]):
            values, n = np.unique(row, return_counts=True)
            room[t, : len(values)], weight[t, : len(values)] = values, n
        for epsilon in (0.0, 0.1, 0.7, 2.0):
            got = robust.counted_value(samples[:, open_].sum(axis=1), room, weight, epsilon, 10.0)
            assert got[0] == pytest.approx(robust.robust_value(samples, open_, epsilon, 10.0)[0], abs=1e-9)


@pytest.mark.parametrize("cells", [1, 10**6])
def test_robust_penalties_count_equal_prizes_once(spark, monkeypatch, cells):
    seen = _sizes(monkeypatch, robust, "written")
    samples = np.array([[(node % 3) * (t % 2) / 2 for node in range(200)] for t in range(6)])
    table = spark.createDataFrame([(t, node, float(samples[t, node])) for t in range(6) for node in range(200)], "number int, node_id long, prize double")
    sets = {"some": list(range(0, 200, 4)), "none": [], "all": list(range(200)), "again": [*range(0, 200, 4), 0, None]}
    cases = [("a", "SP", 0.5, 0, 2), ("a", "RO", 0.5, 0, 2), ("a", "Exact DRO", 0.5, 0, 2), ("b", "Exact DRO", 0.5, 1, 5)]
    tasks = spark.createDataFrame([(*c, name, nodes) for c in cases for name, nodes in sets.items()], "case string, model string, epsilon double, first int, last int, selection string, nodes array<long>")
    got = {(r["case"], r["model"], r["selection"]): r["penalty"] for r in robust.robust_over_spans(table, "number", tasks, 10.0, cells).collect()}
    assert len(got) == 16
    for name, nodes in sets.items():
        open_ = ~np.isin(np.arange(200), [n for n in nodes if n is not None])
        for case, model, epsilon, first, last in cases:
            exact = 10.0 * open_.sum() if model == "RO" else robust.robust_value(samples[first : last + 1], open_, 0.0 if model == "SP" else epsilon, 10.0)[0]
            assert got[case, model, name] == pytest.approx(exact, abs=1e-4)
    assert max(n for name, n, _ in seen if name == "rooms") <= 2 * 6 * 3  # two different sets that leave nodes, three prizes


def test_one_candidate_needs_no_array_functions(spark):
    points = spark.createDataFrame([(0, 104.0, 30.5), (1, 104.0011, 30.5), (2, 104.1, 30.5), (3, None, 30.5), (4, 103.0, 30.5), (5, 103.0061, 30.5)], "event_id long, lon double, lat double")
    nodes = spark.createDataFrame([(7, 104.0, 30.5), (8, 104.002, 30.5), (9, 103.0, 30.5)], "node_id long, lon double, lat double")
    found = spatial.nearest_node(points, nodes, 600.0, max_abs_lat=35.0)
    assert {r["event_id"]: r["node_id"] for r in found.collect()} == {0: 7, 1: 8, 2: None, 3: None, 4: 9, 5: 9}  # 5: 584 m
    plan = found.groupBy("node_id").count()._jdf.queryExecution().optimizedPlan().toString()
    lead = [part[-200:] for part in plan.split("array_min(")[:-1]]
    assert lead and all("size(near" in part for part in lead)  # arrays only where a cell has several nodes


def test_node_sets_are_named_without_interpreted_functions(spark):
    rows = [("a", [3, 1, None, 3]), ("b", [1, 3]), ("c", [None]), ("d", None), ("e", [])]
    named = robust._named(spark.createDataFrame(rows, "selection string, nodes array<long>"))
    got = {r["selection"]: (r["nodes"], r["set"]) for r in named.collect()}
    assert [got[s][0] for s in "abcde"] == [[1, 3], [1, 3], [], [], []]
    assert got["a"] == got["b"] and got["c"] == got["d"] == got["e"]
    assert "lambda" not in named._jdf.queryExecution().optimizedPlan().toString()


def _rolling_case(spark):
    samples = np.array([[(node * (t % 4 + 1)) % 5 / 4 for node in range(12)] for t in range(6)])
    table = spark.createDataFrame([(t + 1, t + 1, node, float(samples[t, node])) for t in range(6) for node in range(12)], "period int, number int, node_id long, prize double")
    sets = {"even": list(range(0, 12, 2)), "few": [1, 5], "none": []}
    pool = spark.createDataFrame([(s, n) for s, nodes in sets.items() for n in nodes or [None]], "selection string, node_id long")
    travel = spark.createDataFrame([("even", 9.0), ("few", 3.0), ("none", 0.0)], "selection string, travel double")
    return samples, table, sets, pool, travel


def test_rolling_selection_counts_rooms_once_and_meets_a_plan_once(spark, monkeypatch):
    rooms, marks = _sizes(monkeypatch, robust, "written"), _sizes(monkeypatch, summaries, "small")
    samples, table, sets, pool, travel = _rolling_case(spark)
    _, tested = summaries.calibrate_refit_test(table, "number", pool, travel, [("a", 2, 2, 2), ("b", 2, 1, 3)], [0.1, 0.4], 10.0)
    rows = tested.collect()
    assert len(rows) == 6
    cost = {"even": 9.0, "few": 3.0, "none": 0.0}
    for r in rows:
        open_ = ~np.isin(np.arange(12), sets[r["plan"]])
        held = samples[4:6] if r["fold"] == "a" else samples[3:6]
        daily = cost[r["plan"]] + 10.0 * held[:, open_].sum(axis=1)
        assert r["mean_cost"] == pytest.approx(daily.mean(), abs=1e-5) and r["worst_cost"] == pytest.approx(daily.max(), abs=1e-5)
        assert r["coverage_pct"] == pytest.approx((1 - held[:, open_].sum(axis=1) / held.sum(axis=1)).mean() * 100)
    assert [name for name, _, _ in rooms].count("rooms") == 1
    assert max(n for _, n, _ in marks) <= pool.count()


def test_calibration_alone_leaves_the_test_out(spark, monkeypatch):
    chosen = _sizes(monkeypatch, summaries, "written")
    _, table, _, pool, travel = _rolling_case(spark)
    args = table, "number", pool, travel, [("a", 2, 2, 2), ("b", 2, 1, 3)], [0.1, 0.4], 10.0
    whole = summaries.calibrate_refit_test(*args)[0]
    before = [name for name, _, _ in chosen].count("chosen")
    alone, none = summaries.calibrate_refit_test(*args, test=False)
    assert none is None and sorted(map(tuple, alone.collect())) == sorted(map(tuple, whole.collect()))
    assert [name for name, _, _ in chosen].count("chosen") - before == 1


@pytest.mark.parametrize("cells", [1, 10**6])
def test_robust_penalties_make_no_zero_prizes(spark, monkeypatch, cells):
    seen = _sizes(monkeypatch, robust, "written")
    samples = np.zeros((40, 50))  # periods x nodes; most periods have no prize at all
    samples[::8, 3], samples[5, [3, 4, 7]] = 1.0, [1.0, 0.5, 0.25]
    paid = spark.createDataFrame([(int(t), int(n), float(samples[t, n])) for t, n in zip(*samples.nonzero(), strict=True)] + [(0, 9, 0.0)], "day int, node_id long, prize double")
    grid = spark.range(50).withColumnRenamed("id", "node_id"), spark.createDataFrame([(t,) for t in [*range(40), 5, None]], "day int")
    sets = {"some": [3, 4, 10, 11, 99], "none": [None], "all": list(range(50)), "rest": list(range(8, 50))}
    tasks = spark.createDataFrame([(s, e, nodes) for s, nodes in sets.items() for e in (0.0, 0.3, 2.0)], "selection string, epsilon double, nodes array<long>")
    got = {(r["selection"], r["epsilon"]): r for r in robust.robust(paid, tasks, scale=10.0, cells=cells, grid=grid).collect()}
    assert len(got) == 12
    for (name, epsilon), row in got.items():
        exact = robust.robust_value(samples, ~np.isin(np.arange(50), [n for n in sets[name] if n is not None]), epsilon, 10.0)[0]
        assert row["penalty"] == pytest.approx(exact, abs=1e-4)
    assert got["all", 0.3]["multiplier"] == pytest.approx(50**0.5)
    assert max(n for name, n, _ in seen if name != "robust_tasks") <= 3 * (40 + 8)  # not 3 x 40 x 50


def test_template_ranking_writes_paid_prizes_only(spark, sf, monkeypatch):
    from patrolkit.plans import catalogue

    seen = _sizes(monkeypatch, robust, "written")
    catalogue.queries()["q87_template_ranking"](spark, sf)
    paid = catalogue._prizes(spark, sf).where("prize > 0").count()
    assert [n for name, n, _ in seen if name == "robust_prizes"] == [paid]


def test_rolling_selection_makes_no_zero_prizes(spark, monkeypatch):
    samples, table, _, pool, travel = _rolling_case(spark)
    samples[4], samples[1, 3:] = 0.0, 0.0
    periods = spark.createDataFrame([(t, min(t, 6)) for t in range(1, 8)], "period int, number int")  # 7 shares a number, and has no prize
    dense = spark.createDataFrame([(t, min(t, 6), node, float(samples[t - 1, node]) if t < 7 else 0.0) for t in range(1, 8) for node in range(12)], "period int, number int, node_id long, prize double")
    args = "number", pool, travel, [("a", 2, 2, 2), ("b", 2, 1, 3)], [0.1, 0.4], 10.0
    whole = [sorted(map(tuple, part.collect())) for part in summaries.calibrate_refit_test(dense, *args)]
    seen = _sizes(monkeypatch, summaries, "written")
    nodes = spark.range(12).withColumnRenamed("id", "node_id")
    paid = [sorted(map(tuple, part.collect())) for part in summaries.calibrate_refit_test(dense.where("prize > 0"), *args, grid=(nodes, periods))]
    for want, got in zip(whole, paid, strict=True):
        assert len(want) == len(got) > 0
        for a, b in zip(want, got, strict=True):
            assert a == tuple(pytest.approx(v, abs=1e-6) if isinstance(v, float) else v for v in b)
    assert [n for name, n, _ in seen if name == "fold_prizes"] == [int((samples > 0).sum())]


def _insertions(routes, nodes):
    """Plain search of the cheapest place of every node: (node, cost, vehicle, pos)."""
    legs = []
    for v in sorted({r[0] for r in routes}):
        path = [(0.0, 0.0), *[r[2:] for r in sorted(routes) if r[0] == v], (0.0, 0.0)]
        legs += [(v, p + 1, *path[p], *path[p + 1]) for p in range(len(path) - 1)]
    gap = lambda a, b, c, d: ((a - c) ** 2 + (b - d) ** 2) ** 0.5
    return {n: min((round((gap(ax, ay, x, y) + gap(x, y, bx, by) - gap(ax, ay, bx, by)) * 100, 9), v, p) for v, p, ax, ay, bx, by in legs) for n, x, y in nodes}


def _rows_of_joins(plan):
    """Rows that the joins of an executed plan made (without adaptive execution)."""
    metric = plan.metrics().get("numOutputRows")
    own = [metric.get().value()] if "Join" in plan.nodeName() or "Cartesian" in plan.nodeName() else []
    return own + [n for i in range(plan.children().size()) for n in _rows_of_joins(plan.children().apply(i))]


def test_insertions_meet_positions_and_legs_once(spark):
    routes = [(v, p, float((p - 1) // 20 % 3 - v), float((p - 1) // 20 * 7 % 4)) for v in (1, 2) for p in range(1, 121)]
    nodes = [(1000 + i, float(i * 3 % 4) - 1.5, float(i % 3)) for i in range(200)]
    want = _insertions(routes, nodes)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        made = statistics.insertion_costs(spark.createDataFrame(routes, "vehicle long, pos long, x double, y double"), spark.createDataFrame(nodes, "node_id long, x double, y double"))
        got = {r["node_id"]: (r["vehicle"], r["pos"], r["added"]) for r in made.collect()}
        rows = _rows_of_joins(made._jdf.queryExecution().executedPlan())
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert {n: r[:2] for n, r in got.items()} == {n: r[1:] for n, r in want.items()}
    assert all(abs(got[n][2] - r[0]) < 2e-9 for n, r in want.items())
    assert rows and max(rows) <= 200  # not 200 nodes by 242 legs


def test_insertions_in_many_tiles_by_plan(spark, monkeypatch):
    for name, value in (("POSITIONS", 3), ("LEGS", 4), ("POSITION_BLOCK", 2), ("LEG_BLOCK", 2)):
        monkeypatch.setattr(statistics, name, value)
    draw = np.random.default_rng(5)
    routes = [(g, v, p, *draw.random(2).round(2).tolist()) for g in (1, 2) for v in (1, 2) for p in range(1, 12)] + [(2, 3, 1, None, 0.5)]
    nodes = [(g, n, *draw.random(2).round(2).tolist()) for g in (1, 2) for n in range(20)] + [(1, 90, None, 0.1), (3, 91, 0.1, 0.1)]
    made = statistics.insertion_costs(spark.createDataFrame(routes, "g long, vehicle long, pos long, x double, y double"), spark.createDataFrame(nodes, "g long, node_id long, x double, y double"), ["g"])
    got = {(r["g"], r["node_id"]): (r["vehicle"], r["pos"], r["added"]) for r in made.collect()}
    assert got.pop((1, 90)) == (1, 1, None)  # a place that is not known costs nothing known
    for g in (1, 2):
        want = _insertions([r[1:] for r in routes if r[0] == g and r[3] is not None], [r[1:] for r in nodes if r[0] == g and r[2] is not None])
        for n, r in want.items():
            v, p, added = got.pop((g, n))
            assert (v, p) == r[1:] and abs(added - r[0]) < 2e-9
    assert not got


@pytest.mark.parametrize("spread", [0, 1.2, 50])
def test_long_routes_equal_the_plain_search_without_a_table(monkeypatch, spread):
    def plain(inst, route):
        path, again = [0, *(i + 1 for i in route), 0], True
        d = np.sqrt(((inst.places[:, None] - inst.places[None]) ** 2).sum(axis=2)) * 100.0
        while again:
            again = False
            for i in range(1, len(path) - 2):
                for j in range(i + 1, len(path) - 1):
                    if d[path[i - 1], path[i]] + d[path[j], path[j + 1]] - d[path[i - 1], path[j]] - d[path[i], path[j + 1]] > routing.GAIN:
                        path[i : j + 1] = path[i : j + 1][::-1]
                        again = True
        return [i - 1 for i in path[1:-1]], float(d[path[:-1], path[1:]].sum())

    monkeypatch.setattr(routing, "TABLE_NODES", 0)
    monkeypatch.setattr(routing, "LEG_BLOCK", 5)
    for seed in range(25):
        draw = np.random.default_rng(seed)
        n = int(draw.integers(1, 40))
        inst = routing.Instance(np.round(draw.normal(size=(n, 2)) * spread) * 7.3, np.zeros((1, n)), 2, np.inf, 0.0, 0.0)  # many at one place
        route = draw.permutation(n).tolist()
        got = routing.two_opt(inst, route)
        assert (got, inst.cost(got)) == plain(inst, route)


def test_full_routes_need_no_table_of_distances():
    import tracemalloc

    n = 3_000  # a table of all pairs holds 72 MB
    xy = np.random.default_rng(2).normal(size=(n // 20, 2)).repeat(20, axis=0) * 30
    tracemalloc.start()
    inst = routing.Instance(xy, np.zeros((1, n)), 2, np.inf, 0.0, 0.0)
    routes = routing.full_routes(inst)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sorted(i for r in routes for i in r) == list(range(n))
    assert peak < 20e6


def test_distance_matrix_of_one_instance_is_dealt_over_tasks(spark, monkeypatch):
    monkeypatch.setattr(spatial, "TILE_NODES", 7, raising=False)
    xy = np.random.default_rng(1).normal(size=(60, 2)).round(3) * 40
    rows = [(i % 9 // 8, i, *xy[i].tolist()) for i in range(60)] + [(None, 60, 0.0, 0.0), (5, 61, None, 1.0)]
    nodes = spark.createDataFrame(rows, "g long, node_id long, x double, y double").coalesce(1)
    made = spatial.distance_matrix(nodes, ["g"])
    got = {(r["g"], r["node_id"], r["other_id"]): r["distance"] for r in made.collect()}
    assert got.pop((5, 61, 61)) is None
    want = {(a[0], a[1], b[1]): np.sqrt((a[2] - b[2]) ** 2 + (a[3] - b[3]) ** 2) * 100.0 for a in rows[:60] for b in rows[:60] if a[0] == b[0]}
    assert got == want and made.count() == len(want) + 1
    assert made.where("g = 0").select(F.spark_partition_id()).distinct().count() > 1
    alone = spatial.distance_matrix(nodes.where("g = 1").drop("g"))
    assert {(r["node_id"], r["other_id"]) for r in alone.collect()} == {k[1:] for k in want if k[0] == 1}


def test_rounded_equals_round(spark):
    from patrolkit.functions.scalars import rounded

    draw = np.random.default_rng(6)
    values = [*(draw.random(20_000) * 10.0 ** draw.integers(-6, 12, 20_000)).tolist(), *((2 * draw.integers(0, 10**8, 20_000) + 1) / 2e4).tolist(), *((2 * draw.integers(0, 10**8, 20_000) + 1) / 2e5).tolist()]
    values += [-v for v in values[::3]] + [0.0, -0.0, float("nan"), float("inf"), -float("inf"), 1e300, 5e-5, 0.00015, 49999.99995, None]
    both = spark.createDataFrame([(v,) for v in values], "v double").select("v", F.round("v", 4).alias("want"), rounded(F.col("v"), 4).alias("got"))
    assert both.where("not (want <=> got)").collect() == []
