"""Starts and restarts, forests, batched reversals, files, spreadsheets, the harness's checks, older parameter rules."""

import hashlib
import itertools
import json
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from patrolkit.functions import scalars
from patrolkit.operators import capacitated, cluster, robust, routing, starts
from patrolkit.operators import forest
from patrolkit.plans import experiments
from patrolkit.sources import pings as P
from patrolkit.sources import sinks


def instance(n=7, seed=0, evaluator=None, scale=3000.0):
    draw = np.random.default_rng(seed)
    inst = routing.Instance(draw.normal(size=(n, 2)) * 5, draw.random((4, n)), 2, np.inf, 0.1, scale, evaluator)
    inst.budget = 0.6 * max(map(inst.cost, routing.full_routes(inst)))
    return inst


def keeps_rules(inst, routes):
    flat = [i for r in routes for i in r]
    return len(set(flat)) == len(flat) and len(routes) == inst.vehicles and all(inst.cost(r) <= inst.budget + 1e-7 for r in routes)


@pytest.mark.parametrize("n, vehicles", [(7, 2), (9, 4), (8, 4), (3, 4)])
def test_full_routes_visit_all_in_near_equal_sectors(n, vehicles):
    draw = np.random.default_rng(n)
    inst = routing.Instance(draw.normal(size=(n, 2)), np.zeros((1, n)), vehicles, np.inf, 0.0, 0.0)
    routes = routing.full_routes(inst)
    assert sorted(i for r in routes for i in r) == list(range(n))
    assert [len(r) for r in routes] == [len(p) for p in np.array_split(np.arange(n), vehicles)]


def test_nearest_first_by_definition():
    inst = routing.Instance(np.random.default_rng(3).normal(size=(9, 2)), np.zeros((1, 9)), 1, np.inf, 0.0, 0.0)
    left, at, want = set(range(9)), 0, []
    while left:
        at = min(left, key=lambda i, at=at: (inst.distance[at, i + 1], i)) + 1
        left.discard(at - 1)
        want.append(at - 1)
    assert routing.nearest_first(inst, list(range(9))) == want


def test_methods_are_known_and_keep_the_rules():
    inst = instance()
    for method in routing.METHODS:
        assert keeps_rules(inst, routing.solve(inst, method, 3, 2))
    with pytest.raises(ValueError, match="unknown method"):
        routing.solve(inst, "swarm", 1, 1)


def test_ordered_insertion_and_order_descent():
    inst = instance(9)
    empty = [[] for _ in range(2)]
    routes = routing.extend_in_order(inst, empty, list(range(9)))
    assert keeps_rules(inst, routes) and inst.value(routes) <= inst.value(empty)
    better = routing.order_descent(inst, routes)
    assert sum(map(inst.cost, better)) <= sum(map(inst.cost, routes)) + 1e-9
    assert {i for r in better for i in r} == {i for r in routes for i in r} and keeps_rules(inst, better)


def test_evaluators_are_pluggable():
    inst = instance(evaluator=routing.box_penalty)
    assert inst.penalty([0, 1]) == 3000.0 * 5
    assert keeps_rules(inst, routing.solve(inst, "ils", 1, 1))


def test_starts_restarts_and_templates():
    inst = instance()
    plans = starts.pooled(starts.turned_plans(inst, 5) * 2)
    assert len(plans) == len({json.dumps(p) for p in plans})
    ranked = starts.ranked_starts(inst, plans, 3)
    values = [inst.value(p) for p in ranked]
    assert values == sorted(values) and len({frozenset(i for r in p for i in r) for p in ranked}) == len(ranked)
    best, rows = starts.multistart(inst, plans, 1)
    assert keeps_rules(inst, best) and inst.value(best) <= min(r["objective"] for r in rows) + 1e-6
    assert all(r["objective"] <= r["initial_objective"] + 1e-6 for r in rows) and {r["start_type"] for r in rows} == {"ranked", "random"}
    found, rows = starts.diverse_search(inst, plans, 1, 2, keep=2)
    assert keeps_rules(inst, found) and len(rows) <= 2
    cheap, dear = (starts.templates_by_level(inst, ranked, s)[0] for s in (0.0, 1e9))
    assert sum(map(inst.cost, cheap)) == min(sum(map(inst.cost, p)) for p in ranked)
    assert inst.penalty({i for r in dear for i in r}) == min(inst.penalty({i for r in p for i in r}) for p in ranked)
    assert starts.restarted(instance(scale=0.0), ranked[0], 1, 1) == [[], []]
    assert inst.value(starts.restarted(inst, ranked[0], 1, 2)) <= inst.value([[], []])


def test_records_have_all_columns(spark):
    tasks = spark.createDataFrame([("a", "ils", 1, 1, None), ("a", "ils", 1, 1, 0.0)], "instance string, method string, seed int, rounds int, optimization_epsilon double")
    rows = {r["method"]: r for r in routing.solve_grid(tasks, {"a": instance()}).collect()}
    assert set(rows) == {"ils", "ils-nominal"} and len(rows["ils"].asDict()) == 17
    plain = rows["ils-nominal"]
    assert plain["optimization_epsilon"] == 0.0 and plain["reporting_epsilon"] == 0.1 and plain["runtime"] >= 0
    assert plain["optimized_objective"] == pytest.approx(plain["nominal_objective"])
    assert rows["ils"]["optimized_objective"] == pytest.approx(rows["ils"]["objective"])


@pytest.mark.parametrize("n", [3, 7, 12])
def test_evaluator_against_a_plain_search(n):
    """The dual's inner maximum by a fine search over common levels, its outer minimum by a fine grid."""
    draw = np.random.default_rng(n)
    for check in range(4):
        samples = draw.uniform(0, 1, (5, n))
        open_ = np.ones(n, bool) if check == 0 else draw.random(n) < 0.7
        if not open_.any():
            continue
        room, base = 1 - samples[:, open_], samples[:, open_].sum(axis=1)
        levels = np.linspace(0, 1, 4001)
        filled = np.minimum(room[:, None, :], levels[None, :, None])
        total, norm = filled.sum(-1), np.sqrt((filled**2).sum(-1))
        best = min(0.1 * s + np.mean(base + np.maximum(0, (total - s * norm).max(axis=1))) for s in np.linspace(0, np.sqrt(open_.sum()), 4001))
        assert robust.robust_value(samples, open_, 0.1, 13.0)[0] == pytest.approx(13.0 * best, abs=5e-4 * 13)


def least_members(nodes, links):
    label = {n: n for n in nodes}
    while True:
        moved = [(n, min(label[a], label[b])) for a, b in links for n in (a, b) if label[n] > min(label[a], label[b])]
        if not moved:
            return label
        for n, least in moved:
            label[n] = min(label[n], least)


def test_links_that_come_and_go(spark):
    """Cuts that split, cuts that a replacement link outlives, links that join again, against labels from scratch."""
    draw = np.random.default_rng(5)
    labels, links = spark.createDataFrame([], "node long, label long"), spark.createDataFrame([], "src long, dst long")
    nodes, held = set(), set()
    batches_ = [[("link", a, b) for a, b in ((0, 2), (2, 4), (4, 0), (1, 3), (3, 5), (5, 1), (6, 6))], [("cut", 0, 2), ("link", 5, 2), ("cut", 8, 9)]]
    for _ in range(3):
        pairs = draw.integers(0, 14, (8, 2)).tolist()
        batches_.append([("cut" if draw.random() < 0.5 and held else "link", *p) for p in pairs] + [("cut", *p) for p in sorted(held)[:2]])
    for batch in batches_:
        labels, links = forest.changed_links(labels, links, spark.createDataFrame(batch, "op string, src long, dst long"))
        real = [(op, min(a, b), max(a, b)) for op, a, b in batch if a != b]
        nodes |= {n for _, a, b in real for n in (a, b)}
        held = (held | {(a, b) for op, a, b in real if op == "link"}) - {(a, b) for op, a, b in real if op == "cut"}
        assert {tuple(r) for r in links.collect()} == held
        assert {r["node"]: r["label"] for r in labels.collect()} == least_members(nodes, held)


def test_batched_reversals_shorten_every_tour():
    draw = np.random.default_rng(4)
    xy = draw.normal(size=(5, 12, 2))
    d = np.sqrt(((xy[:, :, None] - xy[:, None]) ** 2).sum(-1))
    tours = np.array([draw.permutation(12) for _ in range(5)])
    cost = lambda t: d[np.arange(5)[:, None], t, np.roll(t, -1, axis=1)].sum(axis=1)
    better = capacitated.batched_two_opt(d, tours, 100)
    assert (cost(better) <= cost(tours) + 1e-9).all() and all(sorted(t) == list(range(12)) for t in better.tolist())
    for t in range(5):
        for i, j in itertools.combinations(range(12), 2):
            turned = better[t].copy()
            turned[i : j + 1] = turned[i : j + 1][::-1]
            assert cost(np.where(np.arange(5)[:, None] == t, turned, better))[t] >= cost(better)[t] - 1e-5


def test_search_without_patience_and_its_track(spark):
    draw = np.random.default_rng(1)
    rows = [(1, 0, 0.0, 0.0, 0.0)] + [(1, i, float(a), float(b), 2.0) for i, (a, b) in enumerate(draw.normal(size=(12, 2)), 1)]
    stops = spark.createDataFrame(rows, "instance long, node long, x double, y double, demand double")
    plan = capacitated.search(stops, 8.0, rounds=12, patience=None).cache()
    assert plan.first()["rounds"] == 12
    track = json.loads(plan.first()["track"])
    got = {r["round"]: r["best_cost"] for r in capacitated.best_at_rounds(plan, [0, 3, 12, 99]).collect()}
    assert got == {0: track[0], 3: track[3], 12: track[12], 99: track[-1]}


def test_seeds_are_numbers(spark):
    got = spark.createDataFrame([("2024-04-10 01",), ("x",)], "key string").select("key", scalars.stable_seed(42, F.col("key")).alias("seed")).collect()
    for r in got:
        assert int(r["seed"]) == int.from_bytes(hashlib.sha256(f"42|{r['key']}".encode()).digest()[:8], "little")


def test_footers_duplicates_and_missing_days(spark, tmp_path):
    for day, name, at in (("2024-01-01", "a", "2024-01-01 03:20:00"), ("2024-01-01", "b", "2024-01-01 03:40:00"), ("2024-01-03", "c", "2024-01-03 00:10:00")):
        folder = tmp_path / f"publish_date={day}"
        folder.mkdir(exist_ok=True)
        made = spark.createDataFrame([("p", at, "3", "{}"), ("q", "2024-01-09 00:00:00", "3", "{}")], "plate_num string, published_at string, speed string, coord string")
        made.coalesce(1).write.parquet(str(tmp_path / f"w{name}"))
        next((tmp_path / f"w{name}").glob("*.parquet")).rename(folder / f"{name}.c000")
    (tmp_path / "publish_date=2024-01-03" / "bad.c000").write_bytes(b"no table")
    report = P.file_report(spark, str(tmp_path)).cache()
    assert sorted((r["path"][-6:], r["rows"], r["readable"]) for r in report.collect() if r["readable"]) == [("a.c000", 2, True), ("b.c000", 2, True), ("c.c000", 2, True)]
    assert [r["path"][-8:] for r in report.where("not readable").collect()] == ["bad.c000"]
    hours = P.hours_by_footer(report)
    assert sorted(str(r["hour"]) for r in hours.collect()) == ["2024-01-01 03:00:00", "2024-01-01 03:00:00", "2024-01-03 00:00:00"]
    assert [(str(r["hour"]), r["files"]) for r in P.duplicate_periods(hours).collect()] == [("2024-01-01 03:00:00", 2)]
    gone = P.missing_days(P.raw_pings(spark, str(tmp_path), "?.c000"), "2024-01-01", "2024-01-04")
    assert sorted(str(r["missing_day"]) for r in gone.collect()) == ["2024-01-02", "2024-01-04"]


def test_tables_in_and_out(spark, tmp_path):
    rows = spark.createDataFrame([(1, 0.5, "2024/01/02"), (2, None, "?")], "k long, v double, at string")
    sinks.write_csv(rows.coalesce(1), str(tmp_path / "sig"), encoding="utf-8-sig")
    text = next((tmp_path / "sig").glob("*.csv")).read_bytes()
    assert text.startswith(b"\xef\xbb\xbfk,v,at") and b"0.50000000" in text
    got = sinks.read_csv(spark, str(tmp_path / "sig"), "k long, v double, at string", "utf-8-sig", columns=["v", "at"], dates={"at": "yyyy/MM/dd"}, index="k")
    assert got.columns == ["k", "v", "at"]
    assert sorted((r["k"], str(r["at"])) for r in got.collect()) == [(1, "2024-01-02 00:00:00"), (2, "None")]
    calls = []
    make = lambda: calls.append(1) or rows
    assert [sinks.cached(spark, str(tmp_path / "cache"), make).count() for _ in range(2)] == [2, 2] and calls == [1]
    sinks.write_numbered(spark.range(100).withColumnRenamed("id", "number"), str(tmp_path / "numbered"), "number")
    assert sorted(r["number"] for r in sinks.read_slice(spark, str(tmp_path / "numbered"), "number", 30, 4).collect()) == [30, 31, 32, 33]
    sinks.write_sheets({"first & best": rows, "second": rows.limit(0)}, str(tmp_path / "report.xlsx"))
    with zipfile.ZipFile(tmp_path / "report.xlsx") as book:
        assert b"first &amp; best" in book.read("xl/workbook.xml") and b"<v>0.5</v>" in book.read("xl/worksheets/sheet1.xml")
        assert book.read("xl/worksheets/sheet2.xml").count(b"<row>") == 1


def test_harness_checks_columns_and_times_iterations(spark):
    table = spark.createDataFrame([(1, 0.0), (2, 1.0)], "event_id long, lon double")
    data = experiments.Dataset("two", table)
    twice = experiments.Algorithm("twice", lambda points, k: (points.withColumn("label", F.lit(i)) for i in range(k)), needs=("event_id bigint",), gives=("label",))
    score = experiments.Evaluator("rows", lambda points, labelled: labelled.count(), needs=("label",))
    records = list(experiments.Suite({"two": data}, {twice: {"k": 2}}, [score]).run())
    assert [(r["iteration"], r["rows"]) for r in records] == [(0, 2), (1, 2)] and all(r["iteration_seconds"] > 0 for r in records)
    with pytest.raises(TypeError, match="needs columns"):
        experiments.Suite({"two": table}, {experiments.Algorithm("x", lambda p: p, needs=("lat",)): {}})
    with pytest.raises(TypeError, match="promised"):
        list(experiments.Suite({"two": table}, {experiments.Algorithm("x", lambda p: p, gives=("label",)): {}}).run())
    with pytest.raises(TypeError, match="instead of a table"):
        list(experiments.Suite({"two": table}, {experiments.Algorithm("x", lambda p: 3): {}}).run())
    with pytest.raises(TypeError, match="no column"):
        experiments.Dataset("two", table, label="truth")


def test_older_parameter_rules(spark):
    rows = spark.createDataFrame([(n,) for n in (100, 10_000, 57_646, 10**9)], "n long")
    got = {r["n"]: (r["eps"], r["k"], r["t"]) for r in rows.select("n", *[c.alias(a) for c, a in zip(cluster.mild_parameters(F.col("n")), ("eps", "k", "t"), strict=True)]).collect()}
    for n, found in got.items():
        grown = np.log(n) - np.log(10_000)
        assert found == (round(max(0.4, 0.75 / (1 + 0.03 * grown)), 4), int(min(10 + 0.6 * grown, 30)), int(min(10 + grown / np.log(2), 20)))
    draw = np.random.default_rng(2)
    values = np.sort(draw.gamma(2.0, 0.1, 200))
    table = spark.createDataFrame([(1, float(v)) for v in values], "g int, v double")
    row = cluster.knee(table, "g", "v").first()
    q, elbow = np.quantile(values, 0.9), values[np.argmax(np.gradient(values))]
    want = (q + elbow) / 2 if abs(q - elbow) / max(q, 1e-6) > 0.5 else q
    assert row["raw"] == pytest.approx(want) and (row["least"], row["most"]) == (values[0], values[-1])
    for d in (2, 20, 54):
        got = spark.createDataFrame([(float(d), 0.3, 0.1, 0.9)], "d double, raw double, a double, b double").select(cluster.dimension_radius(F.col("d"), F.col("raw"), F.col("a"), F.col("b")).alias("e")).first()["e"]
        share = 1 / (1 + np.exp(-0.15 * (d - 15)))
        low, high = 0.2 + 0.5 * share, 0.3 + 0.45 * share
        bend = np.tanh((d - 6.5) / 8)
        place = (0.3 - 0.1) / 0.8 * (1 - 0.4 * abs(bend)) + (0.5 + 0.3 * bend) * 0.4 * abs(bend)
        assert got == pytest.approx(0.01 + 0.99 / (1 + np.exp(-10 * (low + place * (high - low) - 0.5))), abs=1e-4)
