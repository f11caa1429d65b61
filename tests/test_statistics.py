import itertools
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from patrolkit.functions.scalars import gap_pct, join_at_depot, persistence_score, split_at_depot, stable_seed, used_vehicles
from patrolkit.operators import evaluation, statistics
from patrolkit.plans import experiments
from patrolkit.sources import sinks, vrp
from patrolkit.streaming import batches


def test_tail_of_48_values(spark):
    rows = spark.createDataFrame([(float(v),) for v in range(48)], "cost double")
    row = statistics.tail_summary(rows, "cost").first()
    assert (row["n"], row["cvar_value"], row["worst_value"]) == (48, 45.0, 47.0)


def test_tail_with_ties_and_groups(spark):
    rows = spark.createDataFrame([("a", 1.0)] * 15 + [("b", 2.0), ("b", 4.0)], "g string, cost double")
    got = {r["g"]: r["cvar_value"] for r in statistics.tail_summary(rows, "cost", ["g"]).collect()}
    assert got == {"a": 1.0, "b": 4.0}


def exact_p(diff, alternative):
    rank = np.argsort(np.argsort(np.abs(diff))) + 1
    plus = rank[np.array(diff) > 0].sum()
    sums = [sum(r for r, s in zip(rank, signs, strict=True) if s) for signs in itertools.product([0, 1], repeat=len(diff))]
    up, down = np.mean([s >= plus for s in sums]), np.mean([s <= plus for s in sums])
    return {"greater": up, "less": down, "two-sided": min(1, 2 * min(up, down))}[alternative]


@pytest.mark.parametrize("alternative", ["greater", "less", "two-sided"])
def test_signed_ranks_are_exact_for_few(alternative):
    diff = [1.5, -0.2, 3.0, 2.2, -0.9, 4.1, 0.4]
    assert statistics.wilcoxon(np.array(diff), alternative=alternative)[1] == pytest.approx(exact_p(diff, alternative))


def test_signed_ranks_corner_cases():
    assert statistics.wilcoxon(np.zeros(5)) == (0.0, 1.0)
    w, p = statistics.wilcoxon(np.array([1.0, 1.0, 0.0]), zeros="zsplit")
    assert 0 < p < 1 and w == pytest.approx(5.5)


def test_signed_ranks_by_columns_agree_with_the_kernel(spark):
    draw = np.random.default_rng(1)
    diff = np.round(draw.normal(0.2, 1, 200), 1)
    rows = spark.createDataFrame([("a", float(d)) for d in diff] + [("b", 1.0), ("b", 2.0)], "method string, diff double")
    got = {r["method"]: r for r in statistics.wilcoxon_by(rows, "method").collect()}
    w, p = statistics.wilcoxon(diff)
    assert (got["a"]["w_plus"], got["a"]["p_value"]) == (pytest.approx(w), pytest.approx(p))
    assert got["b"]["p_value"] == pytest.approx(0.25)


def test_student_tail_and_correlation():
    assert statistics.student_tail(2.0, 10) == pytest.approx(0.036694, abs=1e-5)
    assert statistics.student_tail(0.0, 5) == pytest.approx(0.5)
    assert statistics.correlation_p(0.5, 20) == pytest.approx(0.024793, abs=1e-4)


def test_bootstrap_blocks():
    means = statistics.block_bootstrap(np.arange(10.0), 4, 500, 3)
    assert means.shape == (500,) and abs(means.mean() - 4.5) < 0.3
    assert np.all(statistics.block_bootstrap(np.ones(7), 3, 5, 1) == 1.0)


def test_average_ranks(spark):
    rows = spark.createDataFrame([(1.0,), (2.0,), (2.0,), (5.0,)], "v double")
    assert sorted(r["r"] for r in statistics.average_rank(rows, "v", [], "r").collect()) == [1.0, 2.5, 2.5, 4.0]


def test_pareto_agrees_with_brute_force(spark):
    draw = np.random.default_rng(5)
    pts = [(i, float(c), float(g)) for i, (c, g) in enumerate(zip(draw.integers(0, 30, 200), draw.integers(0, 30, 200), strict=True))]
    got = {(r["cost"], r["gain"]) for r in statistics.pareto(spark.createDataFrame(pts, "id long, cost double, gain double"), "cost", "gain", "id").collect()}
    want = {(c, g) for _, c, g in pts if not any((c2 <= c and g2 > g) or (c2 < c and g2 >= g) for _, c2, g2 in pts)}
    assert got == want


def test_envelope_breakpoints(spark):
    pool = spark.createDataFrame([("a", 0.0, 23.361124), ("b", 2734.563, 22.112008), ("c", 82367.924, 1.050628)], "plan_id string, travel double, unit_penalty double")
    levels = spark.createDataFrame([(2189.0,), (2190.0,), (3780.0,), (3782.0,)], "level double")
    got = {r["level"]: r["plan_id"] for r in statistics.lower_envelope(pool, levels).collect()}
    assert got == {2189.0: "a", 2190.0: "b", 3780.0: "b", 3782.0: "c"}


def test_agreement_of_labels(spark):
    same = spark.createDataFrame([(1, 7, 5), (2, 8, 5)], "truth int, found int, n long")
    row = evaluation.agreement(same).first()
    assert (row["ari"], row["nmi"], row["accuracy"]) == (1.0, pytest.approx(1.0), 1.0)
    mixed = spark.createDataFrame([(1, 1, 2), (1, 2, 1), (2, 2, 3)], "truth int, found int, n long")
    assert evaluation.agreement(mixed).first()["ari"] == pytest.approx(0.32432432, abs=1e-6)


def test_cluster_scores(spark):
    rows = spark.createDataFrame([(0, 0, 0.0, 0.0), (1, 0, 0.0, 1.0), (2, 1, 10.0, 0.0), (3, 1, 10.0, 1.0), (4, -1, 99.0, 9.0)], "id long, label int, x double, y double")
    row = evaluation.scatter_scores(rows, "label", ["x", "y"]).first()
    assert row["calinski_harabasz"] == pytest.approx(200.0)
    assert row["davies_bouldin"] == pytest.approx(0.1)
    assert 0.89 < evaluation.silhouette(rows, "label", ["x", "y"]).first()["silhouette"] < 0.91


def test_graph_measures(spark):
    ring = spark.createDataFrame([(i, (i + 1) % 6) for i in range(6)], "src long, dst long")
    row = evaluation.degrees(ring).first()
    assert (row["vertices"], row["mean_degree"]) == (6, 2.0)
    assert evaluation.second_eigenvalue(ring, 20) == pytest.approx(1 - math.cos(2 * math.pi / 6), abs=1e-3)


def test_scalars(spark):
    row = spark.range(1).select(
        persistence_score(F.lit(7078), F.lit(167)).alias("p"), gap_pct(F.lit(110.0), F.lit(100.0)).alias("g"), used_vehicles(F.from_json(F.lit("[[1],[],[2,3]]"), "array<array<int>>")).alias("u"),
        split_at_depot(F.array(*[F.lit(v) for v in (0, 1, 2, 0, 0, 3)])).alias("s"), join_at_depot(F.from_json(F.lit("[[1,2],[3]]"), "array<array<bigint>>")).alias("j"), stable_seed(42, F.lit("k")).alias("h"),
    ).first()
    assert row["p"] == pytest.approx(114.55959915733236)
    assert (round(row["g"], 6), row["u"]) == (10.0, 2)
    assert row["s"] == [[1, 2], [3]] and row["j"] == [0, 1, 2, 0, 3, 0]
    import hashlib

    assert int(row["h"]) == int.from_bytes(hashlib.sha256(b"42|k").digest()[:8], "little")


VRP = """NAME : \tmini
DIMENSION : \t6
CAPACITY : \t10
NODE_COORD_SECTION
1\t0\t0
2\t3\t4
4\t6\t8
6\t0\t1
DEMAND_SECTION
1\t0
2\t5
6\t2
DEPOT_SECTION
 1
 -1
EOF
"""


def test_instances_with_a_missing_node(spark, tmp_path):
    (tmp_path / "mini.vrp").write_text(VRP)
    (tmp_path / "mini.sol").write_text("Route #1: 1 2\nRoute #2: 5\nCost 42\n")
    heads = {r["key"]: r["value"] for r in vrp.instance_headers(spark, str(tmp_path / "mini.vrp")).collect()}
    assert heads["CAPACITY"] == "10"
    nodes = {r["node"]: (r["x"], r["y"], r["demand"]) for r in vrp.instance_nodes(spark, str(tmp_path / "mini.vrp")).collect()}
    assert nodes == {1: (0, 0, 0), 2: (3, 4, 5), 3: (0, 0, 0), 4: (6, 8, 0), 5: (0, 0, 0), 6: (0, 1, 2)}
    sol = vrp.solutions(spark, str(tmp_path / "mini.sol")).first()
    assert (sol["cost"], sol["routes"]) == (42.0, [[1, 2], [5]])
    tour = spark.createDataFrame([("t", 0, 0.0, 0.0), ("t", 1, 3.0, 4.0), ("t", 2, 0.0, 1.0)], "t string, pos int, x double, y double")
    assert vrp.rounded_tour_cost(tour, ["t"]).first()["cost"] == 5 + 4 + 1


def test_generators(spark):
    for kind in ("uniform", "cluster", "mixed"):
        made = vrp.random_instances(spark, 2, 20, kind)
        assert made.count() == 40
        assert made.where("x < 0 or x > 1 or y < 0 or y > 1 or demand > 1 or demand <= 0").count() == 0
    assert vrp.two_moons(spark, 50).groupBy("label").count().count() == 2
    assert vrp.blobs(spark, 30, 3, 5).select("label").distinct().count() == 5
    assert vrp.block_model(spark, 20, 2, 1.0, 0.0).where("src % 2 <> dst % 2").count() == 0


def test_result_log_and_resume(spark, tmp_path):
    path = str(tmp_path / "log")
    rows = spark.createDataFrame([(1, 2.0)], "trial int, cost double")
    sinks.append_results(rows, path)
    sinks.append_results(rows, path)
    assert spark.read.parquet(path).count() == 2
    with pytest.raises(ValueError, match="the log has"):
        sinks.append_results(rows.withColumn("more", F.lit(1)), path)
    left = sinks.remaining(experiments.grid(spark, m=[1, 2], seed=[1, 2]), spark.createDataFrame([(1, 2)], "m long, seed long"), ["m", "seed"])
    assert left.count() == 3
    sinks.write_csv(rows, str(tmp_path / "csv"))
    assert sinks.read_csv(spark, str(tmp_path / "csv"), "trial int, cost double").first()["cost"] == 2.0


def test_suite(spark):
    data = {"d": spark.range(10)}
    first = experiments.Algorithm("first", lambda points, n, twice=1: points.limit(n * twice))
    suite = experiments.Suite(data, {first: {"n": [2, 3], "twice": lambda p: p["n"]}}, [experiments.Evaluator("rows2", lambda p, r: r.count())])
    got = experiments.results(spark, suite.run())
    assert sorted(r["rows2"] for r in got.collect()) == [4.0, 9.0]
    assert len(list(suite.run(done=[0]))) == 1
    with pytest.raises(ValueError, match="no parameters"):
        experiments.Suite(data, {first: {"k": 1}})


def test_selection_rules(spark):
    rows = [(1000.0, 0.1, 80.0, 5.0, 5.0, 1.0), (2000.0, 0.1, 90.0, 9.0, 5.0, 1.0), (2000.0, 0.2, 90.0, 8.0, 5.0, 1.0), (4000.0, 0.1, 95.0, 1.0, 1.0, 1.0)]
    table = spark.createDataFrame(rows, "scale double, epsilon double, coverage_pct double, cvar_cost double, mean_cost double, travel double")
    assert experiments.select_parameters(table).first()["epsilon"] == 0.2
    assert experiments.refinement_pairs(table).count() == 2
    assert experiments.select_parameters(table, 99.0).first()["scale"] == 4000.0
    validation = spark.createDataFrame([(0.2, 70000.0), (0.25, 68777.2466), (0.3, 68777.2466)], "epsilon double, validation_mean_cost double")
    assert experiments.best_epsilon(validation).first()["epsilon"] == 0.25


def test_stream_gives_the_static_labels(spark, tmp_path):
    """After every batch, over a restart, and with a cost that follows the batch."""
    from patrolkit.operators.cluster import frozen_labels, hashed_dbscan, shifts

    draw = np.random.default_rng(6)
    pts = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(np.round(draw.normal(size=(150, 2)), 2))], "event_id long, lon double, lat double")
    dealt = batches.as_batches(pts, 50).cache()
    assert sorted(r["count"] for r in dealt.groupBy("batch").count().collect()) == [50, 50, 50]
    etas = shifts(3, 0.3)
    touched = []
    for b in range(3):
        dealt.where(f"batch = {b}").drop("batch").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        for name, burn_in in (("all", None), ("burnt", 2)):
            state = batches.IncrementalClusters(spark, str(tmp_path / name), 0.3, 5, etas, burn_in)  # a new object each time
            stream = batches.read_points(spark, str(tmp_path / "in"), "event_id long, lon double, lat double")
            query = state.attach(stream, str(tmp_path / f"{name}-checkpoint"))
            query.awaitTermination()
            assert [p["batch"] for p in state.progress] == [b]
            if name == "all":
                touched += [p["stateOperators"][0]["numRowsUpdated"] for p in query.recentProgress if p["numInputRows"]]
            so_far = dealt.where(f"batch <= {b if burn_in is None else min(b, 1)}")
            want = {r["event_id"]: (r["is_core"], r["label"]) for r in hashed_dbscan(so_far, 0.3, 5, etas, core_by="any bucket").collect()}
            if burn_in is not None and b == 2:
                known = so_far.join(spark.createDataFrame([(i, *v) for i, v in want.items()], "event_id long, is_core boolean, label long"), "event_id")
                want |= {r["event_id"]: (False, r["label"]) for r in frozen_labels(dealt.where("batch = 2"), known, 0.3, etas).collect()}
            assert {r["event_id"]: (r["is_core"], r["label"]) for r in state.labels().collect()} == want
    assert max(touched) <= 50 * 3  # at most one bucket of each hash function for each point of a batch


def test_points_that_come_and_go(spark, tmp_path):
    """After every batch the labels of the live points from scratch: deletes that split clusters, late inserts, returns."""
    from patrolkit.operators.cluster import hashed_dbscan, shifts
    from patrolkit.streaming.changes import ChangingClusters

    draw = np.random.default_rng(9)
    at = np.round(draw.normal(size=(160, 2)) * 0.8, 2)
    etas, net = shifts(3, 0.3), {}
    steps = [
        [("insert", i) for i in range(110)],
        [("delete", i) for i in range(0, 110, 3)] + [("delete", 120)] + [("insert", i) for i in range(110, 118)],  # 120 goes before it comes
        [("insert", i) for i in range(118, 160)] + [("insert", i) for i in range(0, 110, 6)] + [("delete", 1), ("delete", 2)],
    ]
    for step in steps:
        rows = [(op, i, float(at[i][0]), float(at[i][1])) for op, i in step]
        spark.createDataFrame(rows, "op string, event_id long, lon double, lat double").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        state = ChangingClusters(spark, str(tmp_path / "state"), 0.3, 5, etas)  # a new object over the same folders
        state.attach(batches.read_points(spark, str(tmp_path / "in"), "op string, event_id long, lon double, lat double"), str(tmp_path / "checkpoint")).awaitTermination()
        for op, i in step:
            net[i] = net.get(i, 0) + (1 if op == "insert" else -1)
        live = spark.createDataFrame([(i, float(at[i][0]), float(at[i][1])) for i, n in net.items() if n > 0], "event_id long, lon double, lat double")
        want = {r["event_id"]: (r["is_core"], r["label"]) for r in hashed_dbscan(live, 0.3, 5, etas, core_by="any bucket").collect()}
        assert {r["event_id"]: (r["is_core"], r["label"]) for r in state.labels().collect()} == want
    assert len({label for _, label in want.values()}) > 2


def test_recomputed_baseline(spark):
    from patrolkit.operators.cluster import dbscan

    pts = spark.createDataFrame([(i, i % 7 / 10, i % 3 / 10, i // 20) for i in range(60)], "event_id long, lon double, lat double, batch int")
    assert sorted(batches.recomputed(pts, 1, 0.11, 4).collect()) == sorted(dbscan(pts.where("event_id < 40"), 0.11, 4).collect())


def test_live_labels(spark):
    changes = spark.createDataFrame([(0, "insert", 1), (0, "insert", 2), (1, "insert", 3), (2, "delete", 1)], "iter int, op string, id long")
    labels = spark.createDataFrame([(1, 0), (2, 1), (3, 1)], "event_id long, label int")
    got = [(r["n"], r["classes"]) for r in batches.live_labels(changes, labels).orderBy("iter").collect()]
    assert got == [(2, 2), (3, 2), (2, 1)]


def test_spearman_bootstrap_against_whole_panels(spark):
    """The replicates of a panel in memory: ties, and a node that lacks a period, which no replicate with that period ranks."""
    draw = np.random.default_rng(8)
    panel = {(p, n): float(draw.integers(0, 4)) for p in range(9) for n in range(12) if (p, n) != (2, 5)}
    train = draw.integers(0, 6, 12).astype(float)
    rows = spark.createDataFrame([(p, n, v, float(train[n])) for (p, n), v in panel.items()], "day long, node_id long, prize double, t double")
    got = {r["replicate"]: r["rho"] for r in statistics.spearman_bootstrap(rows, "day", "t", block=2, reps=25, seed=3).collect()}
    matrix = np.array([[panel.get((p, n), np.nan) for n in range(12)] for p in range(9)])
    for rep, index in enumerate(statistics.resampled(9, 2, np.arange(25), 3)):
        means = np.round(matrix[index].mean(axis=0), 9)
        held = ~np.isnan(means)
        ranks = [pd.Series(v[held]).rank() for v in (train, means)]
        assert got[rep] == pytest.approx(ranks[0].corr(ranks[1]))
