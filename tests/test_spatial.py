import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from patrolkit.functions.geo import cell, dihedral, haversine_m, local_km
from patrolkit.operators import cluster, prizes, sampling, spatial
from patrolkit.operators.components import components
from patrolkit.sources import pings as P


def points(spark, rows):
    return spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(rows)], "event_id long, lon double, lat double")


def test_parsing_edge_rows(spark):
    rows = [
        ("a", "2024-01-01 00:00:00", "0", '{"lon": 103.40, "lat": 30.10}'), ("a", "2024-01-01 00:00:00", "0", '{"lon": 103.40, "lat": 30.10}'),
        ("b", "2024-01-01 00:00:00", "5", '{"lon": 104.55, "lat": 31.20}'), ("c", "2024-01-01 00:00:00", "120", '{"lon": 104, "lat": 30.5}'),
        ("d", "2024-01-01 00:00:00", "120.1", '{"lon": 104, "lat": 30.5}'), ("e", "2024-01-01 00:00:00", "abc", '{"lon": 104, "lat": 30.5}'),
        ("f", "2024-01-01 00:00:00", "1", None), ("g", "2024-01-01 00:00:00", "1", '{"lon": 104}'), ("h", "2024-01-01 00:00:00", "1", '{"lon": -104, "lat": 30.5}'),
        ("i", "2024-01-01 00:00:00", "1", '{"lon": 1.04e2, "lat": 30.5}'), (None, "2024-01-01 00:00:00", "1", '{"lon": 104, "lat": 30.5}'), ("k", "never", "1", '{"lon": 104, "lat": 30.5}'),
    ]
    raw = spark.createDataFrame(rows, "plate_num string, published_at string, speed string, coord string")
    kept = P.cleaned(P.parsed(raw))
    assert sorted(r["plate_num"] for r in kept.collect()) == ["a", "b", "c"]
    assert sorted(r["plate_num"] for r in P.slow_in_box(kept).collect()) == ["a", "b"]


def test_periods_with_gaps(spark):
    rows = spark.createDataFrame([("2024-01-01 00:10:00",), ("2024-01-01 02:10:00",), (None,)], "t string").select(F.to_timestamp("t").alias("t"))
    got = [(r["n"], r["status"]) for r in P.period_counts(rows, "t").orderBy("period").collect()]
    assert got == [(1, "present"), (0, "missing"), (1, "present")]


def test_nearest_node_agrees_with_brute_force(spark):
    draw = np.random.default_rng(1)
    pts, nodes = draw.uniform([104, 30.5], [104.05, 30.55], (200, 2)), draw.uniform([104, 30.5], [104.05, 30.55], (40, 2))
    nodes = np.vstack([nodes, nodes[:5]])  # repeated places: the lower id wins
    node_df = spark.createDataFrame([(i, *map(float, n)) for i, n in enumerate(nodes)], "node_id long, lon double, lat double")
    got = {r["event_id"]: (r["node_id"], r["dist_m"]) for r in spatial.nearest_node(points(spark, pts), node_df, 600.0).collect()}
    assert len(got) == len(pts)
    for i, p in enumerate(pts):
        a = np.sin(np.radians(nodes[:, 1] - p[1]) / 2) ** 2 + np.cos(np.radians(p[1])) * np.cos(np.radians(nodes[:, 1])) * np.sin(np.radians(nodes[:, 0] - p[0]) / 2) ** 2
        d = 2 * 6371008.8 * np.arcsin(np.sqrt(a))
        best = int(d.argmin())
        assert got[i][0] == (best if d[best] <= 600 else None)


def brute_dbscan(x, eps, k):
    d2 = ((x[:, None] - x[None]) ** 2).sum(-1)
    near = d2 <= eps * eps
    core = near.sum(1) >= k
    label = np.full(len(x), -1)
    for i in np.flatnonzero(core):
        if label[i] < 0:
            todo = [i]
            while todo:
                j = todo.pop()
                if label[j] < 0:
                    label[j] = i
                    todo += [m for m in np.flatnonzero(near[j] & core) if label[m] < 0]
    out = label.copy()
    for i in np.flatnonzero(~core):
        options = label[near[i] & core]
        out[i] = options.min() if len(options) else -1
    return out + 1, core


@settings(max_examples=25, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 12), st.integers(0, 12)), min_size=0, max_size=60), st.integers(1, 6))
def test_grid_kernel_agrees_with_brute_force(cells, k):
    x = np.array(cells, float).reshape(-1, 2) / 4
    got = cluster.grid_dbscan(x, 0.5, k)
    want, _ = brute_dbscan(x, 0.5, k) if len(x) else (np.empty(0, int), None)
    order = {v: i for i, v in enumerate(sorted(set(want[want > 0].tolist())))}
    assert got.tolist() == [order.get(v, -1) for v in want.tolist()]


@pytest.fixture(params=["cells", "small tiles", "grown tiles", "one tile"])
def kernel_rows(request, monkeypatch):
    """Joins on cells, tiles of a few cells, tiles that grow to some points, and tiles of the registered size."""
    if request.param == "cells":
        monkeypatch.setattr(cluster, "DENSE_ROWS", 0)
    if request.param in ("small tiles", "grown tiles"):
        monkeypatch.setattr(cluster, "BLOCK_CELLS", 4)
        monkeypatch.setattr(cluster, "TILE_ROWS", 1 if request.param == "small tiles" else 40)


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10**6), st.integers(1, 12), st.sampled_from([0.3, 1.0, 3.0]), st.integers(1, 120))
def test_cell_kernel_against_brute_force(seed, k, spread, n):
    draw = np.random.default_rng(seed)
    x = np.vstack([draw.normal(size=(n, 2)) * spread, np.round(draw.normal(size=(n // 2, 2)) * 4) / 4])
    top, core = cluster.cell_dbscan(x, 0.5, k)
    want, is_core = brute_dbscan(x, 0.5, k)
    assert (top + 1).tolist() == want.tolist() and core.tolist() == is_core.tolist()


@pytest.mark.parametrize("spread, k, step", [(4, 4, 4), (1, 6, 16), (12, 2, 2), (2, 300, 8)])
def test_distributed_dbscan_agrees_with_brute_force(spark, kernel_rows, spread, k, step):
    """Sparse, dense and repeated positions; cells that are all core, cells with some cores, and none."""
    x = np.round(np.random.default_rng(2).normal(size=(250, 2)) * spread * step) / step
    x[40:60] = x[3]
    got = {r["event_id"]: (r["label"], r["is_core"]) for r in cluster.dbscan(points(spark, x), 0.5, k).collect()}
    want, core = brute_dbscan(x, 0.5, k)
    assert [got[i] for i in range(len(x))] == list(zip(want.tolist(), core.tolist(), strict=True))


def test_cells_whose_rims_do_not_meet_are_compared(spark, kernel_rows):
    """Two neighbouring cells of many cores each, whose nearest pair is not among the outermost cores."""
    side = 0.5 / np.sqrt(2)
    draw = np.random.default_rng(5)
    for _ in range(3):
        x = np.vstack([draw.uniform(0, 1, (60, 2)) * side * 0.98, draw.uniform(0, 1, (60, 2)) * side * 0.98 + [2 * side, side]])
        got = {r["event_id"]: r["label"] for r in cluster.dbscan(points(spark, x), 0.5, 5).collect()}
        assert [got[i] for i in range(len(x))] == brute_dbscan(x, 0.5, 5)[0].tolist()


def test_groups_are_clustered_apart(spark, kernel_rows):
    draw = np.random.default_rng(6)
    x = np.round(draw.normal(size=(160, 2)) * 6) / 4
    day = draw.integers(0, 3, len(x))
    table = points(spark, x).join(spark.createDataFrame([(i, int(d)) for i, d in enumerate(day)], "event_id long, day long"), "event_id")
    got = {r["event_id"]: r["label"] for r in cluster.dbscan(table, 0.5, 4, by=["day"]).collect()}
    for d in range(3):
        ids = np.flatnonzero(day == d)
        want, _ = brute_dbscan(x[ids], 0.5, 4)
        assert [got[i] for i in ids] == [0 if w == 0 else int(ids[w - 1]) + 1 for w in want]


@pytest.mark.parametrize("k, spread", [(3, 3.0), (6, 2.0)])
def test_tiles_join_long_clusters_and_borders(spark, kernel_rows, k, spread):
    """Winding clusters over many tiles, and points that border on clusters of several tiles."""
    draw = np.random.default_rng(k)
    walk = np.cumsum(draw.normal(size=(400, 2)) * 0.3, axis=0)
    x = np.vstack([walk, draw.normal(size=(300, 2)) * spread, -np.abs(draw.normal(size=(60, 2))) * 9])
    x = x[draw.permutation(len(x))]
    got = {r["event_id"]: (r["label"], r["is_core"]) for r in cluster.dbscan(points(spark, x), 0.5, k).collect()}
    want, core = brute_dbscan(x, 0.5, k)
    assert [got[i] for i in range(len(x))] == list(zip(want.tolist(), core.tolist(), strict=True))


def test_registered_clusters_on_both_sides(spark, monkeypatch):
    """q12 at sf0.01 in many tiles, and by joins on cells, gives what it gives as registered."""
    from patrolkit.plans import catalogue

    labels = lambda: sorted(map(tuple, catalogue.q12_dbscan_labels(spark, "/root/testdata/sf0.01").collect()))
    plain = labels()
    monkeypatch.setattr(cluster, "TILE_ROWS", 500)
    assert labels() == plain
    monkeypatch.setattr(cluster, "DENSE_ROWS", 0)
    assert labels() == plain


def test_empty_clouds(spark):
    none = points(spark, [])
    assert cluster.dbscan(none, 0.5, 3).count() == 0
    assert spatial.spaced(none.withColumnRenamed("event_id", "node_id").withColumn("s", F.lit(1.0)), "s", 100.0).count() == 0


@pytest.fixture(params=[0, 200_000])
def few_links(request, monkeypatch):
    """Rounds of joins, and one task."""
    from patrolkit.operators import components as module

    monkeypatch.setattr(module, "FEW_LINKS", request.param)


def test_components_of_a_long_path_and_a_clique(spark, few_links):
    path = [(i, i + 1) for i in range(60)]
    clique = [(100 + i, 100 + j) for i in range(12) for j in range(i)]
    links = spark.createDataFrame(path + clique + [(7, 7), (None, 3)], "src long, dst long")
    got = {r["node"]: r["label"] for r in components(links).collect()}
    assert got == {i: 0 for i in range(61)} | {100 + i: 100 for i in range(12)}
    assert components(links.limit(0)).count() == 0


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 25), st.integers(0, 25)), max_size=40))
def test_components_agree_with_union_find(spark, few_links, links):
    parent = list(range(26))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in links:
        ra, rb = root(a), root(b)
        parent[max(ra, rb)] = min(ra, rb)
    nodes = {n for a, b in links for n in (a, b) if a != b}
    got = {r["node"]: r["label"] for r in components(spark.createDataFrame(links, "src long, dst long")).collect()}
    assert got == {n: root(n) for n in nodes}


def test_forest_walkthrough(spark):
    links = [(0, 2), (2, 4), (4, 0), (1, 3), (3, 5), (5, 1)]
    of = lambda rows: len({r["label"] for r in components(spark.createDataFrame(rows, "src long, dst long")).collect()})
    assert of(links) == 2
    assert of([*links, (2, 5)]) == 1


def test_spacing_agrees_with_the_sequential_pass(spark):
    draw = np.random.default_rng(3)
    xy, score = draw.uniform([104, 30.5], [104.1, 30.6], (80, 2)), draw.integers(0, 9, 80).astype(float)
    nodes = spark.createDataFrame([(i, float(a), float(b), float(s)) for i, ((a, b), s) in enumerate(zip(xy, score, strict=True))], "node_id long, lon double, lat double, score double")
    got = sorted(r["node_id"] for r in spatial.spaced(nodes, "score", 1500.0).collect())
    kept = []
    for i in sorted(range(80), key=lambda i: (-score[i], i)):
        a = [np.sin(np.radians(xy[j, 1] - xy[i, 1]) / 2) ** 2 + np.cos(np.radians(xy[i, 1])) * np.cos(np.radians(xy[j, 1])) * np.sin(np.radians(xy[j, 0] - xy[i, 0]) / 2) ** 2 for j in kept]
        if all(2 * 6371008.8 * np.arcsin(np.sqrt(v)) >= 1500 for v in a):
            kept.append(i)
    assert got == sorted(kept)


def test_adaptive_parameters_golden(spark):
    n = spark.createDataFrame([(3014.0,)], "n double")
    row = n.select(cluster.min_samples_for(F.col("n")).alias("k"), cluster.hashes_for(F.col("n")).alias("h")).first()
    assert (row["k"], row["h"]) == (6, 8)
    assert spark.range(1).select(cluster.eps_in_metres(F.lit(0.001513)).alias("m")).first()["m"] == pytest.approx(168.42716)


def test_hashed_labels_are_static_and_frozen(spark):
    x = np.round(np.random.default_rng(4).normal(size=(200, 2)), 2)
    etas = cluster.shifts(4, 0.2)
    found = cluster.hashed_dbscan(points(spark, x), 0.2, 6, etas).cache()
    again = cluster.frozen_labels(points(spark, x), points(spark, x).join(found, "event_id"), 0.2, etas)
    both = found.join(again.withColumnRenamed("label", "again"), "event_id").where("is_core and label <> again")
    assert both.count() == 0


def test_prizes_of_a_period_without_counts(spark):
    counted = spark.createDataFrame([("a", 1, 0), ("a", 2, 0), ("b", 1, 3), ("b", 2, 6)], "day string, node_id long, cnt long")
    got = {(r["day"], r["node_id"]): r["prize"] for r in prizes.prizes(counted).collect()}
    assert got == {("a", 1): 0.0, ("a", 2): 0.0, ("b", 1): 0.5, ("b", 2): 1.0}


def test_geometry(spark):
    row = spark.range(1).select(
        haversine_m(F.lit(104.0), F.lit(30.0), F.lit(104.0), F.lit(31.0)).alias("d"), *[c.alias(n) for c, n in zip(local_km(F.lit(104.0665), F.lit(31.6570)), "xy", strict=True)],
        cell(F.lit(-0.1), 1.0).alias("c"), F.size(F.array_distinct(F.transform(dihedral(F.lit(0.1), F.lit(0.3)), lambda s: F.struct(s["x"], s["y"])))).alias("turns"),
    ).first()
    assert row["d"] == pytest.approx(111195.08, abs=0.1)
    assert (row["x"], row["y"]) == (0.0, pytest.approx(110.57))
    assert (row["c"], row["turns"]) == (-1, 8)


def test_samples(spark):
    rows = spark.range(1000).select(F.col("id").alias("event_id"), (F.col("id") % 3).alias("day"))
    assert {r["count"] for r in sampling.exact_share(rows, "day", "event_id", 0.1).groupBy("day").count().collect()} == {33}
    assert sampling.per_cell(rows, [F.col("day")], "event_id", 5).count() == 15
    assert sampling.every_nth(rows, "day", "event_id", 10).count() == 102


@pytest.mark.parametrize("compared", [0, 8_192])
def test_k_distances_against_brute_force(spark, monkeypatch, compared):
    """Dense and sparse places, repeated positions, a period with too few points, and k by period."""
    monkeypatch.setattr(spatial, "COMPARED_ROWS", compared)
    draw = np.random.default_rng(8)
    x = np.vstack([draw.normal(size=(150, 2)) * 0.01, draw.uniform(-5, 5, (60, 2)), np.repeat([[3.0, 3.0]], 9, axis=0), [[100.0, -40.0]]])
    rows = [(0, i, float(a), float(b), 4) for i, (a, b) in enumerate(x)] + [(1, 1000 + i, float(i), 0.0, 5) for i in range(3)] + [(2, 2000, 7.0, 7.0, 2)]
    table = spark.createDataFrame(rows, "day int, event_id long, lon double, lat double, need int")
    for k in (1, 5, "need"):
        got = {r["event_id"]: r["k_dist"] for r in spatial.k_distances(table, "day", k).collect()}
        assert len(got) == len(rows)
        for day in range(3):
            part = [r for r in rows if r[0] == day]
            at = np.array([r[2:4] for r in part])
            d = np.sort(np.sqrt(((at[:, None] - at[None]) ** 2).sum(-1)), axis=1)
            want = d[:, min(k if isinstance(k, int) else part[0][4], len(part)) - 1]
            assert np.allclose([got[r[1]] for r in part], want, atol=1e-12)
    assert spatial.k_distances(table.limit(0), "day", 3).count() == 0
