import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from patrolkit.operators import capacitated, features, spatial, statistics, tuning
from patrolkit.streaming import batches


def stops(spark, n=14, seed=1):
    draw = np.random.default_rng(seed)
    rows = [(1, 0, 0.0, 0.0, 0.0)] + [(1, 10 * i, float(a), float(b), float(q)) for i, (a, b, q) in enumerate(zip(draw.normal(size=n), draw.normal(size=n), draw.integers(1, 9, n), strict=True), 1)]
    return spark.createDataFrame(rows, "instance long, node long, x double, y double, demand double")


def test_capacitated_routes_keep_the_rules_and_get_shorter(spark):
    table = stops(spark)
    plan = capacitated.search(table, 20.0, rounds=30)
    row = plan.first()
    assert row["cost"] <= row["start_cost"] + 1e-9
    assert sorted(i for r in json.loads(row["routes"]) for i in r) == [10 * i for i in range(1, 15)]
    track = json.loads(row["track"])
    assert track == sorted(track, reverse=True)
    assert capacitated.feasibility(plan, table, 20.0).first()["feasible"]
    broken = plan.withColumn("routes", F.lit("[[10, 20], [20]]"))
    bad = capacitated.feasibility(broken, table, 20.0).first()
    assert (bad["missed"], bad["repeated"], bad["feasible"]) == (12, 1, False)


def test_rounded_legs():
    d = capacitated.distances(np.array([[0, 0], [0, 0.5], [0, 1.5], [0, 2.6]]), rounded=True)
    assert d[0].tolist() == [0, 0, 2, 3]


def test_settings_find_the_blobs(spark):
    draw = np.random.default_rng(2)
    xy = np.vstack([draw.normal([0.1, 0.1], 0.004, (150, 2)), draw.normal([0.3, 0.3], 0.004, (150, 2))])
    rows = [("blobs", i, float(x), float(y)) for i, (x, y) in enumerate(xy)] + [("few", 1_000 + i, i / 7, i / 9) for i in range(4)] + [("spread", 2_000 + i, float(i), float(i * i)) for i in range(9)]
    table = spark.createDataFrame(rows, "day string, event_id long, lon double, lat double")
    got = {r["day"]: r for r in tuning.enhanced_parameters(table, "day").collect()}
    assert 0.001 <= got["blobs"]["eps"] <= 0.5 and got["blobs"]["score"] > 0 and got["blobs"]["n"] == 300
    tried = tuning.trials(table, "day").where("day = 'blobs'").collect()
    best = max(tried, key=lambda r: (r["score"], -r["k"]))
    assert (got["blobs"]["min_samples"], got["blobs"]["eps"]) == (best["k"], round(best["eps"], 6))
    assert got["few"]["min_samples"] == 5 and got["few"]["score"] == 0.0 and got["few"]["eps"] > 0
    assert got["spread"]["score"] == 0.0 and got["spread"]["min_samples"] == max(r["k"] for r in tuning.trials(table, "day").where("day = 'spread' and k < 9").collect())
    assert tuning.score(np.full(10, -1), 100) == 0.0


def test_candidate_counts(spark):
    ns = (2, 20, 3_014, 40_000, 10**6, 10**9)
    rows = spark.createDataFrame([(n,) for n in ns], "n long")
    got = {r["n"]: r["k"] for r in rows.select("n", tuning.candidate_counts(F.col("n")).alias("k")).collect()}
    for n in ns:
        smooth = int(min(max(5, 6.4 + 0.2 * np.log(n / 10_000)), 12))
        sizes = int(0.8 * np.log10(n))
        rules = [min(12, max(5, sizes)), min(12, max(5, int(0.9 * max(0.0, np.log10(n) - 1)))), smooth, (max(5, sizes) + smooth) // 2]
        assert got[n] == list(range(max(5, min(rules) - 1), min(15, max(rules) + 2) + 1))[:10]


def test_scaling(spark):
    rows = spark.createDataFrame([(1.0, 5.0), (3.0, 5.0), (None, 5.0)], "a double, b double")
    assert [tuple(r) for r in features.standard_scaled(rows, ["a", "b"]).collect()] == [(-1.0, 0.0), (1.0, 0.0), (None, 0.0)]
    assert [r["a"] for r in features.unit_square(rows, ["a"]).collect()] == [0.0, 1.0, None]


def test_principal_components(spark):
    draw = np.random.default_rng(3)
    x = draw.normal(size=(100, 1)) @ np.array([[2.0, 1.0, 0.0]]) + draw.normal(size=(100, 3)) * 0.01
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "id long, v array<double>")
    got = np.array([r["components"] for r in features.principal_components(df, "v", 1).orderBy("id").collect()])[:, 0]
    assert abs(np.corrcoef(got, x @ np.array([2.0, 1.0, 0.0]))[0, 1]) > 0.999


def test_shares_quintiles_and_gaps(spark):
    rows = spark.createDataFrame([(i, float(i), float(i % 3)) for i in range(10)], "k long, v double, a double")
    row = statistics.top_share(rows, "v", "a", "k").first()
    assert (row["k"], row["share"], row["lift"]) == (2, pytest.approx(2 / 9), pytest.approx(10 / 9))
    assert sorted(r["count"] for r in statistics.rank_quintiles(rows, "v", "k").groupBy("quintile").count().collect()) == [2] * 5
    refs = spark.createDataFrame([(1, 10.0, 5.0), (2, None, 5.0), (3, None, None)], "k long, optimum double, bound double")
    gaps = {r["k"]: r["gap"] for r in statistics.certified_gaps(spark.createDataFrame([(1, 11.0), (2, 6.0), (3, 1.0), (4, 1.0)], "k long, v double"), refs, "k", "v").collect()}
    assert gaps == {1: pytest.approx(10.0), 2: pytest.approx(20.0), 3: None, 4: None}


def test_symmetric_neighbours(spark):
    pts = spark.createDataFrame([(0, 0.0), (1, 1.0), (2, 5.0)], "id long, x double")
    got = {(r["src"], r["dst"]): r["w"] for r in spatial.symmetric_neighbours(pts, 2).collect()}
    assert got[0, 1] == 2.0 and got[2, 1] == 1.0 and got[1, 2] == 1.0 and got[0, 0] == 2.0


def test_late_rows_within_the_watermark(spark, tmp_path):
    rows = [("2024-01-01 00:10:00", 1), ("2024-01-01 03:10:00", 1), ("2024-01-01 01:20:00", 2)]
    for i, r in enumerate(rows):
        spark.createDataFrame([r], "t string, node_id long").select(F.to_timestamp("t").alias("published_at"), "node_id").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = batches.read_points(spark, str(tmp_path / "in"), "published_at timestamp, node_id long")
    query = batches.windowed_counts(stream).writeStream.outputMode("complete").format("memory").queryName("windowed").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert spark.sql("SELECT * FROM windowed").count() == 3


def test_scratch_tables_are_removed_and_kept_ones_stay(spark):
    from pathlib import Path

    from patrolkit.plans.shared_tables import scratch, written

    where = lambda df: Path(df.inputFiles()[0].removeprefix("file://")).parent
    rows = spark.range(3)
    with scratch():
        with scratch():
            inner, kept = written(rows, "inner"), written(rows, "kept", keep=True)
            gone = where(inner)
        assert not gone.exists() and kept.count() == 3
        place = where(kept)
    assert not place.exists()
