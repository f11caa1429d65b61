"""The registered queries over the driver's tables, and for each that SQL can express the SQL it is held against."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from patrolkit.functions.geo import local_km
from patrolkit.operators import cluster, evaluation, prizes, robust, routing, sampling, spatial, statistics
from patrolkit.sources import pings as P

#: Settings of the registered queries.
RADIUS_M = 600.0
EPS = 0.0005
MIN_SAMPLES = 5
CENTRE_EPS, CENTRE_SAMPLES = 0.003, 2
MERGE_KM, MERGE_SAMPLES = 0.4, 3
SCALE = 4000.0
RADII = (0.05, 0.1, 0.3)
CROSS_RADII = (0.0, 0.025, 0.05, 0.1, 0.15, 0.2)
LEVELS = tuple(range(1000, 33_001, 1000))
HASHES = 4
MAX_LAT = 35.0


def _pings(spark: SparkSession, sf: str) -> DataFrame:
    return P.events_as_pings(spark, sf)


def _nodes(spark: SparkSession, sf: str) -> DataFrame:
    return P.suppliers_as_nodes(spark, sf)


def _found(spark: SparkSession, sf: str) -> DataFrame:
    return spatial.nearest_node(_pings(spark, sf), _nodes(spark, sf).select("node_id", "lon", "lat"), RADIUS_M, max_abs_lat=MAX_LAT)


def _prizes(spark: SparkSession, sf: str) -> DataFrame:
    found = _found(spark, sf)
    counted = prizes.dense(prizes.counts(found), _pings(spark, sf), _nodes(spark, sf))
    return prizes.prizes(counted)


def _paid(spark: SparkSession, sf: str) -> DataFrame:
    """The prizes over 0: a table of pings' nodes by days, not of all nodes by all days."""
    return prizes.prizes(prizes.counts(_found(spark, sf)))


def _grid(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    return _nodes(spark, sf).select("node_id"), _pings(spark, sf).select("day").distinct()


def _even(spark: SparkSession, sf: str) -> DataFrame:
    return _nodes(spark, sf).where("node_id % 2 = 0").select("node_id")


def _misses(spark: SparkSession, sf: str) -> DataFrame:
    return robust.missed(_prizes(spark, sf), _even(spark, sf))


def _day(column: str = "day"):
    return F.col(column).cast("string").alias("day")


def q01_clean_pings(spark, sf):
    text = F.concat(F.lit('{"lon": '), F.format_string("%.6f", "lon"), F.lit(', "lat": '), F.format_string("%.6f", "lat"), F.lit("}"))
    raw = _pings(spark, sf).select("event_id", F.col("plate_num").cast("string").alias("plate_num"), F.col("published_at").cast("string").alias("published_at"), F.col("speed").cast("string").alias("speed"), text.alias("coord"))
    return P.cleaned(P.parsed(raw)).select("event_id", "plate_num", F.round("speed", 4).alias("speed"), F.round("lon", 6).alias("lon"), F.round("lat", 6).alias("lat"))


def q02_slow_in_box(spark, sf):
    return P.slow_in_box(_pings(spark, sf), 35.0).select("event_id", F.round("lon", 7).alias("lon"), F.round("lat", 7).alias("lat"))


def q03_period_completeness(spark, sf):
    return P.period_counts(_pings(spark, sf), "published_at").select(F.date_format("period", "yyyy-MM-dd HH").alias("period"), "n", "status")


def q04_exact_n_sample(spark, sf):
    return sampling.exact_share(_pings(spark, sf).select("event_id", "day"), "day", "event_id", 0.1).select(_day(), "event_id")


def q05_nearest_node(spark, sf):
    """Unassigned pings carry node -1 and distance -1."""
    return _found(spark, sf).select("event_id", F.coalesce("node_id", F.lit(-1).cast("long")).alias("node_id"), F.coalesce(F.round("dist_m", 3), F.lit(-1.0)).alias("dist_m"))


def q06_daily_counts(spark, sf):
    return prizes.counts(_found(spark, sf)).select(_day(), "node_id", "cnt")


def q07_daily_prizes(spark, sf):
    return _prizes(spark, sf).select(_day(), "node_id", "cnt", F.round("prize", 6).alias("prize"))


def q08_unique_vehicle_visits(spark, sf):
    return prizes.visits(_found(spark, sf)).select(_day(), "node_id", "vehicles")


def q09_assignment_summary(spark, sf):
    return prizes.assignment_summary(_found(spark, sf)).select(_day(), "points", "assigned", F.round("rate_pct", 6).alias("rate_pct"), "nodes_hit", F.round("mean_dist_m", 3).alias("mean_dist_m"))


def q10_epsilon_neighbours(spark, sf):
    return cluster.core_points(_pings(spark, sf), EPS, MIN_SAMPLES).select("event_id", "neighbours")


def q11_dbscan_core(spark, sf):
    return cluster.core_points(_pings(spark, sf), EPS, MIN_SAMPLES).where("is_core").select("event_id")


def q12_dbscan_labels(spark, sf):
    return cluster.dbscan(_pings(spark, sf), EPS, MIN_SAMPLES).select("event_id", "is_core", "label")


def q13_cluster_centroids(spark, sf):
    points = _pings(spark, sf)
    labelled = points.join(cluster.dbscan(points, EPS, MIN_SAMPLES), "event_id")
    return cluster.centroids(labelled, [], noise=0).select("label", F.round("lon", 7).alias("lon"), F.round("lat", 7).alias("lat"), "sampled_count")


def q14_kdist_quantiles(spark, sf):
    dist = spatial.k_distances(_pings(spark, sf), "day", 6)
    return dist.groupBy("day").agg(*[F.round(F.expr(f"percentile(k_dist, {q})"), 8).alias(f"q{int(q * 100)}") for q in (0.5, 0.6, 0.7, 0.75)], F.count("*").alias("n")).select(_day(), "q50", "q60", "q70", "q75", "n")


def q15_adaptive_params(spark, sf):
    points = _pings(spark, sf)
    made = cluster.region_parameters(spatial.k_distances(points, "day", 5), "day", points)
    return made.select(_day(), "n", F.round("eps", 8).alias("eps"), "min_samples", "hashes")


def q15b_density_params(spark, sf):
    points = _pings(spark, sf)
    made = cluster.density_parameters(spatial.k_distances(points, "day", 5), spatial.k_distances(points, "day", 2), points, "day")
    return made.select(_day(), "n", F.round("eps", 5).alias("eps"), "min_samples", "hashes")


def _centres(spark, sf):
    points = _pings(spark, sf).select("day", "event_id", "lon", "lat")
    found = cluster.dbscan(points, CENTRE_EPS, CENTRE_SAMPLES, by=["day"]).where("label > 0").select("event_id", "label")
    return cluster.centroids(points.join(found, "event_id"), ["day"])


def _merged(spark, sf):
    """Centres of all days with the cluster that holds them in local kilometres about their mean latitude."""
    from patrolkit.plans.shared_tables import written

    day = F.datediff("day", F.lit("2000-01-01").cast("date"))
    centres = written(_centres(spark, sf).withColumn("event_id", day.cast("long") * 1_000_000_000_000 + F.col("label")), "centres")
    mean_lat = centres.agg(F.avg("lat")).first()[0] or 0.0
    x, y = local_km(F.col("lon"), F.col("lat"), 0.0, float(mean_lat))
    local = centres.select("event_id", x.alias("lon"), (y + mean_lat * 110.57).alias("lat"))
    found = cluster.dbscan(local, MERGE_KM, MERGE_SAMPLES).where("label > 0").select("event_id", F.col("label").alias("merged_label"))
    return centres.join(found, "event_id")


def q16_persistent_candidates(spark, sf):
    best = prizes.persistent(_merged(spark, sf), "day")
    return best.select("node_id", "sampled_count", "active_periods", "cluster_count", F.round("score", 6).alias("score"))


def q17_greedy_spacing(spark, sf):
    return spatial.spaced(_nodes(spark, sf), "weight", 25_000.0, max_abs_lat=MAX_LAT).select("node_id", F.round("weight", 4).alias("weight"))


def q18_prize_quintiles(spark, sf):
    means = _prizes(spark, sf).groupBy("node_id").agg(F.avg("prize").alias("mean_prize"))
    edges = means.agg(F.expr("percentile(round(mean_prize, 9), array(0.2, 0.4, 0.6, 0.8))").alias("edges"))
    value = F.round("mean_prize", 9)
    by_value = 1 + F.size(F.filter(F.array_distinct("edges"), lambda e: value > F.round(e, 9)))
    ranked = statistics.tiles(means.withColumn("value", value), "value", "node_id", 5, "rank_bin")
    return ranked.crossJoin(F.broadcast(edges)).select("node_id", F.round("mean_prize", 6).alias("mean_prize"), by_value.cast("int").alias("value_bin"), "rank_bin")


def _routes(spark, sf):
    return routing.sector_routes(_nodes(spark, sf), 4)


def q19_route_costs(spark, sf):
    return routing.route_costs(_routes(spark, sf)).select("vehicle", "stops", F.round("cost", 3).alias("cost"))


def q20_feasibility(spark, sf):
    return routing.feasibility(_routes(spark, sf), _nodes(spark, sf), 4, 1_000_000.0).select("used", F.round("longest", 3).alias("longest"), "duplicates", "unknown", "feasible")


def q21_nominal_penalty(spark, sf):
    return robust.nominal(_misses(spark, sf), SCALE).select(F.round("penalty", 3).alias("penalty"), "unvisited")


def q22_box_penalty(spark, sf):
    return robust.box(_misses(spark, sf), SCALE).select(F.round("penalty", 3).alias("penalty"))


def _radii(spark, values=RADII):
    return spark.createDataFrame([(float(v),) for v in values], "epsilon double")


def q23_dro_fast(spark, sf):
    made = robust.robust_bound(_misses(spark, sf), _radii(spark), SCALE)
    return made.select("epsilon", F.round("penalty", 3).alias("penalty"), "certified")


def _selections(spark, sf):
    """Selections by remainder: every second, third and fifth node, all nodes, and none."""
    nodes = _nodes(spark, sf).select("node_id")
    parts = [nodes.where(f"node_id % {k} = 0").select(F.lit(f"every {k}").alias("selection"), "node_id") for k in (2, 3, 5)]
    parts += [nodes.select(F.lit("all").alias("selection"), "node_id"), spark.createDataFrame([("none", None)], "selection string, node_id long")]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def q24_dro_general(spark, sf):
    chosen = _selections(spark, sf).groupBy("selection").agg(F.collect_list("node_id").alias("nodes"))
    tasks = chosen.crossJoin(_radii(spark, (0.0, 0.1, 0.5, 1.0)))
    return robust.robust(_paid(spark, sf), tasks, scale=SCALE, grid=_grid(spark, sf)).select("selection", "epsilon", F.round("penalty", 2).alias("penalty"))


def _realized(spark, sf):
    travel = routing.route_costs(_routes(spark, sf).where("node_id % 2 = 0")).agg(F.sum("cost")).first()[0]
    return statistics.realized(_misses(spark, sf), travel or 0.0, SCALE)


def q25_realized_cost(spark, sf):
    return _realized(spark, sf).select(_day(), F.round("cost", 3).alias("cost"), F.round("missed", 6).alias("missed"))


def q26_coverage(spark, sf):
    return _realized(spark, sf).select(_day(), F.round("coverage_pct", 6).alias("coverage_pct"))


def q27_cvar(spark, sf):
    made = statistics.tail_summary(_realized(spark, sf), "cost")
    return made.select("n", F.round("mean_value", 3).alias("mean_value"), F.round("cvar_value", 3).alias("cvar_value"), F.round("worst_value", 3).alias("worst_value"))


def _travel(spark, sf):
    """Each selection's route cost: its nodes in four angular sectors, with the legs from and to the depot."""
    from patrolkit.plans.shared_tables import small

    chosen = _selections(spark, sf).join(small(_nodes(spark, sf)), "node_id").select("selection", "node_id", "lon", "lat")
    cost = routing.route_costs(routing.sector_routes(chosen, 4, by="selection"), by=["selection"]).groupBy("selection").agg(F.sum("cost").alias("travel"))
    return _selections(spark, sf).select("selection").distinct().join(cost, "selection", "left").select("selection", F.coalesce("travel", F.lit(0.0)).alias("travel"))


def _exact(spark, sf, radii, scale=SCALE):
    """The exact robust penalty of each selection under each radius."""
    chosen = _selections(spark, sf).groupBy("selection").agg(F.collect_list("node_id").alias("nodes"))
    return robust.robust(_paid(spark, sf), chosen.crossJoin(_radii(spark, radii)), scale=scale, grid=_grid(spark, sf))


def _cross(spark, sf):
    """Plans by selection, each evaluated under every radius: route cost plus the exact robust penalty."""
    value = _exact(spark, sf, CROSS_RADII).join(F.broadcast(_travel(spark, sf)), "selection")
    return value.select("selection", "epsilon", (F.col("penalty") + F.col("travel")).alias("objective"), "travel")


def q28_eps_cross_matrix(spark, sf):
    cells = _cross(spark, sf)
    wide = cells.groupBy("selection").pivot("epsilon", [float(v) for v in CROSS_RADII]).agg(F.round(F.first("objective"), 2))
    return wide.select("selection", *[F.col(f"`{float(v)}`").alias(f"e{int(round(v * 1000))}") for v in CROSS_RADII])


def q29_column_winners(spark, sf):
    best = _cross(spark, sf).groupBy("epsilon").agg(F.min(F.struct(F.round("objective", 2).alias("objective"), "selection")).alias("best"))
    return best.select("epsilon", "best.selection", "best.objective")


def q30_lower_envelope(spark, sf):
    unit = _exact(spark, sf, (0.1,), 1.0).select("selection", F.col("penalty").alias("unit_penalty"))
    pool = unit.join(_travel(spark, sf), "selection").withColumnRenamed("selection", "plan_id")
    levels = spark.createDataFrame([(float(v),) for v in LEVELS], "level double")
    return statistics.lower_envelope(pool, levels).select("level", "plan_id", F.round("objective", 1).alias("objective"))


def q31_pareto(spark, sf):
    orders = spark.read.parquet(f"{sf}/orders.parquet")
    per = orders.groupBy("o_custkey").agg(F.round(F.sum("o_totalprice"), 2).alias("cost"), F.count("*").cast("double").alias("gain"))
    return statistics.pareto(per, "cost", "gain", "o_custkey").select(F.col("o_custkey").cast("long").alias("o_custkey"), F.round("cost", 2).alias("cost"), "gain")


def _records(spark, sf):
    return spark.read.parquet(f"{sf}/orders.parquet").select(F.col("o_orderkey").cast("long").alias("o_orderkey"), F.col("o_custkey").cast("long").alias("instance"), F.col("o_orderpriority").alias("method"), F.col("o_totalprice").cast("double").alias("objective"))


def q32_best_per_group(spark, sf):
    return statistics.best_of_group(_records(spark, sf), ["instance"], "objective", "o_orderkey").select("instance", "o_orderkey", "method", F.round("objective", 2).alias("objective"))


def q33_method_summary(spark, sf):
    made = statistics.method_summary(_records(spark, sf), ["method"], "objective")
    return made.select("method", "runs", *[F.round(f"{k}_value", 3).alias(f"{k}_value") for k in ("mean", "std", "min", "max")])


REFERENCE = "1-URGENT"


def _paired(spark, sf):
    records = _records(spark, sf)
    reference = records.agg(F.min("method")).first()[0]
    return statistics.paired(records, "instance", "method", "objective", reference, "o_orderkey")


def q34_paired_wtl(spark, sf):
    made = statistics.win_tie_loss(_paired(spark, sf), "method")
    return made.select("method", "pairs", F.round("mean_diff", 3).alias("mean_diff"), F.round("mean_reduction_pct", 4).alias("mean_reduction_pct"), "wins", "ties", "losses")


def _halves(spark, sf):
    late = F.dayofmonth("day") > 18
    return _prizes(spark, sf).groupBy("node_id").agg(F.avg(F.when(~late, F.col("prize"))).alias("train_mean"), F.avg(F.when(late, F.col("prize"))).alias("holdout_mean")).dropna()


def q35_calibration_fit(spark, sf):
    made = statistics.calibration(_halves(spark, sf), "train_mean", "holdout_mean")
    return made.select(*[F.round(c, 6).alias(c) for c in ("slope", "intercept", "r2", "mae", "rmse")], "n")


def q36_spearman(spark, sf):
    rounded = _halves(spark, sf).select("node_id", F.round("train_mean", 9).alias("train_mean"), F.round("holdout_mean", 9).alias("holdout_mean"))
    return statistics.spearman(rounded, "train_mean", "holdout_mean").select(F.round("rho", 8).alias("rho"), "n")


def q37_rolling_folds(spark, sf):
    """Three rolling origins; every fold's mean, tail and worst realised cost of its three parts."""
    daily = _realized(spark, sf).select("day", F.round("cost", 6).alias("cost"), (F.dayofmonth("day")).alias("d"))
    folds = spark.createDataFrame([(f, p, a, b) for f, t in ((1, 15), (2, 18), (3, 21)) for p, a, b in (("train", 1, t), ("validate", t + 1, t + 4), ("test", t + 5, t + 9))], "fold int, part string, low int, high int")
    rows = daily.join(F.broadcast(folds), (F.col("d") >= F.col("low")) & (F.col("d") <= F.col("high")))
    made = statistics.tail_summary(rows, "cost", ["fold", "part"])
    return made.select("fold", "part", "n", *[F.round(f"{k}_value", 3).alias(f"{k}_value") for k in ("mean", "cvar", "worst")])


def _labelled_vectors(spark, sf):
    """Each vector's label and the label of the nearest label centre, by squared distance to one centre a label."""
    vectors = spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", F.col("label").cast("int").alias("label"), F.col("embedding").cast("array<double>").alias("v"))
    flat = vectors.select("label", F.posexplode("v").alias("i", "x"))
    centre = flat.groupBy("label", "i").agg(F.avg("x").alias("c")).groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "c"))), lambda s: s["c"]).alias("c"))
    table = centre.agg(F.array_sort(F.collect_list(F.struct("label", "c"))).alias("centres"))
    square = lambda a, b: F.aggregate(F.zip_with(a, b, lambda p, q: (p - q) * (p - q)), F.lit(0.0), lambda s, t: s + t)
    near = F.array_min(F.transform("centres", lambda k: F.struct(F.round(square(F.col("v"), k["c"]), 9).alias("d"), k["label"].alias("label"))))
    return vectors.crossJoin(F.broadcast(table)).select("vec_id", "label", near["label"].alias("found"))


def _agreement(spark, sf):
    return evaluation.agreement(evaluation.contingency(_labelled_vectors(spark, sf), "label", "found"))


def q38_contingency_ari(spark, sf):
    return _agreement(spark, sf).select("n", F.round("ari", 8).alias("ari"))


def q39_nmi(spark, sf):
    return _agreement(spark, sf).select("n", F.round("nmi", 8).alias("nmi"))


def q40_accuracy(spark, sf):
    return _agreement(spark, sf).select("n", F.round("accuracy", 8).alias("accuracy"))


def q41_lsh_fdbscan(spark, sf):
    made = cluster.hashed_dbscan(_pings(spark, sf), 0.001, 10, cluster.shifts(HASHES, 0.001))
    return made.select("event_id", "is_core", "label")


def q42_lsh_dynamic(spark, sf):
    made = cluster.hashed_dbscan(_pings(spark, sf), 0.001, 10, cluster.shifts(HASHES, 0.001), core_by="any bucket")
    return made.select("event_id", "is_core", "label")


def q43_stream_batches(spark, sf):
    """Batches of 1000 inserts by event id, with the points and the distinct vehicles seen so far."""
    rows = _pings(spark, sf).select("event_id", "plate_num", F.floor(F.col("event_id") / 1000).alias("batch"))
    fresh = rows.groupBy("plate_num").agg(F.min("batch").alias("batch")).groupBy("batch").agg(F.count("*").alias("new_vehicles"))
    per = rows.groupBy("batch").agg(F.count("*").alias("inserts")).join(fresh, "batch", "left").withColumn("new_vehicles", F.coalesce("new_vehicles", F.lit(0)))
    points = statistics.counts_before(per, [], "batch", "inserts", "points_before")
    both = statistics.counts_before(points, [], "batch", "new_vehicles", "vehicles_before")
    return both.select("batch", "inserts", (F.col("points_before") + F.col("inserts")).alias("points"), (F.col("vehicles_before") + F.col("new_vehicles")).alias("vehicles"))


def q44_pivot_wide_prizes(spark, sf):
    """Counts and prizes of every day side by side."""
    table = _prizes(spark, sf).withColumn("d", F.date_format("day", "yyyyMMdd"))
    days = [r["d"] for r in table.select("d").distinct().orderBy("d").collect()]  # the output's columns
    wide = table.groupBy("node_id").pivot("d", days).agg(F.first("cnt").alias("cnt"), F.round(F.first("prize"), 6).alias("prize"))
    return wide.select("node_id", *[F.col(f"`{d}_{k}`").alias(f"{k}_{d}") for d in days for k in ("cnt", "prize")])


def q45_density_grid(spark, sf):
    return statistics.density_grid(_pings(spark, sf), "lon", "lat", (103.4, 104.55, 30.1, 31.2), 360).select("bin_x", "bin_y", "amount")


def q46_cluster_report(spark, sf):
    made = evaluation.cluster_report(cluster.dbscan(_pings(spark, sf), EPS, MIN_SAMPLES))
    return made.select("points", "clusters", "noise", F.round("noise_pct", 6).alias("noise_pct"), F.round("mean_size", 6).alias("mean_size"), "max_size", "min_size")


def q47_timepoint_asof(spark, sf):
    """The last ping of each vehicle at weekly time points, from the day after the first ping on."""
    ends = _pings(spark, sf).agg(F.date_add(F.min("day"), 1).cast("timestamp").alias("a"), F.max("published_at").cast("timestamp").alias("b"))
    points = ends.select(F.explode(F.expr("sequence(a, b, interval 7 day)")).alias("point"))
    rows = _pings(spark, sf).select("plate_num", "published_at", "event_id").withColumn("published_at", F.col("published_at").cast("timestamp"))
    made = statistics.as_of(rows, points, "published_at", "plate_num", "event_id")
    return made.select("plate_num", F.date_format("point", "yyyy-MM-dd").alias("point"), "last_event_id")


def q48_running_best(spark, sf):
    made = statistics.running_best(_pings(spark, sf).select("event_id", "plate_num", "speed"), "plate_num", ["event_id"], "speed")
    return made.select("event_id", F.round("best_so_far", 4).alias("best_so_far"))


def q49_mean_sem(spark, sf):
    rows = spark.read.parquet(f"{sf}/lineitem.parquet").select("l_returnflag", "l_linestatus", *[F.col(c).cast("double").alias(c) for c in ("l_quantity", "l_extendedprice", "l_discount")])
    made = statistics.mean_and_sem(rows, ["l_returnflag", "l_linestatus"], ["l_quantity", "l_extendedprice", "l_discount"])
    return made.select("l_returnflag", "l_linestatus", *[F.round(c, 5).alias(c) for c in made.columns[2:]])


def _instance(spark, sf, size: int, seed: int, name: str) -> routing.Instance:
    """A case study of at most ``size`` nodes, stratified by mean prize."""
    table = _prizes(spark, sf)
    means = table.groupBy("node_id").agg(F.avg("prize").alias("mean_prize"))
    chosen = sampling.stratified_nodes(means, "mean_prize", "node_id", 5, size).select("node_id")
    x, y = local_km(F.col("lon"), F.col("lat"))
    at = _nodes(spark, sf).join(chosen, "node_id").select("node_id", x.alias("x"), y.alias("y")).toPandas().sort_values("node_id")
    rows = table.join(F.broadcast(chosen), "node_id").select("day", "node_id", "prize").toPandas()  # at most size nodes
    samples = rows.pivot(index="day", columns="node_id", values="prize").sort_index()[at["node_id"]].to_numpy(float)
    inst = routing.Instance(at[["x", "y"]].to_numpy(float), samples, 2, np.inf, 0.1, SCALE)
    full = routing.full_routes(inst)
    inst.budget = 0.55 * max(map(inst.cost, full))
    return inst


def q50_tsp_2opt_routes(spark, sf):
    """Full routes by sector, nearest neighbour and two-opt, one task for each region's nodes."""
    import pandas as pd

    from patrolkit.plans.shared_tables import ship

    ship(spark)

    x, y = local_km(F.col("lon"), F.col("lat"))
    rows = _nodes(spark, sf).select("region_key", "node_id", x.alias("x"), y.alias("y"))

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("node_id")
        inst = routing.Instance(part[["x", "y"]].to_numpy(float), np.zeros((1, len(part))), 2, np.inf, 0.0, 0.0)
        ids = part["node_id"].to_numpy()
        out = [(int(part["region_key"].iloc[0]), v, p, int(ids[i]), cost) for v, r in enumerate(routing.full_routes(inst)) for cost in (inst.cost(r),) for p, i in enumerate(r)]
        return pd.DataFrame(out, columns=["region_key", "vehicle", "pos", "node_id", "route_cost"])

    dealt = rows.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "region_key")  # few bytes, much work: not put together
    return dealt.groupBy("region_key").applyInPandas(run, "region_key long, vehicle long, pos long, node_id long, route_cost double")


def q51_mns_solve(spark, sf):
    instances = {f"n{n}": _instance(spark, sf, n, 1, f"n{n}") for n in (10, 15)}
    grid = [(name, m, seed, 2) for name in instances for m in ("grasp", "ils", "alns", "warm") for seed in (1, 2)]
    return routing.solve_grid(spark.createDataFrame(grid, "instance string, method string, seed int, rounds int"), instances)


def q52_bootstrap_ci(spark, sf):
    rows = _realized(spark, sf).select(F.lit("every 2").alias("plan"), "day", "cost")
    made = statistics.bootstrap_interval(rows, "day", "cost", "plan", reps=2000)
    return made.select("plan", *[F.round(c, 3).alias(c) for c in ("mean", "low", "high")])


def q53_wilcoxon_p(spark, sf):
    made = statistics.wilcoxon_by(_paired(spark, sf), "method")
    return made.select("method", "n", "w_plus", F.round("p_value", 7).alias("p_value"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from . import catalogue_checks, catalogue_more, catalogue_records

    found = {k: f for part in (globals(), vars(catalogue_more), vars(catalogue_records), vars(catalogue_checks)) for k, f in part.items() if k[:1] == "q" and k[1:3].isdigit()}
    return dict(sorted(found.items()))
