"""Further registered queries: reports, features, capacitated routes, tuning, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from patrolkit.functions.geo import dihedral, local_km
from patrolkit.functions.scalars import rounded
from patrolkit.operators import capacitated, cluster, features, routing, spatial, statistics, tuning
from patrolkit.sources import pings as P
from patrolkit.streaming import batches

from . import oracle as O
from .catalogue import HASHES, _found, _halves, _nodes, _pings, _prizes, _routes

CAPACITY = 40.0


def _rounded_halves(spark, sf):
    return _halves(spark, sf).select("node_id", F.round("train_mean", 9).alias("train_mean"), F.round("holdout_mean", 9).alias("holdout_mean"))


def q54_top_share_lift(spark, sf):
    made = statistics.top_share(_rounded_halves(spark, sf), "train_mean", "holdout_mean", "node_id")
    return made.select("k", F.round("share", 6).alias("share"), F.round("lift", 6).alias("lift"))


def q55_quintile_calibration(spark, sf):
    binned = statistics.rank_quintiles(_rounded_halves(spark, sf), "train_mean", "node_id")
    return binned.groupBy("quintile").agg(F.count("*").alias("n"), F.round(F.avg("train_mean"), 6).alias("train_mean"), F.round(F.avg("holdout_mean"), 6).alias("holdout_mean"))


def _order_records(spark, sf):
    return spark.read.parquet(f"{sf}/orders.parquet").select(F.col("o_custkey").cast("long").alias("instance"), F.col("o_orderpriority").alias("method"), F.col("o_orderstatus").alias("status"), F.col("o_totalprice").cast("double").alias("objective"))


def q56_certified_gaps(spark, sf):
    """Finished orders stand for proven optima; where an instance has none, 0.9 of its least objective is the bound."""
    records = _order_records(spark, sf)
    refs = records.groupBy("instance").agg(F.min(F.when(F.col("status") == "F", F.col("objective"))).alias("optimum"), (F.min("objective") * 0.9).alias("bound"))
    gaps = statistics.certified_gaps(records, refs, "instance", "objective")
    return gaps.groupBy("method").agg(F.count("gap").alias("n"), F.round(F.avg("gap"), 4).alias("mean_gap"), F.round(F.max("gap"), 4).alias("max_gap"))


def q57_level_ranges(spark, sf):
    rows = spark.read.parquet(f"{sf}/lineitem.parquet").select(F.col("l_linenumber").cast("long").alias("level"), F.col("l_extendedprice").cast("double").alias("price"), F.col("l_quantity").cast("double").alias("quantity"))
    made = statistics.ranges(rows, "level", ["price", "quantity"])
    return made.select("level", *[F.round(c, 2).alias(c) for c in made.columns[1:]])


def q58_complete_groups(spark, sf):
    return statistics.complete_groups(_order_records(spark, sf), "instance", "method", 5)


def _planar(spark, sf):
    x, y = local_km(F.col("lon"), F.col("lat"))
    return _nodes(spark, sf).select("node_id", "region_key", x.alias("x"), y.alias("y"))


def q59_unit_square(spark, sf):
    return features.unit_square(_planar(spark, sf), ["x", "y"]).select("node_id", F.round("x", 8).alias("x"), F.round("y", 8).alias("y"))


def q60_distance_matrix(spark, sf):
    made = spatial.distance_matrix(_planar(spark, sf), ["region_key"])
    return made.select("region_key", "node_id", "other_id", rounded(F.col("distance"), 4).alias("distance"))


def q61_standard_scaling(spark, sf):
    made = features.standard_scaled(_pings(spark, sf).select("event_id", "speed", "lon", "lat"), ["speed", "lon", "lat"])
    return made.select("event_id", *[F.round(c, 6).alias(c) for c in ("speed", "lon", "lat")])


def q62_principal_components(spark, sf):
    made = features.principal_components(spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding"), "embedding", 2)
    return made.select("vec_id", *[F.round(F.col("components")[i], 6).alias(f"c{i}") for i in range(2)])


def q63_frozen_labels(spark, sf):
    """Pings of the second half of the days take labels from the cores of the first half."""
    points, etas = _pings(spark, sf), cluster.shifts(HASHES, 0.001)
    known = points.where(F.dayofmonth("day") <= 15)
    labelled = known.join(cluster.hashed_dbscan(known, 0.001, 10, etas), "event_id")
    return cluster.frozen_labels(points.where(F.dayofmonth("day") > 15), labelled, 0.001, etas)


def q64_dihedral_copies(spark, sf):
    unit = features.unit_square(_planar(spark, sf), ["x", "y"])
    turned = unit.select("node_id", F.explode(dihedral(F.col("x"), F.col("y"))).alias("s"))
    return turned.select("node_id", F.col("s.turn").alias("turn"), F.round("s.x", 8).alias("x"), F.round("s.y", 8).alias("y"))


def q65_windowed_counts(spark, sf):
    """The watermark query over the whole table at once."""
    rows = _found(spark, sf).where("node_id is not null").withColumn("published_at", F.col("published_at").cast("timestamp"))
    return batches.windowed_counts(rows).select(F.date_format("period", "yyyy-MM-dd HH").alias("period"), "node_id", "cnt")


def q66_first_day_split(spark, sf):
    """Each vehicle's first 24 pings against the rest."""
    from pyspark.sql import Window

    turn = F.row_number().over(Window.partitionBy("plate_num").orderBy("event_id"))
    rows = _pings(spark, sf).select("plate_num", "speed", "event_id").withColumn("first", turn <= 24)
    return rows.groupBy("plate_num").agg(F.round(F.avg(F.when(F.col("first"), F.col("speed"))), 5).alias("first_mean"), F.round(F.avg(F.when(~F.col("first"), F.col("speed"))), 5).alias("rest_mean"))


def q67_removal_savings(spark, sf):
    return statistics.removal_savings(_routes(spark, sf)).select("vehicle", "node_id", (F.round("saving", 3) + 0.0).alias("saving"))  # no negative zero


def _stops(spark, sf):
    """One instance a region: the depot (node 0) and its nodes, with demands 1 to 9."""
    planar = _planar(spark, sf)
    at = planar.select(F.col("region_key").alias("instance"), (F.col("node_id") + 1).alias("node"), "x", "y", (1 + F.col("node_id") % 9).cast("double").alias("demand"))
    depots = planar.select(F.col("region_key").alias("instance")).distinct().select("instance", F.lit(0).cast("long").alias("node"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y"), F.lit(0.0).alias("demand"))
    return at.unionByName(depots)


def q68_capacitated_search(spark, sf):
    made = capacitated.search(_stops(spark, sf), CAPACITY)
    return made.select("instance", "n", F.round("start_cost", 3).alias("start_cost"), F.round("cost", 3).alias("cost"), "rounds")


def q69_capacitated_feasibility(spark, sf):
    """A fixed plan a region, checked: nodes in four angular sectors, some left out and some visited twice."""
    stops = _stops(spark, sf)
    placed = routing.sector_routes(_nodes(spark, sf), 4, by="region_key").where("node_id % 7 <> 3").select(F.col("region_key").alias("instance"), "vehicle", F.struct("pos", (F.col("node_id") + 1).alias("node")).alias("stop"), "node_id")
    route = F.transform(F.array_sort(F.collect_list("stop")), lambda s: s["node"])
    twice = F.collect_list(F.when(F.col("node_id") % 11 == 5, F.col("stop.node")))
    plans = placed.groupBy("instance", "vehicle").agg(F.concat(route, twice).alias("route"))
    plans = plans.groupBy("instance").agg(F.to_json(F.collect_list("route")).alias("routes"))
    return capacitated.feasibility(plans, stops, CAPACITY).select("instance", "missed", "repeated", F.round("largest_load", 3).alias("largest_load"), "feasible")


def q70_enhanced_params(spark, sf):
    return tuning.enhanced_parameters(_pings(spark, sf), "day").select(F.col("day").cast("string").alias("day"), "n", "eps", "min_samples", F.round("score", 6).alias("score"))


def q71_spearman_bootstrap(spark, sf):
    panel = _prizes(spark, sf).where(F.dayofmonth("day") > 18).join(_halves(spark, sf).select("node_id", "train_mean"), "node_id")
    made = statistics.spearman_bootstrap(panel.select("day", "node_id", "prize", "train_mean"), "day", "train_mean", reps=200)
    return made.agg(F.count("*").alias("n"), F.round(F.avg("rho"), 6).alias("mean"), F.round(F.expr("percentile(rho, 0.025)"), 6).alias("low"), F.round(F.expr("percentile(rho, 0.975)"), 6).alias("high"))


def q72_json_coordinates(spark, sf):
    """Coordinates by JSON paths instead of patterns."""
    text = F.to_json(F.struct(F.round("lon", 6).alias("lon"), F.round("lat", 6).alias("lat")))
    return P.with_json_coordinates(_pings(spark, sf).select("event_id", text.alias("coord"))).select("event_id", F.round("lon", 6).alias("lon"), F.round("lat", 6).alias("lat"))


UNIT = """
unit AS (
  SELECT node_id, CASE WHEN max(x) OVER () > min(x) OVER () THEN (x - min(x) OVER ()) / (max(x) OVER () - min(x) OVER ()) ELSE 0 END AS x,
    CASE WHEN max(y) OVER () > min(y) OVER () THEN (y - min(y) OVER ()) / (max(y) OVER () - min(y) OVER ()) ELSE 0 END AS y FROM xy)"""
ROUNDED = "r AS (SELECT node_id, round(train_mean, 9) AS t, round(holdout_mean, 9) AS h FROM halves)"
ORDERS = "o AS (SELECT CAST(o_custkey AS BIGINT) AS instance, o_orderpriority AS method, o_orderstatus AS status, CAST(o_totalprice AS DOUBLE) AS objective FROM orders)"
SCALED = ", ".join(f"round(({c} - avg({c}) OVER ()) / stddev_pop({c}) OVER (), 6) AS {c}" for c in ("speed", "lon", "lat"))

ORACLE = {
    "q54_top_share_lift": O._with(O.BASE, O.HALVES, ROUNDED) + """
, k AS (SELECT CAST(ceil(0.2::DOUBLE * count(*) - 1e-9) AS BIGINT) AS k, count(*) AS n, sum(h) AS whole FROM r),
top AS (SELECT sum(h) AS held FROM (SELECT h, row_number() OVER (ORDER BY t DESC, node_id) AS i FROM r), k WHERE i <= k)
SELECT k, round(CASE WHEN whole > 0 THEN held / whole ELSE 1 END, 6) AS share, round(CASE WHEN whole > 0 THEN held / whole ELSE 1 END / (k::DOUBLE / n), 6) AS lift FROM k, top""",
    "q55_quintile_calibration": O._with(O.BASE, O.HALVES, ROUNDED) + """
, ranked AS (SELECT *, row_number() OVER (ORDER BY t, node_id) AS i, count(*) OVER () AS n FROM r),
binned AS (SELECT t, h, 1 + CAST(i > 1 + (n - 1) / 5::DOUBLE AS INT) + CAST(i > 1 + (n - 1) * 2 / 5::DOUBLE AS INT) + CAST(i > 1 + (n - 1) * 3 / 5::DOUBLE AS INT) + CAST(i > 1 + (n - 1) * 4 / 5::DOUBLE AS INT) AS q FROM ranked)
SELECT CAST(q AS INTEGER) AS quintile, count(*) AS n, round(avg(t), 6) AS train_mean, round(avg(h), 6) AS holdout_mean FROM binned GROUP BY q""",
    "q56_certified_gaps": "WITH " + ORDERS + """
, refs AS (SELECT instance, coalesce(min(objective) FILTER (status = 'F'), min(objective) * 0.9::DOUBLE) AS ref FROM o GROUP BY instance),
g AS (SELECT method, CASE WHEN ref <> 0 THEN (objective - ref) / ref * 100 END AS gap FROM o JOIN refs USING (instance))
SELECT method, count(gap) AS n, round(avg(gap), 4) AS mean_gap, round(max(gap), 4) AS max_gap FROM g GROUP BY method""",
    "q57_level_ranges": """
SELECT CAST(l_linenumber AS BIGINT) AS level, round(min(l_extendedprice::DOUBLE), 2) AS price_min, round(max(l_extendedprice::DOUBLE), 2) AS price_max, round(min(l_quantity::DOUBLE), 2) AS quantity_min, round(max(l_quantity::DOUBLE), 2) AS quantity_max FROM lineitem GROUP BY ALL""",
    "q58_complete_groups": "WITH " + ORDERS + " SELECT instance FROM o GROUP BY instance HAVING count(DISTINCT method) = 5",
    "q59_unit_square": O._with(O.NODES, O.XY, UNIT) + " SELECT node_id, round(x, 8) AS x, round(y, 8) AS y FROM unit",
    "q60_distance_matrix": O._with(O.NODES, O.XY) + """
SELECT a.region_key, a.node_id, b.node_id AS other_id, round(sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) * 100, 4) AS distance FROM xy a JOIN xy b USING (region_key)""",
    "q61_standard_scaling": O._with(O.PINGS) + f" SELECT event_id, {SCALED} FROM pings",
    "q64_dihedral_copies": O._with(O.NODES, O.XY, UNIT) + """
SELECT node_id, CAST(t AS INTEGER) AS turn, round(CASE WHEN t >= 4 THEN CASE WHEN t % 4 >= 2 THEN 1 - y ELSE y END ELSE CASE WHEN t % 2 = 1 THEN 1 - x ELSE x END END, 8) AS x,
  round(CASE WHEN t >= 4 THEN CASE WHEN t % 2 = 1 THEN 1 - x ELSE x END ELSE CASE WHEN t % 4 >= 2 THEN 1 - y ELSE y END END, 8) AS y
FROM unit, (SELECT unnest(range(8)) AS t)""",
    "q65_windowed_counts": O._with(O.PINGS, O.NODES, O.FOUND) + " SELECT strftime(date_trunc('hour', published_at), '%Y-%m-%d %H') AS period, node_id, count(*) AS cnt FROM found WHERE node_id IS NOT NULL GROUP BY ALL",
    "q66_first_day_split": """
SELECT user_id AS plate_num, round(avg(value) FILTER (i <= 24), 5) AS first_mean, round(avg(value) FILTER (i > 24), 5) AS rest_mean
FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM events) GROUP BY user_id""",
    "q67_removal_savings": O._with(O.NODES, O.XY, O.ROUTES) + """
, n AS (SELECT *, coalesce(lag(x) OVER v, 0) AS px, coalesce(lag(y) OVER v, 0) AS py, coalesce(lead(x) OVER v, 0) AS nx, coalesce(lead(y) OVER v, 0) AS ny FROM routes WINDOW v AS (PARTITION BY vehicle ORDER BY pos))
SELECT vehicle, node_id, round((sqrt((px - x) * (px - x) + (py - y) * (py - y)) + sqrt((x - nx) * (x - nx) + (y - ny) * (y - ny)) - sqrt((px - nx) * (px - nx) + (py - ny) * (py - ny))) * 100, 3) + 0::DOUBLE AS saving FROM n""",
    "q69_capacitated_feasibility": O._with(O.NODES, O.XY) + f"""
, placed AS (SELECT region_key, node_id, ntile(4) OVER (PARTITION BY region_key ORDER BY round(atan2(y, x), 9), node_id) AS vehicle FROM xy),
planned AS (SELECT * FROM placed WHERE node_id % 7 <> 3),
visits AS (SELECT * FROM planned UNION ALL SELECT * FROM planned WHERE node_id % 11 = 5),
loads AS (SELECT region_key, vehicle, sum(1 + node_id % 9)::DOUBLE AS load FROM visits GROUP BY ALL),
seen AS (SELECT n.region_key, n.node_id, count(v.node_id) AS times FROM nodes n LEFT JOIN visits v USING (region_key, node_id) GROUP BY ALL)
SELECT s.region_key AS instance, count(*) FILTER (times = 0) AS missed, count(*) FILTER (times > 1) AS repeated, round(max(l.load), 3) AS largest_load,
  count(*) FILTER (times <> 1) = 0 AND coalesce(max(l.load), 0) <= {{CAPACITY}} AS feasible
FROM seen s LEFT JOIN (SELECT region_key, max(load) AS load FROM loads GROUP BY region_key) l USING (region_key) GROUP BY s.region_key""".replace("{CAPACITY}", str(CAPACITY)),
    "q72_json_coordinates": O._with(O.PINGS) + " SELECT event_id, round(round(lon, 6), 6) AS lon, round(round(lat, 6), 6) AS lat FROM pings",
}
