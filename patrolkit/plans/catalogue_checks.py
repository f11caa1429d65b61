"""Registered queries that take sources, sinks, scalars, samples, scores and streams through a round trip; with SQL."""

from __future__ import annotations

import uuid

import numpy as np
import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from patrolkit.functions import scalars
from patrolkit.functions.geo import cell
from patrolkit.operators import cluster, evaluation, routing, sampling, statistics, subsets
from patrolkit.sources import pings as P
from patrolkit.sources import sinks, vrp
from patrolkit.streaming import batches
from patrolkit.streaming.changes import ChangingClusters

from . import experiments
from . import oracle as O
from .catalogue import HASHES, _nodes, _pings, _prizes
from .catalogue_more import _planar
from .catalogue_records import RECORDS, _records
from .shared_tables import scratch_path, ship


def _folder(spark, name: str) -> str:
    return scratch_path(spark, f"{name}-{uuid.uuid4().hex}")


def q106_instance_file(spark, sf):
    """The nodes as a sectioned text file with gaps, read back with every number from 1 on."""
    rows = _planar(spark, sf).where("node_id % 7 <> 3").select((F.col("node_id") + 1).alias("n"), F.format_string("%.4f", "x").alias("x"), F.format_string("%.4f", "y").alias("y"))
    coords, needs = (F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "x", "y"))), f), "\n") for f in (lambda r: F.concat_ws(" ", r["n"].cast("string"), r["x"], r["y"]), lambda r: F.concat_ws("\t", r["n"].cast("string"), (r["n"] % 9).cast("string"))))
    text = rows.agg(F.concat(F.lit("NAME : \tnodes\nCAPACITY : \t100\nNODE_COORD_SECTION\n"), coords, F.lit("\nDEMAND_SECTION\n"), needs, F.lit("\nDEPOT_SECTION\n1\n-1\nEOF")).alias("value"))
    path = _folder(spark, "instance")
    text.coalesce(1).write.text(path)
    made = vrp.instance_nodes(spark, path)
    return made.select("node", F.round("x", 4).alias("x"), F.round("y", 4).alias("y"), F.round("demand", 1).alias("demand"))


def q107_solution_file(spark, sf):
    """Routes and their whole cost as solution text, read back."""
    routes = routing.sector_routes(_nodes(spark, sf), 4)
    each = routes.groupBy("vehicle").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "node_id"))), lambda r: r["node_id"]).alias("stops"))
    cost = routing.route_costs(routes).agg(F.round(F.sum("cost")).cast("long").alias("cost"))
    whole = each.agg(F.transform(F.array_sort(F.collect_list(F.struct("vehicle", "stops"))), lambda r: r["stops"]).alias("routes")).crossJoin(cost).withColumn("solution", F.lit(1))
    path = _folder(spark, "solution")
    sinks.route_text(whole).select("value").coalesce(1).write.text(path)
    back = vrp.solutions(spark, path).select("cost", F.posexplode("routes").alias("k", "stops"))
    return back.select((F.col("k") + 1).cast("long").alias("route"), F.array_join(F.col("stops").cast("array<string>"), " ").alias("stops"), "cost")


def q108_csv_round_trip(spark, sf):
    rows = _nodes(spark, sf).select("node_id", "lon", "lat", F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), F.col("node_id").cast("int")), "yyyy/MM/dd").alias("since"))
    path = _folder(spark, "csv")
    sinks.write_csv(rows, path, encoding="utf-8-sig")
    back = sinks.read_csv(spark, path, "node_id long, lon double, lat double, since string", "utf-8-sig", columns=["lon", "since"], dates={"since": "yyyy/MM/dd"}, index="node_id")
    return back.select("node_id", "lon", F.date_format("since", "yyyy-MM-dd").alias("since"))


def q109_json_lines(spark, sf):
    path = _folder(spark, "json")
    sinks.write_metadata(spark.read.parquet(f"{sf}/nation.parquet").select(F.col("n_nationkey").cast("long").alias("key"), F.col("n_name").alias("name")), path)
    return spark.read.text(path)


def q110_remaining_tasks(spark, sf):
    """Records whose task is not in the log of two appended parts."""
    records = _records(spark, sf)
    path = _folder(spark, "log")
    for part in (0, 1):
        sinks.append_results(records.where(F.col("seed") == part).select("instance", "method"), path)
    return sinks.remaining(records.select("instance", "method").distinct(), spark.read.parquet(path), ["instance", "method"])


def q111_numbered_slice(spark, sf):
    path = _folder(spark, "numbered")
    sinks.write_numbered(_pings(spark, sf).select("event_id", F.round("speed", 4).alias("speed")), path, "event_id")
    return sinks.read_slice(spark, path, "event_id", 1200, 700)


def q112_route_sequences(spark, sf):
    """Each order's suppliers as a node sequence, 0 being the depot: split, joined again, flattened, counted, as JSON."""
    lines = spark.read.parquet(f"{sf}/lineitem.parquet").select(F.col("l_orderkey").cast("long").alias("record"), F.struct(F.col("l_linenumber").cast("long").alias("i"), (F.col("l_suppkey").cast("long") % 4).alias("node")).alias("s"))
    rows = lines.groupBy("record").agg(F.transform(F.array_sort(F.collect_list("s")), lambda s: s["node"]).alias("nodes")).withColumn("routes", scalars.split_at_depot(F.col("nodes")))
    text = F.to_json("routes")
    back = F.from_json(text, "array<array<bigint>>")
    joined = F.array_join(scalars.join_at_depot(back).cast("array<string>"), ",")
    return rows.select("record", text.alias("routes"), joined.alias("joined"), F.size(F.flatten("routes")).alias("stops"), scalars.used_vehicles(F.col("routes")).alias("used"))


def q113_seeds_and_shares(spark, sf):
    """A stable seed for each node, its softmax share of its region by weight, and a sigmoid and a tanh of it."""
    w = F.col("weight") / 10_000.0
    rows = _nodes(spark, sf).withColumn("share", scalars.softmax(w, Window.partitionBy("region_key")))
    seed = scalars.stable_seed(42, F.col("node_id").cast("string")).cast("string")
    return rows.select("node_id", seed.alias("seed"), F.round("share", 9).alias("share"), F.round(scalars.sigmoid(w), 9).alias("sigmoid"), F.round(scalars.tanh(w), 9).alias("tanh"), F.round(vrp.decoded_degrees("node_id"), 6).alias("degrees"))


def _gaps(spark, sf):
    return _records(spark, sf).select("method", F.col("n") * 5, F.col("record"), (F.col("record") * 7 % 601).alias("n"), F.round(F.col("objective") / 1000, 6).alias("gap"), F.when(F.col("status") != "P", F.col("objective")).alias("cost"))


def q114_gap_buckets(spark, sf):
    made = experiments.gap_buckets(_gaps(spark, sf).select("n", "gap"))
    return made.select("bucket", "instances", F.round("mean_gap", 5).alias("mean_gap"))


def q115_gap_statistics(spark, sf):
    made = experiments.gap_statistics(_gaps(spark, sf).select("method", "gap", "cost"), "method")
    return made.select("method", *[F.round(c, 4).alias(c) for c in ("mean_gap", "std_gap", "min_gap", "max_gap", "mean_cost")], "solved", "instances")


def q116_final_rows(spark, sf):
    return experiments.final_rows(_records(spark, sf).select("instance", "record", "method", F.round("objective", 2).alias("objective")), "instance", "record")


def _candidates(spark, sf):
    """Settings with their validation: one a (scale, radius), from the records' means."""
    return _records(spark, sf).groupBy(F.col("scale").cast("double").alias("scale"), F.col("optimization_epsilon").alias("epsilon")).agg(
        F.round(F.avg("holdout_coverage_pct") + 15.0, 6).alias("coverage_pct"), F.round(F.avg("holdout_cvar"), 4).alias("cvar_cost"), F.round(F.avg("holdout_cost"), 4).alias("mean_cost"), F.round(F.avg("travel"), 4).alias("travel")
    )


def q117_parameter_choice(spark, sf):
    return experiments.select_parameters(_candidates(spark, sf), 85.5)


def q118_refinement_pairs(spark, sf):
    return experiments.refinement_pairs(_candidates(spark, sf), 85.5)


def q119_best_radius(spark, sf):
    rows = _candidates(spark, sf).groupBy("epsilon").agg(F.round(F.avg("mean_cost"), 4).alias("validation_mean_cost"), F.round(F.avg("cvar_cost"), 4).alias("validation_cvar90"), F.round(F.avg("travel"), 4).alias("travel_cost"))
    return experiments.best_epsilon(rows).unionByName(experiments.best_epsilon(rows, "tail"))


def q120_cell_sample(spark, sf):
    """At most three pings of each cell of 0.002 degrees."""
    rows = _pings(spark, sf).select("event_id", "lon", "lat")
    return sampling.per_cell(rows, [cell(F.col("lon"), 0.002), cell(F.col("lat"), 0.002)], "event_id", 3).select("event_id")


def q121_stride_sample(spark, sf):
    return sampling.every_nth(_pings(spark, sf).select("plate_num", "event_id"), "plate_num", "event_id", 7)


def q122_stratified_nodes(spark, sf):
    values = _nodes(spark, sf).select("node_id", F.round("weight", 4).alias("value"))
    return sampling.stratified_nodes(values, "value", "node_id", 5, 20).select("node_id", "stratum")


def q123_cluster_scores(spark, sf):
    made = evaluation.scatter_scores(_pings(spark, sf).select((F.col("plate_num") % 6 - 1).alias("label"), "lon", "lat"), "label", ["lon", "lat"])
    return made.select(F.round("calinski_harabasz", 6).alias("calinski_harabasz"), F.round("davies_bouldin", 6).alias("davies_bouldin"))


def q124_silhouette(spark, sf):
    """The silhouette of the nodes by region: all pairs of nodes are its definition."""
    rows = _planar(spark, sf).select(F.col("node_id").alias("id"), (F.col("region_key") % 4).alias("l"), "x", "y")
    return evaluation.silhouette(rows, "l", ["x", "y"]).select(F.round("silhouette", 7).alias("silhouette"))


def q125_graph_degrees(spark, sf):
    rows = _nodes(spark, sf).select("region_key", "node_id")
    edges = rows.join(rows.withColumnRenamed("node_id", "dst"), "region_key").where("node_id < dst and (node_id + dst) % 3 > 0").select(F.col("node_id").alias("src"), "dst")
    return evaluation.degrees(edges).select("vertices", F.round("mean_degree", 6).alias("mean_degree"))


def q126_insert_batches(spark, sf):
    """Batches of 700 pings in the order of the draws."""
    return batches.as_batches(_pings(spark, sf).select("event_id"), 700).select("event_id", "batch")


def q127_live_labels(spark, sf):
    """Points live by batch: inserted by id, every tenth deleted two batches later; classes by vehicle."""
    rows = _pings(spark, sf).select("event_id", (F.col("plate_num") % 40).alias("label"), F.floor(F.col("event_id") / 1000).alias("at"))
    changes = rows.select(F.col("at").alias("iter"), F.lit("insert").alias("op"), F.col("event_id").alias("id"))
    changes = changes.unionByName(rows.where("event_id % 10 = 0").select((F.col("at") + 2).alias("iter"), F.lit("delete").alias("op"), F.col("event_id").alias("id")))
    return batches.live_labels(changes, rows.select("event_id", "label"))


def _streamed(spark, steps, made):
    """Labels after a stream has taken the ``steps`` (tables): each is written, and a new object over the same folders takes
    it from a new start of the stream, so state, logs and folds come from the shared folder."""
    folder, labels = scratch_path(spark, f"stream-{uuid.uuid4().hex}"), None
    for step in steps:
        step.write.mode("append").parquet(f"{folder}/in")
        state = made(f"{folder}/state")
        state.attach(batches.read_points(spark, f"{folder}/in", ", ".join(f"{n} {t}" for n, t in step.dtypes), 64), f"{folder}/checkpoint").awaitTermination()
        labels = state.labels()
    return labels.select("event_id", "is_core", "label")


def q137_changing_clusters(spark, sf):
    """Labels of the live pings after a stream of inserts by id and deletes of every tenth, which come with later rows."""
    points = _pings(spark, sf).select("event_id", "lon", "lat")
    changes = points.select(F.lit("insert").alias("op"), "*").unionByName(points.where("event_id % 10 = 0").select(F.lit("delete").alias("op"), "*"))
    later = F.when(F.col("op") == "delete", F.col("event_id") % 2).otherwise(F.col("event_id") % 3 % 2)
    steps = [changes.where(later == k) for k in (0, 1)]
    return _streamed(spark, steps, lambda at: ChangingClusters(spark, at, 0.001, 10, cluster.shifts(HASHES, 0.001)))


def q138_streamed_clusters(spark, sf):
    """Labels of all pings after an insert-only stream with a restart: the rule of q42."""
    points = _pings(spark, sf).select("event_id", "lon", "lat")
    return _streamed(spark, [points.where(F.col("event_id") % 2 == k) for k in (0, 1)], lambda at: batches.IncrementalClusters(spark, at, 0.001, 10, cluster.shifts(HASHES, 0.001)))


def q139_burnt_in_clusters(spark, sf):
    """A stream whose cores are those of the first half of the days; later pings take labels from them."""
    points = _pings(spark, sf).select("event_id", "lon", "lat", "day")
    steps = [points.where(days).drop("day") for days in (F.dayofmonth("day") <= 15, F.dayofmonth("day") > 15)]
    return _streamed(spark, steps, lambda at: batches.IncrementalClusters(spark, at, 0.001, 10, cluster.shifts(HASHES, 0.001), burn_in=1))


#: Neighbours in the angle about the depot that make one small instance, the loss of a node by its mean prize, and the budget.
PART, LOSS, BUDGET = 7, 12_000.0, 20_000.0


def _parts(spark, sf):
    """The regions' nodes in the order of their angle, in parts of at most PART nodes."""
    turned = routing.sector_routes(_nodes(spark, sf), 1, by="region_key")
    return turned.select("region_key", F.floor((F.col("pos") - 1) / PART).alias("part"), "node_id", "x", "y")


def q140_optimal_tours(spark, sf):
    """The shortest closed tour of every part, proven by the subset programme."""
    tours = subsets.subset_tours(_parts(spark, sf), ["region_key", "part"])
    return tours.groupBy("region_key", "part").agg(F.max("n").alias("n"), F.round(F.max_by("cost", "n"), 4).alias("cost"), F.count("*").alias("subsets"))


def q141_optimal_selections(spark, sf):
    """For every part the nodes whose tour under a budget, with the losses of the others, costs least."""
    means = _prizes(spark, sf).groupBy("node_id").agg(F.round(F.avg("prize") * LOSS, 4).alias("loss"))
    best = subsets.best_selections(_parts(spark, sf).join(means, "node_id"), ["region_key", "part"], BUDGET)
    return best.select("region_key", "part", "mask", "n", *[F.round(c, 4).alias(c) for c in ("cost", "missed", "objective")])


def q128_rounded_tours(spark, sf):
    """Closed tours of the regions' nodes by number, every leg rounded half to even."""
    stops = _planar(spark, sf).select("region_key", F.col("node_id").alias("pos"), F.round(F.col("x") * 10).alias("x"), F.round(F.col("y") * 10).alias("y"))
    return vrp.rounded_tour_cost(stops, ["region_key"])


def q129_partitioned_files(spark, sf):
    """The pings as a partitioned raw table, read back, with each day's rows and first hour from the files' footers."""
    text = F.concat(F.lit('{"lon": '), F.format_string("%.6f", "lon"), F.lit(', "lat": '), F.format_string("%.6f", "lat"), F.lit("}"))
    at = F.date_format("published_at", "yyyy-MM-dd HH:mm:ss")
    raw = _pings(spark, sf).select(F.col("plate_num").cast("string").alias("plate_num"), at.alias("published_at"), F.col("speed").cast("string").alias("speed"), text.alias("coord"), F.col("day").alias("publish_date"))
    path = _folder(spark, "raw")
    raw.repartition("publish_date").write.partitionBy("publish_date").parquet(path)
    read = P.parsed(P.raw_pings(spark, path, "*.parquet")).groupBy("publish_date").agg(F.count("lon").alias("read_rows"))
    report = P.file_report(spark, path, "*.parquet").withColumn("publish_date", F.to_date(F.regexp_extract("path", r"publish_date=([\d-]+)", 1)))
    by_day = report.groupBy("publish_date").agg(F.sum("rows").alias("footer_rows"), F.date_format(F.date_trunc("hour", F.to_timestamp(F.min("first"))), "yyyy-MM-dd HH").alias("first_hour"))
    return read.join(by_day, "publish_date").select(F.col("publish_date").cast("string").alias("day"), "read_rows", "footer_rows", "first_hour")


def q130_random_instances(spark, sf):
    """Three mixed instances of 50 customers."""
    made = vrp.random_instances(spark, 3, 50, "mixed", 7)
    return made.select("instance", "node", F.round("x", 8).alias("x"), F.round("y", 8).alias("y"), F.round("demand", 6).alias("demand"))


def q131_two_moons(spark, sf):
    return vrp.two_moons(spark, 1000).select("id", F.round("x", 8).alias("x"), F.round("y", 8).alias("y"), "label")


def q132_blobs(spark, sf):
    return vrp.blobs(spark, 600, 3, 5).select("id", *[F.round(c, 8).alias(c) for c in ("x0", "x1", "x2")], "label")


def q133_block_model(spark, sf):
    return vrp.block_model(spark, 120, 3, 0.3, 0.02)


def q134_fraction_sample(spark, sf):
    return sampling.fraction(_pings(spark, sf).select("event_id", "plate_num"), 0.2, "event_id")


def q135_cheapest_insertions(spark, sf):
    """Nodes left out of a plan and the cheapest place of each in it."""
    placed = routing.sector_routes(_nodes(spark, sf).where("node_id % 7 <> 3"), 4)
    made = statistics.insertion_costs(placed, _planar(spark, sf).where("node_id % 7 = 3").select("node_id", "x", "y"))
    return made.select("node_id", F.round("added", 5).alias("added"), "vehicle", "pos")


def q136_nearest_neighbour_routes(spark, sf):
    """Each region's nodes by repeated nearest neighbour from the depot, one task a region."""
    ship(spark)

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("node_id")
        inst = routing.Instance(part[["x", "y"]].to_numpy(float), np.zeros((1, len(part))), 1, np.inf, 0.0, 0.0)
        ids = part["node_id"].to_numpy()
        turn = routing.nearest_first(inst, list(range(len(part))))
        return pd.DataFrame({"region_key": part["region_key"].to_numpy()[0], "pos": np.arange(1, len(part) + 1), "node_id": ids[turn]})

    return _planar(spark, sf).groupBy("region_key").applyInPandas(run, "region_key long, pos long, node_id long")


def _uniform_sql(key: str, salt: int) -> str:
    x = f"((({key})::BIGINT * 64 + {salt % 64}) * 1103515245 + {12345 + salt}) % 2147483648"
    return f"((((({x}) // 1024) * 1664525 + ({x}) * 69069 + 1013904223) % 2147483648 + 0.5::DOUBLE) / 2147483648::DOUBLE)"


def _normal_sql(key: str, salt: int) -> str:
    return f"(sqrt(-2 * ln({_uniform_sql(key, salt)})) * cos(2 * pi() * {_uniform_sql(key, salt + 1)}))"


_DRAW = "({0} * 1103515245 + 12345) % 2147483648"
CANDIDATES = """,
cand AS (SELECT scale::DOUBLE AS scale, optimization_epsilon AS epsilon, round(avg(holdout_coverage_pct) + 15, 6) AS coverage_pct, round(avg(holdout_cvar), 4) AS cvar_cost, round(avg(holdout_cost), 4) AS mean_cost, round(avg(travel), 4) AS travel FROM rec GROUP BY ALL)"""
GAPS = ", g AS (SELECT method, record * 7 % 601 AS n, round(objective / 1000, 6) AS gap, CASE WHEN status <> 'P' THEN objective END AS cost FROM rec)"

def _near_sql(i: int) -> str:
    return f"least(1, greatest(0, 0.2::DOUBLE + 0.6::DOUBLE * {_uniform_sql('instance * 3 + node % 3 + 63', 10 + i)} + 0.07::DOUBLE * {_normal_sql('place', 2 + 2 * i)}))"


#: Cheapest paths from the depot through every subset of a part's nodes to each last node, and the closed tours.
_TOURS = f"""
turned AS (SELECT *, row_number() OVER (PARTITION BY region_key ORDER BY round(atan2(y, x), 9), node_id) - 1 AS turn FROM xy),
n AS (SELECT region_key, turn // {PART} AS part, node_id, x, y, row_number() OVER (PARTITION BY region_key, turn // {PART} ORDER BY node_id) - 1 AS bit FROM turned),
paths AS (
  SELECT region_key, part, CAST(1 AS BIGINT) << bit AS mask, bit, x, y, sqrt(x * x + y * y) * 100 AS cost FROM n
  UNION ALL
  SELECT p.region_key, p.part, p.mask | (CAST(1 AS BIGINT) << n.bit), n.bit, any_value(n.x), any_value(n.y), min(p.cost + sqrt((p.x - n.x) * (p.x - n.x) + (p.y - n.y) * (p.y - n.y)) * 100)
  FROM paths p JOIN n ON n.region_key = p.region_key AND n.part = p.part AND (p.mask >> n.bit) & 1 = 0
  GROUP BY p.region_key, p.part, p.mask | (CAST(1 AS BIGINT) << n.bit), n.bit),
tours AS (SELECT region_key, part, mask, min(cost + sqrt(x * x + y * y) * 100) AS cost FROM paths GROUP BY ALL)"""

ORACLE = {
    "q130_random_instances": f"""
WITH r AS (SELECT id // 50 AS instance, id % 50 + 1 AS node, id + 7 * 150 AS place FROM (SELECT unnest(range(150)) AS id))
SELECT instance, node, round(CASE WHEN node % 2 = 0 THEN {_near_sql(0)} ELSE {_uniform_sql('place', 0)} END, 8) AS x, round(CASE WHEN node % 2 = 0 THEN {_near_sql(1)} ELSE {_uniform_sql('place', 1)} END, 8) AS y,
  round((1 + floor({_uniform_sql('place', 6)} * 9)) / 40, 6) AS demand FROM r""",
    "q131_two_moons": f"""
WITH r AS (SELECT id, {_uniform_sql('id + 1000', 0)} * pi() AS t FROM (SELECT unnest(range(1000)) AS id))
SELECT id, round(CASE WHEN id % 2 = 0 THEN cos(t) ELSE 1 - cos(t) END + {_normal_sql('id + 1000', 2)} * 0.07::DOUBLE, 8) AS x, round(CASE WHEN id % 2 = 0 THEN sin(t) ELSE 0.5::DOUBLE - sin(t) END + {_normal_sql('id + 1000', 4)} * 0.07::DOUBLE, 8) AS y, CAST(id % 2 AS INTEGER) AS label FROM r""",
    "q132_blobs": "SELECT id, " + ", ".join(f"round(20 * {_uniform_sql('id % 5 + 5', 2 * j)} - 10 + {_normal_sql('id + 600', 2 * j)}, 8) AS x{j}" for j in range(3)) + ", CAST(id % 5 AS INTEGER) AS label FROM (SELECT unnest(range(600)) AS id)",
    "q133_block_model": f"SELECT a AS src, b AS dst FROM (SELECT unnest(range(120)) AS a), (SELECT unnest(range(120)) AS b) WHERE a < b AND {_uniform_sql('a * 120 + b', 1)} < CASE WHEN a % 3 = b % 3 THEN 0.3::DOUBLE ELSE 0.02::DOUBLE END",
    "q134_fraction_sample": f"SELECT event_id, user_id AS plate_num FROM events WHERE {_uniform_sql('event_id', 42)} < 0.2::DOUBLE",
    "q135_cheapest_insertions": O._with(O.NODES, O.XY) + """,
placed AS (SELECT *, ntile(4) OVER w AS vehicle, row_number() OVER w AS turn FROM xy WHERE node_id % 7 <> 3 WINDOW w AS (ORDER BY round(atan2(y, x), 9), node_id)),
stops AS (SELECT *, row_number() OVER (PARTITION BY vehicle ORDER BY turn) AS pos FROM placed),
legs AS (
  SELECT vehicle, pos, coalesce(lag(x) OVER v, 0) AS ax, coalesce(lag(y) OVER v, 0) AS ay, x AS bx, y AS b_y FROM stops WINDOW v AS (PARTITION BY vehicle ORDER BY pos)
  UNION ALL SELECT vehicle, max(pos) + 1, arg_max(x, pos), arg_max(y, pos), 0, 0 FROM stops GROUP BY vehicle),
cost AS (SELECT n.node_id, l.vehicle, l.pos, round((sqrt((ax - x) * (ax - x) + (ay - y) * (ay - y)) + sqrt((x - bx) * (x - bx) + (y - b_y) * (y - b_y)) - sqrt((ax - bx) * (ax - bx) + (ay - b_y) * (ay - b_y))) * 100, 9) AS added FROM xy n, legs l WHERE n.node_id % 7 = 3),
best AS (SELECT node_id, min({'added': added, 'vehicle': vehicle, 'pos': pos}) AS b FROM cost GROUP BY node_id)
SELECT node_id, round(b.added, 5) AS added, b.vehicle AS vehicle, b.pos AS pos FROM best""",
    "q136_nearest_neighbour_routes": O._with(O.NODES, O.XY, """
walk AS (
  SELECT region_key, CAST(0 AS BIGINT) AS pos, CAST(-1 AS BIGINT) AS node_id, 0::DOUBLE AS x, 0::DOUBLE AS y, CAST([] AS BIGINT[]) AS seen FROM xy GROUP BY region_key
  UNION ALL
  SELECT region_key, pos + 1, b.n, b.x, b.y, list_append(seen, b.n) FROM (
    SELECT w.region_key, w.pos, any_value(w.seen) AS seen, min({'d': sqrt((n.x - w.x) * (n.x - w.x) + (n.y - w.y) * (n.y - w.y)) * 100, 'n': n.node_id, 'x': n.x, 'y': n.y}) AS b
    FROM walk w JOIN xy n ON n.region_key = w.region_key AND NOT list_contains(w.seen, n.node_id) GROUP BY w.region_key, w.pos))""", recursive=True) + " SELECT region_key, pos, node_id FROM walk WHERE pos > 0",
    "q106_instance_file": O._with(O.NODES, O.XY) + """,
kept AS (SELECT node_id + 1 AS n, CAST(printf('%.4f', x) AS DOUBLE) AS x, CAST(printf('%.4f', y) AS DOUBLE) AS y FROM xy WHERE node_id % 7 <> 3)
SELECT i AS node, coalesce(round(x, 4), 0) AS x, coalesce(round(y, 4), 0) AS y, CASE WHEN n IS NULL THEN 0 ELSE (n % 9)::DOUBLE END AS demand FROM (SELECT unnest(range(1, (SELECT max(n) FROM kept) + 1)) AS i) LEFT JOIN kept ON n = i""",
    "q107_solution_file": O._with(O.NODES, O.XY, O.ROUTES, O._costs("routes")) + """
SELECT vehicle AS route, string_agg(node_id::VARCHAR, ' ' ORDER BY pos) AS stops, (SELECT round(sum(cost)) FROM costs) AS cost FROM routes GROUP BY vehicle""",
    "q108_csv_round_trip": O._with(O.NODES) + " SELECT node_id, CAST(printf('%.8f', lon) AS DOUBLE) AS lon, strftime(DATE '2024-01-01' + CAST(node_id AS INTEGER), '%Y-%m-%d') AS since FROM nodes",
    "q109_json_lines": "SELECT '{\"key\":' || n_nationkey::VARCHAR || ',\"name\":\"' || n_name || '\"}' AS value FROM nation",
    "q110_remaining_tasks": O._with(RECORDS) + " SELECT DISTINCT instance, method FROM rec WHERE (instance, method) NOT IN (SELECT (instance, method) FROM rec WHERE seed IN (0, 1))",
    "q111_numbered_slice": "SELECT event_id, round(value, 4) AS speed FROM events WHERE event_id BETWEEN 1200 AND 1899",
    "q112_route_sequences": """
WITH s AS (SELECT CAST(l_orderkey AS BIGINT) AS record, string_agg((l_suppkey % 4)::VARCHAR, ',' ORDER BY l_linenumber, l_suppkey % 4) AS t FROM lineitem GROUP BY l_orderkey),
r AS (SELECT record, list_filter([trim(p, ',') FOR p IN string_split(t, '0')], lambda p: p <> '') AS routes FROM s)
SELECT record, '[' || array_to_string(['[' || p || ']' FOR p IN routes], ',') || ']' AS routes, CASE WHEN len(routes) = 0 THEN '0' ELSE '0,' || array_to_string(routes, ',0,') || ',0' END AS joined,
  CAST(coalesce(list_sum([len(string_split(p, ',')) FOR p IN routes]), 0) AS INTEGER) AS stops, CAST(len(routes) AS INTEGER) AS used FROM r""",
    "q113_seeds_and_shares": O._with(O.NODES) + """,
h AS (SELECT *, sha256('42|' || node_id::VARCHAR) AS d, weight / 10000.0::DOUBLE AS w FROM nodes),
e AS (SELECT *, exp(w - max(w) OVER (PARTITION BY region_key)) AS q FROM h)
SELECT node_id, ('0x' || d[15:16] || d[13:14] || d[11:12] || d[9:10] || d[7:8] || d[5:6] || d[3:4] || d[1:2])::UBIGINT::VARCHAR AS seed, round(q / sum(q) OVER (PARTITION BY region_key), 9) AS share, round(1 / (1 + exp(-w)), 9) AS sigmoid, round(tanh(w), 9) AS tanh, round(node_id / 1e5, 6) AS degrees FROM e""",
    "q114_gap_buckets": O._with(RECORDS) + GAPS + """
SELECT CASE WHEN n <= 200 THEN '0-200' WHEN n <= 500 THEN '200-500' ELSE '500+' END AS bucket, count(*) AS instances, round(avg(gap), 5) AS mean_gap FROM g GROUP BY 1 UNION ALL SELECT 'all', count(*), round(avg(gap), 5) FROM g""",
    "q115_gap_statistics": O._with(RECORDS) + GAPS + """
SELECT method, round(avg(gap), 4) AS mean_gap, round(stddev_pop(gap), 4) AS std_gap, round(min(gap), 4) AS min_gap, round(max(gap), 4) AS max_gap, round(avg(cost), 4) AS mean_cost, count(cost) AS solved, count(*) AS instances FROM g GROUP BY method""",
    "q116_final_rows": O._with(RECORDS) + " SELECT instance, max(record) AS record, arg_max(method, record) AS method, round(arg_max(objective, record), 2) AS objective FROM rec GROUP BY instance",
    "q117_parameter_choice": O._with(RECORDS) + CANDIDATES + " SELECT * FROM cand ORDER BY coverage_pct >= 85.5 DESC, CASE WHEN coverage_pct >= 85.5 THEN scale END NULLS FIRST, CASE WHEN coverage_pct < 85.5 THEN -coverage_pct END NULLS FIRST, cvar_cost, mean_cost, travel LIMIT 1",
    "q118_refinement_pairs": O._with(RECORDS) + CANDIDATES + ", f AS (SELECT min(scale) AS s FROM cand WHERE coverage_pct >= 85.5) SELECT cand.* FROM cand, f WHERE scale BETWEEN s / 1.6::DOUBLE AND s * 1.6::DOUBLE ORDER BY cvar_cost, mean_cost, scale, epsilon LIMIT 8",
    "q119_best_radius": O._with(RECORDS) + CANDIDATES + """,
r AS (SELECT epsilon, round(avg(mean_cost), 4) AS validation_mean_cost, round(avg(cvar_cost), 4) AS validation_cvar90, round(avg(travel), 4) AS travel_cost FROM cand GROUP BY epsilon)
(SELECT * FROM r ORDER BY validation_mean_cost, epsilon LIMIT 1) UNION ALL (SELECT * FROM r ORDER BY validation_cvar90, validation_mean_cost, epsilon, travel_cost LIMIT 1)""",
    "q120_cell_sample": O._with(O.PINGS) + f" SELECT event_id FROM (SELECT event_id, row_number() OVER (PARTITION BY floor(lon / 0.002::DOUBLE), floor(lat / 0.002::DOUBLE) ORDER BY {_DRAW.format('event_id')}, event_id) AS r FROM pings) WHERE r <= 3",
    "q121_stride_sample": "SELECT plate_num, event_id FROM (SELECT user_id AS plate_num, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS r FROM events) WHERE (r - 1) % 7 = 0",
    "q122_stratified_nodes": O._with(O.NODES) + f""",
v AS (SELECT node_id, round(weight, 4) AS value FROM nodes), edges AS (SELECT list_distinct(quantile_cont(value, [0.2, 0.4, 0.6, 0.8])) AS es FROM v),
b AS (SELECT node_id, CAST(len(list_filter(es, lambda e: value > e)) AS INTEGER) AS stratum FROM v, edges)
SELECT node_id, stratum FROM (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY {_DRAW.format('node_id')}, node_id) AS r FROM b) WHERE r <= 4""",
    "q123_cluster_scores": O._with(O.PINGS) + """,
p AS (SELECT plate_num % 6 - 1 AS l, lon, lat FROM pings WHERE plate_num % 6 > 0), c AS (SELECT l, count(*) AS n, avg(lon) AS cx, avg(lat) AS cy FROM p GROUP BY l), w AS (SELECT avg(lon) AS gx, avg(lat) AS gy, count(*) AS n FROM p),
s AS (SELECT l, any_value(c.n) AS n, any_value(cx) AS cx, any_value(cy) AS cy, sum((lon - cx) * (lon - cx) + (lat - cy) * (lat - cy)) AS within, avg(sqrt((lon - cx) * (lon - cx) + (lat - cy) * (lat - cy))) AS spread FROM p JOIN c USING (l) GROUP BY l),
ch AS (SELECT (sum(s.n * ((cx - gx) * (cx - gx) + (cy - gy) * (cy - gy))) / (count(*) - 1)) / (sum(within) / (any_value(w.n) - count(*))) AS v FROM s, w),
db AS (SELECT avg(m) AS v FROM (SELECT a.l, max((a.spread + b.spread) / sqrt((a.cx - b.cx) * (a.cx - b.cx) + (a.cy - b.cy) * (a.cy - b.cy))) AS m FROM s a JOIN s b ON a.l <> b.l GROUP BY a.l))
SELECT round(ch.v, 6) AS calinski_harabasz, round(db.v, 6) AS davies_bouldin FROM ch, db""",
    "q124_silhouette": O._with(O.NODES, O.XY) + """,
p AS (SELECT node_id AS id, region_key % 4 AS l, x, y FROM xy),
d AS (SELECT a.id, a.l, b.l AS o, avg(sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y))) AS m FROM p a JOIN p b ON a.id <> b.id GROUP BY a.id, a.l, b.l),
s AS (SELECT id, max(m) FILTER (o = l) AS a, min(m) FILTER (o <> l) AS b FROM d GROUP BY id)
SELECT round(avg(CASE WHEN a IS NULL OR b IS NULL THEN 0 WHEN greatest(a, b) = 0 THEN 0 ELSE (b - a) / greatest(a, b) END), 7) AS silhouette FROM s""",
    "q125_graph_degrees": O._with(O.NODES) + """,
e AS (SELECT a.node_id AS s, b.node_id AS d FROM nodes a JOIN nodes b USING (region_key) WHERE a.node_id < b.node_id AND (a.node_id + b.node_id) % 3 > 0), v AS (SELECT s AS v FROM e UNION ALL SELECT d FROM e)
SELECT count(DISTINCT v) AS vertices, round(count(*)::DOUBLE / nullif(count(DISTINCT v), 0), 6) AS mean_degree FROM v""",
    "q126_insert_batches": f"SELECT event_id, CAST((row_number() OVER (ORDER BY {_DRAW.format('event_id')}, event_id) - 1) // 700 AS BIGINT) AS batch FROM events",
    "q127_live_labels": """
WITH r AS (SELECT event_id, user_id % 40 AS label, event_id // 1000 AS turn FROM events),
c AS (SELECT turn AS iter, label, 1 AS d FROM r UNION ALL SELECT turn + 2, label, -1 FROM r WHERE event_id % 10 = 0),
i AS (SELECT DISTINCT iter FROM c), l AS (SELECT DISTINCT label FROM c), s AS (SELECT iter, label, sum(d) AS d FROM c GROUP BY ALL),
n AS (SELECT i.iter, l.label, sum(coalesce(s.d, 0)) OVER (PARTITION BY l.label ORDER BY i.iter) AS n FROM i CROSS JOIN l LEFT JOIN s ON s.iter = i.iter AND s.label = l.label)
SELECT CAST(iter AS BIGINT) AS iter, CAST(sum(n) AS BIGINT) AS n, count(*) FILTER (n > 0) AS classes FROM n GROUP BY iter""",
    "q137_changing_clusters": "WITH RECURSIVE " + O.PINGS + ", live AS (SELECT * FROM pings WHERE event_id % 10 <> 0)," + O._hashed(True).replace("FROM pings", "FROM live"),
    "q138_streamed_clusters": "WITH RECURSIVE " + O.PINGS + "," + O._hashed(True),
    "q139_burnt_in_clusters": "WITH RECURSIVE " + O.PINGS + ", known AS (SELECT * FROM pings WHERE day(day) <= 15)," + O._hashed(True).replace("FROM pings", "FROM known").split("\nSELECT p.event_id")[0] + """,
early AS (
  SELECT p.event_id, c.event_id IS NOT NULL AS is_core, coalesce(coalesce(w.label, CASE WHEN c.event_id IS NOT NULL THEN p.event_id END) + 1, 0) AS label
  FROM known p LEFT JOIN core c USING (event_id) LEFT JOIN labels w USING (event_id)),
frozen AS (SELECT j, cx, cy, min(label) AS label FROM bucket JOIN early USING (event_id) WHERE is_core GROUP BY ALL),
asked AS (SELECT event_id, j, floor((lon + e) / 0.002::DOUBLE) AS cx, floor((lat + e) / 0.002::DOUBLE) AS cy FROM pings, eta WHERE day(day) > 15),
met AS (SELECT event_id, arg_min(label, j) AS label FROM asked JOIN frozen USING (j, cx, cy) GROUP BY event_id)
SELECT event_id, is_core, CAST(label AS BIGINT) AS label FROM early
UNION ALL SELECT event_id, false, CAST(coalesce(label, 0) AS BIGINT) FROM (SELECT DISTINCT event_id FROM asked) LEFT JOIN met USING (event_id)""",
    "q140_optimal_tours": O._with(O.NODES, O.XY, _TOURS, recursive=True) + """
SELECT region_key, part, max(bit_count(mask)::INTEGER) AS n, round(arg_max(cost, bit_count(mask)), 4) AS cost, count(*) AS subsets FROM tours GROUP BY ALL""",
    "q141_optimal_selections": O._with(O.BASE, O.XY, _TOURS, f"""
losses AS (SELECT node_id, round(avg(prize) * {LOSS}::DOUBLE, 4) AS loss FROM prizes GROUP BY node_id),
every AS (SELECT region_key, part, mask, cost FROM tours WHERE cost <= {BUDGET} UNION ALL SELECT region_key, part, 0, 0 FROM n GROUP BY ALL),
valued AS (
  SELECT region_key, part, mask, any_value(cost) AS cost, coalesce(sum(loss) FILTER ((mask >> bit) & 1 = 0), 0) AS missed
  FROM every JOIN n USING (region_key, part) JOIN losses USING (node_id) GROUP BY region_key, part, mask)""", recursive=True) + """
SELECT region_key, part, CAST(mask AS BIGINT) AS mask, bit_count(mask)::INTEGER AS n, round(cost, 4) AS cost, round(missed, 4) AS missed, round(cost + missed, 4) AS objective
FROM valued QUALIFY row_number() OVER (PARTITION BY region_key, part ORDER BY cost + missed, mask) = 1""",
    "q128_rounded_tours": O._with(O.NODES, O.XY) + """,
p AS (SELECT region_key, node_id AS pos, round(x * 10) AS x, round(y * 10) AS y FROM xy),
n AS (SELECT *, coalesce(lead(x) OVER v, first(x) OVER (PARTITION BY region_key ORDER BY pos)) AS nx, coalesce(lead(y) OVER v, first(y) OVER (PARTITION BY region_key ORDER BY pos)) AS ny FROM p WINDOW v AS (PARTITION BY region_key ORDER BY pos))
SELECT region_key, sum(round_even(sqrt((x - nx) * (x - nx) + (y - ny) * (y - ny)), 0)) AS cost FROM n GROUP BY region_key""",
    "q129_partitioned_files": O._with(O.PINGS) + " SELECT CAST(day AS VARCHAR) AS day, count(*) AS read_rows, count(*) AS footer_rows, strftime(date_trunc('hour', min(published_at)), '%Y-%m-%d %H') AS first_hour FROM pings GROUP BY day",
}
