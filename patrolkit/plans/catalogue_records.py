"""Registered queries over experiment records: named summaries, paired tables, pools of plans, rolling selection; with SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from patrolkit.operators import cluster, prizes, robust, spatial, statistics, summaries

from . import oracle as O
from .catalogue import CENTRE_EPS, CENTRE_SAMPLES, CROSS_RADII, LEVELS, MAX_LAT, RADIUS_M, SCALE, _exact, _found, _grid, _halves, _merged, _nodes, _paid, _paired, _pings, _realized, _selections, _travel

FOLDS = [("early", 12, 4, 4), ("middle", 15, 4, 4), ("late", 18, 4, 4)]
STRICT = [("strict", 16, 6, 8)]
SEARCH_RADII = [0.05, 0.1, 0.2]
SPACING_M, LEAST_CANDIDATES = 5_000.0, 3


def _records(spark, sf):
    """The driver's orders as experiment records: every column follows from the order's keys and price."""
    price, key = F.col("o_totalprice").cast("double"), F.col("o_orderkey").cast("long")
    n = 40 * (1 + F.col("o_custkey").cast("long") % 3)
    radius = F.element_at(F.array(*[F.lit(v) for v in CROSS_RADII]), (key % 6 + 1).cast("int"))
    scale = 1000 * (1 + key % 5)
    return spark.read.parquet(f"{sf}/orders.parquet").select(
        key.alias("record"), F.col("o_custkey").cast("long").alias("instance"), (key % 3).alias("seed"), n.alias("n"), F.col("o_orderpriority").alias("method"), price.alias("objective"),
        (price * 0.9).alias("nominal_objective"), (price * 0.4).alias("travel"), (price * 0.6).alias("robust_penalty"), (key % 41).alias("visited"), ((key % 41) * 100.0 / n).alias("visit_rate_pct"),
        ((key % 50) / 10.0).alias("runtime"), scale.alias("scale"), (scale / 100.0).alias("equivalent_km_per_full_prize"), radius.alias("optimization_epsilon"), (key % 5).alias("used_vehicles"),
        (50.0 + key % 47).alias("training_coverage_pct"), (50.0 + key % 43).alias("holdout_coverage_pct"), (price * 1.1).alias("holdout_cost"), (price * 1.2).alias("holdout_cvar"), F.col("o_orderstatus").alias("status"),
    )


def _shown(df, keys, digits=4):
    """Doubles but for the keys rounded, as the SQL shows them."""
    return df.select(*[F.round(c, digits).alias(c) if t == "double" and c not in keys else F.col(c) for c, t in df.dtypes])


def q73_heuristic_summary(spark, sf):
    """Instances whose first order is finished have a proven optimum, others a bound, every fifth neither."""
    records = _records(spark, sf)
    least = records.groupBy("instance").agg(F.min("objective").alias("least"), F.min_by("status", "record").alias("status"))
    bound = F.when(F.col("instance") % 5 != 0, F.col("least") * 0.9)
    exact = least.select("instance", (F.col("least") * 0.95).alias("objective"), bound.alias("bound"), F.when(F.col("status") == "F", "integer optimal solution").otherwise("time limit").alias("status"))
    return _shown(summaries.summary(summaries.with_certified_gaps(records, exact), ["n", "method"], summaries.HEURISTIC), ["n", "method"])


def q74_ablation_summary(spark, sf):
    return _shown(summaries.summary(_records(spark, sf), ["n", "method"], summaries.ABLATION), ["n", "method"])


def q75_robustness_summary(spark, sf):
    return _shown(summaries.summary(_records(spark, sf), ["method"], summaries.ROBUSTNESS), ["method"])


def q76_epsilon_grid_summary(spark, sf):
    return _shown(summaries.summary(_records(spark, sf), ["optimization_epsilon"], summaries.EPSILON_GRID), ["optimization_epsilon"])


def q77_route_summary(spark, sf):
    return _shown(summaries.summary(_records(spark, sf), ["optimization_epsilon"], summaries.ROUTES), ["optimization_epsilon"])


def q78_scale_sensitivity(spark, sf):
    return _shown(summaries.summary(_records(spark, sf), ["scale"], summaries.SCALES), ["scale"])


def q79_refinement_summary(spark, sf):
    return _shown(summaries.summary(_records(spark, sf), ["scale", "optimization_epsilon"], summaries.REFINEMENT), ["scale", "optimization_epsilon"])


def q80_algorithm_statistics(spark, sf):
    made = summaries.algorithm_statistics(_records(spark, sf), "method", "record", "objective", {"seed": 1})
    return _shown(made, ["method"], 2)


def q81_paired_differences(spark, sf):
    """Each method against the first one by instance, as if instances were periods."""
    made = summaries.paired_intervals(_paired(spark, sf).select("method", "instance", "diff"), "method", "instance", reps=300)
    return made.select("method", "pairs", F.round("mean_difference", 3).alias("mean_difference"), F.round("ci_low", 2).alias("ci_low"), F.round("ci_high", 2).alias("ci_high"), "below", "ties", "above", F.round("p_value", 7).alias("p_value"))


def _cells(spark, sf):
    """Cross evaluation: a record's objective under every radius grows with the radius and the record."""
    radii = spark.createDataFrame([(float(v),) for v in CROSS_RADII], "evaluation_epsilon double")
    rows = _records(spark, sf).groupBy("instance", "optimization_epsilon").agg(F.min_by("objective", "record").alias("base"))
    value = F.round(F.col("base") * (1 + F.col("evaluation_epsilon")) + 1000.0 * F.abs(F.col("optimization_epsilon") - F.col("evaluation_epsilon")), 6)
    return rows.crossJoin(F.broadcast(radii)).select("instance", "optimization_epsilon", "evaluation_epsilon", value.alias("objective"))


def q82_matched_radius_tests(spark, sf):
    made = summaries.matched_radius_tests(_cells(spark, sf), ["instance"])
    return made.select("evaluation_epsilon", "pairs", F.round("mean_reduction", 3).alias("mean_reduction"), F.round("mean_reduction_pct", 4).alias("mean_reduction_pct"), "wins", "ties", "losses")


def q83_radius_winners(spark, sf):
    return _shown(summaries.column_winners(_cells(spark, sf)), ["evaluation_epsilon", "best_optimization_epsilon"], 3)


def q84_distinct_plans(spark, sf):
    """The first order of each (customer, status, month) signature."""
    rows = spark.read.parquet(f"{sf}/orders.parquet").select(F.col("o_orderkey").cast("long").alias("record"), F.concat_ws("|", F.col("o_custkey").cast("string"), "o_orderstatus", F.date_format("o_orderdate", "yyyy-MM")).alias("signature"))
    return summaries.distinct_plans(rows, "signature", "record")


def q85_best_by_visited(spark, sf):
    """Orders as plans that visit their lines' suppliers modulo 7: the cheapest order of each set of stops, ranked."""
    lines = spark.read.parquet(f"{sf}/lineitem.parquet").select(F.col("l_orderkey").cast("long").alias("record"), (F.col("l_suppkey").cast("long") % 7).alias("stop"))
    plans = lines.groupBy("record").agg(F.collect_list("stop").alias("stops")).join(_records(spark, sf).select("record", "objective"), "record")
    made = summaries.best_by_visited(plans, "stops", "objective", "record")
    return made.select("record", F.array_join(F.array_sort(F.array_distinct("stops")), ",").alias("stops"), F.round("objective", 2).alias("objective"), "rank")


def q86_top_cells(spark, sf):
    """The 50 largest total prices of a (customer, priority) table: a top-k report."""
    cells = _records(spark, sf).groupBy("instance", "method").agg(F.round(F.sum("objective"), 2).alias("value"))
    return summaries.top_cells(cells, "value", 50, ["instance", "method"])


def q87_template_ranking(spark, sf):
    unit = _exact(spark, sf, (0.1,), 1.0).select("selection", F.col("penalty").alias("unit_penalty"))
    levels = spark.createDataFrame([(float(v),) for v in LEVELS], "level double")
    made = summaries.rank_templates(unit.join(_travel(spark, sf), "selection"), levels, "selection")
    return made.select("level", "rank", "selection", F.round("value", 1).alias("value"))


def _day_clusters(spark, sf):
    points = _pings(spark, sf).select("day", "event_id", "lon", "lat")
    return points.join(cluster.dbscan(points, CENTRE_EPS, CENTRE_SAMPLES, by=["day"]).select("event_id", "label"), "event_id")


def _centre_nodes(spark, sf):
    return spatial.nearest_node(cluster.centroids(_day_clusters(spark, sf), ["day"], noise=0), _nodes(spark, sf).select("node_id", "lon", "lat"), RADIUS_M, max_abs_lat=MAX_LAT)


def q88_processing_summary(spark, sf):
    made = summaries.processing_summary(_day_clusters(spark, sf), "day", _pings(spark, sf))
    return made.select(F.col("day").cast("string").alias("day"), "raw_rows", "selected_rows", "clusters", F.round("noise_ratio", 8).alias("noise_ratio"))


def q89_centre_assignment(spark, sf):
    made = summaries.centre_assignment(_centre_nodes(spark, sf), "day")
    return made.select(F.col("day").cast("string").alias("day"), "clusters", "assigned_clusters", F.round("assignment_rate_pct", 6).alias("assignment_rate_pct"), "assigned_points")


def q90_run_metadata(spark, sf):
    centres = _centre_nodes(spark, sf)
    counted = prizes.dense(prizes.counts(centres, "day", "sampled_count"), _pings(spark, sf), _nodes(spark, sf))
    made = summaries.run_metadata(summaries.processing_summary(_day_clusters(spark, sf), "day", _pings(spark, sf)), summaries.centre_assignment(centres, "day"), counted, "day")
    return made.select(F.col("data_start").cast("string").alias("data_start"), F.col("data_end").cast("string").alias("data_end"), "periods", "total_raw_rows", "total_selected_rows", "total_clusters", F.round("mean_assignment_rate_pct", 6).alias("mean_assignment_rate_pct"), "zero_count_periods", "candidate_nodes")


def q91_candidates(spark, sf):
    """Candidate nodes end to end: score, spacing, cap, and an error when too few remain."""
    made = prizes.candidates(_merged(spark, sf), "day", spacing_m=SPACING_M, limit=250, least=LEAST_CANDIDATES, max_abs_lat=MAX_LAT)
    return made.select("node_id", "merged_label", "sampled_count", "active_periods", "cluster_count", F.round("score", 6).alias("score"))


def _rolling(spark, sf, table, **kind):
    numbered = F.col("day").alias("period"), F.dayofmonth("day").alias("number")
    nodes, days = _grid(spark, sf)
    rows = _paid(spark, sf).select(*numbered, "node_id", "prize")
    return summaries.calibrate_refit_test(rows, "number", _selections(spark, sf), _travel(spark, sf), table, SEARCH_RADII, SCALE, grid=(nodes, days.select(*numbered)), **kind)


_TESTED = ("objective", "travel", "mean_cost", "cvar_cost", "worst_cost")


def q92_rolling_selection(spark, sf):
    """Three rolling origins: calibrate the radius, refit on training and validation, test."""
    tested = _rolling(spark, sf, FOLDS)[1]
    return tested.select("fold", "model", "epsilon", "plan", *[F.round(c, 2).alias(c) for c in _TESTED], F.round("coverage_pct", 5).alias("coverage_pct"))


def q93_strict_selection(spark, sf):
    """One strict split without refit: the radius of least validation mean, then the test periods."""
    tested = _rolling(spark, sf, STRICT, refit=False, rule="mean")[1]
    return tested.select("fold", "model", "epsilon", "plan", *[F.round(c, 2).alias(c) for c in _TESTED], F.round("coverage_pct", 5).alias("coverage_pct"))


def q94_calibration_table(spark, sf):
    """What each radius gives in each fold's validation periods."""
    made = _rolling(spark, sf, FOLDS, test=False)[0]
    return made.select("fold", "epsilon", "plan", *[F.round(c, 2).alias(c) for c in _TESTED], F.round("coverage_pct", 5).alias("coverage_pct"))


def q95_pareto_filtered(spark, sf):
    """The frontier of positive costs and of coverages of at least 60 %."""
    rows = _records(spark, sf).select("record", F.round("travel", 2).alias("cost"), F.col("training_coverage_pct").alias("gain"))
    return statistics.pareto(rows, "cost", "gain", "record", positive_cost=True, least_gain=60.0).select("record", "cost", "gain")


def q96_matrix_with_depot(spark, sf):
    """Distances from and to the depot (node -1) beside those between the nodes of a region."""
    from patrolkit.functions.geo import local_km

    x, y = local_km(F.col("lon"), F.col("lat"))
    planar = _nodes(spark, sf).select("node_id", "region_key", x.alias("x"), y.alias("y"))
    made = spatial.distance_matrix(spatial.with_depot(planar, ["region_key"]), ["region_key"])
    return made.where("node_id = -1 or other_id = -1").select("region_key", "node_id", "other_id", F.round("distance", 4).alias("distance"))


def q97_first_positions(spark, sf):
    """One ping for each position: the first by id."""
    return spatial.first_positions(_pings(spark, sf).select("event_id", "plate_num", "lon", "lat"), "event_id").select("event_id", "plate_num", F.round("lon", 7).alias("lon"), F.round("lat", 7).alias("lat"))


def q98_rank_correlation_test(spark, sf):
    rounded = _halves(spark, sf).select("node_id", F.round("train_mean", 9).alias("train_mean"), F.round("holdout_mean", 9).alias("holdout_mean"))
    return summaries.rank_correlation_test(statistics.spearman(rounded, "train_mean", "holdout_mean")).select(F.round("rho", 8).alias("rho"), "n", (F.col("p_value") < 0.05).alias("significant"))


def q99_visited_masks(spark, sf):
    lines = spark.read.parquet(f"{sf}/lineitem.parquet").select(F.col("l_orderkey").cast("long").alias("record"), F.col("l_suppkey").cast("long").alias("node"))
    return summaries.visited_masks(lines, ["record"], "node").select("record", "visited", F.size("masks").alias("words"))


def q100_latex_cells(spark, sf):
    made = statistics.method_summary(_records(spark, sf), ["n", "method"], "objective")
    return summaries.latex_cells(made, "method", "mean_value", "std_value", ["n"], decimals=1)


def _day_counts(spark, sf):
    return prizes.day_counts(_pings(spark, sf).select("day", "event_id", "lon", "lat"), _nodes(spark, sf), "day", max_abs_lat=MAX_LAT)


def q101_day_counts(spark, sf):
    """Points of each day's clusters near fixed nodes, the clusters found with the day's own parameters."""
    return _day_counts(spark, sf)[0].select(F.col("day").cast("string").alias("day"), "node_id", "cnt")


def q102_day_summary(spark, sf):
    made = _day_counts(spark, sf)[1]
    return made.select(F.col("day").cast("string").alias("day"), "nearby_points", "clustered_points", "assigned_points", "clusters", F.round("noise_ratio", 8).alias("noise_ratio"), F.round("eps", 6).alias("eps"), "min_samples", "hashes", "nonzero_nodes", "largest_count")


VALIDATED = (3, 7, 12)


def q103_evaluator_values(spark, sf):
    """The exact penalty of small seeded instances: 4 checks of 3, 7 and 12 nodes over 5 periods, scale 13, radius 0.1."""
    n = F.explode(F.array(*[F.lit(v) for v in VALIDATED]))
    grid = spark.range(4).select(n.alias("n"), F.col("id").alias("check")).withColumn("t", F.explode(F.sequence(F.lit(0), F.lit(4)))).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    turn = ((F.col("n") * 100 + F.col("check")) * 50 + F.col("t")) * 50 + F.col("i")
    x = (turn.cast("long") * 1103515245 + 12345) % 2147483648
    drawn = ((F.floor(x / 1024).cast("long") * 1664525 + x * 69069 + 1013904223) % 2147483648) / 2147483648.0
    name = F.concat_ws("|", F.col("n").cast("string"), F.col("check").cast("string"))
    rows = grid.select(name.alias("selection"), "n", "check", F.col("t").alias("day"), F.col("i").cast("long").alias("node_id"), drawn.alias("prize"))
    out = None
    for count in VALIDATED:
        for check in range(4):
            part = rows.where((F.col("n") == count) & (F.col("check") == check))
            sets = spark.createDataFrame([(f"{count}|{check}", 0.1, [i for i in range(count) if (i + check) % 4 == 0])], "selection string, epsilon double, nodes array<long>")
            one = robust.robust(part, sets, "day", 13.0).select("selection", F.round("penalty", 5).alias("penalty"))
            out = one if out is None else out.unionByName(one)
    return out


def q104_mild_parameters(spark, sf):
    """The slow logarithmic rule for each vehicle's number of pings, and for a thousand times as many."""
    sizes = _pings(spark, sf).groupBy("plate_num").agg(F.count("*").alias("n"))
    rows = sizes.unionByName(sizes.withColumn("n", F.col("n") * 1000).withColumn("plate_num", -F.col("plate_num") - 1))
    eps, k, hashes = cluster.mild_parameters(F.col("n"))
    return rows.select("plate_num", "n", F.round(eps, 3).alias("eps"), k.alias("min_samples"), hashes.alias("hashes"))


def q105_dimension_radius(spark, sf):
    """The dimension-dependent rule on each day's k-distances, as if the points had 2, 20 and 54 dimensions."""
    found = cluster.knee(spatial.k_distances(_pings(spark, sf), "day", 5).select("day", F.round("k_dist", 9).alias("k_dist")), "day", "k_dist")
    rows = found.withColumn("d", F.explode(F.array(F.lit(2.0), F.lit(20.0), F.lit(54.0))))
    return rows.select(F.col("day").cast("string").alias("day"), F.col("d").cast("int").alias("d"), F.round(cluster.dimension_radius(F.col("d"), F.col("raw"), F.col("least"), F.col("most")), 3).alias("eps"))


RECORDS = f"""
rec AS (
  SELECT *, (record % 41) * 100.0::DOUBLE / n AS visit_rate_pct, scale / 100.0::DOUBLE AS equivalent_km_per_full_prize FROM (
    SELECT CAST(o_orderkey AS BIGINT) AS record, CAST(o_custkey AS BIGINT) AS instance, CAST(o_orderkey % 3 AS BIGINT) AS seed, CAST(40 * (1 + o_custkey % 3) AS BIGINT) AS n, o_orderpriority AS method,
      o_totalprice::DOUBLE AS objective, o_totalprice::DOUBLE * 0.9::DOUBLE AS nominal_objective, o_totalprice::DOUBLE * 0.4::DOUBLE AS travel, o_totalprice::DOUBLE * 0.6::DOUBLE AS robust_penalty,
      CAST(o_orderkey % 41 AS BIGINT) AS visited, (o_orderkey % 50) / 10.0::DOUBLE AS runtime, CAST(1000 * (1 + o_orderkey % 5) AS BIGINT) AS scale,
      [{", ".join(f"{v}::DOUBLE" for v in CROSS_RADII)}][CAST(o_orderkey % 6 + 1 AS INT)] AS optimization_epsilon, CAST(o_orderkey % 5 AS BIGINT) AS used_vehicles,
      50.0::DOUBLE + o_orderkey % 47 AS training_coverage_pct, 50.0::DOUBLE + o_orderkey % 43 AS holdout_coverage_pct, o_totalprice::DOUBLE * 1.1::DOUBLE AS holdout_cost,
      o_totalprice::DOUBLE * 1.2::DOUBLE AS holdout_cvar, o_orderstatus AS status FROM orders))"""
_HOW = {"mean": "round(avg({0}), 4)", "std": "round(stddev_samp({0}), 4)", "size": "count({0})", "first": "round(min({0}), 4)"}


def _summary_sql(by: str, columns, source: str = "rec", before: str = "") -> str:
    return O._with(RECORDS) + before + f" SELECT {by}, " + ", ".join(f"{_HOW[how].format(c)} AS {name}" for name, c, how in columns) + f" FROM {source} GROUP BY {by}"


CELLS = f""",
base AS (SELECT instance, optimization_epsilon, arg_min(objective, record) AS base FROM rec GROUP BY ALL),
cells AS (SELECT instance, optimization_epsilon, e AS evaluation_epsilon, round(base * (1 + e) + 1000.0::DOUBLE * abs(optimization_epsilon - e), 6) AS objective
  FROM base, (SELECT unnest([{", ".join(f"{v}::DOUBLE" for v in CROSS_RADII)}]) AS e))"""
#: The upper tail of the normal law: exp(-x^2) times the series of x^(2k+1) / gamma(k + 3/2), summed to convergence.
TAIL = "(1 - sign(z) * exp(-z * z / 2) * list_sum([pow(abs(z) / sqrt(2::DOUBLE), 2 * k + 1) / gamma(k + 1.5::DOUBLE) FOR k IN range(0, 120)])) / 2"
SIGNED = """,
sized AS (SELECT method, diff, abs(diff) AS a FROM paired WHERE diff <> 0),
turned AS (SELECT method, diff, rank() OVER (PARTITION BY method ORDER BY a) + (count(*) OVER (PARTITION BY method, a) - 1) / 2::DOUBLE AS r, count(*) OVER (PARTITION BY method, a) AS t FROM sized),
w AS (SELECT method, sum(CASE WHEN diff > 0 THEN r ELSE 0 END) AS w_plus, count(*)::DOUBLE AS n, sum(t * t - 1)::DOUBLE AS ties FROM turned GROUP BY method),
law AS (SELECT method, n, w_plus, (w_plus - n * (n + 1) / 4) / sqrt(n * (n + 1) * (2 * n + 1) / 24 - ties / 48) AS z FROM w)"""


def _starts(reps: int, seed: int = 7, block: int = 4) -> str:
    """CTE ``index`` (rep, place, i): the resampled places of ``series`` of ``n`` values; the arithmetic draws of the operator."""
    return f"""
draws AS (SELECT who, n, rep, b, (((rep * ceil(n / {block}::DOUBLE)::BIGINT + b + {seed} * 7919) * 1103515245 + 12345) % 2147483648)::BIGINT AS x
  FROM sizes, (SELECT unnest(range({reps})) AS rep), LATERAL (SELECT unnest(range(ceil(n / {block}::DOUBLE)::BIGINT)) AS b)),
started AS (SELECT who, n, rep, b, (((x // 1024) * 1664525 + x * 69069 + 1013904223) % 2147483648) * n // 2147483648 AS s FROM draws),
index AS (SELECT who, n, rep, b * {block} + o AS place, (s + o) % n AS i FROM started, (SELECT unnest(range({block})) AS o) WHERE b * {block} + o < n)"""


def _rolling_sql(table, refit: bool, rule: str) -> str:
    spans = [(f, p, a, b) for f, p, a, b in summaries.folds(table)]
    rows = ", ".join(f"('{f}', '{p}', {a}, {b})" for f, p, a, b in spans)
    ends = "validate" if refit else "train"
    order = "round(cvar_cost, 6), round(mean_cost, 6), epsilon, round(travel, 6)" if rule == "tail" else "round(mean_cost, 6), epsilon"
    radii = ", ".join(f"{e}::DOUBLE" for e in (0.0, *SEARCH_RADII))
    return f"""
span(fold, part, low, high) AS (VALUES {rows}),
phase AS (SELECT fold, 'cal' AS phase, low, high FROM span WHERE part = 'train' UNION ALL SELECT fold, 'fit', 1, high FROM span WHERE part = '{ends}'),
plans AS (
  SELECT 'every 2' AS plan, node_id FROM nodes WHERE node_id % 2 = 0 UNION ALL SELECT 'every 3', node_id FROM nodes WHERE node_id % 3 = 0
  UNION ALL SELECT 'every 5', node_id FROM nodes WHERE node_id % 5 = 0 UNION ALL SELECT 'all', node_id FROM nodes),
plan_names(plan) AS (VALUES ('every 2'), ('every 3'), ('every 5'), ('all'), ('none')),
names AS (SELECT fold || '|' || phase || '|' || plan AS selection, fold, phase, plan, low, high FROM phase, plan_names),
open_ones AS (
  SELECT s.selection, p.day, p.prize, 1 - p.prize AS room FROM names s JOIN prizes p ON day(p.day) BETWEEN s.low AND s.high
  LEFT JOIN plans k ON k.plan = s.plan AND k.node_id = p.node_id WHERE k.node_id IS NULL),
each_day AS (SELECT selection, day, sum(prize) AS missed, count(*) AS m FROM open_ones GROUP BY ALL),
stats AS (SELECT selection, avg(missed) AS mean_missed, max(m) AS m FROM each_day GROUP BY selection),
{O.ROOMS},{O._dual((0.0, *SEARCH_RADII))},
picked AS (SELECT plan AS selection, node_id FROM plans),
{O.TRAVELS.replace("FROM names LEFT JOIN", "FROM (SELECT plan AS selection FROM plan_names) LEFT JOIN")},
days AS (
  SELECT fold, part, plan, p.day, sum(CASE WHEN k.node_id IS NULL THEN prize ELSE 0 END) AS missed, sum(prize) AS total
  FROM span JOIN prizes p ON day(p.day) BETWEEN low AND high CROSS JOIN plan_names LEFT JOIN plans k USING (plan, node_id) WHERE part <> 'train' GROUP BY fold, part, plan, p.day),
costs AS (
  SELECT fold, part, plan, travel, round(travel + {SCALE} * missed, 6) AS cost, CASE WHEN total > 0 THEN 1 - missed / total ELSE 1 END * 100 AS coverage,
    row_number() OVER (PARTITION BY fold, part, plan ORDER BY travel + {SCALE} * missed DESC) AS r, count(*) OVER (PARTITION BY fold, part, plan) AS c
  FROM days JOIN travels ON travels.selection = plan),
valued AS (SELECT fold, part, plan, avg(cost) AS mean_cost, avg(cost) FILTER (r <= ceil(0.1::DOUBLE * c)) AS cvar_cost, max(cost) AS worst_cost, avg(coverage) AS coverage_pct FROM costs GROUP BY ALL),
goals AS (
  SELECT n.fold, n.phase, 'Exact DRO' AS model, d.epsilon, n.plan, t.travel, round(t.travel + {SCALE} * d.value, 6) AS objective FROM dual d JOIN names n USING (selection) JOIN travels t ON t.selection = n.plan
  UNION ALL SELECT n.fold, n.phase, 'RO', e, n.plan, t.travel, round(t.travel + {SCALE} * coalesce(s.m, 0), 6) FROM names n JOIN travels t ON t.selection = n.plan LEFT JOIN stats s ON s.selection = n.selection, (SELECT unnest([{radii}]) AS e)),
best AS (SELECT fold, phase, model, epsilon, min({{'o': objective, 's': plan, 't': travel}}) AS b FROM goals GROUP BY ALL),
calibration AS (
  SELECT b.fold, b.epsilon, b.b.s AS plan, b.b.o AS objective, b.b.t AS travel, v.mean_cost, v.cvar_cost, v.worst_cost, v.coverage_pct
  FROM best b JOIN valued v ON v.fold = b.fold AND v.part = 'validate' AND v.plan = b.b.s WHERE b.phase = 'cal' AND b.model = 'Exact DRO' AND b.epsilon > 0),
radius_of AS (SELECT fold, epsilon FROM (SELECT *, row_number() OVER (PARTITION BY fold ORDER BY {order}) AS r FROM calibration) WHERE r = 1),
wanted AS (
  SELECT fold, 'SP' AS model, 0::DOUBLE AS epsilon, 'Exact DRO' AS kind FROM radius_of UNION ALL SELECT fold, 'RO', epsilon, 'RO' FROM radius_of UNION ALL SELECT fold, 'Exact DRO', epsilon, 'Exact DRO' FROM radius_of),
tested AS (
  SELECT w.fold, w.model, w.epsilon, b.b.s AS plan, b.b.o AS objective, b.b.t AS travel, v.mean_cost, v.cvar_cost, v.worst_cost, v.coverage_pct
  FROM wanted w JOIN best b ON b.fold = w.fold AND b.phase = 'fit' AND b.model = w.kind AND b.epsilon = w.epsilon JOIN valued v ON v.fold = w.fold AND v.part = 'test' AND v.plan = b.b.s)"""


_SHOWN = ", ".join(f"round({c}, 2) AS {c}" for c in _TESTED) + ", round(coverage_pct, 5) AS coverage_pct"
CENTRES = O._with(O.PINGS, O.NODES, O._per_day_clusters(), recursive=True) + f""",
centre_near AS (
  SELECT c.day, c.root, min({{'d': {O._haversine("c.lon", "c.lat", "n.lon", "n.lat")}, 'n': n.node_id}}) AS best FROM centres c JOIN nodes n ON abs(c.lat - n.lat) < 0.01 AND abs(c.lon - n.lon) < 0.02
  WHERE {O._haversine("c.lon", "c.lat", "n.lon", "n.lat")} <= {RADIUS_M} GROUP BY ALL),
placed AS (SELECT c.day, c.sampled_count, b.best.n AS node_id FROM centres c LEFT JOIN centre_near b USING (day, root)),
assigned AS (SELECT day, count(*) AS clusters, count(node_id) AS assigned_clusters, count(node_id)::DOUBLE / count(*) * 100 AS rate, CAST(coalesce(sum(sampled_count) FILTER (node_id IS NOT NULL), 0) AS BIGINT) AS points FROM placed GROUP BY day),
processed AS (
  SELECT p.day, count(*) AS raw_rows, count(*) AS selected_rows, count(DISTINCT l.root) AS clusters, avg(CASE WHEN l.root IS NULL THEN 1 ELSE 0 END) AS noise FROM pings p LEFT JOIN day_label l USING (event_id) GROUP BY p.day)"""

_GAPS = """
gap AS (
  SELECT a.day, a.event_id, sqrt((a.lon - b.lon) * (a.lon - b.lon) + (a.lat - b.lat) * (a.lat - b.lat)) AS d, z.n, z.kappa,
    row_number() OVER (PARTITION BY a.day, a.event_id ORDER BY (a.lon - b.lon) * (a.lon - b.lon) + (a.lat - b.lat) * (a.lat - b.lat)) AS r
  FROM close_ones a JOIN close_ones b USING (day) JOIN size z USING (day))"""
DAYS = O._with(O.PINGS, O.NODES, O.FOUND.replace(f"<= {RADIUS_M}", "<= 750.0"), f"""
close_ones AS (SELECT * FROM found WHERE node_id IS NOT NULL),
size AS (SELECT *, {O.N_SAMPLES} AS kappa, greatest(1, {O.N_HASHES}) AS hashes FROM (SELECT day, count(*)::DOUBLE AS n, (max(lon) - min(lon)) * (max(lat) - min(lat)) AS area FROM close_ones GROUP BY day))""", _GAPS, """
k AS (SELECT day, quantile_cont(d, 0.5) AS q50, quantile_cont(d, 0.6) AS q60, quantile_cont(d, 0.7) AS q70, quantile_cont(d, 0.75) AS q75, min(d) AS lo, max(d) AS hi FROM gap WHERE r = least(kappa, n) GROUP BY day),
base AS (SELECT day, avg(d) * 1.5::DOUBLE AS b FROM gap WHERE r = least(2, n) GROUP BY day),
e AS (
  SELECT *, greatest(0.001::DOUBLE, b * (0.5::DOUBLE - 0.1::DOUBLE * log10(greatest(1, n / greatest(area, 1e-12))))) AS e0,
    least(0.5::DOUBLE, b * (3.0::DOUBLE + 0.2::DOUBLE * CASE WHEN n > 1000 THEN log10(n / 1000) ELSE 0 END)) AS raw1,
    list_sort([CASE WHEN n > 50000 THEN q70 ELSE q60 END, q50 * 1.2::DOUBLE, q75])[2] AS mid
  FROM size JOIN base USING (day) JOIN k USING (day)),
f AS (SELECT *, CASE WHEN raw1 <= e0 THEN e0 * 2 ELSE raw1 END AS e1 FROM e),
params AS (SELECT day, kappa, hashes, round_even(least(e1, greatest(e0, CASE WHEN hi - lo > 1e-6 THEN e0 + (mid - lo) / (hi - lo) * (e1 - e0) * 0.8::DOUBLE ELSE (e0 + e1) / 2 END)), 6) AS eps FROM f),
scaled AS (SELECT c.day, c.event_id, c.node_id, c.dist_m, lon / eps AS x, lat / eps AS y, kappa FROM close_ones c JOIN params USING (day)),
pair AS (SELECT a.event_id AS a, b.event_id AS b, a.kappa FROM scaled a JOIN scaled b USING (day) WHERE (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= 1),
core AS (SELECT a FROM pair GROUP BY a HAVING count(*) >= any_value(kappa)),
walk AS (SELECT a AS node, a AS reach FROM core UNION SELECT w.node, p.b FROM walk w JOIN pair p ON w.reach = p.a AND p.b IN (SELECT a FROM core)),
label AS (SELECT node, min(reach) AS root FROM walk GROUP BY node),
border AS (SELECT p.a AS event_id, min(l.root) AS root FROM pair p JOIN label l ON l.node = p.b GROUP BY p.a),
marked AS (SELECT s.*, coalesce(l.root, b.root) AS root FROM scaled s LEFT JOIN label l ON l.node = s.event_id LEFT JOIN border b ON b.event_id = s.event_id),
hits AS (SELECT day, node_id, count(*) AS cnt FROM marked WHERE root IS NOT NULL AND dist_m <= 500 GROUP BY ALL)""", recursive=True)


def _leading(name: str, source: str) -> str:
    """CTE ``name`` (i, v): the leading eigenvector of a matrix (i, j, c), by squaring it 14 times; its largest entry is positive."""
    return f"""
{name}_p AS (
  SELECT 0 AS turn, i, j, c FROM {source}
  UNION ALL SELECT turn + 1, i, j, c / max(abs(c)) OVER () FROM (SELECT a.turn, a.i, b.j, sum(a.c * b.c) AS c FROM {name}_p a JOIN {name}_p b ON a.j = b.i WHERE a.turn < 14 GROUP BY a.turn, a.i, b.j)),
{name}_j AS (SELECT j, sqrt(sum(c * c)) AS size FROM {name}_p WHERE turn = 14 GROUP BY j ORDER BY size DESC, j LIMIT 1),
{name}_u AS (SELECT i, c / size AS v FROM {name}_p JOIN {name}_j USING (j) WHERE turn = 14),
{name} AS (SELECT i, v * (SELECT sign(arg_max(v, abs(v))) FROM {name}_u) AS v FROM {name}_u)"""


ORACLE = {
    "q62_principal_components": O._with("""
flat AS (SELECT vec_id, unnest(range(1, len(embedding) + 1)) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings),
mean AS (SELECT i, avg(x) AS m FROM flat GROUP BY i), cen AS (SELECT vec_id, i, x - m AS x FROM flat JOIN mean USING (i)),
cov AS (SELECT a.i, b.i AS j, avg(a.x * b.x) AS c FROM cen a JOIN cen b USING (vec_id) GROUP BY a.i, b.i)""", _leading("first", "cov"), """
lam AS (SELECT sum(a.v * c * b.v) AS l FROM cov JOIN first a ON a.i = cov.i JOIN first b ON b.i = cov.j),
cov2 AS (SELECT cov.i, cov.j, c - l * a.v * b.v AS c FROM cov JOIN first a ON a.i = cov.i JOIN first b ON b.i = cov.j, lam)""", _leading("second", "cov2"), recursive=True) + """
SELECT vec_id, round(sum(x * first.v), 6) AS c0, round(sum(x * second.v), 6) AS c1 FROM flat JOIN first USING (i) JOIN second USING (i) GROUP BY vec_id""",
    "q103_evaluator_values": O._with("""
grid AS (SELECT n, c, t, i FROM (SELECT unnest([3, 7, 12]) AS n), (SELECT unnest(range(4)) AS c), (SELECT unnest(range(5)) AS t), LATERAL (SELECT unnest(range(n)) AS i)),
mixed AS (SELECT *, ((((n * 100 + c) * 50 + t) * 50 + i)::BIGINT * 1103515245 + 12345) % 2147483648 AS x FROM grid),
drawn AS (SELECT n, c, t, i, n::VARCHAR || '|' || c::VARCHAR AS selection, (((x // 1024) * 1664525 + x * 69069 + 1013904223) % 2147483648)::DOUBLE / 2147483648::DOUBLE AS prize FROM mixed),
names AS (SELECT DISTINCT selection FROM drawn),
open_ones AS (SELECT selection, t AS day, prize, 1 - prize AS room FROM drawn WHERE (i + c) % 4 <> 0),
each_day AS (SELECT selection, day, sum(prize) AS missed, count(*) AS m FROM open_ones GROUP BY ALL),
stats AS (SELECT selection, avg(missed) AS mean_missed, max(m) AS m FROM each_day GROUP BY selection)""", O.ROOMS, O._dual((0.1,)), recursive=True) + " SELECT selection, round(13 * value, 5) AS penalty FROM dual",
    "q104_mild_parameters": """
WITH sizes AS (SELECT user_id AS plate_num, count(*) AS n FROM events GROUP BY user_id),
every AS (SELECT plate_num, n, ln(n::DOUBLE) - ln(10000::DOUBLE) AS g FROM (SELECT * FROM sizes UNION ALL SELECT -plate_num - 1, n * 1000 FROM sizes))
SELECT plate_num, n, round(round_even(greatest(0.4::DOUBLE, 0.75::DOUBLE / (1 + 0.03::DOUBLE * g)), 4), 3) AS eps, CAST(trunc(least(10 + 0.6::DOUBLE * g, 30)) AS INTEGER) AS min_samples, CAST(trunc(least(10 + g / ln(2::DOUBLE), 20)) AS INTEGER) AS hashes FROM every""",
    "q105_dimension_radius": O._with(O.PINGS, O._kdist(5)) + """,
r AS (SELECT day, round(k_dist, 9) AS v FROM kd),
line AS (SELECT day, v, row_number() OVER w AS i, (coalesce(lead(v) OVER w, v) - coalesce(lag(v) OVER w, v)) / CASE WHEN lag(v) OVER w IS NULL OR lead(v) OVER w IS NULL THEN 1 ELSE 2 END AS g FROM r WINDOW w AS (PARTITION BY day ORDER BY v)),
steep AS (SELECT day, arg_max(v, {'g': round(g, 12), 'v': -v}) AS elbow FROM line GROUP BY day),
q AS (SELECT day, quantile_cont(v, 0.9) AS q, min(v) AS lo, max(v) AS hi FROM r GROUP BY day),
raw AS (SELECT day, lo, hi, CASE WHEN abs(q - elbow) / greatest(q, 1e-6) > 0.5 THEN (q + elbow) / 2 ELSE q END AS raw FROM q JOIN steep USING (day)),
d AS (SELECT *, 1 / (1 + exp(-0.15::DOUBLE * (d - 15))) AS s, (exp((d - 6.5::DOUBLE) / 4) - 1) / (exp((d - 6.5::DOUBLE) / 4) + 1) AS bend FROM raw, (SELECT unnest([2.0::DOUBLE, 20.0::DOUBLE, 54.0::DOUBLE]) AS d)),
e AS (SELECT *, 0.2::DOUBLE + 0.5::DOUBLE * s AS a, 0.3::DOUBLE + 0.45::DOUBLE * s AS b FROM d),
f AS (SELECT *, (CASE WHEN hi - lo < 1e-6 THEN (a + b) / 2 ELSE a + (raw - lo) / (hi - lo) * (b - a) END - a) / (b - a) AS p, 0.4::DOUBLE * abs(bend) AS w FROM e)
SELECT CAST(day AS VARCHAR) AS day, CAST(d AS INTEGER) AS d, round(round_even(0.01::DOUBLE + 0.99::DOUBLE / (1 + exp(-10 * (a + (p * (1 - w) + (0.5::DOUBLE + 0.3::DOUBLE * bend) * w) * (b - a) - 0.5::DOUBLE))), 4), 3) AS eps FROM f""",
    "q101_day_counts": DAYS + " SELECT CAST(day AS VARCHAR) AS day, node_id, cnt FROM hits",
    "q102_day_summary": DAYS + """
SELECT CAST(m.day AS VARCHAR) AS day, count(*) AS nearby_points, count(root) AS clustered_points, count(*) FILTER (root IS NOT NULL AND dist_m <= 500) AS assigned_points, count(DISTINCT root) AS clusters,
  round(avg(CASE WHEN root IS NULL THEN 1 ELSE 0 END), 8) AS noise_ratio, any_value(round(p.eps, 6)) AS eps, any_value(p.kappa) AS min_samples, any_value(p.hashes) AS hashes, any_value(t.n) AS nonzero_nodes, any_value(t.top) AS largest_count
FROM marked m JOIN params p USING (day) LEFT JOIN (SELECT day, count(*) AS n, max(cnt) AS top FROM hits GROUP BY day) t USING (day) GROUP BY m.day""",
    "q52_bootstrap_ci": O._with(O.BASE, O.REALIZED, """
series AS (SELECT 'every 2' AS who, cost, row_number() OVER (ORDER BY day) - 1 AS i FROM realized),
sizes AS (SELECT who, count(*) AS n FROM series GROUP BY who)""", _starts(2000), """
means AS (SELECT who, rep, avg(cost) AS m FROM index JOIN series USING (who, i) GROUP BY ALL)""") + """
SELECT who AS plan, (SELECT round(avg(cost), 3) FROM series) AS mean, round(quantile_cont(m, 0.025), 3) AS low, round(quantile_cont(m, 0.975), 3) AS high FROM means GROUP BY who""",
    "q53_wilcoxon_p": O._with(O.PAIRED) + SIGNED + f" SELECT method, CAST(n AS BIGINT) AS n, w_plus, round({TAIL}, 7) AS p_value FROM law",
    "q71_spearman_bootstrap": O._with(O.BASE, O.HALVES, """
late AS (SELECT dense_rank() OVER (ORDER BY day) - 1 AS i, node_id, prize FROM prizes JOIN halves USING (node_id) WHERE day(day) > 18),
sizes AS (SELECT 'all' AS who, max(i) + 1 AS n FROM late)""", _starts(200), """
means AS (SELECT rep, node_id, round(avg(prize), 9) AS m, any_value(round(train_mean, 9)) AS t FROM index JOIN late USING (i) JOIN halves USING (node_id) GROUP BY ALL),
ranks AS (SELECT rep, rank() OVER (PARTITION BY rep ORDER BY m) + (count(*) OVER (PARTITION BY rep, m) - 1) / 2::DOUBLE AS rm, rank() OVER (PARTITION BY rep ORDER BY t) + (count(*) OVER (PARTITION BY rep, t) - 1) / 2::DOUBLE AS rt FROM means),
rhos AS (SELECT rep, corr(rm, rt) AS rho FROM ranks GROUP BY rep)""") + """
SELECT count(*) AS n, round(avg(rho), 6) AS mean, round(quantile_cont(rho, 0.025), 6) AS low, round(quantile_cont(rho, 0.975), 6) AS high FROM rhos""",
    "q63_frozen_labels": "WITH RECURSIVE " + O.PINGS + """,
known AS (SELECT * FROM pings WHERE day(day) <= 15),""" + O._hashed(False).replace("FROM pings, eta", "FROM known, eta").replace("AS cy FROM pings)", "AS cy FROM known)").split("\nSELECT p.event_id")[0] + """,
frozen AS (SELECT j, cx, cy, min(coalesce(l.label + 1, 0)) AS label FROM bucket JOIN core USING (event_id) LEFT JOIN labels l USING (event_id) GROUP BY ALL),
asked AS (SELECT event_id, j, floor((lon + e) / 0.002::DOUBLE) AS cx, floor((lat + e) / 0.002::DOUBLE) AS cy FROM pings, eta WHERE day(day) > 15),
met AS (SELECT event_id, arg_min(label, j) AS label FROM asked JOIN frozen USING (j, cx, cy) GROUP BY event_id)
SELECT event_id, CAST(coalesce(label, 0) AS BIGINT) AS label FROM (SELECT DISTINCT event_id FROM asked) LEFT JOIN met USING (event_id)""",
    "q73_heuristic_summary": _summary_sql("n, method", summaries.HEURISTIC, "gapped", """,
least AS (SELECT instance, min(objective) AS least, arg_min(status, record) AS status FROM rec GROUP BY instance),
gapped AS (
  SELECT rec.*, CASE WHEN ref <> 0 THEN (objective - ref) / ref * 100 END AS certified_gap_pct
  FROM rec JOIN (SELECT instance, CASE WHEN status = 'F' THEN least * 0.95::DOUBLE WHEN instance % 5 <> 0 THEN least * 0.9::DOUBLE END AS ref FROM least) USING (instance))"""),
    "q74_ablation_summary": _summary_sql("n, method", summaries.ABLATION),
    "q75_robustness_summary": _summary_sql("method", summaries.ROBUSTNESS),
    "q76_epsilon_grid_summary": _summary_sql("optimization_epsilon", summaries.EPSILON_GRID),
    "q77_route_summary": _summary_sql("optimization_epsilon", summaries.ROUTES),
    "q78_scale_sensitivity": _summary_sql("scale", summaries.SCALES),
    "q79_refinement_summary": _summary_sql("scale, optimization_epsilon", summaries.REFINEMENT),
    "q80_algorithm_statistics": O._with(RECORDS) + " SELECT method, round(avg(objective), 2) AS average, round(max(objective), 2) AS largest, round(arg_max(objective, record), 2) AS final FROM rec WHERE seed = 1 GROUP BY method",
    "q81_paired_differences": O._with(O.RECORDS) + ",".join((O.PAIRED.removeprefix(O.RECORDS).replace("SELECT f.method, f.value,", "SELECT f.method, f.instance, f.value,") + SIGNED, """
series AS (SELECT method AS who, diff, row_number() OVER (PARTITION BY method ORDER BY instance) - 1 AS i FROM paired),
sizes AS (SELECT who, count(*) AS n FROM series GROUP BY who)""", _starts(300), """
means AS (SELECT who, rep, avg(diff) AS m FROM index JOIN series USING (who, i) GROUP BY ALL),
ends AS (SELECT who, quantile_cont(m, 0.025) AS low, quantile_cont(m, 0.975) AS high FROM means GROUP BY who),
counts AS (SELECT method, count(*) AS pairs, avg(diff) AS mean_difference, count(*) FILTER (diff < -1e-8) AS below, count(*) FILTER (abs(diff) <= 1e-8) AS ties, count(*) FILTER (diff > 1e-8) AS above FROM paired GROUP BY method)
""")) + f"""SELECT c.method, pairs, round(mean_difference, 3) AS mean_difference, round(low, 2) AS ci_low, round(high, 2) AS ci_high, below, c.ties, above, round(p, 7) AS p_value
FROM counts c JOIN ends ON who = c.method JOIN (SELECT method, least(1, 2 * {TAIL.replace("sign(z)", "1")}) AS p FROM law) l ON l.method = c.method""",
    "q82_matched_radius_tests": O._with(RECORDS) + CELLS + """,
pairs AS (SELECT a.evaluation_epsilon, a.objective AS nominal, a.objective - b.objective AS diff FROM cells a JOIN cells b USING (instance, evaluation_epsilon)
  WHERE a.optimization_epsilon = 0 AND b.optimization_epsilon = evaluation_epsilon AND evaluation_epsilon > 0)
SELECT evaluation_epsilon, count(*) AS pairs, round(avg(diff), 3) AS mean_reduction, round(avg(diff / greatest(nominal, 1e-12)) * 100, 4) AS mean_reduction_pct,
  count(*) FILTER (diff > 1e-8) AS wins, count(*) FILTER (abs(diff) <= 1e-8) AS ties, count(*) FILTER (diff < -1e-8) AS losses FROM pairs GROUP BY evaluation_epsilon""",
    "q83_radius_winners": O._with(RECORDS) + CELLS + """,
means AS (SELECT evaluation_epsilon, optimization_epsilon, avg(objective) AS m FROM cells GROUP BY ALL),
top AS (SELECT evaluation_epsilon, min({'v': round(m, 6), 'e': optimization_epsilon}) AS b, max(m) FILTER (optimization_epsilon = evaluation_epsilon) AS own FROM means GROUP BY evaluation_epsilon)
SELECT evaluation_epsilon, b.e AS best_optimization_epsilon, round(b.v, 3) AS best_mean_objective, round(own, 3) AS matched_mean_objective FROM top""",
    "q84_distinct_plans": """
SELECT min(CAST(o_orderkey AS BIGINT)) AS record, signature FROM (SELECT o_orderkey, o_custkey::VARCHAR || '|' || o_orderstatus || '|' || strftime(o_orderdate, '%Y-%m') AS signature FROM orders) GROUP BY signature""",
    "q85_best_by_visited": O._with(RECORDS) + """,
sets AS (SELECT CAST(l_orderkey AS BIGINT) AS record, array_to_string(list_sort(list_distinct(list(CAST(l_suppkey % 7 AS BIGINT)))), ',') AS stops FROM lineitem GROUP BY l_orderkey),
best AS (SELECT stops, min({'v': objective, 'r': record}) AS b FROM sets JOIN rec USING (record) GROUP BY stops)
SELECT b.r AS record, stops, round(b.v, 2) AS objective, row_number() OVER (ORDER BY b.v, b.r) AS rank FROM best""",
    "q86_top_cells": O._with(RECORDS) + """,
cells AS (SELECT instance, method, round(sum(objective), 2) AS value FROM rec GROUP BY ALL), placed AS (SELECT *, CAST(row_number() OVER (ORDER BY value DESC, instance, method) AS INTEGER) AS rank FROM cells)
SELECT * FROM placed WHERE rank <= 50""",
    "q87_template_ranking": O._with(O.BASE, O.XY, O.SELECTIONS, O.ROOMS, O._dual((0.1,)), O.TRAVELS, recursive=True) + f"""
SELECT level, CAST(row_number() OVER (PARTITION BY level ORDER BY round(travel + level * value, 6), selection) AS INTEGER) AS rank, selection, round(travel + level * value, 1) AS value
FROM dual JOIN travels USING (selection), (SELECT unnest([{", ".join(f"{v}::DOUBLE" for v in LEVELS)}]) AS level)""",
    "q88_processing_summary": CENTRES + " SELECT CAST(day AS VARCHAR) AS day, raw_rows, selected_rows, clusters, round(noise, 8) AS noise_ratio FROM processed",
    "q89_centre_assignment": CENTRES + " SELECT CAST(day AS VARCHAR) AS day, clusters, assigned_clusters, round(rate, 6) AS assignment_rate_pct, points AS assigned_points FROM assigned",
    "q90_run_metadata": CENTRES + """
SELECT CAST(min(day) AS VARCHAR) AS data_start, CAST(max(day) AS VARCHAR) AS data_end, count(*) AS periods, CAST(sum(raw_rows) AS BIGINT) AS total_raw_rows, CAST(sum(selected_rows) AS BIGINT) AS total_selected_rows,
  CAST(sum(clusters) AS BIGINT) AS total_clusters, (SELECT round(avg(rate), 6) FROM assigned) AS mean_assignment_rate_pct,
  (SELECT count(*) FROM (SELECT DISTINCT day FROM pings) WHERE day NOT IN (SELECT day FROM placed WHERE node_id IS NOT NULL)) AS zero_count_periods, (SELECT count(*) FROM nodes) AS candidate_nodes FROM processed""",
    "q91_candidates": O._with(O.PINGS, O._per_day_clusters(), O._dbscan("local", O.MERGE_KM, O.MERGE_SAMPLES), f"""
merged AS (
  SELECT db.label, sum(lon * sampled_count) / sum(sampled_count) AS lon, sum(lat * sampled_count) / sum(sampled_count) AS lat, CAST(sum(sampled_count) AS BIGINT) AS sampled_count, count(DISTINCT day) AS active_periods, count(*) AS cluster_count
  FROM db JOIN spots ON spots.id = db.event_id WHERE db.label > 0 GROUP BY db.label),
scored AS (SELECT *, ln(1 + sampled_count::DOUBLE) * sqrt(active_periods::DOUBLE) AS score FROM merged),
turns AS (SELECT row_number() OVER (ORDER BY round(score, 9) DESC, active_periods DESC, sampled_count DESC, label) AS r, * FROM scored),
pass AS (
  SELECT CAST(0 AS BIGINT) AS r, CAST([] AS STRUCT(lon DOUBLE, lat DOUBLE)[]) AS kept, CAST(NULL AS BIGINT) AS label
  UNION ALL
  SELECT o.r, CASE WHEN len(list_filter(kept, lambda k: {O._haversine("o.lon", "o.lat", "k.lon", "k.lat")} < {SPACING_M})) = 0 THEN list_append(kept, {{'lon': o.lon, 'lat': o.lat}}) ELSE kept END,
    CASE WHEN len(list_filter(kept, lambda k: {O._haversine("o.lon", "o.lat", "k.lon", "k.lat")} < {SPACING_M})) = 0 THEN o.label END
  FROM pass JOIN turns o ON o.r = pass.r + 1)""", recursive=True) + """
SELECT * FROM (SELECT CAST(row_number() OVER (ORDER BY r) AS INTEGER) AS node_id, CAST(label AS BIGINT) AS merged_label, sampled_count, active_periods, cluster_count, round(score, 6) AS score FROM pass JOIN turns USING (r, label)) WHERE node_id <= 250""",
    "q92_rolling_selection": O._with(O.BASE, O.XY, _rolling_sql(FOLDS, True, "tail"), recursive=True) + f" SELECT fold, model, epsilon, plan, {_SHOWN} FROM tested",
    "q93_strict_selection": O._with(O.BASE, O.XY, _rolling_sql(STRICT, False, "mean"), recursive=True) + f" SELECT fold, model, epsilon, plan, {_SHOWN} FROM tested",
    "q94_calibration_table": O._with(O.BASE, O.XY, _rolling_sql(FOLDS, True, "tail"), recursive=True) + f" SELECT fold, epsilon, plan, {_SHOWN} FROM calibration",
    "q95_pareto_filtered": O._with(RECORDS) + """,
one AS (SELECT round(travel, 2) AS cost, max({'g': training_coverage_pct, 't': -record}) AS b FROM rec WHERE round(travel, 2) > 0 AND training_coverage_pct >= 60 GROUP BY 1),
line AS (SELECT cost, b.g AS gain, -b.t AS record, max(b.g) OVER (ORDER BY cost ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best FROM one)
SELECT record, cost, gain FROM line WHERE best IS NULL OR gain > best + 1e-9""",
    "q96_matrix_with_depot": O._with(O.NODES, O.XY) + """
, every AS (SELECT region_key, node_id, x, y FROM xy UNION ALL SELECT DISTINCT region_key, CAST(-1 AS BIGINT), 0::DOUBLE, 0::DOUBLE FROM xy)
SELECT a.region_key, a.node_id, b.node_id AS other_id, round(sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) * 100, 4) AS distance FROM every a JOIN every b USING (region_key) WHERE a.node_id = -1 OR b.node_id = -1""",
    "q97_first_positions": O._with(O.PINGS) + " SELECT min(event_id) AS event_id, arg_min(plate_num, event_id) AS plate_num, round(lon, 7) AS lon, round(lat, 7) AS lat FROM pings GROUP BY pings.lon, pings.lat",
    "q98_rank_correlation_test": O._with(O.BASE, O.HALVES) + """
, r AS (SELECT round(train_mean, 9) AS x, round(holdout_mean, 9) AS y FROM halves),
ranks AS (SELECT rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2::DOUBLE AS rx, rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2::DOUBLE AS ry FROM r),
c AS (SELECT corr(rx, ry) AS rho, count(*) AS n FROM ranks),
law AS (SELECT rho, n, abs(rho) * sqrt((n - 2) / (1 - rho * rho)) AS t, (n - 2)::DOUBLE AS df FROM c)
SELECT round(rho, 8) AS rho, n, 2 * list_sum([exp(lgamma((df + 1) / 2) - lgamma(df / 2)) / sqrt(pi() * df) * pow(1 + pow(t + (k + 0.5::DOUBLE) * 0.001::DOUBLE, 2) / df, -(df + 1) / 2) * 0.001::DOUBLE FOR k IN range(0, 60000)]) < 0.05 AS significant FROM law""",
    "q99_visited_masks": "SELECT CAST(l_orderkey AS BIGINT) AS record, count(DISTINCT l_suppkey) AS visited, CAST(count(DISTINCT l_suppkey // 64) AS INTEGER) AS words FROM lineitem GROUP BY l_orderkey",
    "q100_latex_cells": O._with(RECORDS) + """,
m AS (SELECT n, method, avg(objective) AS v, stddev_samp(objective) AS e FROM rec GROUP BY ALL), t AS (SELECT n, method, v, printf('%.1f \\pm %.1f', v, e) AS s, min(round(v, 1)) OVER (PARTITION BY n) AS best FROM m)
SELECT n, method, CASE WHEN round(v, 1) = best THEN '$\\mathbf{' || s || '}$' ELSE '$' || s || '$' END AS cell FROM t""",
}
