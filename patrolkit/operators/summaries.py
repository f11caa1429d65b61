"""Named summaries of experiment records, paired tables with intervals, plan pools, and rolling selection by validation."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from patrolkit.plans.shared_tables import ship, small, written

from . import robust, statistics

# ---- named aggregates ------------------------------------------------------------------------------------------------

_FUNCTIONS = {"mean": F.avg, "std": F.stddev_samp, "size": F.count, "sum": F.sum, "min": F.min, "max": F.max, "first": F.min}
#: Output columns of the record summaries as (name, column, function): fixed values. "first" is a group's one value.
HEURISTIC = (
    ("objective_mean", "objective", "mean"), ("objective_sd", "objective", "std"), ("gap_mean_pct", "certified_gap_pct", "mean"), ("gap_sd_pct", "certified_gap_pct", "std"),
    ("visit_rate_mean_pct", "visit_rate_pct", "mean"), ("runtime_mean", "runtime", "mean"), ("runs", "objective", "size"),
)
ABLATION = (
    ("objective_mean", "objective", "mean"), ("objective_sd", "objective", "std"), ("travel_mean", "travel", "mean"), ("robust_penalty_mean", "robust_penalty", "mean"),
    ("visit_rate_mean_pct", "visit_rate_pct", "mean"), ("runtime_mean", "runtime", "mean"), ("runs", "objective", "size"),
)
ROBUSTNESS = (
    ("nominal_objective_mean", "nominal_objective", "mean"), ("robust_objective_mean", "objective", "mean"), ("robust_objective_sd", "objective", "std"),
    ("visit_rate_mean_pct", "visit_rate_pct", "mean"), ("runtime_mean", "runtime", "mean"), ("runs", "objective", "size"),
)
EPSILON_GRID = (
    ("nominal_objective_mean", "nominal_objective", "mean"), ("common_robust_objective_mean", "objective", "mean"), ("common_robust_objective_sd", "objective", "std"),
    ("travel_mean", "travel", "mean"), ("visit_rate_mean_pct", "visit_rate_pct", "mean"), ("runtime_mean", "runtime", "mean"), ("runs", "objective", "size"),
)
ROUTES = (("travel_mean", "travel", "mean"), ("visit_rate_mean_pct", "visit_rate_pct", "mean"), ("runtime_mean", "runtime", "mean"))
SCALES = (
    ("equivalent_km_per_full_prize", "equivalent_km_per_full_prize", "first"), ("objective_mean", "objective", "mean"), ("objective_sd", "objective", "std"),
    ("travel_cost_mean", "travel", "mean"), ("robust_penalty_mean", "robust_penalty", "mean"), ("visited_nodes_mean", "visited", "mean"),
    ("visit_rate_mean_pct", "visit_rate_pct", "mean"), ("used_vehicles_mean", "used_vehicles", "mean"), ("training_prize_coverage_mean_pct", "training_coverage_pct", "mean"),
    ("holdout_prize_coverage_mean_pct", "holdout_coverage_pct", "mean"), ("holdout_mean_realized_cost", "holdout_cost", "mean"), ("runtime_mean", "runtime", "mean"),
)
REFINEMENT = (
    ("validation_coverage_pct", "holdout_coverage_pct", "mean"), ("validation_cvar90", "holdout_cvar", "mean"), ("validation_mean_cost", "holdout_cost", "mean"),
    ("travel_cost", "travel", "mean"), ("visited_nodes", "visited", "mean"),
)


def summary(rows: DataFrame, by: list[str], columns: tuple[tuple[str, str, str], ...]) -> DataFrame:
    """One row a group with the named aggregates, in one partial aggregation."""
    return rows.groupBy(*by).agg(*[_FUNCTIONS[how](F.col(column)).alias(name) for name, column, how in columns])


def with_certified_gaps(records: DataFrame, exact: DataFrame) -> DataFrame:
    """``records`` with certified_gap_pct and reference_type, from ``exact`` (instance, objective, bound, status).

    A status that says optimal makes the objective the reference, else the bound is; without either the gap is null.
    """
    proven = F.lower("exact_status").contains("optimal") & F.col("exact_objective").isNotNull()
    refs = exact.select("instance", F.col("objective").alias("exact_objective"), F.col("bound").alias("exact_bound"), F.col("status").alias("exact_status"))
    joined = records.join(refs, "instance", "left")
    kind = F.when(F.coalesce(proven, F.lit(False)), "proven optimum").when(F.col("exact_bound").isNotNull(), "certified lower bound").otherwise("none")
    reference = F.when(proven, F.col("exact_objective")).otherwise(F.col("exact_bound"))
    gap = F.when(reference != 0, (F.col("objective") - reference) / reference * 100.0)
    return joined.withColumns({"certified_gap_pct": gap, "reference_type": kind}).drop("exact_objective", "exact_bound", "exact_status")


def algorithm_statistics(rows: DataFrame, by: str, order: str, value: str, fixed: dict[str, object] | None = None) -> DataFrame:
    """Mean, largest and final value of each algorithm, over the rows whose parameters are as ``fixed``."""
    for name, wanted in (fixed or {}).items():
        rows = rows.where(F.col(name) == F.lit(wanted))
    return rows.groupBy(by).agg(F.avg(value).alias("average"), F.max(value).alias("largest"), F.max_by(value, order).alias("final"))


def run_metadata(processed: DataFrame, assigned: DataFrame, counted: DataFrame, period: str) -> DataFrame:
    """One row for a whole run: its periods, totals of the processing, the mean assignment rate, periods without a count."""
    span = processed.agg(
        F.min(period).alias("data_start"), F.max(period).alias("data_end"), F.count("*").alias("periods"), F.sum("raw_rows").alias("total_raw_rows"),
        F.sum("selected_rows").alias("total_selected_rows"), F.sum("clusters").alias("total_clusters"),
    )
    empty = counted.groupBy(period).agg(F.max("cnt").alias("top")).agg(F.count_if(F.col("top") == 0).alias("zero_count_periods"))
    rate = assigned.agg(F.avg("assignment_rate_pct").alias("mean_assignment_rate_pct"))
    nodes = counted.agg(F.count_distinct("node_id").alias("candidate_nodes"))
    return span.crossJoin(rate).crossJoin(empty).crossJoin(nodes)  # one row each


def processing_summary(labelled: DataFrame, period: str, raw: DataFrame) -> DataFrame:
    """``(period, raw_rows, selected_rows, clusters, noise_ratio)`` of clustered points; label 0 is noise."""
    made = labelled.groupBy(period).agg(
        F.count("*").alias("selected_rows"), F.count_distinct(F.when(F.col("label") > 0, F.col("label"))).alias("clusters"), F.avg((F.col("label") == 0).cast("double")).alias("noise_ratio")
    )
    return raw.groupBy(period).agg(F.count("*").alias("raw_rows")).join(made, period, "left")


def centre_assignment(centres: DataFrame, period: str) -> DataFrame:
    """``(period, clusters, assigned_clusters, assignment_rate_pct, assigned_points)`` of centres with their nearest node."""
    hit = F.col("node_id").isNotNull()
    return centres.groupBy(period).agg(
        F.count("*").alias("clusters"), F.count_if(hit).alias("assigned_clusters"), (F.avg(hit.cast("double")) * 100).alias("assignment_rate_pct"),
        F.coalesce(F.sum(F.when(hit, F.col("sampled_count"))), F.lit(0)).alias("assigned_points"),
    )


# ---- paired tables ---------------------------------------------------------------------------------------------------


def _signs(diff: Column, tolerance: float = 1e-8) -> list[Column]:
    return [F.count_if(diff > tolerance).alias("above"), F.count_if(F.abs(diff) <= tolerance).alias("ties"), F.count_if(diff < -tolerance).alias("below")]


def paired_intervals(pairs: DataFrame, by: str, period: str, *, block: int = 4, reps: int = 10_000, seed: int = 7) -> DataFrame:
    """``(by, pairs, mean_difference, ci_low, ci_high, below, ties, above, p_value)`` of ``diff`` by benchmark.

    The interval comes from circular blocks of periods, the p-value from the two-sided signed-rank test.
    """
    counted = pairs.groupBy(by).agg(F.count("*").alias("pairs"), F.avg("diff").alias("mean_difference"), *_signs(F.col("diff")))
    interval = statistics.bootstrap_interval(pairs, period, "diff", by, block=block, reps=reps, seed=seed).select(by, F.col("low").alias("ci_low"), F.col("high").alias("ci_high"))
    tests = statistics.wilcoxon_by(pairs, by, "two-sided").select(by, "p_value")
    joined = counted.join(interval, by).join(tests, by, "left")
    return joined.select(by, "pairs", "mean_difference", "ci_low", "ci_high", "below", "ties", "above", F.coalesce("p_value", F.lit(1.0)).alias("p_value"))


def matched_radius_tests(cells: DataFrame, key: list[str]) -> DataFrame:
    """For each evaluation radius over 0 the plans of radius 0 against those of the same radius, paired by ``key``.

    ``cells`` holds (key, optimization_epsilon, evaluation_epsilon, objective). Zero differences share their ranks.
    """
    plain = cells.where("optimization_epsilon = 0").select(*key, "evaluation_epsilon", F.col("objective").alias("nominal"))
    matched = cells.where("optimization_epsilon = evaluation_epsilon and evaluation_epsilon > 0").select(*key, "evaluation_epsilon", F.col("objective").alias("matched"))
    pairs = plain.join(matched, [*key, "evaluation_epsilon"]).withColumn("diff", F.col("nominal") - F.col("matched"))
    share = F.col("diff") / F.greatest("nominal", F.lit(1e-12))
    made = pairs.groupBy("evaluation_epsilon").agg(F.count("*").alias("pairs"), F.avg("diff").alias("mean_reduction"), (F.avg(share) * 100).alias("mean_reduction_pct"), *_signs(F.col("diff")))
    tests = statistics.wilcoxon_by(pairs, "evaluation_epsilon", "greater", "zsplit").select("evaluation_epsilon", "p_value")
    joined = made.join(tests, "evaluation_epsilon", "left")
    return joined.select("evaluation_epsilon", "pairs", "mean_reduction", "mean_reduction_pct", F.col("above").alias("wins"), "ties", F.col("below").alias("losses"), F.coalesce("p_value", F.lit(1.0)).alias("p_value"))


def column_winners(cells: DataFrame) -> DataFrame:
    """For each evaluation radius the radius of least mean objective, that mean, and the mean of the matched radius."""
    means = cells.groupBy("evaluation_epsilon", "optimization_epsilon").agg(F.avg("objective").alias("mean_objective"))
    best = means.groupBy("evaluation_epsilon").agg(
        F.min(F.struct(F.round("mean_objective", 6).alias("value"), F.col("optimization_epsilon").alias("epsilon"))).alias("best"),
        F.max(F.when(F.col("optimization_epsilon") == F.col("evaluation_epsilon"), F.col("mean_objective"))).alias("matched_mean_objective"),
    )
    return best.select("evaluation_epsilon", F.col("best.epsilon").alias("best_optimization_epsilon"), F.col("best.value").alias("best_mean_objective"), "matched_mean_objective")


# ---- pools of plans --------------------------------------------------------------------------------------------------


def distinct_plans(plans: DataFrame, signature: str, order: str) -> DataFrame:
    """The first row of each signature, by ``order``: an ordered distinct union."""
    rest = F.struct(F.col(order), F.struct(*[F.col(c) for c in plans.columns]).alias("row"))
    return plans.groupBy(F.col(signature).alias("signature__")).agg(F.min(rest).alias("first")).select("first.row.*")


def best_by_visited(plans: DataFrame, nodes: str, value: str, tie: str) -> DataFrame:
    """Of plans that visit the same set of nodes the one of least ``value`` (then ``tie``), ranked by value from 1.

    ``nodes`` is an array of node ids in any order. Ranks come from counts of values, so no window holds all plans.
    """
    key = F.to_json(F.array_sort(F.array_distinct(nodes)))
    best = distinct_plans(plans.withColumn("order__", F.struct(value, tie)).withColumn("visited__", key), "visited__", "order__").drop("order__", "visited__")
    per = best.groupBy(F.col(value).alias("value__")).agg(F.count("*").alias("count__"))
    before = statistics.counts_before(per, [], "value__", "count__", "before__").drop("count__")
    inside = F.row_number().over(Window.partitionBy(value).orderBy(tie))
    return best.join(before, best[value] == F.col("value__")).withColumn("rank", (F.col("before__") + inside).cast("long")).drop("value__", "before__")


def top_cells(rows: DataFrame, value: str, k: int, keys: list[str]) -> DataFrame:
    """The ``k`` largest cells of a (row, column, value) table with their rank from 1, ties by the keys: a top-k report."""
    best = rows.orderBy(F.desc(value), *keys).limit(k)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc(value), *keys)))


def rank_templates(templates: DataFrame, levels: DataFrame, tie: str) -> DataFrame:
    """``(level, rank, ...)``: warm starts by travel + level * unit penalty, for each level of the penalty scale.

    The templates of one case study: one level is ranked in one task.
    """
    every = templates.crossJoin(F.broadcast(levels)).withColumn("value", F.col("travel") + F.col("level") * F.col("unit_penalty"))
    return every.withColumn("rank", F.row_number().over(Window.partitionBy("level").orderBy(F.round("value", 6), tie)))


# ---- calibrate, refit, test ------------------------------------------------------------------------------------------


def folds(table: list[tuple[str, int, int, int]]) -> list[tuple[str, str, int, int]]:
    """``(fold, part, first, last)`` of rolling origins given as (name, train, validate, test) numbers of periods."""
    out = []
    for name, *sizes in table:
        at = 0
        for part, size in zip(("train", "validate", "test"), sizes, strict=True):
            out.append((name, part, at + 1, at + size))
            at += size
    return out


def _chosen(prizes: DataFrame, index: str, sets: DataFrame, rooms: DataFrame, travel: DataFrame, cases: list[tuple[str, str, float, int, int]], scale: float) -> DataFrame:
    """``(case, model, epsilon, plan, objective, travel, penalty)``: for each case the plan of least objective.

    A case is (name, model, epsilon, first, last) and looks at the periods whose number lies in first..last. Models: SP
    (radius 0), RO (the box penalty, of all unvisited nodes) and Exact DRO. ``sets`` holds (selection, nodes), ``rooms``
    what :func:`robust.rooms_of` gives for them.
    """
    spark = prizes.sparkSession
    table = spark.createDataFrame(cases, "case string, model string, epsilon double, first int, last int")
    value = robust.robust_over_spans(prizes, index, sets.crossJoin(F.broadcast(table)), scale, rooms=rooms)
    cost = value.join(F.broadcast(travel), "selection").withColumn("objective", F.col("travel") + F.col("penalty"))
    best = cost.groupBy("case", "model", "epsilon").agg(F.min(F.struct(F.round("objective", 6).alias("objective"), "selection", "travel", "penalty")).alias("b"))
    return best.select("case", "model", "epsilon", F.col("b.selection").alias("plan"), F.col("b.objective").alias("objective"), F.col("b.travel").alias("travel"), F.col("b.penalty").alias("penalty"))


def evaluated(chosen: DataFrame, prizes: DataFrame, spans: list[tuple[str, int, int]], index: str, pool: DataFrame, scale: float, periods: DataFrame | None = None) -> DataFrame:
    """``chosen`` with mean_cost, cvar_cost, worst_cost and coverage_pct over the periods of each case's span.

    A span is (case, first, last) and holds the periods of ``prizes`` (period, node_id, prize, number ``index``) between. A
    plan meets a period's nodes once, however many cases value it there. With ``periods`` (period, number), ``prizes`` may
    leave out prizes of 0.
    """
    chosen = written(chosen, "chosen")  # a row a case
    table = prizes.sparkSession.createDataFrame(spans, "case string, first int, last int")
    asked = chosen.select("case", "plan", "travel").join(F.broadcast(table.where("first <= last")), "case").withColumn("at", F.explode(F.sequence("first", "last"))).drop("first", "last")
    wanted = small(asked.select("plan", "at").distinct())
    marks = pool.withColumnRenamed("selection", "plan").where("node_id is not null").join(F.broadcast(chosen.select("plan").distinct()), "plan", "left_semi")
    rows = prizes.join(wanted, F.col(index) == F.col("at")).join(small(marks.select("plan", "node_id", F.lit(True).alias("seen"))), ["plan", "node_id"], "left")
    open_ = F.col("seen").isNull()
    sums = rows.groupBy("plan", "at", "period").agg(F.sum(F.when(open_, F.col("prize")).otherwise(0.0)).alias("missed"), F.sum("prize").alias("total"))
    if periods is not None:
        every = periods.select("period", F.col(index).alias("at")).dropna().join(wanted, "at")
        sums = every.join(sums, ["plan", "at", "period"], "left").fillna(0.0, ["missed", "total"])
    per = asked.join(sums, ["plan", "at"])
    cost = per.withColumns({"cost": F.round(F.col("travel") + F.lit(scale) * F.col("missed"), 6), "coverage": F.when(F.col("total") > 0, 1 - F.col("missed") / F.col("total")).otherwise(1.0) * 100})
    tail = statistics.tail_summary(cost, "cost", ["case"]).select("case", F.col("mean_value").alias("mean_cost"), F.col("cvar_value").alias("cvar_cost"), F.col("worst_value").alias("worst_cost"))
    share = cost.groupBy("case").agg(F.avg("coverage").alias("coverage_pct"))
    return chosen.join(tail, "case").join(share, "case")


def calibrate_refit_test(prizes: DataFrame, index: str, pool: DataFrame, travel: DataFrame, table: list[tuple[str, int, int, int]], radii: list[float], scale: float, *, refit: bool = True, rule: str = "tail", test: bool = True, grid: tuple[DataFrame, DataFrame] | None = None) -> tuple[DataFrame, DataFrame | None]:
    """``(calibration, test)`` over the rolling origins of ``table``; plans are chosen from a pool.

    For each fold and radius the plan of least training objective is valued over the validation periods. The fold's radius
    is that of least tail, mean, radius and travel (``rule`` "tail"), or of least mean, then radius ("mean"). SP, RO and
    Exact DRO then choose anew over training and validation (``refit``) or stay with training, and are valued over the
    test periods, which nothing before has seen; without ``test`` that is left out. ``prizes`` holds (period, node_id,
    prize) and the period's number; with ``grid``, the nodes and the periods with their number, it may leave out prizes of 0.
    """
    span = {(f, p): (a, b) for f, p, a, b in folds(table)}
    names = [t[0] for t in table]
    prizes = written(prizes.select("period", "node_id", "prize", F.col(index).alias("number")), "fold_prizes")
    nodes, periods = grid or (None, None)
    periods = periods.select("period", F.col(index).alias("number")).dropna().distinct() if grid else None
    travel = written(travel, "fold_travel")
    sets = pool.groupBy("selection").agg(F.collect_list("node_id").alias("nodes"))
    rooms = robust.rooms_of(prizes, sets, "number", (nodes, periods) if grid else None)  # of both choices
    grid = [(f"{f}|{e}", "Exact DRO", float(e), *span[f, "train"]) for f in names for e in radii]
    validate = [(f"{f}|{e}", *span[f, "validate"]) for f in names for e in radii]
    calibration = evaluated(_chosen(prizes, "number", sets, rooms, travel, grid, scale), prizes, validate, "number", pool, scale, periods).withColumn("fold", F.split("case", r"\|")[0])
    if not test:
        return calibration.drop("case", "model"), None
    calibration = written(calibration, "calibration")
    order = ["cvar_cost", "mean_cost", "epsilon", "travel"] if rule == "tail" else ["mean_cost", "epsilon"]
    rounded = [F.round(c, 6).alias(c) for c in order]
    picked = {r["fold"]: r["best"]["epsilon"] for r in calibration.groupBy("fold").agg(F.min(F.struct(*rounded)).alias("best")).collect()}  # a row a fold
    models = [(f, m) for f in names for m in ("SP", "RO", "Exact DRO")]
    refits = [(f"{f}|{m}", m, 0.0 if m == "SP" else float(picked[f]), 1, span[f, "validate" if refit else "train"][1]) for f, m in models]
    held = [(f"{f}|{m}", *span[f, "test"]) for f, m in models]
    tested = evaluated(_chosen(prizes, "number", sets, rooms, travel, refits, scale), prizes, held, "number", pool, scale, periods).withColumn("fold", F.split("case", r"\|")[0])
    return calibration.drop("case", "model"), tested.drop("case")


# ---- text tables -----------------------------------------------------------------------------------------------------


def latex_cells(rows: DataFrame, by: str, value: str, error: str, group: list[str], *, decimals: int = 2, smaller_is_better: bool = True) -> DataFrame:
    """``(group, by, cell)``: value ± error as LaTeX, the best of each group in bold."""
    best = rows.groupBy(*group).agg((F.min if smaller_is_better else F.max)(F.round(value, decimals)).alias("best"))
    text = F.format_string(f"%.{decimals}f \\pm %.{decimals}f", F.col(value), F.col(error))
    marked = F.when(F.round(value, decimals) == F.col("best"), F.concat(F.lit("$\\mathbf{"), text, F.lit("}$"))).otherwise(F.concat(F.lit("$"), text, F.lit("$")))
    return rows.join(best, group).select(*group, by, marked.alias("cell"))


def visited_masks(visits: DataFrame, by: list[str], node: str) -> DataFrame:
    """``(by, masks, visited)``: the set of visited nodes as 64-bit masks by word, and its size as the sum of their bits."""
    words = visits.groupBy(*by, F.floor(F.col(node) / 64).alias("word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), (F.col(node) % 64).cast("int"))).alias("bits"))
    return words.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("word", "bits"))).alias("masks"), F.sum(F.bit_count("bits")).cast("long").alias("visited"))


def rank_correlation_test(rho: DataFrame) -> DataFrame:
    """``(rho, n)`` with the two-sided p-value of Student's law."""
    ship(rho.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            yield part.assign(p_value=[statistics.correlation_p(float(r), int(n)) if not math.isnan(r) else float("nan") for r, n in zip(part["rho"], part["n"], strict=True)])

    return rho.select("rho", "n").mapInPandas(run, "rho double, n long, p_value double")
