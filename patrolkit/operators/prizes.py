"""Prizes: counts of pings at nodes by period, normalised by the period's largest, and candidate nodes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from patrolkit.functions.scalars import persistence_score
from patrolkit.plans.shared_tables import small, written

from .cluster import dbscan, density_parameters, min_samples_for
from .spatial import k_distances, nearest_node, spaced

RADIUS_M = 600.0


def assigned(points: DataFrame, nodes: DataFrame, radius_m: float = RADIUS_M) -> DataFrame:
    return nearest_node(points, nodes.select("node_id", "lon", "lat"), radius_m)


def counts(found: DataFrame, period: str = "day", weight: str | None = None) -> DataFrame:
    """``(period, node_id, cnt)`` of the assigned rows."""
    amount = F.sum(weight) if weight else F.count("*")
    return found.where("node_id is not null").groupBy(period, "node_id").agg(amount.alias("cnt"))


def dense(counted: DataFrame, periods: DataFrame, nodes: DataFrame, period: str = "day") -> DataFrame:
    """Every period with every node: the grid is the output (periods times nodes), absent counts are 0."""
    grid = nodes.select("node_id").crossJoin(small(periods.select(period).distinct()))  # periods are fewer than nodes
    return grid.join(counted, [period, "node_id"], "left").select(period, "node_id", F.coalesce("cnt", F.lit(0)).cast("long").alias("cnt"))


def prizes(counted: DataFrame, period: str = "day") -> DataFrame:
    """``prize``: the count over the period's largest, 0 where that is 0."""
    top = counted.groupBy(period).agg(F.max("cnt").alias("top"))
    value = F.when(F.col("top") > 0, F.col("cnt") / F.col("top")).otherwise(0.0)
    return counted.join(F.broadcast(top), period).select(period, "node_id", "cnt", value.alias("prize"))


def assignment_summary(found: DataFrame, period: str = "day") -> DataFrame:
    """Points, assigned points and their rate by period."""
    return found.groupBy(period).agg(
        F.count("*").alias("points"), F.count("node_id").alias("assigned"), (F.count("node_id") / F.count("*") * 100).alias("rate_pct"), F.count_distinct("node_id").alias("nodes_hit"),
        F.avg("dist_m").alias("mean_dist_m"),
    )


def visits(found: DataFrame, period: str = "day") -> DataFrame:
    """Different vehicles by period and node."""
    return found.where("node_id is not null").groupBy(period, "node_id").agg(F.count_distinct("plate_num").alias("vehicles"))


def persistent(centres: DataFrame, period: str, limit: int = 250) -> DataFrame:
    """Merged clusters with weighted centres, periods, and the persistence score; the best ``limit`` get node ids from 1."""
    keys = [F.desc(F.round("score", 9)), F.desc("active_periods"), F.desc("sampled_count"), F.asc("merged_label")]
    best = _scored(centres, period).orderBy(*keys).limit(limit)  # a top-k: `limit` rows
    return best.withColumn("node_id", F.row_number().over(Window.orderBy(*keys)))


def _scored(centres: DataFrame, period: str) -> DataFrame:
    w = F.col("sampled_count").cast("double")
    merged = centres.groupBy("merged_label").agg(
        (F.sum(F.col("lon") * w) / F.sum(w)).alias("lon"), (F.sum(F.col("lat") * w) / F.sum(w)).alias("lat"),
        F.sum("sampled_count").alias("sampled_count"), F.count_distinct(period).alias("active_periods"), F.count("*").alias("cluster_count"),
    )
    return merged.withColumn("score", persistence_score(F.col("sampled_count"), F.col("active_periods")))


def candidates(centres: DataFrame, period: str, *, spacing_m: float = 250.0, limit: int = 250, least: int = 200, max_abs_lat: float = 60.0) -> DataFrame:
    """Candidate nodes end to end: the persistence score of merged clusters, greedy spacing by falling score, the best
    ``limit`` of what stays, numbered from 1 in that order. Fewer than ``least`` are an error."""
    scored = _scored(centres, period)
    keys = [F.desc(F.round("score", 9)), F.desc("active_periods"), F.desc("sampled_count"), F.asc("merged_label")]
    order = F.struct((-F.round("score", 9)).alias("s"), (-F.col("active_periods")).alias("p"), (-F.col("sampled_count")).alias("c"), F.col("merged_label").alias("l"))
    kept = spaced(scored.withColumn("node_id", F.col("merged_label")), order, spacing_m, max_abs_lat=max_abs_lat).drop("node_id")
    best = kept.orderBy(*keys).limit(limit)  # a top-k: `limit` rows
    found = best.count()
    if found < least:
        raise ValueError(f"only {found} candidates lie {spacing_m:g} m apart; {least} are needed")
    return best.withColumn("node_id", F.row_number().over(Window.orderBy(*keys)))


def day_counts(points: DataFrame, nodes: DataFrame, period: str, *, near_m: float = 750.0, assign_m: float = 500.0, max_abs_lat: float = 60.0) -> tuple[DataFrame, DataFrame]:
    """``(counts, summary)`` by period: points near fixed nodes are clustered with the period's own parameters, and the
    points of clusters within ``assign_m`` of their node are counted.

    A period without a point near a node is an error. Coordinates are divided by the period's radius, so that one run
    clusters all periods.
    """
    found = nearest_node(points, nodes.select("node_id", "lon", "lat"), near_m, max_abs_lat=max_abs_lat).where("node_id is not null")
    found = written(found, "near_nodes")  # read some ten times below
    empty = points.select(period).distinct().join(found.select(period).distinct(), period, "left_anti").limit(3).collect()
    if empty:
        raise ValueError(f"no point lies near a node in {[str(r[0]) for r in empty]}")
    sizes = found.groupBy(period).agg(min_samples_for(F.count("*").cast("double")).alias("k"))
    keyed = found.join(F.broadcast(sizes), period)
    params = density_parameters(k_distances(keyed, period, "k"), k_distances(keyed, period, 2), found, period).withColumnRenamed("n", "points")
    params = written(params, "parameters")  # a row a period
    scaled = found.join(F.broadcast(params.select(period, "eps", "min_samples")), period).select(period, "min_samples", "event_id", (F.col("lon") / F.col("eps")).alias("lon"), (F.col("lat") / F.col("eps")).alias("lat"))
    labelled = found.join(dbscan(scaled, 1.0, "min_samples", by=[period, "min_samples"]).select("event_id", "label"), "event_id")
    ok = (F.col("label") > 0) & (F.col("dist_m") <= assign_m)
    counted = labelled.where(ok).groupBy(period, "node_id").agg(F.count("*").alias("cnt"))
    noise = F.avg((F.col("label") == 0).cast("double"))
    made = labelled.groupBy(period).agg(
        F.count("*").alias("nearby_points"), F.count_if(F.col("label") > 0).alias("clustered_points"), F.count_if(ok).alias("assigned_points"),
        F.count_distinct(F.when(F.col("label") > 0, F.col("label"))).alias("clusters"), noise.alias("noise_ratio"),
    )
    top = counted.groupBy(period).agg(F.count("*").alias("nonzero_nodes"), F.max("cnt").alias("largest_count"))
    return counted, made.join(params, period).join(top, period, "left")
