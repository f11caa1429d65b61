"""Proven optima of small instances: the subset dynamic programme over tables, a layer of subsets at a time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from patrolkit.functions.geo import COST_PER_KM
from patrolkit.plans.shared_tables import scratch, small, written

#: Nodes of an instance at most: it has n * 2^(n - 1) states, all of them rows.
MAX_NODES = 12


def _leg(x: Column, y: Column, x2: Column, y2: Column) -> Column:
    return F.sqrt((x - x2) * (x - x2) + (y - y2) * (y - y2)) * F.lit(float(COST_PER_KM))


def numbered(nodes: DataFrame, by: list[str]) -> DataFrame:
    """``nodes`` with ``bit``: 0, 1, ... by node_id in each instance. Instances over MAX_NODES are an error."""
    made = nodes.select(*by, "node_id", "x", "y", (F.row_number().over(Window.partitionBy(*by).orderBy("node_id")) - 1).alias("bit"))
    return made.withColumn("bit", F.when(F.col("bit") < MAX_NODES, F.col("bit")).otherwise(F.raise_error(F.lit(f"an instance has over {MAX_NODES} nodes"))))


def subset_tours(nodes: DataFrame, by: list[str]) -> DataFrame:
    """``(by, mask, n, cost)``: the shortest closed tour from the depot at (0, 0) through every non-empty subset of each
    instance's ``nodes`` (by, node_id, x, y); bit i of ``mask`` is the i-th node by node_id.

    A layer holds the cheapest path from the depot through each subset of one size to each last node; the next one comes
    of a join with the legs and a minimum. Layers are tables, so instances of any number are solved side by side.
    """
    with scratch():
        at = written(numbered(nodes, by), "numbered")
        other = at.select(*by, F.col("bit").alias("next"), F.col("x").alias("x2"), F.col("y").alias("y2"))
        legs = written(at.join(other, by).where("bit <> next").select(*by, F.col("bit").alias("last"), "next", _leg(F.col("x"), F.col("y"), F.col("x2"), F.col("y2")).alias("leg")), "legs")
        home = written(at.select(*by, F.col("bit").alias("last"), _leg(F.col("x"), F.col("y"), F.lit(0.0), F.lit(0.0)).alias("home")), "home")
        most = at.agg(F.coalesce(F.max("bit"), F.lit(-1)).alias("n")).first()["n"] + 1
        layer = home.select(*by, F.expr("shiftleft(1L, last)").alias("mask"), "last", F.col("home").alias("cost"))
        layers = [layer]
        for _ in range(1, most):
            taken = F.expr("shiftleft(1L, next)")
            grown = layer.join(small(legs), [*by, "last"]).where(F.col("mask").bitwiseAND(taken) == 0)
            layer = written(grown.groupBy(*by, F.col("mask").bitwiseOR(taken).alias("mask"), F.col("next").alias("last")).agg(F.min(F.col("cost") + F.col("leg")).alias("cost")), "layer")
            layers.append(layer)
        every = layers[0]
        for more in layers[1:]:
            every = every.unionByName(more)
        tours = every.join(small(home), [*by, "last"]).groupBy(*by, "mask").agg(F.min(F.col("cost") + F.col("home")).alias("cost"))
        return written(tours.select(*by, "mask", F.bit_count("mask").cast("int").alias("n"), "cost"), "tours", keep=True)


def best_selections(nodes: DataFrame, by: list[str], budget: float) -> DataFrame:
    """``(by, mask, n, cost, missed, objective)``: for each instance the set of nodes whose tour keeps the budget and whose
    tour cost with the losses of the nodes left out is least (of equal ones the least mask). ``nodes`` has ``loss`` too.

    Losses of nodes add up, as in the nominal objective; leaving all nodes out is a selection too.
    """
    with scratch():
        tours = subset_tours(nodes, by)
        lost = numbered(nodes, by).join(nodes.select(*by, "node_id", "loss"), [*by, "node_id"])
        lost = written(lost.groupBy(*by).agg(F.collect_list(F.struct("bit", "loss")).alias("losses")), "losses")  # MAX_NODES each
        empty = lost.select(*by, F.lit(0).cast("long").alias("mask"), F.lit(0).alias("n"), F.lit(0.0).alias("cost"))
        every = tours.where(F.col("cost") <= budget).unionByName(empty).join(small(lost), by)
        out = F.filter("losses", lambda v: F.col("mask").bitwiseAND(F.pow(F.lit(2.0), v["bit"]).cast("long")) == 0)
        missed = F.aggregate(F.array_sort(out), F.lit(0.0), lambda total, v: total + v["loss"])
        valued = every.withColumn("missed", missed).withColumn("objective", F.col("cost") + F.col("missed"))
        best = valued.groupBy(*by).agg(F.min(F.struct("objective", "mask", "n", "cost", "missed")).alias("best"))
        return written(best.select(*by, "best.mask", "best.n", "best.cost", "best.missed", "best.objective"), "best", keep=True)
