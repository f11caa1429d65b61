"""Counts of what lies before a value, without a task that holds all values."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Value ranges that a group is cut into; more ranges mean smaller tasks, not other results.
RANGES = 128


def counts_before(per_value: DataFrame, by: list[str], value: str, count: str, name: str, *, descending: bool = False) -> DataFrame:
    """``per_value`` with ``name``: the sum of ``count`` over the group's rows of smaller (or larger) ``value``.

    Each (group, value) is one row. Values are cut at approximate quantiles of the whole table; totals of the ranges
    (RANGES rows a group) give where a range starts, and a window counts inside one range.
    """
    sign = -1 if descending else 1
    keyed = per_value.withColumn("key__", F.col(value) * F.lit(sign))
    shares = ", ".join(str(i / RANGES) for i in range(1, RANGES))
    edges = keyed.agg(F.expr(f"percentile_approx(key__, array({shares}), 1000)").alias("edges__"))
    inside_edges = F.size(F.filter(F.coalesce("edges__", F.array().cast("array<double>")), lambda e: e < F.col("key__")))
    cut = keyed.crossJoin(F.broadcast(edges)).withColumn("range__", inside_edges).drop("edges__")  # one row of edges
    earlier = Window.partitionBy(*by).orderBy("range__").rowsBetween(Window.unboundedPreceding, -1)
    totals = cut.groupBy(*by, "range__").agg(F.sum(count).alias("total__"))
    starts = totals.select(*[F.col(b).alias(f"{b}__start") for b in by], F.col("range__").alias("range__start"), F.coalesce(F.sum("total__").over(earlier), F.lit(0)).alias("start__"))
    inside = Window.partitionBy(*by, "range__").orderBy("key__").rowsBetween(Window.unboundedPreceding, -1)
    counted = cut.withColumn("inside__", F.coalesce(F.sum(count).over(inside), F.lit(0)))
    match = [F.col(b).eqNullSafe(F.col(f"{b}__start")) for b in by] + [F.col("range__") == F.col("range__start")]
    return counted.join(starts, match).select(*per_value.columns, (F.col("start__") + F.col("inside__")).alias(name))
