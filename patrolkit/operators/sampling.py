"""Samples that a hash or an arithmetic generator decides, so that they repeat on any cluster."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from patrolkit.functions.scalars import uniform
from patrolkit.plans.shared_tables import small

#: Constants of the arithmetic generator: fixed values.
FACTOR, STEP, MODULUS = 1103515245, 12345, 2147483648


def draw(key: Column) -> Column:
    """A number in 0..2^31 that an integer key decides; the same in any SQL engine."""
    return F.pmod(key * F.lit(FACTOR) + F.lit(STEP), F.lit(MODULUS))


#: Draws in one of the ranges that an exact sample counts first (4,096 ranges).
RANGE = 1 << 19


def exact_share(rows: DataFrame, by: str, key: str, share: float) -> DataFrame:
    """In each group the ``max(1, round(share * n))`` rows of least draw (then key).

    Counts by ranges of draws tell which range the last kept row lies in, so rows are ranked inside one range only.
    """
    marked = rows.withColumn("draw__", draw(F.col(key))).withColumn("range__", F.floor(F.col("draw__") / RANGE))
    counts = marked.groupBy(by, "range__").agg(F.count("*").alias("n__"))
    earlier = Window.partitionBy(by).orderBy("range__").rowsBetween(Window.unboundedPreceding, -1)
    sizes = rows.groupBy(F.col(by).alias("of__")).agg(F.greatest(F.lit(1), F.bround(F.count("*") * F.lit(share)).cast("long")).alias("keep__"))
    starts = counts.withColumn("before__", F.coalesce(F.sum("n__").over(earlier), F.lit(0))).join(sizes, F.col(by).eqNullSafe(F.col("of__")))
    starts = starts.where("before__ < keep__").select(F.col(by).alias("in__"), F.col("range__").alias("at__"), "before__", "keep__")
    near = marked.join(small(starts), F.col(by).eqNullSafe(F.col("in__")) & (F.col("range__") == F.col("at__")))
    rank = F.row_number().over(Window.partitionBy(by, "range__").orderBy("draw__", key))
    return near.withColumn("rank__", rank).where(F.col("before__") + F.col("rank__") <= F.col("keep__")).select(*rows.columns)


def every_nth(rows: DataFrame, by: str, order: str, step: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(by).orderBy(order))
    return rows.withColumn("rank", rank).where(F.pmod(F.col("rank") - 1, F.lit(step)) == 0).drop("rank")


def per_cell(rows: DataFrame, cells: list[Column], key: str, most: int) -> DataFrame:
    """At most ``most`` rows of each cell, by least draw."""
    named = rows.withColumns({f"cell_{i}": c for i, c in enumerate(cells)} | {"draw": draw(F.col(key))})
    rank = F.row_number().over(Window.partitionBy(*[f"cell_{i}" for i in range(len(cells))]).orderBy("draw", key))
    return named.withColumn("rank", rank).where(F.col("rank") <= most).select(*rows.columns)


def fraction(rows: DataFrame, share: float, key: str, seed: int = 42) -> DataFrame:
    """About ``share`` of the rows, by the draw of a whole-number key."""
    return rows.where(uniform(F.col(key), seed) < share)


def by_cluster_centres(rows: DataFrame, features: list[str], key: str, count: int, seed: int = 1) -> DataFrame:
    """``count`` rows spread over the data: the row next to each centre of a k-means clustering."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    vectors = VectorAssembler(inputCols=features, outputCol="features_vector").transform(rows)
    model = KMeans(k=count, seed=seed, featuresCol="features_vector", predictionCol="centre").fit(vectors)
    centres = F.array(*[F.array(*[F.lit(float(v)) for v in c]) for c in model.clusterCenters()])
    x = vector_to_array("features_vector")
    gap = F.aggregate(F.zip_with(x, F.element_at(centres, F.col("centre") + 1), lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v)
    near = model.transform(vectors).withColumn("gap", gap)
    return near.groupBy("centre").agg(F.min_by(F.struct(*rows.columns), F.struct("gap", key)).alias("row")).select("row.*")


def stratified_nodes(values: DataFrame, value: str, key: str, strata: int, take: int) -> DataFrame:
    """Quantile bins of a value (equal edges dropped) and the ``take / strata`` nodes of least draw in each."""
    edges = values.agg(F.expr(f"percentile({value}, array({', '.join(str(i / strata) for i in range(1, strata))}))").alias("edges"))
    bin_ = F.size(F.filter(F.array_distinct("edges"), lambda e: F.col(value) > e))
    binned = values.crossJoin(F.broadcast(edges)).withColumn("stratum", bin_).drop("edges")
    rank = F.row_number().over(Window.partitionBy("stratum").orderBy(draw(F.col(key)), key))
    return binned.withColumn("rank", rank).where(F.col("rank") <= max(1, take // strata)).drop("rank")
