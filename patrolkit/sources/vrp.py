"""Routing instances: the sectioned text format and its solutions, and seeded random instances and clouds."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from patrolkit.functions.scalars import normal, uniform

#: Vehicle capacities by number of customers: fixed values.
CAPACITY = {10: 20, 20: 30, 50: 40, 100: 50, 200: 80, 500: 100, 1000: 250}
_NUMBER = r"(-?\d+(?:\.\d+)?(?:[eE][-+]?\d+)?)"


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """``(file, line_no, line)`` of text files, each file whole so that its lines keep their order."""
    whole = spark.read.text(path, wholetext=True).withColumn("file", F.input_file_name())
    return whole.select("file", F.posexplode(F.split("value", r"\r?\n"))).select("file", F.col("pos").alias("line_no"), F.trim(F.regexp_replace("col", "\t", " ")).alias("line"))


def instance_headers(spark: SparkSession, path: str) -> DataFrame:
    """``(file, key, value)`` of the header lines ``KEY : value``."""
    lines = _lines(spark, path).where(F.col("line").rlike(r"^[A-Z_]+\s*:"))
    return lines.select("file", F.trim(F.regexp_extract("line", r"^([A-Z_]+)\s*:", 1)).alias("key"), F.trim(F.regexp_extract("line", r"^[A-Z_]+\s*:\s*(.*)$", 1)).alias("value"))


def instance_nodes(spark: SparkSession, path: str) -> DataFrame:
    """``(file, node, x, y, demand)`` for every node from 1 to the largest; missing nodes lie at (0, 0) without demand."""
    lines = _lines(spark, path)
    title = F.when(F.col("line").rlike(r"^(NODE_COORD|DEMAND|DEPOT)_SECTION"), F.regexp_extract("line", r"^(\w+)_SECTION", 1)).when(F.col("line").rlike(r"^(EOF|[A-Z_]+\s*:)"), "HEAD")
    marked = lines.withColumn("section", F.last(title, ignorenulls=True).over(Window.partitionBy("file").orderBy("line_no")))
    part = F.regexp_extract_all(F.col("line"), F.lit(_NUMBER), F.lit(1))
    rows = marked.where("section in ('NODE_COORD', 'DEMAND')").withColumn("n", part).where(F.size("n") >= 2)
    node = F.col("n")[0].cast("double").cast("long")
    at = rows.where("section = 'NODE_COORD'").select("file", node.alias("node"), F.col("n")[1].cast("double").alias("x"), F.col("n")[2].cast("double").alias("y"))
    need = rows.where("section = 'DEMAND'").select("file", node.alias("node"), F.col("n")[1].cast("double").alias("demand"))
    every = at.select("file", "node").union(need.select("file", "node")).groupBy("file").agg(F.max("node").alias("last")).select("file", F.explode(F.sequence(F.lit(1).cast("long"), "last")).alias("node"))
    full = every.join(at, ["file", "node"], "left").join(need, ["file", "node"], "left")
    return full.select("file", "node", *[F.coalesce(c, F.lit(0.0)).alias(c) for c in ("x", "y", "demand")])


def solutions(spark: SparkSession, path: str) -> DataFrame:
    """``(file, cost, routes)`` of solution files (lines ``Route #k: ...`` and ``Cost n``)."""
    lines = _lines(spark, path)
    stops = F.transform(F.regexp_extract_all(F.regexp_replace("line", r"^Route #\d+:", ""), F.lit(r"(\d+)"), F.lit(1)), lambda s: s.cast("long"))
    routes = lines.where(F.col("line").rlike(r"^Route #\d+:")).groupBy("file").agg(F.transform(F.array_sort(F.collect_list(F.struct("line_no", stops.alias("stops")))), lambda r: r["stops"]).alias("routes"))
    cost = lines.where(F.col("line").rlike(r"^Cost")).groupBy("file").agg(F.max(F.regexp_extract("line", r"^Cost\s+([\d.]+)", 1).cast("double")).alias("cost"))
    return routes.join(cost, "file", "full_outer").select("file", "cost", "routes")


def rounded_tour_cost(stops: DataFrame, by: list[str]) -> DataFrame:
    """Tour lengths with every leg rounded half to even, as the benchmark format asks; rows are (by, pos, x, y), closed."""
    order = Window.partitionBy(*by).orderBy("pos")
    first = Window.partitionBy(*by).orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    nx, ny = (F.coalesce(F.lead(c).over(order), F.first(c).over(first)) for c in ("x", "y"))
    leg = F.bround(F.sqrt((F.col("x") - nx) ** 2 + (F.col("y") - ny) ** 2), 0)
    return stops.withColumn("leg", leg).groupBy(*by).agg(F.sum("leg").alias("cost"))


def random_instances(spark: SparkSession, count: int, customers: int, kind: str = "uniform", seed: int = 1) -> DataFrame:
    """``(instance, node, x, y, demand, capacity)``: seeded customers in the unit square; kinds uniform, cluster, mixed.

    Every number follows from the customer's place and the seed, so instances are the same on any cluster.
    """
    place = F.col("id") + F.lit(seed) * F.lit(count * customers)
    rows = spark.range(count * customers).select(F.floor(F.col("id") / customers).alias("instance"), (F.col("id") % customers + 1).alias("node"), place.alias("place"))
    centre = F.col("instance") * 3 + F.col("node") % 3 + F.lit(seed) * F.lit(count * 3)
    inside = lambda c: F.least(F.lit(1.0), F.greatest(F.lit(0.0), c))
    near = [inside(0.2 + 0.6 * uniform(centre, 10 + i) + 0.07 * normal(F.col("place"), 2 + 2 * i)) for i in (0, 1)]
    grouped = {"uniform": F.lit(False), "cluster": F.lit(True), "mixed": F.col("node") % 2 == 0}[kind]
    size = min((k for k in CAPACITY if k >= customers), default=max(CAPACITY))
    x, y = (F.when(grouped, near[i]).otherwise(uniform(F.col("place"), i)) for i in (0, 1))
    demand = (1 + F.floor(uniform(F.col("place"), 6) * 9)) / float(CAPACITY[size])
    return rows.select("instance", "node", x.alias("x"), y.alias("y"), demand.alias("demand"), F.lit(1.0).alias("capacity"))


def two_moons(spark: SparkSession, n: int, noise: float = 0.07, seed: int = 1) -> DataFrame:
    """``(id, x, y, label)``: two half circles that reach into each other, with normal noise."""
    key = F.col("id") + F.lit(seed * n)
    upper = F.col("id") % 2 == 0
    rows = spark.range(n).withColumn("t", uniform(key, 0) * F.lit(math.pi))
    x = F.when(upper, F.cos("t")).otherwise(1 - F.cos("t")) + normal(key, 2) * noise
    y = F.when(upper, F.sin("t")).otherwise(0.5 - F.sin("t")) + normal(key, 4) * noise
    return rows.select("id", x.alias("x"), y.alias("y"), F.when(upper, 0).otherwise(1).alias("label"))


def blobs(spark: SparkSession, n: int, d: int, k: int, spread: float = 1.0, seed: int = 1) -> DataFrame:
    """``(id, x0 .., label)``: normal clouds about ``k`` centres in -10..10."""
    centre = lambda j: 20 * uniform(F.col("label") + F.lit(seed * k), 2 * j) - 10
    rows = spark.range(n).withColumn("label", (F.col("id") % k).cast("int"))
    return rows.select("id", *[(centre(j) + normal(F.col("id") + F.lit(seed * n), 2 * j) * spread).alias(f"x{j}") for j in range(d)], "label")


def block_model(spark: SparkSession, n: int, k: int, p: float, q: float, seed: int = 1) -> DataFrame:
    """Edges (src < dst) of a random graph of k equal blocks; all pairs are its definition, so n is bounded by the caller."""
    a = spark.range(n).select(F.col("id").alias("src"))
    b = spark.range(n).select(F.col("id").alias("dst"))
    same = F.col("src") % k == F.col("dst") % k
    drawn = uniform(F.col("src") * n + F.col("dst"), seed)
    return a.join(b, F.col("src") < F.col("dst")).where(drawn < F.when(same, p).otherwise(q))


def decoded_degrees(column: str):
    """Coordinates that are stored as whole numbers of 1/100000 degree."""
    return F.col(column) / 1e5


