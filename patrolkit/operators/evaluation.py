"""Quality of clusterings and graphs, as aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from patrolkit.plans.shared_tables import small


def contingency(rows: DataFrame, truth: str, found: str) -> DataFrame:
    return rows.groupBy(F.col(truth).alias("truth"), F.col(found).alias("found")).agg(F.count("*").alias("n"))


def _pairs(n: Column) -> Column:
    return n * (n - 1) / 2.0


def agreement(table: DataFrame) -> DataFrame:
    """One row: n, ari, nmi (arithmetic mean) and accuracy (each cluster stands for its commonest class)."""
    n = F.col("n").cast("double")
    cells = table.agg(F.sum(n).alias("n"), F.sum(_pairs(n)).alias("both"), F.sum(n * F.ln(n)).alias("s_both"))
    rows = table.groupBy("truth").agg(F.sum(n).alias("n")).agg(F.sum(_pairs(F.col("n"))).alias("a"), F.sum(F.col("n") * F.ln("n")).alias("s_a"))
    cols = table.groupBy("found").agg(F.sum(n).alias("n"), F.max(n).alias("top"))
    cols = cols.agg(F.sum(_pairs(F.col("n"))).alias("b"), F.sum(F.col("n") * F.ln("n")).alias("s_b"), F.sum("top").alias("right"))
    one = cells.crossJoin(rows).crossJoin(cols)  # one row each
    n = F.col("n")
    expected = F.col("a") * F.col("b") / _pairs(n)
    top = (F.col("a") + F.col("b")) / 2
    ari = F.when(top == expected, 1.0).otherwise((F.col("both") - expected) / (top - expected))
    h_a, h_b = F.ln(n) - F.col("s_a") / n, F.ln(n) - F.col("s_b") / n
    mutual = F.ln(n) + (F.col("s_both") - F.col("s_a") - F.col("s_b")) / n
    nmi = F.when(h_a + h_b == 0, 1.0).otherwise(2 * mutual / (h_a + h_b))
    return one.select(n.cast("long").alias("n"), ari.alias("ari"), nmi.alias("nmi"), (F.col("right") / n).alias("accuracy"))


def cluster_report(labelled: DataFrame, noise: int = 0) -> DataFrame:
    """One row: points, clusters, noise points and share, and the clusters' sizes."""
    sizes = labelled.groupBy("label").agg(F.count("*").alias("n"))
    real = F.col("label") != noise
    return sizes.agg(
        F.sum("n").alias("points"), F.count_if(real).alias("clusters"), F.coalesce(F.sum(F.when(~real, F.col("n"))), F.lit(0)).alias("noise"),
        (F.coalesce(F.sum(F.when(~real, F.col("n"))), F.lit(0)) / F.sum("n") * 100).alias("noise_pct"),
        F.avg(F.when(real, F.col("n"))).alias("mean_size"), F.max(F.when(real, F.col("n"))).alias("max_size"), F.min(F.when(real, F.col("n"))).alias("min_size"),
    )


def scatter_scores(points: DataFrame, label: str, features: list[str]) -> DataFrame:
    """One row: Calinski-Harabasz and Davies-Bouldin scores of labels >= 0, from sums of each cluster."""
    kept = points.where(F.col(label) >= 0)
    sums = kept.groupBy(label).agg(F.count("*").alias("n"), *[F.avg(f).alias(f"c_{f}") for f in features])
    whole = kept.agg(*[F.avg(f).alias(f"g_{f}") for f in features])
    near = kept.join(F.broadcast(sums), label)  # one row a cluster
    square = sum(((F.col(f) - F.col(f"c_{f}")) ** 2 for f in features), F.lit(0.0))
    per = near.groupBy(label).agg(F.first("n").alias("n"), F.sum(square).alias("within"), F.avg(F.sqrt(square)).alias("spread"), *[F.first(f"c_{f}").alias(f"c_{f}") for f in features])
    between = sum(((F.col(f"c_{f}") - F.col(f"g_{f}")) ** 2 for f in features), F.lit(0.0)) * F.col("n")
    ch = per.crossJoin(whole).agg(F.sum(between).alias("between"), F.sum("within").alias("within"), F.count("*").alias("k"), F.sum("n").alias("n"))
    other = per.select(F.col(label).alias("other"), F.col("spread").alias("spread2"), *[F.col(f"c_{f}").alias(f"d_{f}") for f in features])
    apart = F.sqrt(sum(((F.col(f"c_{f}") - F.col(f"d_{f}")) ** 2 for f in features), F.lit(0.0)))
    worst = per.join(F.broadcast(other), F.col(label) != F.col("other")).groupBy(label).agg(F.max((F.col("spread") + F.col("spread2")) / apart).alias("worst"))
    db = worst.agg(F.avg("worst").alias("davies_bouldin"))
    score = (F.col("between") / (F.col("k") - 1)) / (F.col("within") / (F.col("n") - F.col("k")))
    return ch.crossJoin(db).select(score.alias("calinski_harabasz"), "davies_bouldin")


def silhouette(points: DataFrame, label: str, features: list[str]) -> DataFrame:
    """Mean silhouette (Euclidean) of labels >= 0.

    Equal positions of a label are one row with their number. Distances between all positions are the definition: each
    part of the positions meets all of them, and only their sums by label are shuffled.
    """
    places = points.where(F.col(label) >= 0).groupBy(F.col(label).alias("l"), *features).agg(F.count("*").alias("w"))
    kept = places.withColumn("id", F.struct("l", *features)).repartition(4 * points.sparkSession.sparkContext.defaultParallelism)
    other = small(places.select(F.col("l").alias("l2"), F.col("w").alias("w2"), *[F.col(f).alias(f"{f}2") for f in features]))
    d = F.sqrt(sum(((F.col(f) - F.col(f"{f}2")) ** 2 for f in features), F.lit(0.0)))
    met = kept.crossJoin(other).groupBy("id", "l", "w", "l2").agg(F.sum(F.col("w2") * d).alias("sum"), F.sum(F.when(d.isNotNull(), F.col("w2"))).alias("n"))
    others = F.col("n") - (F.col("l") == F.col("l2")).cast("long")  # without the point itself
    means = met.withColumn("d", F.when(others > 0, F.col("sum") / others))
    per = means.groupBy("id", "l", "w").agg(F.max(F.when(F.col("l") == F.col("l2"), F.col("d"))).alias("a"), F.min(F.when(F.col("l") != F.col("l2"), F.col("d"))).alias("b"))
    value = F.when(F.col("a").isNull() | F.col("b").isNull(), 0.0).otherwise((F.col("b") - F.col("a")) / F.greatest("a", "b"))
    return per.agg(F.try_divide(F.sum(F.col("w") * value), F.sum("w")).alias("silhouette"))


def degrees(edges: DataFrame) -> DataFrame:
    """One row: vertices and mean degree (null without an edge) of an undirected edge table (src, dst), each edge given once."""
    ends = edges.select(F.explode(F.array("src", "dst")).alias("v"))
    return ends.agg(F.count_distinct("v").alias("vertices"), F.try_divide(F.count("*"), F.count_distinct("v")).alias("mean_degree"))


def second_eigenvalue(edges: DataFrame, rounds: int = 60) -> float:
    """Second smallest eigenvalue of the normalised Laplacian, by power iteration with the first vector taken out.

    Each round is one join and aggregation over edges, written to the shared folder now and then.
    """
    from patrolkit.plans.shared_tables import written

    both = edges.select("src", "dst").union(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    degree = written(both.groupBy("src").agg(F.count("*").cast("double").alias("deg")), "degree")
    links = written(both.join(degree, "src").join(degree.select(F.col("src").alias("dst"), F.col("deg").alias("deg2")), "dst").select("src", "dst", (1 / F.sqrt(F.col("deg") * F.col("deg2"))).alias("w")), "links")
    total = degree.agg(F.sum("deg")).first()[0]
    vector = degree.select("src", F.sqrt(F.col("deg") / total).alias("first"), (F.pmod(F.xxhash64("src"), F.lit(2001)) / 1000.0 - 1.0).alias("x"))
    value = 0.0
    for turn in range(rounds):
        along = vector.agg(F.sum(F.col("x") * F.col("first"))).first()[0] or 0.0
        flat = vector.withColumn("x", F.col("x") - F.lit(along) * F.col("first"))
        size = math_sqrt(flat.agg(F.sum(F.col("x") ** 2)).first()[0] or 0.0)
        if size == 0:
            return 0.0
        flat = flat.withColumn("x", F.col("x") / F.lit(size))
        moved = links.join(flat.select(F.col("src").alias("dst"), "x"), "dst").groupBy("src").agg(F.sum(F.col("w") * F.col("x")).alias("y"))
        grown = flat.join(moved, "src")
        value = grown.agg(F.sum(F.col("x") * F.col("y"))).first()[0]
        vector = grown.select("src", "first", ((F.col("x") + F.col("y")) / 2).alias("x"))  # shifted, so that no sign flips
        if turn % 5 == 4:
            vector = written(vector, "vector")
    return 1.0 - value


def math_sqrt(x: float) -> float:
    return x**0.5
