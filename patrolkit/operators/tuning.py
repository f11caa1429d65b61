"""Parameter search for density clustering: neighbour counts and radii are tried on a small sample and scored."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from patrolkit.plans.shared_tables import ship, small, written

from .cluster import density_radii, grid_dbscan
from .spatial import k_distances

#: Points on which a setting is scored, and points of a period that its trials see (drawn by a hash of the ids).
EVALUATED_ROWS = 2_000
SAMPLED_ROWS = 50_000
#: Fixed values of the neighbour counts: the factors of log10(n) and of log10(n / 10), the constant, slope and bounds of
#: the rule by ln(n / 10000), the surroundings below and above the rules, the bounds of all counts, and how many are tried.
COUNTS = {"by_size": 0.8, "by_tenth": 0.9, "constant": 6.4, "slope": 0.2, "rule": (5, 12), "around": (1, 2), "all": (5, 15), "tried": 10}
#: Fixed values of the score: places for each expected cluster squared, what noise takes, and the least factor it leaves.
SCORE = {"places": 2_000, "noise": 1.5, "least": 0.1}
#: The neighbours that a period gets in whose trials nothing scored: the tried count nearest to this.
PLAIN_COUNT = 10
_SPREAD = 1 << 30


def candidate_counts(n: Column) -> Column:
    """The neighbour counts to try for ``n`` places, as an array: all between the least and the largest of four rules,
    with their surroundings."""
    low, high = COUNTS["rule"]
    held = lambda v: F.least(F.lit(high), F.greatest(F.lit(low), v.cast("int")))
    digits = F.log10(n)
    by_size = (digits * COUNTS["by_size"]).cast("int")
    smooth = held(F.lit(COUNTS["constant"]) + F.lit(COUNTS["slope"]) * F.ln(n / F.lit(10_000.0)))
    rules = [held(by_size), held(F.greatest(F.lit(0.0), digits - 1) * COUNTS["by_tenth"]), smooth, held(F.floor((F.greatest(F.lit(low), by_size) + smooth) / 2))]
    (before, behind), (least, most) = COUNTS["around"], COUNTS["all"]
    return F.slice(F.sequence(F.greatest(F.lit(least), F.least(*rules) - before), F.least(F.lit(most), F.greatest(*rules) + behind)), 1, COUNTS["tried"])


def score(labels: np.ndarray, n: int) -> float:
    """Closeness to the number of clusters that n places suggest, less what noise takes; 0 without a cluster."""
    clusters = len(np.unique(labels[labels >= 0]))
    wanted = max(2, math.isqrt(n // SCORE["places"]))
    kept = max(SCORE["least"], 1 - SCORE["noise"] * float((labels < 0).mean()))
    return kept * wanted / (wanted + abs(clusters - wanted)) if clusters else 0.0


def trials(points: DataFrame, period: str, sampled_rows: int = SAMPLED_ROWS) -> DataFrame:
    """``(period, n, k, eps, eps_min, eps_max, score)``: every neighbour count tried for a period, with the radius that the
    density rules give it and the score of the clusters found on EVALUATED_ROWS of the period's sample.

    k-distances, quantiles and radii are columns over the sample; a task sees the scored rows of one setting.
    """
    sizes = points.groupBy(F.col(period).alias("of")).agg(F.count("*").alias("all_rows"))
    draw = F.pmod(F.xxhash64("event_id"), F.lit(_SPREAD))
    rows = points.select(period, "event_id", "lon", "lat").join(small(sizes), F.col(period) == F.col("of")).drop("of")
    rows = written(rows.withColumn("draw", draw).where(F.col("draw") * F.col("all_rows") < F.lit(sampled_rows * _SPREAD)), "sampled")
    held = rows.groupBy(period).agg(F.count("*").alias("sampled"), F.max("all_rows").alias("all_rows"))
    counts = held.select(F.col(period).alias("of"), F.explode(candidate_counts(F.col("sampled"))).alias("k"), F.monotonically_increasing_id().alias("place"))
    counts = written(counts.select("of", "k", F.concat_ws("/", "place", "k").alias("trial")), "counts")
    tried = rows.join(small(counts), F.col(period) == F.col("of")).drop("of")
    first = k_distances(rows, period, 2).join(small(counts), F.col(period) == F.col("of")).select("trial", "event_id", "k_dist")
    radii = written(density_radii(k_distances(tried, "trial", "k"), first, tried, "trial"), "radii")
    best = Window.partitionBy(period).orderBy("draw", "event_id")  # a sample of bounded size
    scored = rows.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= EVALUATED_ROWS).join(small(counts), F.col(period) == F.col("of"))
    scored = scored.join(small(radii.select(F.col("trial").alias("named"), F.col("n").alias("sampled"), "eps")), F.col("trial") == F.col("named"))
    ship(points.sparkSession)

    def run(part: pd.DataFrame) -> pd.DataFrame:
        setting = part.iloc[0]
        labels = grid_dbscan(part.sort_values("event_id")[["lon", "lat"]].to_numpy(float), float(setting["eps"]), int(setting["k"]))
        return pd.DataFrame({"trial": [setting["trial"]], "score": [score(labels, int(setting["sampled"]))]})

    found = scored.select("trial", "event_id", "lon", "lat", "k", "eps", "sampled").groupBy("trial").applyInPandas(run, "trial string, score double")
    named = counts.join(radii, "trial").join(found, "trial").join(held.select(period, "all_rows"), F.col("of") == F.col(period))
    return named.select(period, F.col("all_rows").alias("n"), F.col("n").alias("sampled"), "k", "eps", "eps_min", "eps_max", "score")


def enhanced_parameters(points: DataFrame, period: str, sampled_rows: int = SAMPLED_ROWS) -> DataFrame:
    """``(period, n, eps, min_samples, score)``: the best trial of each period (fewer neighbours first).

    n is the number of all its points, the trials see a sample of about ``sampled_rows``. Where nothing scores, the count
    nearest to PLAIN_COUNT is taken; where no count is smaller than the sample, half of it and the middle of the radii.
    """
    valid = F.col("k") < F.col("sampled")
    by_score = F.when(valid, F.struct(F.col("score"), F.when(F.col("score") > 0, -F.col("k")).otherwise(-F.abs(F.col("k") - PLAIN_COUNT)).alias("near"), (-F.col("k")).alias("few"), F.bround("eps", 6).alias("eps")))
    top = trials(points, period, sampled_rows).groupBy(period, "n").agg(F.max(by_score).alias("top"), F.max("sampled").alias("sampled"), F.max((F.col("eps_min") + F.col("eps_max")) / 2).alias("middle"))
    least, most = COUNTS["all"]
    half = F.greatest(F.lit(least), F.least(F.lit(most), F.floor(F.col("sampled") / 2))).cast("int")
    return top.select(period, "n", F.coalesce("top.eps", "middle").alias("eps"), F.coalesce(-F.col("top.few"), half).cast("int").alias("min_samples"), F.coalesce("top.score", F.lit(0.0)).alias("score"))
