"""Holdout metrics, selection rules, paired tests and resampling."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from patrolkit.functions.scalars import ratio_or_one
from patrolkit.plans.shared_tables import scratch, ship, small, written

from .ranking import RANGES, counts_before


def realized(misses: DataFrame, travel: float, scale: float) -> DataFrame:
    """Cost and coverage of a selection in every period."""
    return misses.withColumns({"cost": F.lit(float(travel)) + F.lit(float(scale)) * F.col("missed"), "coverage_pct": ratio_or_one(F.col("collected"), F.col("total")) * 100.0})


def tail_summary(rows: DataFrame, value: str, by: list[str] | None = None, share: float = 0.10) -> DataFrame:
    """Mean, the mean of the largest ``ceil(share * n)`` values (CVaR), and the largest, for each group.

    The cut value comes from counts by value, so no group is collected: rows above it count whole, ties in part.
    """
    by = by or []
    per_value = rows.groupBy(*by, F.col(value).alias("v")).agg(F.count("*").alias("c"))
    total = rows.groupBy(*by).agg(F.ceil(F.lit(share) * F.count("*")).alias("k"), F.avg(value).alias("mean_value"), F.max(value).alias("worst_value"), F.count("*").alias("n"))
    ranked = counts_before(per_value.where(F.col("v").isNotNull()), by, "v", "c", "above", descending=True)
    joined = ranked.join(total, by) if by else ranked.crossJoin(F.broadcast(total))
    taken = F.greatest(F.lit(0), F.least(F.col("c"), F.col("k") - F.col("above")))
    return joined.groupBy(*by).agg(F.first("n").alias("n"), F.first("mean_value").alias("mean_value"), (F.sum(taken * F.col("v")) / F.sum(taken)).alias("cvar_value"), F.first("worst_value").alias("worst_value"))


def best_of_group(rows: DataFrame, by: list[str], value: str, tie: str) -> DataFrame:
    """The row of least ``value`` (then ``tie``) of each group, by one aggregation."""
    rest = F.struct(F.col(value), F.col(tie), F.struct(*[F.col(c) for c in rows.columns if c not in by]).alias("row"))
    return rows.groupBy(*by).agg(F.min(rest).alias("best")).select(*by, "best.row.*")


def method_summary(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    return rows.groupBy(*by).agg(F.count("*").alias("runs"), F.avg(value).alias("mean_value"), F.stddev_samp(value).alias("std_value"), F.min(value).alias("min_value"), F.max(value).alias("max_value"))


def mean_and_sem(rows: DataFrame, by: list[str], values: list[str]) -> DataFrame:
    """Mean and standard error of each value column."""
    made = []
    for v in values:
        made += [F.avg(v).alias(f"{v}_mean"), (F.stddev_samp(v) / F.sqrt(F.count(v).cast("double"))).alias(f"{v}_sem")]
    return rows.groupBy(*by).agg(*made)


def paired(records: DataFrame, key: str, method: str, value: str, reference: str, order: str) -> DataFrame:
    """``(method, key, reference_value, value, diff)``: the first record of each pair, benchmark minus reference."""
    first = records.groupBy(key, method).agg(F.min_by(value, order).alias("value"))
    ref = first.where(F.col(method) == reference).select(key, F.col("value").alias("reference_value"))
    return first.where(F.col(method) != reference).join(ref, key).withColumn("diff", F.col("value") - F.col("reference_value"))


def win_tie_loss(pairs: DataFrame, method: str, tolerance: float = 1e-8) -> DataFrame:
    d = F.col("diff")
    return pairs.groupBy(method).agg(
        F.count("*").alias("pairs"), F.avg("diff").alias("mean_diff"), (F.avg(d / F.col("value")) * 100).alias("mean_reduction_pct"),
        F.count_if(d > tolerance).alias("wins"), F.count_if(F.abs(d) <= tolerance).alias("ties"), F.count_if(d < -tolerance).alias("losses"),
    )


def average_rank(rows: DataFrame, value: str, by: list[str], name: str) -> DataFrame:
    """``rows`` with average ranks of ``value`` in its group, from counts of each value."""
    per = rows.groupBy(*by, F.col(value).alias("value__")).agg(F.count("*").alias("count__"))
    placed = counts_before(per, by, "value__", "count__", "before__")
    ranked = placed.select(*[F.col(b).alias(f"{b}__by") for b in by], "value__", (F.col("before__") + (F.col("count__") + 1) / 2.0).alias(name))
    match = [F.col(b) == F.col(f"{b}__by") for b in by] + [F.col(value) == F.col("value__")]
    return rows.join(ranked, match).select(*rows.columns, name)


def spearman(rows: DataFrame, x: str, y: str) -> DataFrame:
    """Correlation of average ranks."""
    return average_rank(average_rank(rows, x, [], "rank_x"), y, [], "rank_y").agg(F.corr("rank_x", "rank_y").alias("rho"), F.count("*").alias("n"))


def calibration(rows: DataFrame, x: str, y: str) -> DataFrame:
    """Least-squares line of y on x with R squared, mean absolute and root mean square error of y against x."""
    gap = F.col(y) - F.col(x)
    return rows.agg(
        F.regr_slope(F.col(y), F.col(x)).alias("slope"), F.regr_intercept(F.col(y), F.col(x)).alias("intercept"), F.regr_r2(F.col(y), F.col(x)).alias("r2"),
        F.avg(F.abs(gap)).alias("mae"), F.sqrt(F.avg(gap * gap)).alias("rmse"), F.count("*").alias("n"),
    )


def pareto(rows: DataFrame, cost: str, gain: str, tie: str, *, positive_cost: bool = False, least_gain: float | None = None) -> DataFrame:
    """Rows that no cheaper (or equal) row matches in gain: least cost first, strictly more gain each time.

    On demand only positive costs and gains from ``least_gain`` on count. Costs are cut at approximate quantiles; the
    largest gain of the cheaper ranges (RANGES rows) and a window inside one range give what a row has to exceed.
    """
    if positive_cost:
        rows = rows.where(F.col(cost) > 0)
    if least_gain is not None:
        rows = rows.where(F.col(gain) >= least_gain)
    best_at_cost = rows.groupBy(cost).agg(F.max(F.struct(F.col(gain).alias("g"), (-F.col(tie)).alias("t"))).alias("top"))
    points = best_at_cost.select(F.col(cost), F.col("top.g").alias(gain), (-F.col("top.t")).alias(tie))
    shares = ", ".join(str(i / RANGES) for i in range(1, RANGES))
    edges = points.agg(F.expr(f"percentile_approx({cost}, array({shares}), 1000)").alias("edges__"))
    place = F.size(F.filter(F.coalesce("edges__", F.array().cast("array<double>")), lambda e: e < F.col(cost)))
    cut = points.crossJoin(F.broadcast(edges)).withColumn("range__", place).drop("edges__")  # one row of edges
    tops = cut.groupBy("range__").agg(F.max(gain).alias("top__"))
    cheaper = Window.orderBy("range__").rowsBetween(Window.unboundedPreceding, -1)  # RANGES rows
    starts = tops.select(F.col("range__").alias("at__"), F.max("top__").over(cheaper).alias("before__"))
    inside = F.max(gain).over(Window.partitionBy("range__").orderBy(cost).rowsBetween(Window.unboundedPreceding, -1))
    met = cut.withColumn("inside__", inside).join(F.broadcast(starts), F.col("range__") == F.col("at__"))
    best = F.greatest("inside__", "before__")
    return met.where(best.isNull() | (F.col(gain) > best + 1e-9)).select(tie, cost, gain)


def lower_envelope(pool: DataFrame, levels: DataFrame) -> DataFrame:
    """For each penalty level the plan of least travel + level * unit penalty (ties: smaller plan id)."""
    every = levels.crossJoin(small(pool.select("plan_id", "travel", "unit_penalty")))  # a grid of levels and plans
    value = F.col("travel") + F.col("level") * F.col("unit_penalty")
    best = every.groupBy("level").agg(F.min(F.struct(F.round(value, 6).alias("objective"), F.col("plan_id"))).alias("best"))
    return best.select("level", F.col("best.plan_id").alias("plan_id"), F.col("best.objective").alias("objective"))


def density_grid(rows: DataFrame, x: str, y: str, box: tuple[float, float, float, float], bins: int, weight: Column | None = None) -> DataFrame:
    """Weighted counts of a bins x bins grid over a box; the last bin holds its upper edge."""

    def index(c: str, low: float, high: float) -> Column:
        return F.least(F.lit(bins - 1), F.floor((F.col(c) - F.lit(low)) / F.lit((high - low) / bins))).cast("long")

    inside = rows.where(F.col(x).between(box[0], box[1]) & F.col(y).between(box[2], box[3]))
    return inside.groupBy(index(x, box[0], box[1]).alias("bin_x"), index(y, box[2], box[3]).alias("bin_y")).agg((F.sum(weight) if weight is not None else F.count("*")).alias("amount"))


def as_of(records: DataFrame, points: DataFrame, at: str, key: str, tie: str) -> DataFrame:
    """For each key and time point the last record at or before it.

    Records and points are laid on one line by time, and the last record is carried along it: one shuffle by key.
    """
    own = records.select(F.col(key), F.col(at).alias("t"), F.lit(0).alias("kind"), F.struct(F.col(at), F.col(tie)).alias("record"), F.lit(None).cast("timestamp").alias("point"))
    asks = records.select(key).distinct().crossJoin(F.broadcast(points.select("point")))
    asks = asks.select(key, F.col("point").alias("t"), F.lit(1).alias("kind"), F.lit(None).cast(own.schema["record"].dataType).alias("record"), "point")
    line = Window.partitionBy(key).orderBy("t", "kind", F.col(f"record.{tie}"))
    carried = own.unionByName(asks).withColumn("last", F.last("record", ignorenulls=True).over(line))
    return carried.where("kind = 1 and last is not null").select(key, "point", F.col(f"last.{at}").alias("last_at"), F.col(f"last.{tie}").alias(f"last_{tie}"))


def running_best(records: DataFrame, key: str, order: list[str], value: str) -> DataFrame:
    line = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return records.withColumn("best_so_far", F.min(value).over(line))


# ---- inference kernels -----------------------------------------------------------------------------------------------


def normal_tail(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2))


def wilcoxon(diff: np.ndarray, *, alternative: str = "greater", zeros: str = "wilcox", exact_up_to: int = 50) -> tuple[float, float]:
    """``(W+, p)`` of the signed-rank test. Zeros are dropped or (``zsplit``) their ranks halved; all zero gives p = 1.

    Exact for up to ``exact_up_to`` untied differences without zeros, else normal with tie correction.
    """
    d = np.asarray(diff, float)
    if not len(d) or np.all(np.abs(d) <= 1e-12):
        return 0.0, 1.0
    had_zero = bool((d == 0).any())
    if zeros == "wilcox":
        d = d[d != 0]
    size = np.abs(d)
    values, inverse, count = np.unique(size, return_inverse=True, return_counts=True)
    rank = (np.cumsum(count) - (count - 1) / 2)[inverse]
    plus = float(rank[d > 0].sum() + (rank[d == 0].sum() / 2 if zeros == "zsplit" else 0.0))
    n = len(d)
    if n <= exact_up_to and len(values) == n and not had_zero:
        ways = np.zeros(n * (n + 1) // 2 + 1)
        ways[0] = 1.0
        for r in range(1, n + 1):
            ways[r:] = ways[r:] + ways[:-r].copy()
        share = ways / ways.sum()
        upper, lower = float(share[int(round(plus)) :].sum()), float(share[: int(round(plus)) + 1].sum())
        p = upper if alternative == "greater" else lower if alternative == "less" else min(1.0, 2 * min(upper, lower))
        return plus, p
    mean = n * (n + 1) / 4
    spread = n * (n + 1) * (2 * n + 1) / 24 - float((count**3 - count).sum()) / 48
    if spread <= 0:
        return plus, 1.0
    z = (plus - mean) / math.sqrt(spread)
    p = normal_tail(z) if alternative == "greater" else normal_tail(-z) if alternative == "less" else min(1.0, 2 * normal_tail(abs(z)))
    return plus, p


def wilcoxon_by(pairs: DataFrame, method: str, alternative: str = "greater", zeros: str = "wilcox") -> DataFrame:
    """The signed-rank test of each group of paired differences, from counts of each difference.

    Ranks come from a window over distinct absolute differences, and the p-value is normal with tie correction; small
    groups (at most 50 differences) go to the exact kernel.
    """
    d = F.col("diff")
    used = pairs.where(d != 0) if zeros == "wilcox" else pairs
    sizes = used.groupBy(method).agg(F.count("*").alias("n"))
    per = used.groupBy(method, F.abs(d).alias("a")).agg(F.count("*").alias("c"), F.count_if(d > 0).alias("p"), F.count_if(d == 0).alias("z"))
    placed = counts_before(per, [method], "a", "c", "before")
    ranked = placed.withColumn("rank", F.col("before") + (F.col("c") + 1) / 2.0)
    sums = ranked.groupBy(method).agg(F.sum(F.col("rank") * (F.col("p") + F.col("z") / 2)).alias("w_plus"), F.sum(F.col("c") ** 3 - F.col("c")).alias("ties"), F.sum("c").alias("n"))
    n = F.col("n").cast("double")
    spread = n * (n + 1) * (2 * n + 1) / 24 - F.col("ties") / 48
    large = sums.select(method, "n", "w_plus", ((F.col("w_plus") - n * (n + 1) / 4) / F.sqrt(spread)).alias("z_score"))

    def tail(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in rows:
            z = part["z_score"].fillna(0.0)
            p = [normal_tail(v) if alternative == "greater" else normal_tail(-v) if alternative == "less" else min(1.0, 2 * normal_tail(abs(v))) for v in z]
            yield part.assign(p_value=p)[[method, "n", "w_plus", "p_value"]]

    kind = dict(pairs.dtypes)[method]
    ship(pairs.sparkSession)
    out = large.join(sizes.where("n > 50").select(method), method, "left_semi").mapInPandas(tail, f"{method} {kind}, n long, w_plus double, p_value double")

    def small_groups(rows: pd.DataFrame) -> pd.DataFrame:
        w, p = wilcoxon(rows["diff"].to_numpy(), alternative=alternative, zeros=zeros)
        return pd.DataFrame({method: [rows[method].iloc[0]], "n": [int((rows["diff"] != 0).sum()) if zeros == "wilcox" else len(rows)], "w_plus": [w], "p_value": [p]})

    few = used.join(sizes.where("n <= 50").select(method), method, "left_semi").select(method, "diff")
    return out.unionByName(few.groupBy(method).applyInPandas(small_groups, f"{method} {kind}, n long, w_plus double, p_value double"))


def block_starts(n: int, blocks: int, reps: np.ndarray, seed: int) -> np.ndarray:
    """Starts in 0..n-1 of the blocks of each replicate, by an arithmetic generator that any engine can follow."""
    i = reps.astype(np.int64)[:, None] * blocks + np.arange(blocks) + seed * 7919
    x = (i * 1103515245 + 12345) % 2147483648
    x = (x // 1024 * 1664525 + x * 69069 + 1013904223) % 2147483648
    return x * n // 2147483648


def resampled(n: int, block: int, reps: np.ndarray, seed: int) -> np.ndarray:
    """Places of each replicate of a series of ``n`` values: circular blocks, cut to its length."""
    starts = block_starts(n, -(-n // block), reps, seed)
    return ((starts[:, :, None] + np.arange(block)) % n).reshape(len(reps), -1)[:, :n]


def block_bootstrap(values: np.ndarray, block: int, reps: int, seed: int, rows: int = 2_000_000) -> np.ndarray:
    """Means of ``reps`` resamples made of circular blocks, a bounded number of values at a time."""
    step = max(1, rows // max(1, len(values)))
    return np.concatenate([values[resampled(len(values), block, np.arange(a, min(reps, a + step)), seed)].mean(axis=1) for a in range(0, reps, step)])


def bootstrap_interval(rows: DataFrame, period: str, value: str, by: str, *, block: int = 4, reps: int = 10_000, seed: int = 7) -> DataFrame:
    """``(by, mean, low, high)``: 2.5 and 97.5 % quantiles of circular block bootstrap means of a series of periods."""
    kind = dict(rows.dtypes)[by]
    ship(rows.sparkSession)

    def run(part: pd.DataFrame) -> pd.DataFrame:
        x = part.sort_values(period)[value].to_numpy(float)
        means = block_bootstrap(x, block, reps, seed)
        return pd.DataFrame({by: [part[by].iloc[0]], "mean": [x.mean()], "low": [np.quantile(means, 0.025)], "high": [np.quantile(means, 0.975)]})

    return rows.select(by, period, value).groupBy(by).applyInPandas(run, f"{by} {kind}, mean double, low double, high double")


def spearman_bootstrap(panel: DataFrame, period: str, train: str, *, block: int = 4, reps: int = 500, seed: int = 7) -> DataFrame:
    """``(replicate, rho)``: Spearman correlations of training means with resampled holdout means.

    ``panel`` holds (period, node_id, prize, train). A replicate draws periods in circular blocks of their order; the
    draws follow from the number of periods, so a node's resampled means follow from its own series (a period without
    the node counts as one without a value), and nodes of equal training means and series are resampled once, with their
    number. Ranks among the nodes come from counts by value in ranges, and the correlations from sums, so no task holds
    the panel or a replicate. Means are rounded to nine decimals before they are ranked.
    """
    with scratch():
        periods = panel.select(period).distinct().withColumn("at", F.row_number().over(Window.orderBy(period)) - 1)  # a series' length
        periods = written(periods, "periods")
        n = periods.count()
        ship(panel.sparkSession)
        series = panel.join(small(periods), period).groupBy("node_id").agg(F.max(F.round(train, 9)).alias("train"), F.array_sort(F.collect_list(F.struct("at", "prize"))).alias("series"))
        kinds = series.where("train is not null").groupBy("train", "series").agg(F.count("*").alias("count__"))
        kinds = kinds.select("train", F.transform("series", lambda v: v["at"]).alias("at"), F.transform("series", lambda v: v["prize"].cast("double")).alias("prize"), "count__")

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            step = max(1, _LAID_OUT // max(1, n))
            for part in batches:
                for at, prize, train_, count in zip(part["at"], part["prize"], part["train"], part["count__"], strict=True):
                    x = np.full(n, np.nan)
                    x[np.asarray(at)] = np.asarray(prize, float)
                    means = np.concatenate([x[resampled(n, block, np.arange(a, min(reps, a + step)), seed)].mean(axis=1) for a in range(0, reps, step)])
                    yield pd.DataFrame({"train": train_, "replicate": np.arange(reps), "mean": np.round(means, 9), "count__": count})

        means = kinds.mapInPandas(run, "train double, replicate long, mean double, count__ long")
        means = written(means.where("mean is not null and not isnan(mean)").groupBy("replicate", "train", "mean").agg(F.sum("count__").alias("count__")), "means")
        by_train = _midranks(means.groupBy("train", "replicate").agg(F.sum("count__").alias("count__")), ["replicate"], "train", "rank_train")
        by_mean = _midranks(means.groupBy("mean", "replicate").agg(F.sum("count__").alias("count__")), ["replicate"], "mean", "rank_mean")
        middle = means.groupBy("replicate").agg(((F.sum("count__") + 1) / 2).alias("middle"))  # the mean of the ranks
        ranked = means.join(by_train, ["replicate", "train"]).join(by_mean, ["replicate", "mean"]).join(F.broadcast(middle), "replicate")
        x, y, w = F.col("rank_train") - F.col("middle"), F.col("rank_mean") - F.col("middle"), F.col("count__")
        sums = ranked.groupBy("replicate").agg(F.sum(w * x * y).alias("xy"), F.sum(w * x * x).alias("xx"), F.sum(w * y * y).alias("yy"))
        rho = F.try_divide(F.col("xy"), F.sqrt(F.col("xx") * F.col("yy")))
        return written(sums.select("replicate", rho.alias("rho")), "rho", keep=True)


#: Values of one node's resamples that are laid out at once.
_LAID_OUT = 2_000_000


def _midranks(per_value: DataFrame, by: list[str], value: str, name: str) -> DataFrame:
    """``(by, value, name)``: the mean rank of each value's rows in its group, from counts by value."""
    before = counts_before(per_value, by, value, "count__", "before__")
    return before.select(*by, value, (F.col("before__") + (F.col("count__") + 1) / 2).alias(name))


def student_tail(t: float, df: float) -> float:
    """P(T > t), by the incomplete beta function's continued fraction."""
    if df <= 0:
        return 1.0
    x = df / (df + t * t)
    half = 0.5 * incomplete_beta(df / 2, 0.5, x)
    return half if t > 0 else 1 - half


def incomplete_beta(a: float, b: float, x: float) -> float:
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - incomplete_beta(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log(1 - x)) / a
    c, d = 1.0, 1 / max(1e-300, 1 - (a + b) * x / (a + 1))
    value = d
    for m in range(1, 300):
        for top in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / (1 + top * d or 1e-300)
            c = 1 + top / c or 1e-300
            value *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return front * value


def correlation_p(rho: float, n: int) -> float:
    """Two-sided p-value of a rank correlation by Student's law."""
    if n < 3 or abs(rho) >= 1:
        return 0.0 if n >= 3 else 1.0
    return min(1.0, 2 * student_tail(abs(rho) * math.sqrt((n - 2) / (1 - rho * rho)), n - 2))


def top_share(rows: DataFrame, rank_by: str, amount: str, key: str, share: float = 0.2) -> DataFrame:
    """One row: the part of ``amount`` that the top ``ceil(share * n)`` rows by ``rank_by`` hold, and its lift."""
    n = rows.count()
    k = math.ceil(share * n - 1e-9)
    top = rows.orderBy(F.desc(rank_by), key).limit(k)  # a top-k report
    held = top.agg(F.coalesce(F.sum(amount), F.lit(0.0)).alias("held")).crossJoin(rows.agg(F.coalesce(F.sum(amount), F.lit(0.0)).alias("whole")))
    part = ratio_or_one(F.col("held"), F.col("whole"))
    return held.select(F.lit(k).cast("long").alias("k"), part.alias("share"), (part / F.lit(k / n if n else 1.0)).alias("lift"))


def rank_quintiles(rows: DataFrame, value: str, key: str) -> DataFrame:
    """``rows`` with ``quintile`` 1..5: linear quantile edges over the ranks 1..n of ``value`` (ties by key).

    Ranks come from counts of values and a rank inside one value, so no window holds all rows.
    """
    per = rows.groupBy(F.col(value).alias("value__")).agg(F.count("*").alias("count__"))
    before = counts_before(per, [], "value__", "count__", "before__").drop("count__")
    placed = rows.join(before, rows[value] == F.col("value__")).drop("value__")
    inside = F.row_number().over(Window.partitionBy(value).orderBy(key))
    n = rows.count()
    rank = F.col("before__") + inside
    bin_ = F.lit(1)
    for i in range(1, 5):
        bin_ = bin_ + F.when(rank > F.lit(1 + (n - 1) * i / 5), 1).otherwise(0)
    return placed.withColumn("quintile", bin_).drop("before__")


def tiles(rows: DataFrame, value: str, key: str, count: int, name: str) -> DataFrame:
    """``rows`` with ``name``: which of ``count`` near-equal parts of the order of (value, key) a row lies in, from 1.

    The first parts hold the surplus, as ntile deals it; ranks come from counts of values and a rank inside one value.
    """
    per = rows.groupBy(F.col(value).alias("value__")).agg(F.count("*").alias("count__"))
    before = counts_before(per, [], "value__", "count__", "before__").drop("count__")
    rank = F.col("before__") + F.row_number().over(Window.partitionBy(value).orderBy(key)) - 1
    n = rows.count()
    size, surplus = divmod(n, count)
    large = surplus * (size + 1)
    tile = F.when(rank < large, F.floor(rank / F.lit(size + 1))).otherwise(F.lit(surplus) + F.floor((rank - F.lit(large)) / F.lit(max(1, size))))
    return rows.join(before, rows[value].eqNullSafe(F.col("value__"))).withColumn(name, (tile + 1).cast("int")).drop("value__", "before__")


def certified_gaps(records: DataFrame, references: DataFrame, key: str, value: str) -> DataFrame:
    """``records`` with ``gap``: percent over the proven optimum, else over the lower bound, else null.

    ``references`` holds (key, optimum, bound).
    """
    joined = records.join(references, key, "left")
    ref = F.coalesce("optimum", "bound")
    return joined.withColumn("gap", F.when(ref != 0, (F.col(value) - ref) / ref * 100.0)).drop("optimum", "bound")


def complete_groups(rows: DataFrame, by: str, member: str, wanted: int) -> DataFrame:
    """Groups that hold ``wanted`` different members."""
    return rows.groupBy(by).agg(F.count_distinct(member).alias("members")).where(F.col("members") == wanted).select(by)


def ranges(rows: DataFrame, by: str, values: list[str]) -> DataFrame:
    made = [f(v).alias(f"{v}_{n}") for v in values for n, f in (("min", F.min), ("max", F.max))]
    return rows.groupBy(by).agg(*made)


def removal_savings(routes: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Every stop with the length that leaving it out saves: both of its legs less the one that replaces them."""
    keys = [*(by or []), "vehicle"]
    order = Window.partitionBy(*keys).orderBy("pos")
    zero = F.lit(0.0)
    near = {f"{p}{c}": F.coalesce(f(c).over(order), zero) for p, f in (("p", F.lag), ("n", F.lead)) for c in ("x", "y")}
    wide = routes.withColumns(near)
    leg = lambda a, b: F.sqrt((F.col(f"{a}x") - F.col(f"{b}x")) ** 2 + (F.col(f"{a}y") - F.col(f"{b}y")) ** 2)
    return wide.withColumn("saving", (leg("p", "") + leg("", "n") - leg("p", "n")) * 100.0).drop(*near)


#: Positions and legs that one task of the insertion costs compares, how many of each at a time, and by how much costs that
#: round alike to nine places can differ.
POSITIONS, LEGS = 8_192, 65_536
POSITION_BLOCK, LEG_BLOCK = 64, 1_024
ROUNDING = 1.5e-9


def insertion_costs(routes: DataFrame, nodes: DataFrame, by: list[str] | None = None) -> DataFrame:
    """``(by, node_id, added, vehicle, pos)``: for each node its cheapest place in the routes, before the stop at ``pos`` (one
    more than the last for the way home); of equal ones the first vehicle and place.

    ``routes`` holds (by, vehicle, pos, x, y), ``nodes`` (by, node_id, x, y). Different positions meet different legs of
    their plan, a bounded number of each in one task; nodes at one position and legs between the same two count once.
    """
    by = by or []
    order = Window.partitionBy(*by, "vehicle").orderBy("pos")
    zero = F.lit(0.0)
    legs = routes.select(*by, "vehicle", "pos", F.coalesce(F.lag("x").over(order), zero).alias("ax"), F.coalesce(F.lag("y").over(order), zero).alias("ay"), F.col("x").alias("bx"), F.col("y").alias("by_"))
    home = routes.groupBy(*by, "vehicle").agg(F.max(F.struct("pos", "x", "y")).alias("l")).select(*by, "vehicle", (F.col("l.pos") + 1).alias("pos"), F.col("l.x").alias("ax"), F.col("l.y").alias("ay"), zero.alias("bx"), zero.alias("by_"))
    ends = ["ax", "ay", "bx", "by_"]
    every = legs.unionByName(home).groupBy(*by, *ends).agg(F.min(F.struct("vehicle", "pos")).alias("first")).select(*by, *ends, "first.vehicle", "first.pos")
    places = nodes.select(*by, "x", "y").distinct()
    tiles, parts = (t.groupBy(*by).agg(F.ceil(F.count("*") / most).alias(c)) for t, most, c in ((places, POSITIONS, "tiles"), (every, LEGS, "parts")))
    sizes = tiles.join(parts, by) if by else tiles.crossJoin(parts).where("tiles > 0 and parts > 0")
    sized = lambda t: t.join(sizes, by) if by else t.crossJoin(F.broadcast(sizes))
    dealt = lambda columns, n: F.pmod(F.xxhash64(*columns), F.col(n))
    all_of = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    left = sized(places).select(*by, "x", "y", dealt(["x", "y"], "tiles").alias("tile"), all_of("parts").alias("part"))
    right = sized(every).select(*by, *ends, "vehicle", "pos", dealt(ends, "parts").alias("part"), all_of("tiles").alias("tile"))
    keys = [*by, "tile", "part"]
    kept = [*by, "x", "y", "added", "vehicle", "pos"]
    schema = left.select(*by, "x", "y", F.lit(0.0).alias("added")).crossJoin(right.select("vehicle", "pos")).schema
    for f in schema:
        f.nullable = True
    ship(nodes.sparkSession)

    def run(points: pd.DataFrame, part: pd.DataFrame) -> pd.DataFrame:
        if points.empty or part.empty:
            return pd.DataFrame({c: pd.Series(dtype=object) for c in kept})
        found = cheapest_legs(points[["x", "y"]].to_numpy(float), part[ends].to_numpy(float), part[["vehicle", "pos"]].reset_index(drop=True))
        at = points.reset_index(drop=True).loc[found.pop("place"), [*by, "x", "y"]].reset_index(drop=True)
        return pd.concat([at, found], axis=1)[kept]

    made = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(run, schema)
    last = F.struct(F.col("added").isNull(), F.round("added", 9).alias("added"), "vehicle", "pos")  # unknown costs come last
    best = made.groupBy(*by, "x", "y").agg(F.min(last).alias("b"))
    other = best.select(*[F.col(c).alias(f"{c}_of") for c in by], F.col("x").alias("x_of"), F.col("y").alias("y_of"), "b")
    same = F.col("x").eqNullSafe(F.col("x_of")) & F.col("y").eqNullSafe(F.col("y_of"))
    for c in by:
        same = same & (F.col(c) == F.col(f"{c}_of"))
    return nodes.join(other, same).groupBy(*by, "node_id").agg(F.min("b").alias("b")).select(*by, "node_id", "b.added", "b.vehicle", "b.pos")


def cheapest_legs(xy: np.ndarray, legs: np.ndarray, names: pd.DataFrame) -> pd.DataFrame:
    """``(place, added, vehicle, pos)``: for each row of ``xy`` the least cost added to a leg (ax, ay, bx, by), and the others
    that round like it; of equal costs the first ``names`` (vehicle, pos). A place without a known cost has the first leg."""
    order = names.sort_values(["vehicle", "pos"]).index.to_numpy()
    legs, names = legs[order], names.loc[order].reset_index(drop=True)
    whole, placed = np.flatnonzero(~np.isnan(legs).any(axis=1)), np.flatnonzero(~np.isnan(xy).any(axis=1))
    ax, ay, bx, by_ = legs[whole].T
    length = np.sqrt((ax - bx) * (ax - bx) + (ay - by_) * (ay - by_))
    best = np.full(len(xy), np.inf)
    known: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = [(np.arange(len(xy)), np.full(len(xy), np.inf), np.zeros(len(xy), int))]
    for p in range(0, len(placed), POSITION_BLOCK):
        rows = placed[p : p + POSITION_BLOCK]
        x, y = xy[rows, :1], xy[rows, 1:]
        for k in range(0, len(whole), LEG_BLOCK):
            at = slice(k, k + LEG_BLOCK)
            dx, dy, ex, ey = ax[at] - x, ay[at] - y, x - bx[at], y - by_[at]
            added = (np.sqrt(dx * dx + dy * dy) + np.sqrt(ex * ex + ey * ey) - length[at]) * 100.0
            low = added.min(axis=1)
            near = np.flatnonzero(low <= best[rows] + ROUNDING)
            best[rows] = np.minimum(best[rows], low)
            added = added[near]
            i, j = np.nonzero(added <= best[rows[near]][:, None] + ROUNDING)
            cost = added[i, j]
            first = np.lexsort((j, cost, i))
            i, j, cost = i[first], j[first], cost[first]
            new = np.ones(len(i), bool)
            new[1:] = (i[1:] != i[:-1]) | (cost[1:] != cost[:-1])
            known.append((rows[near[i[new]]], cost[new], whole[j[new] + k]))
    place, cost, leg = (np.concatenate(c) for c in zip(*known, strict=True))
    close = (cost <= best[place] + ROUNDING) & ((cost < np.inf) | np.isinf(best[place]))
    made = pd.DataFrame({"place": place, "added": cost, "leg": leg})[close].sort_values(["place", "added", "leg"]).drop_duplicates(["place", "added"])
    made["added"] = made["added"].where(made["added"] < np.inf)
    return pd.concat([made[["place", "added"]].reset_index(drop=True), names.loc[made["leg"]].reset_index(drop=True)], axis=1)
