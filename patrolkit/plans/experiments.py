"""Experiment harness: registries of algorithms and evaluators, parameter grids, trials that resume, result tables."""

from __future__ import annotations

import inspect
import itertools
import time
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Dataset:
    """A named table of points with what it promises: its columns, and where its true labels stand (if it has any)."""

    name: str
    points: DataFrame
    label: str | None = None

    def __post_init__(self):
        if self.label is not None and self.label not in self.points.columns:
            raise TypeError(f"{self.name} has no column {self.label}")


def _columns_of(df: DataFrame) -> set[str]:
    return {f"{n} {t}" for n, t in df.dtypes} | set(df.columns)


@dataclass(frozen=True)
class Algorithm:
    """A named function from a table of points and parameters to labelled points, or to such a table for each iteration.

    ``needs`` are columns of the points and ``gives`` columns of the result, by name or as "name type"; a table that
    lacks one is a TypeError.
    """

    name: str
    run: Callable[..., DataFrame | Iterable[DataFrame]]
    needs: tuple[str, ...] = ()
    gives: tuple[str, ...] = ()

    def parameters(self) -> list[str]:
        return list(inspect.signature(self.run).parameters)[1:]

    def accept(self, points: DataFrame) -> None:
        if lacking := set(self.needs) - _columns_of(points):
            raise TypeError(f"{self.name} needs columns {sorted(lacking)}")

    def checked(self, result: object) -> DataFrame:
        if not isinstance(result, DataFrame):
            raise TypeError(f"{self.name} gave {type(result).__name__} instead of a table")
        if lacking := set(self.gives) - _columns_of(result):
            raise TypeError(f"{self.name} promised columns {sorted(lacking)}")
        return result


@dataclass(frozen=True)
class Evaluator:
    """A named function from (points, labelled points) to one number; ``needs`` are columns of the labelled points."""

    name: str
    run: Callable[[DataFrame, DataFrame], float]
    needs: tuple[str, ...] = ()

    def accept(self, labelled: DataFrame) -> None:
        if lacking := set(self.needs) - _columns_of(labelled):
            raise TypeError(f"{self.name} needs columns {sorted(lacking)}")


@dataclass
class Suite:
    """All combinations of data sets, algorithms and their parameters; columns are checked before anything runs.

    A parameter's values may be a list, one value, or a function of the fixed parameters. ``run`` yields one record a
    trial, skipping trials that ``done`` holds.
    """

    datasets: dict[str, DataFrame | Dataset]
    algorithms: dict[Algorithm, dict[str, object]]
    evaluators: list[Evaluator] = field(default_factory=list)
    runs: int = 1

    def __post_init__(self):
        for algorithm, given in self.algorithms.items():
            unknown = set(given) - set(algorithm.parameters())
            if unknown:
                raise ValueError(f"{algorithm.name} has no parameters {sorted(unknown)}")
            for data in self.datasets.values():
                algorithm.accept(data.points if isinstance(data, Dataset) else data)

    def trials(self) -> Iterable[dict]:
        number = 0
        for run, data, (algorithm, given) in itertools.product(range(self.runs), self.datasets, self.algorithms.items()):
            fixed = {k: v for k, v in given.items() if not callable(v)}
            lists = [v if isinstance(v, (list, tuple)) else [v] for v in fixed.values()]
            for values in itertools.product(*lists):
                chosen = dict(zip(fixed, values, strict=True))
                chosen |= {k: v(chosen) for k, v in given.items() if callable(v)}
                yield {"trial_id": number, "run_id": run, "dataset": data, "algorithm": algorithm, "parameters": chosen}
                number += 1

    def run(self, done: Iterable[int] = ()) -> Iterable[dict]:
        finished = set(done)
        for trial in self.trials():
            if trial["trial_id"] in finished:
                continue
            data = self.datasets[trial["dataset"]]
            points = data.points if isinstance(data, Dataset) else data
            head = {"trial_id": trial["trial_id"], "run_id": trial["run_id"], "dataset": trial["dataset"], "algorithm": trial["algorithm"].name}
            head |= {f"p_{k}": str(v) for k, v in trial["parameters"].items()}
            began = turn = time.perf_counter()
            made = trial["algorithm"].run(points, **trial["parameters"])
            steps = [made] if isinstance(made, DataFrame) or not isinstance(made, Iterable) else made
            for iteration, result in enumerate(steps):
                labelled = trial["algorithm"].checked(result)
                count, now = labelled.count(), time.perf_counter()
                for e in self.evaluators:
                    e.accept(labelled)
                scores = {e.name: float(e.run(points, labelled)) for e in self.evaluators}
                yield head | {"iteration": iteration, "rows": count, "iteration_seconds": now - turn, "seconds": now - began} | scores
                turn = time.perf_counter()


def results(spark: SparkSession, records: Iterable[dict]) -> DataFrame:
    """Records as a table; a parameter that only some algorithms have is null elsewhere."""
    rows = list(records)
    names = list(dict.fromkeys(k for r in rows for k in r))
    kinds = {n: "double" if any(isinstance(r.get(n), float) for r in rows) else "long" if any(isinstance(r.get(n), int) for r in rows) else "string" for n in names}
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], ", ".join(f"`{n}` {kinds[n]}" for n in names))


def grid(spark: SparkSession, **values: list) -> DataFrame:
    """All combinations of small value lists as a table."""
    out = None
    for name, items in values.items():
        one = spark.createDataFrame([(v,) for v in items], [name])
        out = one if out is None else out.crossJoin(one)
    return out


def final_rows(records: DataFrame, key: str, order: str) -> DataFrame:
    """The last record of each key."""
    return records.groupBy(key).agg(F.max_by(F.struct(*[c for c in records.columns if c != key]), order).alias("last")).select(key, "last.*")


def select_parameters(candidates: DataFrame, least_coverage: float = 85.0) -> DataFrame:
    """One row: the smallest scale whose coverage suffices, then least tail, mean and travel; else the best coverage."""
    fits = F.col("coverage_pct") >= least_coverage
    order = [F.desc(fits), F.when(fits, F.col("scale")), F.when(~fits, -F.col("coverage_pct")), "cvar_cost", "mean_cost", "travel"]
    return candidates.orderBy(*order).limit(1)


def refinement_pairs(candidates: DataFrame, least_coverage: float = 85.0, band: float = 1.6, most: int = 8) -> DataFrame:
    """The best ``most`` settings whose scale lies within ``band`` of the first that suffices."""
    first = candidates.where(F.col("coverage_pct") >= least_coverage).agg(F.min("scale").alias("first_scale"))
    near = candidates.crossJoin(F.broadcast(first)).where(F.col("scale").between(F.col("first_scale") / band, F.col("first_scale") * band))
    return near.orderBy("cvar_cost", "mean_cost", "scale", "epsilon").limit(most).drop("first_scale")


def best_epsilon(validation: DataFrame, rule: str = "mean") -> DataFrame:
    """One row: the radius of least validation mean, ties to the smaller; or (``tail``) of least tail, mean, radius and travel."""
    order = {"mean": ["validation_mean_cost", "epsilon"], "tail": ["validation_cvar90", "validation_mean_cost", "epsilon", "travel_cost"]}[rule]
    return validation.orderBy(*order).limit(1)


def gap_buckets(results_: DataFrame) -> DataFrame:
    """Mean gap by instance size (up to 200, up to 500, more) and over all."""
    size = F.when(F.col("n") <= 200, "0-200").when(F.col("n") <= 500, "200-500").otherwise("500+")
    each = results_.groupBy(size.alias("bucket")).agg(F.count("*").alias("instances"), F.avg("gap").alias("mean_gap"))
    return each.unionByName(results_.agg(F.lit("all").alias("bucket"), F.count("*").alias("instances"), F.avg("gap").alias("mean_gap")))


def gap_statistics(results_: DataFrame, by: str) -> DataFrame:
    return results_.groupBy(by).agg(
        F.avg("gap").alias("mean_gap"), F.stddev_pop("gap").alias("std_gap"), F.min("gap").alias("min_gap"), F.max("gap").alias("max_gap"),
        F.avg("cost").alias("mean_cost"), F.count("cost").alias("solved"), F.count("*").alias("instances"),
    )
