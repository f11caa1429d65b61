"""Streams of ping batches: batch tables, incremental clustering by micro-batch, and windowed counts."""

from __future__ import annotations

import time
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from patrolkit.operators.cluster import buckets, dbscan
from patrolkit.operators.components import components
from patrolkit.operators.sampling import draw
from patrolkit.plans.shared_tables import ship, written


def as_batches(points: DataFrame, size: int = 1000, order: str = "shuffled") -> DataFrame:
    """``points`` with ``batch``: groups of about ``size`` rows, by a draw of the id or (``by label``) cluster by cluster.

    Batches come from the share of rows before a row, by counts of draws in 4096 bins and a rank within a bin, so no
    task holds all rows.
    """
    bin_ = F.floor(draw(F.col("event_id")) / (1 << 19)).cast("int")
    keys = [F.col("label")] if order == "by label" else []
    keyed = points.withColumn("bin", bin_)
    counts = keyed.groupBy(*keys, "bin").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy(*keys, "bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    start = counts.withColumn("start", before).drop("n")
    names = [*(["label"] if keys else []), "bin"]
    rank = F.row_number().over(Window.partitionBy(*names).orderBy(draw(F.col("event_id")), "event_id"))
    placed = keyed.withColumn("rank", rank).join(start, names)
    return placed.withColumn("batch", F.floor((F.col("start") + F.col("rank") - 1) / size)).select(*points.columns, "batch")


def live_labels(changes: DataFrame, labels: DataFrame) -> DataFrame:
    """``(iter, n, classes)``: live points and their true classes after each change ``(iter, op, id)``."""
    step = changes.join(labels, changes["id"] == labels["event_id"]).groupBy("iter", "label").agg(F.sum(F.when(F.col("op") == "insert", 1).otherwise(-1)).alias("delta"))
    iters = changes.select("iter").distinct()
    grid = iters.crossJoin(F.broadcast(step.select("label").distinct()))
    line = Window.partitionBy("label").orderBy("iter")
    running = grid.join(step, ["iter", "label"], "left").withColumn("n", F.sum(F.coalesce("delta", F.lit(0))).over(line))
    return running.groupBy("iter").agg(F.sum("n").alias("n"), F.count_if(F.col("n") > 0).alias("classes"))


_STATE = "n long, ids array<long>, lons array<double>, lats array<double>"
_EVENT = "kind string, event_id long, lon double, lat double"


def bucket_events(stream: DataFrame, eps: float, min_samples: int, etas: list[float]) -> DataFrame:
    """``(kind, event_id, lon, lat)`` of a stream of points: every point once, and every point that became a core.

    State is kept by bucket in the stream's state store: its number of points and, while it is not full, those points.
    A batch reads and writes the state of the buckets that it hits and of no other. When a bucket fills, all its points
    become cores; later points of a full bucket are cores at once. A point may become a core in several buckets.
    """
    ship(stream.sparkSession)
    cells = F.array(*[F.struct(F.lit(j).alias("j"), F.floor((F.col("lon") + F.lit(e)) / F.lit(2 * eps)).alias("cx"), F.floor((F.col("lat") + F.lit(e)) / F.lit(2 * eps)).alias("cy")) for j, e in enumerate(etas)])
    keyed = stream.select("event_id", "lon", "lat", F.explode(cells).alias("b")).select("event_id", "lon", "lat", "b.j", "b.cx", "b.cy")

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, *waiting = state.get if state.exists else (0, [], [], [])
        rows = pd.concat(list(parts))[["event_id", "lon", "lat"]]  # one batch's points of one bucket
        held = pd.DataFrame({"event_id": list(waiting[0]), "lon": list(waiting[1]), "lat": list(waiting[2])})
        n += len(rows)
        every = pd.concat([held, rows]) if len(held) else rows
        out = []
        if key[0] == 0:
            out.append(rows.assign(kind="point"))
        if n >= min_samples:
            out.append(every.assign(kind="core"))
            every = every.iloc[:0]
        state.update((n, every["event_id"].astype(int).tolist(), every["lon"].tolist(), every["lat"].tolist()))
        if out:
            yield pd.concat(out)[["kind", "event_id", "lon", "lat"]].astype({"event_id": "int64"})

    return keyed.groupBy("j", "cx", "cy").applyInPandasWithState(step, _EVENT, _STATE, "append", GroupStateTimeout.NoTimeout)


class IncrementalClusters:
    """Clusters of an insert-only stream: cores that share a shifted bucket are connected.

    A batch costs what its points' buckets hold (:func:`bucket_events`) and appends its points and new cores to logs
    under ``folder``, one folder a batch, so that a batch that is repeated after a failure replaces itself. ``labels``
    folds the cores since its last call into the clusters so far. Everything lies in ``folder`` and the stream's
    checkpoint, so a new object over the same folders goes on where an old one ended. With ``burn_in`` the cores are those
    of the first batches; later points take the label of a core in the first bucket that holds one.
    """

    def __init__(self, spark: SparkSession, folder: str, eps: float, min_samples: int, etas: list[float], burn_in: int | None = None):
        self.spark, self.folder, self.eps, self.k, self.etas, self.burn_in = spark, folder.rstrip("/"), eps, min_samples, etas, burn_in
        self.progress: list[dict] = []

    def _log(self, name: str, df: DataFrame, batch: int) -> None:
        df.write.mode("overwrite").parquet(f"{self.folder}/{name}/batch={batch}")

    def _read(self, name: str, schema: str) -> DataFrame:
        whole = f"{schema}, batch int"
        try:
            return self.spark.read.schema(whole).parquet(f"{self.folder}/{name}")
        except Exception as error:  # noqa: BLE001  nothing was logged yet
            if "PATH_NOT_FOUND" not in str(error):
                raise
            return self.spark.createDataFrame([], whole)

    def take(self, events: DataFrame, batch: int) -> None:
        """Logs one micro-batch of :func:`bucket_events`."""
        began = time.perf_counter()
        events = events.persist()
        self._log("points", events.where("kind = 'point'").select("event_id", "lon", "lat"), batch)
        if self.burn_in is None or batch < self.burn_in:
            self._log("cores", events.where("kind = 'core'").select("event_id", "lon", "lat").distinct(), batch)
        events.unpersist()
        self.progress.append({"batch": batch, "seconds": time.perf_counter() - began})

    def attach(self, stream: DataFrame, checkpoint: str) -> StreamingQuery:
        """Feeds a streaming table of points ``(event_id, lon, lat)``, one micro-batch at a time."""
        return self._events(stream).writeStream.foreachBatch(self.take).outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

    def _events(self, stream: DataFrame) -> DataFrame:
        return bucket_events(stream, self.eps, self.k, self.etas)

    def _points(self) -> DataFrame:
        return self._read("points", "event_id long, lon double, lat double")

    def _fold(self) -> tuple[DataFrame, DataFrame]:
        """``(cores with labels, buckets with labels)``, with the cores since the last fold worked in."""
        kept, known = f"{self.folder}/folded", -1
        folds = [f for f in self._folds() if f >= 0]
        if folds:
            known = max(folds)
            old = self.spark.read.schema("event_id long, label long").parquet(f"{kept}/cores-{known}")
            leads = self.spark.read.schema("j int, cx long, cy long, label long").parquet(f"{kept}/leads-{known}")
        else:
            old = self.spark.createDataFrame([], "event_id long, label long")
            leads = self.spark.createDataFrame([], "j int, cx long, cy long, label long")
        log = self._read("cores", "event_id long, lon double, lat double")
        last = log.agg(F.max("batch")).first()[0]
        if last is None or last == known:
            return old, leads
        fresh = log.where(F.col("batch") > known).select("event_id", "lon", "lat").distinct()
        fresh = fresh.join(old.select("event_id"), "event_id", "left_anti")
        held = written(buckets(fresh, self.eps, self.etas), "fresh_buckets")
        own = held.groupBy("j", "cx", "cy").agg(F.min("event_id").alias("lead"))
        star = held.join(own, ["j", "cx", "cy"]).select(F.col("event_id").alias("src"), F.col("lead").alias("dst"))
        touched = own.join(leads, ["j", "cx", "cy"]).select(F.col("lead").alias("src"), F.col("label").alias("dst"))
        found = components(star.union(touched)).select("node", F.col("label").alias("merged"))
        ids = held.select("event_id").distinct()
        named = ids.join(found, ids.event_id == found.node, "left").select("event_id", F.coalesce("merged", "event_id").alias("label"))
        moved = old.join(found, old.label == found.node, "left").select("event_id", F.coalesce("merged", "label").alias("label"))
        moved.unionByName(named).write.mode("overwrite").parquet(f"{kept}/cores-{last}")
        at_leads = leads.join(found, leads.label == found.node, "left").select("j", "cx", "cy", F.coalesce("merged", "label").alias("label"))
        at_fresh = held.join(named, "event_id").select(F.col("j").cast("int").alias("j"), "cx", "cy", "label")
        at_leads.unionByName(at_fresh).groupBy("j", "cx", "cy").agg(F.min("label").alias("label")).write.mode("overwrite").parquet(f"{kept}/leads-{last}")
        self.spark.createDataFrame([(last,)], "batch int").write.mode("append").parquet(f"{kept}/done")
        return self._fold()

    def _folds(self) -> list[int]:
        try:
            return [r["batch"] for r in self.spark.read.schema("batch int").parquet(f"{self.folder}/folded/done").collect()]
        except Exception as error:  # noqa: BLE001  nothing was folded yet
            if "PATH_NOT_FOUND" not in str(error):
                raise
            return []

    def labels(self) -> DataFrame:
        """``(event_id, is_core, label)`` of all points so far; label is 1 + the smallest member, 0 for noise."""
        cores, leads = self._fold()
        points = self._points()
        frozen = F.col("batch") >= (self.burn_in if self.burn_in is not None else (1 << 31) - 1)
        rest = points.join(cores.select("event_id"), "event_id", "left_anti")
        met = buckets(rest, self.eps, self.etas).join(leads, ["j", "cx", "cy"]).groupBy("event_id").agg(F.min(F.struct("j", "label")).alias("first")).select("event_id", F.col("first.label").alias("found"))
        outer = rest.join(met, "event_id", "left").select("event_id", frozen.alias("late"), F.lit(False).alias("is_core"), F.col("found").alias("label"))
        every = cores.select("event_id", F.lit(False).alias("late"), F.lit(True).alias("is_core"), "label").unionByName(outer)
        least = every.where("label is not null and not late").groupBy("label").agg(F.min("event_id").alias("least"), F.count("*").alias("members"))
        joined = every.join(least.withColumnRenamed("label", "of"), F.col("label") == F.col("of"), "left")
        return joined.select("event_id", "is_core", F.coalesce(F.col("least") + 1, F.lit(0)).cast("long").alias("label"))


def recomputed(points: DataFrame, upto: int, eps: float, min_samples: int) -> DataFrame:
    """The baseline: exact clusters of all points of the batches up to ``upto``, from scratch."""
    return dbscan(points.where(F.col("batch") <= upto), eps, min_samples)


def windowed_counts(stream: DataFrame, at: str = "published_at", length: str = "1 hour", delay: str = "2 hours") -> DataFrame:
    """Counts by node and window of event time, with late rows up to ``delay``."""
    return stream.withWatermark(at, delay).groupBy(F.window(at, length).alias("w"), "node_id").agg(F.count("*").alias("cnt")).select(F.col("w.start").alias("period"), "node_id", "cnt")


def read_points(spark: SparkSession, path: str, schema: str, files_per_batch: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)
