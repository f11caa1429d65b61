"""Clusters of a stream of inserted and deleted points, on the stream's state store."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from patrolkit.operators.cluster import buckets
from patrolkit.operators.forest import refolded
from patrolkit.plans.shared_tables import scratch, ship, written

from .batches import IncrementalClusters

_KEYS = ["j", "cx", "cy"]
_EVENT = "kind string, event_id long, lon double, lat double, net long, j int, cx long, cy long"


def bucket_changes(stream: DataFrame, eps: float, min_samples: int, etas: list[float]) -> DataFrame:
    """``(kind, event_id, lon, lat, net, j, cx, cy)`` of a stream of changes ``(op, event_id, lon, lat)``.

    ``point`` rows say how often a point came (net 1) or went (-1); ``bucket`` rows that a bucket became full (net 1) or
    ceased to be (-1). The state of a bucket is its number of live points, so it stays one number however many points
    it holds; a batch touches the state of the buckets that its points hit. A point may go before it comes (late data).
    """
    ship(stream.sparkSession)
    cells = F.array(*[F.struct(F.lit(j).alias("j"), F.floor((F.col("lon") + F.lit(e)) / F.lit(2 * eps)).alias("cx"), F.floor((F.col("lat") + F.lit(e)) / F.lit(2 * eps)).alias("cy")) for j, e in enumerate(etas)])
    keyed = stream.select(F.when(F.col("op") == "insert", 1).otherwise(-1).alias("net"), "event_id", "lon", "lat", F.explode(cells).alias("b"))
    keyed = keyed.select("net", "event_id", "lon", "lat", "b.j", "b.cx", "b.cy")

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        (held,) = state.get if state.exists else (0,)
        now = held
        for rows in parts:  # the pieces of one batch's points of one bucket
            now += int(rows["net"].sum())
            if key[0] == 0:
                yield rows.assign(kind="point", j=0, cx=0, cy=0)[_COLUMNS]
        state.update((now,))
        if (now >= min_samples) != (held >= min_samples):
            yield pd.DataFrame([("bucket", 0, 0.0, 0.0, 1 if now >= min_samples else -1, *key)], columns=_COLUMNS)

    return keyed.groupBy(*_KEYS).applyInPandasWithState(step, _EVENT, "held long", "append", GroupStateTimeout.NoTimeout)


_COLUMNS = [c.split()[0] for c in _EVENT.split(", ")]


class ChangingClusters(IncrementalClusters):
    """Clusters of a stream of inserts and deletes, by the rule of :class:`IncrementalClusters` over the live points.

    Batches are logged as folders, so a repeated batch replaces itself and a new object goes on where an old one ended.
    ``labels`` works the changes since its last call into the clusters: components that lost a core are folded anew from
    the buckets that their cores still share, new cores join by the buckets that they share, and all others stay.
    """

    def take(self, events: DataFrame, batch: int) -> None:
        events = events.persist()
        self._log("points", events.where("kind = 'point'").select("event_id", "lon", "lat", "net"), batch)
        self._log("full", events.where("kind = 'bucket'").select("j", "cx", "cy", "net"), batch)
        events.unpersist()
        self.progress.append({"batch": batch})

    def _events(self, stream: DataFrame) -> DataFrame:
        return bucket_changes(stream, self.eps, self.k, self.etas)

    def live(self) -> DataFrame:
        """``(event_id, lon, lat)`` of the points that came more often than they went."""
        log = self._read("points", "event_id long, lon double, lat double, net long")
        return log.groupBy("event_id", "lon", "lat").agg(F.sum("net").alias("net")).where("net > 0").drop("net")

    def _fold(self) -> tuple[DataFrame, DataFrame]:
        """``(cores with labels, buckets with labels)`` of the live points."""
        last = self._read("points", "event_id long, net long").agg(F.max("batch")).first()[0]
        folds, none = self._folds(), "event_id long, label long"
        known = max(folds, default=-1)
        path = f"{self.folder}/folded/cores"
        old = self.spark.read.schema(none).parquet(f"{path}-{known}") if folds else self.spark.createDataFrame([], none)
        with scratch():
            held = written(buckets(self.live(), self.eps, self.etas), "live_buckets")
            full = self._read("full", "j int, cx long, cy long, net long").groupBy(*_KEYS).agg(F.sum("net").alias("net")).where("net > 0").select(*_KEYS)
            if last is None or last == known:
                return old, written(held.join(old, "event_id").groupBy(*_KEYS).agg(F.min("label").alias("label")), "leads", keep=True)
            cores = written(held.join(full, _KEYS, "left_semi").select(F.col("event_id").alias("node")).distinct(), "cores")
            at = written(held.join(cores, held.event_id == cores.node, "left_semi"), "core_buckets")
            before = old.select(F.col("event_id").alias("node"), "label")
            touched = before.join(cores, "node", "left_anti").select("label").distinct()
            kept = written(before.join(touched, "label", "left_anti").select("node", "label"), "kept")
            loose = written(cores.join(kept, "node", "left_anti"), "loose")
            # in each bucket, loose cores and the components of kept ones meet
            names = at.join(kept, at.event_id == kept.node, "left").select(*_KEYS, F.coalesce("label", "event_id").alias("name")).distinct()
            lead = names.groupBy(*_KEYS).agg(F.min("name").alias("lead"), F.count("*").alias("n")).where("n > 1")
            links = names.join(lead, _KEYS).select(F.col("name").alias("src"), F.col("lead").alias("dst"))
            refolded(kept, loose, links).select(F.col("node").alias("event_id"), "label").write.mode("overwrite").parquet(f"{path}-{last}")
            self.spark.createDataFrame([(last,)], "batch int").write.mode("append").parquet(f"{self.folder}/folded/done")
            now = self.spark.read.schema(none).parquet(f"{path}-{last}")
            leads = at.join(now, "event_id").groupBy(*_KEYS).agg(F.min("label").alias("label"))
            return now, written(leads, "leads", keep=True)

    def _points(self) -> DataFrame:
        return self.live().withColumn("batch", F.lit(0))
