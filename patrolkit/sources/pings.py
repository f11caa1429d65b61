"""Ping sources: the partitioned raw table, completeness checks, and the views over the driver's tables."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from patrolkit.plans.shared_tables import ship

RAW = T.StructType([
    T.StructField("plate_num", T.StringType()), T.StructField("published_at", T.StringType()), T.StructField("speed", T.StringType()),
    T.StructField("coord", T.StringType()), T.StructField("publish_date", T.DateType()),
])
#: The coordinate text of a ping: fixed patterns.
LON_PATTERN = r'"lon"\s*:\s*(-?\d+(?:\.\d+)?)'
LAT_PATTERN = r'"lat"\s*:\s*(-?\d+(?:\.\d+)?)'
#: Boxes of longitude and latitude: fixed values.
FINE_BOX = (103.40, 104.55, 30.10, 31.20)
COARSE_BOX = (102.0, 105.0, 29.0, 32.0)
SPEED_RANGE = (0.0, 120.0)


def raw_pings(spark: SparkSession, root: str, glob: str = "*.c000") -> DataFrame:
    """The raw table under ``root``, partitioned by publish_date; unreadable files and missing days are passed over."""
    reader = spark.read.schema(RAW).option("pathGlobFilter", glob).option("ignoreCorruptFiles", "true").option("ignoreMissingFiles", "true")
    return reader.option("basePath", root).parquet(root)


_FOOTER = "path string, rows long, first string, readable boolean"


def file_report(spark: SparkSession, root: str, glob: str = "*.c000", column: str = "published_at") -> DataFrame:
    """``(path, rows, first, readable)`` of every file, from its footer alone: the least value that the row groups state.

    Files whose footer cannot be read are listed as such, so that what a read passes over is known.
    """
    ship(spark)
    listed = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(root).select("path")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for path in batch.column("path").to_pylist():
                try:
                    where, name = fs.FileSystem.from_uri(path)
                    with where.open_input_file(name) as file:
                        meta = pq.ParquetFile(file).metadata
                    place = meta.schema.names.index(column)
                    stats = [meta.row_group(i).column(place).statistics for i in range(meta.num_row_groups)]
                    lows = [s.min for s in stats if s is not None and s.has_min_max]
                    out.append((path, meta.num_rows, str(min(lows)) if lows else None, True))
                except (OSError, ValueError, pa.ArrowException):
                    out.append((path, None, None, False))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.string(), pa.int64(), pa.string(), pa.bool_()), strict=True)], names=["path", "rows", "first", "readable"]) if out else batch.slice(0, 0)

    return listed.repartition("path").mapInArrow(run, _FOOTER)


def hours_by_footer(report: DataFrame) -> DataFrame:
    """``(path, hour)`` of readable files by their least time."""
    return report.where("readable and first is not null").select("path", F.date_trunc("hour", F.to_timestamp("first")).alias("hour"))


def duplicate_periods(by_file: DataFrame, period: str = "hour") -> DataFrame:
    """Periods that more than one file claims, with their number of files."""
    return by_file.groupBy(period).agg(F.count("*").alias("files")).where("files > 1")


def missing_days(pings: DataFrame, first: str, last: str, day: str = "publish_date") -> DataFrame:
    """Days from ``first`` to ``last`` without a row."""
    every = pings.sparkSession.sql(f"SELECT explode(sequence(date'{first}', date'{last}')) AS missing_day")
    return every.join(pings.select(F.col(day).cast("date").alias("there")).distinct(), F.col("missing_day") == F.col("there"), "left_anti")


def hours_by_file(pings: DataFrame) -> DataFrame:
    """``(file, hour)``: the hour of each file's earliest ping."""
    return pings.groupBy(F.input_file_name().alias("file")).agg(F.date_trunc("hour", F.min(F.to_timestamp("published_at"))).alias("hour"))


def period_counts(rows: DataFrame, at: str, unit: str = "hour") -> DataFrame:
    """``(period, n, status)`` for every period from the first to the last: missing ones have n = 0."""
    seen = rows.where(F.col(at).isNotNull()).groupBy(F.date_trunc(unit, F.col(at)).alias("period")).agg(F.count("*").alias("n"))
    every = seen.agg(F.min("period").alias("a"), F.max("period").alias("b")).select(F.explode(F.expr(f"sequence(a, b, interval 1 {unit})")).alias("period"))
    return every.join(seen, "period", "left").select("period", F.coalesce("n", F.lit(0)).alias("n"), F.when(F.col("n").isNull(), "missing").otherwise("present").alias("status"))


def parsed(pings: DataFrame) -> DataFrame:
    """Raw pings with double lon, lat and speed and a timestamp; what cannot be read is null."""
    number = lambda c: F.col(c).try_cast("double")
    part = lambda p: F.regexp_extract("coord", p, 1).try_cast("double")
    return pings.withColumns({"lon": part(LON_PATTERN), "lat": part(LAT_PATTERN), "speed": number("speed"), "published_at": F.try_to_timestamp("published_at")}).drop("coord")


def within(lon: Column, lat: Column, box: tuple[float, float, float, float]) -> Column:
    return lon.between(box[0], box[1]) & lat.between(box[2], box[3])


def cleaned(pings: DataFrame, box=COARSE_BOX, speed=SPEED_RANGE) -> DataFrame:
    """Complete, plausible and distinct pings of a parsed table."""
    whole = pings.dropna(subset=["plate_num", "published_at", "lon", "lat", "speed"])
    return whole.where(within(F.col("lon"), F.col("lat"), box) & F.col("speed").between(*speed)).distinct()


def slow_in_box(pings: DataFrame, threshold: float = 5.0, box=FINE_BOX) -> DataFrame:
    return pings.where(F.col("speed").between(0.0, threshold) & within(F.col("lon"), F.col("lat"), box))


def events_as_pings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The driver's events as pings over a lattice of 150 places."""
    k = F.get_json_object("props", "$.k").cast("bigint")
    place = lambda factor: (F.col("user_id") * factor % 150).cast("double") / F.lit(150.0)
    step = F.round(F.col("value") * 100).cast("bigint") % 100
    return spark.read.parquet(f"{sf_dir}/events.parquet").select(
        "event_id", F.col("user_id").alias("plate_num"), F.col("ts").alias("published_at"), F.col("value").alias("speed"),
        (F.lit(103.40) + F.lit(1.15) * place(37) + k * F.lit(0.00004)).alias("lon"),
        (F.lit(30.10) + F.lit(1.10) * place(53) + step * F.lit(0.00004)).alias("lat"),
        F.to_date("ts").alias("day"),
    )


def suppliers_as_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The driver's suppliers as candidate nodes."""
    place = lambda factor: (F.col("s_suppkey") * factor % 150).cast("double") / F.lit(150.0)
    return spark.read.parquet(f"{sf_dir}/supplier.parquet").select(
        F.col("s_suppkey").cast("bigint").alias("node_id"),
        (F.lit(103.40) + F.lit(1.15) * place(37) + F.lit(0.002)).alias("lon"),
        (F.lit(30.10) + F.lit(1.10) * place(53) + F.lit(0.002)).alias("lat"),
        F.col("s_nationkey").cast("bigint").alias("region_key"), F.col("s_acctbal").cast("double").alias("weight"),
    )


def with_json_coordinates(pings: DataFrame) -> DataFrame:
    """Raw pings with double lon and lat read by JSON paths; what cannot be read is null."""
    part = lambda k: F.get_json_object("coord", f"$.{k}").try_cast("double")
    return pings.withColumns({"lon": part("lon"), "lat": part("lat")}).drop("coord")
