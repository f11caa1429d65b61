"""Helpers shared by the text operators: per-batch columns and distributed ranks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from patrolkit.plans.shared_tables import scratch, ship, small, written  # noqa: F401  used by the operators

#: Rows and bytes handled at once inside a Python worker; a longer text is a slice of its own.
SLICE_ROWS = 256
SLICE_BYTES = 4 << 20


def free_name(taken: list[str], wanted: str) -> str:
    """``wanted``, with underscores in front until no column of ``taken`` has that name (case aside)."""
    used = {name.lower() for name in taken}
    while wanted.lower() in used:
        wanted = f"_{wanted}"
    return wanted


def with_batches(df: DataFrame, source: str, fields: list[T.StructField], make: Callable[[], Callable[[pa.Array], list[pa.Array]]], *, drop_source: bool = False) -> DataFrame:
    """``df`` with columns that ``make()`` computes from the values of column ``source``, a few hundred rows at a time.

    ``make`` runs once per task and returns the function of a batch; every row stays one row, so repeated rows and
    null or repeated ids need no care. A new column replaces none: a name that is taken gets underscores in front.
    """
    ship(df.sparkSession)
    columns = [f for f in df.schema.fields if not (drop_source and f.name == source)]
    names = [f.name for f in columns]
    added = []
    for field in fields:
        added.append(T.StructField(free_name(names + [a.name for a in added], field.name), field.dataType, True))
    schema = T.StructType(columns + added)
    labels = names + [a.name for a in added]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for whole in batches:
            for start, rows in slices(whole.column(source)):
                batch = whole.slice(start, rows)
                got = work(batch.column(source))
                yield pa.RecordBatch.from_arrays([batch.column(n) for n in names] + got, names=labels)

    return df.mapInArrow(run, schema)


def slices(column: pa.Array) -> Iterator[tuple[int, int]]:
    """``(start, rows)`` of the slices of a column: at most SLICE_ROWS rows and, unless it is one row, SLICE_BYTES bytes."""
    if pa.types.is_struct(column.type):
        column = column.field(0)
    sizes = pc.fill_null(pc.binary_length(column), 0).to_pylist()
    start, held = 0, 0
    for at, size in enumerate(sizes):
        if at > start and (at - start >= SLICE_ROWS or held + size > SLICE_BYTES):
            yield start, at - start
            start, held = at, 0
        held += size
    if sizes:
        yield start, len(sizes) - start


def utf8(column: pa.Array) -> list[bytes | None]:
    """The texts as bytes, without decoding."""
    return column.cast(pa.binary() if pa.types.is_string(column.type) else pa.large_binary()).to_pylist()


def parts_for(rows: int, least: int = 256, each: int = 1_000_000) -> int:
    """Parts of about ``each`` rows at most, and no fewer than ``least``."""
    return max(least, -(-rows // each))


def join_hot(rows: DataFrame, key: str, table: DataFrame, table_key: str, hot: list) -> DataFrame:
    """``rows`` joined with ``table`` (one row a key); the keys in ``hot`` meet a broadcast, so that none fills a task.

    ``hot`` holds the keys of more than a fixed share of all rows, so its length is bounded.
    """
    if not hot:
        return rows.join(table, rows[key] == table[table_key])
    kind = dict(rows.dtypes)[key]
    few = F.broadcast(rows.sparkSession.createDataFrame([(k,) for k in hot], f"hot_key {kind}"))
    cold = rows.join(few, rows[key] == few["hot_key"], "left_anti").join(table, F.col(key) == F.col(table_key))
    warm = rows.join(F.broadcast(table.join(few, table[table_key] == few["hot_key"], "left_semi")), F.col(key) == F.col(table_key))
    return cold.unionByName(warm)


def gapless(df: DataFrame, by: list[str], order: list[str], name: str, buckets: int, deal: list[str] | None = None) -> DataFrame:
    """``df`` with ``name``: 0, 1, ... within ``by``, without a task that holds all rows of one key.

    Rows are cut into ``buckets`` by a hash of ``deal`` (``order`` unless given); the counts of (by, bucket) give where each bucket starts, and a
    window ranks the rows inside one bucket. Rows that agree in ``order`` fall into one bucket, so give a fine one.
    """
    cut = free_name(df.columns, "cut")
    base, size = free_name(df.columns, "base"), free_name(df.columns, "size_of_cut")
    dealt = df.withColumn(cut, F.pmod(F.xxhash64(*(deal or order)), F.lit(buckets)).cast("int"))
    before = Window.partitionBy(*by).orderBy(cut).rowsBetween(Window.unboundedPreceding, -1)
    starts = dealt.groupBy(*by, cut).agg(F.count("*").alias(size)).select(*by, cut, F.coalesce(F.sum(size).over(before), F.lit(0)).alias(base))
    inside = F.row_number().over(Window.partitionBy(*by, cut).orderBy(*order))
    ranked = dealt.withColumn(name, inside - F.lit(1))
    keys = [*by, cut]
    other = starts.select(*[F.col(k).alias(f"{k}__start") for k in keys], base)
    match = [F.col(k).eqNullSafe(F.col(f"{k}__start")) for k in keys]
    joined = ranked.join(other, on=match, how="inner")
    return joined.withColumn(name, (F.col(name) + F.col(base)).cast("long")).select(*df.columns, name)


def running_total(df: DataFrame, size: str, order: list[str], name: str, parts: int, deal: list[str] | None = None) -> DataFrame:
    """``df`` with ``name``: the sum of ``size`` over all rows before this one in the order of (part, order).

    A part is a hash of ``deal`` (``order`` unless given); the totals of the parts, one row each, give where a part starts. No task holds more
    than one part.
    """
    part, base, total = (free_name(df.columns, x) for x in ("part", "part_base", "part_total"))
    dealt = df.withColumn(part, F.pmod(F.xxhash64(*(deal or order)), F.lit(parts)).cast("int"))
    before = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    starts = dealt.groupBy(part).agg(F.sum(size).alias(total)).select(part, F.coalesce(F.sum(total).over(before), F.lit(0)).alias(base))
    inside = F.sum(size).over(Window.partitionBy(part).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    return (
        dealt.withColumn(name, F.coalesce(inside, F.lit(0)))
        .join(F.broadcast(starts), part)  # `parts` rows at most
        .withColumn(name, (F.col(name) + F.col(base)).cast("long"))
        .select(*df.columns, name)
    )
