"""Sinks: CSV and JSON files, result logs that keep their schema, and runs that resume."""

from __future__ import annotations

import zipfile
from collections.abc import Callable
from xml.sax.saxutils import escape

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_csv(df: DataFrame, path: str, decimals: int = 8, encoding: str = "utf-8", mode: str = "error") -> None:
    """CSV with a header; doubles with a fixed number of decimals. ``utf-8-sig`` puts a byte-order mark before the header."""
    shown = df.select(*[F.when(F.col(f"`{c}`").isNotNull(), F.format_string(f"%.{decimals}f", F.col(f"`{c}`"))).alias(c) if t == "double" else F.col(f"`{c}`") for c, t in df.dtypes])
    if encoding == "utf-8-sig":
        encoding = "utf-8"
        shown = shown.toDF("\ufeff" + shown.columns[0], *shown.columns[1:])
    shown.write.mode(mode).option("header", "true").option("encoding", encoding).csv(path)


def read_csv(spark: SparkSession, path: str, schema: str, encoding: str = "utf-8", *, columns: list[str] | None = None, dates: dict[str, str] | None = None, index: str | None = None) -> DataFrame:
    """CSV with a header: on demand some columns only, text columns read as times by their formats (null where they do not
    fit), and the index column first."""
    reader = spark.read.schema(schema).option("header", "true").option("ignoreLeadingWhiteSpace", "true").option("enforceSchema", "true")
    rows = reader.option("encoding", "utf-8" if encoding == "utf-8-sig" else encoding).csv(path)
    for name, form in (dates or {}).items():
        rows = rows.withColumn(name, F.try_to_timestamp(name, F.lit(form)))
    kept = columns or rows.columns
    return rows.select(*([index] if index else []), *[c for c in kept if c != index])


def cached(spark: SparkSession, path: str, make: Callable[[], DataFrame]) -> DataFrame:
    """The table at ``path``; computed and written there first where it is absent."""
    try:
        return spark.read.parquet(path)
    except Exception as error:  # noqa: BLE001  the table does not exist yet
        if "PATH_NOT_FOUND" not in str(error):
            raise
    made = make()
    made.write.parquet(path)
    return spark.read.schema(made.schema).parquet(path)


def write_numbered(df: DataFrame, path: str, key: str, mode: str = "error") -> None:
    """``df`` as Parquet sorted by a number, so that :func:`read_slice` skips files and row groups."""
    df.repartitionByRange(key).sortWithinPartitions(key).write.mode(mode).parquet(path)


def read_slice(spark: SparkSession, path: str, key: str, offset: int, count: int) -> DataFrame:
    """The rows whose number lies in offset .. offset + count - 1: instances of a data set, or hours of a matrix."""
    return spark.read.parquet(path).where(F.col(key).between(offset, offset + count - 1))


#: Rows that a sheet may have: a fixed value of the format.
SHEET_ROWS = 1_048_576


def write_sheets(frames: dict[str, DataFrame], path: str) -> None:
    """Small report tables as the sheets of one spreadsheet file on the driver's disk; over SHEET_ROWS rows are an error."""
    names = list(frames)
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as out:
        types = "".join(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>' for i in range(1, len(names) + 1))
        main = '<Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/>'
        defaults = '<Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/>'
        relation = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
        package = "http://schemas.openxmlformats.org/package/2006"
        sheet = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
        out.writestr("[Content_Types].xml", f'<Types xmlns="{package}/content-types">{defaults}{main}{types}</Types>')
        out.writestr("_rels/.rels", f'<Relationships xmlns="{package}/relationships"><Relationship Id="r1" Type="{relation}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        links = "".join(f'<Relationship Id="r{i}" Type="{relation}/worksheet" Target="worksheets/sheet{i}.xml"/>' for i in range(1, len(names) + 1))
        out.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="{package}/relationships">{links}</Relationships>')
        listed = "".join(f'<sheet name="{escape(n[:31], {chr(34): "&quot;"})}" sheetId="{i}" r:id="r{i}"/>' for i, n in enumerate(names, 1))
        out.writestr("xl/workbook.xml", f'<workbook xmlns="{sheet}" xmlns:r="{relation}"><sheets>{listed}</sheets></workbook>')
        for i, name in enumerate(names, 1):
            rows = frames[name].limit(SHEET_ROWS).collect()  # a report; its size is checked next
            if len(rows) >= SHEET_ROWS:
                raise ValueError(f"{name} has over {SHEET_ROWS - 1} rows")
            lines = [frames[name].columns, *rows]
            body = "".join("<row>" + "".join(_cell(v) for v in line) + "</row>" for line in lines)
            out.writestr(f"xl/worksheets/sheet{i}.xml", f'<worksheet xmlns="{sheet}"><sheetData>{body}</sheetData></worksheet>')


def _cell(value: object) -> str:
    if value is None:
        return "<c/>"
    if isinstance(value, (int, float)) and not isinstance(value, bool):
        return f"<c><v>{value}</v></c>"
    return f'<c t="inlineStr"><is><t>{escape(str(value))}</t></is></c>'


def write_metadata(df: DataFrame, path: str, mode: str = "error") -> None:
    """Each row as one JSON line."""
    df.select(F.to_json(F.struct(*df.columns)).alias("value")).write.mode(mode).text(path)


def append_results(df: DataFrame, path: str) -> None:
    """Appends to a Parquet log; a schema that differs from the log's is an error."""
    spark = df.sparkSession
    try:
        there = spark.read.parquet(path).dtypes
    except Exception as error:  # noqa: BLE001  the log does not exist yet
        if "PATH_NOT_FOUND" not in str(error):
            raise
        there = df.dtypes
    if [*there] != [*df.dtypes]:
        raise ValueError(f"the log has {there}, the rows have {df.dtypes}")
    df.write.mode("append").parquet(path)


def remaining(grid: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """The tasks of a grid that no finished row has."""
    return grid.join(done.select(*keys).distinct(), keys, "left_anti")


def route_text(solutions: DataFrame, key: str = "solution") -> DataFrame:
    """Solutions as text rows: ``Route #k: a b c`` lines and the cost. ``routes`` is array<array<bigint>>."""
    lines = F.transform("routes", lambda r, i: F.concat(F.lit("Route #"), (i + 1).cast("string"), F.lit(": "), F.array_join(F.transform(r, lambda x: x.cast("string")), " ")))
    return solutions.select(key, F.concat(F.array_join(lines, "\n"), F.lit("\nCost "), F.col("cost").cast("string")).alias("value"))
