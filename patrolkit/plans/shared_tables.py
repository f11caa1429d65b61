"""Tables of the shared folder, which cut lineage and outlive lost executors, and the size check before a broadcast."""

from __future__ import annotations

import atexit
import io
import re
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a table that may be sent whole to every task.
BROADCAST_ROWS = 200_000


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Unset, a local session (tests) gets a folder of its own; a cluster is an error."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not folder:
        if not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = Path(tempfile.mkdtemp(prefix="patrolkit-")).as_uri()
        context.setCheckpointDir(folder)
    return folder.rstrip("/")


def _forget(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # noqa: BLE001  the session may be gone when the process ends
        return


def put_file(spark: SparkSession, data: bytes, name: str) -> str:
    """Writes a small file into the shared folder and returns its path; removed when the process ends."""
    path = f"{shared_folder(spark)}/patrolkit/{uuid.uuid4().hex}/{name}"
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    out = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(where, True)
    try:
        out.write(data)
    finally:
        out.close()
    atexit.register(_forget, spark, path)
    return path


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors once per application, so that workers can import it anywhere."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = Path(__file__).resolve().parents[1]
    made = io.BytesIO()
    with zipfile.ZipFile(made, "w", zipfile.ZIP_DEFLATED) as out:
        for file in sorted(root.rglob("*.py")):
            out.write(file, file.relative_to(root.parent))
    spark.sparkContext.addPyFile(put_file(spark, made.getvalue(), f"{root.name}.zip"))
    _shipped.add(app)


_scopes: list[list[tuple[SparkSession, str]]] = []


@contextmanager
def scratch() -> Iterator[None]:
    """Removes the tables written inside when the block ends, but for those written with ``keep``."""
    scope: list[tuple[SparkSession, str]] = []
    _scopes.append(scope)
    try:
        yield
    finally:
        _scopes.remove(scope)
        for spark, path in scope:
            _forget(spark, path)


def written(df: DataFrame, name: str, *, keep: bool = False) -> DataFrame:
    """``df`` as a Parquet table in the shared folder.

    It is removed when the innermost :func:`scratch` block ends (with ``keep`` the one around that), else with the process.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/patrolkit/{name}-{uuid.uuid4().hex}"
    around = _scopes[: len(_scopes) - keep]
    if around:
        around[-1].append((spark, path))
    else:
        atexit.register(_forget, spark, path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path of the shared folder for files of any kind, removed with the innermost scratch block or the process."""
    path = f"{shared_folder(spark)}/patrolkit/{name}"
    if _scopes:
        _scopes[-1].append((spark, path))
    else:
        atexit.register(_forget, spark, path)
    return path


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``rows`` rows, else as it is, so that the join shuffles."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df
