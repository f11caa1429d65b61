"""Feature preparation: standard scaling, independent unit scaling, principal components."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from patrolkit.functions.geo import unit_scaled


def standard_scaled(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Each column less its mean, over its population deviation; a constant column becomes 0."""
    stats = rows.agg(*[F.avg(c).alias(f"{c}__mean") for c in columns], *[F.stddev_pop(c).alias(f"{c}__std") for c in columns])
    wide = rows.crossJoin(F.broadcast(stats))  # one row
    made = {c: F.when(F.col(f"{c}__std") > 0, (F.col(c) - F.col(f"{c}__mean")) / F.col(f"{c}__std")).otherwise(F.when(F.col(c).isNotNull(), 0.0)) for c in columns}
    return wide.withColumns(made).select(*rows.columns)


def unit_square(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Each column scaled on its own to 0..1."""
    stats = rows.agg(*[F.min(c).alias(f"{c}__low") for c in columns], *[F.max(c).alias(f"{c}__high") for c in columns])
    wide = rows.crossJoin(F.broadcast(stats))  # one row
    return wide.withColumns({c: unit_scaled(F.col(c), F.col(f"{c}__low"), F.col(f"{c}__high")) for c in columns}).select(*rows.columns)


def principal_components(rows: DataFrame, vector: str, count: int, name: str = "components") -> DataFrame:
    """``rows`` with the leading components of an array column. Signs are fixed: the largest loading is positive."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    ready = rows.withColumn("vector__ml", array_to_vector(F.col(vector).cast("array<double>")))
    model = PCA(k=count, inputCol="vector__ml", outputCol="pca__ml").fit(ready)
    loads = model.pc.toArray()
    signs = [1.0 if loads[abs(loads[:, j]).argmax(), j] >= 0 else -1.0 for j in range(count)]
    out = F.zip_with(vector_to_array("pca__ml"), F.array(*[F.lit(s) for s in signs]), lambda x, s: x * s)
    return model.transform(ready).withColumn(name, out).drop("vector__ml", "pca__ml")
