"""Connected components of a link table by contraction, in joins over tables of the shared folder."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from patrolkit.plans.shared_tables import scratch, ship, written

#: Rounds after which the work is given up with an error; each leaves only local minima of the links as nodes.
MAX_ROUNDS = 60

#: Links up to which one task folds them in memory (about 50 MB); more links go through rounds of joins.
FEW_LINKS = 200_000


def _in_one_task(edges: DataFrame) -> DataFrame:
    """The components of at most FEW_LINKS links, by one pass that hangs each larger root under the smaller."""
    ship(edges.sparkSession)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        above: dict[int, int] = {}

        def root(node: int) -> int:
            top = node
            while above.setdefault(top, top) != top:
                top = above[top]
            while above[node] != top:
                above[node], node = top, above[node]
            return top

        for part in parts:
            for a, b in zip(part.column("a").to_pylist(), part.column("b").to_pylist(), strict=True):
                one, other = root(a), root(b)
                above[max(one, other)] = min(one, other)
        nodes = sorted(above)
        yield pa.RecordBatch.from_arrays([pa.array(nodes, kind), pa.array([root(n) for n in nodes], kind)], names=["node", "label"])

    name = dict(edges.dtypes)["a"]
    kind = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[name]
    return edges.coalesce(1).mapInArrow(run, f"node {name}, label {name}")


def components(links: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """``(node, label)`` for every node of ``links``; label is the smallest node reachable.

    Links count both ways; a loop or a null end is ignored; an empty table gives an empty table. A round maps every node
    to its smallest neighbour (itself, if smaller), then to that one's, and keeps the links between different images:
    a dense group folds into one node at once, so its links are read in the first round only. At most FEW_LINKS links
    are folded by one task instead, with the same result.
    """
    clean = links.select(F.col(src).alias("a"), F.col(dst).alias("b")).where("a is not null and b is not null and a <> b")
    with scratch():
        edges = written(clean.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
        if edges.count() <= FEW_LINKS:
            return written(_in_one_task(edges), "components", keep=True)
        labels = None
        for _ in range(MAX_ROUNDS):
            if labels is not None and edges.limit(1).count() == 0:
                return written(labels, "components", keep=True)
            with scratch():
                edges, image = _contracted(edges)
                if labels is None:
                    labels = image.select("node", F.col("image").alias("label"))
                else:
                    step = image.select(F.col("node").alias("label"), "image")
                    labels = labels.join(step, "label", "left").select("node", F.coalesce("image", "label").alias("label"))
                labels = written(labels, "labels", keep=True)
    raise RuntimeError(f"links were left after {MAX_ROUNDS} rounds")


def _contracted(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The links between different images of their ends, and each node's image."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("a").alias("node"), F.col("a").alias("low")), F.struct(F.col("b").alias("node"), F.col("a").alias("low")))).alias("e"))
    low = written(ends.groupBy("e.node").agg(F.min("e.low").alias("low")), "low")
    above = low.select(F.col("node").alias("up"), F.col("low").alias("lower"))
    image = written(low.join(above, low.low == above.up).select("node", F.col("lower").alias("image")), "image")
    left = image.select(F.col("node").alias("a"), F.col("image").alias("image_a"))
    right = image.select(F.col("node").alias("b"), F.col("image").alias("image_b"))
    moved = edges.join(left, "a").join(right, "b").where("image_a <> image_b")
    edges = written(moved.select(F.least("image_a", "image_b").alias("a"), F.greatest("image_a", "image_b").alias("b")).distinct(), "edges", keep=True)
    return edges, image
