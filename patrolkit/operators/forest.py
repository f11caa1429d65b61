"""Connectivity under links that come and go, in joins over tables.

A component is named by its least node. Links that come merge components by their names alone. A link that goes may or may
not split its component: the rest of that component's links tell, so the nodes of touched components are folded anew from
the links that they still have (the search for replacement links), and all other components keep their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from patrolkit.plans.shared_tables import scratch, written

from .components import components


def refolded(kept: DataFrame, loose: DataFrame, links: DataFrame) -> DataFrame:
    """``(node, label)`` of the ``kept`` (node, label) and the ``loose`` (node).

    ``links`` (src, dst) lead between loose nodes and names of kept components; kept components that they join get one
    name, the least node. Kept links inside a component are not looked at.
    """
    found = written(components(links).select(F.col("node").alias("name"), F.col("label").alias("merged")), "merged")
    moved = kept.join(found, kept.label == found.name, "left").select("node", F.coalesce("merged", "label").alias("label"))
    named = loose.join(found, loose.node == found.name, "left").select("node", F.coalesce("merged", "node").alias("label"))
    every = moved.unionByName(named)
    least = every.groupBy(F.col("label").alias("of")).agg(F.min("node").alias("least"))  # a name may have lost its node
    return every.join(least, every.label == least.of).select("node", F.col("least").alias("label"))


def changed_links(labels: DataFrame, links: DataFrame, changes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(labels, links)`` after the ``changes`` (op, src, dst) of one batch; op is link or cut.

    ``labels`` (node, label) holds every node that ever had a link, alone or not; links count both ways and are kept once;
    a link that is cut in the batch that brings it goes, cutting what is no link changes nothing, a loop is no link.
    """
    with scratch():
        ends = lambda df: df.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).where("src <> dst").distinct()
        cut, new = written(ends(changes.where("op = 'cut'")), "cut"), ends(changes.where("op = 'link'"))
        lost = written(links.join(cut, ["src", "dst"], "left_semi"), "lost")
        came = written(new.join(cut, ["src", "dst"], "left_anti").join(links, ["src", "dst"], "left_anti"), "came")
        held = written(links.join(cut, ["src", "dst"], "left_anti").unionByName(came), "links", keep=True)
        touched = lost.select(F.explode(F.array("src", "dst")).alias("node")).distinct().join(labels, "node").select("label").distinct()
        kept = written(labels.join(touched, "label", "left_anti").select("node", "label"), "kept")
        named = new.unionByName(cut).select(F.explode(F.array("src", "dst")).alias("node")).distinct()
        loose = written(labels.join(touched, "label", "left_semi").select("node").union(named.join(labels, "node", "left_anti")).distinct(), "loose")
        at = lambda side: F.coalesce(f"{side}_label", side)
        name = lambda side: kept.select(F.col("node").alias(side), F.col("label").alias(f"{side}_label"))
        inner = held.join(loose.select(F.col("node").alias("src")), "src", "left_semi")
        apart = inner.unionByName(came).distinct().join(name("src"), "src", "left").join(name("dst"), "dst", "left")
        new_labels = written(refolded(kept, loose, apart.select(at("src").alias("src"), at("dst").alias("dst"))), "labels", keep=True)
    return new_labels, held
