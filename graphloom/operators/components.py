"""Connected components over an edge table, without ever holding labels or edges in one place."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.storage import materialise


def components(links: DataFrame) -> DataFrame:
    """(a, b) links -> (node, component), component being the least node reached. Loops and nulls make no link.

    Each round takes the least label among a node's neighbours, then the label of that label (pointer jumping), which
    shortens paths by half; it ends when no label changed. Minima are pre-aggregated before the shuffle, so a hub costs
    one row per task.
    """
    both = links.select(F.col("a").alias("node"), F.col("b").alias("near")).unionByName(
        links.select(F.col("b").alias("node"), F.col("a").alias("near"))
    )
    both = materialise(both.where("node <> near").distinct(), "links")
    label = both.groupBy("node").agg(F.least(F.col("node"), F.min("near")).alias("component"))
    label = materialise(label, "labels")
    while True:
        near = both.join(label.withColumnRenamed("node", "near"), "near")
        low = near.groupBy("node").agg(F.min("component").alias("low"))
        step = label.join(low, "node").select("node", F.least("component", "low").alias("low"), F.col("component").alias("old"))
        step = materialise(step, "step")
        root = step.select(F.col("node").alias("low"), F.col("low").alias("root"))
        jumped = step.join(root, "low").select("node", F.least("low", "root").alias("component"), "old")
        jumped = materialise(jumped, "labels")
        label = jumped.select("node", "component")
        if jumped.where("component <> old").isEmpty():
            return label


def component_sizes(edges: DataFrame) -> DataFrame:
    """(source_title, target_title) -> (page_title, component, size) of every edge end, loops included."""
    links = edges.select(F.col("source_title").alias("a"), F.col("target_title").alias("b"))
    ends = links.select(F.col("a").alias("node")).union(links.select("b")).distinct()
    label = ends.join(components(links), "node", "left")
    label = materialise(label.select("node", F.coalesce("component", "node").alias("component")), "component_of")
    sizes = label.groupBy("component").agg(F.count(F.lit(1)).alias("size"))
    return label.join(sizes, "component").select(F.col("node").alias("page_title"), "component", "size")


def without_small(edges: DataFrame, largest: int = 2) -> DataFrame:
    """The edges whose component has more than ``largest`` pages. One pass is enough: dropping whole components can't
    make another one smaller."""
    keep = component_sizes(edges).where(F.col("size") > largest).select(F.col("page_title").alias("source_title"))
    return edges.join(keep, "source_title", "left_semi")
