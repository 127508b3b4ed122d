"""Edges, degrees, adjacency and neighbourhood payloads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def both_ends_in(edges: DataFrame, titles: DataFrame) -> DataFrame:
    """The edges whose two ends are in ``titles`` (page_title). Semi joins carry no columns along."""
    for end in ("source_title", "target_title"):
        edges = edges.join(titles.select(F.col("page_title").alias(end)).distinct(), end, "left_semi")
    return edges.select("source_title", "target_title")


def edge_nodes(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("source_title").alias("page_title")).union(edges.select("target_title")).distinct()


def degrees(edges: DataFrame, titles: DataFrame | None = None) -> DataFrame:
    """(page_title, in_degree, out_degree) of every edge end, or of every one of ``titles``, those without edges too.

    One pass: each edge gives a row to either end, and the two counts are summed in one aggregation.
    """
    ends = edges.select(F.explode(F.array(
        F.struct(F.col("source_title").alias("page_title"), F.lit(0).alias("i"), F.lit(1).alias("o")),
        F.struct(F.col("target_title").alias("page_title"), F.lit(1).alias("i"), F.lit(0).alias("o")),
    )).alias("e")).select("e.*")
    if titles is not None:
        ends = ends.unionByName(titles.select("page_title", F.lit(0).alias("i"), F.lit(0).alias("o")))
    out = ends.groupBy("page_title").agg(F.sum("i").alias("in_degree"), F.sum("o").alias("out_degree"))
    return out if titles is None else out.join(titles.select("page_title").distinct(), "page_title", "left_semi")


def node_size(in_degree: Column) -> Column:
    """1.5 + 1.4 ln(1 + d), between 1.5 and 18."""
    return F.least(F.lit(18.0), F.greatest(F.lit(1.5), F.lit(1.5) + F.lit(1.4) * F.log(F.lit(1.0) + in_degree)))


def percentage(count: Column, total: Column) -> Column:
    return F.when(total == 0, F.lit("0.00%")).otherwise(F.format_string("%.2f%%", F.lit(100.0) * count / total))


def path_statistics(degree: DataFrame) -> DataFrame:
    """Counts of dead ends (no way out), orphans (no way in), both, starts and ends, with percentages."""
    dead, orphan = F.col("out_degree") == 0, F.col("in_degree") == 0
    out = degree.agg(
        F.count(F.lit(1)).alias("total"), F.count_if(dead).alias("dead_ends"), F.count_if(orphan).alias("orphans"),
        F.count_if(dead & orphan).alias("isolated"), F.count_if(~dead).alias("starts"), F.count_if(~orphan).alias("ends"),
    )
    total = F.col("total")
    return out.withColumns({f"{c}_share": percentage(F.col(c), total) for c in ("dead_ends", "orphans", "isolated")})


def directed_adjacency(edges: DataFrame) -> DataFrame:
    """(page_title, out, in): sorted arrays of distinct neighbours either way."""
    ends = edges.select(F.col("source_title").alias("page_title"), F.col("target_title").alias("o"), F.lit(None).cast("string").alias("i"))
    ends = ends.unionByName(edges.select(F.col("target_title").alias("page_title"), F.lit(None).cast("string").alias("o"), F.col("source_title").alias("i")))
    return ends.groupBy("page_title").agg(
        F.array_sort(F.collect_set("o")).alias("out"), F.array_sort(F.collect_set("i")).alias("in")
    )


def adjacency(edges: DataFrame) -> DataFrame:
    """(page_title, neighbors): a page with a loop is its own neighbour."""
    return directed_adjacency(edges).select("page_title", F.array_sort(F.array_union("out", "in")).alias("neighbors"))


def grouped_categories(categories: DataFrame) -> DataFrame:
    """(page_title, categories): names and titles are stripped, blank ones skipped, the rest sorted."""
    strip = lambda c: F.regexp_replace(c, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")
    rows = categories.select(strip(F.col("page_title")).alias("page_title"), strip(F.col("category_name")).alias("c"))
    rows = rows.where("page_title <> '' and c <> ''")
    return rows.groupBy("page_title").agg(F.array_sort(F.collect_list("c")).alias("categories"))


def node_payload(layout: DataFrame, colors: DataFrame, categories: DataFrame, label: Column | None = None) -> DataFrame:
    """Nodes as clients get them, with the cluster's name and the page's categories."""
    names = colors.select(F.col("cluster_id").alias("_cluster"), "cluster_name", F.col("cluster_color").alias("_color"))
    lists = categories.groupBy("page_title").agg(F.array_sort(F.collect_list("category_name")).alias("categories"))
    rows = layout.join(names, F.col("cluster_id") == F.col("_cluster"), "left").join(lists, "page_title", "left")
    color = F.coalesce("cluster_color", "_color") if "cluster_color" in layout.columns else F.col("_color")
    out = [F.col("page_title").alias("id"), "x", "y", F.col("node_size").alias("size"), color.alias("color"), "cluster_id",
           "cluster_name", "in_degree", "out_degree", F.coalesce("categories", F.array().cast("array<string>")).alias("categories")]
    return rows.select(*out, *([label.alias("label")] if label is not None else []))


def neighbourhood(
    titles: DataFrame, edges: DataFrame, layout: DataFrame, colors: DataFrame, categories: DataFrame
) -> DataFrame:
    """For each of ``titles`` (page_title) that has neighbours or a place in the layout: node_id, neighbors, out, in (sorted
    titles) and neighbor_nodes, out_nodes, in_nodes (payloads of those that have a place, in the order of titles)."""
    wanted = titles.select("page_title").distinct()
    out = edges.join(wanted.withColumnRenamed("page_title", "source_title"), "source_title", "left_semi")
    into = edges.join(wanted.withColumnRenamed("page_title", "target_title"), "target_title", "left_semi")
    near = out.select(F.col("source_title").alias("node_id"), F.col("target_title").alias("page_title"), F.lit(1).alias("o"), F.lit(0).alias("i"))
    near = near.unionByName(into.select(F.col("target_title").alias("node_id"), F.col("source_title").alias("page_title"), F.lit(0).alias("o"), F.lit(1).alias("i")))
    near = near.groupBy("node_id", "page_title").agg(F.max("o").alias("o"), F.max("i").alias("i"))
    needed = near.select("page_title").distinct()
    nodes = node_payload(layout.join(needed, "page_title", "left_semi"), colors, categories.join(needed, "page_title", "left_semi"))
    nodes = nodes.select(F.col("id").alias("page_title"), F.struct(*nodes.columns).alias("node"))
    near = near.join(nodes, "page_title", "left")
    entry = F.struct("page_title", "o", "i", "node")
    lists = near.groupBy("node_id").agg(F.array_sort(F.collect_list(F.struct("page_title", "o", "i"))).alias("t"),
                                        F.collect_list(entry).alias("n"))
    placed = wanted.join(layout.select("page_title"), "page_title", "left_semi").withColumn("placed", F.lit(True))
    rows = wanted.join(lists, F.col("page_title") == F.col("node_id"), "left").drop("node_id").join(placed, "page_title", "left")
    rows = rows.where("t is not null or placed")
    empty = F.array().cast("array<string>")
    pick = lambda f: F.coalesce(F.transform(F.filter("t", f), lambda s: s["page_title"]), empty)
    by_title = F.array_sort("n", lambda a, b: F.when(a["page_title"] < b["page_title"], -1).when(a["page_title"] > b["page_title"], 1).otherwise(0))
    got = lambda f: F.transform(F.filter(by_title, lambda s: s["node"].isNotNull() & f(s)), lambda s: s["node"])
    return rows.select(
        F.col("page_title").alias("node_id"),
        pick(lambda s: F.lit(True)).alias("neighbors"), pick(lambda s: s["o"] == 1).alias("out"), pick(lambda s: s["i"] == 1).alias("in"),
        got(lambda s: F.lit(True)).alias("neighbor_nodes"), got(lambda s: s["o"] == 1).alias("out_nodes"), got(lambda s: s["i"] == 1).alias("in_nodes"),
    )


def out_targets(edges: DataFrame, title: str) -> DataFrame:
    return edges.where(F.col("source_title") == title).select("target_title")


def ids_of(titles: DataFrame) -> DataFrame:
    """(page_title, id): dense ids from 0 in the order of titles, without one task numbering them all.

    Rows are dealt out in ranges of titles; each range starts where the counts of the ranges before it end.
    """
    from pyspark.sql import Window

    from graphloom.storage import materialise

    parts = titles.select("page_title").repartitionByRange("page_title").sortWithinPartitions("page_title")
    rows = materialise(parts.select("page_title", F.spark_partition_id().alias("part")), "ranges")
    counts = rows.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row per range
    starts = counts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    within = F.row_number().over(Window.partitionBy("part").orderBy("page_title")) - 1
    return rows.join(F.broadcast(starts), "part").select("page_title", (F.col("start") + within).cast("long").alias("id"))
