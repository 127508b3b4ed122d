"""Communities: detection, statistics, names, colours, contraction."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.operators.components import component_sizes
from graphloom.runtime import ship
from graphloom.storage import materialise

#: Names of categories that say nothing about a community, as patterns over lower-case names.
GENERIC = [
    r"^articles? ", r"^pages? ", r"^images? ", r"^browse ", r"^templates? ", r"^stubs?$", r"^wiki ", r"^maintenance",
    r"^cleanup", r"^candidates? ", r"^all ", r"^years?$", r"^year of ", r"^\d{1,4}$", r"^\d{1,4}s$", r"^births?$",
    r"^deaths?$", r"^inhabitants?$", r"^locations?$", r"^items?$", r"^creatures?$", r"^males?$", r"^females?$",
    r"^humans?$", r"^events?$", r"^books?$", r"^comics?$",
]
#: Resolution and seed of community detection.
RESOLUTION, SEED = 2.0, 42


def tidy(name: Column) -> Column:
    return F.trim(F.regexp_replace(name, r"(?U)[\s\x1c-\x1f]+", " "))


def is_generic(name: Column) -> Column:
    return F.lower(tidy(name)).rlike("|".join(GENERIC))


def color(cluster_id: Column) -> Column:
    """The id times the golden ratio's fraction as a hue, saturation .65, value .9, as #rrggbb with truncated channels."""
    h = F.pmod(cluster_id.cast("double") * F.lit(0.618033988749895), F.lit(1.0))
    i = F.floor(h * 6.0)
    f = h * 6.0 - i
    v, s = F.lit(0.9), F.lit(0.65)
    p, q, t = v * (1.0 - s), v * (1.0 - s * f), v * (1.0 - s * (1.0 - f))
    pick = lambda *cs: F.element_at(F.array(*cs), (F.pmod(i, F.lit(6)) + 1).cast("int"))
    rgb = [pick(v, q, p, p, t, v), pick(t, v, v, q, p, p), pick(p, p, t, v, v, q)]
    return F.format_string("#%02x%02x%02x", *[(c * 255).cast("int") for c in rgb])


def cluster_statistics(assignments: DataFrame) -> DataFrame:
    sizes = assignments.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("size"))
    return sizes.agg(
        F.count(F.lit(1)).alias("clusters"), F.min("size").alias("smallest"), F.max("size").alias("largest"),
        F.round(F.avg("size"), 6).alias("average"), F.count_if(F.col("size") == 1).alias("singletons"),
        F.count_if(F.col("size") < 5).alias("below_5"), F.count_if(F.col("size") < 10).alias("below_10"),
    )


def name_candidates(assignments: DataFrame, categories: DataFrame) -> DataFrame:
    """(cluster_id, name, coverage, uses, rank): categories that may name a cluster.

    Coverage counts pages, a page's first spelling of a name only; uses counts every row. Generic names are out. Ranked
    by coverage, uses, brevity, lower-case name, name.
    """
    rows = categories.join(assignments, "page_title").withColumn("name", tidy(F.col("category_name")))
    rows = rows.where(F.col("name") != "").where(~is_generic(F.col("name")))
    first = Window.partitionBy("page_title", F.lower("name")).orderBy("name")
    rows = rows.withColumn("_first", F.when(F.row_number().over(first) == 1, 1).otherwise(0))
    found = rows.groupBy("cluster_id", "name").agg(F.sum("_first").alias("coverage"), F.count(F.lit(1)).alias("uses"))
    order = Window.partitionBy("cluster_id").orderBy(F.desc("coverage"), F.desc("uses"), F.length("name"), F.lower("name"), "name")
    return found.withColumn("rank", F.row_number().over(order)).where("coverage > 0")


def cluster_names(assignments: DataFrame, categories: DataFrame) -> DataFrame:
    """(cluster_id, cluster_color, cluster_name): in order of id, each cluster takes its best candidate that is free.

    Without one it is called by its first two titles. The greedy choice is sequential over clusters and may need any of
    their candidates; one task reads them, a cluster at a time, after they were ranked and stored by many.
    """
    ship(assignments.sparkSession)
    ranked = name_candidates(assignments, categories)
    lists = ranked.groupBy("cluster_id").agg(F.array_sort(F.collect_list(F.struct("rank", "name"))).alias("c"))
    place = Window.partitionBy("cluster_id").orderBy("page_title")
    first = assignments.withColumn("k", F.row_number().over(place)).where("k <= 2").groupBy("cluster_id").agg(
        F.array_join(F.array_sort(F.collect_list("page_title")), " / ").alias("fallback")
    )
    rows = first.join(lists, "cluster_id", "left").select(
        "cluster_id", "fallback", F.transform(F.coalesce("c", F.array().cast("array<struct<rank:int,name:string>>")), lambda x: x["name"]).alias("names")
    )

    def choose(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        used: set[str] = set()
        for pdf in parts:
            out = []
            for cluster, names, fallback in zip(pdf["cluster_id"], pdf["names"], pdf["fallback"], strict=True):
                name = next((n for n in names if n.lower() not in used), None)
                if name is not None:
                    used.add(name.lower())
                out.append((cluster, name if name is not None else fallback or f"Cluster {cluster}"))
            yield pd.DataFrame(out, columns=["cluster_id", "cluster_name"])

    rows = materialise(rows, "cluster_candidates")  # or the joins above would run in that one task, too
    named = rows.repartition(1).sortWithinPartitions("cluster_id").mapInPandas(choose, "cluster_id long, cluster_name string")
    return named.select("cluster_id", color(F.col("cluster_id")).alias("cluster_color"), "cluster_name")


def cluster_weights(edges: DataFrame, assignments: DataFrame) -> DataFrame:
    """(a, b, weight): distinct undirected edges between two clusters; those within one don't count."""
    pairs = edges.select(F.least("source_title", "target_title").alias("s"), F.greatest("source_title", "target_title").alias("t")).distinct()
    one = assignments.select(F.col("page_title").alias("s"), F.col("cluster_id").alias("cs"))
    two = assignments.select(F.col("page_title").alias("t"), F.col("cluster_id").alias("ct"))
    met = pairs.join(one, "s").join(two, "t").where("cs <> ct")
    return met.groupBy(F.least("cs", "ct").alias("a"), F.greatest("cs", "ct").alias("b")).agg(F.count(F.lit(1)).alias("weight"))


def modularity(edges: DataFrame, assignments: DataFrame, resolution: float = RESOLUTION) -> float:
    """Q = sum over clusters of inner/m - resolution (degrees / 2m)^2 on the simple undirected graph without loops."""
    pairs = edges.where("source_title <> target_title").select(
        F.least("source_title", "target_title").alias("s"), F.greatest("source_title", "target_title").alias("t")).distinct()
    one = assignments.select(F.col("page_title").alias("s"), F.col("cluster_id").alias("cs"))
    two = assignments.select(F.col("page_title").alias("t"), F.col("cluster_id").alias("ct"))
    met = pairs.join(one, "s").join(two, "t")
    ends = met.select(F.explode(F.array("cs", "ct")).alias("c"), F.when(F.col("cs") == F.col("ct"), 0.5).otherwise(0.0).alias("inner"))
    by = ends.groupBy("c").agg(F.sum("inner").alias("inner"), F.count(F.lit(1)).alias("degree"))
    got = by.agg(F.sum("inner").alias("i"), F.sum("degree").alias("d"), F.sum(F.col("degree") * F.col("degree")).alias("q")).first()
    return got["i"] / (got["d"] / 2) - resolution * got["q"] / got["d"] ** 2 if got["d"] else 0.0


def _louvain(src: np.ndarray, dst: np.ndarray, seed: int, resolution: float) -> dict[int, int]:
    """Local moving and aggregation on a weighted undirected graph until nothing improves; communities are then split
    into their connected parts. Nodes are visited in an order drawn from the seed."""
    nodes, inverse = np.unique(np.concatenate([src, dst]), return_inverse=True)
    a, b = inverse[: len(src)], inverse[len(src) :]
    near: list[dict[int, float]] = [{} for _ in nodes]
    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        if x != y:
            near[x][y] = near[y][x] = 1.0
    simple = near
    member = list(range(len(nodes)))
    rng = np.random.default_rng(seed)
    loops = [0.0] * len(nodes)
    total = sum(sum(v.values()) for v in near)
    while total:
        degree = [sum(v.values()) + 2 * loops[i] for i, v in enumerate(near)]
        com, weight = list(range(len(near))), list(degree)
        moved_any, queue = False, rng.permutation(len(near)).tolist()
        waiting = set(queue)
        while queue:
            i = queue.pop()
            waiting.discard(i)
            links: dict[int, float] = {}
            for j, w in near[i].items():
                links[com[j]] = links.get(com[j], 0.0) + w
            weight[com[i]] -= degree[i]
            gain = lambda c: links.get(c, 0.0) - resolution * degree[i] * weight[c] / total  # noqa: B023, E731
            best = max(sorted(links), key=gain, default=com[i])
            if gain(best) > gain(com[i]) + 1e-12:
                com[i], moved_any = best, True
                for j in sorted(near[i]):
                    if com[j] != best and j not in waiting:
                        waiting.add(j)
                        queue.insert(0, j)
            weight[com[i]] += degree[i]
        if not moved_any:
            break
        names = {c: k for k, c in enumerate(sorted(set(com)))}
        member = [names[com[m]] for m in member]
        grown: list[dict[int, float]] = [{} for _ in names]
        inner = [0.0] * len(names)
        for i, v in enumerate(near):
            inner[names[com[i]]] += loops[i]
            for j, w in v.items():
                x, y = names[com[i]], names[com[j]]
                if x == y:
                    inner[x] += w / 2
                else:
                    grown[x][y] = grown[x].get(y, 0.0) + w
        near, loops = grown, inner
    part, count = [-1] * len(nodes), 0
    for i in range(len(nodes)):
        if part[i] < 0:
            part[i], stack = count, [i]
            while stack:
                for j in simple[x := stack.pop()]:
                    if part[j] < 0 and member[j] == member[x]:
                        part[j] = count
                        stack.append(j)
            count += 1
    return {int(n): p for n, p in zip(nodes.tolist(), part, strict=True)}


def communities(edges: DataFrame, seed: int = SEED, resolution: float = RESOLUTION, smallest: int = 3) -> DataFrame:
    """(page_title, cluster_id) of the pages in components of ``smallest`` pages or more; ids from 0, large ones first.

    Components are independent, so each is one group; a component's edges, as integers, fit a worker's memory for graphs
    of tens of millions of edges. The result repeats for a seed; communities are connected.
    """
    from graphloom.operators.graph import ids_of

    ship(edges.sparkSession)
    sizes = materialise(component_sizes(edges).where(F.col("size") >= smallest), "kept_pages")
    ids = materialise(ids_of(sizes.select("page_title")), "page_ids")
    label = sizes.join(ids, "page_title")
    rows = edges.where("source_title <> target_title").join(
        label.select(F.col("page_title").alias("source_title"), F.col("id").alias("src"), "component"), "source_title"
    ).join(ids.select(F.col("page_title").alias("target_title"), F.col("id").alias("dst")), "target_title")
    # Resolution refers to the whole graph's edges; within a component the share of its own edges scales it.
    pairs = rows.select("component", F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct()
    pairs = materialise(pairs, "component_edges")
    every = max(1, pairs.count())

    def cluster(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["src", "dst"])
        found = _louvain(pdf["src"].to_numpy(), pdf["dst"].to_numpy(), seed, resolution * len(pdf) / every)
        return pd.DataFrame({"id": list(found), "part": list(found.values())}).assign(component=pdf["component"].iloc[0])

    found = pairs.groupBy("component").applyInPandas(cluster, "id long, part long, component string")
    found = materialise(found, "communities")
    sized = found.groupBy("component", "part").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first"))
    number = F.row_number().over(Window.orderBy(F.desc("n"), "first")) - 1  # a row per community
    named = sized.select("component", "part", number.alias("cluster_id"))
    return found.join(named, ["component", "part"]).join(ids, "id").select("page_title", F.col("cluster_id").cast("long").alias("cluster_id"))
