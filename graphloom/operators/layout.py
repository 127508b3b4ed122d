"""Two-level force-directed layout: communities on a coarse map, pages within their community."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.operators.clusters import cluster_weights
from graphloom.operators.graph import both_ends_in, degrees, edge_nodes, node_size
from graphloom.runtime import ship

#: Fixed values of the layout.
SMALL = 1500  # pages of a community that is laid out as a whole
ROUNDS = 250
COARSE_SCALE = 180.0
EXTENT = 1000.0
LEAST_SPAN = 1e-9


def normalised(points: np.ndarray) -> np.ndarray:
    """Both axes stretched to -1000 .. 1000; an axis without extent is taken as LEAST_SPAN wide."""
    if not len(points):
        return points
    low = points.min(axis=0)
    span = np.maximum(points.max(axis=0) - low, LEAST_SPAN)
    return (points - low) / span * (2 * EXTENT) - EXTENT


def repel(points: np.ndarray, rounds: int, least: float, step: float) -> np.ndarray:
    """Points nearer than ``least`` push each other apart, all at once in each round.

    A grid of cells of that width finds neighbours: only the 3 x 3 cells around a point are looked at. Points that
    coincide push along the diagonal, both the same way.
    """
    points = np.array(points, float)
    for _ in range(rounds):
        cells = np.floor(points / least).astype(np.int64)
        order = np.lexsort((cells[:, 1], cells[:, 0]))
        key = cells[:, 0] * (1 << 31) + cells[:, 1]
        sorted_key = key[order]
        move = np.zeros_like(points)
        for dx in (-1, 0, 1):
            for dy in (-1, 0, 1):
                want = (cells[:, 0] + dx) * (1 << 31) + cells[:, 1] + dy
                a, b = np.searchsorted(sorted_key, want, "left"), np.searchsorted(sorted_key, want, "right")
                n = b - a
                if not n.sum():
                    continue
                i = np.repeat(np.arange(len(points)), n)
                j = order[np.concatenate([np.arange(x, y) for x, y in zip(a[n > 0], b[n > 0], strict=True)])]
                keep = i != j
                i, j = i[keep], j[keep]
                d = points[i] - points[j]
                same = (d**2).sum(axis=1) < 1e-12
                d[same] = 1e-4
                dist = np.sqrt((d**2).sum(axis=1))
                near = dist < least
                push = (least - dist[near]) / least * step
                np.add.at(move, i[near], d[near] / dist[near][:, None] * push[:, None])
        if not move.any():
            break
        points += move
    return points


def forces(n: int, a: np.ndarray, b: np.ndarray, weight: np.ndarray | None = None, rounds: int = ROUNDS, seed: int = 42) -> np.ndarray:
    """Fruchterman-Reingold in blocks of rows, so that memory stays linear in ``n``; starts from a seeded square."""
    rng = np.random.default_rng(seed)
    p = rng.uniform(-1, 1, (n, 2)) * np.sqrt(n)
    weight = np.ones(len(a)) if weight is None else weight
    heat = np.sqrt(n) / 10
    for r in range(rounds):
        move = np.zeros_like(p)
        for at in range(0, n, 512):
            d = p[at : at + 512, None, :] - p[None, :, :]
            q = np.maximum((d**2).sum(axis=2), 1e-9)
            move[at : at + 512] = (d / q[:, :, None]).sum(axis=1)
        d = p[a] - p[b]
        pull = d * (np.sqrt((d**2).sum(axis=1)) * weight)[:, None]
        np.add.at(move, a, -pull)
        np.add.at(move, b, pull)
        size = np.maximum(np.sqrt((move**2).sum(axis=1)), 1e-9)
        p += move / size[:, None] * np.minimum(size, heat * (1 - r / rounds))[:, None]
    return p


def coarse_layout(weights: pd.DataFrame, clusters: list[int]) -> dict[int, tuple[float, float]]:
    """The communities' centres; a single one lies at the origin, those without links in a row."""
    if len(clusters) == 1:
        return {clusters[0]: (0.0, 0.0)}
    if not len(weights):
        return {c: (COARSE_SCALE * i, 0.0) for i, c in enumerate(clusters)}
    at = {c: i for i, c in enumerate(clusters)}
    a, b = (weights[c].map(at).to_numpy() for c in ("a", "b"))
    p = forces(len(clusters), a, b, np.log1p(weights["weight"].to_numpy(float))) * COARSE_SCALE
    return {c: (float(x), float(y)) for c, (x, y) in zip(clusters, p, strict=True)}


def anchor_count(n: int) -> int:
    return min(600, max(120, int(np.sqrt(n)) * 10))


def spread(n: int) -> float:
    """How far a community of n pages reaches around its centre."""
    return min(500.0, max(80.0, 25.0 * np.sqrt(n)))


def local_layout(n: int, a: np.ndarray, b: np.ndarray, seed: int = 42) -> np.ndarray:
    """A community's own layout, about -1 .. 1.

    Up to SMALL pages by forces, then neighbours pushed apart. Of larger ones the pages of highest degree are anchors,
    laid out by forces; each other page lies near the weighted mean of its up to eight strongest anchors, pulled towards
    one of them, and without any on one of all anchors in turn; a little off by a fixed pattern that grows with the
    number of its anchors.
    """
    if n == 1:
        return np.zeros((1, 2))
    if n <= SMALL:
        return repel(normalised(forces(n, a, b, seed=seed)) / EXTENT, 6, 0.03, 0.02)
    degree = np.bincount(np.concatenate([a, b]), minlength=n)  # a loop counts twice
    k = anchor_count(n)
    anchors = np.sort(np.argsort(-degree, kind="stable")[:k])
    place = np.full(n, -1)
    place[anchors] = np.arange(k)
    both = (place[a] >= 0) & (place[b] >= 0) & (a != b)
    fixed = normalised(forces(k, place[a][both], place[b][both], seed=seed)) / EXTENT
    i = np.arange(n)
    # The factors of the pattern, its scales, the pull.
    off = np.column_stack([(i * k) % 1000 for k in (92821, 68917, 39119)]) / 1000.0 - 0.5
    p = np.zeros((n, 2))
    x, y = np.concatenate([a, b]), np.concatenate([b, a])
    use = (place[x] < 0) & (place[y] >= 0)
    x, y = x[use], y[use]
    order = np.lexsort((y, -degree[y], x))
    x, y = x[order], y[order]
    anchored = np.bincount(x, minlength=n)
    first = np.searchsorted(x, x, "left")
    top = np.arange(len(x)) - first < 8
    x, y = x[top], y[top]
    w = np.maximum(1, degree[y]).astype(float)
    total = np.bincount(x, w, minlength=n)
    for c in (0, 1):
        p[:, c] = np.bincount(x, w * fixed[place[y], c], minlength=n) / np.maximum(total, 1e-9)
    used = np.minimum(anchored, 8)
    pulled = np.flatnonzero(used > 1)
    second = y[np.searchsorted(x, pulled) + pulled % used[pulled]]
    p[pulled] = 0.82 * p[pulled] + 0.18 * fixed[place[second]]
    p[total == 0] = fixed[i[total == 0] % k]
    scale = 0.06 + 0.05 * np.minimum(1.0, anchored / 4.0)
    p += off[:, :2] * scale[:, None] + off[:, 2:] * np.array([0.025, -0.02])
    p[anchors] = fixed
    return repel(p, 10, 0.02, 0.01)


def dropped(edges: DataFrame, assignments: DataFrame) -> DataFrame:
    """One row: nodes and edges of the graph that have no cluster, or an end without one, and so no place."""
    inner = both_ends_in(edges, assignments)
    count = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))  # noqa: E731 - a row each
    nodes = edge_nodes(edges).join(assignments.select("page_title"), "page_title", "left_anti")
    every = count(edges, "every").crossJoin(count(inner, "inner_edges"))
    return count(nodes, "dropped_nodes").crossJoin(every).select("dropped_nodes", (F.col("every") - F.col("inner_edges")).alias("dropped_edges"))


def layout(edges: DataFrame, assignments: DataFrame, colors: DataFrame, seed: int = 42) -> DataFrame:
    """The nodes_layout table of the pages that have a cluster and an edge to another such page.

    Degrees count edges between such pages. Communities are laid out as independent groups; the largest one bounds a
    task. The coarse map has a row per community. A cluster without a colour raises.
    """
    ship(edges.sparkSession)
    inner = both_ends_in(edges, assignments)
    pages = edge_nodes(inner).join(assignments, "page_title")
    one = assignments.select(F.col("page_title").alias("source_title"), F.col("cluster_id").alias("cs"))
    two = assignments.select(F.col("page_title").alias("target_title"), F.col("cluster_id").alias("ct"))
    within = inner.join(one, "source_title").join(two, "target_title").where("cs = ct")
    rows = pages.select("cluster_id", F.col("page_title").alias("s"), F.lit(None).cast("string").alias("t")).unionByName(
        within.select(F.col("cs").alias("cluster_id"), F.col("source_title").alias("s"), F.col("target_title").alias("t")))

    def place(pdf: pd.DataFrame) -> pd.DataFrame:
        titles = np.unique(pdf["s"].to_numpy(str))
        links = pdf[pdf["t"].notna()]
        a, b = np.searchsorted(titles, links["s"].to_numpy(str)), np.searchsorted(titles, links["t"].to_numpy(str))
        pairs = np.unique(np.column_stack([np.minimum(a, b), np.maximum(a, b)]), axis=0) if len(a) else np.empty((0, 2), np.int64)
        p = local_layout(len(titles), pairs[:, 0], pairs[:, 1], seed) * spread(len(titles))
        return pd.DataFrame({"page_title": titles, "cluster_id": pdf["cluster_id"].iloc[0], "lx": p[:, 0], "ly": p[:, 1]})

    local = rows.groupBy("cluster_id").applyInPandas(place, "page_title string, cluster_id long, lx double, ly double")
    clusters = sorted(r[0] for r in pages.select("cluster_id").distinct().collect())  # a row per community
    centres = coarse_layout(cluster_weights(inner, assignments).orderBy("a", "b").toPandas(), clusters) if clusters else {}
    spark = edges.sparkSession
    middle = spark.createDataFrame([(int(c), *xy) for c, xy in centres.items()], "cluster_id long, cx double, cy double")
    met = local.join(middle, "cluster_id").select("page_title", "cluster_id", (F.col("lx") + F.col("cx")).alias("x"), (F.col("ly") + F.col("cy")).alias("y"))
    scaled = normalise_columns(met).join(degrees(inner), "page_title")
    color = colors.select(F.col("cluster_id").cast("long").alias("cluster_id"), "cluster_color")
    out = scaled.join(color, "cluster_id", "left")
    missing = F.raise_error(F.concat(F.lit("no colour for cluster "), F.col("cluster_id").cast("string")))
    return out.select("page_title", "x", "y", F.col("cluster_id").cast("int").alias("cluster_id"),
                      F.coalesce("cluster_color", missing.cast("string")).alias("cluster_color"),
                      F.col("in_degree").cast("int").alias("in_degree"), F.col("out_degree").cast("int").alias("out_degree"),
                      node_size(F.col("in_degree")).alias("node_size"))


def normalise_columns(points: DataFrame) -> DataFrame:
    """x and y stretched to -1000 .. 1000 over all rows; the bounds are one row."""
    bounds = points.agg(*[f(c).alias(f"{c}{k}") for c in "xy" for f, k in ((F.min, 0), (F.max, 1))])

    def scale(c: str) -> Column:
        span = F.greatest(F.col(f"{c}1") - F.col(f"{c}0"), F.lit(LEAST_SPAN))
        return (F.col(c) - F.col(f"{c}0")) / span * F.lit(2 * EXTENT) - F.lit(EXTENT)

    return points.crossJoin(F.broadcast(bounds)).withColumns({c: scale(c) for c in "xy"}).select(*points.columns)


def close_pairs(points: DataFrame, least: float) -> DataFrame:
    """(a, b, distance) of the points (id, x, y) nearer than ``least``: a grid turns the range join into an equi-join.

    Each point goes to the 9 cells around its own and meets those in their own cell.
    """
    cell = lambda c: F.floor(F.col(c) / F.lit(least))
    own = points.select("id", "x", "y", cell("x").alias("cx"), cell("y").alias("cy"))
    around = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)]))
    sent = own.select(F.col("id").alias("a"), F.col("x").alias("ax"), F.col("y").alias("ay"), "cx", "cy", around.alias("o"))
    sent = sent.select("a", "ax", "ay", (F.col("cx") + F.col("o.i")).alias("cx"), (F.col("cy") + F.col("o.j")).alias("cy"))
    met = sent.join(own, ["cx", "cy"]).where("a < id")
    distance = F.sqrt(F.pow(F.col("ax") - F.col("x"), 2) + F.pow(F.col("ay") - F.col("y"), 2))
    return met.select("a", F.col("id").alias("b"), distance.alias("distance")).where(F.col("distance") < least)
