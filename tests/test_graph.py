"""Golden values and invariants of the graph operators."""

import json
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.functions import titles as T
from graphloom.operators import canonical, clusters, components, graph, ingest, layout, paths, tiles

E = "source_title string, target_title string"


def col(spark, values, f, schema="v string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, " + schema)
    return [r[0] for r in rows.orderBy("i").select(f(F.col("v"))).collect()]


@pytest.mark.parametrize(("titles", "expected"), [
    (["Foo", "foo", "Foo (disambiguation)", "foo (disambiguation)"],
     {"Foo (disambiguation)": "Foo", "foo": "Foo", "foo (disambiguation)": "foo"}),
    (["Bar (disambiguation)", "Bar (Disambiguation)"], {"Bar (disambiguation)": "Bar (Disambiguation)"}),
    (["BAZ (disambiguation)", "Baz"], {}),
    (["Logan’s Walk", "Logan's Walk"], {"Logan’s Walk": "Logan's Walk"}),
    (["SS", "ß"], {"SS": "ß"}),
    (["A  B", "A B"], {"A B": "A  B"}),
    (["Qux", "Qux (disambiguation)"], {"Qux (disambiguation)": "Qux"}),
    (["Solo"], {}),
])
def test_alias_map(spark, titles, expected):
    rows = spark.createDataFrame([(t,) for t in titles], "title string")
    assert {r[0]: r[1] for r in canonical.alias_map(rows).collect()} == expected


def test_titles(spark):
    texts = ["  a   b\x1c", "Hello World", "O'neil", "O'Neil", "hello", "ABC", "3D Map", "", "É A"]
    assert col(spark, texts, T.collapse_space)[0] == "a b"
    assert col(spark, texts, T.is_title_case) == [t == t.title() for t in texts]
    assert col(spark, ["A b/c(d)~*é"], T.page_path) == ["A_b%2Fc(d)~%2A%C3%A9"]
    assert col(spark, ["Category:Category:X", "category:X"], T.category_name) == ["Category:X", "category:X"]


def test_scalars(spark):
    assert col(spark, [0, 1, 2, 3], clusters.color, "v int") == ["#e55050", "#507be5", "#a7e550", "#e550d2"]
    sizes = col(spark, [0, 1, 10, 1000, 131400], graph.node_size, "v int")
    assert sizes == pytest.approx([1.5, 2.470406052783924, 4.857053381917719, 11.172256691041309, 18.0])
    assert col(spark, [1.5, 4.857, 18.0], lambda c: tiles.edge_alpha(c, F.lit(0.0)), "v double") == [52, 68, 89]
    assert [tiles.edge_style(z) for z in (0, 3, 4, 6)] == [(1, 7, 4.0), (1, 7, 4.0), (2, 8, 4.4), (2, 8, 4.4)]
    for size, zoom, r in ((1.5, 0, 1), (1.5, 5, 1), (4.857, 0, 1), (4.857, 5, 5), (18.0, 0, 6), (18.0, 5, 19)):
        assert col(spark, [size], lambda c, z=zoom: tiles.node_radius(c, z), "v double") == [r]
    assert col(spark, [63], lambda c: tiles.shard(c, c), "v int") == [66]
    assert col(spark, ["#abc", None, "#0a0B0c"], tiles.rgb) == [[79, 70, 229], [79, 70, 229], [10, 11, 12]]
    assert col(spark, [0], lambda c: graph.percentage(c, c), "v int") == ["0.00%"]


def test_point_tiles(spark):
    points = [(-1000, 1000), (1000, -1000), (0, 0), (999.9, 999.9), (-15.625, 15.625), (31.25, -31.25)]
    rows = spark.createDataFrame([(str(i), float(x), float(y)) for i, (x, y) in enumerate(points)], "page_title string, x double, y double")
    got = {(r["page_title"], r["zoom"]): (r["tx"], r["ty"]) for r in tiles.point_tiles(rows, [0, 1, 6, 7]).collect()}
    want = [[(0, 0)] * 4, [(0, 0), (1, 1), (63, 63), (127, 127)], [(0, 0), (1, 1), (32, 32), (64, 64)],
            [(0, 0), (1, 0), (63, 0), (127, 0)], [(0, 0), (0, 0), (31, 31), (63, 63)], [(0, 0), (1, 1), (33, 33), (66, 66)]]
    assert got == {(str(i), z): w for i, ws in enumerate(want) for z, w in zip((0, 1, 6, 7), ws)}


@pytest.mark.parametrize(("segment", "expected"), [
    ((512, 512, 2560, 2560), [(0, 0), (1, 1), (2, 2)]),
    ((512, 512, 3584, 512), [(0, 0), (1, 0), (2, 0), (3, 0)]),
    ((512, 100, 512, 100), [(0, 0)]),
    ((100, 512, 3000, 1500), [(0, 0), (1, 0), (1, 1), (2, 1)]),
    ((3000, 1500, 100, 512), [(2, 1), (1, 1), (1, 0), (0, 0)]),
    ((0, 0, 4096, 4096), [(0, 0), (1, 1), (2, 2), (3, 3)]),
])
def test_walk_tiles(segment, expected):
    assert tiles.walk_tiles(*segment, 4) == expected


def test_walk_tiles_is_connected():
    rng = random.Random(1)
    for _ in range(500):
        s = [rng.uniform(0, 64 * 1024) for _ in range(4)]
        got = tiles.walk_tiles(*s, 64)
        assert got[0] == (int(s[0] // 1024), int(s[1] // 1024)) and got[-1] == (int(s[2] // 1024), int(s[3] // 1024))
        assert all(max(abs(a - c), abs(b - d)) == 1 for (a, b), (c, d) in zip(got, got[1:]))


def test_repel():
    assert layout.repel(np.array([[0, 0], [0.015, 0]]), 1, 0.03, 0.02) == pytest.approx(np.array([[-0.01, 0], [0.025, 0]]))
    assert layout.repel(np.zeros((2, 2)), 1, 0.03, 0.02) == pytest.approx(np.full((2, 2), 0.014075468957064286))
    assert layout.repel(np.array([[0, 0], [0.5, 0]]), 3, 0.03, 0.02) == pytest.approx(np.array([[0, 0], [0.5, 0]]))


def graph_of(spark, n=60, m=90, seed=3):
    rng = random.Random(seed)
    pairs = sorted({(f"n{rng.randrange(n):02}", f"n{rng.randrange(n):02}") for _ in range(m)})
    return pairs, spark.createDataFrame(pairs, E)


def test_components_and_prune(spark):
    edges = [("a", "a"), ("b", "c"), ("d", "e"), ("e", "f"), ("f", "d")]
    df = spark.createDataFrame(edges, E)
    assert {(r[0], r[2]) for r in components.component_sizes(df).collect()} == {("a", 1), ("b", 2), ("c", 2), ("d", 3), ("e", 3), ("f", 3)}
    assert {tuple(r) for r in components.without_small(df).collect()} == set(edges[2:])
    chain = spark.createDataFrame([(f"x{i:03}", f"x{i + 1:03}") for i in range(200)], E)
    assert {r["component"] for r in components.component_sizes(chain).collect()} == {"x000"}


def test_communities(spark):
    clique = lambda p: [(f"{p}{i}", f"{p}{j}") for i in range(6) for j in range(i)]
    edges = spark.createDataFrame(clique("a") + clique("b") + [("a0", "b0"), ("z0", "z1")], E)
    found = clusters.communities(edges)
    by = {r[0]: r[1] for r in found.collect()}
    assert len({by[f"a{i}"] for i in range(6)}) == 1 and by["a1"] != by["b1"] and "z0" not in by
    assert {r[0]: r[1] for r in clusters.communities(edges).collect()} == by
    alone = found.select("page_title", F.row_number().over(__import__("pyspark.sql").sql.Window.orderBy("page_title")).alias("cluster_id"))
    assert clusters.modularity(edges, found) > clusters.modularity(edges, alone)


def test_layout(spark):
    _, edges = graph_of(spark)
    ends = graph.edge_nodes(edges)
    assigned = ends.select("page_title", (F.length("page_title") + F.substring("page_title", 3, 1).cast("int") % 3).cast("long").alias("cluster_id"))
    colors = assigned.select("cluster_id").distinct().withColumn("cluster_color", clusters.color(F.col("cluster_id")))
    one, two = (layout.layout(edges, assigned, colors).toPandas().sort_values("page_title").reset_index(drop=True) for _ in range(2))
    assert one.equals(two) and len(one) == ends.count()
    for c in "xy":
        assert one[c].min() == pytest.approx(-1000) and one[c].max() == pytest.approx(1000)


def test_large_local_layout():
    rng = np.random.default_rng(0)
    a, b = rng.integers(0, 1600, 4000), rng.integers(0, 1600, 4000)
    p = layout.local_layout(1600, a, b)
    assert p.shape == (1600, 2) and np.isfinite(p).all() and np.abs(p).max() < 3


def test_paths(spark):
    pairs, edges = graph_of(spark)
    near: dict = {}
    for a, b in pairs:
        near.setdefault(a, []).append(b)
    depth, level = {pairs[0][0]: 0}, [pairs[0][0]]
    while level:
        level = [b for a in level for b in near.get(a, []) if b not in depth and not depth.update({b: depth[a] + 1})]
    starts = spark.createDataFrame([(pairs[0][0],)], "page_title string")
    tree = paths.bfs(edges, starts)
    assert {r["node"]: r["depth"] for r in tree.collect()} == depth
    goals = tree.select("start", "node").union(starts.select("page_title", F.lit("nowhere")))
    for r in paths.path_to(tree, goals).collect():
        if r["node"] == "nowhere":
            assert (r["path_length"], r["path"]) == (-1, "NOT FOUND")
        else:
            steps = r["path"].split(" -> ")
            assert len(steps) == depth[r["node"]] + 1 == r["path_length"] + 1 and set(zip(steps, steps[1:])) <= set(pairs)
    far = paths.farthest(tree).first()
    ecc = paths.eccentricities(edges, starts).first()
    assert (far["farthest_title"], far["depth"]) == (ecc["farthest_node"], ecc["depth"])
    got = paths.longest_incoming(edges, spark.createDataFrame([(pairs[0][1],), ("nowhere",)], "page_title string"), 50)
    for r in got.collect():
        steps = r["path"].split(" -> ")
        assert len(set(steps)) == len(steps) == r["path_length"] + 1 and set(zip(steps, steps[1:])) <= set(pairs)


def test_best_row(spark):
    rows = spark.createDataFrame([("a", "3", 0), ("b", "x", 1), ("c", "5", 2), ("d", "5", 3)], "start string, path_length string, line int")
    assert paths.best_row(rows).first()["start"] == "c" and paths.greatest_length(rows).first()[0] == 5
    assert paths.greatest_length(rows.limit(0)).first()[0] == -1


def body(pages, normalized=(), redirects=()):
    pair = lambda ps: [{"from": a, "to": b} for a, b in ps]
    return json.dumps({"query": {"pages": {str(i): p for i, p in enumerate(pages)}, "normalized": pair(normalized), "redirects": pair(redirects)}})


def test_crawl(spark):
    asked = [(1, 0, "Foo"), (1, 1, "old name"), (1, 2, "MIXED case"), (1, 3, "gone"), (2, 0, "x"), (2, 1, "y")]
    link = lambda t, ns=0: {"ns": ns, "title": t}
    first = body([{"title": "Foo", "links": [link("B"), link("A"), link("T", 10)], "categories": [{"title": "Category:C"}]},
                  {"title": "New", "links": [link("Z")]}], redirects=[("old name", "New")])
    more = body([{"title": "Foo", "links": [link("A"), link("D")]}, {"title": "Mixed_Case", "links": []}])
    raw = spark.createDataFrame([(1, first, None), (1, more, None), (2, None, "timeout")], "batch long, body string, error string")
    requests = spark.createDataFrame(asked, "batch long, pos int, page_title string")
    records = ingest.crawl_records(requests, ingest.parse_responses(raw).select("batch", "response", "error"))
    got = {r["page_title"]: r for r in records.collect()}
    assert got["Foo"]["links_out"] == ["A", "B", "D"] and got["Foo"]["categories"] == ["C"]
    assert got["old name"]["links_out"] == ["Z"] and got["MIXED case"]["links_out"] == [] and got["gone"]["error"] is None
    assert got["x"]["error"] == got["y"]["error"] == "timeout" and len(got) == 6


def test_store(spark):
    from graphloom.sources.catalog import SCHEMAS

    empty = {t: spark.createDataFrame([], SCHEMAS[t]) for t in ("pages", "searched_pages", "failed_pages", "page_links", "page_categories")}
    schema = "page_title string, links_out array<string>, categories array<string>, error string, seq int"
    rows = spark.createDataFrame([("a", ["b", "c"], ["k"], None, 1), ("a", [], [], "late", 2), ("d", ["a"], [], None, 3)], schema)
    out = ingest.store_records(empty, rows, "seq")
    assert {tuple(r) for r in out["pages"].collect()} == {("a", 0, 0, "late"), ("d", 1, 0, None)}
    assert {r[0] for r in out["searched_pages"].collect()} == {"a", "d"} and [tuple(r) for r in out["failed_pages"].drop("failed_at").collect()] == [("a", "late")]
    assert {tuple(r) for r in out["page_links"].collect()} == {("a", "b"), ("a", "c"), ("d", "a")}
    assert ingest.clean_failed(out["failed_pages"], out["searched_pages"]).count() == 0
    again = ingest.store_records(out, spark.createDataFrame([("d", ["q"], [], None, 1)], schema), "seq")
    assert {tuple(r) for r in again["page_links"].collect()} >= {("d", "a"), ("d", "q")}


def test_neighbourhood(spark):
    edges = spark.createDataFrame([("a", "b"), ("c", "a"), ("a", "a")], E)
    placed = spark.createDataFrame([("b", 0.0, 0.0, 1, "#000000", 1, 0, 1.5), ("lone", 1.0, 1.0, 1, "#000000", 0, 0, 1.5)],
                                   "page_title string, x double, y double, cluster_id int, cluster_color string, in_degree int, out_degree int, node_size double")
    colors = spark.createDataFrame([(1, "#000000", None)], "cluster_id int, cluster_color string, cluster_name string")
    cats = spark.createDataFrame([("b", "k2"), ("b", "k1")], "page_title string, category_name string")
    wanted = spark.createDataFrame([("a",), ("lone",), ("who",)], "page_title string")
    got = {r["node_id"]: r for r in graph.neighbourhood(wanted, edges, placed, colors, cats).collect()}
    assert set(got) == {"a", "lone"} and got["lone"]["neighbors"] == []
    assert got["a"]["neighbors"] == ["a", "b", "c"] and got["a"]["out"] == ["a", "b"] and got["a"]["in"] == ["a", "c"]
    assert [n["id"] for n in got["a"]["neighbor_nodes"]] == ["b"] and got["a"]["neighbor_nodes"][0]["categories"] == ["k1", "k2"]


def test_name_candidates(spark):
    assigned = spark.createDataFrame([("p", 1), ("q", 1)], "page_title string, cluster_id long")
    cats = spark.createDataFrame([("p", "Ships"), ("p", "ships"), ("q", "ships"), ("q", "Year of 1900"), ("q", "Boats ")], "page_title string, category_name string")
    got = {r["name"]: (r["coverage"], r["rank"]) for r in clusters.name_candidates(assigned, cats).collect()}
    assert got == {"Ships": (1, 2), "ships": (1, 1), "Boats": (1, 3)} or got == {"Ships": (1, 3), "ships": (1, 1), "Boats": (1, 2)}


def test_zoom_config(tmp_path):
    tiles.ZoomConfig()
    for bad in ({"interactive_min_zoom": 7}, {"label_min_zoom": 5}, {"chunk_max_zoom": 6}):
        with pytest.raises(ValueError):
            tiles.ZoomConfig(**bad)
    (tmp_path / "c.json").write_text('{"static_tile_max_zoom": 5}')
    with pytest.raises(ValueError, match="missing"):
        tiles.ZoomConfig.load(str(tmp_path / "c.json"))


def test_raster():
    image = np.zeros((32, 32, 4), np.uint8)
    tiles.draw_gradient(image, (0, 0), (31, 0), (255, 0, 0, 255), (0, 0, 255, 255), 1)
    assert image[0, 0, 0] > image[0, 31, 0] and not image[5].any()
    assert tiles.arrow((0, 0), (0, 0), 7, 4) == [] and len(tiles.arrow((0, 0), (9, 0), 7, 4)) == 3
    data = tiles.png(image)
    assert data[:8] == b"\x89PNG\r\n\x1a\n" and data[16:24] == (32).to_bytes(4, "big") * 2


def test_paths_beyond_the_broadcast_bound(spark, monkeypatch):
    """The same eccentricities, and simple paths as long, when steps are joins."""
    pairs = [("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("x", "d"), ("d", "e"), ("e", "x"), ("a", "a")]
    edges = spark.createDataFrame(pairs, E)
    nodes = graph.edge_nodes(edges)
    key = lambda df: sorted(map(tuple, df.collect()))
    few = key(paths.eccentricities(edges, nodes))
    walks = {r["end_node"]: r["path_length"] for r in paths.longest_incoming(edges, nodes, 200).collect()}
    monkeypatch.setattr(paths, "MOST_EDGES", 0)
    assert key(paths.eccentricities(edges, nodes)) == few and few[0] == ("a", "x", 5, "a -> b -> c -> d -> e -> x")
    got = paths.longest_incoming(edges, nodes, 200).collect()
    assert {r["end_node"]: r["path_length"] for r in got} == walks == {"a": 2, "b": 2, "c": 2, "d": 3, "e": 4, "x": 5}
    for r in got:
        steps = r["path"].split(" -> ")
        assert len(set(steps)) == len(steps) == r["path_length"] + 1 and set(zip(steps, steps[1:])) <= set(pairs)


def test_random_walks_are_fair_and_simple():
    """Walks from a fork of three ways take each about as often, and the longest is found."""
    first, to = np.array([0, 3, 3, 4, 5, 5]), np.array([1, 2, 3, 4, 4])
    rng = np.random.default_rng(1)
    ends = [paths.walk_back(first, to, 0, 1, rng) for _ in range(900)]
    count = {1: 0, 2: 0, 3: 0}
    for e in ends:
        count[e[1]] += 1
        assert e in ([0, 1], [0, 2, 4], [0, 3, 4])
    assert min(count.values()) > 240 and len(paths.walk_back(first, to, 0, 50, rng)) == 3


def test_names_beyond_fifty_candidates(spark):
    """A cluster whose first sixty names are taken by others gets its sixty-first."""
    assigned = spark.createDataFrame([(f"p{i:02d}", i) for i in range(61)], "page_title string, cluster_id long")
    cats = spark.createDataFrame([(f"p{i:02d}", f"n{k:02d}") for i in range(60) for k in [i]] + [("p60", f"n{k:02d}") for k in range(61)],
                                 "page_title string, category_name string")
    got = {r["cluster_id"]: r["cluster_name"] for r in clusters.cluster_names(assigned, cats).collect()}
    assert got[59] == "n59" and got[60] == "n60"


def test_images_in_parts(spark, monkeypatch):
    """Tiles drawn in parts and laid over each other are those drawn at once."""
    rng = np.random.default_rng(4)
    rows = [(f"p{i:03d}", float(x), float(y), 1, f"#{i:06x}", 0, 0, 9.0) for i, (x, y) in enumerate(rng.uniform(0, 50, (60, 2)))]
    placed = spark.createDataFrame(rows, "page_title string, x double, y double, cluster_id int, cluster_color string, in_degree int, out_degree int, node_size double")
    edges = spark.createDataFrame([(f"p{i:03d}", f"p{(i * 7) % 60:03d}") for i in range(60)], E)
    geometry = tiles.edge_geometry(edges, placed, 1).cache()
    member, discs = tiles.edge_tiles(geometry, 1).cache(), tiles.disc_tiles(placed, 1).cache()
    key = lambda df: sorted((r["zoom"], r["tx"], r["ty"], zlib.crc32(bytes(r["png"]))) for r in df.collect())
    whole = key(tiles.render_edges(member, geometry, 1)), key(tiles.render_nodes(discs))
    monkeypatch.setattr(tiles, "PART", 3)
    monkeypatch.setattr(tiles, "STACK", 4)
    assert (key(tiles.render_edges(member, geometry, 1)), key(tiles.render_nodes(discs))) == whole and len(whole[0]) == 5


def test_clipped_lines():
    """Only what lies in the image is computed, and it is the same as when all of the line is."""
    rng = np.random.default_rng(2)
    for _ in range(200):
        ends = rng.uniform(-300, 300, 4)
        width = int(rng.integers(1, 3))
        small, big = np.zeros((40, 40, 4), np.uint8), np.zeros((700, 700, 4), np.uint8)
        tiles.draw_line(small, *ends, width, (1, 2, 3, 4))
        n = int(max(abs(ends[2] - ends[0]), abs(ends[3] - ends[1]))) + 1
        for k in range(n + 1):
            x, y = int(np.rint(ends[0] + (ends[2] - ends[0]) * (k / n))), int(np.rint(ends[1] + (ends[3] - ends[1]) * (k / n)))
            for d in range(width):
                a, b = (x, y + d) if abs(ends[2] - ends[0]) >= abs(ends[3] - ends[1]) else (x + d, y)
                if 0 <= a < 40 and 0 <= b < 40:
                    big[b, a] = (1, 2, 3, 4)
        assert (small == big[:40, :40]).all()


def test_large_community_layout():
    """Pages outside of the anchors: pulled towards one anchor, without any on an anchor in turn; all finite."""
    rng = np.random.default_rng(1)
    n = 1700
    a, b = rng.integers(0, 200, 3000), rng.integers(0, n, 3000)
    p = layout.local_layout(n, a, b)
    assert p.shape == (n, 2) and np.isfinite(p).all() and np.abs(p).max() < 3
    lone = np.setdiff1d(np.arange(n), np.concatenate([a, b]))
    assert len(lone) > 100 and np.hypot(*p[lone].T).std() > 0.05  # not on a ring


def random_edges(seed, n=300, m=420):
    """Several components, a node that many link to, loops and copies."""
    rng = np.random.default_rng(seed)
    pairs = [(f"t{a}", f"t{b}") for a, b in rng.integers(0, n, (m, 2))] + [(f"t{a}", "t7") for a in range(0, n, 4)]
    return pairs + [("t1", "t1"), pairs[0], ("é", "z"), ("z", "𝒜"), ("z", "￮")]


def plain_search(pairs, start):
    """node -> (depth, least predecessor)"""
    near: dict = {}
    for a, b in pairs:
        near.setdefault(a, set()).add(b)
    found, level = {start: (0, None)}, [start]
    while level:
        new: dict = {}
        for a in sorted(level):
            for b in near.get(a, ()):
                if b not in found:
                    new.setdefault(b, a)
        found |= {b: (found[a][0] + 1, a) for b, a in new.items()}
        level = list(new)
    return found


def plain_path(found, node):
    path = [node]
    while found[path[-1]][1] is not None:
        path.append(found[path[-1]][1])
    return " -> ".join(path[::-1])


def test_tree_of_all_starts_stores_nothing(spark, monkeypatch):
    """bfs_tree: no round of all the searches is written, and the rows are those of searches one by one."""
    pairs = random_edges(1)
    edges = spark.createDataFrame(pairs, E)
    starts = spark.createDataFrame([(a,) for a in sorted({a for p in pairs for a in p})] + [("nowhere",)], "page_title string")
    want = {(r["page_title"], node, *found) for r in starts.collect() for node, found in plain_search(pairs, r["page_title"]).items()}
    monkeypatch.setattr(paths, "materialise", None)
    got = paths.bfs(edges, starts)
    assert got.schema.simpleString() == "struct<start:string,node:string,depth:int,pred:string>"
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    ends = {start: depth for start, node, depth, _ in want if node == "t7"}
    for most, target in ((2, None), (None, "t7"), (1, "t7"), (None, "nowhere"), (0, None)):
        got = sorted(map(tuple, paths.bfs(edges, starts, target, most).collect()), key=str)
        last = {s: min(99 if most is None else most, ends.get(s, 99) if target == "t7" else 0 if s == target else 99) for s, *_ in want}
        assert got == sorted((w for w in want if w[2] <= last[w[0]]), key=str)


def test_searches_from_many_starts(monkeypatch):
    """eccentricities, shortest_paths: starts that are searched together get what each gets alone, by halves as well."""
    import pyarrow as pa

    pairs = random_edges(2)
    g = paths._Components(*(pa.chunked_array([pa.array(x)]) for x in zip(*pairs, strict=True)))
    names = g.titles.to_pylist()
    trees = [plain_search(pairs, s) for s in names]
    rng = np.random.default_rng(0)
    goals = rng.integers(0, len(names), len(names))
    order = np.concatenate([np.arange(len(names)), [0, 0, 5]])  # starts may come again
    for held, ranks in ((paths.HELD, paths.RANKS), (3000, 2)):
        monkeypatch.setattr(paths, "HELD", held)
        monkeypatch.setattr(paths, "RANKS", ranks)
        g._range = (None, None)
        for ends in (None, goals[order]):
            parts = list(paths._together(g, order, 0, len(names), ends))
            assert len(parts) == 1 if held > 3000 else len(parts) > 1
            got = [(int(e), int(d), p) for es, ds, ps in parts for e, d, p in zip(es, ds, ps.to_pylist(), strict=True)]
            for i, (e, depth, path) in zip(order, got, strict=True):
                tree = trees[i]
                goal = min(tree, key=lambda x: (-tree[x][0], x)) if ends is None else names[goals[i]]
                assert names[e] == goal
                assert (depth, path) == ((tree[goal][0], plain_path(tree, goal)) if goal in tree else (-1, None))


def test_paths_of_pairs(spark, monkeypatch):
    """shortest_paths: every given pair, also of nodes that are not reached or not there, as path_to gives them."""
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("x", "c"), ("a", "c")], E)
    pairs = [("a", "c"), ("a", "a"), ("c", "a"), ("q", "q"), ("q", "a"), ("a", "q"), ("x", "b"), ("x", "c")]
    want = {("a", "c", 1, "a -> c"), ("a", "a", 0, "a"), ("q", "q", 0, "q"), ("x", "c", 1, "x -> c")}
    want |= {(*p, -1, "NOT FOUND") for p in (("c", "a"), ("q", "a"), ("a", "q"), ("x", "b"))}
    frame = spark.createDataFrame(pairs, "start string, node string")
    for most in (paths.MOST_EDGES, 0):
        monkeypatch.setattr(paths, "MOST_EDGES", most)
        got = paths.shortest_paths(edges, frame)
        assert got.schema.simpleString() == "struct<start:string,node:string,path_length:int,path:string>"
        assert sorted(map(tuple, got.collect())) == sorted(want)


def test_images_in_parts_by_their_edges(spark, monkeypatch):
    """edge_tile_images: a tile of few edges is one image, however far apart their ids are; parts make the same image."""
    rows = [(k * 3 * tiles.PART, 40.0 * k, 900.0, 1900.0, 30.0 * k + 5, [200, k, 3], [1, 2, 250 - k], 90 + k, False) for k in range(9)]
    schema = "edge_id long, x1 double, y1 double, x2 double, y2 double, rgb1 array<int>, rgb2 array<int>, alpha int, missing boolean"
    geometry = spark.createDataFrame(rows, schema).cache()
    member = tiles.edge_tiles(geometry, 1).cache()
    key = lambda df: {tuple(r[:3]): bytes(r["png"]) for r in df.collect()}
    image = np.zeros((tiles.TILE, tiles.TILE, 4), np.uint8)
    for _, x1, y1, x2, y2, c1, c2, alpha, _ in rows:
        a, b = (x1 / 2, y1 / 2), (x2 / 2, y2 / 2)
        tiles.draw_gradient(image, a, b, (*c1, alpha), (*c2, alpha), 1)
        tiles.draw_triangle(image, tiles.arrow(a, b, 7, 4.0), (*c2, alpha))
    stacked = tiles._stacked
    monkeypatch.setattr(tiles, "_stacked", None)
    whole = key(tiles.render_edges(member, geometry, 1))
    assert whole[0, 0, 0] == tiles.png(image) and key(tiles.draw_edges(geometry, 1)) == whole
    monkeypatch.setattr(tiles, "_stacked", stacked)
    monkeypatch.setattr(tiles, "PART", 4)
    assert [len(r["cuts"]) for r in tiles._cuts(member).where("zoom = 0").collect()] == [3]
    assert key(tiles.draw_edges(geometry, 1)) == whole


def core_graph():
    """Edges of a component with a core, ways into it and out of it, side branches, and some small components."""
    rng = np.random.default_rng(5)
    pairs = {(f"t{a}", f"t{b}") for a, b in rng.integers(0, 500, (640, 2)).tolist()}
    pairs |= {("z1", "z2"), ("z2", "z1"), ("y1", "y2"), *((f"a{i}", f"a{i + 1}") for i in range(90)), ("a40", "t1")}
    return sorted(pairs)


@pytest.mark.parametrize("alone", [1 << 17, 1])
def test_farthest_by_few_searches(spark, monkeypatch, alone):
    """bfs_farthest: with many starts, searches back from few nodes give every start's farthest one, in one task or many."""
    pairs = core_graph()
    edges = spark.createDataFrame(pairs, E)
    starts = spark.createDataFrame([(a,) for a in sorted({a for p in pairs for a in p})] + [("nowhere",)], "page_title string")
    for name, value in {"MANY": 1, "CORE": 100, "LEAST_CORE": 20, "ALONE": alone, "WORDS": 1}.items():
        monkeypatch.setattr(paths, name, value)
    g = paths._by_component(edges)
    core, back, swept = paths._Core(g), g.turned(), []
    assert len(core.middle) == 1 and (core.inner & ~core.reached).sum() > 50 and (~core.inner & core.reached).sum() > 50
    lo, hi = int(g.low[core.middle[0]]), int(g.high[core.middle[0]])

    def sweep(pivots, score):
        swept.extend(pivots.tolist())
        return paths._sweep(back, lo, hi, pivots, core.inner, score)

    paths._core_ends(g, core, int(core.middle[0]), sweep, 8)
    assert len(swept) < core.inner.sum() / 2
    got = {(r["start"], r["node"], r["depth"]) for r in paths.farthest_nodes(edges, starts).collect()}
    trees = {r["page_title"]: plain_search(pairs, r["page_title"]) for r in starts.collect()}
    ends = {s: min(tree, key=lambda x: (-tree[x][0], x)) for s, tree in trees.items()}
    assert got == {(s, e, trees[s][e][0]) for s, e in ends.items()}


def test_paths_by_their_ends(spark, monkeypatch):
    """eccentricities: paths of many starts to one end are followed together, without a search from each."""
    pairs = core_graph()
    edges = spark.createDataFrame(pairs, E)
    starts = spark.createDataFrame([(a,) for a in sorted({a for p in pairs for a in p})] + [("nowhere",)], "page_title string")
    trees = {r["page_title"]: plain_search(pairs, r["page_title"]) for r in starts.collect()}
    for name, value in {"MANY": 1, "CORE": 100, "LEAST_CORE": 20, "ABREAST": 7}.items():
        monkeypatch.setattr(paths, name, value)
    g = paths._by_component(edges)
    names = g.titles.to_pylist()
    for end in ("t1", "a91", "z"):
        if end not in names:
            continue
        i = names.index(end)
        lo, hi = int(g.low[i]), int(g.high[i])
        got = [x for d, p in paths._paths_into(g, np.arange(lo, hi), i, lo, paths._distances(g, i, lo, hi)) for x in zip(d.tolist(), p.to_pylist(), strict=True)]
        assert got == [(trees[s][end][0], plain_path(trees[s], end)) if end in trees[s] else (-1, None) for s in names[lo:hi]]
    got = {tuple(r) for r in paths.eccentricities(edges, starts).collect()}
    ends = {s: min(tree, key=lambda x: (-tree[x][0], x)) for s, tree in trees.items()}
    assert got == {(s, e, trees[s][e][0], plain_path(trees[s], e)) for s, e in ends.items()}


def test_pairs_of_a_core(spark, monkeypatch):
    """shortest_paths: pairs of starts with and without a way to the core, to few ends or many, reached or not."""
    pairs = core_graph()
    names = sorted({a for p in pairs for a in p}) + ["nowhere"]
    edges = spark.createDataFrame(pairs, E)
    for name, value in {"MANY": 1, "CORE": 100, "LEAST_CORE": 20}.items():
        monkeypatch.setattr(paths, name, value)
    rng = np.random.default_rng(3)
    some = {(s, e) for s in names for e in ("t1", "a50", names[rng.integers(len(names))])} | {("nowhere", "nowhere"), ("t1", "nowhere")}
    trees = {s: plain_search(pairs, s) for s in names}
    want = {(s, e, trees[s][e][0], plain_path(trees[s], e)) if e in trees[s] else (s, e, -1, "NOT FOUND") for s, e in some}
    for ends in (None, {"t1", "a50"}):
        mine = sorted(p for p in some if ends is None or p[1] in ends)
        got = paths.shortest_paths(edges, spark.createDataFrame(mine, "start string, node string")).collect()
        assert sorted(map(tuple, got)) == sorted(w for w in want if ends is None or w[1] in ends)


def test_ends_without_paths(spark, monkeypatch):
    """bfs_farthest, shortest_paths: the queries follow no paths only to learn the ends."""
    from graphloom.plans import queries as Q

    for name, value in {"MANY": 1, "CORE": 1024}.items():
        monkeypatch.setattr(paths, name, value)
    monkeypatch.setattr(paths, "eccentricities", None)
    assert Q.QUERIES["bfs_farthest"](spark, "/root/testdata/sf0.1").count() == 9405
    assert Q.QUERIES["shortest_paths"](spark, "/root/testdata/sf0.1").count() == 9405


@pytest.mark.parametrize("zoom", [0, 5])
def test_edges_drawn_at_once(monkeypatch, zoom):
    """edge_tile_images: lines and arrows of all edges at once make the image that one after the other makes."""
    rng = np.random.default_rng(zoom)
    size, (width, head, spread) = 256, tiles.edge_style(zoom)
    ends = np.concatenate([rng.uniform(-300, 560, (300, 4)), rng.integers(-2, 260, (60, 4)), rng.uniform(-30000, 30000, (200, 4))])
    ends[:9, 2:] = ends[:9, :2]
    ends[9:30, 2], ends[30:50, 3] = ends[9:30, 0], ends[30:50, 1]
    ends[50:60] = [[10, 10, 10 + 1e-7, 10], [255, 3, 255, 900], [-2, -2, -2, 300], [0, 0, 255, 255], [258, 0, 258, 99],
                   [-1, 256, 256, -1], [5, 5, 5.2, 5], [-1, 40, -1, 40], [256, 256, 250, 250], [100, -3, 100, 259]]
    rng.shuffle(ends)
    channels = rng.integers(0, 256, (len(ends), 7))
    paint = sum(channels[:, i].astype(np.int64) << 48 - 8 * i for i in range(7))
    image = np.zeros((size, size, 4), np.uint8)
    for (x1, y1, x2, y2), c in zip(ends.tolist(), channels.tolist(), strict=True):
        tiles.draw_gradient(image, (x1, y1), (x2, y2), (*c[:3], c[6]), (*c[3:6], c[6]), width)
        tiles.draw_triangle(image, tiles.arrow((x1, y1), (x2, y2), head, spread), (*c[3:6], c[6]))
    for pixels in (tiles.PIXELS, 500):
        monkeypatch.setattr(tiles, "PIXELS", pixels)
        assert (tiles.draw_all(ends, paint, width, head, spread, size) == image).all()
