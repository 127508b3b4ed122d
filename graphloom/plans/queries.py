"""Queries over the graph that the test tables describe, and the SQL that must give the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions import titles as T
from graphloom.operators import canonical, clusters, components, graph, ingest, layout, paths, tiles
from graphloom.sources.testgraph import graph_table, with_tables
from graphloom.storage import materialise, table
from graphloom.streaming import crawl

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def _filtered(spark: SparkSession, d: str) -> DataFrame:
    return graph.both_ends_in(graph_table(spark, d, "page_links"), graph_table(spark, d, "discovered_pages"))


def _searched(spark: SparkSession, d: str) -> DataFrame:
    return graph.both_ends_in(graph_table(spark, d, "page_links"), graph_table(spark, d, "searched_pages"))


_E = ", e AS (SELECT source_title, target_title FROM page_links WHERE source_title IN (SELECT page_title FROM discovered_pages) AND target_title IN (SELECT page_title FROM discovered_pages))"
FILTERED = with_tables("page_links", "discovered_pages") + _E
SEARCHED = with_tables("page_links", "searched_pages") + _E.replace("discovered_pages", "searched_pages")
_DEG = """, n AS (SELECT source_title AS page_title FROM e UNION SELECT target_title FROM e),
g AS (SELECT page_title, (SELECT count(*) FROM e WHERE target_title = page_title) AS in_degree,
  (SELECT count(*) FROM e WHERE source_title = page_title) AS out_degree FROM n)"""


@query(FILTERED + _DEG + """
SELECT page_title, in_degree, out_degree, round(least(18.0, greatest(1.5, 1.5 + 1.4 * ln(1.0 + in_degree))), 6) AS node_size
FROM g ORDER BY in_degree DESC, out_degree DESC, page_title LIMIT 100""")
def graph_top_nodes(spark: SparkSession, d: str) -> DataFrame:
    found = graph.degrees(_filtered(spark, d))
    size = F.round(graph.node_size(F.col("in_degree")), 6).alias("node_size")
    return found.select("page_title", "in_degree", "out_degree", size).orderBy(
        F.desc("in_degree"), F.desc("out_degree"), "page_title").limit(100)


@query(FILTERED + " SELECT source_title, target_title FROM e")
def filtered_edges(spark: SparkSession, d: str) -> DataFrame:
    return _filtered(spark, d)


@query(FILTERED + " SELECT source_title AS page_title FROM e UNION SELECT target_title FROM e")
def graph_nodes(spark: SparkSession, d: str) -> DataFrame:
    return graph.edge_nodes(_filtered(spark, d))


@query(FILTERED + """ SELECT page_title, row_number() OVER (ORDER BY page_title) - 1 AS id
FROM (SELECT source_title AS page_title FROM e UNION SELECT target_title FROM e)""")
def node_ids(spark: SparkSession, d: str) -> DataFrame:
    return graph.ids_of(graph.edge_nodes(_filtered(spark, d)))


@query(FILTERED + _DEG + " SELECT page_title, in_degree, out_degree FROM g")
def node_degrees(spark: SparkSession, d: str) -> DataFrame:
    return graph.degrees(_filtered(spark, d))


_SDEG = """, g AS (SELECT page_title, (SELECT count(*) FROM e WHERE target_title = page_title) AS in_degree,
  (SELECT count(*) FROM e WHERE source_title = page_title) AS out_degree FROM searched_pages)"""


@query(SEARCHED + _SDEG + " SELECT page_title, in_degree, out_degree FROM g WHERE in_degree = 0 OR out_degree = 0")
def dead_ends_and_orphans(spark: SparkSession, d: str) -> DataFrame:
    return graph.degrees(_searched(spark, d), graph_table(spark, d, "searched_pages")).where("in_degree = 0 or out_degree = 0")


@query(SEARCHED + _SDEG + """, s AS (SELECT count(*) AS total, count(*) FILTER (out_degree = 0) AS dead_ends,
 count(*) FILTER (in_degree = 0) AS orphans, count(*) FILTER (in_degree = 0 AND out_degree = 0) AS isolated,
 count(*) FILTER (out_degree > 0) AS starts, count(*) FILTER (in_degree > 0) AS ends FROM g)
SELECT *, printf('%.2f%%', 100.0 * dead_ends / total) AS dead_ends_share, printf('%.2f%%', 100.0 * orphans / total) AS orphans_share,
 printf('%.2f%%', 100.0 * isolated / total) AS isolated_share FROM s""")
def path_statistics(spark: SparkSession, d: str) -> DataFrame:
    return graph.path_statistics(graph.degrees(_searched(spark, d), graph_table(spark, d, "searched_pages")))


@query(FILTERED + """, b AS (SELECT source_title AS p, target_title AS q FROM e UNION SELECT target_title, source_title FROM e)
SELECT p AS page_title, string_agg(q, '|' ORDER BY q) AS neighbors FROM b GROUP BY p""")
def undirected_adjacency(spark: SparkSession, d: str) -> DataFrame:
    return graph.adjacency(_filtered(spark, d)).select("page_title", F.array_join("neighbors", "|").alias("neighbors"))


@query(FILTERED + """, n AS (SELECT source_title AS p FROM e UNION SELECT target_title FROM e)
SELECT p AS page_title, coalesce((SELECT string_agg(target_title, '|' ORDER BY target_title) FROM e WHERE source_title = p), '') AS outs,
 coalesce((SELECT string_agg(source_title, '|' ORDER BY source_title) FROM e WHERE target_title = p), '') AS ins FROM n""")
def directed_adjacency(spark: SparkSession, d: str) -> DataFrame:
    return graph.directed_adjacency(_filtered(spark, d)).select(
        "page_title", F.array_join("out", "|").alias("outs"), F.array_join("in", "|").alias("ins"))


@query(with_tables("page_links") + " SELECT target_title FROM page_links WHERE source_title = 'C1'")
def out_targets(spark: SparkSession, d: str) -> DataFrame:
    return graph.out_targets(graph_table(spark, d, "page_links"), "C1")


@query(with_tables("discovered_pages") + " SELECT count(*) AS n, count(*) < 72666 AS refresh FROM discovered_pages")
def discovered_count(spark: SparkSession, d: str) -> DataFrame:
    return graph_table(spark, d, "discovered_pages").agg(F.count(F.lit(1)).alias("n"), (F.count(F.lit(1)) < 72666).alias("refresh"))


@query(with_tables("discovered_pages", "searched_pages") + """ SELECT page_title FROM discovered_pages
WHERE page_title NOT IN (SELECT page_title FROM searched_pages) ORDER BY page_title LIMIT 50""")
def pending_titles(spark: SparkSession, d: str) -> DataFrame:
    return ingest.pending(graph_table(spark, d, "discovered_pages"), graph_table(spark, d, "searched_pages"), 50)


@query(with_tables("discovered_pages") + """ SELECT (k - 1) // 20 AS batch, (k - 1) % 20 AS pos, page_title
FROM (SELECT page_title, row_number() OVER (ORDER BY page_title) AS k FROM discovered_pages)""")
def crawl_batches(spark: SparkSession, d: str) -> DataFrame:
    return ingest.batches(graph_table(spark, d, "discovered_pages"))


_UPSERT = """, p AS (SELECT page_title, 1 AS v FROM discovered_pages), q AS (SELECT page_title, 2 AS v FROM searched_pages)"""


@query(with_tables("discovered_pages", "searched_pages") + _UPSERT + """ SELECT page_title, v FROM p UNION ALL
SELECT page_title, v FROM q WHERE page_title NOT IN (SELECT page_title FROM p)""")
def insert_or_ignore(spark: SparkSession, d: str) -> DataFrame:
    p, q = (graph_table(spark, d, t).withColumn("v", F.lit(v)) for t, v in (("discovered_pages", 1), ("searched_pages", 2)))
    return ingest.insert_or_ignore(p, q, ["page_title"])


@query(with_tables("discovered_pages", "searched_pages") + _UPSERT + """ SELECT page_title, v FROM q UNION ALL
SELECT page_title, v FROM p WHERE page_title NOT IN (SELECT page_title FROM q)""")
def upsert(spark: SparkSession, d: str) -> DataFrame:
    p, q = (graph_table(spark, d, t).withColumn("v", F.lit(v)) for t, v in (("discovered_pages", 1), ("searched_pages", 2)))
    return ingest.upsert(p, q, ["page_title"])


@query(with_tables("discovered_pages", "searched_pages") + """ SELECT page_title FROM discovered_pages
WHERE page_title NOT IN (SELECT page_title FROM searched_pages)""")
def clean_failed(spark: SparkSession, d: str) -> DataFrame:
    return ingest.clean_failed(graph_table(spark, d, "discovered_pages"), graph_table(spark, d, "searched_pages"))


# ------------------------------------------------------------------------------------------------ titles, aliases

_PY_SPACE = r"[\s\x0b\x1c-\x1f\x85\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"


def _sql_fold(x: str) -> str:
    return f"replace(lower(upper(lower({x}))), 'ß', 'ss')"


_T = (
    with_tables("dirty_links")
    + f""", l AS (SELECT * FROM dirty_links WHERE source_title <> '' AND target_title <> ''),
ti AS (SELECT source_title AS title FROM l UNION SELECT target_title FROM l),
f2 AS (SELECT title, translate(trim(regexp_replace(title, '{_PY_SPACE}', ' ', 'g')), '‘’ʼ`', '''''''''') AS plain FROM ti),
f3 AS (SELECT *, regexp_replace(plain, '(?i)\\s+\\(disambiguation\\)$', '') AS bare FROM f2),
f4 AS (SELECT *, {_sql_fold('bare')} AS family, {_sql_fold('plain')} AS spelling,
  CASE WHEN plain <> bare THEN 1 ELSE 0 END AS suffixed,
  CASE WHEN regexp_matches(plain, '(^|[^\\p{{L}}])\\p{{Ll}}') OR regexp_matches(plain, '\\p{{L}}\\p{{Lu}}') THEN 0 ELSE -1 END AS cased,
  length(bare) AS len FROM f3),
rk AS (SELECT *, first_value(title) OVER w AS canonical, first_value(spelling) OVER w AS best_spelling, count(*) OVER (PARTITION BY family) AS n
  FROM f4 WINDOW w AS (PARTITION BY family ORDER BY suffixed, cased, len, spelling, title)),
al AS (SELECT title AS old_title, CASE WHEN spelling = best_spelling THEN canonical WHEN bare IN (SELECT title FROM ti) AND bare <> title THEN bare END AS canonical_title
  FROM rk WHERE n > 1 AND title <> canonical),
am AS (SELECT * FROM al WHERE canonical_title IS NOT NULL),
cl AS (SELECT DISTINCT coalesce(a.canonical_title, l.source_title) AS source_title, coalesce(b.canonical_title, l.target_title) AS target_title
  FROM l LEFT JOIN am a ON a.old_title = l.source_title LEFT JOIN am b ON b.old_title = l.target_title)"""
)


def _dirty(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    links = materialise(graph_table(spark, d, "dirty_links").where("source_title <> '' and target_title <> ''"), "dirty_links")
    return {"page_links": links}


def _aliases(t: dict[str, DataFrame]) -> DataFrame:
    return materialise(canonical.alias_map(canonical.all_titles(t)), "aliases")


@query(_T + " SELECT title, plain, bare, family, cased FROM f4")
def title_functions(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("title")
    return canonical.all_titles(_dirty(spark, d)).select(
        "title", T.plain_apostrophes(t).alias("plain"), T.without_suffix(t).alias("bare"), T.family_key(t).alias("family"),
        F.when(T.is_title_case(T.plain_apostrophes(t)), -1).otherwise(0).alias("cased"))


@query(_T + " SELECT old_title, canonical_title FROM am")
def alias_map(spark: SparkSession, d: str) -> DataFrame:
    return canonical.alias_map(canonical.all_titles(_dirty(spark, d)))


@query(_T + " SELECT old_title, canonical_title FROM am ORDER BY old_title LIMIT 20")
def alias_sample(spark: SparkSession, d: str) -> DataFrame:
    return canonical.alias_map(canonical.all_titles(_dirty(spark, d))).orderBy("old_title").limit(20)


@query(_T + " SELECT source_title, target_title FROM cl")
def canonical_links(spark: SparkSession, d: str) -> DataFrame:
    t = _dirty(spark, d)
    return canonical.canonical_links(t["page_links"], _aliases(t))


@query(_T + """ SELECT (SELECT count(*) FROM l) AS edges_before, (SELECT count(*) FROM ti) AS nodes_before, (SELECT count(*) FROM cl) AS edges_after,
(SELECT count(*) FROM (SELECT source_title FROM cl UNION SELECT target_title FROM cl)) AS nodes_after""")
def canonical_counts(spark: SparkSession, d: str) -> DataFrame:
    t = _dirty(spark, d)
    after = materialise(canonical.canonical_links(t["page_links"], _aliases(t)), "after")
    parts = []
    for name, df in (("before", t["page_links"]), ("after", after)):
        parts += [df.agg(F.count(F.lit(1)).alias(f"edges_{name}")), graph.edge_nodes(df).agg(F.count(F.lit(1)).alias(f"nodes_{name}"))]
    out = parts[0]
    for p in parts[1:]:
        out = out.crossJoin(p)  # a row each
    return out


_PG = """, pg AS (SELECT source_title AS page_title, count(*) AS links_out_count, NULL AS categories_count,
 CASE WHEN count(*) % 3 = 0 THEN concat('e', source_title) END AS error_message FROM l GROUP BY source_title),
cp AS (SELECT coalesce(canonical_title, page_title) AS page_title, max(coalesce(links_out_count, 0)) AS links_out_count,
 max(coalesce(categories_count, 0)) AS categories_count, min(error_message) AS error_message FROM pg LEFT JOIN am ON old_title = page_title GROUP BY 1)"""


def _pages(links: DataFrame) -> DataFrame:
    out = links.groupBy(F.col("source_title").alias("page_title")).agg(F.count(F.lit(1)).alias("links_out_count"))
    error = F.when(F.col("links_out_count") % 3 == 0, F.concat(F.lit("e"), F.col("page_title")))
    return out.select("page_title", "links_out_count", F.lit(None).cast("int").alias("categories_count"), error.alias("error_message"))


@query(_T + _PG + " SELECT page_title, links_out_count, CAST(categories_count AS INT) AS categories_count, error_message FROM cp")
def canonical_pages(spark: SparkSession, d: str) -> DataFrame:
    t = _dirty(spark, d)
    return canonical.canonical_pages(_pages(t["page_links"]), _aliases(t))


@query(_T + """, fl AS (SELECT title AS page_title, CASE WHEN length(title) % 3 > 0 THEN concat('e', length(title) % 7) END AS error_message FROM ti)
SELECT coalesce(canonical_title, page_title) AS page_title, min(error_message) AS error_message FROM fl LEFT JOIN am ON old_title = page_title GROUP BY 1""")
def canonical_failed(spark: SparkSession, d: str) -> DataFrame:
    t = _dirty(spark, d)
    error = F.when(F.length("title") % 3 > 0, F.concat(F.lit("e"), (F.length("title") % 7).cast("string")))
    return canonical.canonical_failed(canonical.all_titles(t).select(F.col("title").alias("page_title"), error.alias("error_message")), _aliases(t))


@query(_T + """ SELECT title, replace(lower(trim(regexp_replace(replace(title, '_', ' '), '\\s+', ' ', 'g'))), 'ß', 'ss') AS match_key,
replace(replace(url_encode(replace(title, ' ', '_')), '%28', '('), '%29', ')') AS page_path, regexp_replace('Category:' || title, '^Category:', '') AS category_name FROM ti""")
def title_forms(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("title")
    return canonical.all_titles(_dirty(spark, d)).select("title", T.match_key(t).alias("match_key"), T.page_path(t).alias("page_path"),
                                                         T.category_name(F.concat(F.lit("Category:"), t)).alias("category_name"))


@query(_T + """ SELECT coalesce(canonical_title, title) AS page_title, min(length(title) % 5) AS cluster_id FROM ti LEFT JOIN am ON old_title = title GROUP BY 1""")
def canonical_clusters(spark: SparkSession, d: str) -> DataFrame:
    t = _dirty(spark, d)
    rows = canonical.all_titles(t).select(F.col("title").alias("page_title"), (F.length("title") % 5).cast("long").alias("cluster_id"))
    return canonical.canonical_clusters(rows, _aliases(t))


@query(_T + """, nl AS (SELECT title AS page_title, length(title) % 4 AS node_size, length(title) % 3 AS out_degree, length(title) % 2 AS in_degree FROM ti)
SELECT coalesce(canonical_title, page_title) AS page_title, node_size, out_degree, in_degree FROM nl LEFT JOIN am ON old_title = page_title
QUALIFY row_number() OVER (PARTITION BY coalesce(canonical_title, page_title) ORDER BY node_size DESC, out_degree DESC, in_degree DESC, page_title) = 1""")
def canonical_layout(spark: SparkSession, d: str) -> DataFrame:
    t = _dirty(spark, d)
    mod = lambda k: (F.length("title") % k).cast("long")
    rows = canonical.all_titles(t).select(F.col("title").alias("page_title"), mod(4).alias("node_size"), mod(3).alias("out_degree"), mod(2).alias("in_degree"))
    return canonical.canonical_layout(rows, _aliases(t))


@query(_T + _PG + """, ends AS (SELECT source_title AS page_title FROM cl UNION SELECT target_title FROM cl)
SELECT page_title, links_out_count, CAST(categories_count AS INT) AS categories_count, error_message FROM cp UNION ALL
SELECT page_title, 0, 0, NULL FROM ends WHERE page_title NOT IN (SELECT page_title FROM cp)""")
def backfilled_pages(spark: SparkSession, d: str) -> DataFrame:
    t = _dirty(spark, d)
    seen = t["page_links"].select(F.col("source_title").alias("page_title")).distinct()
    return canonical.canonicalise(t | {"pages": _pages(t["page_links"]), "discovered_pages": seen})["pages"]


# ---------------------------------------------------------------------------------------- categories and clusters

_STRIP = "regexp_replace({0}, '^\\s+|\\s+$', '', 'g')"


@query(with_tables("page_categories") + f""" SELECT page_title, string_agg(c, '||' ORDER BY c) AS categories
FROM (SELECT page_title, {_STRIP.format('category_name')} AS c FROM page_categories) WHERE c <> '' GROUP BY page_title""")
def page_categories(spark: SparkSession, d: str) -> DataFrame:
    found = graph.grouped_categories(graph_table(spark, d, "page_categories"))
    return found.select("page_title", F.array_join("categories", "||").alias("categories"))


_GENERIC = "|".join(clusters.GENERIC)
_CAND = f""", r AS (SELECT page_title, cluster_id, trim(regexp_replace(category_name, '\\s+', ' ', 'g')) AS name FROM page_categories JOIN cluster_assignments USING (page_title)),
s AS (SELECT *, row_number() OVER (PARTITION BY page_title, lower(name) ORDER BY name) AS k FROM r WHERE name <> '' AND NOT regexp_matches(lower(name), '{_GENERIC}')),
c AS (SELECT cluster_id, name, sum(CASE WHEN k = 1 THEN 1 ELSE 0 END) AS coverage, count(*) AS uses FROM s GROUP BY ALL)"""


@query(with_tables("page_categories", "cluster_assignments") + _CAND + """ SELECT cluster_id, name, CAST(coverage AS BIGINT) AS coverage, uses,
row_number() OVER (PARTITION BY cluster_id ORDER BY coverage DESC, uses DESC, length(name), lower(name), name) AS rank FROM c QUALIFY coverage > 0""")
def cluster_name_candidates(spark: SparkSession, d: str) -> DataFrame:
    return clusters.name_candidates(graph_table(spark, d, "cluster_assignments"), graph_table(spark, d, "page_categories"))


_NAMES = """, rk AS (SELECT cluster_id, name, row_number() OVER (PARTITION BY cluster_id ORDER BY coverage DESC, uses DESC, length(name), lower(name), name) AS rank
 FROM c WHERE coverage > 0),
cl AS (SELECT cluster_id, row_number() OVER (ORDER BY cluster_id) AS k, array_to_string(list(page_title ORDER BY page_title)[1:2], ' / ') AS fallback
 FROM cluster_assignments GROUP BY cluster_id),
ls AS (SELECT k, cl.cluster_id, fallback, coalesce(list(name ORDER BY rank) FILTER (name IS NOT NULL), []) AS names FROM cl LEFT JOIN rk ON rk.cluster_id = cl.cluster_id GROUP BY ALL),
gr AS (SELECT CAST(0 AS BIGINT) AS k, CAST([] AS VARCHAR[]) AS used, CAST(NULL AS VARCHAR) AS name
 UNION ALL SELECT ls.k, CASE WHEN p IS NULL THEN used ELSE list_append(used, lower(p)) END, p
 FROM (SELECT ls.k, used, list_filter(names, lambda x: NOT list_contains(used, lower(x)))[1] AS p FROM gr JOIN ls ON ls.k = gr.k + 1) s JOIN ls ON ls.k = s.k)"""


@query((with_tables("page_categories", "cluster_assignments") + _CAND + _NAMES).replace("WITH ", "WITH RECURSIVE ", 1) + """
 SELECT ls.cluster_id, coalesce(gr.name, fallback) AS cluster_name FROM gr JOIN ls ON ls.k = gr.k""")
def cluster_names(spark: SparkSession, d: str) -> DataFrame:
    found = clusters.cluster_names(graph_table(spark, d, "cluster_assignments"), graph_table(spark, d, "page_categories"))
    return found.select(F.col("cluster_id").cast("int").alias("cluster_id"), "cluster_name")


_COLOR = """, k AS (SELECT DISTINCT cluster_id FROM cluster_assignments), h AS (SELECT cluster_id, (cluster_id * 0.618033988749895e0) % 1.0e0 AS h FROM k),
i AS (SELECT *, CAST(floor(h * 6.0e0) AS INT) AS i, h * 6.0e0 - floor(h * 6.0e0) AS f FROM h),
v AS (SELECT *, 0.9e0 AS v, 0.9e0 * (1.0e0 - 0.65e0) AS p, 0.9e0 * (1.0e0 - 0.65e0 * f) AS q, 0.9e0 * (1.0e0 - 0.65e0 * (1.0e0 - f)) AS t FROM i),
m AS (SELECT cluster_id, [v, q, p, p, t, v][i % 6 + 1] AS r, [t, v, v, q, p, p][i % 6 + 1] AS g, [p, p, t, v, v, q][i % 6 + 1] AS b FROM v)"""


@query(with_tables("cluster_assignments") + _COLOR + """ SELECT cluster_id,
printf('#%02x%02x%02x', CAST(trunc(r * 255) AS INT), CAST(trunc(g * 255) AS INT), CAST(trunc(b * 255) AS INT)) AS cluster_color FROM m""")
def cluster_colors(spark: SparkSession, d: str) -> DataFrame:
    rows = graph_table(spark, d, "cluster_assignments").select("cluster_id").distinct()
    return rows.select("cluster_id", clusters.color(F.col("cluster_id")).alias("cluster_color"))


@query(with_tables("cluster_assignments") + """, s AS (SELECT count(*) AS size FROM cluster_assignments GROUP BY cluster_id)
SELECT count(*) AS clusters, min(size) AS smallest, max(size) AS largest, round(avg(size), 6) AS average,
count(*) FILTER (size = 1) AS singletons, count(*) FILTER (size < 5) AS below_5, count(*) FILTER (size < 10) AS below_10 FROM s""")
def cluster_statistics(spark: SparkSession, d: str) -> DataFrame:
    return clusters.cluster_statistics(graph_table(spark, d, "cluster_assignments"))


@query(FILTERED.replace("WITH ", with_tables("cluster_assignments") + ", ", 1) + """,
u AS (SELECT DISTINCT least(source_title, target_title) AS s, greatest(source_title, target_title) AS t FROM e)
SELECT least(x.cluster_id, y.cluster_id) AS a, greatest(x.cluster_id, y.cluster_id) AS b, count(*) AS weight
FROM u JOIN cluster_assignments x ON x.page_title = s JOIN cluster_assignments y ON y.page_title = t WHERE x.cluster_id <> y.cluster_id GROUP BY ALL""")
def cluster_weights(spark: SparkSession, d: str) -> DataFrame:
    return clusters.cluster_weights(_filtered(spark, d), graph_table(spark, d, "cluster_assignments"))


_CC = FILTERED.replace("WITH ", "WITH RECURSIVE ", 1) + """, b AS (SELECT source_title AS p, target_title AS q FROM e UNION SELECT target_title, source_title FROM e),
reach AS (SELECT p AS node, p AS seen FROM b UNION SELECT r.node, b.q FROM reach r JOIN b ON b.p = r.seen),
cc AS (SELECT node AS page_title, min(seen) AS component FROM reach GROUP BY node)"""


@query(_CC + " SELECT page_title, component, count(*) OVER (PARTITION BY component) AS size FROM cc")
def connected_components(spark: SparkSession, d: str) -> DataFrame:
    return components.component_sizes(_filtered(spark, d))


@query(_CC + """, z AS (SELECT page_title, count(*) OVER (PARTITION BY component) AS size FROM cc)
SELECT source_title, target_title FROM e WHERE source_title IN (SELECT page_title FROM z WHERE size > 2)""")
def without_small_components(spark: SparkSession, d: str) -> DataFrame:
    return components.without_small(_filtered(spark, d))


@query()
def communities(spark: SparkSession, d: str) -> DataFrame:
    return clusters.communities(_filtered(spark, d))


@query()
def graph_layout(spark: SparkSession, d: str) -> DataFrame:
    assigned = graph_table(spark, d, "cluster_assignments")
    colors = assigned.select("cluster_id").distinct().select("cluster_id", clusters.color(F.col("cluster_id")).alias("cluster_color"))
    return layout.layout(_filtered(spark, d), assigned, colors)


# ----------------------------------------------------------------------------------------------------------- paths

_BFS = SEARCHED.replace("WITH ", "WITH RECURSIVE ", 1) + """, st AS (SELECT DISTINCT source_title AS start FROM e),
t(start, node, depth) USING KEY (start, node) AS (SELECT start, start, 0 FROM st UNION
 SELECT t.start, e.target_title, min(t.depth) + 1 FROM t JOIN e ON e.source_title = t.node
 WHERE NOT EXISTS (SELECT 1 FROM recurring.t r WHERE r.start = t.start AND r.node = e.target_title) GROUP BY t.start, e.target_title)"""
_TREE = _BFS + """, tr AS (SELECT t.start, t.node, t.depth, min(p.node) AS pred FROM t LEFT JOIN e ON e.target_title = t.node AND t.depth > 0
 LEFT JOIN t p ON p.start = t.start AND p.node = e.source_title AND p.depth = t.depth - 1 GROUP BY ALL)"""
_FAR = _TREE + """, fa AS (SELECT start, node, depth FROM tr QUALIFY row_number() OVER (PARTITION BY start ORDER BY depth DESC, node) = 1),
up(start, node, here, path) AS (SELECT start, node, node, node FROM fa UNION ALL
 SELECT up.start, up.node, tr.pred, tr.pred || ' -> ' || up.path FROM up JOIN tr ON tr.start = up.start AND tr.node = up.here WHERE tr.pred IS NOT NULL),
pa AS (SELECT start, node, path FROM up WHERE here = start)"""


def _searches(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Searched edges, and every page that has a way out."""
    edges = materialise(_searched(spark, d), "edges")
    return edges, edges.select(F.col("source_title").alias("page_title")).distinct()


@query(_TREE + " SELECT * FROM tr")
def bfs_tree(spark: SparkSession, d: str) -> DataFrame:
    return paths.bfs(*_searches(spark, d))


@query(_BFS + " SELECT start, node AS farthest_title, depth FROM t QUALIFY row_number() OVER (PARTITION BY start ORDER BY depth DESC, node) = 1")
def bfs_farthest(spark: SparkSession, d: str) -> DataFrame:
    found = paths.farthest_nodes(*_searches(spark, d))
    return found.select("start", F.col("node").alias("farthest_title"), F.col("depth").cast("int").alias("depth"))


@query(_FAR + """ SELECT start AS start_node, node AS farthest_node, CAST(depth AS BIGINT) AS depth, path FROM fa JOIN pa USING (start, node)""")
def eccentricities(spark: SparkSession, d: str) -> DataFrame:
    return paths.eccentricities(*_searches(spark, d))


@query(_FAR + " SELECT start, node, depth AS path_length, path FROM fa JOIN pa USING (start, node)")
def shortest_paths(spark: SparkSession, d: str) -> DataFrame:
    edges, starts = _searches(spark, d)
    return paths.shortest_paths(edges, materialise(paths.farthest_nodes(edges, starts).select("start", "node"), "ends"))


_SUMMARY = _TREE.replace("SELECT DISTINCT source_title AS start FROM e", "SELECT min(source_title) AS start FROM e") + """,
en AS (SELECT max(target_title) AS node FROM e), fa AS (SELECT node, depth FROM tr ORDER BY depth DESC, node LIMIT 1),
up(node, here, path) AS (SELECT node, node, node FROM tr WHERE node IN (SELECT node FROM en UNION SELECT node FROM fa) UNION ALL
 SELECT up.node, tr.pred, tr.pred || ' -> ' || up.path FROM up JOIN tr ON tr.node = up.here WHERE tr.pred IS NOT NULL),
pa AS (SELECT node, path FROM up WHERE here = (SELECT start FROM st))"""


@query(_SUMMARY + """ SELECT x.depth IS NOT NULL AS found, coalesce(x.depth, -1) AS target_path_length, coalesce(p.path, 'NOT FOUND') AS target_path,
 fa.depth AS longest_path_length, fa.node AS farthest_title, q.path AS longest_path
FROM en CROSS JOIN fa JOIN pa q ON q.node = fa.node LEFT JOIN tr x ON x.node = en.node LEFT JOIN pa p ON p.node = en.node""")
def bfs_summary(spark: SparkSession, d: str) -> DataFrame:
    edges = materialise(_searched(spark, d), "edges")
    ends = edges.agg(F.min("source_title"), F.max("target_title")).first()
    return paths.bfs_summary(edges, ends[0], ends[1])


#: Walks into each page; the operator's own figure is for a run of hours.
WALKS = 1000


@query()
def longest_incoming_paths(spark: SparkSession, d: str) -> DataFrame:
    edges = materialise(_searched(spark, d), "edges")
    return paths.longest_incoming(edges, edges.select(F.col("target_title").alias("page_title")).distinct(), WALKS)


_RES = """res AS (SELECT o_custkey AS start, CASE WHEN o_orderkey % 7 = 0 THEN 'n/a' ELSE CAST(o_custkey % 97 AS STRING) END AS path_length,
 o_orderkey AS line FROM orders)"""


@query("WITH " + _RES.replace("STRING", "VARCHAR") + """ SELECT start, TRY_CAST(path_length AS INT) AS path_length, line,
 (SELECT max(TRY_CAST(path_length AS INT)) FROM res) AS greatest FROM res
WHERE TRY_CAST(path_length AS INT) IS NOT NULL ORDER BY TRY_CAST(path_length AS INT) DESC, line LIMIT 1""")
def best_result(spark: SparkSession, d: str) -> DataFrame:
    table(spark, d, "orders").createOrReplaceTempView("orders")
    rows = spark.sql("WITH " + _RES + " SELECT * FROM res")
    return paths.best_row(rows).crossJoin(paths.greatest_length(rows))  # a row each


# ----------------------------------------------------------------------------------------------------------- tiles

_LB = with_tables("nodes_layout") + """, b AS (SELECT min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM nodes_layout),
s AS (SELECT n.*, (x - x0) / greatest(x1 - x0, 1e-9) AS u, (y1 - y) / greatest(y1 - y0, 1e-9) AS v FROM nodes_layout n, b)"""


def _layout(spark: SparkSession, d: str) -> DataFrame:
    return graph_table(spark, d, "nodes_layout")


def _colors(spark: SparkSession, d: str) -> DataFrame:
    rows = graph_table(spark, d, "cluster_assignments").select("cluster_id").distinct()
    name = F.when(F.col("cluster_id") % 5 != 0, F.concat(F.lit("cluster "), F.col("cluster_id").cast("string")))
    return rows.select("cluster_id", clusters.color(F.col("cluster_id")).alias("cluster_color"), name.alias("cluster_name"))


_PT = _LB + """, z AS (SELECT unnest([6, 7]) AS zoom), pt AS (SELECT page_title, zoom,
greatest(0, least((1 << zoom) - 1, CAST(trunc(u * (1 << zoom)) AS INT))) AS tx, greatest(0, least((1 << zoom) - 1, CAST(trunc(v * (1 << zoom)) AS INT))) AS ty FROM s, z)"""


@query(_LB + " SELECT x0 AS min_x, x1 AS max_x, y0 AS min_y, y1 AS max_y FROM b")
def layout_bounds(spark: SparkSession, d: str) -> DataFrame:
    return tiles.bounds(_layout(spark, d))


@query(_PT + " SELECT page_title, CAST(zoom AS INT) AS zoom, CAST(tx AS INT) AS tx, CAST(ty AS INT) AS ty FROM pt")
def point_tiles(spark: SparkSession, d: str) -> DataFrame:
    return tiles.point_tiles(_layout(spark, d), [6, 7]).select("page_title", "zoom", "tx", "ty")


@query(_PT + """ SELECT CAST(zoom AS INT) AS zoom, CAST(1 << zoom AS INT) AS tiles_per_axis, count(DISTINCT tx * 1000 + ty) AS node_tiles,
count(*) AS included_nodes, zoom >= 6 AS interactive_enabled FROM pt GROUP BY zoom""")
def tile_statistics(spark: SparkSession, d: str) -> DataFrame:
    return tiles.tile_statistics(tiles.point_tiles(_layout(spark, d), [6, 7]))


_DISC = _LB + """, g AS (SELECT *, u * 8192.0e0 AS gx, v * 8192.0e0 AS gy, greatest(1, CAST(trunc(greatest(1.0e0, node_size * (0.35e0 + 0.15e0 * 3))) AS INT)) AS radius FROM s),
r AS (SELECT *, greatest(0, least(7, CAST(floor((gx - radius) / 1024) AS INT))) AS a0, greatest(0, least(7, CAST(floor((gx + radius) / 1024) AS INT))) AS a1,
 greatest(0, least(7, CAST(floor((gy - radius) / 1024) AS INT))) AS c0, greatest(0, least(7, CAST(floor((gy + radius) / 1024) AS INT))) AS c1 FROM g),
x AS (SELECT *, unnest(generate_series(a0, a1)) AS tx FROM r), dt AS (SELECT *, unnest(generate_series(c0, c1)) AS ty FROM x),
dd AS (SELECT page_title, CAST(tx AS INT) AS tx, CAST(ty AS INT) AS ty, gx - tx * 1024 AS lx, gy - ty * 1024 AS ly, CAST(radius AS DOUBLE) AS radius FROM dt)"""


@query(_DISC + " SELECT page_title, tx, ty, round(lx, 6) AS local_x, round(ly, 6) AS local_y, radius FROM dd")
def disc_tiles(spark: SparkSession, d: str) -> DataFrame:
    found = tiles.disc_tiles(_layout(spark, d), 3)
    return found.select("page_title", "tx", "ty", F.round("local_x", 6).alias("local_x"), F.round("local_y", 6).alias("local_y"), "radius")


@query(_DISC + """ SELECT page_title, CAST(tx // 2 AS INT) AS tx, CAST(ty // 2 AS INT) AS ty, round(lx / 2 + (tx % 2) * 512, 6) AS local_x,
round(ly / 2 + (ty % 2) * 512, 6) AS local_y, greatest(1.0e0, radius / 2) AS radius FROM dd""")
def parent_disc_tiles(spark: SparkSession, d: str) -> DataFrame:
    found = tiles.parent_discs(tiles.disc_tiles(_layout(spark, d), 3))
    return found.select("page_title", "tx", "ty", F.round("local_x", 6).alias("local_x"), F.round("local_y", 6).alias("local_y"), "radius")


@query(_DISC + " SELECT tx, ty, count(*) AS ops, sum(count(*)) OVER () AS total FROM dd GROUP BY ALL")
def disc_counts(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    found = tiles.disc_tiles(_layout(spark, d), 3).groupBy("tx", "ty").agg(F.count(F.lit(1)).alias("ops"))
    return found.withColumn("total", F.sum("ops").over(Window.partitionBy()).cast("decimal(38,0)"))  # a row per tile


def _drawn(spark: SparkSession, d: str) -> DataFrame:
    return _layout(spark, d).join(_colors(spark, d).drop("cluster_name"), "cluster_id")


_GEO = _LB.replace("WITH ", with_tables("page_links", "cluster_assignments") + ", ", 1) + _COLOR + """,
kc AS (SELECT cluster_id, [CAST(trunc(r * 255) AS INT), CAST(trunc(g * 255) AS INT), CAST(trunc(b * 255) AS INT)] AS rgb FROM m),
nd AS (SELECT page_title, u * 65536.0e0 AS gx, v * 65536.0e0 AS gy, node_size, rgb FROM s JOIN kc USING (cluster_id)),
el AS (SELECT *, row_number() OVER (ORDER BY source_title || chr(1) || target_title) - 1 AS edge_id FROM page_links)
SELECT edge_id, source_title, target_title, round(p.gx, 6) AS x1, round(p.gy, 6) AS y1, round(q.gx, 6) AS x2, round(q.gy, 6) AS y2,
array_to_string(p.rgb, ',') AS c1, array_to_string(q.rgb, ',') AS c2, p.gx IS NULL OR q.gx IS NULL AS missing,
CASE WHEN p.gx IS NULL OR q.gx IS NULL THEN NULL ELSE CAST(round_even(greatest(40.0e0, least(255.0e0, 40.0e0 * greatest(0.9e0, least(2.6e0, 0.9e0 + 0.45e0 * ln(1.0e0 + greatest(p.node_size, q.node_size)))))), 0) AS INT) END AS alpha
FROM el LEFT JOIN nd p ON p.page_title = source_title LEFT JOIN nd q ON q.page_title = target_title"""


@query(_GEO)
def edge_geometry(spark: SparkSession, d: str) -> DataFrame:
    found = tiles.edge_geometry(graph_table(spark, d, "page_links"), _drawn(spark, d), 6)
    return found.select("edge_id", "source_title", "target_title", *[F.round(c, 6).alias(c) for c in ("x1", "y1", "x2", "y2")],
                        F.array_join("rgb1", ",").alias("c1"), F.array_join("rgb2", ",").alias("c2"), "missing", "alpha")


def _edge_tiles(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    geometry = materialise(tiles.edge_geometry(graph_table(spark, d, "page_links"), _drawn(spark, d), 6), "geometry")
    return materialise(tiles.edge_tiles(geometry, 6), "edge_tiles"), geometry


# The walk from border to border, a step at a time for all edges at once.
_WALK = _GEO.split("SELECT edge_id, source_title")[0].replace("WITH ", "WITH RECURSIVE ", 1) + """,
ge AS (SELECT edge_id, p.gx AS x1, p.gy AS y1, q.gx AS x2, q.gy AS y2 FROM el JOIN nd p ON p.page_title = source_title JOIN nd q ON q.page_title = target_title),
g1 AS (SELECT *, sign(x2 - x1) AS sx, sign(y2 - y1) AS sy, greatest(0, least(63, floor(x1 / 1024))) AS ax, greatest(0, least(63, floor(y1 / 1024))) AS ay,
 greatest(0, least(63, floor(x2 / 1024))) AS ex, greatest(0, least(63, floor(y2 / 1024))) AS ey FROM ge),
wk(edge_id, tx, ty, nx, ny, k) AS (SELECT edge_id, ax, ay,
 CASE WHEN sx = 0 THEN 'infinity'::DOUBLE ELSE ((ax + (sx > 0)::INT) * 1024 - x1) / (x2 - x1) END,
 CASE WHEN sy = 0 THEN 'infinity'::DOUBLE ELSE ((ay + (sy > 0)::INT) * 1024 - y1) / (y2 - y1) END, 0 FROM g1
 UNION ALL SELECT edge_id, tx, ty, nx, ny, k FROM (SELECT w.edge_id, w.tx + CASE WHEN w.nx <= w.ny THEN sx ELSE 0 END AS tx,
 w.ty + CASE WHEN w.ny <= w.nx THEN sy ELSE 0 END AS ty,
 CASE WHEN w.nx <= w.ny THEN w.nx + CASE WHEN sx = 0 THEN 'infinity'::DOUBLE ELSE 1024 / abs(x2 - x1) END ELSE w.nx END AS nx,
 CASE WHEN w.ny <= w.nx THEN w.ny + CASE WHEN sy = 0 THEN 'infinity'::DOUBLE ELSE 1024 / abs(y2 - y1) END ELSE w.ny END AS ny, w.k + 1 AS k
 FROM wk w JOIN g1 USING (edge_id) WHERE NOT (w.tx = ex AND w.ty = ey) AND w.k < 264) WHERE tx BETWEEN 0 AND 63 AND ty BETWEEN 0 AND 63),
et AS (SELECT DISTINCT CAST(z.zoom AS INT) AS zoom, CAST(tx AS INT) >> (6 - z.zoom)::INT AS tx, CAST(ty AS INT) >> (6 - z.zoom)::INT AS ty, edge_id
 FROM wk, (SELECT unnest(range(7)) AS zoom) z)"""


@query(_WALK + " SELECT * FROM et")
def edge_tiles(spark: SparkSession, d: str) -> DataFrame:
    return _edge_tiles(spark, d)[0]


@query(_WALK + """ SELECT zoom, count(*) AS memberships,
 count(DISTINCT xor(CAST(tx AS BIGINT) * 73856093, CAST(ty AS BIGINT) * 19349663) % 128) AS shards FROM et GROUP BY zoom""")
def edge_tile_shards(spark: SparkSession, d: str) -> DataFrame:
    found = _edge_tiles(spark, d)[0].withColumn("shard", tiles.shard(F.col("tx"), F.col("ty")))
    return found.groupBy("zoom").agg(F.count(F.lit(1)).alias("memberships"), F.countDistinct("shard").alias("shards"))


@query()
def edge_tile_images(spark: SparkSession, d: str) -> DataFrame:
    return tiles.draw_edges(tiles.edge_geometry(graph_table(spark, d, "page_links"), _drawn(spark, d), 6), 6)


@query()
def node_tile_images(spark: SparkSession, d: str) -> DataFrame:
    zoom = tiles.ZoomConfig().static_tile_max_zoom
    discs = level = tiles.disc_tiles(_drawn(spark, d), zoom)
    for _ in range(zoom):
        level = tiles.parent_discs(level)
        discs = discs.unionByName(level)
    return tiles.render_nodes(discs)


def _payload(spark: SparkSession, d: str) -> DataFrame:
    return graph.node_payload(_layout(spark, d), _colors(spark, d), graph_table(spark, d, "page_categories"))


_PAYLOAD = _COLOR + """,
kc AS (SELECT cluster_id, CASE WHEN cluster_id % 5 <> 0 THEN concat('cluster ', cluster_id) END AS cluster_name,
 printf('#%02x%02x%02x', CAST(trunc(r * 255) AS INT), CAST(trunc(g * 255) AS INT), CAST(trunc(b * 255) AS INT)) AS color FROM m),
py AS (SELECT page_title AS id, x, y, round(node_size, 6) AS size, color, nodes_layout.cluster_id, cluster_name, in_degree, out_degree,
 coalesce((SELECT string_agg(category_name, '||' ORDER BY category_name) FROM page_categories c WHERE c.page_title = nodes_layout.page_title), '') AS categories
 FROM nodes_layout LEFT JOIN kc ON kc.cluster_id = nodes_layout.cluster_id)"""
_PAY = with_tables("nodes_layout", "page_categories", "cluster_assignments") + _PAYLOAD


@query(_PAY + " SELECT * FROM py")
def node_payloads(spark: SparkSession, d: str) -> DataFrame:
    return _payload(spark, d).withColumns({"categories": F.array_join("categories", "||"), "size": F.round("size", 6)})


@query(_PAY + " SELECT id, color, row_number() OVER (ORDER BY lower(id), id) AS place FROM py")
def search_index(spark: SparkSession, d: str) -> DataFrame:
    rows = _payload(spark, d).select(F.col("id").alias("node"), "color").withColumn("page_title", F.concat_ws("\u0001", F.lower("node"), "node"))
    ids = graph.ids_of(rows.select("page_title"))
    return rows.join(ids, "page_title").select(F.col("node").alias("id"), "color", (F.col("id") + 1).alias("place"))


@query(_PT.replace("WITH ", with_tables("page_categories", "cluster_assignments") + ", ", 1) + _PAYLOAD + """,
pj AS (SELECT id, x, y, size, color, CAST(cluster_id AS INT) AS cluster_id, cluster_name, in_degree, out_degree,
 CASE WHEN categories = '' THEN [] ELSE string_split(categories, '||') END AS categories FROM py)
SELECT CAST(zoom AS INT) AS zoom, CAST(tx AS INT) AS tx, CAST(ty AS INT) AS ty, CAST(to_json(list(pj ORDER BY id)) AS VARCHAR) AS body
FROM pt JOIN pj ON pj.id = pt.page_title GROUP BY ALL""")
def chunk_json(spark: SparkSession, d: str) -> DataFrame:
    payload = _payload(spark, d).withColumn("size", F.round("size", 6))
    return tiles.chunk_json(tiles.point_tiles(_layout(spark, d), [6, 7]), payload)


@query(FILTERED.replace("WITH ", with_tables("nodes_layout") + ", ", 1) + """, t AS (SELECT source_title AS node_id FROM e UNION SELECT target_title FROM e),
o AS (SELECT source_title AS node_id, target_title AS q, 1 AS o, 0 AS i FROM e UNION ALL SELECT target_title, source_title, 0, 1 FROM e),
n AS (SELECT node_id, q, max(o) AS o, max(i) AS i FROM o GROUP BY ALL)
SELECT node_id, coalesce(string_agg(q, '|' ORDER BY q), '') AS neighbors, coalesce(string_agg(q, '|' ORDER BY q) FILTER (o = 1), '') AS outs,
 coalesce(string_agg(q, '|' ORDER BY q) FILTER (i = 1), '') AS ins,
 coalesce(string_agg(q, '|' ORDER BY q) FILTER (q IN (SELECT page_title FROM nodes_layout)), '') AS placed
FROM t JOIN n USING (node_id) GROUP BY node_id""")
def neighbourhoods(spark: SparkSession, d: str) -> DataFrame:
    edges = _filtered(spark, d)
    found = graph.neighbourhood(graph.edge_nodes(edges), edges, _layout(spark, d), _colors(spark, d), graph_table(spark, d, "page_categories"))
    ids = F.transform("neighbor_nodes", lambda s: s["id"])
    return found.select("node_id", *[F.array_join(c, "|").alias(n) for c, n in (("neighbors", "neighbors"), ("out", "outs"), ("in", "ins"))],
                        F.array_join(ids, "|").alias("placed"))


@query(_LB + """ SELECT a.page_title AS a, b.page_title AS b, round(sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2), 6) AS distance
FROM nodes_layout a JOIN nodes_layout b ON a.page_title < b.page_title AND abs(a.x - b.x) < 30 AND abs(a.y - b.y) < 30
WHERE sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) < 30""")
def close_pairs(spark: SparkSession, d: str) -> DataFrame:
    found = layout.close_pairs(_layout(spark, d).withColumnRenamed("page_title", "id"), 30.0)
    return found.select("a", "b", F.round("distance", 6).alias("distance"))


# -------------------------------------------------------------------------------------------------- crawl and layout

# Answers as the API gives them, made from the graph: by number of the title exact, normalised, redirected or spelt anew;
# every seventh batch fails, links to other namespaces and repeated ones are among the links.
_ASK = with_tables("page_links", "page_categories") + """, ask AS (SELECT CAST(c_custkey AS BIGINT) AS n, concat('C', CAST(c_custkey AS STRING)) AS page_title,
 CAST(floor(c_custkey / 20) AS BIGINT) AS batch, CAST(c_custkey % 20 AS INT) AS pos FROM customer)"""
_RECORDS = _ASK.replace("STRING", "VARCHAR") + """, lk AS (SELECT source_title AS p, string_agg(DISTINCT target_title, '|' ORDER BY target_title) AS links FROM page_links GROUP BY 1),
ca AS (SELECT page_title AS p, string_agg(DISTINCT category_name, '|' ORDER BY category_name) AS cats FROM page_categories GROUP BY 1),
rec AS (SELECT batch, page_title, CASE WHEN batch % 7 = 0 THEN '' ELSE coalesce(links, '') END AS links, CASE WHEN batch % 7 = 0 THEN '' ELSE coalesce(cats, '') END AS categories,
 CASE WHEN batch % 7 = 0 THEN 'down' END AS error FROM ask LEFT JOIN lk ON lk.p = page_title LEFT JOIN ca ON ca.p = page_title)"""


def _records(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "customer").select(F.col("c_custkey").cast("long").alias("n"), F.concat(F.lit("C"), F.col("c_custkey").cast("string")).alias("page_title"))
    ask = rows.select("n", "page_title", F.floor(F.col("n") / 20).alias("batch"), (F.col("n") % 20).cast("int").alias("pos"))
    link = lambda ns, t: F.struct(F.lit(ns).alias("ns"), t.alias("title"))
    links = graph_table(spark, d, "page_links").groupBy(F.col("source_title").alias("page_title")).agg(
        F.collect_list(link(0, F.col("target_title"))).alias("a"), F.collect_list(link(10, F.col("target_title"))).alias("b"))
    cats = graph_table(spark, d, "page_categories").groupBy("page_title").agg(
        F.collect_list(F.struct(F.concat(F.lit("Category:"), F.col("category_name")).alias("title"))).alias("categories"))
    kind, name = F.col("n") % 4, F.col("page_title")
    title = F.when(kind == 1, F.concat(F.lit("Norm "), name)).when(kind == 2, F.concat(F.lit("Led "), name)).when(kind == 3, F.concat(F.lit("_"), F.lower(name), F.lit(" "))).otherwise(name)
    rows = ask.join(links, "page_title", "left").join(cats, "page_title", "left").withColumn("title", title)
    page = F.struct("title", F.concat("a", "b", "a").alias("links"), "categories")
    pair = F.struct(name.alias("from"), F.col("title").alias("to"))
    body = rows.groupBy("batch").agg(
        F.map_from_entries(F.collect_list(F.struct(F.col("n").cast("string"), page))).alias("pages"),
        F.collect_list(F.when(kind == 1, pair)).alias("normalized"), F.collect_list(F.when(kind == 2, pair)).alias("redirects"))
    failed = F.col("batch") % 7 == 0
    text = F.to_json(F.struct(F.struct("pages", "normalized", "redirects").alias("query")))
    answers = body.select("batch", F.when(~failed, text).alias("body"), F.when(failed, F.lit("down")).alias("error"))
    return ingest.crawl_records(ask.select("batch", "pos", "page_title"), ingest.parse_responses(answers).select("batch", "response", "error"))


@query(_RECORDS + """ SELECT batch, page_title, len(string_split(links, '|')) * (links <> '')::INT AS links_out_count, links,
 len(string_split(categories, '|')) * (categories <> '')::INT AS categories_count, categories, error FROM rec""")
def crawl_records(spark: SparkSession, d: str) -> DataFrame:
    return _records(spark, d).select("batch", "page_title", F.col("links_out_count").cast("long").alias("links_out_count"), F.array_join("links_out", "|").alias("links"),
                                     F.col("categories_count").cast("long").alias("categories_count"), F.array_join("categories", "|").alias("categories"), "error")


@query(_RECORDS + " SELECT count(*) FILTER (error IS NULL) AS ok, count(*) FILTER (error IS NOT NULL) AS error FROM rec")
def crawl_counters(spark: SparkSession, d: str) -> DataFrame:
    return crawl.counters(_records(spark, d))


# What was stored before: a failure for every fifth title, a row in pages for every third, every eleventh searched.
_STORED = _RECORDS + """, of AS (SELECT page_title, 'old' AS error_message FROM ask WHERE n % 5 = 0), op AS (SELECT page_title, 1 AS links_out_count, 1 AS categories_count,
 'old' AS error_message FROM ask WHERE n % 3 = 0), os AS (SELECT page_title FROM ask WHERE n % 11 = 0)"""


def _stored(spark: SparkSession, d: str, name: str) -> DataFrame:
    n = table(spark, d, "customer").select("c_custkey", F.concat(F.lit("C"), F.col("c_custkey").cast("string")).alias("page_title"))
    some = lambda k: n.where(F.col("c_custkey") % k == 0).select("page_title")
    old, one = F.lit("old").alias("error_message"), F.lit(1)
    tables = {
        "failed_pages": some(5).select("page_title", old), "searched_pages": some(11),
        "pages": some(3).select("page_title", one.alias("links_out_count"), one.alias("categories_count"), old),
        "page_links": graph_table(spark, d, "page_links").limit(0), "page_categories": graph_table(spark, d, "page_categories").limit(0),
    }
    return ingest.store_records(tables, materialise(_records(spark, d), "records"), "batch")[name]


@query(_STORED + """ SELECT page_title, CAST(len(string_split(links, '|')) * (links <> '')::INT AS INT) AS links_out_count,
 CAST(len(string_split(categories, '|')) * (categories <> '')::INT AS INT) AS categories_count, error AS error_message FROM rec""")
def stored_pages(spark: SparkSession, d: str) -> DataFrame:
    return _stored(spark, d, "pages")


@query(_STORED + """ SELECT page_title, error AS error_message FROM rec WHERE error IS NOT NULL""")
def stored_failures(spark: SparkSession, d: str) -> DataFrame:
    return _stored(spark, d, "failed_pages")


@query(_STORED + """ SELECT page_title FROM os UNION SELECT page_title FROM rec WHERE error IS NULL""")
def stored_searched(spark: SparkSession, d: str) -> DataFrame:
    return _stored(spark, d, "searched_pages")


@query(_STORED + """ SELECT DISTINCT page_title AS source_title, unnest(string_split(links, '|')) AS target_title FROM rec WHERE links <> ''""")
def stored_links(spark: SparkSession, d: str) -> DataFrame:
    return _stored(spark, d, "page_links")


@query(FILTERED.replace("WITH ", with_tables("cluster_assignments") + ", ", 1) + """, ca AS (SELECT page_title FROM cluster_assignments WHERE cluster_id % 4 > 0),
n AS (SELECT source_title AS p FROM e UNION SELECT target_title FROM e)
SELECT (SELECT count(*) FROM n WHERE p NOT IN (SELECT page_title FROM ca)) AS dropped_nodes,
 (SELECT count(*) FROM e WHERE source_title NOT IN (SELECT page_title FROM ca) OR target_title NOT IN (SELECT page_title FROM ca)) AS dropped_edges""")
def dropped_by_layout(spark: SparkSession, d: str) -> DataFrame:
    return layout.dropped(_filtered(spark, d), graph_table(spark, d, "cluster_assignments").where("cluster_id % 4 > 0"))


@query(_LB + """ SELECT page_title, round((x - x0) / greatest(x1 - x0, 1e-9) * 2000 - 1000, 6) AS x, round((y - y0) / greatest(y1 - y0, 1e-9) * 2000 - 1000, 6) AS y FROM nodes_layout, b""")
def normalised_layout(spark: SparkSession, d: str) -> DataFrame:
    found = layout.normalise_columns(_layout(spark, d).select("page_title", "x", "y"))
    return found.select("page_title", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


@query(_LB + """, nw AS (SELECT page_title, 0.0::DOUBLE AS x, 1.0::DOUBLE AS y FROM nodes_layout WHERE in_degree % 3 = 0 UNION ALL SELECT 'new', 2.0, 3.0)
SELECT page_title, x, y FROM nw UNION ALL SELECT page_title, x, y FROM nodes_layout WHERE page_title NOT IN (SELECT page_title FROM nw)""")
def upserted_layout(spark: SparkSession, d: str) -> DataFrame:
    old = _layout(spark, d)
    new = old.where("in_degree % 3 = 0").select("page_title", F.lit(0.0).alias("x"), F.lit(1.0).alias("y"))
    new = new.unionByName(spark.range(1).select(F.lit("new").alias("page_title"), F.lit(2.0).alias("x"), F.lit(3.0).alias("y")))
    return ingest.upsert(old.select("page_title", "x", "y"), new, ["page_title"])
