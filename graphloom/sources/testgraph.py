"""Graph tables that the star-schema test tables describe. The same SQL text serves Spark and the oracle, but for
page_links."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.storage import materialise, table

#: Directed links between the customers of consecutive urgent, finished orders.
PAGE_LINKS = """
SELECT DISTINCT concat('C', CAST(a AS STRING)) AS source_title, concat('C', CAST(b AS STRING)) AS target_title
FROM (SELECT o_custkey AS a, lead(o_custkey) OVER (ORDER BY o_orderkey) AS b, o_orderstatus, o_orderpriority FROM orders) o
WHERE b IS NOT NULL AND o_orderstatus = 'F' AND o_orderpriority IN ('1-URGENT', '2-HIGH')
"""
DISCOVERED = "SELECT concat('C', CAST(c_custkey AS STRING)) AS page_title FROM customer WHERE c_acctbal >= 0"
SEARCHED = "SELECT concat('C', CAST(c_custkey AS STRING)) AS page_title FROM customer WHERE c_custkey % 10 <> 0"
CATEGORIES = """
SELECT DISTINCT page_title, category_name FROM (
  SELECT concat('C', CAST(c_custkey AS STRING)) AS page_title, c_mktsegment AS category_name FROM customer
  UNION ALL
  SELECT concat('C', CAST(c_custkey AS STRING)), n_name FROM customer JOIN nation ON c_nationkey = n_nationkey
  UNION ALL
  SELECT concat('C', CAST(o_custkey AS STRING)), concat('Year of ', CAST(year(o_orderdate) AS STRING)) FROM orders
  UNION ALL
  SELECT concat('C', CAST(c_custkey AS STRING)), concat(' ', upper(n_name), ' ') FROM customer JOIN nation ON c_nationkey = n_nationkey
    WHERE c_custkey % 7 = 0
) c
"""
#: Cluster of a page: its customer's nation.
CLUSTERS = "SELECT concat('C', CAST(c_custkey AS STRING)) AS page_title, CAST(c_nationkey AS INT) AS cluster_id FROM customer"
#: A made-up, repeatable layout with coordinates between -1000 and 1000.
LAYOUT = """
SELECT concat('C', CAST(c_custkey AS STRING)) AS page_title,
  CAST((c_custkey * 92821) % 2000 - 1000 AS DOUBLE) AS x, CAST((c_custkey * 68917) % 2000 - 1000 AS DOUBLE) AS y,
  CAST(c_nationkey AS INT) AS cluster_id,
  CAST(c_custkey % 40 AS INT) AS in_degree, CAST(c_custkey % 17 AS INT) AS out_degree,
  least(18.0e0, greatest(1.5e0, 1.5e0 + 1.4e0 * ln(1.0e0 + c_custkey % 40))) AS node_size
FROM customer WHERE c_custkey % 3 <> 1
"""
#: Titles with many spellings: each page's title links to the names that its anchors carry.
DIRTY_SPARK = r"""
SELECT DISTINCT regexp_extract(html, '<title>([^<]*)', 1) AS source_title, link AS target_title
FROM pages LATERAL VIEW explode(regexp_extract_all(html, '<a href="/([^"]*)"', 1)) t AS link
"""
DIRTY_ORACLE = r"""
SELECT DISTINCT regexp_extract(html, '<title>([^<]*)', 1) AS source_title, link AS target_title
FROM (SELECT html, unnest(regexp_extract_all(html, '<a href="/([^"]*)"', 1)) AS link FROM pages) t
"""
NAMES = {"page_links": PAGE_LINKS, "discovered_pages": DISCOVERED, "searched_pages": SEARCHED,
         "page_categories": CATEGORIES, "cluster_assignments": CLUSTERS, "nodes_layout": LAYOUT}
_TABLES = ("orders", "customer", "nation", "pages")


def graph_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    for t in _TABLES:
        table(spark, sf_dir, t).createOrReplaceTempView(t)
    if name == "page_links":
        return page_links(table(spark, sf_dir, "orders"))
    return spark.sql(DIRTY_SPARK if name == "dirty_links" else NAMES[name])


def page_links(orders: DataFrame) -> DataFrame:
    """What PAGE_LINKS says, with orders followed up in ranges of keys instead of all in one task."""
    rows = orders.select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority").repartitionByRange("o_orderkey")
    rows = materialise(rows.withColumn("part", F.spark_partition_id()), "orders_in_order")
    firsts = rows.groupBy("part").agg(F.min_by("o_custkey", "o_orderkey").alias("first"))
    behind = firsts.select("part", F.lead("first").over(Window.orderBy("part")).alias("next"))  # a row per range
    within = F.lead("o_custkey").over(Window.partitionBy("part").orderBy("o_orderkey"))
    pairs = rows.withColumn("within", within).join(behind, "part").withColumn("b", F.coalesce("within", "next"))
    pairs = pairs.where("b is not null and o_orderstatus = 'F' and o_orderpriority in ('1-URGENT', '2-HIGH')")
    title = lambda c: F.concat(F.lit("C"), F.col(c).cast("string"))
    return pairs.select(title("o_custkey").alias("source_title"), title("b").alias("target_title")).distinct()


def with_tables(*names: str) -> str:
    """The oracle's WITH clause for the named graph tables."""
    text = NAMES | {"dirty_links": DIRTY_ORACLE}
    return "WITH " + ", ".join(f"{n} AS ({text[n].replace('AS STRING', 'AS VARCHAR')})" for n in names)
