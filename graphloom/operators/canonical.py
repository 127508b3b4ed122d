"""Entity resolution of page titles: alias map, rewrite of every table, backfill."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions.titles import family_key, fold, plain_apostrophes, preference, without_suffix

#: The columns of each table that hold titles.
TITLE_COLUMNS = {
    "discovered_pages": ["page_title"],
    "searched_pages": ["page_title"],
    "failed_pages": ["page_title"],
    "pages": ["page_title"],
    "page_links": ["source_title", "target_title"],
    "page_categories": ["page_title"],
    "cluster_assignments": ["page_title"],
    "nodes_layout": ["page_title"],
}


def all_titles(tables: dict[str, DataFrame]) -> DataFrame:
    """Every distinct title of the tables; null and empty ones don't count."""
    parts = [tables[t].select(F.col(c).alias("title")) for t, cs in TITLE_COLUMNS.items() if t in tables for c in cs]
    return reduce(DataFrame.union, parts).where("title is not null and title <> ''").distinct()


def alias_map(titles: DataFrame) -> DataFrame:
    """(old_title, canonical_title) of the titles (column ``title``) that go by another name.

    In a family of titles the preferred one is canonical. Another spelling of it (by apostrophes, white space, case) is
    its alias; a title with the "(disambiguation)" suffix is the alias of the exact title without it, if the family has
    that; anything else stays. Chains aren't followed.
    """
    t = F.col("title")
    rows = titles.select(
        "title",
        family_key(t).alias("family"),
        F.struct(*[preference(t)[c].alias(c) for c in ("suffixed", "cased", "length", "folded")], t.alias("title")).alias("rank"),
        fold(plain_apostrophes(t)).alias("spelling"),
        without_suffix(t).alias("bare"),
    )
    best = rows.groupBy("family").agg(
        F.min("rank").getField("title").alias("canonical"),
        F.min(F.struct("rank", "spelling")).getField("spelling").alias("best_spelling"),
        F.count(F.lit(1)).alias("n"),
    ).where("n > 1")
    known = titles.select(F.col("title").alias("bare"), F.lit(True).alias("exists"))
    rows = rows.join(best, "family").where("title <> canonical").join(known, "bare", "left")
    name = F.when(F.col("spelling") == F.col("best_spelling"), F.col("canonical")).when(
        F.col("exists") & (F.col("bare") != F.col("title")), F.col("bare")
    )
    return rows.select(F.col("title").alias("old_title"), name.alias("canonical_title")).where("canonical_title is not null")


def renamed(df: DataFrame, aliases: DataFrame, column: str) -> DataFrame:
    """``df`` with the titles of a column replaced by their canonical ones. Spark broadcasts the aliases if few."""
    to = aliases.select(F.col("old_title").alias("_old"), F.col("canonical_title").alias("_new"))
    out = df.join(to, F.col(column) == F.col("_old"), "left")
    return out.withColumn(column, F.coalesce("_new", column)).select(*df.columns)


def canonical_titles(df: DataFrame, aliases: DataFrame) -> DataFrame:
    """discovered_pages, searched_pages: distinct titles. Their times start anew, so they are left out."""
    return renamed(df, aliases, "page_title").select("page_title").distinct()


def canonical_failed(df: DataFrame, aliases: DataFrame) -> DataFrame:
    return renamed(df, aliases, "page_title").groupBy("page_title").agg(F.min("error_message").alias("error_message"))


def canonical_pages(df: DataFrame, aliases: DataFrame) -> DataFrame:
    """Of the rows that become one, the largest counts (null is 0) and the least error message."""
    return renamed(df, aliases, "page_title").groupBy("page_title").agg(
        F.max(F.coalesce("links_out_count", F.lit(0))).alias("links_out_count"),
        F.max(F.coalesce("categories_count", F.lit(0))).alias("categories_count"),
        F.min("error_message").alias("error_message"),
    )


def canonical_links(df: DataFrame, aliases: DataFrame) -> DataFrame:
    """Distinct links between canonical titles; links that become loops stay."""
    return renamed(renamed(df, aliases, "source_title"), aliases, "target_title").distinct()


def canonical_categories(df: DataFrame, aliases: DataFrame) -> DataFrame:
    return renamed(df, aliases, "page_title").distinct()


def canonical_clusters(df: DataFrame, aliases: DataFrame) -> DataFrame:
    return renamed(df, aliases, "page_title").groupBy("page_title").agg(F.min("cluster_id").alias("cluster_id"))


def canonical_layout(df: DataFrame, aliases: DataFrame) -> DataFrame:
    """Of the rows that become one, the largest node: by size, then degrees, then the least old title."""
    old = df.withColumn("_was", F.col("page_title"))
    best = Window.partitionBy("page_title").orderBy(F.desc("node_size"), F.desc("out_degree"), F.desc("in_degree"), "_was")
    out = renamed(old, aliases, "page_title").withColumn("_k", F.row_number().over(best)).where("_k = 1")
    return out.select(*df.columns)


def backfill(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Every link's end gets a row in pages (0, 0, null), every page one in discovered_pages."""
    links, pages, seen = tables["page_links"], tables["pages"], tables["discovered_pages"]
    ends = links.select(F.col("source_title").alias("page_title")).union(links.select("target_title")).distinct()
    new = ends.join(pages, "page_title", "left_anti").select(
        "page_title", F.lit(0).alias("links_out_count"), F.lit(0).alias("categories_count"),
        F.lit(None).cast("string").alias("error_message"),
    )
    pages = pages.select("page_title", "links_out_count", "categories_count", "error_message").unionByName(new)
    fresh = pages.select("page_title").distinct().join(seen, "page_title", "left_anti")
    return tables | {"pages": pages, "discovered_pages": seen.unionByName(fresh, allowMissingColumns=True)}


_REWRITE = {
    "discovered_pages": canonical_titles, "searched_pages": canonical_titles, "failed_pages": canonical_failed,
    "pages": canonical_pages, "page_links": canonical_links, "page_categories": canonical_categories,
    "cluster_assignments": canonical_clusters, "nodes_layout": canonical_layout,
}


def canonicalise(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """All tables under canonical titles, then the backfill, which happens even if there is no alias."""
    aliases = alias_map(all_titles(tables))
    out = {t: _REWRITE[t](df, aliases) if t in _REWRITE else df for t, df in tables.items()}
    return backfill(out) if {"page_links", "pages", "discovered_pages"} <= out.keys() else out
