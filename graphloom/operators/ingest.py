"""Crawl responses to records, and records into the crawl tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions.titles import category_name, match_key

RESPONSE = (
    "query STRUCT<pages MAP<STRING, STRUCT<title STRING, links ARRAY<STRUCT<ns INT, title STRING>>, "
    "categories ARRAY<STRUCT<title STRING>>>>, normalized ARRAY<STRUCT<`from` STRING, `to` STRING>>, "
    "redirects ARRAY<STRUCT<`from` STRING, `to` STRING>>>, `continue` MAP<STRING, STRING>"
)
DISCOVERY = "query STRUCT<allpages ARRAY<STRUCT<title STRING>>>, `continue` MAP<STRING, STRING>"


def parse_responses(raw: DataFrame, body: str = "body") -> DataFrame:
    """JSON bodies as structs; a body that isn't JSON gives null."""
    return raw.withColumn("response", F.from_json(body, RESPONSE))


def discovered(raw: DataFrame, body: str = "body") -> DataFrame:
    """(page_title): the titles that discovery responses list."""
    got = raw.select(F.explode(F.from_json(body, DISCOVERY)["query"]["allpages"]).alias("p"))
    return got.select(F.col("p.title").alias("page_title")).where("page_title is not null").distinct()


def crawl_records(requests: DataFrame, responses: DataFrame) -> DataFrame:
    """One record per requested title.

    requests: (batch, pos, page_title). responses: (batch, response, error), a row per page of a batch's response; a
    non-null error makes error records of the whole batch. A returned page belongs to the requested title that it
    equals, else to the one that was normalised to it, else to the one that redirects to it, else to the one with the
    same key. Links outside namespace 0 are skipped. Lists are distinct and sorted; a title without a response has
    empty ones.
    """
    asked = requests.select("batch", F.col("page_title").alias("asked"), "pos")
    by_key = asked.groupBy("batch", match_key(F.col("asked")).alias("key")).agg(F.max_by("asked", "pos").alias("by_key"))
    exact = asked.select("batch", "asked").distinct()

    def renames(kind: str, out: str) -> DataFrame:
        rows = responses.select("batch", F.posexplode(F.col("response.query")[kind]).alias("pos", "m"))
        rows = rows.select("batch", "pos", F.col("m.from").alias(out), F.col("m.to").alias("title"))
        rows = rows.where(f"{out} <> '' and title <> ''").groupBy("batch", "title").agg(F.max_by(out, "pos").alias(out))
        return rows.join(exact.withColumnRenamed("asked", out), ["batch", out], "left_semi")

    pages = responses.select("batch", F.explode(F.col("response.query.pages")).alias("id", "page"))
    pages = pages.select("batch", F.col("page.title").alias("title"), "page").where("title is not null")
    pages = pages.withColumn("key", match_key(F.col("title")))
    pages = pages.join(exact.withColumn("title", F.col("asked")), ["batch", "title"], "left")
    pages = pages.join(renames("normalized", "was"), ["batch", "title"], "left")
    pages = pages.join(renames("redirects", "led"), ["batch", "title"], "left").join(by_key, ["batch", "key"], "left")
    pages = pages.withColumn("page_title", F.coalesce("asked", "was", "led", "by_key")).where("page_title is not null")
    found = pages.select(
        "batch", "page_title",
        F.transform(F.filter(F.coalesce("page.links", F.array()), lambda x: (x["ns"] == 0) & x["title"].isNotNull()), lambda x: x["title"]).alias("links"),
        F.transform(F.filter(F.coalesce("page.categories", F.array()), lambda x: x["title"].isNotNull()), lambda x: category_name(x["title"])).alias("cats"),
    ).groupBy("batch", "page_title").agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("links")))).alias("links_out"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("cats")))).alias("categories"),
    )
    failed = responses.where("error is not null").groupBy("batch").agg(F.min("error").alias("error"))
    rows = requests.select("batch", "page_title").distinct().join(found, ["batch", "page_title"], "left").join(failed, "batch", "left")
    empty = F.array().cast("array<string>")
    lists = {c: F.when(F.col("error").isNull(), F.coalesce(c, empty)).otherwise(empty) for c in ("links_out", "categories")}
    rows = rows.withColumns(lists)
    return rows.select("batch", "page_title", F.size("links_out").alias("links_out_count"), "links_out",
                       F.size("categories").alias("categories_count"), "categories", "error")


def insert_or_ignore(table: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """``table`` and the rows of ``new`` whose key it lacks; existing rows win."""
    fresh = new.dropDuplicates(keys).join(table, keys, "left_anti")
    return table.unionByName(fresh.select(*table.columns))


def upsert(table: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """``new`` replaces the rows of ``table`` with its keys; other rows stay."""
    return table.join(new, keys, "left_anti").unionByName(new.select(*table.columns))


def pending(seen: DataFrame, searched: DataFrame, most: int | None = None) -> DataFrame:
    """Discovered titles that weren't searched, in order; the first ``most`` if given."""
    out = seen.select("page_title").distinct().join(searched, "page_title", "left_anti").orderBy("page_title")
    return out if most is None else out.limit(most)


def batches(titles: DataFrame, size: int = 20) -> DataFrame:
    """(batch, pos, page_title) in the order of titles."""
    from graphloom.operators.graph import ids_of

    rows = ids_of(titles)
    return rows.select(F.floor(F.col("id") / size).alias("batch"), (F.col("id") % size).alias("pos"), "page_title")


def clean_failed(failed: DataFrame, searched: DataFrame) -> DataFrame:
    """Failures of titles that were searched since go."""
    return failed.join(searched, "page_title", "left_anti")


def store_records(tables: dict[str, DataFrame], records: DataFrame, order: str | None = None) -> dict[str, DataFrame]:
    """The crawl tables after the records; of several records of a title the last by ``order`` sets pages' row, then one
    with an error, then the one with the most links.

    Counts are the lists' lengths. A success marks the title as searched and removes its failure; a later error in the
    same batch brings the failure back and sets the counts to 0. Links and categories only ever grow, and only by
    records without error.
    """
    ties = [F.col("error").isNull(), F.desc(F.size("links_out")), F.desc(F.size("categories")), F.xxhash64("links_out", "categories")]
    last = Window.partitionBy("page_title").orderBy(*([F.desc(order)] if order else []), *ties)
    rows = records.withColumn("_last", F.row_number().over(last) == 1)
    good, now = rows.where("error is null"), rows.where("_last")
    lists = {c: F.when(F.col("error").isNull(), F.size(c)).otherwise(0) for c in ("links_out", "categories")}
    pages = now.select("page_title", lists["links_out"].alias("links_out_count"), lists["categories"].alias("categories_count"),
                       F.col("error").alias("error_message"))
    at = lambda t, c: [F.lit(None).cast("timestamp").alias(c)] if c in tables[t].columns else []  # noqa: E731 - set as it is stored
    failures = now.where("error is not null").select("page_title", *at("failed_pages", "failed_at"), F.col("error").alias("error_message"))
    links = good.select(F.col("page_title").alias("source_title"), F.explode("links_out").alias("target_title"))
    cats = good.select("page_title", F.explode("categories").alias("category_name"))
    failed = tables["failed_pages"].join(good, "page_title", "left_anti")
    return tables | {
        "pages": upsert(tables["pages"], pages, ["page_title"]),
        "searched_pages": insert_or_ignore(tables["searched_pages"], good.select("page_title", *at("searched_pages", "searched_at")), ["page_title"]),
        "failed_pages": upsert(failed, failures, ["page_title"]),
        "page_links": insert_or_ignore(tables["page_links"], links, ["source_title", "target_title"]),
        "page_categories": insert_or_ignore(tables["page_categories"], cats, ["page_title", "category_name"]),
    }
