"""Incremental crawl: responses that arrive as JSON files become rows of the crawl tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from graphloom.operators.ingest import RESPONSE, clean_failed, crawl_records, insert_or_ignore, store_records
from graphloom.sources.catalog import Catalog

#: A line of a crawl file: the titles that a batch asked for, and one page of its response or its error.
LINE = f"batch BIGINT, titles ARRAY<STRING>, response STRUCT<{RESPONSE}>, error STRING"
TABLES = ("pages", "searched_pages", "failed_pages", "page_links", "page_categories")
#: Micro-batches between two clearings of superseded files.
VACUUM_EVERY = 20


def read_stream(spark: SparkSession, folder: str, files_per_batch: int = 50) -> DataFrame:
    return spark.readStream.schema(LINE).option("maxFilesPerTrigger", files_per_batch).json(folder)


def records_of(lines: DataFrame) -> DataFrame:
    """Crawl records of the lines' batches; a batch's lines must be in one micro-batch (one file)."""
    asked = lines.select("batch", F.posexplode("titles").alias("pos", "page_title")).dropDuplicates(["batch", "page_title"])
    return crawl_records(asked, lines.select("batch", "response", "error"))


def apply_batch(catalog: Catalog, lines: DataFrame, batch_id: int | None = None) -> None:
    """Merge one micro-batch into the tables, rewriting the buckets of its titles only. A batch id that was merged before
    is skipped, so replays do no harm. Of several records of a title the one of the greatest batch number is the last."""
    if batch_id is not None and catalog.last_batch() >= batch_id:
        return
    records = catalog.staged(records_of(lines), "records")
    touched = [r[0] for r in records.select(catalog.bucket(F.col("page_title"))).distinct().collect()]  # as many as there are buckets
    tables = store_records({t: catalog.read(t, touched) for t in TABLES}, records, "batch")
    catalog.replace(tables, batch_id, touched)
    if batch_id is not None and batch_id % VACUUM_EVERY == VACUUM_EVERY - 1:
        catalog.vacuum()


def add_discovered(catalog: Catalog, titles: DataFrame) -> int:
    """Titles (page_title) that are new are marked as discovered; returns how many titles there are now."""
    fresh = catalog.staged(titles.select("page_title").distinct(), "discovered")
    touched = [r[0] for r in fresh.select(catalog.bucket(F.col("page_title"))).distinct().collect()]
    old = catalog.read("discovered_pages", touched)
    new = fresh.withColumn("discovered_at", F.lit(None).cast("timestamp"))
    catalog.replace({"discovered_pages": insert_or_ignore(old, new, ["page_title"])}, buckets=touched)
    return catalog.read("discovered_pages").count()


def counters(records: DataFrame) -> DataFrame:
    """One row: ok, error - records without and with an error."""
    return records.agg(F.count_if(F.col("error").isNull()).alias("ok"), F.count_if(F.col("error").isNotNull()).alias("error"))


def start(spark: SparkSession, folder: str, catalog: Catalog, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Follow a folder of crawl files; what was read is remembered in ``checkpoint``."""
    catalog.replace({"failed_pages": clean_failed(catalog.read("failed_pages"), catalog.read("searched_pages"))})
    writer = read_stream(spark, folder).writeStream.option("checkpointLocation", checkpoint)
    writer = writer.foreachBatch(lambda df, i: apply_batch(catalog, df, i))
    return (writer.trigger(availableNow=True) if once else writer).start()
