"""Exact de-duplication with a heavy-hitter split, in DataFrame functions only.

A Misra-Gries style frequent-items summary (``approx_top_k``, mergeable, a fixed number of counters) names digests
that may be frequent. Their true sizes and winners are then counted exactly, and those few winners are broadcast, so
that rows of a hot digest are resolved where they were read. All other digests take an ordinary shuffle, in which no
digest can hold more rows than the summary's error bound allows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.runtime import private, quoted
from graphloom.storage import materialise

#: Counters in the frequent-items summary: a digest with more than about 4/COUNTERS of the rows can't escape it.
COUNTERS = 1024
#: At most so many winners are broadcast, at about 120 bytes each.
MOST_HEAVY = 256
#: Tables of at most so many ids are broadcast (8 bytes each).
MOST_IDS = 200_000


def normalised(text: Column) -> Column:
    """The text without the characters ``[\\x20\\x09-\\x0D]``; null counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", "")


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(row, doc_id, n_chars, digest, key): a row each; ``row`` tells repeated rows apart."""
    text = F.col(text_col).cast("string")
    return docs.select(
        F.monotonically_increasing_id().alias("row"),
        F.col(id_col).alias("doc_id"),
        F.length(F.coalesce(text, F.lit(""))).cast("long").alias("n_chars"),
        F.sha2(normalised(text), 256).alias("digest"),
    ).withColumn("key", F.xxhash64("digest"))


def _winner() -> list[Column]:
    # The longest original text stays, then the smallest id (null last), then the first row read.
    least = F.struct(-F.col("n_chars"), F.col("doc_id").isNull(), F.col("doc_id"), F.col("row"))
    return [F.count(F.lit(1)), F.min(least)]


def heavy_groups(rows: DataFrame) -> DataFrame:
    """The verified frequent digests: (digest, group_size, best), at most MOST_HEAVY rows."""
    top = rows.agg(F.expr(f"approx_top_k(key, {MOST_HEAVY}, {COUNTERS})").alias("top"))
    likely = top.select(F.inline("top")).where("count > 1").select(F.col("item").alias("key"))  # MOST_HEAVY rows at most
    size, best = _winner()
    exact = rows.join(F.broadcast(likely), "key", "left_semi")
    exact = exact.groupBy("digest").agg(size.alias("group_size"), best.alias("best"))
    return exact.where("group_size > 1")


def resolve(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For each input row: row, doc_id, n_chars, digest, keep_id, group_size, kept.

    Exactly one row of each group of equal texts is kept, even among repeated rows. A null text equals an empty one;
    an empty table gives an empty result; other columns are not looked at.
    """
    rows = materialise(digests(docs, id_col, text_col), "digests")
    heavy = materialise(heavy_groups(rows), "heavy")
    hot = rows.join(F.broadcast(heavy), "digest")  # MOST_HEAVY rows at most
    cold = rows.join(F.broadcast(heavy), "digest", "left_anti")
    size, best = _winner()  # summed before the shuffle; only the join back, which Spark can split, sees all rows
    groups = cold.groupBy("digest").agg(size.alias("group_size"), best.alias("best"))
    cold = cold.join(groups, "digest").select(*rows.columns, "group_size", "best")
    both = hot.select(*cold.columns).unionByName(cold)
    return both.select(
        "row", "doc_id", "n_chars", "digest",
        F.col("best.doc_id").alias("keep_id"),
        "group_size",
        (F.col("row") == F.col("best.row")).alias("kept"),
    )


def sized_join(big: DataFrame, ids: DataFrame, on: Column, how: str) -> DataFrame:
    """A semi or anti join with a table of ids that is broadcast only after a count has bounded it."""
    return big.join(F.broadcast(ids) if ids.count() <= MOST_IDS else ids, on, how)


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns.

    Dropped ids are removed by an anti join, broadcast only if they were counted and found few. Ids that occur on
    several rows, or are null, are settled by the whole row instead. Other columns may have any names; an empty table
    stays empty.
    """
    found = materialise(resolve(docs, id_col, text_col).select("doc_id", "digest", "kept"), "resolved")
    unclear = materialise(
        found.groupBy("doc_id").count().where("count > 1 or doc_id is null").select("doc_id"), "repeated_ids"
    )
    gone = materialise(found.where("not kept").select("doc_id"), "gone")
    the_id, the_digest, stays, whole = private(docs.columns, "_id", "_digest", "_stay", "_row")
    unclear, gone = unclear.withColumnRenamed("doc_id", the_id), gone.withColumnRenamed("doc_id", the_id)
    same = F.col(id_col).eqNullSafe(F.col(the_id))
    plain = sized_join(docs, gone, same, "left_anti")
    if unclear.isEmpty():
        return plain
    plain = plain.join(unclear, same, "left_anti")
    text = F.col(text_col).cast("string")
    odd = docs.join(unclear, same, "left_semi").withColumn(the_digest, F.sha2(normalised(text), 256))
    stay = found.where("kept").join(unclear, F.col("doc_id").eqNullSafe(F.col(the_id)), "left_semi")
    stay = stay.select(F.col("doc_id").alias(the_id), F.col("digest").alias(stays))
    odd = odd.join(stay, same & (F.col(the_digest) == F.col(stays)), "left_semi")
    longest = odd.groupBy(the_digest).agg(
        F.max_by(F.struct(*quoted(docs.columns)), F.length(F.coalesce(text, F.lit("")))).alias(whole)
    )
    return plain.unionByName(longest.select(f"{whole}.*"))
