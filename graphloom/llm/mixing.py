"""Mixing sources to target weights by a time-varying curriculum, in DataFrame functions only.

Training time runs from 0 to 1. A source's weight is a straight line ``w(t) = a + b t`` (``a`` at the start, ``a + b``
at the end). Its integral, scaled so that time 1 reaches the source's target, is the demand for its words up to ``t``.
A document whose words begin at position ``c`` of its source's queue is due when demand reaches ``c``: the inverse of
the integral, a quadratic with a closed form. Sorting by that time in ranges gives the training order. Sources that
are repeated queue their documents again for the next pass.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.runtime import private, quoted
from graphloom.storage import materialise

#: Largest number of times that a source's words are used.
MOST_REPEATS = 2.0


def n_words(text: Column) -> Column:
    """Number of ``[^\\x20\\x09-\\x0D]+`` in the text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def shuffled(doc_id: Column) -> Column:
    """A fixed pseudo-random order of ids, the same in every run and in any SQL engine with 64-bit integers."""
    return F.pmod(F.pmod(F.coalesce(doc_id, F.lit(-1)), F.lit(2147483648)) * F.lit(2654435761), F.lit(4294967296))


def targets(totals: DataFrame, budget: float = 1.5, weights: tuple[float, ...] = (5.0, 2.0, 1.0)) -> DataFrame:
    """(source, source_size) -> also rank, weight and target.

    Sources are ranked by code point, null last; ``weights`` repeat over the ranks. The targets share ``budget`` times
    all words by weight; none passes MOST_REPEATS times its source's size, and what that cuts off is shared again.

    Water filling in closed form: sources fill up in the order of capacity / weight. With prefix sums in that order
    the level that the budget reaches is found without iterating. One row per source, so one window over them all.
    """
    every = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    by_name = Window.orderBy(F.col("source").isNull(), "source")
    rank = F.row_number().over(by_name) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    level = Window.orderBy("fills_at", "rank")
    before = level.rowsBetween(Window.unboundedPreceding, -1)
    ranked = totals.withColumn("rank", rank).withColumn("weight", weight)
    ranked = ranked.withColumn("capacity", F.lit(MOST_REPEATS) * F.col("source_size"))
    ranked = ranked.withColumn("fills_at", F.col("capacity") / F.col("weight"))
    full = F.coalesce(F.sum("capacity").over(before), F.lit(0.0))
    open_weight = F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    total = F.lit(float(budget)) * F.sum("source_size").over(every)
    # The level if this source and all after it stay open; the first at which it doesn't fill up is the true one.
    ranked = ranked.withColumn("level_here", (total - full) / open_weight)
    reached = F.min(F.when(F.col("level_here") <= F.col("fills_at"), F.struct("fills_at", "rank", "level_here"))).over(every)
    ranked = ranked.withColumn("level", reached["level_here"])
    target = F.when(F.col("level").isNull(), F.col("capacity")).otherwise(
        F.least(F.col("capacity"), F.col("weight") * F.col("level"))
    )
    return ranked.select("source", "source_size", "rank", "weight", target.alias("target"))


def queue(docs: DataFrame) -> DataFrame:
    """(doc_id, tie, source, size) -> also ``before``: the source's words ahead of the row in its queue.

    The queue's order is pseudo-random by id. Prefix sums come in two levels: whole slices of a source first, rows
    within a slice second. With as many slices as the root of the number of rows, neither level holds more than about
    that many rows of a source in one task, hot or not.
    """
    slices = max(1, math.isqrt(docs.count()))
    at = docs.withColumn("at", shuffled(F.col("doc_id")))
    at = at.withColumn("slice", F.floor(F.col("at") * F.lit(slices) / F.lit(4294967296)))
    sums = at.groupBy("source", "slice").agg(F.sum("size").alias("words"))
    ahead = Window.partitionBy("source").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(
        F.col("source").alias("_source"), F.col("slice").alias("_slice"),
        F.coalesce(F.sum("words").over(ahead), F.lit(0)).alias("slice_before"),
    )
    within = (
        Window.partitionBy("source", "slice").orderBy("at", "doc_id", "tie").rowsBetween(Window.unboundedPreceding, -1)
    )
    inner = at.withColumn("in_slice", F.coalesce(F.sum("size").over(within), F.lit(0)))
    met = F.col("source").eqNullSafe(F.col("_source")) & (F.col("slice") == F.col("_slice"))
    joined = inner.join(sums, met)
    return joined.select(*docs.columns, (F.col("in_slice") + F.col("slice_before")).alias("before"))


def allot(
    docs: DataFrame,
    budget: float = 1.5,
    weights: tuple[float, ...] = (5.0, 2.0, 1.0),
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """For each row: doc_id, tie, source, size, before, source_size, rank, target, taken (words used, repeats counted).

    Whole passes come first; the last pass stops at the target, so a source's words reach the whole part of its target
    and no row is used more than MOST_REPEATS times. Null texts and texts without words have size 0 and give nothing;
    null is a source of its own. Ties in the order of ids are broken by id, then by ``tie``, a hash
    of text and source; rows that are equal in all of these are interchangeable.
    """
    rows = materialise(
        docs.select(
            "doc_id", F.xxhash64(text_col, source_col).alias("tie"),
            F.col(source_col).alias("source"), n_words(F.col(text_col)).alias("size"),
        ),
        "sizes",
    )
    totals = materialise(rows.groupBy("source").agg(F.sum("size").alias("source_size")), "totals")
    goal = targets(totals, budget, weights).withColumnRenamed("source", "_source")
    met = F.col("source").eqNullSafe(F.col("_source"))
    # One row per source: the planner sees the size of the table that it may broadcast.
    out = queue(rows).join(materialise(goal, "targets"), met).drop("_source")
    whole = F.floor(F.col("target"))
    passes = F.when(F.col("source_size") > 0, F.floor(whole / F.col("source_size"))).otherwise(0)
    rest = whole - passes * F.col("source_size")
    part = F.greatest(F.lit(0), F.least(F.col("size"), rest - F.col("before")))
    return out.withColumn("taken", (passes * F.col("size") + part).cast("long"))


def position(word: Column, target: Column, start: Column, end: Column) -> Column:
    """When demand reaches ``word`` of ``target`` words under a weight that goes from ``start`` to ``end`` over time.

    Demand up to t is ``target * (start t + (end - start) t^2 / 2) / ((start + end) / 2)``; this is its inverse.
    """
    share = F.when(target > 0, F.least(F.lit(1.0), word / target)).otherwise(F.lit(0.0))
    slope, area = end - start, share * (start + end) / 2
    root = F.sqrt(F.greatest(F.lit(0.0), start * start + 2 * slope * area))
    found = F.coalesce(F.try_divide(2 * area, start + root), F.lit(0.0))
    return F.when(F.abs(slope) < 1e-12, share).otherwise(F.least(F.lit(1.0), found))


def curriculum(rank: Column) -> tuple[Column, Column]:
    """Default schedules: even ranks fade from 1.5 to 0.5 over training, odd ranks grow from 0.5 to 1.5."""
    even = rank % 2 == 0
    return F.when(even, 1.5).otherwise(0.5), F.when(even, 0.5).otherwise(1.5)


def schedule(docs: DataFrame, budget: float = 1.5, weights: tuple[float, ...] = (5.0, 2.0, 1.0)) -> DataFrame:
    """Each row of ``allot`` by the curriculum: ``uses``, an array of (pass, words, training_position), one element per
    pass that takes words of the row; ``taken``, the words of all of them; ``training_position``, that of the first.

    Rows are range-sorted by position, so they come in the order in which training first meets them; rows that are not
    used have no position and come last.
    """
    plan = allot(docs, budget, weights).drop("taken")
    whole, source_size = F.floor("target"), F.col("source_size")
    last = F.when(source_size > 0, F.floor(whole / source_size)).otherwise(0).cast("int")
    start, end = curriculum(F.col("rank"))

    def use(number: Column) -> Column:
        ahead = number * source_size + F.col("before")
        words = F.greatest(F.lit(0), F.least(F.col("size"), whole - ahead)).cast("long")
        due = position(ahead.cast("double"), F.col("target"), start, end)
        return F.struct(number.alias("pass"), words.alias("words"), due.alias("training_position"))

    uses = F.filter(F.transform(F.sequence(F.lit(0), last), use), lambda u: u["words"] > 0)
    plan = plan.withColumn("uses", uses)
    taken = F.aggregate("uses", F.lit(0).cast("long"), lambda n, u: n + u["words"])
    first = F.array_min(F.transform("uses", lambda u: u["training_position"]))
    plan = materialise(plan.withColumn("taken", taken).withColumn("training_position", first), "schedule")
    order = [F.col("training_position").asc_nulls_last(), F.col("doc_id")]
    return plan.repartitionByRange(*order).sortWithinPartitions(*order)


def mix(
    docs: DataFrame, budget: float = 1.5, weights: tuple[float, ...] = (5.0, 2.0, 1.0), position_col: str = "training_position"
) -> DataFrame:
    """The documents as they are trained on, in order: a row each time that one is used, with its training position.

    A document of which the last pass takes at least half is used whole in it; the others are left out of that pass.
    Documents without words go. Other columns may have any names; one called ``position_col`` is replaced. Rows that
    share an id are told apart by their text and source; an empty table stays empty.
    """
    plan = materialise(allot(docs, budget, weights), "plan")
    repeated = not plan.groupBy("doc_id").count().where("count > 1").isEmpty()
    if repeated:  # rows that share an id are told apart by their place among them
        nth = Window.partitionBy("doc_id").orderBy("tie", "before")
        plan = plan.withColumn("nth", F.row_number().over(nth))
    size = F.col("size")
    uses = F.floor(F.col("taken") / size) + F.when(F.col("taken") % size * 2 >= size, 1).otherwise(0)
    plan = plan.where("size > 0").withColumn("uses", uses.cast("int")).where("uses > 0")
    start, end = curriculum(F.col("rank"))
    plan = plan.withColumn("pass", F.explode(F.sequence(F.lit(0), F.col("uses") - 1)))
    word = (F.col("pass") * F.col("source_size") + F.col("before")).cast("double")
    due = position(word, F.col("target"), start, end)
    keep = [c for c in docs.columns if c.lower() != position_col.lower()]
    the_id, place, own = private([*docs.columns, position_col], "_id", "_nth", "_own")
    rows, same = docs.select(*quoted(keep)), F.col("doc_id").eqNullSafe(F.col(the_id))
    due = plan.select(F.col("doc_id").alias(the_id), *[F.col("nth").alias(place)] * repeated, due.alias(position_col))
    if repeated:
        nth = Window.partitionBy("doc_id").orderBy(F.xxhash64("text", "source"))
        rows, same = rows.withColumn(own, F.row_number().over(nth)), same & (F.col(own) == F.col(place))
    # A row per use grows with the data, so it is never broadcast, whatever its size here.
    picked = rows.join(due.hint("merge"), same).select(*quoted(keep), position_col)
    return picked.repartitionByRange(position_col, "doc_id").sortWithinPartitions(position_col, "doc_id")
