"""Exact set-similarity self-join (Jaccard >= 0.8 over word shingles) by a universe-partition pigeonhole.

Hashing cuts the universe of shingles into m segments. Two sets that differ in at most H shingles agree on some
segment of any H + 1 segments, since each differing shingle spoils one. So a set is indexed under the contents of its
segments; two sets that are similar enough meet in a bucket. Where segments would be too small to tell texts apart, a
segment is indexed under its one-deletion neighbourhood as well (its content, and its content without each of its
shingles): then two sets meet there while at most one shingle differs, and the segment is worth 2 in the pigeonhole
count instead of 1.

Sizes fall into bands with a ratio over 1.25, so similar sets lie in the same band or in adjacent ones. Each band has
its own m and kind of segments, chosen by cost. A set is indexed by its own band's rules and, if it may have larger
partners there, by the next band's.

A set only needs H + 1 worth of its segments. Which ones is decided by cost once bucket sizes are known: buckets of one
set are free. A set whose free segments are enough has no partner at all and goes; another keeps its cheapest ones.
Of the sets that are left, shingles that only one set has are counted: they differ in any pair, so two sets with too
many of them between them are no pair. In each bucket the set with the fewest is the likeliest partner of all others
and is tried first; pairs across the components that this leaves are then all tried. Every pair that is tried is
verified on the sets themselves.

Sets are told apart by a 63-bit digest of their 64-bit shingle hashes, so copies count once from the start.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.operators.components import components
from .exact_dedup import sized_join
from graphloom.runtime import private, ship, trim, turn_to
from graphloom.storage import free_shuffles, materialise, release
from .words import encoded, mix, shingle_hashes, word_hashes

#: Jaccard similarity as a fraction of whole numbers, compared without rounding: 100 * both >= 80 * either.
NUM, DEN = 80, 100
#: Cost of a one-shingle segment in units of a signature: such buckets collect sets that share just a phrase.
LOOSE = 8.0
#: Times that a set is dealt into segments anew if too many of them came out empty.
TRIES = 3
#: Signatures that one task of the bucket stage gets.
BUCKET_ROWS = 500_000
#: A signature of more sets in one batch than this is pre-aggregated there: its rows stay out of the bucket's shuffle.
HOT = 32


def differ(a: int, b: int) -> int:
    """Most shingles in just one of two sets of these sizes that are similar: D <= (DEN - NUM) / (DEN + NUM) * (a + b)."""
    return (DEN - NUM) * (a + b) // (DEN + NUM)


def largest(n: int) -> int:
    """Size of the largest set that can be similar to one of size n."""
    return n * DEN // NUM


@lru_cache(maxsize=None)
def band_start(j: int) -> int:
    """Sizes 1-4 allow no difference, 5-8 one; from there each band is about 1.56 times as wide as the one before."""
    return (1, 5, 9)[j] if j < 3 else band_start(j - 1) * 25 // 16


@lru_cache(maxsize=None)
def band_of(n: int) -> int:
    j = 0
    while band_start(j + 1) <= n:
        j += 1
    return j


def allowed(n: int, j: int) -> int:
    """Most differing shingles between a set of size n and a partner when they meet under the rules of band j."""
    return differ(n, min(largest(n), band_start(j + 1) - 1))


@lru_cache(maxsize=None)
def plan(j: int) -> tuple[int, int]:
    """(segments, worth) of band j: the cheapest that suffice for its sets with a margin of four standard deviations."""
    lo, hi = band_start(j), band_start(j + 1) - 1
    sizes = sorted({lo, hi, max(1, -(-lo * NUM // DEN))})
    best = None
    for worth in (1, 2):
        for m in range(1, 2 * (allowed(hi, j) + 1) + 8):

            def margin(n: int, m=m, worth=worth) -> float:
                none = (1 - 1 / m) ** n
                one = n / m * (1 - 1 / m) ** (n - 1) if n > 1 or m > 1 else 1.0
                mean = m * (1 - none) if worth == 1 else m * (2 * (1 - none - one) + one)
                spread = math.sqrt(m * none * (1 - none)) if worth == 1 else math.sqrt(m * (4 * none + one))
                return mean - (4 * spread if m > 1 else 0) - allowed(n, j) - 1

            if min(margin(n) for n in sizes) < 0:
                continue
            n = math.sqrt(lo * hi)
            lonely = n * (1 - 1 / m) ** (n - 1) if m > 1 else 0.0
            cost = (m if worth == 1 else m + n) + LOOSE * lonely * (worth == 1)
            if best is None or cost < best[0]:
                best = (cost, m, worth)
            break
    return best[1:] if best else (1 + allowed(hi, j) // 2, 2)


def set_of(words: np.ndarray) -> np.ndarray:
    return np.unique(shingle_hashes(words))


def key_of(s: np.ndarray) -> int:
    """63 bits that name the set: even, so that the lowest bit is free."""
    h = mix(np.array([s.sum(dtype=np.uint64), np.bitwise_xor.reduce(mix(s)), np.uint64(len(s))], np.uint64) + np.arange(3, dtype=np.uint64))
    return int(mix(h.sum(dtype=np.uint64, keepdims=True))[0] & np.uint64(0xFFFFFFFFFFFFFFFE))


def segments(s: np.ndarray, j: int, attempt: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(shingles in order of their segment, start of each segment that has any, its number, its size)."""
    m = plan(j)[0]
    if attempt:
        s = np.sort(mix(s + np.uint64(attempt) * np.uint64(0x9E3779B97F4A7C15)))
    seg = ((s >> np.uint64(32)) * np.uint64(m)) >> np.uint64(32)
    start = np.flatnonzero(np.diff(seg, prepend=np.uint64(2**63)))
    return s, start, seg[start], np.diff(start, append=len(s))


def signatures(s: np.ndarray, j: int) -> tuple[np.ndarray, int, int, int]:
    """(signatures under band j, worth of the sound attempt's segments, worth of one, most differing shingles).

    The lowest six bits of a signature are its segment's number. If no attempt has enough segments, all that were made
    count, and the first H + 1 shingles in order of hash are signatures of their own (prefix filter); worth 0 says that
    nothing may be pruned.
    """
    worth, h = plan(j)[1], allowed(len(s), j)
    out = []
    for attempt in range(TRIES):
        t, start, number, size = segments(s, j, attempt)
        x = mix(t + np.uint64(0xD6E8FEB86659FD93))
        total = np.add.reduceat(x, start)
        name = mix((number << np.uint64(12)) + np.uint64(j << 4 | attempt))
        low = number & np.uint64(63)
        made = [(mix(total + name) & ~np.uint64(63)) | low]
        if worth == 2:
            at = np.repeat(np.arange(len(start)), size)
            keep = size[at] > 1
            made.append((mix(total[at] - x + name[at]) & ~np.uint64(63))[keep] | low[at][keep])
        out.append(np.concatenate(made))
        have = len(start) if worth == 1 else int(np.minimum(size, 2).sum())
        if have > h:
            return np.concatenate(out), have if not attempt else 0, worth if not attempt else 0, h
    prefix = mix(s[: allowed(band_start(j + 1) - 1, j) + 1] + np.uint64(j << 4 | 15)) & ~np.uint64(63)
    return np.concatenate([*out, prefix]), 0, 0, h


def roles(n: int) -> list[tuple[int, int]]:
    """(bit, band) under which a set of size n is indexed: 0 its own band, 1 the next one if partners may lie there."""
    j = band_of(n)
    return [(0, j)] + [(1, j + 1)] * (largest(n) >= band_start(j + 1))


def describe(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, key, n_signatures) of each row; key is null for texts without words."""
    ship(docs.sparkSession)

    @F.pandas_udf("n long, key long, n_signatures long")
    def look(texts: pd.Series) -> pd.DataFrame:
        turn_to("sets")
        out = []
        for w in word_hashes(encoded(texts)):
            s = set_of(w)
            if not len(s):
                out.append((0, None, 0))
                continue
            many = sum(plan(j)[0] + (len(s) if plan(j)[1] == 2 else 0) for _, j in roles(len(s)))
            out.append((len(s), key_of(s) - (1 << 63), many))
        # as objects: beside a None, pandas would make floats of the keys
        got = pd.DataFrame(out, columns=["n", "key", "n_signatures"], dtype=object)
        return got.astype({"n": "int64", "key": "Int64", "n_signatures": "int64"})

    look = look.asNondeterministic()  # or a filter on a part of what it returns would run it once more
    got = docs.select(F.col(id_col).alias("doc_id"), look(F.col(text_col).cast("string")).alias("got"))
    return got.select("doc_id", F.col("got.n").alias("n_shingles"), F.col("got.key").alias("key"), "got.n_signatures")


def _index(tasks: int):
    """Texts -> a blob of (signature, unit) pairs for each bucket task, hot signatures apart; and the units' figures."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        turn_to("sets")
        for pdf in parts:
            for at in range(0, len(pdf), 1000):
                yield from batch(pdf["text"].iloc[at : at + 1000])
        trim()

    def batch(texts: pd.Series) -> Iterator[pd.DataFrame]:
        sigs, units, seen, facts = [], [], set(), []
        for w in word_hashes(encoded(texts)):
            s = set_of(w)
            if not len(s) or (key := key_of(s)) in seen:
                continue
            seen.add(key)
            for bit, j in roles(len(s)):
                sig, have, worth, most = signatures(s, j)
                sigs.append(sig)
                units.append(np.full(len(sig), key | bit, np.uint64))
                facts.append((key | bit, len(s), have, worth, most))
        if not facts:
            return
        pairs = np.empty(sum(map(len, sigs)), _PAIR)
        pairs["sig"], pairs["unit"] = np.concatenate(sigs), np.concatenate(units)
        pairs = pairs[np.argsort(pairs["sig"], kind="stable")]
        start = np.flatnonzero(np.diff(pairs["sig"], prepend=~pairs["sig"][:1]))
        size = np.diff(start, append=len(pairs))
        hot = np.repeat(size >= HOT, size)
        first = np.zeros(len(pairs), bool)
        first[start] = True
        blobs = []
        for kind, rows in ((0, pairs[~hot | first]), (1, pairs[hot])):
            # hot rows go to any task, dealt by unit; the others by signature, all of one to one task
            part = mix(rows["unit" if kind else "sig"] >> np.uint64(6)) % np.uint64(tasks)
            order = np.argsort(part, kind="stable")
            rows, part = rows[order], part[order]
            cut = np.flatnonzero(np.diff(part, prepend=np.uint64(2**63)))
            for a, b in zip(cut, [*cut[1:], len(rows)][: len(cut)], strict=True):
                blobs.append((int(part[a]), kind, rows[a:b].tobytes()))
        figures = np.array([(f[0] - (1 << 63), *f[1:]) for f in facts], np.int64)
        blobs.append((facts[0][0] % tasks, 2, figures.tobytes()))
        yield pd.DataFrame(blobs, columns=["part", "kind", "blob"])

    return run


_PAIR = np.dtype([("sig", "<u8"), ("unit", "<u8")])


def _signed(x: np.ndarray) -> np.ndarray:
    """Unsigned numbers as signed ones in the same order."""
    return (x ^ np.uint64(1 << 63)).view(np.int64)


def _buckets(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The pairs of signatures that two or more units share; hot ones as they are; the figures of units."""
    turn_to("sets")
    held = []
    for pdf in parts:
        for kind, blob in zip(pdf["kind"], pdf["blob"], strict=True):
            if kind == 0:
                held.append(np.frombuffer(blob, _PAIR))
            elif kind == 1:
                rows = np.frombuffer(blob, _PAIR)
                yield pd.DataFrame({"sig": _signed(rows["sig"]), "unit": _signed(rows["unit"]), "n": None, "have": None, "worth": None, "most": None})
            else:
                rows = np.frombuffer(blob, np.int64).reshape(-1, 5)
                yield pd.DataFrame(rows, columns=["unit", "n", "have", "worth", "most"]).assign(sig=None)[_FOUND]
    if not held:
        return
    pairs = np.concatenate(held)
    held.clear()
    pairs = pairs[np.argsort(pairs["sig"], kind="stable")]
    start = np.flatnonzero(np.diff(pairs["sig"], prepend=~pairs["sig"][:1]))
    size = np.diff(start, append=len(pairs))
    pairs = pairs[np.repeat(size > 1, size)]
    pairs = pairs[np.lexsort((pairs["unit"], pairs["sig"]))]  # copies of a text are one unit
    pairs = pairs[(np.diff(pairs["sig"], prepend=~pairs["sig"][:1]) != 0) | (np.diff(pairs["unit"], prepend=~pairs["unit"][:1]) != 0)]
    start = np.flatnonzero(np.diff(pairs["sig"], prepend=~pairs["sig"][:1]))
    size = np.diff(start, append=len(pairs))
    pairs = pairs[np.repeat(size > 1, size)]
    for at in range(0, len(pairs), 100_000):
        rows = pairs[at : at + 100_000]
        yield pd.DataFrame({"sig": _signed(rows["sig"]), "unit": _signed(rows["unit"]), "n": None, "have": None, "worth": None, "most": None})


_FOUND = ["sig", "unit", "n", "have", "worth", "most"]


def _typed(run):
    def wrapped(parts):
        for pdf in run(parts):
            yield pdf[_FOUND].astype("Int64")
        trim()

    return wrapped


def set_table(docs: DataFrame, ids: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, key, set: its shingles as sorted 64-bit numbers in binary) of the rows whose id is in ``ids`` (column ``_id``)."""
    ship(docs.sparkSession)
    some = sized_join(docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")),
                      ids, F.col("id").eqNullSafe(F.col("_id")), "left_semi")

    @F.pandas_udf("key long, set binary")
    def sets(texts: pd.Series) -> pd.DataFrame:
        keys, made = [], []
        for w in word_hashes(encoded(texts)):
            s = set_of(w)
            keys.append(key_of(s) - (1 << 63) if len(s) else None)
            made.append(s.tobytes())
        return pd.DataFrame({"key": pd.array(keys, "Int64"), "set": made})

    sets = sets.asNondeterministic()  # or the joins' filters on the key would run it once more
    return some.select("id", sets("text").alias("got")).select("id", "got.key", "got.set")


def _jaccard(a: pd.Series, b: pd.Series) -> pd.Series:
    out = []
    for x, y in zip(a, b, strict=True):
        x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
        at = np.searchsorted(x, y)
        both = int(np.count_nonzero(x[np.minimum(at, len(x) - 1)] == y)) if len(x) and len(y) else 0
        either = len(x) + len(y) - both
        out.append(both / either if either else 0.0)
    return pd.Series(out, dtype="float64")


def _lack(a: pd.Series, b: pd.Series) -> pd.Series:
    """The shingles of b that a lacks, by 32 bits of each, if a pair of a's size could differ in so many; null otherwise."""
    out = []
    for x, y in zip(a, b, strict=True):
        x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
        lack = np.setdiff1d(y, x, assume_unique=True)
        out.append((lack >> np.uint64(32)).astype(np.uint32).view(np.int32) if len(lack) <= differ(len(x), largest(len(x))) else None)
    return pd.Series(out, dtype=object)


def with_lack(pairs: DataFrame, sets: DataFrame, a: str, b: str) -> DataFrame:
    left = sets.select(F.col("id").alias(a), F.col("set").alias("_x"))
    right = sets.select(F.col("id").alias(b), F.col("set").alias("_y"))
    return pairs.join(left, a).join(right, b).select(*pairs.columns, F.pandas_udf(_lack, "array<int>")("_x", "_y").alias("lack"))


def with_jaccard(pairs: DataFrame, sets: DataFrame, a: str, b: str) -> DataFrame:
    left = sets.select(F.col("id").alias(a), F.col("set").alias("_x"))
    right = sets.select(F.col("id").alias(b), F.col("set").alias("_y"))
    met = pairs.join(left, a).join(right, b)
    return met.select(*pairs.columns, F.pandas_udf(_jaccard, "double")("_x", "_y").alias("jaccard"))


def verified(docs: DataFrame, pairs: DataFrame, least: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The pairs (doc_id, match_id) whose Jaccard similarity is ``least`` or more, with it."""
    pairs = materialise(pairs, "pairs")
    ids = materialise(pairs.select(F.col("doc_id").alias("_id")).union(pairs.select("match_id")).distinct(), "pair_ids")
    sets = materialise(set_table(docs, ids, id_col, text_col).dropDuplicates(["id"]), "sets")
    return with_jaccard(pairs, sets, "doc_id", "match_id").where(F.col("jaccard") >= least)


def similar_sets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(described, links): every row's size and key, and verified links (a, b) between keys that suffice for components.

    Keys in no link have no similar set. Within a bucket whose members turn out to be connected, links that add nothing
    are not looked for.
    """
    spark = docs.sparkSession
    described = materialise(describe(docs, id_col, text_col), "described")
    total = described.agg(F.sum("n_signatures")).first()[0] or 0
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), total // BUCKET_ROWS + 1)
    blobs = docs.select(F.col(text_col).cast("string").alias("text")).mapInPandas(_index(tasks), "part int, kind int, blob binary")
    found = blobs.repartition(tasks, "part").mapInPandas(_typed(_buckets), ", ".join(f"{c} long" for c in _FOUND))
    found = materialise(found, "buckets")
    free_shuffles(spark)

    units = found.where("sig is null").select("unit", "n", "have", "worth", "most").distinct()
    rows = found.where("sig is not null").select("sig", "unit").distinct()
    sizes = rows.groupBy("sig").agg(F.count(F.lit(1)).alias("members")).where("members > 1")
    rows = rows.join(sizes, "sig").join(units, "unit")
    # What a set's segments cost. worth 1: a signature is a segment; worth 2: those with the same low bits are.
    place = F.when(F.col("worth") == 2, F.col("sig").bitwiseAND(63)).otherwise(F.col("sig"))
    rows = rows.withColumn("place", place)
    cost = F.sum("members").over(Window.partitionBy("unit", "place"))
    rows = rows.withColumn("cost", cost)
    rank = F.dense_rank().over(Window.partitionBy("unit").orderBy("cost", "place"))
    rows = rows.withColumn("rank", rank)
    shared = F.max("rank").over(Window.partitionBy("unit"))
    need = F.col("most") + 1 - (F.col("have") - F.col("worth") * shared)
    rows = rows.withColumn("need", F.when(F.col("worth") == 0, F.lit(1 << 40)).otherwise(need)).where("need > 0")
    kept = (F.col("rank") - 1) * F.greatest(F.lit(1), F.col("worth")) < F.col("need")
    key = F.col("unit").bitwiseAND(F.lit(-2))
    rows = rows.select("sig", key.alias("key"), F.col("unit").bitwiseAND(1).alias("upper"), "n", kept.alias("kept"))
    rows = materialise(rows, "candidates")
    release(found)
    free_shuffles(spark)

    # The sets themselves, from one document of each key.
    keys = materialise(rows.select("key").distinct(), "keys")
    one = described.where("key is not null").groupBy("key").agg(F.min("doc_id").alias("_id"))
    ids = materialise(one.join(keys, "key", "left_semi").select("_id"), "set_ids")
    sets = set_table(docs, ids, id_col, text_col).select(F.col("key").alias("id"), "set")
    sets = materialise(sets.join(keys, F.col("id") == F.col("key"), "left_semi").dropDuplicates(["id"]), "sets")

    # Shingles that no other of these sets has differ in every pair: D(a, b) >= alone(a) + alone(b).
    candidates = rows
    rows = rows.join(unshared(sets), "key", "left").withColumn("alone", F.coalesce("alone", F.lit(0)))
    rows = rows.where(f"{DEN + NUM} * alone <= {DEN - NUM} * (n + n * {DEN} div {NUM})")
    hopeful = materialise(rows, "hopeful")
    release(candidates)
    rows = hopeful
    free_shuffles(spark)

    pairs = materialise(_pairs(rows.withColumn("component", F.col("key")), "first"), "pairs_first")
    checked = materialise(with_jaccard(pairs, sets, "key", "key_"), "checked_first")
    release(pairs)
    free_shuffles(spark)
    tried = checked.select("a", "b")
    links = checked.where(F.col("jaccard") >= NUM / DEN).select("a", "b")
    label = None if links.isEmpty() else components(links)
    still = materialise(open_buckets(rows, label), "open")
    release(rows)
    rows = materialise(with_leads(still, leads(checked), sets), "led")
    release(still)
    for step in ("last", "all"):
        pairs = materialise(_pairs(rows, step).join(tried, ["a", "b"], "left_anti"), f"pairs_{step}")
        checked = materialise(with_jaccard(pairs, sets, "a", "b"), f"checked_{step}")
        release(pairs)
        free_shuffles(spark)
        good = checked.where(F.col("jaccard") >= NUM / DEN).select("a", "b")
        links = links.unionByName(good)
        tried = tried.unionByName(checked.select("a", "b"))
        if step == "last" and not good.isEmpty():
            still = materialise(open_buckets(rows.drop("component"), components(links)), "open")
            release(rows)
            rows = still
    release(rows, sets)
    return described, links


def open_buckets(rows: DataFrame, label: DataFrame | None) -> DataFrame:
    """The rows of buckets whose members aren't all connected, with their component; other buckets have nothing left to
    tell, now or after more links. Of buckets with the same members one stays, told by a 128-bit digest of them."""
    if label is None:
        now = rows.withColumn("component", F.col("key"))
    else:
        now = rows.join(label.withColumnRenamed("node", "key"), "key", "left")
        now = now.withColumn("component", F.coalesce("component", "key"))
    member = [F.bit_xor(F.xxhash64(F.lit(i), "key", "upper", "kept")).alias(f"digest{i}") for i in (1, 2)]
    ends = now.groupBy("sig").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count(F.lit(1)).alias("members"), *member)
    one = ends.where("lo <> hi").groupBy("members", "digest1", "digest2").agg(F.min("sig").alias("sig"))
    return now.join(one.select("sig"), "sig", "left_semi")


def leads(checked: DataFrame) -> DataFrame:
    """(key, lead, miss): the likeliest partner that a set was compared with, and how many of its shingles the set lacks."""
    both = F.round(F.col("jaccard") * (F.col("n") + F.col("n_")) / (1 + F.col("jaccard"))).cast("long")
    best = F.min(F.struct("alone_", "key_", (F.col("n_") - both).alias("miss"))).alias("best")
    return checked.groupBy("key").agg(best).select("key", F.col("best.key_").alias("lead"), "best.miss")


def with_leads(rows: DataFrame, lead: DataFrame, sets: DataFrame) -> DataFrame:
    """Adds lead, miss and lack (the lead's shingles that the set lacks, if they aren't too many) to each row; a set that
    was compared with none leads itself.

    Sets a and b with the same lead p differ at least in the shingles that only a or only b has, and in those of p that
    one of them lacks and the other doesn't: alone(a) + alone(b) + |lack(a) symmetric difference lack(b)|, or at least
    |miss(a) - miss(b)|. Shingles that share their 32 bits only make the difference smaller. A pair of a set and its lead
    was tried already, so it doesn't matter that the bound says too much there.
    """
    some = materialise(lead.join(rows.select("key").distinct(), "key", "left_semi"), "leads")
    lacks = materialise(with_lack(some, sets, "key", "lead"), "lacks")
    return rows.join(lacks, "key", "left").withColumns({
        "lack": F.when(F.col("lead").isNull(), F.array().cast("array<int>")).otherwise(F.col("lack")),
        "lead": F.coalesce("lead", "key"), "miss": F.coalesce("miss", F.lit(0))})


def unshared(sets: DataFrame) -> DataFrame:
    """(key, alone): how many shingles of each set are in no other one. Shingles that sets of one batch share go on as
    one row, so a very common one costs a row per batch."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            if not len(pdf):
                continue
            made = [np.frombuffer(x, np.uint64) for x in pdf["set"]]
            h = np.concatenate(made)
            key = np.repeat(pdf["id"].to_numpy(np.int64), [len(x) for x in made])
            h, first, n = np.unique(h, return_index=True, return_counts=True)
            yield pd.DataFrame({"h": _signed(h), "key": key[first], "n": np.minimum(n, 2).astype(np.int32)})

    found = sets.mapInPandas(run, "h long, key long, n int").groupBy("h").agg(F.sum("n").alias("n"), F.min("key").alias("key"))
    return found.where("n = 1").groupBy("key").agg(F.count(F.lit(1)).alias("alone"))


def _pairs(rows: DataFrame, step: str) -> DataFrame:
    """Pairs to verify: each member of a bucket with the one that has the fewest shingles to itself, then with the last
    one; at the end all that are not connected yet. Pairs whose own shingles alone make them differ too much are out."""
    columns = ["alone", "key", "upper", "n", "kept", "component"] + ["lead", "miss", "lack"] * (step != "first")
    if step == "all":
        other = rows.select("sig", *[F.col(c).alias(f"{c}_") for c in columns])
        met = rows.join(other, "sig").where("key < key_ and (kept or kept_)")
    else:
        order = columns if step == "first" else ["key", *[c for c in columns if c != "key"]]
        head = rows.groupBy("sig").agg((F.min if step == "first" else F.max)(F.struct(*order)).alias("h"))
        met = rows.join(head.select("sig", *[F.col(f"h.{c}").alias(f"{c}_") for c in columns]), "sig").where("key <> key_")
    met = met.where("component <> component_ and upper + upper_ < 2")
    met = met.where(f"{DEN} * least(n, n_) >= {NUM} * greatest(n, n_) and {DEN + NUM} * (alone + alone_) <= {DEN - NUM} * (n + n_)")
    if step != "first":
        apart = "coalesce(size(array_except(lack, lack_)) + size(array_except(lack_, lack)), abs(miss - miss_))"
        met = met.where(f"lead <> lead_ or {DEN + NUM} * (alone + alone_ + {apart}) <= {DEN - NUM} * (n + n_)")
    pair = [F.least("key", "key_").alias("a"), F.greatest("key", "key_").alias("b")]
    return met.select(*pair, *(["key", "key_", "n", "n_", "alone_"] if step == "first" else [])).distinct()


def near_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id) of each row: the least doc_id that links reach, itself included.

    Links hold between texts whose sets of shingles have a Jaccard similarity of 0.8 or more. Texts without words, null
    or not, have an empty set and are linked with nothing. Rows that repeat fall together; a null id never is the
    component's id unless all of its rows have none.
    """
    described, links = similar_sets(docs, id_col, text_col)
    label = materialise(components(links), "components").withColumnRenamed("node", "key")
    of = described.where("key is not null").groupBy("key").agg(F.min("doc_id").alias("first"))
    of = of.join(label, "key", "left").withColumn("component", F.coalesce("component", "key"))
    of = materialise(of, "of_key")
    least = of.groupBy("component").agg(F.min("first").alias("component_id"))
    named = materialise(of.join(least, "component").select("key", "component_id"), "named")
    # A key may be that of many copies: the key's row is unique, so only the copies' side can be skewed.
    out = described.join(named, "key", "left")
    return out.select("doc_id", "n_shingles", F.when(F.col("key").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that are the first of their component, with all their columns.

    Where an id is on several rows, it goes if all of them do; of rows that repeat as a whole one stays. Rows without an
    id stay. Other columns may have any names; an empty table stays empty.
    """
    found = materialise(near_components(docs, id_col, text_col), "near")
    by_id = found.groupBy("doc_id").agg(F.count(F.lit(1)).alias("rows"), F.bool_and(F.col("doc_id") != F.col("component_id")).alias("goes"))
    by_id = materialise(by_id, "near_ids")
    (the_id,) = private(docs.columns, "_id")
    out = sized_join(docs, by_id.where("goes").select(F.col("doc_id").alias(the_id)), F.col(id_col) == F.col(the_id), "left_anti")
    return out if by_id.where("rows > 1").isEmpty() else out.dropDuplicates()
